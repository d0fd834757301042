"""Alignment of two tokenizers' tokens over the same bytes, by fragments that compose.

Both encodings of a text spell the same bytes. Where tokens of both end at one byte,
the text is cut into groups. A byte range yields a *fragment*: the tokens up to its
first common end (open prefix), the closed groups, and the tokens after its last
common end (open suffix). Two neighbouring fragments compose: the left suffix and the
right prefix make one more group, or stay open where a side has no common end. This is
associative, so the fragments of a long document are composed over a tree, each node
in a task of its own, and only open ends travel up. A short document is one fragment
and is closed where it is encoded, many documents at a time.

Long documents are also encoded in parts. A part begins at a single blank between two
word characters: no match of the first tokenizer's pattern spans it, and no piece of
the second may hold a word mark after another character (checked when it is loaded),
so the parts' tokens are the whole text's tokens. A text without such a place stays
one part.

Tokens with bytes that overlap are *linked*. Between two neighbouring ends of any
tokens lies exactly one token of each side, so the links of a document are as many as
its distinct ends. How many documents hold a linked pair of ids is counted over the
whole corpus. The pairs that most documents hold are few by arithmetic (their number
is at most all rows by the least count) and are broadcast; all others are joined by
pair, where no key has many rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from shelfspark.llm.batches import other_columns, quoted, slices
from shelfspark.llm.graph import stored

#: Bytes from which a document is cut into parts, and the least bytes of a part.
LONG_BYTES = 32 << 10
#: Bytes of a fragment's range, and fragments composed by one node of the tree.
CHUNK_BYTES = 8 << 10
FAN = 16
#: Most pairs of ids that are broadcast.
HOT_PAIRS = 300_000
#: Bytes of text encoded at a time.
ENCODE_BYTES = 1 << 20

_CUT = re.compile(r"(?<=\w)\x20(?=\w)")


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokens(NamedTuple):
    """Tokens of many texts, one after another: ids, ends in the joined bytes, tokens of each text."""

    ids: np.ndarray
    ends: np.ndarray
    counts: np.ndarray


class Ends(NamedTuple):
    """All ends, the common ones, and the tokens of both sides that end before each."""

    every: np.ndarray
    common: np.ndarray
    every_a: np.ndarray
    every_b: np.ndarray
    common_a: np.ndarray
    common_b: np.ndarray


class Tokenizers:
    """Both tokenizers, with the bytes of each id.

    Given the ``pattern`` that the first one cuts a text by, its vocabulary is handed to the
    tiktoken library as ranks, which gives the same ids several times faster. That holds if
    it is plain byte-level BPE with ids in the order of its merges; else its own library is used.
    """

    def __init__(self, path_a: str, path_b: str, pattern: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece

        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        byte = byte_of_char()
        by_id = {i: t for t, i in (spec["model"]["vocab"] | added).items()}
        spelled = lambda t: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
        self.a_bytes = [spelled(by_id.get(i, "")) for i in range(max(by_id) + 1)]
        self.a = self.fast = None
        if pattern and self._ranked(spec):
            import tiktoken

            ranks = {self.a_bytes[i]: i for i in spec["model"]["vocab"].values()}
            self.fast = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        else:
            from tokenizers import Tokenizer

            self.a = Tokenizer.from_file(path_a)
            self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.parts_certain = not any(re.search("[^▁]▁", p) for p in pieces)
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.a_text = [np.array([f"{i}{sep}" for i in range(len(self.a_bytes))], "S") for sep in ",|"]
        self.b_text = [np.array([f"{i}{sep}" for i in range(len(self.b_bytes))], "S") for sep in ",;"]

    @staticmethod
    def _ranked(spec: dict) -> bool:
        """Is it a byte-level vocabulary whose merges are in the order of their ids?"""
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        plain = not spec.get("normalizer") and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        plain = plain and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        merged = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        return plain and merged == sorted(merged) and len(merged) + 256 == len(model["vocab"])

    def encode(self, texts: list[str | None]) -> tuple[Tokens, Tokens, np.ndarray]:
        """Tokens of both sides, and whether a text has any: those of texts that a side doesn't spell are left out."""
        whole = [" " + t if t else "" for t in texts]
        if self.fast:
            a = [self.fast.encode_to_numpy(t, disallowed_special=()) for t in whole]
        else:
            a = [np.array(e.ids, np.uint32) for e in self.a.encode_batch_fast(whole, add_special_tokens=False)]
        b = [np.array(ids, np.uint32) for ids in self.b.encode([t or "" for t in texts], num_threads=1)]
        fine = np.zeros(len(texts), bool)
        for i, text in enumerate(whole):
            want = text.encode()
            fine[i] = bool(want) and all(b"".join(map(size.__getitem__, ids.tolist())) == want for ids, size in ((a[i], self.a_bytes), (b[i], self.b_bytes)))
        return self._joined(a, fine, self.a_size), self._joined(b, fine, self.b_size), fine

    @staticmethod
    def _joined(rows: list[np.ndarray], fine: np.ndarray, size: np.ndarray) -> Tokens:
        rows = [r if ok else r[:0] for r, ok in zip(rows, fine)]
        ids = np.concatenate([np.zeros(0, np.uint32), *rows]).astype(np.int64)
        return Tokens(ids, np.cumsum(size[ids]), np.array([len(r) for r in rows], np.int64))

    def ends(self, a: Tokens, b: Tokens) -> Ends:
        """All ends and common ends, with the number of tokens of each side that end before them."""
        # Places in the bytes from the first end on: sets of ends are marks, ranks among them running sums.
        low = int(min(a.ends[0], b.ends[0])) if len(a.ends) and len(b.ends) else 0
        high = int(max(a.ends[-1], b.ends[-1])) if len(a.ends) and len(b.ends) else -1
        in_a, in_b = np.zeros(high - low + 1, bool), np.zeros(high - low + 1, bool)
        in_a[a.ends - low], in_b[b.ends - low] = True, True
        every, common = np.flatnonzero(in_a | in_b), np.flatnonzero(in_a & in_b)
        through_a, through_b = np.cumsum(in_a, dtype=np.int32), np.cumsum(in_b, dtype=np.int32)
        before = lambda through, marks, at: (through[at] - marks[at]).astype(np.int64)
        return Ends(every + low, common + low, before(through_a, in_a, every), before(through_b, in_b, every), before(through_a, in_a, common), before(through_b, in_b, common))

    def groups_text(self, a: Tokens, b: Tokens, ends: Ends) -> tuple[bytes, np.ndarray]:
        """All groups as ``a1,a2|b1;...`` with a mark after each, and the place of each group's end in it."""
        n_groups = len(ends.common)
        a_through, b_through = ends.common_a + 1, ends.common_b + 1
        a_each, b_each = np.diff(a_through, prepend=0), np.diff(b_through, prepend=0)
        n = len(a.ids) + len(b.ids)
        out = np.zeros(n, f"S{max(self.a_text[0].itemsize, self.b_text[0].itemsize)}")
        # A group's tokens of the first side stand after all tokens of the groups before it.
        a_at = np.arange(len(a.ids)) + np.repeat(b_through - b_each, a_each)
        b_at = np.arange(len(b.ids)) + np.repeat(a_through, b_each)
        out[a_at], out[b_at] = self.a_text[0][a.ids], self.b_text[0][b.ids]
        if n_groups:
            out[a_at[ends.common_a]], out[b_at[ends.common_b]] = self.a_text[1][a.ids[ends.common_a]], self.b_text[1][b.ids[ends.common_b]]
        raw = out.view(np.uint8).reshape(n, out.itemsize) if n else np.zeros((0, 1), np.uint8)
        places = np.concatenate([[0], np.cumsum(np.count_nonzero(raw, axis=1))])
        return raw[raw != 0].tobytes(), places[a_through + b_through]

    def pairs(self, a: Tokens, b: Tokens, ends: Ends) -> np.ndarray:
        """The linked pair of ids, as one number, before each end."""
        return a.ids[ends.every_a] * len(self.b_bytes) + b.ids[ends.every_b]


class Paths(NamedTuple):
    """Files of both tokenizers (every executor has them), and the first one's pattern if it is known."""

    a: str
    b: str
    pattern: str | None = None


_LOADED: dict[Paths, Tokenizers] = {}


def loaded(paths: Paths) -> Tokenizers:
    if paths not in _LOADED:
        _LOADED[paths] = Tokenizers(*paths)
    return _LOADED[paths]


COUNTS = [StructField(c, LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")]
PAIRS = [StructField("pairs", ArrayType(LongType())), StructField("times", ArrayType(IntegerType()))]


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def distinct_pairs(row: np.ndarray, pair: np.ndarray, n: int, most: int) -> list[pa.Array]:
    """The distinct pairs (numbers under ``most``) of each of ``n`` rows, and how often each is linked."""
    key, times = np.unique(row * most + pair, return_counts=True)
    row, pair = np.divmod(key, most)
    bounds = np.searchsorted(row, np.arange(n + 1))
    return [lists(pair, bounds, pa.int64()), lists(times, bounds, pa.int32())]


def align_texts(both: Tokenizers, texts: list[str | None], with_groups: bool) -> list[pa.Array]:
    """Whole documents as one closed fragment each: counts, pairs, digest (and text) of the groups."""
    a, b, _ = both.encode(texts)
    ends = both.ends(a, b)
    text, places = both.groups_text(a, b, ends)
    row_ends = np.concatenate([[0], a.ends])[np.cumsum(a.counts)]  # both sides end a text at the same byte
    upto = lambda values: np.diff(np.searchsorted(values, row_ends, "right"), prepend=0)
    n_groups, n_links = upto(ends.common), upto(ends.every)
    bounds = np.concatenate([[0], places])[np.cumsum(n_groups)]
    rows = [text[lo : hi - 1] if hi > lo else b"" for lo, hi in zip([0, *bounds[:-1]], bounds)]
    out = [pa.array(x, pa.int64()) for x in (a.counts, b.counts, n_groups, n_links)]
    most = len(both.a_bytes) * len(both.b_bytes)
    out += distinct_pairs(np.repeat(np.arange(len(texts)), n_links), both.pairs(a, b, ends), len(texts), most)
    out.append(pa.array([hashlib.sha256(r).hexdigest() if r else "" for r in rows]))
    return out + ([pa.array([r.decode() for r in rows])] if with_groups else [])


class Fragment(NamedTuple):
    """A byte range: tokens up to its first common end, and tokens after its last; ``open`` if it has none (then all are prefix)."""

    start: int
    open: bool
    prefix: tuple[list[int], list[int], list[int], list[int]]  # ids and ends of both sides
    suffix: tuple[list[int], list[int], list[int], list[int]]


OPEN_TOKENS = [
    StructField(f"{side}_{part}", ArrayType(LongType())) for side in ("prefix", "suffix") for part in ("a", "a_ends", "b", "b_ends")
]
FRAGMENT = [StructField("start", LongType()), StructField("open", BooleanType()), *OPEN_TOKENS]
PIECE = [StructField("at", LongType()), *COUNTS, *PAIRS, StructField("groups", StringType())]
KEY = [StructField("rid", LongType()), StructField("node", LongType())]
#: A row is a fragment (``at`` is null) or a run of closed groups (``start`` is null).
NODE = StructType([*KEY, *FRAGMENT, *PIECE])


def closed(both: Tokenizers, start: int, tokens: tuple) -> dict:
    """A run of closed groups that begins at byte ``start``, from ids and ends of both sides."""
    a, b = (Tokens(np.array(tokens[i], np.int64), np.array(tokens[i + 1], np.int64), np.array([len(tokens[i])])) for i in (0, 2))
    ends = both.ends(a, b)
    pairs, times = np.unique(both.pairs(a, b, ends), return_counts=True)
    return {
        "at": start, "n_a": len(a.ids), "n_b": len(b.ids), "n_groups": len(ends.common), "n_links": len(ends.every),
        "pairs": pairs.tolist(), "times": times.tolist(), "groups": both.groups_text(a, b, ends)[0][:-1].decode(),
    }


def fragment(both: Tokenizers, start: int, tokens: tuple) -> tuple[Fragment, list[dict]]:
    """The fragment of a byte range from ``start``, and its closed groups."""
    a, a_ends, b, b_ends = tokens
    common = np.intersect1d(np.array(a_ends, np.int64), np.array(b_ends, np.int64), assume_unique=True)
    if not len(common):
        return Fragment(start, True, tokens, ([], [], [], [])), []
    cuts = [np.searchsorted(x, [common[0], common[-1]], "right") for x in (a_ends, b_ends)]
    part = lambda lo, hi: tuple(x[lo(c) : hi(c)] for x, c in ((a, cuts[0]), (a_ends, cuts[0]), (b, cuts[1]), (b_ends, cuts[1])))
    prefix = part(lambda c: 0, lambda c: c[0])
    suffix = part(lambda c: c[1], lambda c: None)
    middle = part(lambda c: c[0], lambda c: c[1])
    return Fragment(start, False, prefix, suffix), [closed(both, int(common[0]), middle)] if len(common) > 1 else []


def compose(both: Tokenizers, left: Fragment, right: Fragment) -> tuple[Fragment, list[dict]]:
    """Two neighbouring fragments as one, and the group closed between them."""
    together = lambda x, y: tuple(list(p) + list(q) for p, q in zip(x, y))
    if left.open:
        return Fragment(left.start, right.open, together(left.prefix, right.prefix), right.suffix), []
    if right.open:
        return Fragment(left.start, False, left.prefix, together(left.suffix, right.prefix)), []
    between = together(left.suffix, right.prefix)
    at = min(between[1][0], between[3][0]) - 1  # between the left part's last common end and the first end after it
    return Fragment(left.start, False, left.prefix, right.suffix), [closed(both, at, between)]


def node_rows(rid: int, node: int, found: Fragment | None, pieces: list[dict]) -> list[dict]:
    empty = dict.fromkeys(NODE.names)
    rows = [{**empty, "rid": rid, "node": node, **p} for p in pieces]
    if found:
        tokens = dict(zip([f.name for f in OPEN_TOKENS], [*found.prefix, *found.suffix]))
        rows.append({**empty, "rid": rid, "node": node, "start": found.start, "open": found.open, **tokens})
    return rows


def arrow_schema(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def parts_of(long: DataFrame, text: str, paths: Paths, least: int) -> DataFrame:
    """(rid, lo, part): each long text in parts that are encoded alike alone; ``lo`` is the part's first byte in blank + text."""
    schema = StructType([StructField("rid", LongType()), StructField("lo", LongType()), StructField("part", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        certain = loaded(paths).parts_certain
        for one in slices(batches, 1):
            for rid, value in zip(one.column(0).to_pylist(), one.column(1).to_pylist()):
                cuts, last = [0], 0
                for m in _CUT.finditer(value) if certain else ():
                    if m.start() - last >= least:
                        cuts.append(last := m.start())
                # A part after a cut begins with its blank, the first with the blank put before the text.
                parts = [value[lo + (lo > 0) : hi] for lo, hi in zip(cuts, [*cuts[1:], None])]
                at = 0
                for part in parts:
                    yield pa.RecordBatch.from_arrays([pa.array([rid], pa.int64()), pa.array([at], pa.int64()), pa.array([part], pa.string())], names=schema.names)
                    at += 1 + len(part.encode())

    return long.select("rid", quoted(text).alias("part")).mapInArrow(run, schema)


def fragments_of(parts: DataFrame, paths: Paths, chunk: int) -> DataFrame:
    """Fragments and closed groups of all parts, a fragment for each byte range of ``chunk``; a part that isn't spelled gives a row without ``node``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, schema = loaded(paths), arrow_schema(NODE)
        for one in slices(batches, 2, ENCODE_BYTES):
            for rid, lo, part in zip(*(c.to_pylist() for c in one.columns)):
                a, b, fine = both.encode([part])
                if not fine[0]:
                    yield pa.RecordBatch.from_pylist(node_rows(rid, None, None, [{}]), schema)
                    continue
                a_ends, b_ends = a.ends + lo, b.ends + lo
                end, start = int(a_ends[-1]), lo
                while start < end:
                    stop = min(end, (start // chunk + 1) * chunk)
                    cut = [np.searchsorted(x, [start, stop], "right") for x in (a_ends, b_ends)]
                    tokens = tuple(x[c[0] : c[1]].tolist() for x, c in ((a.ids, cut[0]), (a_ends, cut[0]), (b.ids, cut[1]), (b_ends, cut[1])))
                    yield pa.RecordBatch.from_pylist(node_rows(rid, start // chunk, *fragment(both, start, tokens)), schema)
                    start = stop

    return parts.mapInArrow(run, NODE)


def composed(rows: DataFrame, paths: Paths, fan: int, last: bool) -> DataFrame:
    """One level of the tree: the fragments of ``fan`` neighbours as one, and the groups closed by that; the last level closes a document's ends."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        both = loaded(paths)
        names = [f.name for f in OPEN_TOKENS]
        found, pieces = None, []
        for r in sorted(table.to_pylist(), key=lambda r: r["start"]):
            one = Fragment(r["start"], r["open"], tuple(r[c] for c in names[:4]), tuple(r[c] for c in names[4:]))
            found, new = (one, []) if found is None else compose(both, found, one)
            pieces += new
        if last:
            pieces.append(closed(both, -1, found.prefix))
        return pa.Table.from_pylist(node_rows(key[0].as_py(), key[1].as_py(), None if last else found, pieces), arrow_schema(NODE))

    return rows.withColumn("node", F.expr(f"node div {fan}")).groupBy("rid", "node").applyInArrow(run, NODE)


def long_documents(long: DataFrame, text: str, paths: Paths, least: int, chunk: int, fan: int, with_groups: bool) -> tuple[DataFrame, DataFrame]:
    """Long documents: (rid, counts, digest) of each, and (rid, pair, times)."""
    parts = stored(parts_of(long, text, paths, least), "align-parts").repartition("rid", "lo")
    leaves = stored(fragments_of(parts, paths, chunk), "align-fragments")
    unspelled = leaves.where("node is null").select("rid").distinct()
    leaves = leaves.join(unspelled, "rid", "left_anti")
    width = (leaves.agg(F.max("node")).first()[0] or 0) + 1
    level, pieces = leaves, leaves.where("at is not null")
    while True:
        last = width <= fan
        level = stored(composed(level.where("start is not null"), paths, fan, last), "align-level")
        pieces = pieces.unionByName(level.where("at is not null"))
        if last:
            break
        width = -(-width // fan)
    counts = pieces.groupBy("rid").agg(*[F.sum(f.name).alias(f.name) for f in COUNTS])
    pairs = pieces.select("rid", F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy("rid", F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("times"))
    ordered = pieces.select("rid", "at", "groups").repartition("rid").sortWithinPartitions("rid", "at")
    fields = [StructField("rid", LongType()), StructField("groups_sha256", StringType())]
    schema = StructType(fields + ([StructField("groups", StringType())] if with_groups else []))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, texts = None, None, []

        def done() -> Iterator[pa.RecordBatch]:
            if now is not None:
                row = {"rid": now, "groups_sha256": sha.hexdigest()} | ({"groups": ";".join(texts)} if with_groups else {})
                yield pa.RecordBatch.from_pylist([row], arrow_schema(schema))

        for one in slices(batches, 2):
            for rid, piece in zip(one.column(0).to_pylist(), one.column(2).to_pylist()):
                if rid != now:
                    yield from done()
                    now, sha, texts = rid, hashlib.sha256(piece.encode()), []
                else:
                    sha.update(b";" + piece.encode())
                if with_groups:
                    texts.append(piece)
        yield from done()

    return counts.join(ordered.mapInArrow(digests, schema), "rid"), pairs


def align(
    docs: DataFrame,
    paths: Paths,
    text: str = "text",
    keep: list[str] | None = None,
    with_groups: bool = False,
    long_bytes: int = LONG_BYTES,
    chunk: int = CHUNK_BYTES,
    fan: int = FAN,
    hot_pairs: int = HOT_PAIRS,
) -> DataFrame:
    """Aligns the tokens of blank + ``text`` by the JSON tokenizer of ``paths`` with those of ``text`` by its piece model.

    Returns columns ``keep`` (default: all that don't clash with new ones) and n_a, n_b,
    n_groups, n_links, n_best (links whose pair is held by most documents among the pairs
    of its first id), count_sum (documents that hold a link's pair, summed over links),
    groups_sha256, and with ``with_groups`` the groups as text. Both paths must name
    files that every executor has.

    One row for each input row: a row counts as a document of its own, repeated rows and
    equal or null ids too. A text that is null, empty or not spelled by both sides has
    zeros and an empty digest. An empty table gives an empty result. Memory follows the
    longest part of a text without a blank between word characters.
    """
    new = [f.name for f in COUNTS] + ["n_best", "count_sum", "groups_sha256", *(["groups"] if with_groups else [])]
    kept = [c for c in other_columns(docs, new) if keep is None or c in keep]
    named = [f"k{i}" for i in range(len(kept))]
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), quoted(text).alias("t"), *[quoted(c).alias(n) for c, n in zip(kept, named)])
    digest = [StructField("groups_sha256", StringType()), *([StructField("groups", StringType())] if with_groups else [])]
    carried = ["rid", *named]
    schema = StructType([*[rows.schema[c] for c in carried], StructField("long_text", StringType()), *COUNTS, *PAIRS, *digest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = loaded(paths)
        for part in slices(batches, "t", ENCODE_BYTES):
            texts = part.column("t").to_pylist()
            long = [t if t and len(t.encode()) > long_bytes else None for t in texts]
            got = align_texts(both, [None if x else t for x, t in zip(long, texts)], with_groups)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), pa.array(long, pa.string()), *got], names=schema.names)

    base = stored(rows.mapInArrow(run, schema), "aligned")
    counts, long_pairs = long_documents(base.where("long_text is not null"), "long_text", paths, long_bytes, chunk, fan, with_groups)
    short_pairs = base.select("rid", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("rid", F.col("p.pairs").alias("pair"), F.col("p.times").cast("long").alias("times"))
    links = short_pairs.unionByName(stored(long_pairs, "align-long-pairs"))
    sums = link_sums(links, len(loaded(paths).b_bytes), hot_pairs)
    long_counts = stored(counts, "align-long")
    extra = [f.name for f in COUNTS] + [f.name for f in digest]
    renamed = long_counts.select("rid", *[F.col(c).alias(f"long_{c}") for c in extra])
    out = base.drop("pairs", "times", "long_text").join(renamed, "rid", "left").join(sums, "rid", "left")
    merged = {c: F.coalesce(f"long_{c}", c) for c in extra}
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")}
    return out.select(*[F.col(n).alias(c) for n, c in zip(named, kept)], *[(merged | zero)[c].alias(c) for c in new])


def link_sums(links: DataFrame, b_ids: int, hot_pairs: int) -> DataFrame:
    """(rid, n_best, count_sum) from (rid, pair, times), by the number of rows that hold each pair."""
    counted = stored(links.groupBy("pair").agg(F.count("*").alias("held")).withColumn("a", F.expr(f"pair div {b_ids}")), "align-pairs")
    most = counted.groupBy("a").agg(F.max("held").alias("most"))
    known = stored(counted.join(most, "a").select("pair", "held", (F.col("held") == F.col("most")).alias("best")), "align-known")
    total = known.agg(F.sum("held")).first()[0] or 0
    # Pairs held by `least` rows or more are at most `hot_pairs`, whatever the corpus.
    least = -(-total // hot_pairs) or 1
    hot, cold = known.where(F.col("held") >= least), known.where(F.col("held") < least)
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("held") * F.col("times")).alias("count_sum")]
    often = links.join(F.broadcast(hot), "pair").groupBy("rid").agg(*sums)
    if least == 1:
        return often
    rare = links.join(F.broadcast(hot.select("pair")), "pair", "left_anti").join(cold, "pair").groupBy("rid").agg(*sums)
    return often.unionByName(rare).groupBy("rid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
