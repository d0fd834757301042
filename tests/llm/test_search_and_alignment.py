"""Top-k search, hard negatives and token alignment against brute force and on odd inputs."""

import hashlib
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from check import compare, duck
from pyspark.sql import functions as F
from test_llm import ODD, odd

sys.path.insert(0, str(Path(__file__).parent))

from shelfspark.llm import hard_negatives, registry, token_alignment, topk  # noqa: E402

registry.load_all()
SF = "/root/testdata/sf0.001"
PATHS = token_alignment.Paths(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)
COMPONENTS = "vec_id long, embedding array<float>, label int, n long, query string, score string, rid string"


def vectors(spark, n=400, dims=10, seed=3):
    """Vectors of which a third are one, with ties, repeated rows, odd rows and columns that clash."""
    rng = np.random.default_rng(seed)
    base = rng.normal(scale=0.4, size=(n, dims)).round(1)
    base[::3] = base[0]
    rows = [(i, [float(x) for x in v], int(i % 4)) for i, v in enumerate(base)]
    rows += rows[:30]
    rows += [(20, [float(x) for x in base[1]], 2), (500, None, 1), (None, rows[1][1], 1), (501, [float("nan")] * dims, 1), (502, [None] * dims, 1)]
    rows += [(503, [float("inf")] * dims, 1), (504, [1e9] * dims, 1), (560, [0.5, 0.5], 1), (580, [1.0, -2.0], 2), (600, [], 1), (620, [], 2), (700, rows[2][1], None)]
    return spark.createDataFrame([(*r, 1, "x", "y", "z") for r in rows], COMPONENTS), rows


def whole(rows, scale):
    out = {}
    for i, v, label in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) or abs(x) * scale >= 1 << 27 for x in v):
            continue
        out[i, tuple(int(np.floor(scale * float(np.float32(x)))) for x in v), label] = True
    return list(out)


def top_by_brute_force(rows, k):
    rows = list({(i, v) for i, v, _ in whole(rows, 64)})
    out = []
    for q, a in rows:
        if q % 20:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in rows if len(a) == len(b) and (i, b) != (q, a))
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("how", [{}, {"chunk_rows": 30, "query_rows": 4}, {"lists": 3, "chunk_rows": 50}, {"lists": 1}])
@pytest.mark.parametrize("k", [1, 20, 1000])
def test_top_k_equals_brute_force(spark, how, k):
    df, rows = vectors(spark)
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), k, 64, **how).select("query_id", "rank", "vec_id", "score")
    assert sorted(map(tuple, got.collect())) == top_by_brute_force(rows, k)


def test_cutoff_leaves_entries_out(spark):
    """Phase 2 returns a part of all entries only, and phase 3 asks for fewer parts than there are."""
    rng = np.random.default_rng(1)
    x = rng.integers(-20, 20, (500, 16)).astype(np.int32)
    s = x[:5].astype(np.int64) @ x.T
    cutoff = np.sort(s, axis=1)[:, -5]
    import pyarrow as pa

    chunk = pa.table({"size": [500], "mat": [topk.packed(x[:, :8])]})
    block = pa.table({"size": [5], "mat": [topk.packed(x[:5, :8])], "cutoff": [cutoff.tolist()]})
    key = tuple(pa.scalar(v) for v in (0, 0, 0))
    found = topk._sufficient(2)(key, chunk, block)
    entries = len(found.column("qi")[0])
    assert 0 < entries < 0.4 * s.size


def negatives_by_brute_force(rows, positives=5, negatives=5):
    rows = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in whole([r for r in rows if r[2] is not None], 256)]
    out = []
    for a in rows:
        if a[0] % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[1], r[1])), r[0], r) for r in rows if len(r[1]) == len(a[1]) and r != a)
        for s, p, _ in [x for x in scored if x[2][2] == a[2]][:positives]:
            near = [x for x in scored if x[2][2] != a[2] and 80 * -s <= 100 * -x[0] <= 100 * -s][:negatives]
            out += [(a[0], p, rank + 1, x[1], -s, -x[0]) for rank, x in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("how", [{}, {"cell_rows": 10, "block_rows": 16, "first_rows": 20}, {"sample_rows": 5, "cell_rows": 4, "first_rows": 1}])
def test_hard_negatives_equal_brute_force(spark, how):
    df, rows = vectors(spark, seed=9)
    label = F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")
    got = hard_negatives.hard_negatives(df, label, F.col("vec_id") % 100 == 0, **how)
    assert sorted(map(tuple, got.collect())) == negatives_by_brute_force(rows)


def test_walk_is_certified_and_ordered():
    rng = np.random.default_rng(2)
    x = np.rint(np.concatenate([rng.normal(c, 4, (200, 8)) for c in rng.normal(0, 100, (12, 8))])).astype(np.int64)
    books = hard_negatives.Codebooks(list(x), 8)
    c1, d1, c2, d2 = books.assign(x)
    cells = {}
    for i in range(len(x)):
        n, r1, r2 = cells.get((c1[i], c2[i]), (0, 0.0, 0.0))
        cells[c1[i], c2[i]] = (n + 1, max(r1, d1[i]), max(r2, d2[i]))
    centers = books.centers(8)
    radius = hard_negatives.radii(centers, cells)
    for q in x[::97]:
        scores = x @ q
        need = float(np.sort(scores)[-10])
        found, behind = hard_negatives.walk(q, centers, radius, cells, 0, 1 << 40, need, 1e18)
        assert {(c1[i], c2[i]) for i in np.flatnonzero(scores >= need)} <= set(found)
        assert len(found) < len(cells) / 2  # the bound stops the walk, and cells are passed over
        stepwise, at = [], 0
        while True:
            more, now = hard_negatives.walk(q, centers, radius, cells, at, 1, need, 1e18)
            if not more:
                break
            stepwise, at = stepwise + more, now
        assert stepwise == found


def test_empty_vectors(spark):
    df, _ = vectors(spark)
    none = df.where("false")
    assert topk.top_k(none, none).collect() == []
    assert topk.top_k(df, none).collect() == []
    assert hard_negatives.hard_negatives(none, F.col("label"), F.lit(True)).collect() == []
    assert hard_negatives.hard_negatives(df, F.col("label"), F.lit(False)).collect() == []


@pytest.mark.parametrize("name", ["op11_topk", "op12_hard_negatives"])
def test_sql(spark, name):
    assert compare(registry.QUERIES[name](spark, SF), duck(SF), registry.CHECKS[name]) == ""


def aligned_by_brute_force(texts):
    """Token by token, with the tokenizers' own libraries."""
    both = token_alignment.Tokenizers(PATHS.a, PATHS.b)
    found, held = [], Counter()
    for text in texts:
        found.append(None)
        if not text:
            continue
        a, b = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
        spans = []
        for ids, size in ((a, both.a_bytes), (b, both.b_bytes)):
            ends = np.cumsum([len(size[i]) for i in ids]).tolist()
            spans.append(list(zip([0, *ends], ends)))
        if any(b"".join(size[i] for i in ids) != (" " + text).encode() for ids, size in ((a, both.a_bytes), (b, both.b_bytes))):
            continue
        links, k = [], 0
        for i, (lo, hi) in enumerate(spans[0]):
            while spans[1][k][1] <= lo:
                k += 1
            links += [(a[i], b[j]) for j in range(k, len(b)) if spans[1][j][0] < hi] if len(b) < 300 else [(a[i], b[j]) for j in range(k, min(len(b), k + hi - lo)) if spans[1][j][0] < hi]
        groups, i, j = [], 0, 0
        for end in sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}):
            p, q = i, j
            while i < len(a) and spans[0][i][1] <= end:
                i += 1
            while j < len(b) and spans[1][j][1] <= end:
                j += 1
            groups.append(",".join(map(str, a[p:i])) + "|" + ",".join(map(str, b[q:j])))
        found[-1] = (len(a), len(b), len(groups), links, ";".join(groups))
        held.update(set(links))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_best, count_sum = sum(held[x] == best[x[0]] for x in f[3]), sum(held[x] for x in f[3])
            out.append((f[0], f[1], f[2], len(f[3]), n_best, count_sum, hashlib.sha256(f[4].encode()).hexdigest()))
    return out


ALIGNED = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD_TEXTS = [
    "plain words here", "plain words here", "", None, " ", "\n\n\t x", "a  b   c    d", "日本語のテキスト と words", "naïve café — “quoted” …", "<s> </s> <|endoftext|> <0x0A> <unk>",
    "▁ marks ▁", "ﬁ ligature ℌ", "\x00\x01 control", "emoji 😀👩‍👩‍👧 done", "x" * 3000, "no_break space " * 50, "word " * 4000, "tail space ", "ab " + "é" * 700 + " cd " * 300,
]


@pytest.mark.parametrize("how", [{}, {"long_bytes": 200, "chunk": 64, "fan": 2, "hot_pairs": 10}, {"long_bytes": 1, "chunk": 7, "fan": 3, "hot_pairs": 1}])
def test_alignment_equals_brute_force(spark, how):
    docs = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "doc_id int, text string")
    got = token_alignment.align(docs, PATHS, with_groups=True, **how).collect()
    want = aligned_by_brute_force(ODD_TEXTS)
    assert len(got) == len(ODD_TEXTS)
    for row in got:
        assert tuple(row[c] for c in ALIGNED) == want[row["doc_id"]], row["doc_id"]
        assert hashlib.sha256(row["groups"].encode()).hexdigest() == row["groups_sha256"] if row["groups"] else row["n_groups"] == 0


def test_alignment_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r[c] for c in ALIGNED) for r in registry.QUERIES["op13_token_alignment"](spark, SF).collect()}
    assert got == dict(zip([r["doc_id"] for r in docs], aligned_by_brute_force([r["text"] for r in docs])))


def test_alignment_of_odd_rows(spark):
    out = token_alignment.align(odd(spark).withColumn("N_Links", F.lit(1)).withColumn("pairs", F.lit(2)), PATHS)
    rows = out.collect()
    assert len(rows) == len(ODD) and len({c.lower() for c in out.columns}) == len(out.columns)
    assert {r["pairs"] for r in rows} == {2}
    assert sorted(tuple(r[c] for c in ALIGNED) for r in rows) == sorted(aligned_by_brute_force([d[1] for d in ODD]))
    assert token_alignment.align(odd(spark).where("false"), PATHS).collect() == []


def test_fragments_compose_in_any_order():
    """Composition is associative: any bracketing of a text's fragments closes the same groups."""
    both = token_alignment.loaded(PATHS)
    text = "Unbelievably antidisestablishmentarian résumés—日本 of 1234567 things; " * 4
    a, b, fine = both.encode([text])
    assert fine[0]
    ends = int(a.ends[-1])
    leaves = []
    for lo in range(0, ends, 9):
        cut = [np.searchsorted(x, [lo, min(ends, lo + 9)], "right") for x in (a.ends, b.ends)]
        tokens = tuple(x[c[0] : c[1]].tolist() for x, c in ((a.ids, cut[0]), (a.ends, cut[0]), (b.ids, cut[1]), (b.ends, cut[1])))
        leaves.append(token_alignment.fragment(both, lo, tokens))

    def joined(parts):
        if len(parts) == 1:
            return parts[0]
        at = rng.integers(1, len(parts))
        (left, p), (right, q) = joined(parts[:at]), joined(parts[at:])
        one, new = token_alignment.compose(both, left, right)
        return one, p + q + new

    want = both.groups_text(a, b, both.ends(a, b))[0][:-1].decode()
    for seed in range(5):
        rng = np.random.default_rng(seed)
        whole_text, pieces = joined(leaves)
        pieces = pieces + [token_alignment.closed(both, -1, whole_text.prefix)]
        assert ";".join(p["groups"] for p in sorted(pieces, key=lambda p: p["at"])) == want
        assert whole_text.suffix == ([], [], [], [])


def test_blocks_and_entries_are_small(spark, monkeypatch):
    """a component took four bytes and a part eight, and vectors were looked up for all that reach the cutoff, not the best."""
    import pyarrow as pa

    from shelfspark.llm import vector_blocks as vb

    for most, size in ((127, 1), (128, 2), (1 << 15, 4), (1 << 27, 4), (1 << 40, 8)):
        x = np.array([[most, -most, 0]])
        assert vb.large(vb.small(x)).tolist() == [most, -most, 0] and len(vb.small(x)) == 3 * size + 1
    assert vb.large(vb.small(np.array([-128]))).tolist() == [-128] and len(vb.large(vb.small([]))) == 0
    x = np.random.default_rng(2).integers(-60, 60, (300, 16)).astype(np.int32)
    assert len(topk.packed(x)) < 2 * x.size and (topk.unpacked(topk.packed(x), 300) == x).all()
    chunk, block = (pa.table({"size": [n], "mat": [topk.packed(x[:n, :8])]}) for n in (300, 20))
    found = topk._sufficient(2)(tuple(pa.scalar(v) for v in (0, 0, 0)), chunk, block.append_column("cutoff", [[[0] * 20]]))
    assert found.nbytes < 12 * len(found.column("qi")[0])
    # Ties at the last place, and a class of many ids.
    rows = [(i, [float(i % 3), 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = df.where("vec_id in (0, 7, 59)")
    got = topk.top_k(df, asked, 4, 1, chunk_rows=1).collect()
    want = []
    for q in (0, 7, 59):
        best = sorted((-(q % 3 * (i % 3) + 1), i) for i in range(60) if i != q)[:4]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == want
