"""The operators against brute force, on odd inputs, and the pipeline as a whole."""

import hashlib
import os
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from check import compare, duck
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from shelfspark.llm import byte_bpe, decontaminate, graph, minhash, passages, quality, registry, secret_scan, sharding, suffix_array, toxicity, warc  # noqa: E402
from shelfspark.llm.graph import components  # noqa: E402

registry.load_all()
SF = "/root/testdata/sf0.001"
VOCABULARY = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
PROSE = " ".join(f"{a}{b}" for a in "stone river cloud grass ember frost maple thorn".split() for b in "ling wards ness ful able some".split())
LONG = " ".join(f"w{i * 7919 % 5003}x{i}" for i in range(30_000))
ODD = [
    (1, PROSE, "en", "a", 5),
    (1, PROSE, "en", "a", 5),
    (2, PROSE + " once", None, None, None),
    (3, "", "en", "a", 0),
    (4, None, "en", "a", None),
    (5, " \n\t ", "en", "a", 3),
    (None, PROSE, "en", "a", 1),
    (6, "ab", "en", "a", 2),
    (7, LONG, "en", "a", 1),
    (8, "x" * 5000, "en", "a", 1),
    (9, "é" * 900, "fr", "b", 1),
    (1, "another text under a known id, with words of its own", "en", "a", 1),
]
BASE = "doc_id long, text string, lang string, source string, n_chars long"


def odd(spark):
    """Nulls, repeats, empty and long texts, and columns named like those that operators add."""
    df = spark.createDataFrame(ODD, BASE)
    clash = ["id", "tid", "node", "bands", "shard", "slot", "size", "secrets", "token_ids", "decoded", "n_words", "n_symbols", "spans", "evidence", "_text", "Rejected_by", "component", "hash"]
    return df.select("*", *[F.lit("clash").alias(c) for c in clash])


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


def of(rows):
    return {r["doc_id"]: r for r in rows}


def items(spark):
    return spark.createDataFrame([(0, PROSE), (1, ""), (2, None), (None, PROSE), (3, "two words")], "item_id long, text string")


OPERATORS = {
    "leaks": lambda s, d: decontaminate.leaks(d, items(s)),
    "suffix_array": lambda s, d: suffix_array.remove_repeats(d),
    "passages": lambda s, d: passages.repeated_passages(d),
    "minhash": lambda s, d: minhash.near_duplicates(d),
    "secrets": lambda s, d: secret_scan.find_secrets(d),
    "redact": lambda s, d: secret_scan.redact(d),
    "warc": lambda s, d: warc.derivatives(warc.responses(d.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html")))),
    "sharding": lambda s, d: sharding.balanced_shards(d.withColumn("size", sharding.byte_size(F.col("text"), 16)), ["doc_id"]),
    "toxicity": lambda s, d: toxicity.toxicity(d, s.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (7, 0), (1, 0)], "doc_id long, toxic int")),
    "encode": lambda s, d: byte_bpe.decode(byte_bpe.encode(d, *VOCABULARY), *VOCABULARY),
    "cascade": lambda s, d: quality.cascade(d),
    "measures": lambda s, d: quality.measures(d),
    **{f"stage_{name}": lambda s, d, stage=stage: stage(s, d, SF) for name, stage in corpus_pipeline.STAGES},
}
#: Operators with one row for each input row.
ROWWISE = {"suffix_array", "minhash", "secrets", "redact", "sharding", "toxicity", "encode", "cascade", "measures", "stage_secrets", "stage_tokens"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    out = OPERATORS[name](spark, odd(spark))
    rows = out.collect()
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    if name in ROWWISE:
        assert len(rows) == len(ODD)
    if name == "warc":
        assert len(rows) == 2 * len(ODD)
    if name == "leaks":
        assert {(r["doc_id"], r["item_id"]) for r in rows} == {(1, 0), (2, 0)}
    if name == "minhash":
        found = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in rows}
        assert found[2, 45] == (1, False) and found[3, 0] == (3, True) and found[None, 44] == (None, True)
    if name == "passages":
        assert {r["doc_id"] for r in rows} <= {1, 2}
    if name == "suffix_array":
        got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows)
        assert got == sorted((str(d[0]), *w) for d, w in zip(ODD, brute.removed([d[1] for d in ODD], 400)))
    if name == "stage_near_duplicates":
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(d[0]) for d in ODD if d[0] != 2)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    out = OPERATORS[name](spark, odd(spark).where("false"))
    assert out.collect() == []


def test_components(spark):
    random.seed(3)
    edges = [(a, a + 1) for a in range(60)] + [(100, x) for x in range(101, 400)] + [(random.randrange(500, 900), random.randrange(500, 900)) for _ in range(250)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_decontamination_follows_other_values(spark):
    question = "a train leaves the station at 9 am with 120 passengers and after 45 km another 30 people board the train in Lyon before it reaches 9 towns"
    same = question.replace("120", "260").replace("45 km", "80 miles").replace("30", "14").replace("Lyon", "Turin").replace("9", "7")
    mixed = question.replace("at 9 am", "at 7 am")
    texts = ["Some words before. " + question, "Before it: " + same, "Before it: " + mixed, "A train leaves. Nothing else here is like it at all, not even 120 passengers."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["reparameterised"] for r in decontaminate.leaks(docs, spark.createDataFrame([(5, question)], "item_id long, text string")).collect()}
    assert got[0] is False and got[1] is True and 3 not in got


def test_decontamination_finds_items_without_template_windows(spark):
    items = ["What is 17 times 24?", "NAME THE LARGEST PLANET OF THE SOLAR SYSTEM NOW", "Who wrote Hamlet?", "12 34 56 78 90 11 22 33 44", "Yes", "Ann Bob Cid Dan Eve Fay Gus Hal Ida Jon"]
    texts = [f"Some words before it. {t} And some words after it." for t in items] + [
        "Someone asked who, and who wrote, and of Hamlet and what is 17 and times and 24.",
        "what is 17 times 24",
        "12 34 56 78 90 11 22 33 45 and NAME THE LARGEST PLANET OF THE SOLAR SYSTEM",
        "nothing here",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert got == {(i, i) for i in range(6) if i != 4} | {(7, 0)}


def test_decontamination_finds_whole_items(spark):
    docs = {r[0]: " ".join(r[1].split()) for r in documents(spark).collect()}
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = {(d, b["item_id"]) for b in benchmark.collect() for d, t in docs.items() if " ".join(b["text"].split()) in t}
    assert {(r[0], r[1]) for r in decontaminate.leaks(documents(spark), benchmark).select("doc_id", "item_id").collect()} == want


def test_suffix_array_equals_counting(spark):
    random.seed(5)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "rstuv"]
    texts = [" ".join(random.choices(words, k=random.randint(60, 400))) for _ in range(60)]
    for i in range(0, 60, 3):  # pieces of about the length that counts, moved to other texts and places
        piece = texts[i][50 : 50 + random.randint(390, 520)]
        texts[i + 1] = texts[i + 1][:77] + piece + texts[i + 1][77:]
        texts[i + 2] = piece + piece[:410] + texts[i + 2]
    texts += ["na" * 700, "z" * 399, "z" * 400, "z" * 401]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = of(suffix_array.remove_repeats(docs).collect())
    want = brute.removed(texts, 400)
    assert [(got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) for i in range(len(texts))] == want


def test_suffix_order_of_stretches_that_end_in_a_shared_line(spark):
    random.seed(8)
    words = [f"{a}{b}{c}" for a in "abcdefgh" for b in "rstuv" for c in "klmn"]

    def prose(n):
        return " ".join(random.choices(words, k=n)).encode()

    line, rows, at, marked = prose(70), [], 0, 0
    copies = [line + prose(200) for _ in range(4)]
    # Stretches that end within the line, and repeated strings that begin with it.
    texts = [(prose(250), prose(300), line + prose(300)) for _ in range(60)] + [(prose(150), c, prose(150)) for c in copies * 2]
    for head, body, tail in texts:
        data = np.frombuffer(head + body + tail, np.uint8)
        marks = [len(head) + len(body) - 800 + random.randrange(200)] if len(tail) > 1200 else range(len(head), len(head) + len(body), 100)
        got = suffix_array.phrases(data, np.array(marks), 400)
        left, n = got[-1], len(got[0])
        assert all((got[k + 1][left < k] == np.iinfo(np.int64).min).all() for k in (1, 2))
        marked += (left == 0).sum()
        rows += [(at + i, *(int(got[k][i]) for k in (1, 2, 3, 8, 4))) for i in range(n)]
        at += n
    # Consecutive stretches are told apart by their ends alone.
    assert marked >= len(texts)
    symbols = spark.createDataFrame(rows, "at long, symbol long, next1 long, next2 long, left long, prefix long")
    order = [r["at"] for r in suffix_array.suffix_order(symbols).orderBy("position").collect()]
    keys = {r[0]: [rows[k][1] for k in range(r[0], r[0] + min(r[4] + 1, suffix_array.DEPTH))] for r in rows}
    assert len(order) == len(rows) and [keys[x] for x in order] == sorted(keys.values())


def test_suffix_array_of_copies_changed_every_few_hundred_bytes(spark):
    random.seed(7)
    texts = []
    for _ in range(8):
        base = "".join(random.choices("abcdefgh \n", k=3000))
        for _ in range(5):
            x, at = list(base[random.randrange(40) :]), random.randrange(400)
            while at < len(x):
                x[at] = random.choice("XY")
                at += random.randint(380, 430)
            texts.append("".join(random.choices("ij", k=random.randrange(30))) + "".join(x))
    texts += ["k" * 70000, "l" * 300 + "k" * 420]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = of(suffix_array.remove_repeats(docs).collect())
    assert [(got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) for i in range(len(texts))] == brute.removed(texts, 400)


def test_suffix_array_stores_little_beside_its_texts(spark, monkeypatch):
    random.seed(6)
    words = [f"{a}{b}{c}" for a in "abcdefgh" for b in "rstuv" for c in "klmn"]
    texts = []
    for _ in range(150):  # two texts with a long repetition, changed in places
        x = random.choices(words, k=2000)
        y = [w if random.random() > 0.005 else "other" for w in x]
        texts += [" ".join(random.choices(words, k=300) + t) for t in (x, y)]
    kept = []
    monkeypatch.setattr(suffix_array, "stored", lambda df, name: kept.append(graph.stored(df, name)) or kept[-1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert suffix_array.remove_repeats(docs).where("n_removed > 0").count() > 250
    size = sum(os.path.getsize(f.removeprefix("file:")) for df in kept for f in df.inputFiles())
    assert size < 2.5 * sum(map(len, texts))


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_all_pairs(spark, size, percent):
    random.seed(size)
    words = [f"{a}{b}{c}" for a in "abcd" for b in "rst" for c in "xyz"]
    base = random.choices(words, k=120)
    docs = {r[0]: r[1] for r in documents(spark).collect()}
    for i in range(150):  # a hard group: similarities on both sides of the limit
        own = list(base)
        for _ in range(random.randint(0, 6)):
            own[random.randrange(len(own))] = random.choice(words)
        docs[10_000 + i] = " ".join(own)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    near = minhash.Near() if size == 5 else minhash.Near(3, 85, 36, 6)
    got = of(minhash.near_duplicates(df, near).collect())
    want = brute.groups(docs, size, percent)
    assert {d: got[d]["component_id"] for d in docs} == want
    assert all(got[d]["n_shingles"] == len(brute.shingles(t, size)) and got[d]["kept"] == (want[d] == d) for d, t in docs.items())


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, 300).astype(np.uint64), rng.integers(0, 1 << 63, 300).astype(np.uint64)
    one, two = np.sort(a), np.sort(np.concatenate([a[:250], b[:50]]))
    row = np.repeat([0, 1, 2], [300, 300, 1])
    s = minhash.sketches(row, np.concatenate([one, two, a[:1]]), 3, 1024)
    assert not (s == np.uint64(0xFFFFFFFFFFFFFFFF)).any()
    assert abs((s[0] == s[1]).mean() - 250 / 350) < 0.06


def test_passages_equal_runs(spark):
    rows = passages.repeated_passages(documents(spark)).collect()
    words = {r[0]: (r[1] or "").encode().lower().split() for r in documents(spark).collect()}
    seen = {}
    for d, w in words.items():
        for i in range(len(w) - passages.WORDS + 1):
            seen.setdefault(tuple(w[i : i + passages.WORDS]), set()).add(d)
    want = set().union(*[s for s in seen.values() if len(s) > 1])
    assert want <= {r["doc_id"] for r in rows}
    for r in rows:
        a, b = (brute.shingles(b" ".join(w).decode(), 5) for w in (words[r["doc_id"]][r["lo"] : r["hi"]], words[r["other_id"]][r["other_lo"] : r["other_hi"]]))
        assert 100 * len(a & b) >= 80 * len(a | b)


def _tokens(words):
    return next(passages.token_rows(pa.array([" ".join(words)])))[1]


def _found(x, y):
    return [(a, b + passages.SHINGLE, c, d + passages.SHINGLE) for a, b, c, d, _ in passages.passages(_tokens(x), _tokens(y))]


def test_passages_side_by_side_are_found_apart():
    p, q, r = ([f"{k}{i}" for i in range(60)] for k in "pqr")
    x, y = p + q, p + r[:30] + q
    want = [(0, 60, 0, 60), (60, 120, 90, 150)]
    assert sorted(_found(x, y)) == want
    assert sorted(_found(y, x)) == [(c, d, a, b) for a, b, c, d in want]


def test_passages_whose_words_occur_before_are_found():
    p, r = ([f"{k}{i}" for i in range(60)] for k in "pr")
    x, y = r[:20] + p, p[10:22] + r[20:50] + p
    assert _found(x, y) == [(20, 80, 42, 102)] and _found(y, x) == [(42, 102, 20, 80)]


def test_passages_repeated_and_changed():
    p, r = ([f"{k}{i}" for i in range(200)] for k in "pr")
    changed = p[:24] + ["other"] + p[25:50]
    assert _found(r[:40] + p[:50] + r[40:60], changed) == [(40, 90, 0, 50)]
    assert {x[:2] for x in _found(p[:60] + r[:40] + p[:60], r[60:99] + p[:60])} == {(0, 60), (100, 160)}
    assert _found(p[:90] + ["more", "words"] + p[90:], p) == [(0, 202, 0, 200)]
    assert passages.passages(_tokens(["a"] * 3000), _tokens(["a"] * 3000))


def test_passages_in_a_family_of_variants(spark):
    random.seed(4)
    base = [f"b{i}" for i in range(60)]

    def variant():
        return [random.choice("xyz") + str(random.randrange(10**6)) if random.random() < 0.05 else w for w in base]

    def around(passage):
        return " ".join([f"u{random.randrange(10**9)}" for _ in range(40)] + passage + [f"u{random.randrange(10**9)}" for _ in range(40)])

    texts = [around(variant()) for _ in range(300)]
    for _ in range(40):
        passage = variant()
        texts += [around(passage), around(passage)]
    rows = passages.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {r["doc_id"] for r in rows}
    assert set(range(300, 380)) <= found
    split = [t.split() for t in texts]
    for r in rows:
        a, b = (brute.shingles(" ".join(w), 5) for w in (split[r["doc_id"]][r["lo"] : r["hi"]], split[r["other_id"]][r["other_lo"] : r["other_hi"]]))
        assert 100 * len(a & b) >= 80 * len(a | b)


def test_secrets(spark):
    body = b"0aB3" * 7 + b"xy"
    good = "ghp_" + (body + secret_scan.base62_crc(body)).decode()
    texts = [
        r[1] for r in documents(spark).collect()
    ] + [None, "", 'ﬀé Token : "abcdefghijkl" token=short secret=password=0123456789abcdefg', "AKIAABCDEFGHIJKLMN AKIAshort AKIA1234567890123A", "0123456789abcdef" * 3, "paſſword=abcdefghijklmnop", good, good[:-1] + "!"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = of(secret_scan.find_secrets(df).collect())
    kinds = secret_scan.KINDS
    for i, t in enumerate(texts):
        assert [(s["start"], kinds.index(s["kind"]), s["end"]) for s in got[i]["secrets"] if s["kind"] != "checked"] == brute.secrets(t)
    last = len(texts) - 1
    assert [s["kind"] for s in got[last - 1]["secrets"]] == ["checked"] and got[last]["secrets"] == []


def test_sharding(spark):
    rows = registry.QUERIES["op7_sharding"](spark, SF).collect()
    texts = {r[0]: (r[1] or "").encode() for r in documents(spark).collect()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {d: (len(t) + 16, zlib.crc32(t)) for d, t in texts.items()}
    total, sums = sum(r["size"] for r in rows), {}
    assert [r["shard"] for r in sorted(rows, key=lambda r: r["doc_id"])] == sorted(r["shard"] for r in rows)
    for r in rows:
        sums.setdefault(r["shard"], []).append(r)
    for own in sums.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert sum(r["size"] for r in own) <= total / 40 + max(r["size"] for r in rows)


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = registry.QUERIES["op8_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert all(rows["held_out"])
    toxic, score = rows["toxic"] == 1, rows["score"].rank()
    area = (score[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert area > 0.75 and ((rows["predicted"] == 1) & ~toxic).mean() < 0.05


def test_byte_pairs_equal_library(spark):
    random.seed(2)
    texts = [r[1] for r in documents(spark).collect()]
    texts += ["", "a" * 3000, "ab" * 900, "=-" * 700, " " * 800 + "x", "日本語の文" * 60, "<|endoftext|>", "‍👩‍👩‍👧" * 40]
    texts += ["".join(random.choices("abcdefinrst", k=random.randint(30, 300))) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = of(byte_bpe.decode(byte_bpe.encode(df, *VOCABULARY), *VOCABULARY).collect())
    own = brute.encoder()
    for i, t in enumerate(texts):
        assert got[i]["token_ids"] == own.encode_ordinary(t) and bytes(got[i]["decoded"]) == t.encode()


def test_joining_is_associative():
    pairs = byte_bpe.BytePairs.load(*VOCABULARY)
    run = b"therefore1234antidisestablishmentarianism" * 5
    for cut in range(1, len(run), 7):
        assert pairs.join(pairs.encode_run(run[:cut]), pairs.encode_run(run[cut:])) == pairs.merge(run)


@pytest.mark.parametrize("name", ["op6_warc", "op10_quality_rules"])
def test_sql(spark, name):
    assert compare(registry.QUERIES[name](spark, SF), duck(SF), registry.CHECKS[name]) == ""


def test_cascade_equals_measures(spark):
    docs = documents(spark).unionByName(odd(spark).select("doc_id", "text"))
    verdict = lambda df: sorted((str(r[0]), str(r[1])) for r in df.collect())
    shorted = quality.cascade(docs, quality.RULES).select("doc_id", "rejected_by")
    measured = quality.measures(docs).select("doc_id", quality.first_rejection(quality.RULES))
    assert verdict(shorted) == verdict(measured)
    assert {r.name for r in quality.rule_order(docs)} == {r.name for r in quality.RULES}


def test_warc_files_have_records(spark, tmp_path):
    records = registry.QUERIES["op6_warc"](spark, SF)
    warc.write_warc(records, str(tmp_path / "warc"))
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "warc").glob("part-*")))
    at = n = 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in data[at:head_end].decode().split("\r\n")[1:])
        block = data[head_end + 4 : head_end + 4 + int(head["Content-Length"])]
        assert head["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block).hexdigest() and head["WARC-Refers-To"]
        at, n = head_end + 4 + len(block) + 4, n + 1
    assert n == records.count()


def test_pipeline_equals_brute_force(spark):
    docs = {r[0]: r[1] for r in documents(spark).collect()}
    con = duck(SF)
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({registry.CHECKS['op10_quality_rules']}) WHERE kept").fetchall()}
    docs = {d: t for d, t in docs.items() if d in kept}
    docs = {d: t for d, t in docs.items() if brute.groups(docs, 5, 80)[d] == d}
    flat = lambda t: " ".join(t.split())
    benchmark = [flat(r[0]) for r in con.execute("SELECT text FROM benchmark").fetchall()]
    docs = {d: brute.redacted(t, "[secret]") for d, t in docs.items() if not any(b in flat(t) for b in benchmark)}
    own = brute.encoder()
    got = of(corpus_pipeline.run(spark, SF).collect())
    assert set(got) == set(docs)
    for d, t in docs.items():
        assert (got[d]["text"], got[d]["n_chars"], got[d]["token_ids"], got[d]["round_trip"]) == (t, len(t), own.encode_ordinary(t), True)


def toxicity_corpus():
    """(text, toxic): common words, two words in three toxic texts only, one in a single one, and a pair of common words in all toxic texts only."""
    random.seed(11)
    usual = ["frost", "ember", *(f"w{i}" for i in range(400))]
    rows = []
    for i in range(300):
        words = random.choices(usual, k=30)
        if i % 10 == 0:
            words[16:18] = ["frost", "ember"]
            words[7] = "insult" if i % 100 == 0 else words[7]
            words[12] = "vile" if i % 100 == 10 else words[12]
            words[20] = "lone" if i == 20 else words[20]
        text = " ".join(words)
        rows.append((text, 1) if i % 10 == 0 else (text.replace("frost ember", "frost frost"), 0))
    return rows


def test_toxicity_model_equals_brute_force(spark):
    rows = toxicity_corpus()
    model = {r["key"]: r["weight"] for r in toxicity.fit(spark.createDataFrame(rows, "text string, toxic int")).collect()}
    word, pair = brute.kneser_ney(rows, toxicity.DISCOUNT, toxicity.SHARED, toxicity.SHARED_PAIRS, toxicity.LEAST_RATIO)
    _, words, pairs = toxicity.grams(pa.array([" ".join(p) for p in sorted(pair)]))
    keys = {p: (int(words[2 * i + 1]), int(pairs[2 * i + 1])) for i, p in enumerate(sorted(pair))}
    for p, (word_key, pair_key) in keys.items():
        assert abs(model.get(word_key, 0.0) - word[p[1]]) < 1e-9
        assert abs(model.get(pair_key, 0.0) - (pair[p] - word[p[1]])) < 1e-9
    assert word["insult"] > 0 and word["vile"] > 0 and pair["frost", "ember"] > 0


def test_toxicity_of_a_rare_expression(spark):
    """A word in three toxic texts and in no ordinary one counts."""
    rows = [(2 * i, t, y) for i, (t, y) in enumerate(toxicity_corpus())]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    docs = spark.createDataFrame([(1, "insult"), (2, "unheard"), (3, "")], "doc_id long, text string")
    found = {r["doc_id"]: r["evidence"] for r in toxicity.evidence(docs, model, "text", ["doc_id"]).collect()}
    assert found[1] > 0 and found[2] == found[3] == 0


def test_toxicity_of_a_large_model(spark, monkeypatch):
    """Joined with the texts, a model gives the evidence that it gives when it goes to the tasks."""
    rows = toxicity_corpus() + [("", 0), (None, 0), ("stone", 0)]
    docs = spark.createDataFrame([(i // 2, t, y) for i, (t, y) in enumerate(rows)], "doc_id long, text string, toxic int")
    model = toxicity.fit(docs).localCheckpoint()
    sent = sorted(toxicity.evidence(docs, model, "text", ["doc_id"]).collect())
    monkeypatch.setattr(toxicity, "BLOCK_ENTRIES", 0)
    joined = sorted(toxicity.evidence(docs, model, "text", ["doc_id"]).collect())
    assert len(sent) == len(rows) and [r[0] for r in sent] == [r[0] for r in joined]
    assert all(abs(a[1] - b[1]) < 1e-8 for a, b in zip(sent, joined)) and any(r[1] for r in sent)
