"""Operators against plain Python that walks the published method, and texts of a million characters."""

import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from pagelark.llm import exact_dedup, language_id, mixing, ngram_join, packing, pii, quality_mil, queries, secret_scan, sharding, topk_hamming
from pagelark.sources.scratch import Workspace

SF = "/root/testdata/sf0.01"
MILLION = 1_000_000


def spark_hash(*values):
    """xxhash64 of longs, ints (as (int, 4)) and texts, chained as Spark does."""
    h = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else v[0].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True)
            h = xxhash.xxh64(data, seed=h).intdigest()
    return h


def signed(h):
    return h - (1 << 64) if h >> 63 else h


@pytest.mark.parametrize("shards", [1, 3, 40, 41])
def test_jump_walk(spark, shards):
    def walk(key):
        at, following, step = -1, 0, 0
        while following < shards:
            at, step = following, step + 1
            following = math.floor((at + 1) * (2.0**31 / ((spark_hash(key, (step, 4)) >> 33) + 1)))
        return at

    got = spark.range(-50, 400).select("id", sharding.jump_hash(F.col("id"), shards).alias("s")).collect()
    assert all(r["s"] == walk(r["id"]) for r in got)


def test_jumps_beyond_the_first_ones(spark, monkeypatch):
    keys = spark.range(500)
    want = [r["s"] for r in keys.select(sharding.jump_hash(F.col("id"), 40).alias("s")).collect()]
    monkeypatch.setattr(sharding, "JUMPS", 2)
    assert [r["s"] for r in keys.select(sharding.jump_hash(F.col("id"), 40).alias("s")).collect()] == want


def draws(rows, weights, cap, seed, slices):
    """{(id, source): sorted copies} by walking the boundaries in order of class, slice, size and hash."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(list)
    for i, t, s in rows:
        tie = signed(spark_hash(i, t, (seed, 4)))
        by[s].append((-math.floor(math.log(size(t) + 1) / math.log(2) * mixing.CLASSES), tie % slices, size(t), tie, i))
    sources = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(r[2] for r in by[s]) for s in sources]
    share = [weights[k % len(weights)] for k in range(len(sources))]
    full = set()
    while True:
        level = (sum(sizes) - sum(cap * sizes[k] for k in full)) / (sum(share[k] for k in range(len(sources)) if k not in full) or 1)
        over = {k for k in range(len(sources)) if k not in full and level * share[k] > cap * sizes[k]}
        if not over:
            break
        full |= over
    out = defaultdict(list)
    for k, s in enumerate(sources):
        target = cap * sizes[k] if k in full else level * share[k]
        open_, ahead, at = target, float(sizes[k]), 0.0
        offset = (signed(spark_hash(s, (seed + 1, 4))) % (1 << 20)) / (1 << 20)
        classes = defaultdict(list)
        for r in sorted(by[s]):
            classes[r[0]].append(r)
        for c in sorted(classes):
            held = classes[c]
            words = float(sum(r[2] for r in held))
            rate = min(cap, max(0.0, open_ / ahead)) if ahead > 0 else 0.0
            for n, r in enumerate(held, 1):
                copies = math.floor(at + n * rate + offset) - math.floor(at + (n - 1) * rate + offset)
                out[r[4], s].append(copies)
            end = at + len(held) * rate
            open_ -= (math.floor(end + offset) - math.floor(at + offset)) * words / len(held)
            ahead, at = ahead - words, end
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("cap", [3.0, 2.5])
def test_draws_follow_the_boundaries(spark, cap):
    rng = random.Random(6)
    rows = [(i, "w " * rng.choice([0, 1, 2, 5, 9, 30, 31, 90, 400]), rng.choice(["a", "b", "b", "b", "c", "d", None])) for i in range(700)]
    rows += [(5000, "twice the same", "a")] * 7 + [(None, "no id", "c")] * 5 + [(1, None, "b"), (2, "", "e"), (3, "x", "E")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    want = draws(rows, (1.0, 2.0, 3.0), cap, 17, 8)
    for f in (mixing.draw, mixing.systematic_copies):
        got = defaultdict(list)
        for r in f(docs, cap=cap, slices=8).collect():
            got[r["doc_id"], r["source"]].append(r["copies"])
            assert 0 <= r["copies"] <= math.ceil(cap) and r["taken"] == r["copies"] * r["size"]
        assert {k: sorted(v) for k, v in got.items()} == want


def test_a_hot_row_is_drawn_as_one_group(spark):
    docs = spark.createDataFrame([(None, "same text", "s")] * 4000 + [(i, f"other {i}", "t") for i in range(10)], "doc_id long, text string, source string")
    sized = mixing._sized(docs, 17, "doc_id", "text", "source", 8)
    assert sized.count() == 11 and mixing.draw(docs).count() == 4010


def plain_differencing(sizes, windows):
    """Karmarkar-Karp on lists: the sums of the windows."""
    parts = [[0] * (windows - 1) + [s] for s in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[-1] - p[0])
        a, b = parts.pop(), parts.pop()
        parts.append(sorted(x + y for x, y in zip(a, reversed(b))))
    return parts[0]


def test_differencing_equals_plain_lists():
    rng = random.Random(4)
    for _ in range(60):
        # powers of three have no equal sums, so no choice among ties
        sizes, windows = rng.sample([3**k for k in range(14)], rng.randint(2, 12)), rng.randint(1, 5)
        dealt = packing.differencing(sizes, windows)
        assert sorted(i for w in dealt for i in w) == list(range(len(sizes)))
        assert sorted(sum(sizes[i] for i in w) for w in dealt if w) == [s for s in plain_differencing(sizes, windows) if s]


@pytest.mark.parametrize("text", [" " * MILLION, "\t\n" * (MILLION // 2), "a" * MILLION, "漢" * (MILLION // 4), "x" + " " * MILLION + "y<|endoftext|> "])
def test_ids_of_long_runs(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.token_ids(text, packing.default_vocabulary()).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]


def test_carried_ids_stay_exact(spark):
    big = 9007199254740993
    docs = spark.createDataFrame([(big, "one", 1.5), (None, "two", None), (-big, None, float("nan"))], "doc_id long, text string, x double").coalesce(1)
    got = packing.pack(docs, carry=("doc_id", "x")).collect()
    assert {r["doc_id"] for r in got} == {big, None, -big} and Counter(str(r["x"]) for r in got) == Counter(["1.5", "None", "nan"])


def brute_apart(base, wide):
    free = sorted(w for w in wide if all(w[2] <= b[0] or b[2] <= w[0] for b in base))
    return [w for k, w in enumerate(free) if all(o[2] <= w[0] for o in free[:k])]


def test_added_spans_equal_brute_force(spark):
    rng = random.Random(12)
    span = lambda: (lambda a: (a, rng.randrange(4), a + rng.randint(1, 12), "k"))(rng.randrange(400))
    rows = [([span() for _ in range(rng.choice([0, 1, 5, 40]))], [span() for _ in range(rng.choice([1, 3, 20, 60]))]) for _ in range(60)]
    kind = "array<struct<start:int,rank:int,end:int,kind:string>>"
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, base {kind}, wide {kind}").select("i", pii.apart("base", "wide").alias("a")).collect()
    assert all([tuple(s) for s in r["a"]] == brute_apart(*rows[r["i"]]) for r in got)


def test_running_totals(spark):
    rng = random.Random(13)
    rows = [(i, [rng.randint(-50, 50) for _ in range(n)]) for i, n in enumerate([0, 1, 15, 16, 17, 255, 256, 257, 5000])]
    df = spark.createDataFrame(rows, "i int, v array<int>")
    got = df.select("i", F.expr(pii.running("v", "{s} + {x}", "0")).alias("t"), F.expr(pii.running("v", "greatest({s}, {x})", "-99")).alias("m")).collect()
    for r in got:
        v = rows[r["i"]][1]
        assert r["t"] == np.cumsum(v).tolist() and r["m"] == (np.maximum.accumulate(v).tolist() if v else [])


@pytest.fixture(scope="module")
def weights(spark):
    return pii.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def test_many_addresses_in_one_text(spark, weights):
    docs = spark.createDataFrame([(1, "ab.c@de.fr, " * 20000), (2, "4465758382889437 4465758382889437 x " * 20000)], "doc_id long, text string")
    began = time.perf_counter()
    got = {r["doc_id"]: (r["b"], r["a"]) for r in pii.spans(docs, weights).select("doc_id", F.size("base").alias("b"), F.size("added").alias("a")).collect()}
    assert got == {1: (20000, 0), 2: (0, 40000)} and time.perf_counter() - began < 60


def test_planted_data_beyond_the_base_patterns(spark, weights):
    rows = [(1, "ana 7536784127813050 4845168114407329 ok", "card", 2), (2, "mail jane [at] corp [dot] com now", "email", 1), (3, "Call (415) 555-6503 now", "phone", 1), (4, "part 1234567890123456 x", "card", 0)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r["doc_id"]: [s["kind"] for s in r["added"]] for r in pii.spans(docs, weights).collect()}
    assert got == {i: [kind] * n for i, _, kind, n in rows}


@pytest.mark.parametrize(("text", "added"), [
    ('db_password = k\nk = "Zx81kLm2Qp90"', ["Zx81kLm2Qp90"]),
    ('k = "Zx81kLm2Qp90"\nm = k\nauth_token = m', ["Zx81kLm2Qp90"]),
    ('auth_token = m\nm = k\nk = "Zx81kLm2Qp90"', ["Zx81kLm2Qp90"]),
    ("a = b\nb = a\npassword_key = a", []),
    ('k = "Aa1bb2cc3dd4"\nclient_secret = k\nk = "Ee5ff6gg7hh8"', ["Aa1bb2cc3dd4"]),
    ('encryption = "aB3-xK9_qLm2Zt8Wp4+Yc7/Dv5Rs6Hn1"', ["aB3-xK9_qLm2Zt8Wp4+Yc7/Dv5Rs6Hn1"]),
])
def test_constants_reach_their_targets(text, added):
    assert [text[s:e] for s, _, e in secret_scan.literal_matches(text)] == added


@pytest.mark.parametrize("text", ['token "' + '\\"' * (MILLION // 2), "key='" + "\\'" * (MILLION // 2), "secret_key=" * (MILLION // 11), "password" + " " * MILLION, "a" * MILLION + "=token", "<key" + ".a" * (MILLION // 2)])
def test_secrets_of_long_texts(text):
    began = time.perf_counter()
    secret_scan.scan_text(text)
    assert time.perf_counter() - began < 30


def test_every_filter_gives_the_same_groups(spark, monkeypatch):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, f"text {rng.randrange(150)}") for i in range(400)] + [(None, "text 1"), (7, None)], "doc_id long, text string").repartition(3)
    run = lambda: sorted(map(str, exact_dedup.annotate(docs, keep="largest").collect()))
    want = run()
    for words in (1, 64):
        monkeypatch.setattr(exact_dedup, "FILTER_WORDS", words)
        assert run() == want


def test_language_sample_is_bounded(spark):
    rows = [(None, "der und die das ist nicht", "de")] * 3000 + [(i, f"the and of number {i}", "en") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, fit_rows=100)
    assert set(model.languages) == {"de", "en"}
    got = {r["text"]: r["lang_pred"] for r in language_id.predict(spark.createDataFrame([(1, "das ist die"), (2, "number of the")], "doc_id long, text string"), model).collect()}
    assert got == {"das ist die": "de", "number of the": "en"}


def test_quality_sample_takes_one_text_of_an_id(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"text {i % 7}") for i in range(500)] + [(2, "GOOD " * 5)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)] * 50 + [(2, 1)], "doc_id long, quality int")
    trained = []
    monkeypatch.setattr(quality_mil, "train", lambda codes, bag, y: trained.append(len(y)) or quality_mil.Model(np.zeros(1), np.ones(1), {}, 0.5))
    quality_mil.fit(docs, labels)
    assert trained == [2]


def test_radius_rounds_and_scan_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(0, 1, (60, 64))
    near = centers[rng.integers(0, 60, 2500)] * np.where(rng.random((2500, 64)) < 0.03, -1, 1)
    vectors = np.concatenate([near, rng.normal(0, 1, (500, 64))]).astype(np.float32)
    signs = vectors > 0
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(4)
    got = defaultdict(list)
    for r in topk_hamming.top_k(docs, F.col("vec_id") % 50 == 0, k=10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["hamming"], r["neighbor_id"]))
    for q in range(0, 3000, 50):
        d = (signs != signs[q]).sum(axis=1)
        assert got[q] == sorted((int(d[i]), i) for i in range(3000) if i != q)[:10]


LONG = ["", None, "ab c1.2.3.4 " * 80000, " " * MILLION, "漢字" * (MILLION // 2), "key=\"a1B2c3D4e5\" mail a@b.cd +1 (415) 555-6503\n" * 20000, "x" * MILLION]


@pytest.mark.parametrize("run", [
    lambda d, w: exact_dedup.annotate(d), lambda d, w: sharding.assign(d), lambda d, w: mixing.draw(d), lambda d, w: pii.spans(d, w), lambda d, w: secret_scan.scan(d), lambda d, w: packing.pack(d),
    lambda d, w: ngram_join.components(d), lambda d, w: language_id.predict(d, language_id.fit(d)), lambda d, w: quality_mil.score(d, quality_mil.fit(d, d.select("doc_id", (F.col("doc_id") % 2).alias("quality")))),
])
def test_texts_of_a_million_characters(spark, weights, run):
    docs = spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(LONG)], "doc_id long, text string, source string, lang string").repartition(4)
    assert {r["doc_id"] for r in run(docs, weights).select("doc_id").distinct().collect()} == set(range(len(LONG)))


@pytest.fixture
def tables(spark, tmp_path):
    def write(rows):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size long")
        docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
        spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
        return str(tmp_path)

    return write


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_on_awkward_rows(spark, tables, empty):
    known = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long")).limit(150).collect()]
    text = known[5][1]
    more = [known[5]] * 3 + [(None, text, None, None, None)] * 2 + [(70001, text + " more words at the end", "en", None, 5), (70002, None, None, "src1", 0), (70003, "", "en", "src1", 0), (70004, "w " * 200000, "en", "src1", None)]
    sf = tables([] if empty else [(*r, True, -1) for r in known + more])
    docs, scratch = spark.read.parquet(f"{sf}/documents.parquet"), Workspace(spark)
    columns, rows = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.keep(stage(spark, docs, sf), name)
        rows[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    if empty:
        assert not any(rows.values())
        return
    low = lambda r: (r["text"] or "").lower()
    assert max(Counter(map(low, rows["exact_dedup"])).values()) == 1 and {low(r) for r in rows["exact_dedup"]} == {low(r) for r in rows["quality"]}
    assert {r["doc_id"] for r in rows["near_dedup"]} <= {r["doc_id"] for r in rows["exact_dedup"]}
    packed = defaultdict(bytes)
    for r in sorted(rows["packing"], key=lambda r: (r["doc_id"] or 0, r["start"])):
        packed[r["sequence_id"]] += b" " * r["length"]
    assert max(map(len, packed.values())) <= 1024
    tokens = sum(len(packing.token_ids(r["text"], packing.default_vocabulary())) for r in rows["mixing"])
    assert sum(r["length"] for r in rows["packing"]) == tokens


def test_digest_columns_of_the_queries(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op6_sharding(spark, SF).collect():
        data = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(data) + 16 and r["text_crc32"] == zlib.crc32(data)
