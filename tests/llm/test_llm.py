import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from conftest_llm import ODD, words
from pyspark.sql import functions as F

from corvane.llm import ann, bpe, fingerprint, graph, language_model, mixing, ngram_join, quality, queries, sharding, suffix_dedup, toxicity
from corvane.llm.common import written

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


# sharding


def test_sharding_is_stable_gapless_and_moves_into_the_new_shard_only(spark, documents):
    docs = documents(*ODD, *["x"] * 200, ids=[*range(len(ODD)), *range(100, 300)]).union(documents("x", "x", ids=[None, 7]))
    got = sharding.place(docs, [1.0] * 8, [1.0] * 9).collect()
    assert len(got) == docs.count()
    for s in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 8) for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], set()).add(r["shard"])
    assert all(len(v) == 1 for v in by_id.values())
    one = next(r for r in got if r["doc_id"] == 8)
    assert (one["size"], one["text_crc32"]) == (len(ODD[8].encode()) + 1, zlib.crc32(ODD[8].encode()))
    assert sharding.place(docs.limit(0), [1.0], [1.0, 1.0]).count() == 0


def test_weights_shape_shards(spark):
    n = spark.range(4000).select(sharding.shard_of(F.col("id"), [3.0, 1.0]).alias("s")).groupBy("s").count().collect()
    n = {r["s"]: r["count"] for r in n}
    assert 2850 < n[0] < 3150
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("id"), [0.0])


# quality and toxicity


def test_quality_held_out(spark):
    got = queries.QUERIES["op10_quality"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert ((got.score >= 0.5) == (got.quality == 1)).mean() > 0.95


def test_compiled_rules_equal_numpy(spark, documents):
    x = {"a": np.array([0.0, 1, 2, 3]), "b": np.array([1.0, 1, 0, 0])}
    rule = quality.Rule((("a", True, 0.5), ("b", False, 0.5)))
    model = quality.RuleEnsemble(-1.0, ((rule, 2.0),))
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*x.values(), strict=True)], "a double, b double")
    want = 1 / (1 + np.exp(-(-1 + 2 * rule.matches(x))))
    assert np.allclose([r[0] for r in df.select(model.column()).collect()], want)


def test_quality_of_odd_rows_and_labels(spark, documents):
    docs = documents(*ODD).withColumn("score", F.lit("kept")).withColumn("_o", F.lit(1))
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    got = quality.score(docs, quality.fit(docs, labels), into="_cv_score")
    assert got.count() == len(ODD) and got.where("_cv_score between 0 and 1").count() == len(ODD)
    assert got.columns == [*docs.columns, "_cv_score"]


def toy_index():
    r = np.random.default_rng(0)
    doc, term, label = [], [], []
    for i in range(300):
        y = int(i % 5 == 0)
        label.append(y)
        for t in [*r.integers(0, 12, 6), *([20 + i % 3] if y else [])]:
            doc.append(i)
            term.append(int(t))
    return toxicity.NearestExamples(np.arange(300), np.array(label), np.array(doc), np.array(term, np.uint64))


def cosines(m, doc, term, n):
    """All cosines of the examples among each other, by a dense matrix."""
    tf = np.zeros((n, len(m.vocabulary)))
    np.add.at(tf, (doc, np.searchsorted(m.vocabulary, term)), 1)
    w = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * (np.log((1 + n) / (1 + (tf > 0).sum(axis=0))) + 1)
    w /= np.sqrt((w * w).sum(axis=1))[:, None]
    return w @ w.T


@pytest.mark.parametrize("common", [0.1, 2.0])
def test_block_max_search_is_exact(monkeypatch, common):
    """Four languages of 400 words: blocks of the others are never scored, and the neighbours are those of the dense matrix."""
    monkeypatch.setattr(toxicity, "COMMON", common)
    monkeypatch.setattr(toxicity, "BLOCK", 16)
    monkeypatch.setattr(toxicity, "NEAREST", 9)
    r = np.random.default_rng(5)
    rank = np.minimum(r.zipf(1.3, 600 * 40) - 1, 399)
    doc = np.repeat(np.arange(600), 40)
    term = (doc % 4 * 400 + rank + 1).astype(np.uint64)
    doc, term = np.concatenate((doc, [599] * 40)), np.concatenate((term, term[doc == 3]))  # ties and a repeated text
    m = toxicity.NearestExamples(np.arange(600), (r.random(600) < 0.3).astype(int), doc, term)
    exact, scored = cosines(m, doc, term, 600), []
    t, row, tf = np.unique(np.column_stack((doc, term.astype(np.int64))), axis=0, return_counts=True), None, None
    row, h, tf = t[0][:, 0], t[0][:, 1].astype(np.uint64), t[1]
    real = np.partition
    monkeypatch.setattr(toxicity.np, "partition", lambda x, *a: scored.append(len(x)) or real(x, *a))
    found = {r: (at.tolist(), sims) for r, at, sims in m.found(h, row, tf, 600)}
    for q in range(600):
        want = sorted((-round(exact[q, i], 12), i) for i in range(600) if exact[q, i] > 1e-12)[:9]
        assert found[q][0] == [i for _, i in want] and np.allclose(found[q][1], [-x for x, _ in want])
    # like examples stand together by their common terms: most of a language's are never seen by the others
    assert common > 1 or np.mean(scored) < 300


def test_neighbours_are_those_of_whole_texts():
    texts = [words(40 + i, 30) + (" vile" if i % 4 == 0 else "") for i in range(120)]
    asked = ["vile " + words(200, 200), texts[3], words(201, 5) + " " + texts[5].split()[0], "9z9 unseen"]
    doc = np.repeat(np.arange(120), [len(t.split()) for t in texts])
    split_hash = lambda t: toxicity.terms(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0]
    m = toxicity.NearestExamples(np.arange(120), (np.arange(120) % 4 == 0).astype(int), doc, np.concatenate([split_hash(t) for t in texts]))
    df = Counter(w for t in texts for w in set(t.split()))

    def vector(t):
        v = {w: (1 + math.log(n)) * (math.log(121 / (1 + df[w])) + 1) for w, n in Counter(t.split()).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    examples = [vector(t) for t in texts]
    for t, (_, ids, sims) in zip(asked, m.score_texts(toxicity.pa.array(asked)), strict=True):
        q = vector(t)
        want = sorted(((-round(s, 12), i) for i, e in enumerate(examples) if (s := sum(q[w] * e.get(w, 0) for w in q)) > 0))[:5]
        assert ids == [i for _, i in want] and np.allclose(sims, [-s for s, _ in want])


def test_toxicity_held_out_and_odd_rows(spark, documents):
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES["op2_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.96
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    docs = documents(*ODD)
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(scored) == len(ODD) and all(r["score"] == 0 for r in scored)
    one_class = spark.createDataFrame([(i, 1) for i in range(len(ODD))], "doc_id long, toxic int")
    model = toxicity.fit(docs, one_class)
    scored = toxicity.score(docs.union(docs).withColumn("score", F.lit("x")), model).collect()
    assert len(scored) == 2 * len(ODD) and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), one_class)).count() == 0


# fingerprints


def test_fingerprints_against_brute_force(spark, documents, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 3)
    got = sorted(fingerprint.fingerprints(documents(*ODD)).collect(), key=lambda r: r["doc_id"])
    texts = [t or "" for t in ODD]
    for i, r in enumerate(got):
        t, n = texts[i], texts[(i + 1) % len(texts)]
        h = len(t) // 2
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256((t[: len(t) - h] + n[:h]).encode()).hexdigest()
    assert got[5]["fingerprint"] == got[6]["fingerprint"] and got[5]["near_next"] == 1
    assert got[0]["near_next"] == 1 and got[2]["near_next"] == 0
    one = fingerprint.fingerprints(documents("a b")).first()
    assert one["near_next"] == 1
    assert fingerprint.fingerprints(documents()).count() == 0


def drawn(df, keys, samples=fingerprint.SAMPLES):
    """The least a of each draw by the keys of a text."""
    out = {}
    for r in fingerprint.signatures(df, "t", keys, samples).collect():
        out.setdefault(tuple(r[k] for k in keys), {})[r["_block"]] = [r[f"_s{i}"] for i in range(fingerprint.BLOCK)]
    return {k: np.concatenate([v[b] for b in sorted(v)]) for k, v in out.items()}


def test_draws_are_those_of_gamma_numbers(spark):
    """a = c exp(-r (t - b + 1)) with t = floor(ln w / r + b), in plain floating point, from the same hashed bits."""
    import xxhash

    texts = [words(1, 40) + " the the the the the of of", "one", "x " * 1000 + "y " * 3, "Ünd und UND"]
    got = drawn(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), ["k"])
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    long_hash = lambda x, seed=42: signed(xxhash.xxh64_intdigest((x & (1 << 64) - 1).to_bytes(8, "little"), seed=seed & (1 << 64) - 1))
    int_hash = lambda x, seed: signed(xxhash.xxh64_intdigest(x.to_bytes(4, "little"), seed=seed & (1 << 64) - 1))

    def exponential(h, at, zeros, z_at, z_bits):
        field = (h & (1 << 64) - 1) >> at | 1 << zeros
        z = (((h & (1 << 64) - 1) >> z_at & (1 << z_bits) - 1) + 0.5) / (1 << z_bits)
        return ((field & -field).bit_length() - 1 - math.log2(1 - z / 2)) * math.log(2)

    for k, text in enumerate(texts):
        least = []
        for draw in range(fingerprint.SAMPLES):
            block, i = divmod(draw, fingerprint.BLOCK)
            each = []
            for word, w in Counter(text.lower().split()).items():
                h = int_hash(block, long_hash(signed(xxhash.xxh64_intdigest(word.encode(), seed=42))))
                g = int_hash(i, long_hash(h))
                e1, e2, c = exponential(g, 0, 12, 12, 12), exponential(long_hash(g), 0, 24, 32, 32), exponential(g, 24, 8, 32, 12) + exponential(g, 44, 8, 52, 12)
                r = e1 + e2
                t = math.floor(math.log(w) / r + e2 / r)
                each.append(c * math.exp(-r * (t - e2 / r + 1)))
            least.append(min(each) / math.log(2))
        assert np.allclose(got[k,], least, rtol=2e-3)


def test_collisions_estimate_generalised_jaccard(spark):
    a, b = "x x x y z " * 20 + "q " * 30, "x x y y w " * 20 + "q " * 50
    ca, cb = Counter(a.split()), Counter(b.split())
    true = sum((ca & cb).values()) / sum((ca | cb).values())
    s = drawn(spark.createDataFrame([(0, a), (1, b)], "k int, t string"), ["k"], 402)
    assert abs(np.mean(s[0,] == s[1,]) - true) < 0.09


def test_likeness_is_close_to_the_generalised_jaccard(spark):
    pairs = [(f"{words(i, 60)} {words(i + 500, 5 + i % 30)} a a a", f"{words(i, 60)} {words(i + 900, 5 + i % 20)} a") for i in range(60)]
    s = drawn(spark.createDataFrame([(i, k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)], "i int, k int, t string"), ["i", "k"])
    counts = [(Counter(a.split()), Counter(b.split())) for a, b in pairs]
    error = [np.mean(s[i, 0] == s[i, 1]) - sum((a & b).values()) / sum((a | b).values()) for i, (a, b) in enumerate(counts)]
    assert np.sqrt(np.mean(np.square(error))) < 0.7 / np.sqrt(fingerprint.SAMPLES)


def test_fingerprints_order_null_and_equal_ids(spark, documents, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 2)
    docs = documents(*[f"w{i} " * 6 for i in range(30)], ids=[*[None] * 10, *range(40, 20, -1)]).union(documents("same text", "same text", ids=[7, 7]))
    got = fingerprint.fingerprints(docs).collect()
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert len(got) == 32 and by_id[7]["near_next"] in (0, 1)
    text = {r["doc_id"]: r["text"] for r in docs.where("doc_id is not null").collect()}
    for i in range(21, 40):
        t, n = text[i], text[i + 1]
        assert by_id[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()
    # each null id's text is continued by another's, and the last of them by the first row's
    tails = Counter()
    for r in got:
        if r["doc_id"] is None:
            nexts = [x for x in [*[f"w{i} " * 6 for i in range(10)], "same text"] for t in [f"w{i} " * 6 for i in range(10)] if r["edited_sha256"] == hashlib.sha256((t[: len(t) - len(t) // 2] + x[: len(t) // 2]).encode()).hexdigest()]
            tails.update(nexts[:1])
    assert sum(tails.values()) == 10 and tails["same text"] == 1


# near duplicates


def brute_links(texts):
    sets = []
    for t in texts:
        w = split((t or "").translate(LOW))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    n = len(texts)
    link = [[j for j in range(n) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(n)]
    cls = list(range(n))
    for _ in range(n):
        new = [min([cls[i], *[cls[j] for j in link[i]]]) for i in range(n)]
        if new == cls:
            break
        cls = new
    return [(c, len(x)) for c, x in zip(cls, link, strict=True)]


@pytest.mark.parametrize("tile", [512, 4])
def test_ngram_join_against_brute_force(spark, documents, monkeypatch, tile):
    monkeypatch.setattr(ngram_join, "BUCKET_TILE", tile)
    monkeypatch.setattr(ngram_join, "GROUP_TILE", tile)
    base = words(3, 150).split()
    near = [" ".join(base[:k] + ["new"] + base[k + 1 :]) for k in range(0, 150, 10)]
    texts = [*ODD, " ".join(base), *near, " ".join(base[:120]), words(4, 150)]
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in ngram_join.classes(documents(*texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_links(texts)


def test_keep_one(spark, documents):
    docs = documents(*ODD).union(documents(ODD[5], ids=[5])).withColumn("copies", F.lit(1)).withColumn("node", F.lit(2))
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 5, 7, 8, 9]
    assert ngram_join.keep_one(docs.limit(0)).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    for n, m in zip(range(16, 129, 16), ngram_join.least_matches(), strict=True):
        missed = sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(m))
        assert missed < 1e-5


def test_components(spark):
    e = spark.createDataFrame([(9, 8), (8, 7), (7, 1), (4, 5), (5, 4), (3, 3), *[(100, 101 + i) for i in range(50)]], "a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(e).collect()}
    assert got == {9: 1, 8: 1, 7: 1, 1: 1, 4: 4, 5: 4, 100: 100} | {101 + i: 100 for i in range(50)}
    assert graph.components(e.limit(0)).count() == 0


# suffix dedup


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    n = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if n[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest()))
    return out


@pytest.mark.parametrize("most, far_more", [(4000, 64_000), (1, 64_000), (1, 2), (1, 1)])
def test_suffix_dedup_against_brute_force(spark, documents, monkeypatch, most, far_more):
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    monkeypatch.setattr(suffix_dedup, "FAR_MORE", far_more)
    if far_more == 1:
        monkeypatch.setattr(suffix_dedup, "BROADCAST_GRAMS", 0)
    p, q = words(5, 60), words(6, 80)
    texts = [*ODD[:7], f"{words(7, 40)} {p} {words(8, 9)}", f"{p}{q}", f"é{q} {p[50:]}", q[:199], q[3:203], "ab" * 150, "ab" * 140 + "c", "a" * 700, f"{words(9, 20)}{p}{p}"]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove(documents(*texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, 200)


def test_equal_windows_without_end_are_sorted_in_parts(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 4)
    kinds = [("key", suffix_dedup.pa.int64()), ("gram", suffix_dedup.pa.int64()), ("digest", suffix_dedup.pa.int64()), ("base", suffix_dedup.pa.int32()), ("rel", suffix_dedup.pa.int32()), ("times", suffix_dedup.pa.int64()), ("bytes", suffix_dedup.pa.binary())]
    rows = [(1, 1, 100, 5, 0, 1, b"")] + [(2, 1, 200 + i, 7, 0, 1, b"") for i in range(23)] + [(3, 1, 300, 9, 0, 1, b""), (4, 1, 400, 9, 0, 2, b"")]
    batches = [suffix_dedup.pa.RecordBatch.from_arrays([suffix_dedup.pa.array(c, k) for c, (_, k) in zip(zip(*rows[i : i + 5], strict=True), kinds, strict=True)], names=[n for n, _ in kinds]) for i in range(0, len(rows), 5)]
    found = [d for b in suffix_dedup._sort(200)(iter(batches)) for d in b.column("digest").to_pylist()]
    assert found == [*range(200, 223), 400]


def test_remove_with_clashing_names_and_odd_ids(spark, documents):
    docs = documents(*ODD).union(documents("a " * 300, "b", ids=[None, None])).withColumn("n_bytes", F.lit("x")).withColumn("kept_text", F.lit(1)).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    got = suffix_dedup.remove(docs)
    assert got.count() == docs.count() and sorted(got.columns) == sorted({*docs.columns, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"} - {"text"})
    assert {r["n_removed"] for r in got.where("doc_id is null").collect()} == {600, 0}
    assert suffix_dedup.remove(docs.limit(0)).count() == 0


def test_long_texts_are_searched_in_overlapping_pieces(monkeypatch):
    data = np.frombuffer(words(10, 900).encode(), np.uint8)
    whole = {tuple(x) for x in np.column_stack(suffix_dedup.anchors(data, np.array([0, len(data)]), 200)[4:])}
    step, found = 1500, set()
    covered = 0
    for lo in range(0, len(data), step):
        part = data[lo : lo + step + 199]
        got = suffix_dedup.anchors(part, np.array([0, len(part)]), 200)
        covered += int((got[2] - got[1] + 1).sum())
        found |= {int(g) for g in got[4]}
    assert covered == len(data) - 199 and {int(g) for g, _ in whole} <= found


def test_without_repeats_keeps_columns(spark, documents):
    docs = documents(*ODD).withColumn("n_bytes", F.lit("x")).withColumn("_rk", F.lit("y")).withColumn("cuts", F.lit(1.5))
    got = suffix_dedup.without_repeats(docs)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == [0, 1, 2, 3, 4, 7, 8, 9] or got.count() >= 7
    assert got.where("n_chars <> length(text)").count() == 0


# language model


def test_language_model_counts_and_base(spark, documents):
    texts = [*ODD, *[words(k, 50).upper() for k in range(20, 40)]]
    got = {r["doc_id"]: r for r in language_model.score(documents(*texts)).collect()}
    tokens = [[*split((t or "").translate(LOW)), None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    c = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(tokens):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
        assert r["score"] < 0 and math.isfinite(r["score"])
    assert language_model.score(documents()).count() == 0


def test_language_model_beats_the_base_on_held_out_text(spark):
    got = language_model.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_language_model_tells_words_of_one_ending_apart(spark, documents):
    texts = ["sunab one moonab two " * 20] * 40
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2]
    texts[held[0]], texts[held[1]] = "sunab one moonab two", "sunab two moonab one"
    got = {r["doc_id"]: r["score"] for r in language_model.score(documents(*texts)).collect()}
    assert got[held[0]] > got[held[1]] + 2


def test_gibbs_moves_keep_the_exact_distribution_of_tables():
    d, w, n, c = 0.5, 0.7, 20_000, 5
    ways = {1: {1: 1.0}}  # generalised Stirling numbers
    for k in range(1, c):
        ways[k + 1] = {t: ways[k].get(t - 1, 0) + (k - t * d) * ways[k].get(t, 0) for t in range(1, k + 2)}
    total = sum(v * w**t for t, v in ways[c].items())
    rng, at = np.random.default_rng(0), np.arange(n)
    seats = language_model.Seats(np.ones(n, int), np.full(n, c), 1)
    for _ in range(40):
        seats.leave(at, rng)
        seats.sit(at, np.full(n, w), d, rng)
    assert (seats.c == c).all() and seats.sizes().sum() == n * c and len(seats.sizes()) == seats.t.sum()
    for t, v in ways[c].items():
        assert abs((seats.t == t).mean() - v * w**t / total) < 0.015


def test_language_model_scores_against_brute_force(spark, documents, monkeypatch):
    """Every text's score from the tables of the last sweeps, by dictionaries."""
    m, seen = language_model, []
    monkeypatch.setattr(m, "dropped", lambda df: None)
    monkeypatch.setattr(m, "written", lambda df, name: seen.append((name, w := written(df, name))) or w)
    monkeypatch.setattr(m, "SHARE", 0.02)
    states = []
    monkeypatch.setattr(m, "_answer", lambda sent, f=m._answer: states.extend(sent.value[1]) or f(sent))
    r = np.random.default_rng(4)
    texts = [" ".join(r.choice(["the", "of", "cat", "dog", "runs", "sleeps", "ünder"], 30, p=[0.3, 0.2, 0.1, 0.1, 0.1, 0.1, 0.1])) for _ in range(40)] + [None, "", "new words here"]
    got = {r["doc_id"]: r["score"] for r in m.score(documents(*texts)).collect()}
    rows = [w.where("bucket is not null").collect() for n, w in seen if n == "sweep"][-1]
    buckets = [(m.Bucket(r["bucket"], [r[c] for c in m._PARTS]), r) for r in rows]
    names = {m.range_hash(m.prefix_hash(np.frombuffer(w.encode(), np.uint8)), np.array([0]), np.array([len(w.encode())]))[0]: w for t in texts for w in (t or "").split()}
    count, kept, base = Counter(), [({}, {}), ({}, {})], {}
    for b, r in buckets:
        word = [names.get(h, None) for h in b.hash]
        base |= dict(zip(word, m.unpack(r["base"], np.float64).tolist(), strict=True))
        for i, (tables, roots) in enumerate(kept):
            t2, t1 = m.unpack(r["kept"][2 * i], np.int64), m.unpack(r["kept"][2 * i + 1], np.int64)
            for w, u, t in zip(b.word, b.context.tolist(), b.pair_tables(t2).tolist(), strict=True):
                tables[word[w], u] = t
            roots |= dict(zip(word, t1.tolist(), strict=True))
        count.update({(word[w], u): n for w, u, n in zip(b.word, b.context.tolist(), b.count.tolist(), strict=True)})
    tokens = [[*(t or "").split(), None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    seen_words = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    assert sum(count.values()) == sum(seen_words.values())
    # contexts are numbered: frequent words by hash, then classes
    frequent = sorted(h for h, w in names.items() if seen_words[w] >= 0.02 * sum(seen_words.values()))
    number = {names[h]: i for i, h in enumerate(frequent)}
    none = len(frequent) + m.CLASSES
    for i, t in enumerate(tokens):
        if not held[i] and i < 40:
            continue
        if any(w is not None and w not in number for w in t[:-1]):
            continue  # its class is known to the blocks only
        total = 0.0
        for u, w in zip([None, *t], t, strict=False):
            p = 0.0
            c_at = none if u is None else number[u]
            for (tables, roots), s in zip(kept, states, strict=True):
                c1, root = sum(n for (x, _), n in tables.items() if x == w), roots.get(w, 0)
                all1, allt = sum(tables.values()), sum(roots.values())
                q = (max(c1 - s.root_discount * root, 0) + (s.root_strength + s.root_discount * allt) * base[w]) / (s.root_strength + all1)
                customers = sum(n for (_, x), n in count.items() if x == c_at)
                opened = sum(n for (_, x), n in tables.items() if x == c_at)
                p += (max(count[w, c_at] - s.discount * tables.get((w, c_at), 0), 0) + (s.strength + s.discount * opened) * q) / (s.strength + customers)
            total += math.log10(p / m.KEPT)
        assert got[i] == pytest.approx(total, abs=len(t) * m.STEP / 2 + 1e-9)


def test_spelling_probabilities_sum_to_one():
    data = np.frombuffer(b"abacadabra", np.uint8)
    _, sym, ctx = language_model.letters(data, np.array([0, 3, 10]))
    key, n = np.unique(ctx * language_model.LETTERS + sym, return_counts=True)
    m = language_model.Spelling.seated(key, n.astype(float), language_model.Spelling.uniform(), 1)
    for c in [*np.unique(ctx), 12345]:
        assert m.probability(np.full(257, c), np.arange(257)).sum() == pytest.approx(1)


def test_seating_bounds():
    c = np.array([0, 1, 2, 50, 5000])
    t = language_model.seat(c, np.full(5, 3.0), 0.5, np.random.default_rng(0))
    assert (t <= c).all() and (t[1:] >= 1).all() and t[0] == 0


# nearest neighbours


def test_ann_recall_and_odd_vectors(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(1500, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    same = [(2000 + i, [9.0] * 16) for i in range(60)]
    odd = [(3000, None), (3020, [0.0] * 16), (3040, [float("nan")] * 16), (3060, [1.0, None] * 8), (3080, [1.0])]
    df = spark.createDataFrame(rows + same + odd, "vec_id long, embedding array<double>")
    got = ann.neighbours(df, F.col("vec_id") % 20 == 0).toPandas()
    assert set(got.query_id) == {i for i, _ in rows + same if i % 20 == 0}
    ids, m = np.array([i for i, _ in rows + same]), np.array([v for _, v in rows + same])
    hit = 0
    for q, g in got.groupby("query_id"):
        assert g.sort_values("rank")["rank"].tolist() == list(range(1, 21))
        s = m @ m[ids == q][0]
        assert np.allclose(g.score, [s[ids == v][0] for v in g.vec_id])
        s[ids == q] = -np.inf
        hit += len(set(ids[np.lexsort((ids, -s))[:20]]) & set(g.vec_id))
    assert hit / len(got) > 0.9
    assert ann.neighbours(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_ann_ties_ids_and_few_candidates(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=32)
    rows = [(i, v.tolist()) for i in range(300)] + [(1000 + i, x.tolist()) for i, x in enumerate(r.normal(size=(700, 32)) * 0.1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = ann.neighbours(df, F.col("vec_id") % 20 == 0).toPandas()
    for q, g in got[got.query_id < 300].groupby("query_id"):
        assert g.sort_values("rank").vec_id.tolist() == [i for i in range(21) if i != q][:20] and g.score.nunique() == 1
    few = spark.createDataFrame([(20, [1.0, 2.0]), (20, [2.0, 1.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0]), (None, [1.0, 1.0]), (7, [0.5, -1.0])], "vec_id long, embedding array<double>")
    got = ann.neighbours(few, F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(20, 1, 3, 3.0), (20, 2, 3, 3.0), (20, 3, 7, -1.5)]


def test_ann_recall_on_the_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").where("embedding is not null")
    t = df.toPandas()
    ids, m = t.vec_id.to_numpy(), np.array(t.embedding.tolist(), float)
    ok = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
    ids, m = ids[ok], m[ok]
    got = ann.neighbours(df, F.col("vec_id") % 20 == 0).toPandas()
    hit = 0
    for q, g in got.groupby("query_id"):
        s = m @ m[ids == q][0]
        s[ids == q] = -np.inf
        hit += len(set(ids[np.argsort(-s)[:20]]) & set(g.vec_id))
    assert hit / len(got) > 0.93


# mixing


def test_mixing_targets_and_caps(spark, documents):
    docs = documents(*[words(k, 5 + k % 7) for k in range(300)], *ODD, sources=[*["a"] * 200, *["b"] * 60, *["c"] * 40, *[None] * len(ODD)])
    got = mixing.mix(docs).toPandas()
    assert len(got) == docs.count() and got.copies.between(0, 2).all()
    assert got.groupby(got.source.fillna("?")).target.first().sum() == pytest.approx(1.5 * got["size"].sum())
    assert (got.target <= 2 * got.source_size + 1e-6).all()
    for _, g in got[got.source.isin(["a", "b", "c"])].groupby("source"):
        assert abs((g["size"] * g.copies).sum() - g.target.iloc[0]) <= 0.03 * g.target.iloc[0] + 24
    assert got.sort_values("doc_id").copies.tolist() == mixing.mix(docs.repartition(3)).toPandas().sort_values("doc_id").copies.tolist()
    taken = mixing.take(docs.withColumn("copies", F.lit("x")))
    assert taken.count() == got.copies.sum() and "copies" in taken.columns
    assert mixing.mix(documents()).count() == 0


def test_take_keeps_every_column_of_rows_that_differ_in_one(spark, documents):
    docs = documents(*["a b c"] * 4, *[None] * 2, ids=[1, 1, 1, 2, None, None]).withColumn("lang", F.element_at(F.array(*[F.lit(x) for x in ("en", "de")]), (F.monotonically_increasing_id() % 2 + 1).cast("int")))
    docs = docs.withColumn("m", F.create_map(F.lit("k"), F.col("lang"))).cache()
    want = mixing.mix(docs).groupBy("doc_id").agg(F.sum("copies").alias("n")).collect()
    got = mixing.take(docs)
    assert got.columns == docs.columns
    taken = Counter((r["doc_id"], r["lang"], r["m"]["k"]) for r in got.collect())
    assert all(a == b for _, a, b in taken) and {i for i, _, _ in taken} <= {1, 2, None}
    assert {r["doc_id"]: r["n"] for r in want if r["n"]} == dict(sum((Counter({i: n}) for (i, _, _), n in taken.items()), Counter()))
    there = Counter((r["doc_id"], r["lang"]) for r in docs.collect())
    assert all(n <= 2 * there[i, lang] for (i, lang, _), n in taken.items())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(map(str, (tuple(r) for r in df.select(*cols).collect())))
    assert got == sorted(map(str, con.sql(f"select {', '.join(cols)} from ({queries.ORACLE_SQL[name]})").fetchall()))


# byte pairs


def test_bpe_equals_the_library_and_round_trips(spark, documents):
    from tokenizers import Tokenizer

    path = queries.vocabulary_path()
    t = Tokenizer.from_file(path)
    texts = [*ODD, "aaaaaaaaa aaaa", "<|endoftext|>x <|endoftext|>", "I'll  don't\n\n 12 3", "ÀÈ x　y", words(11, 300).upper()]
    got = {r["doc_id"]: r for r in bpe.encode_decode(documents(*texts), path).collect()}
    for i, x in enumerate(texts):
        want = t.encode(x or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == want
        assert got[i]["n_tokens"] == len(want) and got[i]["decoded"] == t.decode(want, skip_special_tokens=False)
    twice = documents("x y", "x y", ids=[1, 1]).union(documents("x y", ids=[None])).withColumn("ids", F.lit(3))
    assert [(r["doc_id"], r["n_tokens"]) for r in bpe.encode_decode(twice, path).collect()] == [(1, 2), (1, 2), (None, 2)]
    assert bpe.encode_decode(documents(), path).count() == 0


def test_bpe_equals_the_library_over_a_table(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary_path())
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in queries.op9_bpe(spark, "/root/testdata/sf0.01").collect():
        ids = t.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality", "near_duplicates", "repeated_passages", "mix", "encode"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bad = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    kept = p.quality_filter(spark, docs, SF)
    assert kept.columns == docs.columns
    left = {r["doc_id"] for r in kept.collect()}
    assert len(left & bad) <= 0.3 * len(bad) and len(left) > 0.7 * docs.count()
    out = p.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"] and {r["doc_id"] for r in out.collect()} <= left
    nothing = docs.limit(0)
    for _, stage in p.STAGES:
        nothing = stage(spark, nothing, SF)
        assert nothing.count() == 0


def test_pipeline_against_brute_force(spark):
    """Every stage's rows on its own input, by plain Python; the classifier's by its operator's scores."""
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scored = quality.score(docs, quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")))
    kept = written(p.quality_filter(spark, docs, SF), "t1")
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in scored.where("score >= 0.5").collect()}
    rows = sorted(kept.collect(), key=lambda r: r["doc_id"])
    first = {}
    for r, (cls, _) in zip(rows, brute_links([r["text"] for r in rows]), strict=True):
        first.setdefault(cls, r)
    once = written(p.near_duplicates(spark, kept, SF), "t2")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, first.values()))
    rows = once.collect()
    left = written(p.repeated_passages(spark, once, SF), "t3")
    got = {r["doc_id"]: r for r in left.collect()}
    for r, (_, gone, _, digest) in zip(rows, brute_repeats([r["text"] for r in rows], 200), strict=True):
        if gone and r["doc_id"] not in got:
            continue
        text = got[r["doc_id"]]["text"]
        assert hashlib.sha256((text or "").encode()).hexdigest() == digest or "\ufffd" in text
        assert (text == r["text"] and got[r["doc_id"]]["n_chars"] == r["n_chars"]) if not gone else (split(text) and got[r["doc_id"]]["n_chars"] == len(text))
    mixed = written(p.mix_sources(spark, left, SF), "t4")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(left).collect()}
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({k: v for k, v in copies.items() if v})
    t = Tokenizer.from_file(queries.vocabulary_path())
    text = {r["doc_id"]: r["text"] or "" for r in mixed.collect()}
    for r in p.encode(spark, mixed, SF).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == t.encode(text[r["doc_id"]], add_special_tokens=False).ids


def test_odd_ids_and_empty_tables(spark, documents):
    docs = documents("a b", "a b", "c", ids=[None, None, 3]).withColumn("score", F.lit(1)).withColumn("size", F.lit(2))
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in language_model.score(docs).collect()) == [(-1, 3), (-1, 3), (3, 2)]
    assert sorted((r["doc_id"] or -1, r["size"]) for r in mixing.mix(docs).collect()) == [(-1, 2), (-1, 2), (3, 1)]
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0
    assert sorted(r["links"] for r in ngram_join.classes(docs).collect()) == [0, 1, 1]
