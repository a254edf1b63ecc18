"""Clustering, packing and alignment against plain Python."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
from conftest_llm import ODD, words
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import alignment, clustering, merges, packing
from corvane.llm.bpe import PRE_SPLIT, byte_letters
from corvane.llm.queries import PIECE_MODEL, VOCABULARY, WORD_VOCABULARY, vocabulary_path

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("cluster", T.StringType())])
HARD = [*ODD, " lead  two ", "a\n\n b\n \nc ", "x\x00y", "don't <|endoftext|> we'LL", "ΑΣ é é ̈x ﬁ", "İ ŒUVRE", "-" * 3000, "a\x1c b\x85 c　 d", "½² ªº µ ×÷ É", "u ▁ v", "end\n"]


# --- clustering


def plain_clusters(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    seed = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    c = [v for _, v in sorted(kept, key=lambda r: (seed(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), j) for j, w in enumerate(c))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        c = [[sum(col) // len(col) for col in zip(*own, strict=True)] if (own := [v for (_, v), a in zip(kept, at, strict=True) if a == j]) else c[j] for j in range(len(c))]
    found = [(i, *near(v)) for i, v in kept]
    each, every = collections.Counter(), sum(d for _, d, _ in found)
    for _, d, j in found:
        each[j] += d
    sha = [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in c]
    return sorted(((i, j, d, each[j], every, sha[j]) for i, d, j in found), key=str)


def clustered(spark, rows):
    got = clustering.cluster(spark.createDataFrame([(i, v, "clash") for i, v in rows], VECTORS)).drop("computed").collect()
    return sorted(map(tuple, got), key=str)


def test_clusters_equal_plain_rounds_with_odd_rows(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=64).tolist()) for i in range(150)]
    rows += [(7, rows[7][1]), (None, rows[9][1]), (200, None), (201, [1.0] * 63), (202, [float("nan")] * 64), (203, [1.0] * 63 + [None]), (204, [0.0] * 64), (205, [float("inf")] * 64)]
    assert clustered(spark, rows) == plain_clusters(rows)


def test_clusters_of_ties_and_few_vectors(spark):
    grid = [(i, [float((i >> b) & 1) for b in range(4)] * 16) for i in range(16)]
    rows = [(j * 16 + i, [x / 2 for x in v]) for j in range(4) for i, v in grid] + [(900 + i, [0.25] * 64) for i in range(9)]
    assert clustered(spark, rows) == plain_clusters(rows)
    assert clustered(spark, rows[:3]) == plain_clusters(rows[:3])
    assert clustered(spark, [(5, rows[0][1])] * 40) == plain_clusters([(5, rows[0][1])] * 40)
    assert clustered(spark, []) == []


def test_bounds_spare_distances_and_hold():
    r = np.random.default_rng(5)
    centres = r.integers(-400, 400, (16, 64))
    x = centres[r.integers(0, 16, 3000)] + r.integers(-9, 9, (3000, 64))
    c = clustering.Centroids(centres)
    own, best, upper, lower, n = clustering.assign(x, c, None, None, None)
    moved = clustering.Centroids(centres + r.integers(-3, 3, centres.shape), centres)
    own, best, upper, lower, n = clustering.assign(x, moved, own, upper, lower)
    every = np.stack([clustering.squared(x, row) for row in moved.rows], axis=1)
    assert (own == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    assert (upper * upper >= best).all() and (lower * lower <= every).all() and n.mean() < 2


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        clustered(spark, [(1, [1e30] * 64)])


# --- ids of parts


@pytest.mark.parametrize("name, split, spaced", [(WORD_VOCABULARY, packing.WORD_SPLIT, False), (VOCABULARY, PRE_SPLIT, True)])
def test_part_ids_equal_the_library(name, split, spaced):
    import pyarrow as pa

    with open(vocabulary_path(name)) as f:
        made = merges.PartIds(f.read(), split, spaced, literal=spaced)
    texts = [*HARD, words(9, 400), "aaaa aaaaaaaa abababab " * 9]
    parts = merges.Parts(pa.array(texts))
    ids, edge = made.of(parts.different)
    for i, text in enumerate(texts):
        want = made.library.encode(" " * spaced + (text or ""), add_special_tokens=False).ids
        assert merges.gather(ids, edge, parts.number[parts.edge[i] : parts.edge[i + 1]])[0].tolist() == want, text


# --- packing


def whole(rows, texts_of, limits, library):
    """Checks pieces against the documents, and that no sequence breaks a limit; returns the padding."""
    by_sequence = collections.defaultdict(list)
    pieces = collections.defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
    padding = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= limits.tokens and len(own) <= limits.segments and sum(r.length - 1 for r in own) <= limits.loss
        padding += 0 if at & (at - 1) == 0 else limits.tokens - at
    for key, text in texts_of.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces.pop(key), key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert not pieces
    return padding


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(2048, 3, 2048), packing.Limits(64, 2, 40), packing.Limits(16, 16, 0)])
def test_documents_are_packed_whole_without_padding(spark, documents, limits):
    from tokenizers import Tokenizer

    texts = [t for t in HARD if t is None or len(t) < 10_000] + [words(i, 5 * i + 1) for i in range(40)]
    ids = [None, *range(1, len(texts))]
    got = packing.pack_documents(documents(*texts, ids=ids).repartition(3), vocabulary_path(WORD_VOCABULARY), limits, ids=True).collect()
    assert whole(got, dict(zip(ids, texts, strict=True)), limits, Tokenizer.from_file(vocabulary_path(WORD_VOCABULARY))) == 0
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)


def test_rows_that_repeat_and_empty_tables_are_packed(documents):
    path = vocabulary_path(WORD_VOCABULARY)
    got = packing.pack_documents(documents("a b c", "a b c", ids=[4, 4]), path).collect()
    assert sum(r.length for r in got) == 8 and {r.doc_tokens for r in got} == {4}
    assert packing.pack_documents(documents("x").where("false"), path).collect() == []


def test_examples_stay_whole_under_three_limits(spark):
    r = np.random.default_rng(1)
    rows = [(f"k{i}", int(t), int(s), int(min(t, x))) for i, (t, s, x) in enumerate(zip(r.integers(1, 900, 400), r.integers(1, 12, 400), r.integers(0, 700, 400), strict=True))]
    rows += [("big", 5000, 1, 1), ("nothing", 0, 0, 0), ("none", None, 1, 1), ("below", -1, 1, 1), ("k0", *rows[0][1:]), (None, 3, 1, 1)]
    limits = packing.Limits(2048, 16, 1024)
    df = spark.createDataFrame([(*x, "clash") for x in rows], "key string, tokens long, segments long, loss_tokens long, sequence string")
    got = packing.pack_examples(df, limits).collect()
    assert sorted(map(str, [x[:4] for x in got])) == sorted(map(str, rows))
    assert {x.key for x in got if x.sequence_id is None} == {"big", "none", "below"}
    by = collections.defaultdict(list)
    for x in got:
        if x.sequence_id is not None:
            by[x.sequence_id].append(x)
    for own in by.values():
        assert sum(x.tokens for x in own) <= 2048 and sum(x.segments for x in own) <= 16 and sum(x.loss_tokens for x in own) <= 1024
        assert len({(x.offset) for x in own if x.tokens}) == len([x for x in own if x.tokens])
    # the bound that holds for any packing, plus a sixteenth
    least = max(sum(x[i] for x in rows if x[0] not in ("big", "none", "below")) / m for i, m in ((1, 2048), (2, 16), (3, 1024)))
    assert len(by) <= least * 17 / 16 + 3 * 8  # up to a bin left open in each of 8 partitions, for each limit
    assert packing.pack_examples(df.where("false")).collect() == []


def test_the_dot_product_chooses_what_is_scarce():
    demands = np.array([[100, 1, 90], [100, 8, 10], [50, 1, 0]])
    bins = packing.pack_whole(np.repeat(demands, 6, axis=0), packing.Limits(200, 9, 100))
    for b in bins:
        assert (np.repeat(demands, 6, axis=0)[b].sum(axis=0) <= [200, 9, 100]).all()
    assert sorted(i for b in bins for i in b) == list(range(18)) and len(bins) <= 9


# --- alignment


def plain_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(vocabulary_path())
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(PIECE_MODEL))
    letters, count, found = byte_letters(), collections.Counter(), []
    for text in texts:
        given = (" " + (text or "")).encode()
        e = a_side.encode(" " + (text or ""), add_special_tokens=False)
        a = [(i, bytes(letters[c] for c in t)) for i, t in zip(e.ids, e.tokens, strict=True)]
        b = [(i, bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode()) for i in b_side.encode(text or "")]
        if not text or b"".join(x[1] for x in a) != given or b"".join(x[1] for x in b) != given:
            found.append(None)
            continue
        ends = [dict(zip(np.cumsum([len(x[1]) for x in side]).tolist(), [x[0] for x in side], strict=True)) for side in (a, b)]
        both, lo, groups, links = sorted(ends[0].keys() & ends[1].keys()), 0, [], []
        for hi in both:
            groups.append("|".join(",".join(str(s[p]) for p in range(lo + 1, hi + 1) if p in s) for s in ends))
            links.append((ends[0][hi], ends[1][hi]))
            lo = hi
        count.update(links)
        found.append((len(a), len(b), groups, links))
    most = collections.Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((f[0], f[1], len(f[2]), len(f[3]), sum(count[x] == most[x[1]] for x in f[3]), sum(count[x] for x in f[3]), hashlib.sha256(";".join(f[2]).encode()).hexdigest()))
    return out


def test_alignment_equals_brute_force(documents, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE_TEXT", 20_000)
    texts = [t for t in HARD if t is None or len(t) < 20_000] + [words(i, 300) for i in range(12)]
    df = documents(*texts, ids=[None, *range(1, len(texts))]).repartition(4)
    got = alignment.align(df, vocabulary_path(), vocabulary_path(PIECE_MODEL)).collect()
    want = plain_alignment(texts)
    assert sorted(map(str, [tuple(r) for r in got])) == sorted(str((None if i == 0 else i, *w)) for i, w in enumerate(want))


def test_alignment_in_lanes_of_repeated_rows_and_empty_tables(documents, monkeypatch):
    monkeypatch.setattr(alignment, "LANE_ROWS", 2)
    monkeypatch.setattr(alignment, "SLICES", 1)
    texts = ["the cat", "the cat", "the dog \U0001f600"] * 8
    got = alignment.align(documents(*texts, ids=[3] * 24).repartition(6), vocabulary_path(), vocabulary_path(PIECE_MODEL)).collect()
    assert sorted(tuple(r)[1:] for r in got) == sorted(plain_alignment(texts))
    assert alignment.align(documents("x").where("false"), vocabulary_path(), vocabulary_path(PIECE_MODEL)).collect() == []


# --- long words


def test_words_of_any_length_are_encoded_in_linear_time():
    import time

    from tokenizers import Tokenizer

    from corvane.llm.bpe import TokenAutomaton

    with open(vocabulary_path()) as f:
        machine = TokenAutomaton(f.read())
    library = Tokenizer.from_file(vocabulary_path())
    texts = ["-" * 40_000, "a" * 40_000, words(4, 9_000).replace(" ", ""), "=-" * 50 + "é漢" * 20_000, "x" * 97, "ab" * 48, "see " + "QUJD/9+" * 3_000 + " end"]
    began = time.perf_counter()
    got = machine.encode(texts)
    assert time.perf_counter() - began < 30
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert machine.decode(ids) == text


# --- language model


def test_scores_are_the_same_however_the_input_is_partitioned(spark):
    from corvane.llm import language_model

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first, second = ({r.doc_id: r.score for r in language_model.score(d).collect()} for d in (docs.coalesce(1), docs.repartition(40)))
    assert first == second


# --- nearest neighbours of many lists


def test_opening_of_many_lists_takes_little_memory():
    import tracemalloc

    import pyarrow as pa

    from corvane.llm import ann

    r = np.random.default_rng(0)
    lists, n = 4096, 2048
    index = ann.Index(r.normal(size=(lists, 16)), [], [0, 16])
    sent = type("Sent", (), {"value": index})
    v = r.normal(size=(n, 16))
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(list(v), pa.list_(pa.float64()))], names=["vec_id", "v"])
    group = np.arange(lists, dtype=np.int32) // 64
    tracemalloc.start()
    seen = collections.defaultdict(set)
    for b in ann._open(sent, group, np.ones(lists, np.int32), np.full(lists, 250), 0.55, 120)(iter([batch])):
        for q, code in zip(b.column("vec_id").to_pylist(), b.column("code").to_pylist(), strict=True):
            seen[q] |= set(np.frombuffer(code, np.int32).tolist())
        assert b.num_rows <= ann.OPEN_ROWS * 64
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400e6 and set(seen) == set(range(n)) and {len(x) for x in seen.values()} == {int(np.ceil(lists * 0.55))}
    best = np.argsort(-(v[:5] @ index.centroids.T), axis=1)
    assert all(set(best[q][: len(seen[q])].tolist()) == seen[q] for q in range(5))


def test_nearest_are_found_in_dense_groups_and_far_from_the_origin(spark):
    from corvane.llm import ann

    r = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    for x in (unit(unit(r.normal(size=(4, 32)))[r.integers(0, 4, 4000)] + 0.004 * r.normal(size=(4000, 32))), unit(1 + 0.05 * r.normal(size=(4000, 32))), unit(r.normal(size=(3000, 128)))):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = ann.neighbours(df, F.col("vec_id") % 20 == 0).toPandas()
        hit = 0
        for q, g in got.groupby("query_id"):
            s = x @ x[q]
            s[q] = -np.inf
            hit += len(set(np.argsort(-s)[:20].tolist()) & set(g.vec_id))
        assert len(got) == len(x) and hit / len(got) > 0.93


# --- quality


def plain_statistics(text):
    import math
    import re

    t = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t.lower()) if w]
    lines, n = t.split("\n"), len(t)
    per = lambda a, b: a / b if b else 0.0
    count = lambda p: len(re.findall(p, t))
    return {
        "chars": math.log1p(n), "upper": per(count("[A-Z]"), n), "digit": per(count("[0-9]"), n), "mark": per(count(r"[#$%&*@^~=+_\\/|<>{}\[\]]"), n), "shout": per(count("[!?]"), n),
        "stop": per(count("[.,;:]"), n), "space": per(count(r"[\x20\x09-\x0D]"), n), "line": per(len(lines), n), "lines_kept": per(len(set(lines)), len(lines)), "words_kept": per(len(set(words)), len(words)),
        "words": math.log1p(len(words)), "word_chars": per(n, len(words)), "inner": per(count(r"[A-Za-z][^A-Za-z \t\n\x0b\f\r.,'’\-]+(?=[ \t\n\x0b\f\r])"), len(words)), "link": count(r"://|www\.|@[a-z]"),
    }


def test_quality_equals_plain_python_from_the_labels_on(spark):
    """Statistics, fold, trees' rules, lasso weights and scores of a whole table, in plain Python from the labels on."""
    import math

    from corvane.llm import quality

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "quality")
    got = {r.doc_id: r.score for r in quality.score(docs.select("doc_id", "text"), quality.fit(docs, labels)).collect()}
    rows = {r.doc_id: plain_statistics(r.text) for r in docs.collect()}
    learned = sorted((r.doc_id for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.doc_id in rows), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    y = dict(map(tuple, labels.collect()))
    x = {k: np.array([rows[i][k] for i in learned], float) for k in next(iter(rows.values()))}
    target = np.array([y[i] for i in learned], float)
    rules = quality.tree_rules(x, target)
    b, w = quality.lasso_logistic(np.column_stack([[all((rows[i][n] > at) == above for n, above, at in r.parts) for i in learned] for r in rules]).astype(float), target)
    for i, s in rows.items():
        z = b + sum(v for r, v in zip(rules, w, strict=True) if abs(v) > 1e-4 and all((s[n] > at) == above for n, above, at in r.parts))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
    assert any(abs(v) > 1e-4 for v in w)
