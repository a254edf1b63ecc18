"""Toxicity scores from the nearest labelled examples by exact TF-IDF cosine of whole texts.

All terms of the examples lie in an inverted index whose examples stand in blocks of like ones; it holds the largest
weight of each term in each block. The few terms that many examples share stand in a matrix instead, and a group of
documents meets them in one product. Its largest value in a block and the maxima of the other terms bound a document's
cosines with the block's examples.
Blocks of the largest bounds are scored first, then those whose bound reaches the last of the nearest found so far, so
the neighbours are exactly the nearest. Document frequencies are those of all documents; a term that no example holds counts
for a document's norm with the idf of no document. The neighbours vote, weighted by distance; so do those found by the terms that tell the labels apart alone.
Both votes are calibrated together on the examples themselves, each left out of its own search.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import lowered, pieces, prefix_hash, range_hash, release, slices
from corvane.llm.quality import labelled

#: Examples that the index takes at most: those with the smallest hashes of their ids.
FIT_ROWS = 8_000
NEAREST, GROUP = 24, 128
#: Terms that at least this share of the examples holds are common: their weights stand in a matrix.
COMMON = 0.05
#: Examples of a block, blocks scored first, and groups of like examples that blocks are cut from.
BLOCK, FIRST, LIKE = 128, 4, 32
#: A term tells the labels apart if at least MIN_DF examples hold it and its G statistic against the label reaches MIN_G.
MIN_DF, MIN_G, MAX_TERMS = 4, 15.0, 4096

_SOLID = np.zeros(256, bool)
_SOLID[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms (runs of letters, digits and non-ASCII bytes, A-Z in lower case) and their row numbers."""
    solid = _SOLID[data]
    first = np.zeros(len(data) + 1, bool)
    first[offs] = True
    none = np.zeros(1, bool)
    starts = np.flatnonzero(solid & (~np.concatenate((none, solid[:-1])) | first[:-1]))
    ends = np.flatnonzero(solid & (~np.concatenate((solid[1:], none)) | first[1:])) + 1
    return range_hash(prefix_hash(lowered(data)), starts, ends), np.searchsorted(offs, starts, "right") - 1


def in_order(x: np.ndarray) -> np.ndarray:
    """Places of the rows of x when like ones stand together: groups by Lloyd's rounds from evenly spaced rows."""
    c = x[np.linspace(0, len(x) - 1, min(LIKE, len(x))).astype(np.int64)] if len(x) else x
    near = np.zeros(len(x), np.int64)
    for _ in range(8 if len(c) > 1 else 0):
        near = (x @ c.T - (c * c).sum(axis=1) / 2).argmax(axis=1)
        for k in range(len(c)):
            if (near == k).any():
                c[k] = x[near == k].mean(axis=0)
    place = np.empty(len(x), np.int64)
    place[np.argsort(near, kind="stable")] = np.arange(len(x))
    return place


class Index:
    """Examples by the TF-IDF weights of their terms: of all (`whole`, norms over known and unknown terms) or of some."""

    def __init__(self, n: int, vocabulary: np.ndarray, df: np.ndarray, idf: np.ndarray, unknown: float, d: np.ndarray, t: np.ndarray, tf: np.ndarray, whole: bool):
        """df: examples that hold each term; d, t, tf: rows, terms and numbers of the examples' terms."""
        self.vocabulary, self.whole, self.blocks = vocabulary, whole, -(-n // BLOCK)
        self.idf, self.unknown = idf, unknown
        w = (1 + np.log(tf)) * self.idf[t]
        w = w / np.sqrt(np.bincount(d, w * w, n))[d]
        often = np.flatnonzero(df >= max(2, COMMON * n))
        self.slot = np.full(len(vocabulary), -1)
        self.slot[often] = np.arange(len(often))
        at = self.slot[t]
        common = np.zeros((n, len(often)))
        common[d[at >= 0], at[at >= 0]] = w[at >= 0]
        place = in_order(common)
        self.row_at = np.argsort(place)  # example at each place
        self.place = place
        # weights of the common terms by place
        self.common = np.zeros((len(often), self.blocks * BLOCK))
        self.common[:, :n] = common[self.row_at].T
        # postings of the others by term and place; an entry is a term's part in a block, with its maximum
        rare = at < 0
        t, p, w = t[rare], place[d[rare]], w[rare]
        order = np.lexsort((p, t))
        t, p, self.post_w = t[order], p[order], w[order]
        self.post_at = (p % BLOCK).astype(np.int32)
        block = p // BLOCK
        self.first = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (block[1:] != block[:-1])))) if len(t) else np.zeros(0, np.int64)
        self.many = np.diff(self.first, append=len(t)).astype(np.int32)
        self.block = block[self.first].astype(np.int32)
        self.most = np.maximum.reduceat(self.post_w, self.first) if len(t) else np.zeros(0)
        self.begin = np.searchsorted(t[self.first], np.arange(len(vocabulary) + 1))

    def _common(self, t: np.ndarray, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.common))
        at = self.slot[t]
        out[at[at >= 0]] = w[at >= 0]
        return out

    def search(self, t: np.ndarray, w: np.ndarray, common: np.ndarray, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the nearest examples, nearest first, ties to smaller rows. The whole query has norm 1; t and w
        are its known terms, common what the common ones give each place."""
        rare = self.slot[t] < 0
        t, w = t[rare], w[rare]
        n = self.begin[t + 1] - self.begin[t]
        entry = np.repeat(self.begin[t] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        w = np.repeat(w, n)
        block = self.block[entry]
        common = common.reshape(self.blocks, BLOCK)
        bound = common.max(axis=1) + np.bincount(block, self.most[entry] * w, self.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        rows, sims, least, done, step = np.zeros(0, np.int64), np.zeros(0), 0.0, 0, FIRST
        slot = np.full(self.blocks, -1)
        while done < len(order) and bound[order[done]] >= least - 1e-9:
            some = order[done : done + step]
            some = some[bound[some] >= least - 1e-9]
            slot[some] = np.arange(len(some))
            mine = np.flatnonzero(slot[block] >= 0)
            first, many = self.first[entry[mine]], self.many[entry[mine]]
            post = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
            got = np.bincount(np.repeat(slot[block[mine]] * BLOCK, many) + self.post_at[post], self.post_w[post] * np.repeat(w[mine], many), len(some) * BLOCK)
            got = got + common[some].ravel()
            at = (some[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            ok = (got > 1e-12) & (at < len(self.row_at))
            if without >= 0:
                ok &= at != self.place[without]
            rows, sims = np.concatenate((rows, self.row_at[at[ok]])), np.concatenate((sims, got[ok]))
            if len(rows) > NEAREST:
                least = float(np.partition(sims, -NEAREST)[-NEAREST])
                near = sims >= least - 1e-11
                rows, sims = rows[near], sims[near]
            slot[some] = -1
            done, step = done + len(some) if len(some) == step else len(order), self.blocks
        nearest = np.lexsort((rows, -np.round(sims, 12)))[:NEAREST]
        return rows[nearest], sims[nearest]

    def found(self, h: np.ndarray, row: np.ndarray, tf: np.ndarray, rows: int, own: int | None = None):
        """(row, examples, cosines) of each row that has known terms; h, row, tf: distinct terms in order of rows.
        own: the rows are the examples from this one on, and none finds itself."""
        if not len(self.vocabulary):
            return
        t = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        known = self.vocabulary[t] == h
        w = (1 + np.log(tf)) * np.where(known, self.idf[t], self.unknown if self.whole else 0.0)
        norm = np.sqrt(np.bincount(row, w * w, rows))
        row, t, w = row[known], t[known], w[known] / norm[row[known]]
        ends = np.searchsorted(row, np.arange(rows + 1))
        some = np.unique(row)
        for lo in range(0, len(some), GROUP):
            group = [(r, t[ends[r] : ends[r + 1]], w[ends[r] : ends[r + 1]]) for r in some[lo : lo + GROUP].tolist()]
            common = np.array([self._common(a, b) for _, a, b in group]) @ self.common
            for (r, a, b), c in zip(group, common, strict=True):
                yield r, *self.search(a, b, c, -1 if own is None else own + r)


class NearestExamples(Index):
    """The fitted index; small (bounded by the words of FIT_ROWS examples), so it goes to every task."""

    def __init__(self, ids: np.ndarray, label: np.ndarray, doc: np.ndarray, term: np.ndarray, counted: tuple[int, np.ndarray] | None = None):
        """doc and term: row numbers and hashes of all terms of the examples; counted: the number of documents and, for each
        distinct term in order, of those that hold it (without it those of the examples)."""
        self.ids, self.label, self.rate = ids, label.astype(float), float(label.mean()) if len(label) else 0.0
        n = len(ids)
        vocabulary, inverse = np.unique(term, return_inverse=True)
        key, tf = np.unique(doc.astype(np.int64) * max(1, len(vocabulary)) + inverse, return_counts=True) if len(doc) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        d, t, tf = (key // max(1, len(vocabulary))).astype(np.int32), (key % max(1, len(vocabulary))).astype(np.int32), tf.astype(np.int32)
        del doc, term, inverse, key
        df = np.bincount(t, minlength=len(vocabulary)).astype(float)
        total, held = counted or (n, df)
        idf, unknown = np.log((1 + total) / (1 + held)) + 1, float(np.log(1 + total)) + 1
        super().__init__(n, vocabulary, df, idf, unknown, d, t, tf, True)
        g = self._g(df, np.bincount(t, self.label[d], len(vocabulary)), n, self.label.sum())
        keep = np.flatnonzero((df >= MIN_DF) & (g >= MIN_G))
        if len(keep) > MAX_TERMS:
            keep = np.sort(keep[np.argsort(-g[keep], kind="stable")[:MAX_TERMS]])
        old = np.full(len(vocabulary), -1)
        old[keep] = np.arange(len(keep))
        ok = old[t] >= 0
        self.telling = Index(n, vocabulary[keep], df[keep], idf[keep], unknown, d[ok], old[t[ok]], tf[ok], False)
        release()
        self._calibrate(vocabulary, t, d, tf, n)

    @staticmethod
    def _g(df, with1, n, ones):
        """G statistic of term against label."""
        out = np.zeros(len(df))
        for seen, expect in ((with1, df * ones), (df - with1, df * (n - ones)), (ones - with1, (n - df) * ones), (n - df - ones + with1, (n - df) * (n - ones))):
            with np.errstate(divide="ignore", invalid="ignore"):
                out += np.where(seen > 0, 2 * seen * np.log(seen * n / np.maximum(expect, 1e-12)), 0)
        return out

    def vote(self, rows: np.ndarray, sims: np.ndarray) -> float:
        w = sims / (0.02 + np.maximum(0, 1 - sims))
        return float((w @ self.label[rows] + 0.5 * self.rate) / (w.sum() + 0.5))

    def _votes(self, h, row, tf, rows, own=None):
        """Votes of the nearest examples and of those by telling terms, NaN and the rate where there are none; and the nearest."""
        whole, telling, nearest = np.full(rows, np.nan), np.full(rows, self.rate), {}
        for r, at, sims in self.found(h, row, tf, rows, own):
            if len(at):
                whole[r], nearest[r] = self.vote(at, sims), (at[:5], sims[:5])
        for r, at, sims in self.telling.found(h, row, tf, rows, own):
            telling[r] = self.vote(at, sims)
        return whole, telling, nearest

    def _calibrate(self, vocabulary, t, row, tf, n):
        """Logistic fit of the label on the log-odds of both left-out votes; examples without neighbours have a rate of their own."""
        whole, telling = np.full(n, np.nan), np.full(n, self.rate)
        for lo in range(0, n, GROUP):  # so that memory follows the group
            hi = min(n, lo + GROUP)
            s, e = np.searchsorted(row, (lo, hi))
            whole[lo:hi], telling[lo:hi], _ = self._votes(vocabulary[t[s:e]], row[s:e] - lo, tf[s:e], hi - lo, lo)
        bare = np.isnan(whole)
        self.bare = float((self.label[bare].sum() + self.rate) / (bare.sum() + 1)) if n else 0.0
        start = np.array([0.0, 1.0, 0.0])
        self.fit = start.copy()
        x, y = np.column_stack((_logit(whole[~bare]), _logit(telling[~bare]), np.ones((~bare).sum()))), self.label[~bare]
        if len(y) and 0 < y.sum() < len(y):
            ridge = np.array([1e-3, 1e-3, 0.0])
            for _ in range(50):
                p = 1 / (1 + np.exp(-np.clip(x @ self.fit, -30, 30)))
                move = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(ridge + 1e-9), x.T @ (p - y) + ridge * (self.fit - start))
                self.fit = self.fit - move
                if np.abs(move).max() < 1e-8:
                    break

    def score_texts(self, texts: pa.Array):
        """(score, example ids, cosines) for each text."""
        out = []
        for i, j, data, offs in slices(texts):
            got: list = [(self.bare, [], [])] * (j - i)
            h, row = terms(data, offs) if len(data) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            if len(h):
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1]))))
                whole, telling, nearest = self._votes(h[new], row[new], np.diff(new, append=len(h)), j - i)
                z = self.fit[0] * _logit(whole) + self.fit[1] * _logit(telling) + self.fit[2]
                score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                for r, (at, sims) in nearest.items():
                    got[r] = float(score[r]), self.ids[at].tolist(), np.round(sims, 9).tolist()
            out += got
        return out


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _held(sent):
    """(term number, documents that hold it) of the terms sent; -1 counts the documents."""

    def run(batches):
        release()
        vocabulary = sent.value
        n, total = np.zeros(len(vocabulary), np.int64), 0
        for batch in pieces(batches):
            total += batch.num_rows
            for _, _, data, offs in slices(batch.column("text")):
                h, row = terms(data, offs) if len(data) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                t = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1) if len(vocabulary) else np.zeros(0, np.int64)
                known = vocabulary[t] == h if len(vocabulary) else np.zeros(0, bool)
                pair = np.unique(row[: len(t)][known] * max(1, len(vocabulary)) + t[known])
                n += np.bincount(pair % max(1, len(vocabulary)), minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-1], some)).astype(np.int32)), pa.array(np.concatenate(([total], n[some])))], names=["term", "n"])

    return run


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[int, np.ndarray]:
    """The number of documents and, for each term of the sorted vocabulary (bounded by the examples), of those that hold it."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    got = docs.select("text").mapInArrow(_held(sent), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = got.column("term").to_numpy(), got.column("n").to_numpy()
    out = np.zeros(len(vocabulary))
    out[term[term >= 0]] = n[term >= 0]
    return int(n[term < 0].sum()), out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", remainder: int = 1, modulus: int = 3, most: int = FIT_ROWS) -> NearestExamples:
    """The index of the labelled documents outside one fold. It learns nothing but their words and labels, and how many of
    all documents hold each of these words.
    No labelled rows: every score is 0; labels of one class: their rate."""
    got = labelled(docs, labels, label, remainder, modulus, most, {"text": F.col("text")}).toArrow()
    texts = got.column("text").combine_chunks()
    doc, term = [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)]
    for i, _, data, offs in slices(texts):
        h, row = terms(data, offs)
        doc.append((row + i).astype(np.int32))
        term.append(h)
    ids = np.array(got.column("doc_id").to_pylist(), np.int64)
    label_of = np.array(got.column("_y").to_pylist(), np.int64)
    del got, texts
    doc, term = np.concatenate(doc), np.concatenate(term)
    model = NearestExamples(ids, label_of, doc, term, document_frequencies(docs, np.unique(term)))
    del doc, term
    release()
    return model


def score(docs: DataFrame, model: NearestExamples) -> DataFrame:
    """doc_id, score, evidence (ids of the nearest examples), cosines, for every row of docs (doc_id, text).

    Null and empty texts, and those that share no term with an example, get the rate of such examples and no evidence.
    Texts are read whole; repeated rows stay; ties between examples go to the earlier one."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        release()
        for batch in pieces(batches, most=500_000):
            got = sent.value.score_texts(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.list_(pa.int64())), pa.array([g[2] for g in got], pa.list_(pa.float64()))],
                names=["doc_id", "score", "evidence", "cosines"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, evidence array<long>, cosines array<double>")
