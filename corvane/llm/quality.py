"""Quality classifier: a sparse ensemble of rules over text statistics, compiled into Spark columns.

Shallow boosted trees are grown on the statistics of labelled documents; every path from a root is a candidate
rule, a conjunction of comparisons; lasso logistic regression weighs the rules and drops most of them; what is
left becomes one Column, so that scoring is a plain projection.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import WORD, document_crc

#: The fit takes at most so many labelled rows, those with the smallest hashes of their ids.
FIT_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LASSO = 40, 3, 48, 0.2, 0.002


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text; a null text counts as empty, whose statistics are all 0."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(F.lower(t), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.split(t, "\n")
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("double")
    per = lambda n, d: F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))
    chars = F.length(t)
    return {
        "chars": F.log1p(chars.cast("double")),
        "upper": per(count("[A-Z]"), chars),
        "digit": per(count("[0-9]"), chars),
        "mark": per(count("[#$%&*@^~=+_\\\\/|<>{}\\[\\]]"), chars),
        "shout": per(count("[!?]"), chars),
        "stop": per(count("[.,;:]"), chars),
        "space": per(count("[\x20\x09-\x0D]"), chars),
        "line": per(F.size(lines), chars),
        "lines_kept": per(F.size(F.array_distinct(lines)), F.size(lines)),
        "words_kept": per(F.size(F.array_distinct(words)), F.size(words)),
        "words": F.log1p(F.size(words).cast("double")),
        "word_chars": per(chars, F.size(words)),
        "inner": per(count("[A-Za-z][^A-Za-z\\s.,'’\\-]+(?=\\s)"), F.size(words)),
        "link": count("://|www\\.|@[a-z]"),
    }


@dataclass(frozen=True)
class Rule:
    """All of (statistic, is above, threshold) hold."""

    parts: tuple[tuple[str, bool, float], ...]

    def matches(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, above, at in self.parts:
            out &= (x[name] > at) == above
        return out

    def column(self, prefix: str = "") -> Column:
        out = None
        for name, above, at in self.parts:
            c = F.col(prefix + name)
            c = c > F.lit(at) if above else c <= F.lit(at)
            out = c if out is None else out & c
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def tree_rules(x: dict[str, np.ndarray], y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> list[Rule]:
    """Paths of boosted trees over binned statistics. Deterministic: no row or column is sampled."""
    names = list(x)
    cuts = {n: np.unique(np.quantile(x[n], np.linspace(0, 1, bins + 1)[1:-1])) for n in names}
    binned = {n: np.searchsorted(cuts[n], x[n], "left") for n in names}
    z = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    found: dict[Rule, None] = {}

    def grow(rows: np.ndarray, path: tuple, left: int, g: np.ndarray, h: np.ndarray) -> None:
        if path:
            found.setdefault(Rule(tuple(sorted(path))))
        best = (1e-3, None, 0)
        if left and len(rows) >= 20:
            gs, hs = g[rows].sum(), h[rows].sum()
            for n in names:
                b, k = binned[n][rows], len(cuts[n]) + 1
                cg = np.cumsum(np.bincount(b, g[rows], k))[:-1]
                ch = np.cumsum(np.bincount(b, h[rows], k))[:-1]
                cn = np.cumsum(np.bincount(b, minlength=k))[:-1]
                gain = cg**2 / (ch + 1) + (gs - cg) ** 2 / (hs - ch + 1) - gs**2 / (hs + 1)
                gain[(cn < 5) | (len(rows) - cn < 5)] = -1
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), n, int(gain.argmax()))
        if best[1] is None:
            z[rows] += RATE * g[rows].sum() / (h[rows].sum() + 1)
            return
        _, n, k = best
        low = binned[n][rows] <= k
        grow(rows[low], (*path, (n, False, float(cuts[n][k]))), left - 1, g, h)
        grow(rows[~low], (*path, (n, True, float(cuts[n][k]))), left - 1, g, h)

    for _ in range(trees):
        p = _sigmoid(z)
        grow(np.arange(len(y)), (), depth, y - p, p * (1 - p))
    return list(found)


def lasso_logistic(m: np.ndarray, y: np.ndarray, penalty: float = LASSO, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights of lasso logistic regression by accelerated proximal gradient."""
    a = np.column_stack([np.ones(len(y)), m])
    v = np.ones(a.shape[1])
    for _ in range(30):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    step = 4 * len(y) / max(1e-9, np.linalg.norm(a.T @ (a @ v)))
    w = np.zeros(a.shape[1])
    w[0] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    u, t = w.copy(), 1.0
    for _ in range(steps):
        new = u - step * (a.T @ (_sigmoid(a @ u) - y)) / len(y)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return float(w[0]), w[1:]


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self, prefix: str = "") -> Column:
        z = F.lit(self.intercept)
        for rule, w in self.rules:
            z = z + F.when(rule.column(prefix), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def labelled(docs: DataFrame, labels: DataFrame, label: str, remainder: int, modulus: int, most: int, columns: dict[str, Column]) -> DataFrame:
    """(doc_id, _y, columns computed from text) of at most `most` labelled documents whose crc32 of the id isn't `remainder` mod
    `modulus`: those with the smallest hashes. Rows without a label, id or match are left out."""
    fold = document_crc() % modulus != remainder
    order = F.md5(F.col("doc_id").cast("string"))
    few = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & fold).groupBy("doc_id").agg(F.max(label).alias("_y"))
    few = few.orderBy(order, "doc_id").limit(most)
    # Bounded by `most` rows, so it may be broadcast; the second limit bounds repeated ids.
    found = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").withColumn("_o", order).withColumn("_t", F.md5("text"))
    return found.select("doc_id", "_y", *[c.alias(n) for n, c in columns.items()], "_o", "_t").orderBy("_o", "doc_id", "_t").limit(most).drop("_o", "_t")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", remainder: int = 2, modulus: int = 4, most: int = FIT_ROWS) -> RuleEnsemble:
    """The ensemble for labels outside one fold. With no labelled rows, as from empty tables, or one class it is the constant
    rate. Rows of a null id or label teach nothing; of several labels of an id the largest counts; null texts are empty;
    repeated rows count each; other columns are ignored."""
    got = labelled(docs, labels, label, remainder, modulus, most, statistics(F.col("text"))).drop("doc_id").toPandas()
    y = got.pop("_y").to_numpy(float)
    x = {n: got[n].to_numpy(float) for n in got}
    if len(y) == 0 or y.min() == y.max():
        rate = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return RuleEnsemble(float(np.log(rate / (1 - rate))), ())
    rules = tree_rules(x, y)
    m = np.column_stack([r.matches(x) for r in rules]).astype(float)
    b, w = lasso_logistic(m, y)
    return RuleEnsemble(b, tuple((r, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-4))


def score(docs: DataFrame, model: RuleEnsemble, into: str = "score", text: str = "text") -> DataFrame:
    """docs with a column `into` from 0 to 1. Null and empty texts are scored by their statistics, all 0;
    every other column is kept, whatever its name; repeated rows stay."""
    stats = {f"_cv_{n}": c for n, c in statistics(F.col(text)).items()}
    return docs.withColumns(stats).withColumn(into, model.column("_cv_")).drop(*stats)
