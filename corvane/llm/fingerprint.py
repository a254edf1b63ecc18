"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A document's terms are its words, weighted by their counts. For each of SAMPLES draws a term has, from its hash, r and c
from Gamma(2, 1) and b uniform; with weight w, t = floor(ln w / r + b) and a = c exp(-r (t - b + 1)). The draw's sample is
the term of least a, with its t; two documents draw the same sample with a chance equal to the generalised Jaccard
similarity of their weights, sum of minima over sum of maxima. As a follows from term and t, 32 bits of the least a's hash
stand for the sample.

Drawn are four exponential numbers, sums of two being gamma numbers: r = e1 + e2 and c = e3 + e4. As b = e2 / r is uniform
and independent of r, t = floor((ln w + e2) / r) and a = c exp(-e1) exp(-r t), and a term of weight 1 has t = 0.
Logarithms are to base 2, which scales r and c alike.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import written

SAMPLES = 60
#: Draws that the generated code makes at once: few enough for the JVM to compile it.
BLOCK = 3
#: Rows of a range of doc_ids whose texts a task orders together, and the most ranges there are.
RANGE_ROWS, MOST_RANGES = 2000, 1 << 15


def _horner(coefficients: tuple[float, ...], x: str) -> str:
    """SQL of a polynomial, constant term first."""
    out = f"{coefficients[-1]!r}D"
    for c in coefficients[-2::-1]:
        out = f"({out} * {x} + {c!r}D)"
    return out


def _fitted(f, degree: int = 4) -> tuple[float, ...]:
    """Coefficients of a polynomial close to f on (0, 1): interpolation in Chebyshev points."""
    x = (np.cos(np.pi * (np.arange(degree + 1) + 0.5) / (degree + 1)) + 1) / 2
    return tuple(float(c) for c in np.linalg.solve(np.vander(x, increasing=True), f(x)))


#: -log2(1 - z / 2) / z and 2**-z.
_LOG, _EXP = _fitted(lambda z: -np.log2(1 - z / 2) / z), _fitted(lambda z: 2.0**-z)


def _draw(i: int) -> tuple[list[dict[str, str]], str]:
    """SQL of draw i, layer by layer, and of its a, from the hash _h of term and block; _lw is the logarithm of the weight.

    -log2 of a uniform number is a geometric number, the trailing zeros of some bits, plus -log2(1 - z / 2); so no logarithm
    is taken. One hash has 12 bits of zeros and 12 of z for e1 and 8 and 12 for each of e3 and e4; terms of a weight above 1
    have another, with 24 and 32 for e2."""
    h = f"_g{i}"
    bits = {}
    for k, at, zeros, z_at, z_bits in ((1, 0, 12, 12, 12), (3, 24, 8, 32, 12), (4, 44, 8, 52, 12)):
        field = f"(({h} >>> {at}) | {1 << zeros}L)"
        bits[f"_m{k}_{i}"] = f"({field} - 1L) & ~{field}"  # as many ones as there are trailing zeros
        bits[f"_z{k}_{i}"] = f"((({h} >>> {z_at}) & {(1 << z_bits) - 1}L) + 0.5D) * {2.0**-z_bits!r}D"
    e = {k: f"bit_count(_m{k}_{i}) + _z{k}_{i} * {_horner(_LOG, f'_z{k}_{i}')}" for k in (1, 3, 4)}
    other = f"(xxhash64({h}) | 16777216L)"
    z = f"((({other} >>> 32) + 0.5D) * {2.0**-32!r}D)"
    numbers = {
        f"_c{i}": f"({e[3]} + {e[4]}) * (1D - 0.5D * _z1_{i}) / (_m1_{i} + 1D)",  # c exp(-e1)
        f"_a{i}": f"case when _lw > 0D then {e[1]} else 1D end",
        f"_b{i}": f"case when _lw > 0D then bit_count(({other} - 1L) & ~{other}) + {z} * {_horner(_LOG, z)} else 0D end",
    }
    x = {f"_x{i}": f"case when _lw > 0D then (_a{i} + _b{i}) * floor((_lw + _b{i}) / (_a{i} + _b{i})) else 0D end"}
    shrunk = f"_c{i} * {_horner(_EXP, f'(_x{i} - floor(_x{i}))')} / shiftleft(1L, cast(floor(_x{i}) as int))"
    return [bits, numbers, x], f"case when _x{i} > 0D then {shrunk} else _c{i} end"


def signatures(texts: DataFrame, text: str, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys, _block and _s, the least a of each draw of the block; no rows for a text without words. keys tell rows apart."""
    if samples % BLOCK:
        raise ValueError(f"samples must be a multiple of {BLOCK}")
    each = texts.select(*keys, F.explode(F.split(F.lower(F.col(text)), r"[\x20\x09-\x0D]+")).alias("_word")).where("_word <> ''")
    terms = each.select(*keys, F.xxhash64("_word").alias("_t")).groupBy(*keys, "_t").agg(F.count(F.lit(1)).alias("_w"))
    terms = terms.select(*keys, "_t", F.when(F.col("_w") > 1, F.log2("_w")).otherwise(0.0).alias("_lw"))
    now = terms.select(*keys, "_t", "_lw", F.explode(F.sequence(F.lit(0), F.lit(samples // BLOCK - 1))).alias("_block"))
    now = now.select(*keys, "_block", "_lw", F.xxhash64("_t", "_block").alias("_h"))
    now = now.select(*keys, "_block", "_lw", *[F.xxhash64("_h", F.lit(i)).alias(f"_g{i}") for i in range(BLOCK)])
    draws = [_draw(i) for i in range(BLOCK)]
    for k in range(3):
        now = now.withColumns({n: F.expr(e) for d in draws for n, e in d[0][k].items()})
    return now.groupBy(*keys, "_block").agg(*[F.min(F.expr(d[1])).alias(f"_s{i}") for i, d in enumerate(draws)])


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples; 1 for two texts without words, 0 if one has none."""
    equal = sum((F.when(F.get(a, F.lit(i)) == F.get(b, F.lit(i)), 1).otherwise(0) for i in range(samples)), F.lit(0))
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(equal / F.lit(float(samples)))


def as_text(sig: Column) -> Column:
    """8 hexadecimal digits of each sample; '' for a text without words."""
    return F.coalesce(F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), ""), F.lit(""))


def _ranges(rows: DataFrame) -> DataFrame:
    """rows (doc_id, _text) with _range, which ascends with doc_id: quantiles of the ids, found by binary search, then the
    null ids by the hash of their texts; and the columns that order rows within a range."""
    n, nulls = rows.agg(F.count("doc_id"), F.count(F.when(F.col("doc_id").isNull(), 1))).first()
    parts = [max(1, min(MOST_RANGES, k // RANGE_ROWS)) for k in (n, nulls)]
    bounds = rows.agg(F.percentile_approx("doc_id", [k / parts[0] for k in range(1, parts[0])], 20 * parts[0])).first()[0] if parts[0] > 1 else []
    bounds = sorted(set(bounds))
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    if bounds:
        edges = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<long>")  # folded to one literal
        below = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: at + F.when(F.get(edges, at + s - 1) < F.col("doc_id"), s).otherwise(0))
    else:
        below = F.lit(0)
    hashed = F.xxhash64("_text")
    tail = len(bounds) + 1 + F.floor((F.call_function("shiftrightunsigned", hashed, F.lit(1)) / F.lit(2.0**63)) * parts[1]).cast("int")
    place = F.when(F.col("doc_id").isNull(), tail).otherwise(below)
    unsigned = F.call_function("shiftrightunsigned", hashed, F.lit(1))
    return rows.select(place.cast("int").alias("_range"), F.col("doc_id").isNull().alias("_no_id"), "doc_id", unsigned.alias("_th"), "_text")


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs (doc_id, text).

    The edited text has the last half of its code points replaced by as many of the first of the next row's
    text (or all), rows in ascending order of doc_id, null ids last and equal ids by a hash of their texts;
    after the last comes the first. A null text counts as empty. Equal texts have equal fingerprints; repeated
    rows follow each other. One row is its own next. Other columns are ignored; an empty table gives no rows.
    """
    rows = _ranges(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_text")))
    within = Window.partitionBy("_range").orderBy("_no_id", "doc_id", "_th")
    ahead = Window.orderBy("_range")

    def with_next(df: DataFrame, heads: DataFrame, value: str, into: str) -> DataFrame:
        """The value of the next row: the next of the range, or the first (heads: _range, value) of the next range that has rows."""
        # One row a range, without texts, so that one task can order them.
        then = heads.select("_range").select("_range", F.lead("_range").over(ahead).alias("_then"), F.first("_range").over(ahead.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_least"))
        then = then.select("_range", F.coalesce("_then", "_least").alias("_then"))
        nexts = then.join(heads.select(F.col("_range").alias("_then"), F.col(value).alias("_head")), "_then").select("_range", "_head")
        # merged, so that rows stay where they are: by their range
        return df.join(nexts.hint("merge"), "_range").withColumn(into, F.when(F.col("_is_last"), F.col("_head")).otherwise(F.col("_led"))).drop("_is_last", "_led", "_head")

    placed = rows.select("_range", "doc_id", "_text", F.row_number().over(within).alias("_row"), F.lead("_text").over(within).alias("_led"), F.lead(F.lit(False), 1, True).over(within).alias("_is_last"))
    heads = rows.withColumn("_row", F.row_number().over(within)).where("_row = 1").select("_range", "_text")
    pair = with_next(placed, heads, "_text", "_next")
    half = F.floor(F.length("_text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), F.length("_text") - half), F.substring(F.col("_next"), F.lit(1), half))
    pair = pair.select("_range", "_row", "doc_id", "_text", edited.alias("_edited"))
    keys = ["_range", "_row", "_kind"]
    both = pair.select("_range", "_row", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("_text").alias("t")), F.struct(F.lit(1).alias("k"), F.col("_edited").alias("t")))).alias("_x"))
    drawn = signatures(both.select("_range", "_row", F.col("_x.k").alias("_kind"), F.col("_x.t").alias("_t")), "_t", keys, samples)
    # A sample is told by 32 bits from here on. What isn't drawn stands beside the draws as a row of kind 2.
    drawn = drawn.select(*keys, "_block", F.array(*[F.hash(f"_s{i}") for i in range(BLOCK)]).alias("_s"), F.lit(None).cast("struct<doc_id: bigint, n_chars: bigint, edited_sha256: string>").alias("_about"))
    about = pair.select("_range", "_row", F.lit(2).alias("_kind"), F.lit(0).alias("_block"), F.lit(None).cast("array<int>").alias("_s"), F.struct("doc_id", F.length("_text").cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256")).alias("_about"))
    parts = written(drawn.unionByName(about), "draws")

    def of(kind: int) -> Column:
        mine = F.sort_array(F.collect_list(F.when(F.col("_kind") == kind, F.struct("_block", "_s"))))
        return F.when(F.size(mine) > 0, F.flatten(F.transform(mine, lambda x: x["_s"])))

    one = parts.repartition("_range").groupBy("_range", "_row").agg(F.max("_about").alias("_about"), of(0).alias("_own"), of(1).alias("_ed"))
    one = one.select("_range", "_row", "_about.*", "_own", "_ed")
    by_row = Window.partitionBy("_range").orderBy("_row")
    led = one.select("*", F.lead("_own").over(by_row).alias("_led"), F.lead(F.lit(False), 1, True).over(by_row).alias("_is_last"))
    # Every range has a row 1; its samples alone are gathered again for the range before.
    firsts = parts.where("_row = 1").groupBy("_range").agg(of(0).alias("_own"))
    last = with_next(led, firsts, "_own", "_after")
    return last.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("_own")).alias("fingerprint"), as_text(F.col("_ed")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_ed"), samples).alias("near_edited"), likeness(F.col("_own"), F.col("_after"), samples).alias("near_next"),
    )
