"""Definitions, calls and the call graph as joins; traversals as frontier joins."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.paths import base_name, extension, family, import_candidates, import_matches, suffixes


#: Bytes of a bin of positions: a place meets the definitions of its bin, not all of its file.
BIN = 2048


def bin_of(pos: Column) -> Column:
    return F.floor(pos / BIN)


def binned(defs: DataFrame) -> DataFrame:
    """Definitions once for each bin that they cover, with _bin; empty ones hold no place."""
    bins = F.sequence(bin_of(F.col("start_byte")), bin_of(F.col("end_byte") - 1))
    return defs.where("start_byte < end_byte").withColumn("_bin", F.explode(bins))


def enclosing_definition(calls: DataFrame, defs: DataFrame) -> DataFrame:
    """calls (file, pos, callee, qualifier) with caller: the shortest definition around pos, the first of equals, or null.

    A null file or position has no caller; calls alike in all four columns count once; no calls give no rows."""
    places = calls.select("file", "pos", "callee", "qualifier", bin_of(F.col("pos")).alias("_bin")).alias("c")
    inside = (F.col("c.file") == F.col("d.file")) & (F.col("c._bin") == F.col("d._bin")) & (F.col("d.start_byte") <= F.col("c.pos")) & (F.col("c.pos") < F.col("d.end_byte"))
    best = F.min_by("d.name", F.struct(F.col("d.end_byte") - F.col("d.start_byte"), F.col("d.start_byte"), F.col("d.name")))
    # One row a call: its columns are its key. The bin follows from pos, and with it groups lie where the join left them.
    return places.join(binned(defs).alias("d"), inside, "left").groupBy("c.file", "c._bin", "c.pos", "c.callee", "c.qualifier").agg(best.alias("caller")).drop("_bin")


def first_definitions(defs: DataFrame, *key: Column | str) -> DataFrame:
    """The first definition of each key, by (file, start_byte, name)."""
    first = F.min(F.struct("file", "start_byte", "name", "end_byte", "kind")).alias("_d")
    return defs.groupBy(*key).agg(first)


def resolve_same_file(calls: DataFrame, defs: DataFrame) -> DataFrame:
    """calls with target_file: their own, if it defines the callee; else null."""
    here = defs.select("file", F.col("name").alias("callee")).distinct().withColumn("target_file", F.col("file"))
    return calls.join(here, ["file", "callee"], "left")


def file_suffixes(files: DataFrame) -> DataFrame:
    """(pattern, target): every suffix of whole components of each file."""
    return files.select(F.col("file").alias("target"), F.explode(suffixes(F.col("file"))).alias("pattern")).distinct()


def resolve_imports(calls: DataFrame, imports: DataFrame, defs: DataFrame) -> DataFrame:
    """Calls that an import of their file leads to: file, pos, callee, qualifier, target_file; first by import, candidate, file."""
    ext = extension(F.col("file"))
    candidates = imports.select("file", "import_pos", "module_path", ext.alias("_ext"), F.posexplode(import_candidates(F.col("module_path"), ext)).alias("_rank", "pattern"))
    targets = file_suffixes(defs.select("file").distinct())
    # Imports, then files, then definitions: each step is an equi join, and pairs of keys are made distinct before calls join.
    reached = candidates.join(targets, "pattern").join(defs.select(F.col("file").alias("target"), F.col("name").alias("callee")).distinct(), "target")
    reached = reached.where(import_matches(F.col("module_path"), F.col("callee"), F.col("_ext")))
    best = reached.groupBy("file", "callee").agg(F.min(F.struct("import_pos", "_rank", "target")).alias("_b"))
    return calls.join(best, ["file", "callee"]).select("file", "pos", "callee", "qualifier", F.col("_b.target").alias("target_file"))


def resolve_global(calls: DataFrame, defs: DataFrame) -> DataFrame:
    """calls with target_file: the first file of their family of languages that defines the callee; else null."""
    first = first_definitions(defs.withColumn("_family", family(extension(F.col("file")))), "name", "_family")
    first = first.select(F.col("name").alias("callee"), "_family", F.col("_d.file").alias("target_file"))
    return calls.withColumn("_family", family(extension(F.col("file")))).join(first, ["callee", "_family"], "left").drop("_family")


def resolve_names(calls: DataFrame, imports: DataFrame, defs: DataFrame, strict: bool = False) -> DataFrame:
    """(file, callee, target_file) of the names that calls (file, callee) use and that resolve: same file, then imports,
    then (unless strict) anywhere in the family. Resolution depends on these two alone, so each pair is resolved once,
    and later steps see only what earlier ones left."""
    none = F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("qualifier")
    names = calls.select("file", "callee").distinct().select("file", none[0], "callee", none[1])
    here = resolve_same_file(names, defs)
    found = here.where("target_file is not null").select("file", "callee", "target_file")
    left = here.where("target_file is null").select("file", "pos", "callee", "qualifier")
    by_import = resolve_imports(left, imports, defs).select("file", "callee", "target_file")
    found = found.union(by_import)
    if not strict:
        rest = left.join(by_import, ["file", "callee"], "left_anti")
        found = found.union(resolve_global(rest, defs).where("target_file is not null").select("file", "callee", "target_file"))
    return found


def resolve(calls: DataFrame, imports: DataFrame, defs: DataFrame, strict: bool = False) -> DataFrame:
    """calls with target_file, null where nothing resolves."""
    found = resolve_names(calls, imports, defs, strict)
    return calls.join(found, ["file", "callee"], "left").select("file", "pos", "callee", "qualifier", "target_file")


def same_call(a: DataFrame, b: DataFrame, key: Sequence[str]) -> Column:
    """Equal keys, where nulls equal nulls."""
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in key])


CALL = ("file", "pos", "callee", "qualifier")


def call_edges(calls: DataFrame, imports: DataFrame, defs: DataFrame, strict: bool = False, resolved: DataFrame | None = None) -> DataFrame:
    """src and dst nodes 'file:name' of resolved calls inside definitions; no loops, no repeats.

    resolved (file, pos, callee, qualifier, target_file, target_name): calls resolved elsewhere, as by a language server.
    They lead to that definition, or nowhere if there is none: names are not tried for them. Of several rows of a call the
    least counts."""
    pairs = []
    if resolved is None:
        inside = enclosing_definition(calls.select("file", "pos", "callee", F.lit(None).cast("string").alias("qualifier")), defs).where("caller is not null")
        called = checkpointed(inside.select("file", "caller", "callee").distinct())
    else:
        inside = enclosing_definition(calls, defs).where("caller is not null")
        told = resolved.groupBy(*CALL).agg(F.min(F.struct("target_file", "target_name")).alias("_t"))
        known = inside.join(told, same_call(inside, told, CALL), "left").select(inside["file"], "caller", F.when(F.col("_t").isNull(), inside["callee"]).alias("callee"), F.col("_t").isNotNull().alias("_told"), "_t.*")
        known = checkpointed(known.distinct())
        indexed = defs.select(F.col("file").alias("target_file"), F.col("name").alias("target_name")).distinct()
        pairs.append(known.where("_told").join(indexed, ["target_file", "target_name"]).select("file", "caller", "target_file", "target_name"))
        called = known.where("NOT _told").select("file", "caller", "callee")
    # what calls come down to is far smaller than they are: it is kept, and names are resolved from it
    pairs.append(called.join(resolve_names(called, imports, defs, strict), ["file", "callee"]).select("file", "caller", "target_file", F.col("callee").alias("target_name")))
    edges = reduce(DataFrame.union, pairs).select(F.concat_ws(":", "file", "caller").alias("src"), F.concat_ws(":", "target_file", "target_name").alias("dst"))
    return edges.where("src <> dst").distinct()


QUESTION = ("callee", "qualifier", "ext")


def representatives(calls: DataFrame) -> DataFrame:
    """One call for each callee, qualifier and extension, the first by file and position, with the number of calls n."""
    keyed = calls.select(*CALL, extension(F.col("file")).alias("ext"))
    return keyed.groupBy(*QUESTION).agg(F.min(F.struct("file", "pos")).alias("_c"), F.count(F.lit(1)).alias("n")).select("_c.*", *QUESTION, "n")


def fan_out(calls: DataFrame, answers: DataFrame) -> DataFrame:
    """calls (file, pos, callee, qualifier) with target_file and target_name of the answer that their representative got; nulls
    where it got none. answers: a row of these six columns for each representative that resolved. Null qualifiers are alike."""
    asked, told = representatives(calls), answers.groupBy(*CALL).agg(F.min(F.struct("target_file", "target_name")).alias("_t"))
    known = asked.join(told, same_call(asked, told, CALL)).select(*[asked[k] for k in QUESTION], "_t")
    keyed = calls.select(*CALL, extension(F.col("file")).alias("ext"))
    return keyed.join(known, same_call(keyed, known, QUESTION), "left").select(*[keyed[k] for k in CALL], F.col("_t.target_file").alias("target_file"), F.col("_t.target_name").alias("target_name"))


def nodes(defs: DataFrame) -> DataFrame:
    return defs.select(F.concat_ws(":", "file", "name").alias("node")).distinct()


def to_depth(edges: DataFrame, start: DataFrame, most: int, reverse: bool = False, keep=None) -> DataFrame:
    """(node, depth) of nodes at most `most` steps away, the start at 0; a frontier join a step.

    `keep` cuts the lineage of the edges and of each step (a checkpoint by default); steps end when nothing new is reached."""
    keep = keep or checkpointed
    a, b = ("dst", "src") if reverse else ("src", "dst")
    seen = start.select("node", F.lit(0).alias("depth"))
    if most > 0:
        step = edges.select(F.col(a).alias("_from"), F.col(b).alias("node"))
        step = keep(step) if most > 1 else step
        frontier = start.select("node")
    for d in range(1, most + 1):
        frontier = step.join(frontier.select(F.col("node").alias("_from")), "_from").select("node").distinct().join(seen.select("node"), "node", "left_anti")
        if d < most:
            frontier = keep(frontier)
        seen = seen.union(frontier.select("node", F.lit(d).alias("depth")))
        if d < most and frontier.isEmpty():
            break
    return seen


def transitive(edges: DataFrame, start: DataFrame, reverse: bool = False, keep=None) -> DataFrame:
    """All nodes reached from `start` by at least one step; the start itself only if it lies on a cycle.

    `keep` cuts the lineage of each round (a checkpoint by default); rounds end when nothing new is reached."""
    keep = keep or checkpointed
    a, b = ("dst", "src") if reverse else ("src", "dst")
    step = keep(edges.select(F.col(a).alias("_from"), F.col(b).alias("node")))
    frontier = keep(step.join(start.select(F.col("node").alias("_from")), "_from").select("node").distinct())
    seen = frontier
    while not frontier.isEmpty():
        frontier = keep(step.join(frontier.withColumnRenamed("node", "_from"), "_from").select("node").distinct().join(seen, "node", "left_anti"))
        seen = keep(seen.union(frontier))
    return seen


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut off from its plan, in the folder that spark.checkpoint.dir names; in local mode in one of our own if that is unset."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir isn't set: it names the folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="corvane-"))
    return df.checkpoint()


def post_order(spark: SparkSession, edges: DataFrame, start: str) -> DataFrame:
    """A depth-first post-order of what start reaches, start last, siblings by name: (ord, node).

    The reachable part is found by joins; only its edges come to the driver, which a call graph of one entry bounds."""
    reached = transitive(edges, spark.createDataFrame([(start,)], "node string"))
    near = edges.join(reached.union(spark.createDataFrame([(start,)], "node string")).distinct().withColumnRenamed("node", "src"), "src", "left_semi")
    calls: dict[str, list[str]] = {}
    for r in near.orderBy("src", "dst").collect():
        calls.setdefault(r["src"], []).append(r["dst"])
    out, seen, stack = [], {start}, [(start, iter(calls.get(start, [])))]
    while stack:
        node, rest = stack[-1]
        for n in rest:
            if n not in seen:
                seen.add(n)
                stack.append((n, iter(calls.get(n, []))))
                break
        else:
            out.append(node)
            stack.pop()
    return spark.createDataFrame(list(enumerate(out)), "ord int, node string")


def roots(all_nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return all_nodes.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")


def leaves(all_nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return all_nodes.join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti")


def adjacency_sets(edges: DataFrame, all_nodes: DataFrame | None = None) -> DataFrame:
    """node, callees, callers: the sets of its neighbours both ways, as sorted arrays, of all ends of edges and of all_nodes (node).

    Loops, and edges without one of their ends, are dropped; repeats of edges and of nodes count once; a node without edges has
    two empty sets."""
    way = lambda node, callee, caller: F.struct(node.alias("node"), callee.alias("callee"), caller.alias("caller"))
    src, dst, none = F.col("src"), F.col("dst"), F.lit(None).cast("string")
    ends = edges.where("src <> dst").select(F.explode(F.array(way(src, dst, none), way(dst, none, src))).alias("_e")).select("_e.*")
    if all_nodes is not None:
        ends = ends.union(all_nodes.select("node", none, none))
    return ends.groupBy("node").agg(F.array_sort(F.collect_set("callee")).alias("callees"), F.array_sort(F.collect_set("caller")).alias("callers"))


def adjacency(edges: DataFrame) -> DataFrame:
    """node, callees, callers as counts of distinct neighbours."""
    return adjacency_sets(edges).select("node", F.size("callees").cast("long").alias("n_callees"), F.size("callers").cast("long").alias("n_callers"))


def by_name(defs: DataFrame) -> DataFrame:
    """The first definition of each bare name."""
    w = Window.partitionBy("name").orderBy("file", "start_byte")
    return defs.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("name", "file", "start_byte")


def find_nodes(targets: DataFrame, defs: DataFrame) -> DataFrame:
    """targets (file, func) with node: the definition in that file or, without a file, the first of that name; null if there is none."""
    exact = nodes_by(defs).select("file", F.col("name").alias("func"), F.concat_ws(":", "file", "name").alias("node"))
    first = by_name(defs).select(F.col("name").alias("func"), F.concat_ws(":", "file", "name").alias("node"))
    with_file = targets.where("file is not null").join(exact, ["file", "func"], "left")
    without = targets.where("file is null").join(first, "func", "left").select("file", "func", "node")
    return with_file.select("file", "func", "node").union(without)


def nodes_by(defs: DataFrame) -> DataFrame:
    """The first definition of each (file, name), with its other columns."""
    others = [c for c in defs.columns if c not in ("file", "name")]
    order = ["start_byte", "end_byte", *[c for c in others if c not in ("start_byte", "end_byte")]]
    return defs.groupBy("file", "name").agg(F.min(F.struct(*order)).alias("_d")).select("file", "name", *[F.col("_d")[c].alias(c) for c in others])


def definitions_to_depth(edges: DataFrame, start: DataFrame, defs: DataFrame, most: int, reverse: bool = False) -> DataFrame:
    """The first definition of every node at most `most` steps away, with its node and depth."""
    there = to_depth(edges, start, most, reverse)
    return there.join(nodes_by(defs).withColumn("node", F.concat_ws(":", "file", "name")), "node")
