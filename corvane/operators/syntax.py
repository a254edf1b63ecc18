"""Definitions, calls and imports by patterns over token tables.

A file becomes a table of tokens by one regular expression of its language, inside the JVM. From a file's tokens follow
offsets, lines, bracket levels, matching brackets and the chains of names in front of a call; tokens of one
level between the same brackets are siblings. Patterns are rows too: they come from a registry file, meet the tokens that
can start them by language and first token, and are compared with the next siblings. Whatever brackets are missing,
the rest of a file still has its tokens, so broken lines cost what stands on them.

Files are shuffled by path before they become tokens, in as many partitions as their bytes ask for; tokens never are.
`facts` sends the tokens of a partition through NumPy columns (matching.py). `tokens`, `siblings` and `matches` are the same rules
as window functions and joins, for tables of tokens and for the test of `facts`. Work is linear in a file.
"""

from __future__ import annotations

import tomllib
from functools import lru_cache
from itertools import product
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators import matching

#: The registry that is used unless another file is named.
REGISTRY = str(Path(__file__).with_name("languages.toml"))
#: Siblings that a pattern can look ahead.
AHEAD = 9
#: Bytes of contents in a partition.
PART_BYTES = 500_000
OPEN, CLOSE = ("(", "[", "{"), (")", "]", "}")
START, END = "⟨", "⟩"  # what stands for the brackets around siblings
LANGUAGE = "ext string, language string, lexer string, hole string, comment string, directive string, quotes string, keywords array<string>, chain array<string>, always array<string>, first array<string>, close array<string>"
ELEMENT = "struct<texts:array<string>,kind:string,form:string,near:boolean>"
PATTERN = (
    f"language string, anchor string, rank int, what string, kind string, elements array<{ELEMENT}>, name_at int, body string, block_at int, "
    "after array<string>, not_after array<string>, only_in array<string>, head boolean, in_block boolean, declares boolean, directive string"
)
SQL_TYPES = {pa.string(): "string", pa.bool_(): "boolean", pa.int64(): "long", pa.int32(): "int"}
FACTS = ["path", "what", "name", "kind", "qualifier", "start_byte", "end_byte", "start_line", "end_line"]


def _elements(match: str) -> list[tuple[list[tuple], int]]:
    """A pattern's variants, with and without what may be missing, each with the place of its name."""
    choices = []
    for part in match.split(" "):
        optional = len(part) > 1 and part.endswith("?") and part not in ("?.",)
        part = part[:-1] if optional else part
        near, part = (True, part[1:]) if len(part) > 1 and part[0] == "~" else (False, part)
        named = False
        if part.startswith("[") and part.endswith("]") and len(part) > 2:
            one = (part[1:-1].replace("[]", "[").split("|"), None, None, near)
        elif len(part) > 2 and part[0] == part[-1] == "/":
            one = ([], None, f"^(?:{part[1:-1]})$", near)
        elif part in ("@name", "@id", "@path", "@path:name"):
            named = part != "@id"
            one = (["@s"] if part == "@path" else ["@n"], None, None, near)
        else:
            one = ([part], None, None, near)
        choices.append([(one, named)] + [None] * optional)
    found = []
    for picked in product(*choices):
        left = [p for p in picked if p]
        places = [i for i, (_, named) in enumerate(left) if named]
        if len(left) > AHEAD + 1 or not places:
            raise ValueError(f"pattern without a name, or too long: {match}")
        found.append(([one for one, _ in left], places[-1]))
    return found


@lru_cache(8)
def load(path: str = REGISTRY) -> tuple[list[tuple], list[tuple]]:
    """Rows of languages (by extension) and of patterns of a registry file; of an extension named twice the last counts."""
    with open(path, "rb") as f:
        spec = tomllib.load(f)
    defaults = spec.pop("defaults", {})
    languages, patterns = {}, []
    for name, own in spec.items():
        d = {**defaults, **spec.get(own.get("like"), {}), **own}
        directive, word = d.get("directives", ""), d["words"]
        strings = d["strings"] + d.get("characters", "")
        lexer = "|".join([*([directive] if directive else []), d["comments"], strings, r"\d[\w.]*+", rf"(?:\p{{L}}|[_$]){word}*+", r"\s++", r"=>|->|<-|::|\?\.|&\.|:=|==|!=|<=|>=|&&|\|\||\.\.\.?|(?s:.)"])
        blocks = d.get("blocks", {})
        quotes = "^(?:" + strings + ")$"
        for e in d["extensions"]:
            languages[e] = (e, name, lexer, d.get("holes", ""), f"^(?:{d['comments']})$", f"^(?:{directive})" if directive else "", quotes, d["keywords"], d["chain"], blocks.get("always", []), blocks.get("first", []), blocks.get("close", []))
        if directive:
            patterns.append((name, "@i", 0, "import", None, [(["@i"], None, None, False)], 0, None, -1, None, None, None, False, False, None, directive))
        for what, key in (("definition", "definitions"), ("call", "calls"), ("import", "imports")):
            for rank, p in enumerate(d.get(key, [])):
                for elements, name_at in _elements(p["match"]):
                    if p.get("block_at") == 0:  # what follows a word that opens a block stands in it
                        elements[0] = ([START + t for t in elements[0][0]], *elements[0][1:])
                    for anchor in elements[0][0]:
                        patterns.append((name, anchor, rank, what, p.get("kind"), elements, name_at, p.get("body"), p.get("block_at", -1), p.get("after"), p.get("not_after"), p.get("inside"), p.get("head", False), p.get("inside_block", False), p.get("declares"), directive))
    return list(languages.values()), patterns


def languages(spark: SparkSession, path: str = REGISTRY) -> DataFrame:
    """(ext, language) of what a registry file names."""
    return spark.createDataFrame([row[:2] for row in load(path)[0]], "ext string, language string")


def lexed(files: DataFrame, registry: str = REGISTRY) -> DataFrame:
    """All tokens of files (path, content) of the registry's languages, those of a file in order: path, language, _p and _q (their
    order), text, cls, and the columns of LANGUAGE. Null contents, and files of other kinds, have none.

    cls: n name, k keyword, s string, d number, i import directive, p other, w white space, c comment."""
    spark = files.sparkSession
    table = spark.createDataFrame(load(registry)[0], LANGUAGE)
    name = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    # one row a language and extension: as large as the registry file. Files of a language follow each other, as expressions
    # are compiled when they change: by the functions that keep the last one, which regexp_like doesn't.
    kept = files.where("content IS NOT NULL").select("path", "content", name.alias("ext")).join(F.broadcast(table.select("ext")), "ext", "left_semi")
    own = dealt(kept).sortWithinPartitions("ext").join(F.broadcast(table.select("ext", "lexer", "hole", "quotes")), "ext")
    like = lambda text, form: F.regexp_instr(text, form) > 0
    lex = lambda text: F.regexp_extract_all(text, F.col("lexer"), F.lit(0))
    piece = lambda text, string: F.struct(text.alias("text"), string.alias("string"))
    # A file's token rows lie in memory at once: they have no more than they need, and meet their language again later.
    holed = (F.col("hole") != "") & F.substring("_t", 1, 1).isin('"', "`", "'", "$", "<") & like(F.col("_t"), F.col("quotes")) & like(F.col("_t"), F.col("hole"))
    rows = own.select("path", "ext", "lexer", "hole", "quotes", F.posexplode(lex(F.col("content"))).alias("_p", "_t"))
    rows = rows.select("path", "ext", "_p", "_t", F.when(holed, F.struct("lexer", "hole")).alias("_h")).select("path", "ext", "_p", "_t", F.col("_h.lexer").alias("lexer"), F.col("_h.hole").alias("hole"))
    # a string with holes is cut into them and what is between; the holes are code
    parts = lambda t: F.regexp_extract_all(t, F.concat("hole", F.lit(r"|(?s:.)")), F.lit(0))
    within = lambda t: F.flatten(F.transform(parts(t), lambda p: F.when(F.length(p) > 1, F.concat(F.array(piece(F.substring(p, 1, 1), F.lit(True))), F.transform(lex(F.substring(p, 2, 2147483647)), lambda x: piece(x, F.lit(False))))).otherwise(F.array(piece(p, F.lit(True))))))
    flat = rows.select("path", "ext", "_p", F.posexplode(F.when(F.col("hole").isNotNull(), within(F.col("_t"))).otherwise(F.array(piece(F.col("_t"), F.lit(False))))).alias("_q", "_x"))
    flat = flat.join(F.broadcast(table), "ext").select("*", F.col("_x.text").alias("text"))
    text = F.col("text")
    words = F.regexp_like(text, F.lit(r"^[\p{L}_$]"))
    directed = (F.col("directive") != "") & like(text, F.col("directive"))
    cls = (
        F.when(F.col("_x.string"), "s").when(F.regexp_like(text, F.lit(r"^\s")) & ~directed, "w")
        .when(like(text, F.col("comment")), "c")
        .when(directed, "i")
        .when(~F.regexp_like(text, F.lit(r"^[\p{L}_$]\S*$")) & (F.length(text) > 1) & like(text, F.col("quotes")), "s")
        .when(words & F.regexp_like(text, F.lit("[\"']")) & like(text, F.col("quotes")), "s")
        .when(words, F.when(F.array_contains("keywords", text), "k").otherwise("n"))
        .when(F.regexp_like(text, F.lit(r"^\d")), "d").otherwise("p")
    )
    return flat.withColumn("cls", cls).drop("_x")


def tokens(files: DataFrame, registry: str = REGISTRY) -> DataFrame:
    """Tokens of files (path, content) of the registry's languages: path, language, _p and _q (their order), i, text, cls, lo, hi (bytes),
    line, end_line, indent, first (of its line), and what the language's rules say of them: opens (a block), opens_first (if it
    stands first), closes, chains; and the end of the file. Null contents, and files of other kinds, have none.

    cls as in lexed; comments and white space are left out."""
    flat, text = lexed(files, registry), F.col("text")
    whole = Window.partitionBy("path").orderBy("_p", "_q")
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    breaks = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    marked = flat.select(
        "path", "language", "_p", "_q", "text", "cls", F.array_contains("always", text).alias("opens"), F.array_contains("first", text).alias("opens_first"),
        F.array_contains("close", text).alias("closes"), F.array_contains("chain", text).alias("chains"),
    )
    placed = marked.select(
        "*", F.row_number().over(whole).cast("long").alias("i"),
        F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0)).cast("long").alias("lo"), (F.coalesce(F.sum(breaks).over(before), F.lit(0)) + 1).cast("int").alias("line"),
        breaks.alias("_breaks"), F.lag("text").over(whole).alias("_before"),
    )
    space = F.regexp_extract("_before", r"\n([ \t]*)\z", 1)
    kept = placed.withColumn("indent", F.when(F.regexp_like("_before", F.lit(r"^\s[\s\S]*$")), F.length(space)).when(F.col("_before").isNull(), 0)).where(~F.col("cls").isin("w", "c"))
    end_line = (F.col("line") + F.col("_breaks")).cast("int")
    kept = kept.select("*", (F.col("lo") + F.octet_length("text")).alias("hi"), end_line.alias("end_line"))
    return kept.select(
        "*", F.coalesce(F.col("line") > F.lag("end_line").over(whole), F.lit(True)).alias("first"), F.lag("hi").over(whole).alias("prev_hi"), F.lag("end_line").over(whole).alias("prev_line"), F.lag("text").over(whole).alias("prev_text"),
        F.max(F.struct("hi", F.col("end_line").alias("line"))).over(Window.partitionBy("path")).alias("file_end"),
    ).drop("_breaks", "_before")


def dealt(files: DataFrame) -> DataFrame:
    """files (path, content) by path, in as many partitions as their contents have PART_BYTES."""
    size = files.agg(F.sum(F.octet_length("content").cast("long"))).first()[0] or 0
    return files.repartition(size // PART_BYTES + 1, "path")


def _marked(t: DataFrame, which: Column, level: str, depth: Column) -> DataFrame:
    """Rows with their level, and with each bracket of `which` also the start or the end of the level within it (mark 1, -1)."""
    opens, closes = which & F.col("_open"), which & F.col("_close")
    marks = F.when(opens, F.array(F.lit(0), F.lit(1))).when(closes, F.array(F.lit(-1), F.lit(0))).otherwise(F.array(F.lit(0)))
    return t.select("*", F.explode(marks).alias("mark")).withColumn(level, depth - F.when(opens, 1).otherwise(0) + F.when(F.col("mark") != 0, 1).otherwise(0))


def siblings(found: DataFrame) -> DataFrame:
    """Tokens by block_level, block and level: mark (0 a token, 1 and -1 the start and the end of a level), and for each what stands around it
    among its siblings: next (AHEAD of them), prev, stop (the next block, or end of a statement or of the level), the ends of the
    expression, of the statement, of the level and of the declaration, inside and opener (what the level began with), chain_lo
    and the statement's start, and the end of the file."""
    by_file = Window.partitionBy("path").orderBy("_p", "_q")
    word = F.col("cls") == "k"
    loose = ~F.coalesce(F.col("prev_text").isin(".", "::", ":", "&."), F.lit(False))
    starts = F.col("opens") | (F.col("opens_first") & (F.col("first") | F.col("prev_text").isin("=", "(", "return")))
    bracket = F.col("cls") == "p"
    opens = (bracket & F.col("text").isin(*OPEN)) | (word & loose & starts)
    closes = (bracket & F.col("text").isin(*CLOSE)) | (word & loose & F.col("closes"))
    strong = word | F.col("text").isin("{", "}")
    t = found.withColumns({"_open": F.coalesce(opens, F.lit(False)), "_close": F.coalesce(closes, F.lit(False))}).withColumn("_strong", strong)
    # Blocks first; brackets are counted within a block, so that what isn't closed there ends with it.
    t = t.withColumn("_blocks", F.sum(F.when(F.col("_strong"), F.when(F.col("_open"), 1).when(F.col("_close"), -1).otherwise(0)).otherwise(0)).over(by_file)).drop("_p", "_q", "opens", "opens_first", "closes")
    t = _marked(t, F.col("_strong"), "block_level", F.col("_blocks"))
    in_level = Window.partitionBy("path", "block_level").orderBy("i", "mark").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("block", F.sum(F.when(F.col("mark") == 1, 1).otherwise(0)).over(in_level)).withColumnRenamed("mark", "_mark")
    weak = ~F.col("_strong") & (F.col("_mark") == 0)
    in_block = Window.partitionBy("path", "block_level", "block").orderBy("i", "_mark")
    t = t.withColumn("_brackets", F.sum(F.when(weak, F.when(F.col("_open"), 1).when(F.col("_close"), -1).otherwise(0)).otherwise(0)).over(in_block))
    # a block's own start and end stand outside whatever is left open in it
    t = _marked(t, weak, "level", F.when(F.col("_mark") == 0, F.col("_brackets")).otherwise(0)).withColumn("mark", F.col("mark") + F.col("_mark"))
    started = F.concat(F.lit(START), F.when(word, F.col("text")).otherwise(""))
    t = t.withColumns({
        "_ctx": F.when(F.col("mark") == 1, F.coalesce("prev_text", F.lit(""))),
        "_opener": F.when(F.col("mark") == 1, F.col("text")),
        "text": F.when(F.col("mark") == 1, started).when(F.col("mark") == -1, END).otherwise(F.col("text")),
        "cls": F.when(F.col("mark") == 0, F.col("cls")).otherwise("p"),
        "chains": F.col("chains") & (F.col("mark") == 0),
    }).drop("prev_text", "_blocks", "_brackets", "_open", "_strong", "_mark")
    group = ["path", "block_level", "block", "level"]
    # The way back first, as its rows are narrow; what looks ahead makes them wide, and is sorted no more.
    from_end = Window.partitionBy(*group).orderBy(F.desc("i"), F.desc("mark"))
    back = from_end.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_tok", F.struct("text", "cls", "lo", "hi", "line", "end_line", "first"))
    t = t.withColumns({"prev": F.lead("_tok").over(from_end), "_prev_chains": F.coalesce(F.lead("chains").over(from_end), F.lit(False)), "_after": F.lag("_tok").over(from_end)})
    shut = F.col("text").isin(*CLOSE) | (F.col("_close") & (F.col("mark") == 0))
    after = F.col("_after")
    mate = F.when(after["text"].isin(*CLOSE) | (after["cls"] == "k"), F.struct(after["hi"].alias("hi"), after["end_line"].alias("line")))
    at_end = lambda cond: F.last(F.when(cond, F.struct(F.col("prev_hi").alias("hi"), F.col("prev_line").alias("line"))), ignorenulls=True).over(back)
    declares = F.col("first") & F.col("text").isin("def", "class", "fun", "func", "fn", "object", "trait", "interface", "val", "var", "import", "struct", "enum", "protocol", "let", "const", "return", "function")
    goes_on = F.col("text").isin(".", "?.", "{", "(", "|", "||", "&&", "+", "=>", "=", "where") | F.coalesce(F.col("prev.text").isin("=", "=>", "->", ":", "&&", "||", "+", "(", "{"), F.lit(False))
    over = F.col("text").isin(";", END, ",") | (F.col("first") & ~shut & ~goes_on)
    linked = (
        F.col("chains") | F.col("_prev_chains") | F.col("text").isin(*CLOSE)
        | (F.col("text").isin("(", "[") & ~F.col("first") & (F.col("prev.cls").isin("n", "s") | F.col("prev.text").isin(")", "]")))
    )
    begun = F.col("prev").isNull() | F.col("prev.text").isin(";", "}", END) | F.startswith(F.col("prev.text"), F.lit(START)) | (F.col("prev.cls") == "i")
    t = t.withColumns({
        "stop": F.last(F.when(F.col("text").isin("{", ";", "}", END) | declares, F.struct("text", mate.alias("mate"))), ignorenulls=True).over(back),
        "expression": at_end(over), "statement": at_end(F.col("text").isin(";", END)), "declaration": at_end(F.col("first") & (F.col("indent") == 0) & (F.col("mark") == 0)),
        "block_end": F.last(F.when(F.col("text") == END, F.struct("hi", F.col("end_line").alias("line"))), ignorenulls=True).over(back),
        "eq_line": F.last(F.when(F.col("text").isin("=", "|"), F.col("line")), ignorenulls=True).over(back),
    }).drop("_after", "_close", "prev_hi", "prev_line")
    forth = Window.partitionBy(*group).orderBy("i", "mark")
    so_far = forth.rowsBetween(Window.unboundedPreceding, 0)
    return t.withColumns({
        "inside": F.last("_ctx", ignorenulls=True).over(so_far), "opener": F.last("_opener", ignorenulls=True).over(so_far),
        "chain_lo": F.last(F.when(~F.coalesce(linked, F.lit(False)) | F.col("prev").isNull(), F.col("lo")), ignorenulls=True).over(so_far),
        "begin": F.last(F.when(begun, F.struct("lo", "line")), ignorenulls=True).over(so_far),
        "next": F.array(*[F.lead("_tok", k).over(forth) for k in range(1, AHEAD + 1)]),
    })


def _meets(e: Column, t: Column) -> Column:
    """Whether a token is what a pattern's element asks for."""
    literal = F.array_contains(e["texts"], t["text"]) & (t["cls"] != "s")
    formed = F.regexp_like(t["text"], F.coalesce(e["form"], F.lit("^$"))) & ~F.substring(t["text"], 1, 1).isin(START, END, "{", "}", ";")
    asked = F.when(e["form"].isNotNull(), formed).otherwise(literal | F.array_contains(e["texts"], F.concat(F.lit("@"), t["cls"])))
    return F.coalesce(asked & (~e["near"] | ~t["first"]), F.lit(False))


def matches(rows: DataFrame, registry: str = REGISTRY) -> DataFrame:
    """Rows of siblings() with each pattern that begins at them: the columns of both, the patterns' names as in PATTERN."""
    table = rows.sparkSession.createDataFrame(load(registry)[1], PATTERN)
    anchored = rows.where("mark <> -1").withColumn("anchor", F.explode(F.array("text", F.concat(F.lit("@"), F.col("cls")))))
    # a few hundred rows: as many as the registry file has patterns
    met = anchored.join(F.broadcast(table), ["language", "anchor"])
    none = lambda c: F.coalesce(c, F.lit(False))
    before = lambda names: none(F.array_contains(names, F.col("prev.text"))) | none(F.array_contains(names, F.concat(F.lit("@"), F.col("prev.cls"))))
    free = F.col("first") | F.col("prev").isNull() | ~(F.col("prev.cls").isin("n", "s", "d") | F.col("prev.text").isin(")", "]", "}", ".", "::", "&.", "->"))
    declared = none(F.col("first") & (F.col("indent") == 0) & (F.col("eq_line") == F.col("line")))
    rest = F.slice("elements", 2, AHEAD)
    fits = F.forall(F.zip_with(rest, F.slice("next", F.lit(1), F.size(rest)), _meets), lambda x: x)
    return met.where(
        (~F.col("elements")[0]["near"] | ~F.col("first")) & (F.col("after").isNull() | before(F.col("after"))) & (F.col("not_after").isNull() | ~before(F.col("not_after")))
        & (F.col("only_in").isNull() | none(F.array_contains("only_in", F.col("inside")))) & (~F.col("head") | free) & (F.col("declares").isNull() | (F.col("declares") == declared))
        & (~F.col("in_block") | none(F.col("opener") == "{")) & fits
    )


def facts(files: DataFrame, registry: str = REGISTRY) -> DataFrame:
    """Definitions, calls and imports of files (path, content) as FACTS.

    A definition reaches from the pattern's first word (from the start of the statement if that is the name) to the end of its
    body, to the end of the file if that isn't closed; calls and imports are where their name or path stands. Null contents,
    and files of kinds that the registry doesn't name, give no rows; a path that is there twice is two files of that name;
    other columns are ignored."""
    languages, patterns = load(registry)
    forms = sorted({(e[2], p[0]) for p in patterns for e in p[5] if e[2] is not None})
    names = sorted({form for form, _ in forms})
    matcher = matching.Matcher(languages, patterns, names)
    starts = (F.col("_p") == 0) & (F.col("_q") == 0)
    number = F.create_map(*[F.lit(x) for k, n in enumerate(matcher.names) for x in (n, k)])
    found = lexed(files, registry).select(
        F.when(starts, F.col("path")).alias("path"), F.when(starts, number[F.col("language")]).alias("language"), "text", (F.instr(F.lit(matching.CLASSES), F.col("cls")) - 1).cast("byte").alias("cls"),
        F.when(F.col("cls") == "i", F.call_function("regexp_extract", F.col("text"), F.col("directive"), F.lit(1))).alias("way"),
        *[(F.col("language").isin([n for f, n in forms if f == form]) & F.regexp_like("text", F.lit(form))).alias(f"form{k}") for k, form in enumerate(names)],
    )
    out = found.mapInArrow(matcher, ", ".join(f"{f.name} {SQL_TYPES[f.type]}" for f in matching.FACTS))
    bare = F.regexp_replace("name", "^['\"`<]+|['\"`>]+$", "")
    return out.withColumn("name", F.when(F.col("bare"), bare).otherwise(F.col("name"))).select(*FACTS)


def table_facts(files: DataFrame, registry: str = REGISTRY) -> DataFrame:
    """What `facts` gives, by windows and joins over tables of tokens, of files with different paths."""
    rows = siblings(tokens(files, registry))
    met = matches(rows, registry)
    here = F.struct("text", "cls", "lo", "hi", "line", "end_line", "first")
    met = met.withColumn("_name", F.when(F.col("name_at") == 0, here).otherwise(F.col("next")[F.col("name_at") - 1]))
    defined = F.col("what") == "definition"
    block = F.when(F.col("stop.text") == "{", F.coalesce("stop.mate", "file_end"))
    at_block = F.get("next", F.col("block_at"))
    # an expression that is a block ends with it
    end = (
        F.when(F.col("body") == "{", block).when(F.col("body") == "=", F.coalesce("expression", "file_end")).when(F.col("body") == ";", F.coalesce("statement", "file_end"))
        .when(F.col("body") == "top", F.coalesce("declaration", "file_end")).when((F.col("body") == "end") & (F.col("block_at") == 0), F.coalesce("block_end", "file_end"))
        .when(F.col("body") == "end", F.coalesce(F.when(at_block.isNotNull(), F.struct(at_block["hi"].alias("hi"), at_block["end_line"].alias("line"))), F.col("file_end")))
    )
    met = met.withColumn("_end", F.when(defined, end)).where(~defined | F.col("_end").isNotNull())
    whole = defined & (F.col("body") == "{") & F.substring("anchor", 1, 1).isin("@", ":")
    qualified = (F.col("what") == "call") & (F.col("name_at") == 0) & F.col("_prev_chains") & (F.col("chain_lo") < F.col("prev.lo"))
    # a directive is one token: the path is its first group, and stands last in it
    directive = F.col("cls") == "i"
    path = F.call_function("regexp_extract", F.col("text"), F.col("directive"), F.lit(1))
    path_hi = F.col("hi") - F.octet_length(F.call_function("substring_index", F.col("text"), path, F.lit(-1)))
    bare = F.regexp_replace(F.col("_name.text"), "^['\"`<]+|['\"`>]+$", "")
    out = met.select(
        "path", "what", "rank", F.when(directive, path).when(F.col("what") == "import", bare).otherwise(F.col("_name.text")).alias("name"), "kind",
        F.when(directive, path_hi - F.octet_length(path)).otherwise(F.col("_name.lo")).cast("long").alias("name_lo"),
        F.when(whole, F.col("begin.lo")).when(defined, F.col("lo")).when(directive, path_hi - F.octet_length(path)).otherwise(F.col("_name.lo")).cast("long").alias("start_byte"),
        F.when(defined, F.col("_end.hi")).when(directive, path_hi).otherwise(F.col("_name.hi")).cast("long").alias("end_byte"),
        F.when(whole, F.col("begin.line")).when(defined, F.col("line")).when(directive, F.col("end_line")).otherwise(F.col("_name.line")).alias("start_line"),
        F.when(defined, F.col("_end.line")).otherwise(F.col("_name.end_line")).alias("end_line"),
        F.when(qualified, F.struct(F.col("chain_lo").alias("lo"), F.col("prev.lo").alias("hi"))).alias("_q"),
    )
    # of patterns that meet in a name the first of its kind counts, and what is defined there isn't called
    once = out.withColumns({
        "_turn": F.row_number().over(Window.partitionBy("path", "name_lo", "what").orderBy("rank", "start_byte", "end_byte", "kind")),
        "_defined": F.max(F.col("what") == "definition").over(Window.partitionBy("path", "name_lo")),
    }).where("_turn = 1 AND NOT (what = 'call' AND _defined)")
    # a file's facts meet its text once, for the qualifiers: they can't be more than it has bytes
    own = [f for f in FACTS if f not in ("path", "qualifier")]
    packed = once.groupBy("path").agg(F.collect_list(F.struct(*own, "_q")).alias("_facts"))
    raw = files.where("content IS NOT NULL").select("path", F.col("content").cast("binary").alias("_raw"))
    cut = lambda x: F.substring(F.col("_raw"), (x["_q"]["lo"] + 1).cast("int"), (x["_q"]["hi"] - x["_q"]["lo"]).cast("int")).cast("string")
    each = F.transform("_facts", lambda x: F.struct(*[x[f].alias(f) for f in own], F.when(x["_q"].isNotNull(), cut(x)).alias("qualifier")))
    return packed.join(raw, "path").select("path", F.explode(each).alias("x")).select("path", *[F.col(f"x.{f}").alias(f) for f in FACTS[1:]])
