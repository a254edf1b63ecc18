"""The registered queries over the reference operators, each with the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import paths as P
from corvane.operators import extract as E
from corvane.operators import filters as S
from corvane.operators import graph as G
from corvane.operators import index as I
from corvane.operators import pack as K
from corvane.operators import tokens as T
from corvane.operators import web as W
from corvane.plans.adapters import duckdb, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

V_FILES, V_DEFS, V_CALLS, V_IMPORTS = (duckdb(n) for n in ("files", "defs", "calls", "imports"))


def query(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def files(spark, sf_dir):
    return view(spark, sf_dir, "files")


def graph_inputs(spark, sf_dir):
    return view(spark, sf_dir, "calls"), view(spark, sf_dir, "imports"), view(spark, sf_dir, "defs")


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


NAME_SQL = "string_split(path, '/')[-1]"
EXT_SQL = f"regexp_extract({NAME_SQL}, '^.+\\.([^.]*)$', 1)"
SOURCE_SQL = f"({NAME_SQL} IN {_in(S.SOURCE_NAMES)} OR lower({EXT_SQL}) IN {_in(S.SOURCE_EXTENSIONS)})"


@query("scan_filter_default", f"SELECT path, size FROM {V_FILES} WHERE size <= 10485760 AND {SOURCE_SQL} AND NOT regexp_matches(path, '(^|/)(\\.git|\\.svn|\\.hg|target|node_modules|dist|build)/.')")
def scan_filter_default(spark, sf_dir):
    return files(spark, sf_dir).where(S.should_process(F.col("path"), F.col("size"), exclude=S.DEFAULT_EXCLUDES)).select("path", "size")


@query("scan_max_size", f"SELECT path, size FROM {V_FILES} WHERE size <= 2000")
def scan_max_size(spark, sf_dir):
    return files(spark, sf_dir).where(F.col("size") <= 2000).select("path", "size")


@query("scan_only_include", f"SELECT path FROM {V_FILES} WHERE size <= 10485760 AND {NAME_SQL} LIKE '%.xyz'")
def scan_only_include(spark, sf_dir):
    return files(spark, sf_dir).where(S.should_process(F.col("path"), F.col("size"), only_include=["*.xyz"])).select("path")


@query("scan_include_additive", f"SELECT path FROM {V_FILES} WHERE size <= 10485760 AND ({SOURCE_SQL} OR {NAME_SQL} LIKE '%.xyz')")
def scan_include_additive(spark, sf_dir):
    return files(spark, sf_dir).where(S.should_process(F.col("path"), F.col("size"), include=["*.xyz"])).select("path")


@query("scan_exclude_glob", f"SELECT path FROM {V_FILES} WHERE size <= 10485760 AND {SOURCE_SQL} AND NOT regexp_matches(path, '^en/(.*/)?[^/]*\\.md$') AND NOT regexp_matches(path, '^(.*/)?src1/.')")
def scan_exclude_glob(spark, sf_dir):
    return files(spark, sf_dir).where(S.should_process(F.col("path"), F.col("size"), exclude=["en/**/*.md", "!**/src1/**"])).select("path")


@query("detect_source", f"SELECT path, {SOURCE_SQL} AS is_source FROM {V_FILES}")
def detect_source(spark, sf_dir):
    return files(spark, sf_dir).select("path", S.is_source(F.col("path"), F.col("content")).alias("is_source"))


@query("scan_hidden", f"SELECT path FROM {V_FILES} WHERE NOT list_bool_or(list_transform(string_split(path, '/'), lambda x: starts_with(x, '.')))")
def scan_hidden(spark, sf_dir):
    return files(spark, sf_dir).where(~P.is_hidden(F.col("path"))).select("path")


@query("scan_max_depth", f"SELECT path FROM {V_FILES} WHERE len(string_split(path, '/')) <= 3")
def scan_max_depth(spark, sf_dir):
    return files(spark, sf_dir).where(P.depth(F.col("path")) <= 3).select("path")


@query("scan_valid_utf8", "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size FROM documents WHERE text IS NOT NULL")
def scan_valid_utf8(spark, sf_dir):
    raw = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("raw"))
    return raw.where(F.is_valid_utf8(F.col("raw").cast("string"))).select("doc_id", F.octet_length("raw").cast("long").alias("size"))


@query("shebang_interpreter", """
WITH s AS (SELECT doc_id, doc_id % 6 AS k FROM documents)
SELECT doc_id, CASE k WHEN 0 THEN 'python3' WHEN 1 THEN 'bash' WHEN 2 THEN 'python2' WHEN 3 THEN 'node' WHEN 4 THEN NULL ELSE 'ruby' END AS interpreter FROM s""")
def shebang_interpreter(spark, sf_dir):
    lines = ["#!/usr/bin/env -S python3 -u", "#!/bin/bash", "#!/usr/bin/python2.7", "#!/usr/bin/env A=b node", "plain", '#!/bin/sh\nexec ruby "$0"']
    scripts = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.element_at(F.array(*[F.lit(x) for x in lines]), (F.col("doc_id") % 6 + 1).cast("int")), F.lit("\n"), F.col("text")).alias("content"))
    return scripts.select("doc_id", P.interpreter(F.col("content")).alias("interpreter"))


@query("parse_target", f"SELECT target, nullif(regexp_extract(target, '^(.*):[^:]*$', 1), '') AS file, regexp_extract(target, '([^:]*)$', 1) AS func FROM (SELECT concat(CASE WHEN pos % 5 = 0 THEN '' WHEN pos % 5 = 1 THEN 'C:\\' || file || ':' ELSE file || ':' END, callee) AS target FROM {V_CALLS})")
def parse_target(spark, sf_dir):
    t = view(spark, sf_dir, "calls").selectExpr("concat(CASE WHEN pos % 5 = 0 THEN '' WHEN pos % 5 = 1 THEN concat('C:', chr(92), file, ':') ELSE concat(file, ':') END, callee) AS target")
    return t.select("target", P.target_file(F.col("target")).alias("file"), P.target_function(F.col("target")).alias("func"))


@query("xml_escape", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS escaped FROM pages")
def xml_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.xml_escape(F.col("html")).alias("escaped"))


@query("clean_import_path", f"SELECT import_pos, module_path FROM {V_IMPORTS}")
def clean_import_path(spark, sf_dir):
    quoted = F.concat(F.lit("\"'"), F.col("module_path"), F.lit("'\""))
    return view(spark, sf_dir, "imports").select("import_pos", P.clean_import(quoted).alias("module_path"))


_STEM = "CASE ext WHEN 'rs' THEN replace(replace(module_path, 'crate::', ''), '::', '/') WHEN 'py' THEN replace(module_path, '.', '/') ELSE replace(module_path, '../', '') END"
_FORMS = f"""SELECT import_pos, file, module_path, ext, unnest(CASE ext
   WHEN 'rs' THEN [{{'p': 0, 'c': st || '.rs'}}, {{'p': 1, 'c': st || '/mod.rs'}}, {{'p': 2, 'c': 'src/' || st || '.rs'}}, {{'p': 3, 'c': 'src/' || st || '/mod.rs'}}]
   WHEN 'py' THEN [{{'p': 0, 'c': st || '.py'}}, {{'p': 1, 'c': st || '/__init__.py'}}, {{'p': 2, 'c': 'src/' || st || '.py'}}]
   ELSE [{{'p': 0, 'c': st || '.ts'}}, {{'p': 1, 'c': st || '.tsx'}}, {{'p': 2, 'c': st || '.js'}}, {{'p': 3, 'c': st || '/index.ts'}}, {{'p': 4, 'c': st || '/index.tsx'}}, {{'p': 5, 'c': st || '/index.js'}}] END) AS u
 FROM (SELECT *, {_STEM} AS st FROM (SELECT *, regexp_extract(file, '\\.([^.]*)$', 1) AS ext FROM {V_IMPORTS}))"""


@query("import_candidates", f"SELECT import_pos, CAST(u.p AS INT) AS rank, u.c AS candidate FROM ({_FORMS})")
def import_candidates(spark, sf_dir):
    return view(spark, sf_dir, "imports").select("import_pos", F.posexplode(P.import_candidates(F.col("module_path"), P.extension(F.col("file")))).alias("rank", "candidate"))


_SUFFIX = "SELECT DISTINCT file AS target, unnest(list_transform(range(1, len(string_split(file, '/')) + 1), lambda i: array_to_string(string_split(file, '/')[i:], '/'))) AS pattern FROM "


@query("path_suffixes", f"{_SUFFIX} {V_DEFS}")
def path_suffixes(spark, sf_dir):
    return G.file_suffixes(view(spark, sf_dir, "defs").select("file"))


@query("lsp_skip_dirs", f"SELECT path, regexp_matches(path, '(vendor|vendors|third_party|third-party|thirdparty|external|externals|deps|node_modules|\\.git|dist|build|out|__pycache__)/') AS skipped FROM (SELECT CASE doc_id % 4 WHEN 0 THEN 'third_party/' WHEN 1 THEN 'x/dist/' ELSE '' END || path AS path FROM {V_FILES})")
def lsp_skip_dirs(spark, sf_dir):
    f = files(spark, sf_dir).selectExpr("concat(CASE doc_id % 4 WHEN 0 THEN 'third_party/' WHEN 1 THEN 'x/dist/' ELSE '' END, path) AS path")
    return f.select("path", P.skipped_for_servers(F.col("path")).alias("skipped"))


@query("declaration_files", "SELECT uri, regexp_matches(uri, '(\\.d\\.(ts|mts|cts)|\\.(h|hpp|hxx|hh))$') AS declaration FROM (SELECT 'file:///' || doc_id || (CASE doc_id % 5 WHEN 0 THEN '.d.ts' WHEN 1 THEN '.ts' WHEN 2 THEN '.hpp' WHEN 3 THEN '.h' ELSE '.c' END) AS uri FROM documents)")
def declaration_files(spark, sf_dir):
    d = table(spark, sf_dir, "documents").selectExpr("concat('file:///', doc_id, CASE doc_id % 5 WHEN 0 THEN '.d.ts' WHEN 1 THEN '.ts' WHEN 2 THEN '.hpp' WHEN 3 THEN '.h' ELSE '.c' END) AS uri")
    return d.select("uri", P.is_declaration(F.col("uri")).alias("declaration"))


@query("language_id", f"SELECT file, CASE regexp_extract(file, '\\.([^.]*)$', 1) WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' ELSE 'typescript' END AS language FROM {V_CALLS}")
def language_id(spark, sf_dir):
    return view(spark, sf_dir, "calls").select("file", P.language_id(P.extension(F.col("file"))).alias("language"))


_URLS = "SELECT p_partkey AS k, (CASE p_partkey % 6 WHEN 0 THEN 'https://github.com/a/' WHEN 1 THEN 'https://gitlab.com/raw/' WHEN 2 THEN 'git://host/' WHEN 3 THEN 'https://example.org/' WHEN 4 THEN 'not a url ' ELSE 'https://bitbucket.org/t/' END) || replace(p_name, ' ', '-') || (CASE p_partkey % 4 WHEN 0 THEN '.git' WHEN 1 THEN '.git.git' ELSE '' END) AS url FROM part"


@query("repo_name", f"SELECT k, regexp_replace(string_split(url, '/')[-1], '(\\.git)+$', '') AS name FROM ({_URLS})")
def repo_name(spark, sf_dir):
    return spark.sql(_URLS.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part")).select("k", P.repo_name(F.col("url")).alias("name"))


@query("is_git_url", f"SELECT k, (k % 6 <> 4) AND (k % 6 = 2 OR k % 4 IN (0, 1) OR k % 6 IN (0, 5)) AS is_git FROM ({_URLS})")
def is_git_url(spark, sf_dir):
    return spark.sql(_URLS.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part")).select("k", P.is_git_url(F.col("url")).alias("is_git"))


_LINKS = "SELECT page_id, url, CAST(pos - 1 AS INT) AS pos, l[pos] AS href FROM (SELECT page_id, url, l, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT page_id, url, regexp_extract_all(html, '<a[^>]*?href=\"([^\"]*)\"', 1) AS l FROM pages))"


@query("page_links", f"SELECT page_id, pos, regexp_extract(url, '^(https?://[^/]+)', 1) || href AS link FROM ({_LINKS})")
def page_links(spark, sf_dir):
    return W.page_links(table(spark, sf_dir, "pages")).select("page_id", "pos", "link")


@query("crawl", f"""WITH RECURSIVE links AS (SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) || href AS link, pos FROM ({_LINKS})),
walk AS (SELECT page_id AS start, url, 0 AS depth FROM pages UNION SELECT w.start, l.link, w.depth + 1 FROM walk w JOIN pages p ON p.url = w.url JOIN links l ON l.page_id = p.page_id WHERE w.depth < 2)
SELECT start, count(DISTINCT url) AS n_urls, count(DISTINCT CASE WHEN url IN (SELECT url FROM pages) THEN url END) AS n_fetched FROM walk GROUP BY start""")
def crawl(spark, sf_dir):
    return W.crawl(table(spark, sf_dir, "pages"), 2)


@query("crawl_order", f"""WITH RECURSIVE links AS (SELECT page_id, link, min(pos) AS pos FROM (SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) || href AS link, pos FROM ({_LINKS})) GROUP BY page_id, link),
walk AS (SELECT page_id AS start, url, '' AS steps, 0 AS depth FROM pages UNION ALL SELECT w.start, l.link, w.steps || '/' || l.pos, w.depth + 1 FROM walk w JOIN pages p ON p.url = w.url JOIN links l ON l.page_id = p.page_id
 WHERE w.depth < 2 AND l.link IN (SELECT url FROM pages))
SELECT start, steps, url FROM walk""")
def crawl_order(spark, sf_dir):
    steps = F.array_join(F.transform("steps", lambda x: F.concat(F.lit("/"), x.cast("string"))), "")
    return W.crawl_order(table(spark, sf_dir, "pages"), 2).select("start", steps.alias("steps"), "url")


@query("crawl_positions", f"""WITH RECURSIVE links AS MATERIALIZED (SELECT page_id, link, min(pos) AS pos FROM (SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) || href AS link, pos FROM ({_LINKS})) GROUP BY page_id, link),
next AS MATERIALIZED (SELECT p.url, l.link, l.pos FROM pages p JOIN links l ON l.page_id = p.page_id WHERE l.link IN (SELECT url FROM pages)),
walk AS (SELECT page_id AS start, url, []::INT[] AS steps, 0 AS depth FROM pages UNION ALL SELECT w.start, n.link, list_append(w.steps, n.pos), w.depth + 1 FROM walk w JOIN next n ON n.url = w.url WHERE w.depth < 3)
SELECT start, row_number() OVER (PARTITION BY start ORDER BY steps) - 1 AS position, depth, url FROM walk""")
def crawl_positions(spark, sf_dir):
    """Places of pages in the walks of at most 3 links."""
    return W.crawl_positions(table(spark, sf_dir, "pages"), 3)


@query("html_markdown")
def html_markdown(spark, sf_dir):
    return W.markdown(table(spark, sf_dir, "pages"))


_SORTED = f"(SELECT path, string_split(path, '/') AS c FROM {V_FILES})"


@query("tree_lines", f"""WITH s AS (SELECT path, c, lag(c) OVER (ORDER BY c) AS prev FROM {_SORTED}),
e AS (SELECT path, c, prev, unnest(range(1, len(c) + 1)) AS i FROM s),
u AS (SELECT i, count(DISTINCT c[i]) AS n FROM e GROUP BY i)
SELECT path, CAST(e.i - 1 AS INT) AS level, repeat('  ', CAST(e.i - 1 AS INT)) || CASE WHEN e.i = len(c) THEN '└── ' || c[e.i] WHEN u.n = 1 THEN '└── ' || c[e.i] || '/' ELSE '├── ' || c[e.i] || '/' END AS line
FROM e JOIN u USING (i) WHERE prev IS NULL OR e.i > len(prev) OR prev[e.i] <> c[e.i]""")
def tree_lines(spark, sf_dir):
    return K.tree_lines(files(spark, sf_dir))


@query("file_blocks", f"SELECT path, chr(10) || 'File: ' || path || chr(10) || repeat('=', 48) || chr(10) || content || chr(10) AS block FROM {V_FILES}")
def file_blocks(spark, sf_dir):
    return files(spark, sf_dir).select("path", K.file_block(F.col("path"), F.col("content")).alias("block"))


def _packed(fixed: dict[int, str], block: str, head: str, tail: str) -> str:
    """SQL: the fixed lines by section, the tree, the files' blocks and the summary between head and tail."""
    values = ", ".join(f"({section}, '{line}')" for section, line in fixed.items())
    return f"""SELECT CAST(section AS INT) AS section, '' AS path, CAST(0 AS INT) AS ord, replace(line, '~', chr(10)) AS line FROM (VALUES {values}) v(section, line)
UNION ALL SELECT 2, path, level, line FROM ({ORACLE_SQL["tree_lines"]})
UNION ALL SELECT 5, path, 0, {block} FROM {V_FILES}
UNION ALL SELECT 7, '', 0, '{head}' || chr(10) || 'Total files: ' || count(*) || chr(10) || 'Total size: ' || CAST(coalesce(sum(size), 0) AS BIGINT) || ' bytes' || chr(10) || replace('{tail}', '~', chr(10)) FROM {V_FILES}"""


_PLAIN_BLOCK = "chr(10) || 'File: ' || path || chr(10) || repeat('=', 48) || chr(10) || content || chr(10)"
_TAGGED_BLOCK = "'<file path=\"' || path || '\">' || chr(10) || repeat('=', 48) || chr(10) || content || chr(10) || '</file>' || chr(10)"


@query("packed_document", _packed({1: "Directory Structure:", 3: "", 4: "File Contents:", 6: ""}, _PLAIN_BLOCK, "Summary:", ""))
def packed_document(spark, sf_dir):
    return K.document(files(spark, sf_dir))


_PRINTED = "list_sum(list_transform(string_split(replace(replace(line, chr(9), '    '), chr(13) || chr(10), chr(10)), chr(10)), lambda x: greatest(length(x) - 1, 0) // 110 + 1))"


@query("document_pages", f"""SELECT section, path, ord, CAST(first_line AS BIGINT) AS first_line, CAST(n AS BIGINT) AS n_lines, CAST(first_line // 63 AS BIGINT) AS first_page, CAST((first_line + greatest(n - 1, 0)) // 63 AS BIGINT) AS last_page
FROM (SELECT *, coalesce(sum(n) OVER (ORDER BY section, string_split(path, '/'), ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_line
 FROM (SELECT section, path, ord, coalesce({_PRINTED}, 0) AS n FROM ({_packed({1: "Directory Structure:", 3: "", 4: "File Contents:", 6: ""}, _PLAIN_BLOCK, "Summary:", "")})))""")
def document_pages(spark, sf_dir):
    """Lines and pages of the packed document's pieces on paper."""
    from corvane.sources import pdf

    return pdf.pages(K.document(files(spark, sf_dir))).drop("line")


@query("summary", f"SELECT count(*) AS n_files, CAST(sum(size) AS BIGINT) AS n_bytes FROM {V_FILES} WHERE size <= 10485760 AND {SOURCE_SQL}")
def summary(spark, sf_dir):
    return files(spark, sf_dir).where(S.should_process(F.col("path"), F.col("size"))).agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("n_bytes"))


@query("token_total", f"SELECT CAST(sum(len(regexp_extract_all(content, '[^\\x20\\x09-\\x0D]+'))) AS BIGINT) AS tokens, count(*) AS files FROM {V_FILES}")
def token_total(spark, sf_dir):
    return T.total(T.count(files(spark, sf_dir), T.words))


@query("model_tokens")
def model_tokens(spark, sf_dir):
    """Tokens of whole texts by a byte-pair vocabulary."""
    import public_tokenizers

    return T.count(files(spark, sf_dir), T.tokenizer_file(public_tokenizers.path("byte_bpe_50k.json")))


@query("token_top15", f"SELECT path, CAST(len(regexp_extract_all(content, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens FROM {V_FILES} ORDER BY tokens DESC, path LIMIT 15")
def token_top15(spark, sf_dir):
    counted = files(spark, sf_dir).select("path", F.regexp_count("content", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"))
    return counted.orderBy(F.desc("tokens"), "path").limit(15)


@query("union_paths", f"SELECT path, count(*) AS n FROM (SELECT path FROM {V_FILES} UNION ALL SELECT path FROM {V_FILES} WHERE path LIKE 'en/%') GROUP BY path")
def union_paths(spark, sf_dir):
    f = files(spark, sf_dir).select("path")
    return f.unionByName(f.where(F.col("path").startswith("en/"))).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


_ENCLOSED = f"""(SELECT file, pos, callee, qualifier, name AS caller FROM (SELECT c.file, c.pos, c.callee, c.qualifier, d.name,
 row_number() OVER (PARTITION BY c.file, c.pos, c.callee, c.qualifier ORDER BY d.end_byte - d.start_byte, d.start_byte, d.name) AS rn
 FROM {V_CALLS} c LEFT JOIN {V_DEFS} d ON c.file = d.file AND d.start_byte <= c.pos AND c.pos < d.end_byte) WHERE rn = 1)"""
_EXT = "regexp_extract({}, '\\.([^.]*)$', 1)"
_FAM = "CASE WHEN {0} IN ('ts','tsx') THEN 'js' ELSE {0} END"
_DEF1 = f"(SELECT DISTINCT file, name FROM {V_DEFS})"
_IMPORT_HIT = f"""(SELECT file, callee, arg_min(target, (import_pos, p, target)) AS target FROM (
  SELECT f.file, f.import_pos, f.u.p AS p, s.target, d.name AS callee, f.module_path, f.ext FROM ({_FORMS}) f JOIN ({_SUFFIX} {V_DEFS}) s ON s.pattern = f.u.c JOIN {_DEF1} d ON d.file = s.target
  WHERE CASE f.ext WHEN 'rs' THEN string_split(f.module_path, '::')[-1] = d.name WHEN 'py' THEN string_split(f.module_path, '.')[-1] = d.name ELSE true END) GROUP BY file, callee)"""
_GLOBAL_HIT = f"(SELECT name, fam, min(file) AS target FROM (SELECT file, name, {_FAM.format(_EXT.format('file'))} AS fam FROM {V_DEFS}) GROUP BY name, fam)"


def _resolved(strict: bool) -> str:
    last = "" if strict else ", g.target"
    return f"""(SELECT c.file, c.pos, c.callee, c.qualifier, coalesce(h.file, i.target{last}) AS target_file FROM {V_CALLS} c
 LEFT JOIN {_DEF1} h ON h.file = c.file AND h.name = c.callee LEFT JOIN {_IMPORT_HIT} i ON i.file = c.file AND i.callee = c.callee
 LEFT JOIN {_GLOBAL_HIT} g ON g.name = c.callee AND g.fam = {_FAM.format(_EXT.format('c.file'))})"""


_EDGES = f"""(SELECT DISTINCT src, dst FROM (SELECT e.file || ':' || e.caller AS src, r.target_file || ':' || r.callee AS dst
 FROM {_ENCLOSED} e JOIN {_resolved(False)} r ON e.file = r.file AND e.pos = r.pos AND e.callee = r.callee AND e.qualifier IS NOT DISTINCT FROM r.qualifier
 WHERE e.caller IS NOT NULL AND r.target_file IS NOT NULL) WHERE src <> dst)"""
_NODES = f"(SELECT DISTINCT file || ':' || name AS node FROM {V_DEFS})"
_START = f"(SELECT min(src) AS node FROM {_EDGES})"


@query("enclosing_definition", f"SELECT * FROM {_ENCLOSED}")
def enclosing_definition(spark, sf_dir):
    calls, _, defs = graph_inputs(spark, sf_dir)
    return G.enclosing_definition(calls, defs)


@query("resolve_same_file", f"SELECT c.file, c.pos, c.callee, c.qualifier, h.file AS target_file FROM {V_CALLS} c LEFT JOIN {_DEF1} h ON h.file = c.file AND h.name = c.callee")
def resolve_same_file(spark, sf_dir):
    calls, _, defs = graph_inputs(spark, sf_dir)
    return G.resolve_same_file(calls, defs)


@query("resolve_imports", f"SELECT c.file, c.pos, c.callee, c.qualifier, i.target AS target_file FROM {V_CALLS} c JOIN {_IMPORT_HIT} i ON i.file = c.file AND i.callee = c.callee")
def resolve_imports(spark, sf_dir):
    return G.resolve_imports(*graph_inputs(spark, sf_dir))


@query("resolve_global", f"SELECT c.file, c.pos, c.callee, c.qualifier, g.target AS target_file FROM {V_CALLS} c LEFT JOIN {_GLOBAL_HIT} g ON g.name = c.callee AND g.fam = {_FAM.format(_EXT.format('c.file'))}")
def resolve_global(spark, sf_dir):
    calls, _, defs = graph_inputs(spark, sf_dir)
    return G.resolve_global(calls, defs)


@query("resolve_strict", f"SELECT * FROM {_resolved(True)}")
def resolve_strict(spark, sf_dir):
    return G.resolve(*graph_inputs(spark, sf_dir), strict=True)


@query("resolve_full", f"SELECT * FROM {_resolved(False)}")
def resolve_full(spark, sf_dir):
    return G.resolve(*graph_inputs(spark, sf_dir))


def edges(spark, sf_dir):
    return G.call_edges(*graph_inputs(spark, sf_dir))


def start(e: DataFrame) -> DataFrame:
    return e.agg(F.min("src").alias("node"))


@query("call_edges", f"SELECT src, dst FROM {_EDGES}")
def call_edges(spark, sf_dir):
    return edges(spark, sf_dir)


@query("graph_counts", f"SELECT (SELECT count(*) FROM {_DEF1}) AS n_nodes, (SELECT count(*) FROM {_EDGES}) AS n_edges")
def graph_counts(spark, sf_dir):
    calls, imports, defs = graph_inputs(spark, sf_dir)
    n = G.nodes(defs).agg(F.count(F.lit(1)).alias("n_nodes"))
    return n.crossJoin(G.call_edges(calls, imports, defs).agg(F.count(F.lit(1)).alias("n_edges")))


@query("adjacency", f"""WITH e AS MATERIALIZED (SELECT src, dst FROM {_EDGES})
SELECT node, count(callee) AS n_callees, count(caller) AS n_callers, coalesce(string_agg(callee, ',' ORDER BY callee), '') AS callees, coalesce(string_agg(caller, ',' ORDER BY caller), '') AS callers
FROM (SELECT node, NULL AS callee, NULL AS caller FROM {_NODES} UNION ALL SELECT src, dst, NULL FROM e UNION ALL SELECT dst, NULL, src FROM e) GROUP BY node""")
def adjacency(spark, sf_dir):
    """The nodes of the call graph with the sets of those they call and of those that call them."""
    calls, imports, defs = graph_inputs(spark, sf_dir)
    sets = G.adjacency_sets(G.call_edges(calls, imports, defs), G.nodes(defs))
    joined = [F.array_join(c, ",").alias(c) for c in ("callees", "callers")]
    return sets.select("node", F.size("callees").cast("long").alias("n_callees"), F.size("callers").cast("long").alias("n_callers"), *joined)


@query("callees", f"SELECT dst AS node FROM {_EDGES} WHERE src = (SELECT node FROM {_START})")
def callees(spark, sf_dir):
    e = edges(spark, sf_dir)
    return e.join(start(e).withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"))


@query("callers", f"SELECT src AS node FROM {_EDGES} WHERE dst = (SELECT max(dst) FROM {_EDGES})")
def callers(spark, sf_dir):
    e = edges(spark, sf_dir)
    return e.join(e.agg(F.max("dst").alias("dst")), "dst").select(F.col("src").alias("node"))


def _bounded(a: str, b: str, first: str) -> str:
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst FROM {_EDGES}), w AS (SELECT {first} AS node, 0 AS depth FROM e UNION SELECT e.{b}, w.depth + 1 FROM w JOIN e ON e.{a} = w.node WHERE w.depth < 3)
SELECT node, CAST(min(depth) AS INT) AS depth FROM w GROUP BY node"""


@query("callees_to_depth", _bounded("src", "dst", "min(src)"))
def callees_to_depth(spark, sf_dir):
    e = G.checkpointed(edges(spark, sf_dir))
    return G.to_depth(e, start(e), 3)


@query("callers_to_depth", _bounded("dst", "src", "max(dst)"))
def callers_to_depth(spark, sf_dir):
    e = G.checkpointed(edges(spark, sf_dir))
    return G.to_depth(e, e.agg(F.max("dst").alias("node")), 3, reverse=True)


def _closure(a: str, b: str, first: str) -> str:
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst FROM {_EDGES}), w AS (SELECT {b} AS node FROM e WHERE {a} = (SELECT {first} FROM e) UNION SELECT e.{b} FROM w JOIN e ON e.{a} = w.node)
SELECT node FROM w"""


@query("transitive_callees", _closure("src", "dst", "min(src)"))
def transitive_callees(spark, sf_dir):
    e = G.checkpointed(edges(spark, sf_dir))
    return G.transitive(e, start(e))


@query("transitive_callers", _closure("dst", "src", "max(dst)"))
def transitive_callers(spark, sf_dir):
    e = G.checkpointed(edges(spark, sf_dir))
    return G.transitive(e, e.agg(F.max("dst").alias("node")), reverse=True)


@query("graph_roots", f"SELECT node FROM {_NODES} WHERE node NOT IN (SELECT dst FROM {_EDGES})")
def graph_roots(spark, sf_dir):
    calls, imports, defs = graph_inputs(spark, sf_dir)
    return G.roots(G.nodes(defs), G.call_edges(calls, imports, defs))


@query("graph_leaves", f"SELECT node FROM {_NODES} WHERE node NOT IN (SELECT src FROM {_EDGES})")
def graph_leaves(spark, sf_dir):
    calls, imports, defs = graph_inputs(spark, sf_dir)
    return G.leaves(G.nodes(defs), G.call_edges(calls, imports, defs))


@query("post_order")
def post_order(spark, sf_dir):
    e = G.checkpointed(edges(spark, sf_dir))
    first = e.agg(F.min("src")).first()[0]
    return G.post_order(spark, e, first)


@query("first_by_name", f"SELECT name, file, start_byte FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY file, start_byte) AS rn FROM {V_DEFS}) WHERE rn = 1")
def first_by_name(spark, sf_dir):
    return G.by_name(view(spark, sf_dir, "defs"))


# The index as it was: the labelled files, those with toxic = 1 at another time, those with quality = 0 of another size.
_SCAN = f"(SELECT path, size % 97 AS mtime, size FROM {V_FILES})"
_OLD = f"(SELECT path, f.size % 97 + coalesce(l.toxic, 0) AS mtime, f.size + 1 - coalesce(l.quality, 1) AS size FROM {V_FILES} f JOIN labels l USING (doc_id))"
_STALE = f"(SELECT n.path, n.mtime, n.size FROM {_SCAN} n LEFT JOIN {_OLD} o USING (path) WHERE o.path IS NULL OR o.mtime <> n.mtime OR o.size <> n.size)"


def snapshots(spark, sf_dir):
    f = files(spark, sf_dir)
    now = f.selectExpr("path", "size % 97 AS mtime", "size")
    old = f.join(table(spark, sf_dir, "labels"), "doc_id").selectExpr("path", "size % 97 + coalesce(toxic, 0) AS mtime", "size + 1 - coalesce(quality, 1) AS size")
    return now, old


@query("stale_files", f"SELECT path FROM {_STALE}")
def stale_files(spark, sf_dir):
    return I.stale(*snapshots(spark, sf_dir)).select("path")


@query("index_upsert", f"SELECT path, mtime, size FROM {_OLD} WHERE path NOT IN (SELECT path FROM {_STALE}) UNION ALL SELECT path, mtime, size FROM {_STALE}")
def index_upsert(spark, sf_dir):
    now, old = snapshots(spark, sf_dir)
    return I.upsert(old, I.stale(now, old), "path")


@query("index_remove", f"SELECT path, mtime, size FROM {_SCAN} WHERE path NOT IN (SELECT path FROM {_OLD})")
def index_remove(spark, sf_dir):
    now, old = snapshots(spark, sf_dir)
    return I.remove(now, old, "path")


@query("index_status", f"SELECT (SELECT count(DISTINCT file) FROM {V_DEFS}) AS n_files, (SELECT count(*) FROM {V_DEFS}) AS n_definitions, (SELECT count(*) FROM {V_CALLS}) AS n_calls, (SELECT count(target_file) FROM {_resolved(False)}) AS n_resolved, (SELECT count(*) FROM {V_IMPORTS}) AS n_imports")
def index_status(spark, sf_dir):
    calls, imports, defs = graph_inputs(spark, sf_dir)
    d = defs.agg(F.count_distinct("file").alias("n_files"), F.count(F.lit(1)).alias("n_definitions"))
    c = G.resolve(calls, imports, defs).agg(F.count(F.lit(1)).alias("n_calls"), F.count("target_file").alias("n_resolved"))
    return d.crossJoin(c).crossJoin(imports.agg(F.count(F.lit(1)).alias("n_imports"))).select("n_files", "n_definitions", "n_calls", "n_resolved", "n_imports")


@query("lsp_dedup_keys", f"SELECT callee, qualifier, ext, count(*) AS n, min(file || '@' || pos) AS representative FROM (SELECT *, {_EXT.format('file')} AS ext FROM {V_CALLS}) GROUP BY callee, qualifier, ext")
def lsp_dedup_keys(spark, sf_dir):
    calls = view(spark, sf_dir, "calls").withColumn("ext", P.extension(F.col("file")))
    return calls.groupBy("callee", "qualifier", "ext").agg(F.count(F.lit(1)).alias("n"), F.min(F.concat(F.col("file"), F.lit("@"), F.col("pos").cast("string"))).alias("representative"))


@query("cache_hit_rate", f"SELECT n - u AS hits, round(100.0 * (n - u) / n, 6) AS rate FROM (SELECT count(*) AS n, count(DISTINCT (callee, qualifier, {_EXT.format('file')})) AS u FROM {V_CALLS})")
def cache_hit_rate(spark, sf_dir):
    calls = view(spark, sf_dir, "calls").withColumn("ext", P.extension(F.col("file")))
    keys = calls.groupBy("callee", "qualifier", "ext").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("u"))
    return keys.select((F.col("n") - F.col("u")).alias("hits"), F.round(F.lit(100.0) * (F.col("n") - F.col("u")) / F.col("n"), 6).alias("rate"))


_FACTS = f"""(SELECT file, pos, callee, CASE pos % 7 WHEN 0 THEN 'ext/lib.rs' WHEN 1 THEN 'src/none.rs' WHEN 2 THEN NULL ELSE file END AS target, pos + CASE pos % 3 WHEN 0 THEN 0 ELSE 5000000 END AS at FROM {V_CALLS})"""


@query("lsp_outcomes", f"""SELECT server, count(*) AS total, count(*) FILTER (outcome = 'resolved') AS resolved, count(*) FILTER (outcome = 'external') AS external, count(*) FILTER (outcome = 'no_definition') AS no_definition,
 count(*) FILTER (outcome = 'not_indexed') AS not_indexed, count(*) FILTER (outcome = 'no_match') AS no_match FROM (
 SELECT regexp_extract(file, '\\.([^.]*)$', 1) AS server, CASE WHEN target IS NULL THEN 'no_definition' WHEN NOT starts_with(target, 'src/') THEN 'external' WHEN target NOT IN (SELECT file FROM {V_DEFS}) THEN 'not_indexed'
  WHEN EXISTS (SELECT 1 FROM {V_DEFS} d WHERE d.file = f.target AND d.start_byte <= f.at AND f.at < d.end_byte) THEN 'resolved' ELSE 'no_match' END AS outcome FROM {_FACTS} f) GROUP BY server""")
def lsp_outcomes(spark, sf_dir):
    calls, _, defs = graph_inputs(spark, sf_dir)
    facts = calls.selectExpr("file", "pos", "callee", "CASE pos % 7 WHEN 0 THEN 'ext/lib.rs' WHEN 1 THEN 'src/none.rs' WHEN 2 THEN NULL ELSE file END AS target", "pos + CASE pos % 3 WHEN 0 THEN 0 ELSE 5000000 END AS at")
    return I.server_report(I.location_outcomes(facts, defs, "src/"))


@query("server_timings", "SELECT event_type AS server, count(*) AS n, round(sum(value), 4) AS total_ms, round(coalesce(sum(value) / nullif(count(value), 0), 0), 4) AS mean_ms FROM events GROUP BY event_type")
def server_timings(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("server"))
    return e.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total_ms"), F.round(F.coalesce(F.try_divide(F.sum("value"), F.count("value")), F.lit(0.0)), 4).alias("mean_ms"))


@query("definition_source", "SELECT doc_id, '## ' || 'd' || doc_id || ':f' || chr(10) || '```' || chr(10) || array_to_string(string_split(text, chr(10))[1 + doc_id % 2:2 + doc_id % 2], chr(10)) || chr(10) || '```' AS block FROM documents")
def definition_source(spark, sf_dir):
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", "concat('d', doc_id) AS file", "'f' AS name", "text AS content", "cast(1 + doc_id % 2 AS int) AS start_line", "cast(2 + doc_id % 2 AS int) AS end_line")
    return d.select("doc_id", K.definition_block(F.col("file"), F.col("name"), F.col("content"), F.col("start_line"), F.col("end_line")).alias("block"))


@query("picked_paths", f"SELECT path, size FROM {V_FILES} WHERE doc_id IN (SELECT doc_id FROM labels)")
def picked_paths(spark, sf_dir):
    f = files(spark, sf_dir)
    picked = f.join(table(spark, sf_dir, "labels"), "doc_id").select("path")
    return f.join(picked, "path", "left_semi").select("path", "size")


@query("picker_order", f"SELECT name, is_dir, row_number() OVER (ORDER BY is_dir DESC, name) AS pos FROM (SELECT DISTINCT string_split(path, '/')[2] AS name, len(string_split(path, '/')) > 2 AS is_dir FROM {V_FILES} WHERE path LIKE 'en/%')")
def picker_order(spark, sf_dir):
    parts = F.split("path", "/")
    names = files(spark, sf_dir).where("path LIKE 'en/%'").select(F.get(parts, F.lit(1)).alias("name"), (F.size(parts) > 2).alias("is_dir")).distinct()
    # One directory's entries: a listing, ordered in one task by its nature.
    return names.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("is_dir"), "name")).cast("long"))


@query("call_column", "SELECT doc_id, CAST(CASE WHEN instr(l, 'th') > 0 THEN strlen(substr(l, 1, instr(l, 'th') - 1)) ELSE 0 END AS INT) AS col FROM (SELECT doc_id, string_split(text, chr(10))[1] AS l FROM documents)")
def call_column(spark, sf_dir):
    line = F.get(F.split("text", "\n"), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", P.call_column(line, "th").alias("col"))


@query("thousands", f"SELECT path, format('{{:,}}', size) AS shown FROM {V_FILES}")
def thousands(spark, sf_dir):
    return files(spark, sf_dir).select("path", F.format_number("size", 0).alias("shown"))


@query("hover_signature", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'pub fn f(x: i32) -> i32' WHEN 1 THEN 'x => y' ELSE 'plain' END AS signature FROM documents")
def hover_signature(spark, sf_dir):
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", "CASE doc_id % 3 WHEN 0 THEN concat('doc', chr(10), ' pub fn f(x: i32) -> i32 ') WHEN 1 THEN concat('a', chr(10), 'x => y') ELSE concat('plain', chr(10), 'b') END AS h")
    return d.select("doc_id", P.signature(F.col("h")).alias("signature"))


_SAMPLE = """(SELECT 'src/f' || p_partkey || (CASE p_partkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.rs' WHEN 2 THEN '.go' ELSE '.js' END) AS file, p_partkey % 4 AS t, CAST(p_partkey AS VARCHAR) AS k FROM part)"""


def _per_language(*rows: str) -> str:
    """SQL: each sample file with the structs that its language's list holds."""
    return f"(SELECT file, unnest(CASE t WHEN 0 THEN [{rows[0]}] WHEN 1 THEN [{rows[1]}] WHEN 2 THEN [{rows[2]}] ELSE [{rows[3]}] END) AS u FROM {_SAMPLE})"


def _rows(fields: str, *each: str) -> str:
    return ", ".join("{" + ", ".join(f"'{f}': {v}" for f, v in zip(fields.split(), e.split(";"), strict=True)) + "}" for e in each)


_D = "name kind a b"
_SAMPLE_DEFS = _per_language(
    _rows(_D, "'a' || k;'function';3;4", "'C' || k;'class';6;8", "'m';'function';7;8"), _rows(_D, "'a' || k;'function';3;5"),
    _rows(_D, "'a' || k;'function';5;7"), _rows(_D, "'b' || k;'function';1;1", "'a' || k;'function';2;2"),
)
_SAMPLE_CALLS = _per_language(
    _rows("c q", "'b' || k;NULL", "'getcwd';'os'", "'a' || k;NULL"), _rows("c q", "'b' || k;NULL"), _rows("c q", "'Println';'fmt'", "'b' || k;NULL"), _rows("c q", "'b' || k;NULL")
)


def sample(spark, sf_dir):
    return E.sample_sources(table(spark, sf_dir, "part"))


@query("extract_definitions", f"SELECT file AS path, u.name AS name, u.kind AS kind, CAST(u.a AS INT) AS start_line, CAST(u.b AS INT) AS end_line FROM {_SAMPLE_DEFS}")
def extract_definitions(spark, sf_dir):
    return E.definitions(sample(spark, sf_dir))


@query("extract_calls", f"SELECT file, u.c AS callee, u.q AS qualifier FROM {_SAMPLE_CALLS}")
def extract_calls(spark, sf_dir):
    return E.calls(sample(spark, sf_dir)).select("file", "callee", "qualifier")


@query("extract_imports", f"SELECT file, CASE t WHEN 0 THEN 'os' WHEN 1 THEN 'crate::x::y' ELSE 'fmt' END AS module_path FROM {_SAMPLE} WHERE t < 3")
def extract_imports(spark, sf_dir):
    return E.imports(sample(spark, sf_dir)).select("file", "module_path")


_BROKEN = {
    0: [("import", "a.b", None, None, 1, 1), ("definition", "A{k}", "method", None, 3, 3), ("call", "g{k}", None, None, 3, 3), ("definition", "h{k}", "method", None, 6, 6), ("call", "m{k}", None, "this", 6, 6)],
    1: [("call", "bar{k}", None, None, 2, 2), ("call", "baz{k}", None, None, 3, 3), ("definition", "m{k}", "method", None, 4, 4), ("definition", "o{k}", "method", None, 5, 5), ("call", "p{k}", None, None, 5, 5)],
    2: [("definition", "C{k}", "class", None, 1, 10), ("definition", "a{k}", "function", None, 2, 8), ("call", "b{k}", None, None, 5, 5), ("call", "each{k}", None, "y", 6, 6), ("call", "r{k}", None, "q", 6, 6), ("definition", "z{k}", "function", None, 9, 9)],
    3: [("import", "Data.Map", None, None, 1, 1), ("definition", "f{k}", "function", None, 2, 2), ("call", "g{k}", None, None, 2, 2), ("definition", "main{k}", "function", None, 4, 5), ("call", "put{k}", None, None, 5, 5)],
    4: [("import", "a::b{k}", None, None, 1, 1), ("definition", "k{k}", "function", None, 3, 3), ("call", "y{k}", None, "x", 3, 3), ("call", "z{k}", None, "x.y{k}()", 3, 3), ("call", "n{k}", None, "m", 3, 3)],
}
_BROKEN_EXT = ["java", "ts", "rb", "hs", "rs"]
_text = lambda x: "NULL" if x is None else f"replace('{x}', '{{k}}', k)"
_BROKEN_SQL = " UNION ALL ".join(
    f"SELECT 'lib/b' || k || '.{_BROKEN_EXT[i]}' AS path, '{what}' AS what, {_text(name)} AS name, {_text(kind)} AS kind, {_text(q)} AS qualifier, {a} AS start_line, {b} AS end_line FROM p WHERE n = {i}"
    for i, rows in _BROKEN.items() for what, name, kind, q, a, b in rows
)


@query("extract_broken", f"WITH p AS MATERIALIZED (SELECT CAST(p_partkey AS VARCHAR) AS k, p_partkey % 5 AS n FROM part) {_BROKEN_SQL}")
def extract_broken(spark, sf_dir):
    found = E.facts(E.sample_broken(table(spark, sf_dir, "part")))
    return found.select("path", "what", "name", "kind", "qualifier", "start_line", "end_line")


#: Ignore files of the corpus as rows: one at the top, one in each folder of a language, one in each folder of a source.
IGNORE_FILES = """SELECT '.gitignore' AS path, concat('# of all', chr(10), '*.xyz', chr(10), '!doc_1*', chr(10), '/en/**/doc_2?.txt') AS content
UNION ALL SELECT concat(lang, '/.gitignore'), concat('src1/', chr(10), 'doc_*4.md', chr(10), '!doc_[!0-5]*.xyz  ') FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)
UNION ALL SELECT concat(lang, '/', source, '/.gitignore'), concat(chr(10), '!doc_24.md', chr(10), 'doc_', CAST(length(lang || source) AS STRING), '*', chr(10), '.hid_*', chr(10), '!/.hid_0.md')
 FROM (SELECT DISTINCT lang, source FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL)"""


@query("ignored_by_rules", f"""SELECT path FROM (SELECT path, lang, source, regexp_extract(path, '([^/]*)$') AS name FROM (SELECT f.path, split_part(f.path, '/', 1) AS lang, split_part(f.path, '/', 2) AS source FROM {V_FILES} f) )
WHERE source <> 'src1' AND CASE
 WHEN name = '.hid_0.md' THEN true WHEN name LIKE '.hid%' THEN false WHEN name LIKE 'doc_' || length(lang || source) || '%' THEN false WHEN name = 'doc_24.md' THEN true
 WHEN regexp_matches(name, '^doc_[^0-5].*[.]xyz$') THEN true WHEN name LIKE 'doc_%4.md' THEN false
 WHEN lang = 'en' AND regexp_matches(name, '^doc_2.[.]txt$') THEN false WHEN name LIKE 'doc_1%' THEN true WHEN name LIKE '%.xyz' THEN false ELSE true END""")
def ignored_by_rules(spark, sf_dir):
    """Files that the ignore files leave."""
    from corvane.operators import ignores

    ignore = spark.sql(IGNORE_FILES.replace("FROM documents", "FROM {t}"), t=table(spark, sf_dir, "documents"))
    return ignores.kept(files(spark, sf_dir).select("path"), ignore)


@query("short_paths", f"""SELECT path, CASE WHEN strlen(path) <= 15 THEN path ELSE '.../' || split_part(path, '/', -2) || '/' || split_part(path, '/', -1) END AS shown FROM {V_FILES} WHERE path IS NOT NULL""")
def short_paths(spark, sf_dir):
    """Paths as a terminal of 40 letters shows them."""
    return files(spark, sf_dir).where("path IS NOT NULL").select("path", P.shortened(F.col("path"), 40).alias("shown"))


@query("token_counts", f"SELECT path, CAST(coalesce(len(regexp_extract_all(content, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS tokens FROM {V_FILES}")
def token_counts(spark, sf_dir):
    from corvane.operators import tokens

    return tokens.count(files(spark, sf_dir).select("path", "content"), tokens.words)


@query("code_index_files", f"SELECT path, size FROM {V_FILES} WHERE {SOURCE_SQL} AND {EXT_SQL} <> ''")
def code_index_files(spark, sf_dir):
    return files(spark, sf_dir).where(S.indexable(F.col("path"))).select("path", "size")


@query("relative_path", f"SELECT path, CASE WHEN starts_with(path, 'en/') THEN substr(path, 4) ELSE path END AS rel FROM {V_FILES}")
def relative_path(spark, sf_dir):
    return files(spark, sf_dir).select("path", P.relative(F.col("path"), F.lit("en")).alias("rel"))


_HOVER = "SELECT doc_id, text, lang, CASE WHEN lang = 'en' THEN concat('let v: ', text) ELSE concat('fn f()', chr(10), text) END AS h FROM documents"
_STRIP = "regexp_replace({}, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g')"


@query("hover_type", f"""WITH h AS (SELECT doc_id, lang, string_split({_STRIP.format('h')}, chr(10)) AS l FROM ({_HOVER}))
SELECT doc_id, CASE WHEN lang = 'en' THEN {_STRIP.format("string_split(substr(l[1], 7), '=')[1]")} ELSE {_STRIP.format('coalesce(l[2], l[1])')} END AS type FROM h""")
def hover_type(spark, sf_dir):
    d = spark.sql(_HOVER.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))
    return d.select("doc_id", P.hover_type(F.col("h")).alias("type"))


_COLORS = "SELECT p_partkey AS k, CASE WHEN p_size % 2 = 0 THEN (p_partkey * 7919) % 16777216 ELSE (p_partkey % 256) * 65793 END AS v FROM part"


@query("terminal_colors", f"""SELECT k, CAST(CASE WHEN r = g AND g = b THEN CASE WHEN r < 8 THEN 16 WHEN r > 248 THEN 231 ELSE floor((r - 8) / 247.0 * 24) + 232 END
 ELSE 16 + 36 * round(r / 51.0) + 6 * round(g / 51.0) + round(b / 51.0) END AS INT) AS color FROM (SELECT k, v // 65536 AS r, v // 256 % 256 AS g, v % 256 AS b FROM ({_COLORS}))""")
def terminal_colors(spark, sf_dir):
    c = spark.sql(_COLORS.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))
    return c.select("k", P.terminal_color(F.concat(F.lit("#"), F.lpad(F.hex(F.col("v").cast("long")), 6, "0"))).alias("color"))


@query("unresolved_calls", f"SELECT count(*) - count(target_file) AS n_unresolved, count(target_file) > 0 AS any_resolved FROM {_resolved(False)}")
def unresolved_calls(spark, sf_dir):
    r = G.resolve(*graph_inputs(spark, sf_dir))
    return r.agg(F.count_if(F.col("target_file").isNull()).alias("n_unresolved"), F.coalesce(F.bool_or(F.col("target_file").isNotNull()), F.lit(False)).alias("any_resolved"))


@query("call_edges_strict", f"SELECT src, dst FROM {_EDGES.replace(_resolved(False), _resolved(True))}")
def call_edges_strict(spark, sf_dir):
    return G.call_edges(*graph_inputs(spark, sf_dir), strict=True)


@query("definitions_to_depth", f"""SELECT w.node, w.depth, d.file, d.name, d.start_byte, d.end_byte FROM ({_bounded("src", "dst", "min(src)")}) w
JOIN (SELECT file, name, min(start_byte) AS start_byte, arg_min(end_byte, (start_byte, end_byte)) AS end_byte FROM {V_DEFS} GROUP BY file, name) d ON w.node = d.file || ':' || d.name""")
def definitions_to_depth(spark, sf_dir):
    e = G.checkpointed(edges(spark, sf_dir))
    found = G.definitions_to_depth(e, start(e), view(spark, sf_dir, "defs"), 3)
    return found.select("node", "depth", "file", "name", "start_byte", "end_byte")


_TARGETS = "SELECT DISTINCT CASE WHEN qualifier IS NULL THEN NULL ELSE file END AS file, callee AS func FROM {calls}"


@query("target_lookup", f"""SELECT t.file, t.func, CASE WHEN t.file IS NULL THEN n.file || ':' || t.func ELSE e.file || ':' || t.func END AS node FROM ({_TARGETS.replace("{calls}", V_CALLS)}) t
LEFT JOIN {_DEF1} e ON e.file = t.file AND e.name = t.func LEFT JOIN (SELECT name, min(file) AS file FROM {V_DEFS} GROUP BY name) n ON n.name = t.func""")
def target_lookup(spark, sf_dir):
    calls, _, defs = graph_inputs(spark, sf_dir)
    return G.find_nodes(spark.sql(_TARGETS, calls=calls), defs)


@query("picker_select_all", f"SELECT path FROM {V_FILES} WHERE doc_id IN (SELECT doc_id FROM labels) UNION SELECT path FROM {V_FILES} WHERE path LIKE 'en/%'")
def picker_select_all(spark, sf_dir):
    return picked_paths(spark, sf_dir).select("path").union(files(spark, sf_dir).where("path LIKE 'en/%'").select("path")).distinct()


@query("picker_unpick", f"SELECT path FROM {V_FILES} WHERE doc_id IN (SELECT doc_id FROM labels) AND path NOT LIKE 'en/%'")
def picker_unpick(spark, sf_dir):
    return picked_paths(spark, sf_dir).select("path").exceptAll(files(spark, sf_dir).where("path LIKE 'en/%'").select("path"))


@query("name_index", f"SELECT name, count(*) AS n_files, string_agg(file, ',' ORDER BY file) AS files FROM {_DEF1} GROUP BY name")
def name_index(spark, sf_dir):
    d = view(spark, sf_dir, "defs").select("file", "name").distinct().groupBy("name")
    return d.agg(F.count(F.lit(1)).alias("n_files"), F.array_join(F.array_sort(F.collect_list("file")), ",").alias("files"))


@query("compatible_extensions", f"""WITH e AS (SELECT DISTINCT {_EXT.format('file')} AS ext FROM {V_DEFS}), f AS (SELECT ext, {_FAM.format('ext')} AS fam FROM e)
SELECT a.ext, b.ext AS other FROM f a JOIN f b USING (fam)""")
def compatible_extensions(spark, sf_dir):
    e = view(spark, sf_dir, "defs").select(P.extension(F.col("file")).alias("ext")).distinct().withColumn("fam", P.family(F.col("ext")))
    return e.join(e.select(F.col("ext").alias("other"), "fam"), "fam").select("ext", "other")


@query("file_languages", f"SELECT file, CASE {_EXT.format('file')} WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' END AS language FROM (SELECT DISTINCT file FROM {V_DEFS})")
def file_languages(spark, sf_dir):
    f = view(spark, sf_dir, "defs").select("file").distinct().withColumn("ext", P.extension(F.col("file")))
    return f.join(E.registry(spark), "ext", "left").select("file", "language")


@query("import_matches", f"SELECT import_pos, callee, CASE WHEN {_EXT.format('file')} IN ('rs', 'py') THEN regexp_extract(module_path, '(\\w+)$', 1) = callee ELSE true END AS matches FROM (SELECT *, 'u' || (import_pos % 40) AS callee FROM {V_IMPORTS})")
def import_matches(spark, sf_dir):
    i = view(spark, sf_dir, "imports").withColumn("callee", F.concat(F.lit("u"), (F.col("import_pos") % 40).cast("string")))
    return i.select("import_pos", "callee", P.import_matches(F.col("module_path"), F.col("callee"), P.extension(F.col("file"))).alias("matches"))


@query("tree_lines_strict", f"""WITH s AS (SELECT path, c, lag(c) OVER (ORDER BY c) AS prev FROM {_SORTED}),
e AS (SELECT path, c, prev, unnest(range(1, len(c) + 1)) AS i FROM s),
u AS (SELECT i, count(DISTINCT c[i]) AS n FROM e GROUP BY i)
SELECT path, CAST(e.i - 1 AS INT) AS level, repeat('  ', CAST(e.i - 1 AS INT)) || CASE WHEN e.i = len(c) THEN '└── ' || c[e.i] WHEN u.n = 1 THEN '└── ' || c[e.i] || '/' ELSE '├── ' || c[e.i] || '/' END AS line
FROM e JOIN u USING (i) WHERE prev IS NULL OR c[1:e.i] <> prev[1:e.i]""")
def tree_lines_strict(spark, sf_dir):
    return K.tree_lines(files(spark, sf_dir), faithful=False)


@query("packed_xml", _packed({0: '<context name="corpus">', 1: "<tree>", 3: "</tree>~", 4: "<files>", 6: "</files>"}, _TAGGED_BLOCK, "<summary>", "</summary>~</context>"))
def packed_xml(spark, sf_dir):
    return K.document(files(spark, sf_dir), project="corpus")


_PRE = f"""(SELECT file, pos, callee, qualifier, CASE pos % 3 WHEN 0 THEN file ELSE 'src/m1/u1.py' END AS target_file, concat('fn_', CAST(pos % 750 AS VARCHAR)) AS target_name FROM {V_CALLS} WHERE pos % 5 = 0)"""
_SAME = "{0}.file = {1}.file AND {0}.pos = {1}.pos AND {0}.callee = {1}.callee AND {0}.qualifier IS NOT DISTINCT FROM {1}.qualifier"


@query("call_edges_resolved", f"""SELECT DISTINCT src, dst FROM (SELECT e.file || ':' || e.caller AS src,
 CASE WHEN p.file IS NULL THEN r.target_file || ':' || r.callee ELSE d.file || ':' || d.name END AS dst
 FROM {_ENCLOSED} e LEFT JOIN {_PRE} p ON {_SAME.format('e', 'p')} LEFT JOIN {_DEF1} d ON d.file = p.target_file AND d.name = p.target_name
 JOIN {_resolved(False)} r ON {_SAME.format('e', 'r')} WHERE e.caller IS NOT NULL) WHERE dst IS NOT NULL AND src <> dst""")
def call_edges_resolved(spark, sf_dir):
    """Some calls come resolved; those whose target isn't indexed give no edge, even where their name would."""
    calls, imports, defs = graph_inputs(spark, sf_dir)
    target = F.when(F.col("pos") % 3 == 0, F.col("file")).otherwise("src/m1/u1.py")
    known = calls.where("pos % 5 = 0").select(*G.CALL, target.alias("target_file"), F.concat(F.lit("fn_"), (F.col("pos") % 750).cast("string")).alias("target_name"))
    return G.call_edges(calls, imports, defs, resolved=known)


_REPS = f"(SELECT callee, qualifier, ext, min((file, pos)) AS c FROM (SELECT *, {_EXT.format('file')} AS ext FROM {V_CALLS}) GROUP BY callee, qualifier, ext)"


@query("lsp_fan_out", f"""SELECT c.file, c.pos, c.callee, c.qualifier, r.target_file, r.target_name FROM {V_CALLS} c LEFT JOIN (
 SELECT p.callee, p.qualifier, p.ext, d.file AS target_file, arg_min(d.name, (d.start_byte, d.name)) AS target_name
 FROM {_REPS} p JOIN {V_DEFS} d ON d.file = p.c[1] AND d.start_byte <= p.c[2] AND p.c[2] < d.end_byte WHERE p.c[2] % 4 <> 0 GROUP BY ALL) r
 ON r.callee = c.callee AND r.qualifier IS NOT DISTINCT FROM c.qualifier AND r.ext = {_EXT.format('c.file')}""")
def lsp_fan_out(spark, sf_dir):
    """Representatives are looked up, three of four with an answer, and what is found goes to all calls with their key."""
    calls, _, defs = graph_inputs(spark, sf_dir)
    asked = G.representatives(calls).where("pos % 4 <> 0").select(*G.CALL, F.col("file").alias("target"), F.col("pos").alias("at"))
    found = I.location_outcomes(asked, defs, "src/").where("outcome = 'resolved'").select("file", "pos", "callee", F.col("target").alias("target_file"), F.col("name").alias("target_name"))
    answers = asked.select(*G.CALL).join(found.distinct(), ["file", "pos", "callee"]).select(*G.CALL, "target_file", "target_name")
    return G.fan_out(calls, answers)


@query("lsp_requests", f"""SELECT server, count(*) AS n, min(file) AS first_file, max(file) AS last_file FROM (SELECT file, CASE {_EXT.format('file')} WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' END AS server
 FROM {V_CALLS} WHERE NOT contains(file, 'out/')) WHERE server IS NOT NULL GROUP BY server""")
def lsp_requests(spark, sf_dir):
    # servers follow from files: they are told of each file once, not of each call, and the tests aren't pushed down to the calls
    asked = I.requests(G.checkpointed(view(spark, sf_dir, "calls").groupBy("file").agg(F.count(F.lit(1)).alias("n"))))
    return asked.groupBy("server").agg(F.sum("n").alias("n"), F.min("file").alias("first_file"), F.max("file").alias("last_file"))


@query("hover_text", "SELECT p_partkey, p_name || chr(10) || p_brand || chr(10) || p_type AS hover FROM part")
def hover_text(spark, sf_dir):
    marked = F.array(F.struct(F.lit(None).cast("string").alias("language"), F.col("p_name").alias("value")), F.struct(F.lit("rust").alias("language"), F.col("p_brand").alias("value")), F.struct(F.lit("text").alias("language"), F.col("p_type").alias("value")))
    return table(spark, sf_dir, "part").select("p_partkey", P.hover_text(marked).alias("hover"))


@query("url_template", "SELECT s_suppkey, 'https://host/v' || s_nationkey || '/' || s_name || '/{target}.zip' AS url FROM supplier")
def url_template(spark, sf_dir):
    url = P.filled(F.lit("https://host/v{version}/{filename}/{target}.zip"), version=F.col("s_nationkey").cast("string"), filename=F.col("s_name"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", url.alias("url"))
