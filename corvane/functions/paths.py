"""Column functions over paths, URLs and import strings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories skipped when calls are resolved by a language server.
SKIPPED_FOR_SERVERS = [
    "vendor/", "vendors/", "third_party/", "third-party/", "thirdparty/", "external/", "externals/", "deps/",
    "node_modules/", ".git/", "dist/", "build/", "out/", "__pycache__/",
]
# Language id by extension.
LANGUAGE_IDS = {
    "rust": ["rs"], "typescript": ["ts", "tsx", "mts", "cts"], "javascript": ["js", "jsx", "mjs", "cjs"], "python": ["py", "pyi"],
    "go": ["go"], "c": ["c", "h"], "cpp": ["cpp", "cc", "cxx", "hpp", "hxx"], "java": ["java"], "zig": ["zig"],
    "shellscript": ["sh", "bash"], "scala": ["scala", "sc"],
}
# Extensions of one family can define each other's names.
FAMILIES = {
    "js": ["ts", "tsx", "js", "jsx", "mjs", "cjs"],
    "c": ["c", "cpp", "cc", "cxx", "h", "hpp", "hxx"],
    "scala": ["scala", "sc"],
}


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """After the last dot of the name; '' if there is none or it only begins the name."""
    return F.regexp_extract(base_name(path), r"^.+\.([^.]*)$", 1)


def family(ext: Column) -> Column:
    out = F.concat(F.lit("="), ext)
    for name, members in FAMILIES.items():
        out = F.when(ext.isin(members), F.lit(name)).otherwise(out)
    return out


def language_id(ext: Column) -> Column:
    out = F.lit("text")
    for name, members in LANGUAGE_IDS.items():
        out = F.when(ext.isin(members), F.lit(name)).otherwise(out)
    return out


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def is_hidden(path: Column) -> Column:
    """Some component starts with a dot."""
    return path.rlike(r"(^|/)\.")


def skipped_for_servers(path: Column) -> Column:
    return reduce(lambda a, b: a | b, [path.contains(d) for d in SKIPPED_FOR_SERVERS])


def is_declaration(uri: Column) -> Column:
    return uri.rlike(r"\.d\.(ts|mts|cts)$") | uri.rlike(r"\.(h|hpp|hxx|hh)$")


def target_file(target: Column) -> Column:
    """What stands before the last colon; null if nothing does."""
    return F.nullif(F.regexp_extract(target, r"(?s)^(.*):[^:]*$", 1), F.lit(""))


def target_function(target: Column) -> Column:
    return F.regexp_extract(target, r"(?s)([^:]*)$", 1)


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def clean_import(path: Column) -> Column:
    for q in ('"', "'", "`"):
        path = F.regexp_replace(path, f"^{q}+|{q}+$", "")
    return path


def repo_name(url: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(url, "/"), -1), r"(\.git)+$", "")


def is_git_url(url: Column) -> Column:
    """A URL on a known host and not of a raw file, or with the git scheme, or that ends in .git."""
    parsed = url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    known = reduce(lambda a, b: a | b, [host.contains(h) for h in ("github.com", "gitlab.com", "bitbucket.org", "dev.azure.com")])
    return parsed & (url.startswith("git:") | url.endswith(".git") | (known & ~url.contains("/raw/")))


def interpreter(text: Column) -> Column:
    """The program that a script's first line names, without its path and minor version; null without one.

    A second line that calls exec names it instead; env's options and assignments are passed over; names of one letter don't count."""
    line = F.regexp_extract(text, r"^#!\s*([^\r\n]*)", 1)
    second = F.regexp_extract(text, r"^#![^\n]*\n([^\r\n]*)", 1)
    words = F.filter(F.split(line, r"\s+"), lambda w: w != "")
    program = F.regexp_replace(F.get(words, F.lit(0)), r"^.*/", "")
    after_env = F.get(F.filter(F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda w: ~w.startswith("-") & ~w.contains("=")), F.lit(0))
    named = F.when(program == "env", F.regexp_replace(after_env, r"^.*/", "")).otherwise(program)
    called = F.regexp_extract(second, r"(?:^|\s)exec\s+(\S+)", 1)
    name = F.when(~text.startswith("#!"), F.lit(None)).when(called != "", called).otherwise(named)
    short = F.regexp_replace(name, r"^([^0-9]*[0-9][^.]*)\..*$", "$1")
    return F.when(F.length(short) > 1, short)


def suffixes(path: Column) -> Column:
    """All suffixes of whole components, longest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def import_candidates(module: Column, ext: Column) -> Column:
    """File paths that an import may mean, best first."""
    m = F.regexp_replace(F.regexp_replace(module, "^[\"'<> ]+", ""), "[\"'<> ]+$", "")
    each = lambda stem, *forms: F.array(*[F.concat(F.lit(a), stem, F.lit(b)) for a, b in forms])
    rust = F.replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(m, "^(crate::)+", ""), "^(self::)+", ""), "^(super::)+", ""), F.lit("::"), F.lit("/"))
    dotted = F.replace(m, F.lit("."), F.lit("/"))
    go = F.when(F.split(m, "/")[0].contains(".") & (F.size(F.split(m, "/")) >= 3), F.array_join(F.slice(F.split(m, "/"), F.lit(4), F.size(F.split(m, "/"))), "/")).otherwise(m)
    script = m
    for prefix in (r"\./", r"\.\./", "@/", "@"):
        script = F.regexp_replace(script, f"^({prefix})+", "")
    scala = F.replace(F.regexp_replace(m, r"(\._|\.\*)+$", ""), F.lit("."), F.lit("/"))
    zig = F.when(m.contains(".zig") | m.contains("/"), each(m, ("", ""), ("src/", ""))).otherwise(each(m, ("", ".zig"), ("src/", ".zig")))
    return (
        F.when(ext == "rs", each(rust, ("", ".rs"), ("", "/mod.rs"), ("src/", ".rs"), ("src/", "/mod.rs")))
        .when((ext == "py") & m.startswith("."), F.array().cast("array<string>"))
        .when(ext == "py", each(dotted, ("", ".py"), ("", "/__init__.py"), ("src/", ".py")))
        .when(ext == "go", F.array(go))
        .when(ext.isin("ts", "tsx", "js", "jsx", "mjs", "cjs"), each(script, ("", ".ts"), ("", ".tsx"), ("", ".js"), ("", "/index.ts"), ("", "/index.tsx"), ("", "/index.js")))
        .when(ext == "java", each(dotted, ("", ".java"), ("src/", ".java"), ("src/main/java/", ".java")))
        .when(ext.isin("scala", "sc"), each(scala, ("", ".scala"), ("", ".sc")))
        .when(ext.isin("c", "cpp", "cc", "cxx", "h", "hpp", "hxx"), each(m, ("", ""), ("include/", ""), ("src/", "")))
        .when(ext == "zig", zig)
        .otherwise(F.array(m))
    )


def import_matches(module: Column, callee: Column, ext: Column) -> Column:
    """Whether an import can bring in the callee: its last segment, where the language names what it imports."""
    last = lambda sep: F.element_at(F.split(module, sep), -1)
    return (
        F.when(ext == "rs", last("::") == callee)
        .when(ext == "py", last(r"\.") == callee)
        .when(ext == "go", last("/") == callee)
        .when(ext.isin("java", "scala", "sc"), last(r"\.").isin("*", "_") | (last(r"\.") == callee))
        .otherwise(F.lit(True))
    )


def relative(path: Column, base: Column) -> Column:
    """path below base; paths elsewhere stay as they are."""
    return F.when(path.startswith(F.concat(base, F.lit("/"))), F.substring(path, F.length(base) + 2, F.length(path))).otherwise(path)


def hover_type(hover: Column) -> Column:
    """The declared type of the first line that is no function: between colon and equals sign of a let or const, else the
    whole line; the first line if all are functions, null for a blank text."""
    strip = lambda x: F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    lines = F.transform(F.split(strip(hover), "\n"), strip)
    line = F.coalesce(F.get(F.filter(lines, lambda x: ~x.rlike("^(fn|def) ")), F.lit(0)), F.get(lines, F.lit(0)))
    declared = strip(F.regexp_extract(line, r"^(?:let|const) [^:]*:([^=]*)", 1))
    return F.when(strip(hover) != "", F.when(line.rlike("^(let|const) [^:]*:"), declared).otherwise(line))


def hover_text(parts: Column) -> Column:
    """The values of marked strings (array of structs with value), a line each."""
    return F.array_join(F.transform(parts, lambda x: x["value"]), "\n")


def filled(template: Column, **values: Column) -> Column:
    """A URL template with each {name} replaced by its value; names without a value stay."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def terminal_color(code: Column) -> Column:
    """The 256-colour number nearest a hexadecimal colour: the grey ramp for greys, else the 6 x 6 x 6 cube; null unless six digits."""
    digits = F.regexp_extract(code, "^#*([0-9A-Fa-f]{6})$", 1)
    r, g, b = (F.conv(F.substring(digits, i, 2), 16, 10).cast("int") for i in (1, 3, 5))
    grey = F.when(r < 8, 16).when(r > 248, 231).otherwise(F.floor((r - 8) / 247 * 24) + 232)
    step = lambda x: F.round(x / 51)
    return F.when(digits != "", F.when((r == g) & (g == b), grey).otherwise(16 + 36 * step(r) + 6 * step(g) + step(b)).cast("int"))


def signature(hover: Column) -> Column:
    """First line that starts a function or has an arrow, else the first line."""
    lines = F.transform(F.split(hover, "\n"), lambda x: F.trim(x))
    found = F.filter(lines, lambda x: x.rlike(r"^(pub )?(async )?fn |^(def|function|func) |->|=>"))
    return F.when(hover != "", F.coalesce(F.get(found, F.lit(0)), F.get(lines, F.lit(0))))


def call_column(line: Column, callee: str) -> Column:
    """Bytes before the first occurrence of callee in its line; 0 if there is none."""
    at = F.instr(line, callee)
    return F.when(at > 0, F.octet_length(F.substring(line, F.lit(1), at - 1))).otherwise(0).cast("int")


def shortened(path: Column, width: int) -> Column:
    """A path that fits a terminal of so many letters beside 25 others (in bytes), or its last two components behind an ellipsis;
    one of at most two components, of which a leading '/' is one, stays."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    n = F.size(parts) + F.when(F.startswith(path, F.lit("/")), 1).otherwise(0)
    short = F.concat(F.lit(".../"), F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(""), F.lit("/"), F.element_at(parts, -1))
    return F.when((F.octet_length(path) <= max(0, width - 25)) | (n <= 2), path).otherwise(short)
