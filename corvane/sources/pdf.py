"""A plain PDF of a document's lines as a table of its own lines: A4 pages in Helvetica.

Line and page numbers are running totals over the document's pieces, and so are the places of objects over the pages; tasks write
the parts of the file, which put together are the PDF. Every line is ASCII: texts are written in hexadecimal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.pack import order
from corvane.operators.placing import running

WIDTH, HEIGHT, MARGIN, FONT, LEADING = 595, 842, 40, 9, 12
PER_PAGE = (HEIGHT - 2 * MARGIN) // LEADING
#: Characters of a line at most; longer ones go on in the next, so that no text is lost.
PER_LINE = 110
_HEAD = ["%PDF-1.4", "3 0 obj", "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>", "endobj"]


def printed(text: Column) -> Column:
    """The lines that a piece of text takes on paper: tabs are four spaces, long lines are cut."""
    lines = F.split(F.replace(text, F.lit("\t"), F.lit("    ")), "\r?\n")
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length(x) - 1, F.lit(0)) / PER_LINE).cast("int")), lambda k: F.substring(x, k * PER_LINE + 1, F.lit(PER_LINE)))
    return F.flatten(F.transform(lines, cut))


def pages(pieces: DataFrame) -> DataFrame:
    """section, path, ord, first_line, n_lines, first_page, last_page of each piece of a document (pack.document), counted from 0.
    A null line takes none."""
    n = F.coalesce(F.size(F.when(F.col("line").isNotNull(), printed(F.col("line")))), F.lit(0))
    counted = pieces.select("section", "path", "ord", "line", F.greatest(n, F.lit(0)).alias("n_lines"))
    placed = running(counted, order(), {"first_line": F.col("n_lines")})
    last = F.col("first_line") + F.greatest(F.col("n_lines") - 1, F.lit(0))
    return placed.select("section", "path", "ord", "line", "first_line", F.col("n_lines").cast("long").alias("n_lines"), F.floor(F.col("first_line") / PER_PAGE).alias("first_page"), F.floor(last / PER_PAGE).alias("last_page"))


def document(pieces: DataFrame) -> DataFrame:
    """part, ord, text: the lines of a PDF of the pieces, in this order. Characters outside Latin-1 become question marks."""
    spark = pieces.sparkSession
    # a line's letters as two digits each; what isn't a letter of Latin-1 is written as one that is
    latin = F.regexp_replace("shown", r"[^\x20-\x7E -ÿ]", "?")
    lines = pages(pieces).where("n_lines > 0").select("first_line", F.posexplode(printed(F.col("line"))).alias("_i", "shown"))
    lines = lines.select((F.col("first_line") + F.col("_i")).alias("n"), F.concat(F.lit("<"), F.hex(F.encode(latin, "ISO-8859-1")), F.lit("> '")).alias("shown"))
    # a page has PER_PAGE lines at most
    page = lines.groupBy(F.floor(F.col("n") / PER_PAGE).alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "shown"))), lambda x: x["shown"]), "\n").alias("shown"))
    body = F.concat(F.lit(f"BT /F1 {FONT} Tf {LEADING} TL {MARGIN} {HEIGHT - MARGIN} Td\n"), "shown", F.lit("\nET"))
    number = F.col("page") * 2 + 4
    stream = F.concat(number.cast("string"), F.lit(" 0 obj\n<< /Length "), F.length("body").cast("string"), F.lit(" >>\nstream\n"), "body", F.lit("\nendstream\nendobj"))
    sheet = F.concat((number + 1).cast("string"), F.lit(f" 0 obj\n<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {WIDTH} {HEIGHT}] /Contents "), number.cast("string"), F.lit(" 0 R /Resources << /Font << /F1 3 0 R >> >> >>\nendobj"))
    made = page.select("page", body.alias("body")).select("page", stream.alias("stream"), sheet.alias("sheet"))
    head = sum(len(x) + 1 for x in _HEAD)
    placed = running(made, [F.col("page")], {"at": F.length("stream") + F.length("sheet") + 2}).withColumn("at", F.col("at") + head)
    kid = F.concat((number + 1).cast("string"), F.lit(" 0 R"))
    # one row: where the pages end, and how much their list takes
    size = placed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("stream") + F.length("sheet") + 2), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.length(kid) + 1), F.lit(0)).alias("kids"))
    size = size.withColumn("list", F.concat(F.lit("2 0 obj\n<< /Type /Pages /Count "), F.col("n").cast("string"), F.lit(" /Kids [")))
    size = size.withColumns({"list_at": F.col("bytes") + head, "root_at": F.col("bytes") + head + F.length("list") + 1 + F.col("kids") + len("] >>\nendobj\n")})
    root = "1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj"
    entry = lambda at: F.concat(F.lpad(at.cast("string"), 10, "0"), F.lit(" 00000 n "))
    xref_at = F.col("root_at") + len(root) + 1
    tail = F.concat(F.lit("trailer\n<< /Size "), (F.col("n") * 2 + 4).cast("string"), F.lit(" /Root 1 0 R >>\nstartxref\n"), xref_at.cast("string"), F.lit("\n%%EOF"))
    row = lambda part, at, text: F.struct(F.lit(part).alias("part"), (F.lit(at).cast("long") if isinstance(at, int) else at).alias("ord"), text.alias("text"))
    total = (F.col("n") * 2 + 4).cast("string")
    last = [F.lit("] >>\nendobj"), F.lit(root), F.concat(F.lit("xref\n0 "), total), F.lit("0000000000 65535 f "), entry(F.col("root_at")), entry(F.col("list_at")), entry(F.lit(len(_HEAD[0]) + 1))]
    fixed = F.array(*[row(0, i, F.lit(x)) for i, x in enumerate(_HEAD)], row(2, 0, F.col("list")), *[row(4, i, x) for i, x in enumerate(last)], row(6, 0, tail))
    p = F.col("page").cast("long")
    entries = F.concat(entry(F.col("at")), F.lit("\n"), entry(F.col("at") + F.length("stream") + 1))
    own = F.array(row(1, p, F.concat("stream", F.lit("\n"), "sheet")), row(3, p, kid), row(5, p, entries))
    return size.select(F.inline(fixed)).unionByName(placed.select(F.inline(own)))


def write(pieces: DataFrame, folder: str) -> None:
    """The PDF in parts (text files of a folder), in the order of their names."""
    document(pieces).orderBy("part", "ord").select("text").write.mode("overwrite").text(folder)


def put_together(spark: SparkSession, folder: str, path: str) -> None:
    """Parts of a folder, in the order of their names, as one local file; bytes pass through in small pieces."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted(s.getPath().toString() for s in files.listStatus(place) if s.getPath().getName().startswith("part-"))
    out = spark._jvm.java.io.FileOutputStream(path)
    try:
        for part in parts:
            stream = files.open(spark._jvm.org.apache.hadoop.fs.Path(part))
            spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 65536, False)
            stream.close()
    finally:
        out.close()
