"""Documents and PDFs that tasks write in parts."""

import re

import pytest

from corvane.operators import pack, placing
from corvane.sources import pdf

FILES = [("b/x.py", "one\n\ttwo (\\)\r\né漢 end"), ("a-b/z", "x" * 250), ("a/x/f1", "\n".join(f"line {i}" for i in range(200))), ("empty", ""), ("none", None)]


@pytest.fixture
def pieces(spark):
    files = spark.createDataFrame([(p, t, None if t is None else len(t)) for p, t in FILES], "path string, content string, size long")
    return pack.document(files)


def text_of(pieces) -> str:
    rows = pieces.where("line IS NOT NULL").orderBy(*pack.order()).collect()
    return "".join(r.line + "\n" for r in rows)


def test_parts_put_together_are_the_document(spark, pieces, tmp_path):
    pack.write(pieces.repartition(5), f"file://{tmp_path}/parts")
    pdf.put_together(spark, f"file://{tmp_path}/parts", f"{tmp_path}/whole")
    assert (tmp_path / "whole").read_bytes().decode() == text_of(pieces)


def test_running_totals(spark):
    rows = [(i % 7, f"k{i:03}", None if i % 5 == 0 else i) for i in range(300)] + [(3, "k003", 9)] * 4
    df = spark.createDataFrame(rows, "a int, k string, n long").repartition(6)
    got = sorted(map(tuple, placing.running(df, [df["a"], df["k"]], {"at": df["n"]}, ranges=5).collect()), key=lambda r: (r[0], r[1], r[3]))
    at = 0
    for a, k, n, before in got:
        assert before == at
        at += n or 0
    assert len(got) == len(rows) and placing.running(df.where("false"), [df["a"]], {"at": df["n"]}).count() == 0


def test_pdf(spark, pieces, tmp_path):
    pdf.write(pieces, f"file://{tmp_path}/parts")
    pdf.put_together(spark, f"file://{tmp_path}/parts", f"{tmp_path}/a.pdf")
    data = (tmp_path / "a.pdf").read_bytes()
    start = int(data.split(b"startxref\n")[1].split()[0])
    lines = data[start:].split(b"\n")
    n = int(lines[1].split()[1])
    assert data.startswith(b"%PDF-1.4") and lines[0] == b"xref" and data.endswith(b"%%EOF\n")
    for number in range(1, n):  # each entry is 20 bytes and leads to its object
        entry = lines[2 + number] + b"\n"
        assert len(entry) == 20 and data[int(entry[:10]) :].startswith(b"%d 0 obj\n" % number)
    for length, body in re.findall(rb"<< /Length (\d+) >>\nstream\n(.*?)\nendstream", data, re.S):
        assert int(length) == len(body)
    streams = re.findall(rb"<< /Length \d+ >>\nstream\n(.*?)\nendstream", data, re.S)
    shown = [bytes.fromhex(x.decode()).decode("latin-1") for s in streams for x in re.findall(rb"<([0-9A-F]*)> '", s)]
    want = []
    for line in text_of(pieces)[:-1].split("\n"):
        line = line.replace("\t", "    ").rstrip("\r")
        want += [line[at : at + pdf.PER_LINE] for at in range(0, max(1, len(line)), pdf.PER_LINE)]
    assert shown == [re.sub(r"[^\x20-\x7e\xa0-\xff]", "?", x) for x in want]
    assert len(streams) == -(-len(want) // pdf.PER_PAGE) == int(re.search(rb"/Count (\d+)", data)[1]) and n == 2 * len(streams) + 4
    assert data.count(b"/Type /Page ") == len(streams)


def test_pages_of_an_empty_document(spark):
    files = spark.createDataFrame([], "path string, content string, size long")
    got = pdf.pages(pack.document(files)).collect()
    assert {r.first_page for r in got} == {0} and sum(r.n_lines for r in got) == len(text_of(pack.document(files))[:-1].split("\n"))
