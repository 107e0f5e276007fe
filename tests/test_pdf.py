"""Documents by page: small PDF files made here, read back span by span."""

import zlib

from lectern.plans.pdf_queries import laid_out
from lectern.sources import files, pdf


def stream(body: bytes, more: bytes = b"") -> bytes:
    return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(body), more, body)


def made(content: bytes, fonts: bytes, others: dict[int, bytes] | None = None, xobjects: bytes = b"") -> bytes:
    """A file of one page; fonts are entries of its font dictionary, others further objects from 10 on."""
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << %s >> /XObject << %s >> >> >>" % (fonts, xobjects),
        3: b"<< /Type /Page /Parent 2 0 R /Contents [4 0 R] >>",
        4: stream(content),
    } | (others or {})
    return b"%PDF-1.4\n" + b"\n".join(b"%d 0 obj %s endobj" % item for item in objects.items()) + b"\ntrailer << /Root 1 0 R >>"


PLAIN = b"/F1 << /Type /Font /Subtype /Type1 /BaseFont /Times >> /F2 << /Type /Font /Subtype /Type1 /BaseFont /Times-Bold >>"


def drawn(body: bytes) -> list[tuple[str, float, bool]]:
    document = pdf.Document(body)
    node, held = document.pages()[0]
    return [row[:3] for row in pdf.draw(document.parts(b"\n".join(map(document.stream, node["/Contents"])), held))]


def test_strings_sizes_and_fonts():
    content = rb"""q 2 0 0 2 0 0 cm BT /F2 6 Tf 10 300 Td (A \(nested (pair)\) \101\
B) Tj ET Q BT /F1 10 Tf 14 TL 10 200 Td [(wi) -20 (de) -300 (gap)] TJ T* <48 69> Tj (next) ' ET % (a comment) Tj
BI /W 1 /H 1 ID (no Tj) EI BT /F1 8 Tf (tail) Tj ET"""
    assert drawn(made(content, PLAIN)) == [("A (nested (pair)) AB", 12.0, True), ("wide gap", 10.0, False), ("Hi", 10.0, False), ("next", 10.0, False), ("tail", 8.0, False)]


def test_glyph_names_maps_and_unknown_codes():
    fonts = b"/F1 << /Type /Font /Subtype /Type1 /Encoding << /Differences [1 /fi /degree 65 /uni03B1] >> >> /F2 << /Type /Font /Subtype /Type0 /ToUnicode 10 0 R >> /F3 << /Type /Font /Subtype /Type0 >>"
    cmap = b"2 beginbfchar <0001> <00660066> <0002> <D83DDE00> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<0078> <0079>] endbfrange"
    content = rb"BT /F1 9 Tf (\001x\002A) Tj /F2 9 Tf <00010002001200210099> Tj /F3 9 Tf <0001> Tj ET"
    got = [t for t, *_ in drawn(made(content, fonts, {10: stream(zlib.compress(cmap), b"/Filter /FlateDecode")}))]
    assert got == ["fix°α", "ff\U0001f600cy�", "�"]


def test_forms_inherit_and_do_not_loop():
    form = stream(b"BT /F1 5 Tf (label) Tj ET /Me Do", b"/Type /XObject /Subtype /Form /Matrix [2 0 0 2 0 0] /Resources << /Font << %s >> /XObject << /Me 10 0 R >> >>" % PLAIN)
    assert drawn(made(b"/Fm1 Do", PLAIN, {10: form}, b"/Fm1 10 0 R"))[0] == ("label", 10.0, False)


def test_objects_in_streams_and_later_definitions():
    inner = b"5 0 << /Type /Font /Subtype /Type1 /BaseFont /A-Bold >>"
    head = inner.index(b"<<")
    packed = stream(zlib.compress(inner), b"/Type /ObjStm /N 1 /First %d /Filter /FlateDecode" % head)
    body = made(b"BT /F1 9 Tf (old) Tj ET", b"/F1 5 0 R", {10: packed})
    assert drawn(body) == [("old", 9.0, True)]
    assert drawn(body + b"\n4 0 obj " + stream(b"BT /F1 7 Tf (new) Tj ET") + b" endobj") == [("new", 7.0, True)]


def test_page_trees_with_loops_and_inline_nodes():
    body = made(b"BT /F1 9 Tf (x) Tj ET", PLAIN, {2: b"<< /Type /Pages /Kids [3 0 R 2 0 R << /Kids [3 0 R << /Type /Page /Contents 4 0 R >>] >>] >>"})
    assert len(pdf.Document(body).pages()) == 2


def test_headings_figures_and_captions(spark):
    lines = [("Title", 14), ("Table 1 and TABLE II", 10), ("more é 日本 \U0001f600", 10)]
    body = laid_out([lines, [], [("only", 20)]], image=6000)
    small = laid_out([[("x", 10), ("bit larger", 11.5)]], image=4999, packed=False)
    rows = spark.createDataFrame([("a", body), ("b", small), ("broken", b"text"), ("none", None), ("locked", body + b"/Encrypt 9 0 R")], "path string, content binary").withColumn("page", pdf.F.lit(7))
    sheets = pdf.pages(rows)
    assert {r.path: r.error for r in sheets.where("page is null").collect()} == {"broken": "not a PDF file", "none": "not a PDF file", "locked": "encrypted"}
    found = pdf.lines(pdf.spans(sheets))
    assert sorted((r.path, r.page, r.text, r.heading) for r in found.collect()) == sorted([("a", 1, "Title", True), *[("a", 1, t, False) for t, _ in lines[1:]], ("a", 3, "only", False), ("b", 1, "x", False), ("b", 1, "bit larger", False)])
    assert {r.path: r[1:] for r in pdf.document_stats(sheets, found).collect()} == {"a": (3, 1, round(len(body) / 1024, 1), 4, 1, 2), "b": (1, 0, round(len(small) / 1024, 1), 2, 0, 0)}
    shown = pdf.figures(sheets)
    assert [(r.path, r.page, r.ord, r.n_bytes, bytes(r.content)) for r in shown.collect()] == [("a", 1, 1, 6000, b"\xff" * 6000)]
    said = shown.select("path", "page", "ord", pdf.F.lit("a curve").alias("caption"))
    marked = {(r.path, r.page): r.markdown for r in pdf.page_markdown(found, said).collect()}
    assert marked["a", 1].endswith("\n\n\n[Figure — Page 1, Fig 1: a curve]\n") and "## Title\n\nTable 1" in marked["a", 1]
    without = {(r.path, r.page): r.markdown for r in pdf.page_markdown(found, said.withColumn("caption", pdf.F.lit(None).cast("string"))).collect()}
    assert "[Figure — Page 1, Fig 1: (caption unavailable)]" in without["a", 1]
    assert pdf.lines(pdf.spans(pdf.pages(rows.limit(0)))).count() == 0


def test_a_long_document_is_many_tasks(spark):
    """One file of 300 pages: its pages are drawn in several tasks, and none is lost."""
    body = laid_out([[(f"page {i} line {k}", 10) for k in range(5)] for i in range(300)])
    rows = pdf.spans(pdf.pages(spark.createDataFrame([("long", body)], "path string, content binary")))
    per_task = [r["count"] for r in rows.groupBy(pdf.F.spark_partition_id()).count().collect()]
    assert sum(per_task) == 1500 and len(per_task) > 4 and max(per_task) < 700


def test_folder(spark, tmp_path):
    (tmp_path / "one.PDF").write_bytes(laid_out([[("first", 10), ("second", 10)], [("third", 10)]]))
    (tmp_path / "bad.pdf").write_bytes(b"%PDF-1.4 nothing")
    (tmp_path / "note.txt").write_text("no")
    assert [(r.text, r.page) for r in pdf.lines(pdf.spans(pdf.read(spark, str(tmp_path)))).orderBy("page", "line").collect()] == [("first", 1), ("second", 1), ("third", 2)]
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.n_pages, r.error) for r in files.read_texts(spark, str(tmp_path)).collect()}
    assert got["one.PDF"] == ("first\nsecond\nthird", 2, None) and got["note.txt"][0] == "no"


def test_rich_text_on_the_command_line(spark, tmp_path, capsys):
    from lectern.__main__ import main

    path = tmp_path / "paper.pdf"
    path.write_bytes(laid_out([[("Head", 14), ("one", 10), ("two", 10)], [("three", 10)]], image=9000))
    assert main(["rich-text", str(path)]) == 0
    assert capsys.readouterr().out == "\n## Head\n\none\ntwo\n\n\n[Figure — Page 1, Fig 1: (caption unavailable)]\n\n\nthree\n\n"
    assert main(["rich-text", "--no-figures", str(path)]) == 0
    assert capsys.readouterr().out == "\n## Head\n\none\ntwo\n\nthree\n\n"
    path.write_bytes(b"%PDF-1.4 /Encrypt 1 0 R")
    assert main(["rich-text", str(path)]) == 0
    assert "encrypted" in capsys.readouterr().err
