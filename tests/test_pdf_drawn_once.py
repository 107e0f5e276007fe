"""Documents by page: a page is drawn once and a file read once, whatever is asked of them."""

from lectern.plans import pdf_queries as Q
from lectern.plans.pdf_queries import laid_out
from lectern.sources import pdf


def test_pages_are_drawn_once(spark):
    drawn = spark.sparkContext.accumulator(0)
    sheets = pdf.pages(spark.createDataFrame([("a", laid_out([[("x", 14), ("y", 10), ("z", 10)], [("w", 9)]]))], "path string, content binary"))
    draw = pdf.spans(sheets)

    def counted(batches):
        for batch in batches:
            drawn.add(batch.num_rows)
            yield batch

    spans = draw.mapInArrow(counted, draw.schema)
    assert sorted((r.page, r.text, r.heading) for r in pdf.lines(spans).collect()) == [(1, "x", True), (1, "y", False), (1, "z", False), (2, "w", False)]
    assert drawn.value == 4


def test_files_are_read_once(spark, tmp_path, monkeypatch):
    made, files = spark.sparkContext.accumulator(0), Q.document_files

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(Q, "document_files", lambda docs: files(docs).mapInArrow(counted, "path string, content binary"))
    rows = [(i, "\n".join(f"line {k} é" for k in range(i * 30))) for i in range(4)] + [(4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_pages, r.n_figures, r.n_lines, r.n_headings) for r in Q.pdf_documents(spark, str(tmp_path)).collect()}
    assert got == {0: (1, 0, 0, 0), 1: (1, 0, 30, 1), 2: (2, 0, 60, 2), 3: (3, 1, 90, 3), 4: (1, 0, 0, 0)}
    assert made.value == 5


def test_body_size_is_the_most_frequent_of_the_page(spark):
    """Blank spans do not count, ties go to the smaller size, a page of one size has no heading."""
    rows = [("a", 1, i, i, t, s, False) for i, (t, s) in enumerate([(" ", 30.0)] * 5 + [("p", 8.0), ("q", 10.0)])] + [("a", 2, 0, 0, "r", 10.0, False), ("b", 1, 0, 0, "r", 12.5, False)]
    got = {(r.path, r.text): r.heading for r in pdf.lines(spark.createDataFrame(rows, pdf.SPANS)).collect()}
    assert got == {("a", "p"): False, ("a", "q"): True, ("a", "r"): False, ("b", "r"): False}


def test_codes_beside_maps_and_odd_bytes():
    cmap = b"1 beginbfchar <41> <0078> endbfchar 1 beginbfrange <0010> <0011> <D83D> endbfrange 1 beginbfrange <0020> <0020> <DE00> endbfrange"
    wide, narrow = ({"map": cmap, "wide": w, "names": []} for w in (True, False))
    assert pdf.decoder(wide)(b"\x00\x10\x00\x20\x00\x41\x41") == "\U0001f600xx"
    assert pdf.decoder(narrow)(b"A\x10\x20\xff") == "x\U0001f600�"
