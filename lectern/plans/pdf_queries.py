"""Queries for documents by page: the documents table laid out as PDF files, and read back."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import keep, table
from ..sources import pdf
from .registry import query

PER_PAGE = 40


def laid_out(sheets: list[list[tuple[str, float]]], image: int = 0, packed: bool = True) -> bytes:
    """A PDF file of pages of (text, size) lines, in a font that maps its two-byte codes to UTF-16; with an image of so many bytes on the first page."""
    squeeze, flate = (lambda body: zlib.compress(body, 1), b" /Filter /FlateDecode") if packed else (bytes, b"")
    stream = lambda body, more=b"": b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(body), more, body)
    kids = b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(sheets)))
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Count %d /Kids [%s] /Resources << /Font << /F1 3 0 R >> >> >>" % (len(sheets), kids),
        3: b"<< /Type /Font /Subtype /Type0 /BaseFont /Plain /Encoding /Identity-H /ToUnicode 4 0 R >>",
        4: stream(squeeze(b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange"), flate),
        5: stream(b"\xff" * image, b" /Type /XObject /Subtype /Image /Width 1 /Height 1"),
    }
    for i, rows in enumerate(sheets):
        own = b" /Resources << /Font << /F1 3 0 R >> /XObject << /Im1 5 0 R >> >>" if image and not i else b""
        objects[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R%s >>" % (11 + 2 * i, own)
        shown = [b"BT /F1 %g Tf 1 0 0 1 50 %d Tm <%s> Tj ET" % (size, 800 - 18 * k, text.encode("utf-16-be", "replace").hex().encode()) for k, (text, size) in enumerate(rows)]
        objects[11 + 2 * i] = stream(squeeze(b"\n".join(shown)), flate)
    body = b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % item for item in objects.items())
    return body + b"trailer << /Root 1 0 R >>\n%%EOF\n"


def document_files(docs: DataFrame) -> DataFrame:
    """(path, content): each document as a file of 40 lines a page, the first of each larger; every third has an image of 4,000 or 6,000 bytes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int]]:
        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                rows = [line for line in (text or "").split("\n") if line.strip(" ")]
                sheets = [[(line, 10 if k else 14) for k, line in enumerate(rows[lo : lo + PER_PAGE])] for lo in range(0, max(1, len(rows)), PER_PAGE)]
                body = laid_out(sheets, 0 if doc % 3 else 4000 + 2000 * (doc % 2))
                yield (str(doc), body), len(body)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in pdf.gathered(each(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.binary()), strict=True)], names=["path", "content"])

    return docs.select("doc_id", "text").mapInArrow(lay, "path string, content binary")


@query(
    f"""WITH l AS (SELECT doc_id, trim(u.line) AS line, u.ord FROM documents, unnest(string_split(coalesce(text, ''), chr(10))) WITH ORDINALITY AS u(line, ord) WHERE trim(u.line) <> ''),
    n AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM l),
    t AS (SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE k % {PER_PAGE} = 0 AND k + 1 < n) AS BIGINT) AS n_headings, md5(string_agg(line, chr(10) ORDER BY k)) AS digest FROM n GROUP BY doc_id)
    SELECT d.doc_id, CAST(greatest(1, ceil(coalesce(n_lines, 0) / {PER_PAGE}.0)) AS INTEGER) AS n_pages, CAST(CASE WHEN d.doc_id % 6 = 3 THEN 1 ELSE 0 END AS BIGINT) AS n_figures, coalesce(n_lines, 0) AS n_lines, coalesce(n_headings, 0) AS n_headings, coalesce(digest, md5('')) AS digest FROM documents d LEFT JOIN t USING (doc_id)"""
)
def pdf_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-2 / SRC-3 / SRC-4: every document as a PDF file, read back by page: counts, headings, figures and the lines' digest."""
    sheets = pdf.pages(document_files(table(spark, sf_dir, "documents")))
    sheets = keep(sheets.withColumn("images", F.transform("images", lambda x: F.struct(x["ord"], x["n_bytes"]))))  # read twice; its pictures are only counted
    rows = keep(pdf.lines(pdf.spans(sheets)))
    said = rows.groupBy("path").agg(F.md5(F.array_join(F.array_sort(F.collect_list(F.struct("page", "line", "text")))["text"], "\n")).alias("digest"))
    stats = pdf.document_stats(sheets, rows).join(said, "path", "left")
    return stats.select(F.col("path").cast("long").alias("doc_id"), "n_pages", "n_figures", "n_lines", "n_headings", F.coalesce("digest", F.md5(F.lit(""))).alias("digest"))
