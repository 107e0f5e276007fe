"""Queries that SQL cannot say on every text, against Python's regular expressions on small tables."""

import re

from lectern.functions import text as X
from lectern.plans import QUERIES

DOCS = ["at 25°C here", "it cost €25 only", "from 25–30 on", "five µm wide", "10 µm wide", "no unit", "é25 and 25é", "“Table 3” and Tab. 4, see éTable 5", "Table IV, Table 3é", "The 7–8", "", None, "h’s", "größe nm"]  # but not "nm²": Python reads ² as a part of a word, Java as none
TURNS = ["“What is the cause of it?”", "—which part is it", "éwhich part is it", "what is the größe of x", "«by which way»", "plain words", None]


def test_unmasked_texts(spark, tmp_path):
    spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, t) for i, t in enumerate(TURNS)], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.doc_id: (r.has_number, r.has_unit) for r in QUERIES["numeric_unit_flags"](spark, str(tmp_path)).collect()}
    assert got == {i: (bool(re.search(X.NUMERIC, t or "")), bool(re.search(X.UNIT, t or "", re.I))) for i, t in enumerate(DOCS)}
    assert got[0] == (True, True) and got[1][0] and got[2][0] and got[3][1]
    got = {r.doc_id: r.n_tables for r in QUERIES["table_label_count"](spark, str(tmp_path)).collect()}
    assert got == {i: len(set(re.findall(X.TABLE_LABEL, (t or "").replace("The ", "Table ")))) for i, t in enumerate(DOCS)}
    got = {r.conv_id: r.has_phrase for r in QUERIES["triple_phrase_flags"](spark, str(tmp_path)).collect()}
    assert got == {i: any(re.search(p, t or "", re.I) for p in X.TRIPLE_PHRASES) for i, t in enumerate(TURNS)}
    assert got[0] and got[1] and not got[2]
