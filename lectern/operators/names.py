"""Many names in many texts: which names of a paper its texts contain, and which texts contain one.

A paper's entries and its texts meet in groups of bounded size: texts are dealt to slices of about SLICE characters, entries to chunks of
about CHUNK, both by hash, and each (paper, slice, chunk) is one group, so a paper that holds a third of all rows is many tasks and an
ordinary one is a single group. In a group one Aho-Corasick automaton of the chunk's names runs over each text once, so the work is the
texts' length and not texts times names. What a group has found is reduced there; only hits leave it.

An entry (a, b, c) is found in a text that contains a, and b or c. A single name is (name, name, null).

Defined cases: names and texts are compared as they are given (see `text.norm`); an empty name is in every text; a null a is in none, a
null b or c is not there; null texts contain nothing; rows without a paper take no part; repeated entries and texts count once and
each; empty tables give no rows.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE = 4 << 20  # characters of texts in a group
CHUNK = 20_000  # entries in a group
SALTS = 16


def single(names: DataFrame) -> DataFrame:
    """Entries of names(paper, name)."""
    return names.select("paper", F.col("name").alias("a"), F.col("name").alias("b"), F.lit(None).cast("string").alias("c"))


def _dealt(rows: DataFrame, parts: DataFrame, own: str, other: str, by: Column) -> DataFrame:
    """rows, each in its own part of its paper and once for each part of the other side. The join is salted, so that no paper is one task."""
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_same_salt")
    sizes = parts.select(F.col("paper").alias("_paper"), "_slices", "_chunks", salt)
    salted = rows.withColumn("_hash", F.xxhash64(by)).withColumn("_salt", F.pmod("_hash", F.lit(SALTS)).cast("int"))
    joined = salted.join(sizes, (F.col("paper") == F.col("_paper")) & (F.col("_salt") == F.col("_same_salt")))
    mine = F.pmod(F.shiftright("_hash", 8), F.col(f"_{own}s")).cast("int").alias(f"_{own}")
    # new columns, as both sides may come from one table
    return joined.select(*[F.col(c).alias(c) for c in rows.columns], mine, F.explode(F.sequence(F.lit(0), (F.col(f"_{other}s") - 1).cast("int"))).alias(f"_{other}"))


def _groups(entries: DataFrame, texts: DataFrame) -> tuple:
    """Both sides by (paper, slice, chunk)."""
    n_text = texts.groupBy("paper").agg(F.ceil(F.sum(F.length("blob") + 16) / SLICE).alias("_slices"))
    n_entry = entries.groupBy("paper").agg(F.ceil(F.count("*") / CHUNK).alias("_chunks"))
    parts = n_text.join(n_entry, "paper")
    keys = ("paper", "_slice", "_chunk")
    return _dealt(entries, parts, "chunk", "slice", F.struct("a", "b", "c")).groupBy(*keys), _dealt(texts, parts, "slice", "chunk", F.struct(*texts.columns)).groupBy(*keys)


class Finder:
    """The names of some entries as one automaton."""

    def __init__(self, entries: list[tuple[str, str | None, str | None]]):
        self.by_a: dict[str, list[int]] = {}
        self.entries = entries
        self.automaton = ahocorasick.Automaton()
        for i, entry in enumerate(entries):
            self.by_a.setdefault(entry[0], []).append(i)
            for name in entry:
                if name:
                    self.automaton.add_word(name, name)
        self.any = len(self.automaton) > 0
        if self.any:
            self.automaton.make_automaton()

    def contained(self, text: str) -> set[str]:
        """The names this text contains, the empty one included."""
        return {name for _, name in self.automaton.iter(text)} | {""} if self.any else {""}

    def hits(self, text: str, left: dict[str, list[int]]) -> list[int]:
        """Entries of `left` that this text holds."""
        here = self.contained(text)
        return [i for a in (here if len(here) < len(left) else left) if a in here for i in left.get(a, ()) if self.entries[i][1] in here or self.entries[i][2] in here]


def _entries(table: pa.Table) -> list[tuple]:
    return list(zip(*(table[c].to_pylist() for c in ("a", "b", "c")), strict=True))


def found(entries: DataFrame, texts: DataFrame) -> DataFrame:
    """Entries (paper, a, b, c) that some text of their paper holds, each once. texts: paper, blob."""
    entries = entries.select("paper", "a", "b", "c").where("paper is not null and a is not null").distinct()
    texts = texts.select("paper", "blob").where("paper is not null and blob is not null")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        finder = Finder(_entries(left))
        waiting, hit = {a: list(rows) for a, rows in finder.by_a.items()}, []
        for text in right["blob"].to_pylist():
            for i in finder.hits(text, waiting):
                hit.append(i)
                rows = waiting[finder.entries[i][0]]
                rows.remove(i)
                if not rows:
                    del waiting[finder.entries[i][0]]
            if not waiting:  # what is found need not be found again
                break
        return left.select(["paper", "a", "b", "c"]).take(pa.array(hit, pa.int64()))

    a, b = _groups(entries, texts)
    return a.cogroup(b).applyInArrow(run, entries.schema).distinct()


def naming(entries: DataFrame, texts: DataFrame, key: list[str]) -> DataFrame:
    """Keys of the texts(paper, *key, blob) that hold some entry of their paper, each once."""
    entries = entries.select("paper", "a", "b", "c").where("paper is not null and a is not null").distinct()
    columns = list(dict.fromkeys(["paper", *key, "blob"]))
    texts = texts.select(*columns).where("paper is not null and blob is not null")
    out = texts.select(*key).schema

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        finder = Finder(_entries(left))
        kept = [i for i, text in enumerate(right["blob"].to_pylist()) if finder.hits(text, finder.by_a)]
        return right.select(key).take(pa.array(kept, pa.int64()))

    a, b = _groups(entries, texts)
    return a.cogroup(b).applyInArrow(run, out).distinct()
