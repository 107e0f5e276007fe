"""The rolling knowledge state: keyed merges of per-chunk extractions, caps, views.

Below the caps a merge does not depend on order and is an aggregation (`merge_items`). With eviction it does: an
evicted key starts again when it returns; `fold` replays chunks in order, paper by paper.

Defined cases: an item whose key is null, blank or only separators does not count; a null or blank sentence is no evidence; a missing
confidence is medium on a new item and never promotes a held one; null aliases and contexts add nothing; items without a paper are one
paper without a name; a category without a cap is never cut; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V

# Caps of the state and of its compact view.
CAPS = {"concepts": 80, "relations": 60, "properties": 60, "findings": 40}
KEEP = {"concepts": 30, "relations": 25, "properties": 20, "findings": 15}
SHRINK = [0.75, 0.5, 0.3, 0.15]
SHRUNK_NOTE = "\n[... rolling state truncated for prompt budget ...]"
CUT_NOTE = "\n[... rolling state hard-truncated ...]"
# End of fixed values.

STATE = "paper string, category string, key string, mentions long, confidence string, evidence array<string>, ord long, aliases array<string>, contexts array<string>"
COLUMNS = [c.split()[0] for c in STATE.split(", ")]
_RANK = {"high": 3, "medium": 2, "low": 1}


def identity(category: str) -> Column:
    """Identity key of an item of this category, from its fields."""
    fields = {"concepts": ["name"], "relations": ["subject", "predicate", "object"], "properties": ["material", "property_name", "numeric_value"], "findings": ["statement"]}[category]
    parts = [X.norm(F.coalesce(F.col(f).cast("string"), F.lit("none" if f == "numeric_value" else ""))) for f in fields]
    return F.concat_ws("|", *parts)


def keyed(items: DataFrame) -> DataFrame:
    """Items with a key that says something."""
    return items.where(F.trim(F.translate(F.col("key"), "|", "")) != "")


def best_confidence(c: Column, order: Column) -> Column:
    return F.max_by(F.coalesce(c, F.lit("medium")), F.struct(V.confidence_rank(c), -order))


def merge_items(items: DataFrame, evidence: int = 3) -> DataFrame:
    """(paper, category, key): mentions, highest confidence, first evidence sentences with what stood around them, aliases. items: ..., confidence, sentence, ord[, context, aliases].

    A sentence counts where it comes first, aliases whatever their case and spacing.
    """
    context = F.coalesce("context", F.lit("")) if "context" in items.columns else F.lit("")
    told = F.array_sort(F.collect_list(F.when(F.trim("sentence") != "", F.struct("ord", F.trim("sentence").alias("s"), context.alias("c")))))
    more = {}
    if "context" in items.columns:
        more["contexts"] = F.slice(V.first_by_key(told, lambda e: e["s"]), 1, evidence)["c"]
    if "aliases" in items.columns:
        named = F.flatten(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("aliases", F.array().cast("array<string>")).alias("a"))))["a"])
        more["aliases"] = V.first_by_key(F.filter(named, lambda a: X.norm(a) != ""), X.norm)
    return keyed(items).groupBy("paper", "category", "key").agg(
        *[c.alias(n) for n, c in more.items()],
        F.count("*").alias("mentions"), F.slice(F.array_distinct(told["s"]), 1, evidence).alias("evidence"), best_confidence(F.col("confidence"), F.col("ord")).alias("confidence"), F.min("ord").alias("ord"),
    )


def _add_aliases(item: dict, more: list | None) -> None:
    """Aliases in first-seen order, told apart whatever their case and spacing."""
    seen = {" ".join(a.lower().split()) for a in item["aliases"]}
    for alias in () if more is None else more:
        name = " ".join((alias or "").lower().split())
        if name and name not in seen:
            seen.add(name)
            item["aliases"].append(alias)


def _merge_one(state: dict, row: dict, evidence: int) -> None:
    """`evidence` holds sentences, `contexts` what stood around each of them."""
    sentence, context = (row["sentence"] or "").strip(), row.get("context") or ""
    old = state.get(row["key"])
    if old is None:
        old = state[row["key"]] = {"mentions": 1, "confidence": row["confidence"] or "medium", "evidence": [sentence] if sentence else [], "ord": row["ord"], "aliases": [], "contexts": [context] if sentence else []}
        _add_aliases(old, row.get("aliases"))
        return
    _add_aliases(old, row.get("aliases"))
    old["mentions"] += 1
    if _RANK.get((row["confidence"] or "").lower(), 1) > _RANK.get(old["confidence"].lower(), 1):
        old["confidence"] = row["confidence"]
    if sentence and sentence not in old["evidence"] and len(old["evidence"]) < evidence:
        old["evidence"].append(sentence)
        old["contexts"].append(context)


def fold_chunks(held: dict[str, dict], rows: Iterable[dict], caps: dict[str, int], evidence: int = 3) -> dict[str, dict]:
    """Merge the rows of one chunk into {category: {key: item}}, then evict beyond the caps."""
    for row in rows:
        if row["key"] and row["key"].replace("|", "").strip():
            _merge_one(held.setdefault(row["category"], {}), row, evidence)
    for category, items in held.items():
        cap = caps.get(category, 0)
        if cap and len(items) > cap:
            ranked = sorted(items.items(), key=lambda kv: (-kv[1]["mentions"], -_RANK.get(kv[1]["confidence"].lower(), 1)))
            held[category] = dict(ranked[:cap])
    return held


def state_rows(paper: str | None, held: dict[str, dict]) -> Iterator[tuple]:
    for category in sorted(held):
        for position, (key, item) in enumerate(held[category].items()):
            yield paper, category, key, item["mentions"], item["confidence"], item["evidence"], position, item["aliases"], item["contexts"]


def fold(items: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """The state after all chunks of each paper in order, with eviction. A paper's items are bounded by its length."""
    caps = CAPS if caps is None else caps

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        held: dict[str, dict] = {}
        rows = frame.sort_values(["chunk_id", "ord"], kind="stable").to_dict("records")
        for _, chunk in groupby(rows, lambda r: r["chunk_id"]):
            held = fold_chunks(held, chunk, caps)
        return pd.DataFrame(list(state_rows(frame["paper"].iloc[0], held)), columns=COLUMNS)

    more = [c for c in ("aliases", "context") if c in items.columns]
    return items.select(F.col("paper").cast("string").alias("paper"), "chunk_id", "category", "key", "confidence", "sentence", "ord", *more).groupBy("paper").applyInPandas(run, STATE)


def ranked(state: DataFrame, *tie: str) -> DataFrame:
    w = Window.partitionBy("paper", "category").orderBy(F.desc("mentions"), F.desc(V.confidence_rank(F.col("confidence"))), *(tie or ("ord",)))
    return state.withColumn("rank", F.row_number().over(w))


def cap(state: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """The top rows of each category; a cap of 0 or none is no cap."""
    caps = CAPS if caps is None else caps
    limit = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]) if caps else F.create_map().cast("map<string,int>")
    most = F.coalesce(F.element_at(limit, F.col("category")), F.lit(0))
    return ranked(state).where((most == 0) | (F.col("rank") <= most))


def top_concepts(state: DataFrame, k: int = 20) -> DataFrame:
    """Distinct names by mentions and confidence."""
    return ranked(state.where(F.col("category") == "concepts")).where(F.col("rank") <= k)


def compact(state: DataFrame, budget: int = 4000, keep: dict[str, int] | None = None) -> DataFrame:
    """(paper, view): JSON of the top rows of each category, shrunk step by step until it fits, else cut hard."""
    keep = KEEP if keep is None else keep
    most = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in keep.items() for x in kv]), F.col("category")), F.lit(20))
    rows = ranked(state).where(F.col("rank") <= most).withColumn("n", F.count("*").over(Window.partitionBy("paper", "category")))
    item = F.struct("rank", F.struct("key", "mentions", "confidence").alias("item"))

    def view(share: float) -> Column:
        fits = F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("n") * share))
        return F.array_sort(F.collect_list(F.when(fits, item)))["item"]

    sizes = [1.0, *SHRINK]
    lists = rows.groupBy("paper", "category").agg(*[view(s).alias(f"v{i}") for i, s in enumerate(sizes)])
    whole = [F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", f"v{i}"))))).alias(f"v{i}") for i in range(len(sizes))]
    views = lists.groupBy("paper").agg(*whole)
    tries = [F.when(F.length(f"v{i}") <= budget, F.col(f"v{i}") if i == 0 else F.concat(F.col(f"v{i}"), F.lit(SHRUNK_NOTE))) for i in range(len(sizes))]
    last = F.concat(F.substring(f"v{len(sizes) - 1}", 1, budget), F.lit(CUT_NOTE))
    return views.select("paper", F.coalesce(*tries, last).alias("view"))
