"""Names to ids: exact matches first, then phrases, then shared words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions.terms import bare, full_column
from kgspark.sources.store import GraphStore


def words(text: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""))


def scored(store: GraphStore, text: str, category: str | None = None) -> DataFrame:
    """id, name, category, score of nodes whose name shares a word with the text: 10 for the same name, 5 for the phrase, and the share of words."""
    asked, name = words(F.lit(text)), F.col("name")
    shared = F.size(F.array_intersect(words(name), asked))
    score = F.when(F.lower(name) == text.lower(), 10).otherwise(0) + F.when(F.contains(F.concat(F.lit(" "), F.array_join(words(name), " "), F.lit(" ")), F.concat(F.lit(" "), F.array_join(asked, " "), F.lit(" "))), 5).otherwise(0) + shared / F.greatest(F.size(words(name)), F.lit(1))
    rows = store.nodes.where(name.isNotNull())
    if category:
        rows = rows.where(F.array_contains("category", bare(category)))
    return rows.where((shared > 0) | (F.lower(name) == text.lower())).select("id", "name", F.transform("category", full_column).alias("category"), score.cast("double").alias("score"))


def resolve(store: GraphStore, text: str, category: str | None = None, top: int = 5) -> list[dict]:
    return [r.asDict() for r in scored(store, text, category).orderBy(F.desc("score"), "id").limit(top).select("id", "name", "category").collect()]


def resolve_one(store: GraphStore, text: str, category: str | None = None) -> str:
    found = resolve(store, text, category, 1)
    if not found:
        raise ValueError(f"nothing is named {text!r}" + (f" among {category}" if category else ""))
    return found[0]["id"]


def names(store: GraphStore, ids: list[str]) -> dict[str, str]:
    """The name of each id; the id itself where it has none."""
    asked = dict.fromkeys(ids)
    if not asked:
        return {}
    wanted = F.broadcast(store.spark.createDataFrame([(i,) for i in asked], "id string"))
    known = {r.id: r.name for r in store.nodes.join(wanted, "id", "left_semi").select("id", "name").collect()}
    return {i: known.get(i) or i for i in asked}


def path_text(path: list[tuple[str, str, str]], labels: dict[str, str] | None = None) -> str:
    """A -[p]-> B <-[q]- C; an edge that does not go on from the last node is drawn backwards."""
    labels = labels or {}
    if not path:
        return ""
    show = lambda i: labels.get(i, i)
    at = path[0][0] if len(path) == 1 or path[0][2] in (path[1][0], path[1][2]) else path[0][2]
    out = show(at)
    for s, p, o in path:
        ahead = s == at
        at = o if ahead else s
        out += f" -[{p}]-> {show(at)}" if ahead else f" <-[{p}]- {show(at)}"
    return out
