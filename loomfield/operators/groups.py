"""Connected groups that grow and shrink: labels of the last run change only where links came or went.

labels(id, component) is what `shared.connected` gives: the least id that each id
reaches, for ids with a link to another.  New links are contracted to links between
components, which are few, and only their components are solved; links that go
make only the components they were in be solved again.  Both give the rows to write
and the ids to drop, so a stored table of labels is changed, not derived anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected, stash


def _ends(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def added(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels that are new or others after links(a, b) came.  Null ends, loops, repeated and known links do no harm."""
    fresh = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    for end in "ab":
        known = labels.select(F.col("id").alias(f"_{end}"), F.col("component").alias(f"_to_{end}"))
        fresh = fresh.join(known, F.col(end) == F.col(f"_{end}"), "left")
    fresh = stash(fresh.select("a", "b", F.coalesce("_to_a", "a").alias("x"), F.coalesce("_to_b", "b").alias("y")))
    heads = stash(connected(fresh.select(F.col("x").alias("a"), F.col("y").alias("b"))))
    to = heads.select(F.col("id").alias("_head"), F.col("component").alias("_component"))
    # A component keeps its label where its own head stays the least.
    moved = labels.join(to.where("_head <> _component"), F.col("component") == F.col("_head")).select("id", F.col("_component").alias("component"))
    single = _ends(fresh).join(labels.select("id"), "id", "left_anti")
    return moved.unionByName(single.join(to, F.col("id") == F.col("_head")).select("id", F.col("_component").alias("component")))


def removed(labels: DataFrame, links: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changed, dropped) labels after gone(a, b) went: links(a, b) are those that are left.

    `changed` has new labels, `dropped` ids that no link holds any more.  Only links inside components that lost one are read into the rounds.
    """
    hit = _ends(gone).join(labels, "id").select("component").distinct()
    inside = stash(labels.join(hit, "component", "left_semi").select("id", "component"))
    left = links.join(inside.select(F.col("id").alias("a")), "a", "left_semi").select("a", "b")
    now = stash(connected(left))
    before = inside.select(F.col("id").alias("_id"), F.col("component").alias("_was"))
    changed = now.join(before, F.col("id") == F.col("_id"), "left").where(~F.col("component").eqNullSafe(F.col("_was"))).select("id", "component")
    return changed, inside.select("id").join(now.select("id"), "id", "left_anti")


def relabelled(labels: DataFrame, changed: DataFrame, dropped: DataFrame | None = None) -> DataFrame:
    """labels with changed rows in place of their old ones, without dropped ids."""
    kept = labels.join(changed.select("id"), "id", "left_anti")
    if dropped is not None:
        kept = kept.join(dropped.select("id"), "id", "left_anti")
    return kept.select("id", "component").unionByName(changed.select("id", "component"))
