"""Positioned text: grouping by distance, diagram layout, blending of coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import common_words
from .shared import connected, scratch, stash

#: Side of a cell in reaches: under 1/sqrt(2), so all items of a cell are near each other, and near items are two cells apart at most.
SIDE = 0.7
#: Pairs of points by which two cells are compared; cells that hold more are cut in four.
MET = 256

_PAGE, _ROOTS = ["page_index", "reach"], ["page_index", "reach", "ax", "ay", "bx", "by"]


def _placed(items: DataFrame, threshold: float) -> DataFrame:
    """items with their page's `reach`, centre (cx, cy) and cell (gx, gy); null for those that are near nothing: no page, no finite place or a page without size."""
    reach = F.sqrt(F.col("page_width") * F.col("page_width") + F.col("page_height") * F.col("page_height")) * threshold
    out = items.withColumns({"reach": reach, "cx": F.col("x") + F.col("width") / 2, "cy": F.col("y") + F.col("height") / 2})
    finite = lambda c: F.abs(F.col(c)) < float("inf")
    able = F.col("page_index").isNotNull() & finite("reach") & (F.col("reach") > 0) & finite("cx") & finite("cy")
    at = lambda c: F.when(able, _cell(c, 0))
    return out.withColumns({"gx": at("cx"), "gy": at("cy")})


def _cell(centre: str, level: int):
    """The cell along an axis when cells were halved `level` times; halved again it has twice that number, or one more, as powers of two are exact."""
    return F.floor(F.col(centre) / (F.col("reach") * SIDE) * 2.0**level)


def _large(side: DataFrame) -> DataFrame:
    """A side of a join that isn't broadcast: the planner takes a written table for as large as its compressed files, which as a relation in the driver it isn't."""
    return side.hint("merge")


def _boxes(points: DataFrame, level: int) -> DataFrame:
    """(page_index, reach, box): the cells of points, with the bounds and the number of what they hold."""
    held = points.groupBy(*_PAGE, _cell("cx", level).alias("kx"), _cell("cy", level).alias("ky"))
    held = held.agg(F.min("cx").alias("x0"), F.max("cx").alias("x1"), F.min("cy").alias("y0"), F.max("cy").alias("y1"), F.count(F.lit(1)).alias("n"))
    return held.select(*_PAGE, F.struct("kx", "ky", "x0", "x1", "y0", "y1", "n").alias("box"))


def _judged(met: DataFrame) -> DataFrame:
    """Pairs of boxes p, q that may hold near points; `sure` where any two are.  Rounding keeps order, so bounds hold for the points' own distances."""
    apart = lambda c: F.greatest(F.col(f"p.{c}0") - F.col(f"q.{c}1"), F.col(f"q.{c}0") - F.col(f"p.{c}1"), F.lit(0.0))
    across = lambda c: F.greatest(F.col(f"p.{c}1") - F.col(f"q.{c}0"), F.col(f"q.{c}1") - F.col(f"p.{c}0"))
    size = lambda f: F.sqrt(f("x") * f("x") + f("y") * f("y"))
    return met.where(size(apart) < F.col("reach")).withColumn("sure", size(across) < F.col("reach"))


def near_cells(points: DataFrame) -> DataFrame:
    """points(page_index, reach, cx, cy), each once -> pairs (page_index, reach, ax, ay, bx, by) of neighbouring cells that hold near points.

    Cells are compared by their bounds.  Where these leave it open, cells are halved and their parts compared, few points
    with each other: what is open are the edges of crowded cells, so the work doesn't grow with the pairs of items.
    """
    with scratch() as keep:
        step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(3) for j in range(-2, 3) if (i, j) > (0, 0)]))
        cells = stash(_boxes(points, 0))
        left = cells.withColumn("o", step).select(*_PAGE, (F.col("box.kx") + F.col("o.i")).alias("bx"), (F.col("box.ky") + F.col("o.j")).alias("by"), F.col("box.kx").alias("ax"), F.col("box.ky").alias("ay"), F.col("box").alias("p"))
        right = cells.select(*_PAGE, F.col("box.kx").alias("bx"), F.col("box.ky").alias("by"), F.col("box").alias("q"))
        met, found, level = left.join(_large(right), [*_PAGE, "bx", "by"]), None, 0
        while True:
            judged = stash(_judged(met).select(*_ROOTS, "p", "q", "sure"))
            sure = judged.where("sure").select(*_ROOTS).distinct()
            left_open = judged.where("NOT sure").join(_large(sure), _ROOTS, "left_anti")
            few = F.col("p.n") * F.col("q.n") <= MET
            own = lambda x, y: points.select(*_PAGE, _cell("cx", level).alias(f"{x}x"), _cell("cy", level).alias(f"{x}y"), F.struct("cx", "cy").alias(y))  # noqa: E731, B023
            one = left_open.where(few).select(*_ROOTS, F.col("p.kx").alias("_px"), F.col("p.ky").alias("_py"), F.col("q.kx").alias("_qx"), F.col("q.ky").alias("_qy"))
            both = one.join(_large(own("_p", "u")), [*_PAGE, "_px", "_py"]).join(_large(own("_q", "v")), [*_PAGE, "_qx", "_qy"])
            dx, dy = F.col("u.cx") - F.col("v.cx"), F.col("u.cy") - F.col("v.cy")
            links = stash(sure.unionByName(both.where(F.sqrt(dx * dx + dy * dy) < F.col("reach")).select(*_ROOTS)).distinct())
            found = links if found is None else found.unionByName(links)
            left_open = stash(left_open.where(~few).join(_large(links), _ROOTS, "left_anti"))
            if not left_open.count():
                return keep(stash(found))
            level += 1
            parts = stash(_boxes(points, level))
            half = lambda x, y: parts.select(*_PAGE, F.shiftright("box.kx", 1).alias(f"{x}x"), F.shiftright("box.ky", 1).alias(f"{x}y"), F.col("box").alias(y))  # noqa: E731, B023
            met = left_open.select(*_ROOTS, F.col("p.kx").alias("_px"), F.col("p.ky").alias("_py"), F.col("q.kx").alias("_qx"), F.col("q.ky").alias("_qy"))
            met = met.join(_large(half("_p", "p")), [*_PAGE, "_px", "_py"]).join(_large(half("_q", "q")), [*_PAGE, "_qx", "_qy"])


def near_groups(items: DataFrame, threshold: float = 0.04) -> DataFrame:
    """items with `group_id`, the least item_id that leads to them over items of a page whose centres are nearer than the share of its diagonal.

    Items of a cell are one group anyway, so cells are what is linked: at most as many as fit a page, however many items it
    has.  Rows of one item_id are one item; a page has one size.
    """
    placed = _placed(items, threshold)
    cell = [*_PAGE, "gx", "gy"]
    able = placed.where("gx IS NOT NULL AND gy IS NOT NULL").select("item_id", *cell, "cx", "cy")
    with scratch() as keep:
        first = stash(able.groupBy(*cell).agg(F.min("item_id").alias("first")))
        pairs = near_cells(stash(able.select(*_PAGE, "cx", "cy").distinct()))
        named = lambda x: first.select(*_PAGE, F.col("gx").alias(f"{x}x"), F.col("gy").alias(f"{x}y"), F.col("first").alias(x))
        links = pairs.join(_large(named("a")), [*_PAGE, "ax", "ay"]).join(_large(named("b")), [*_PAGE, "bx", "by"]).select("a", "b")
        again = able.groupBy("item_id").count().where("count > 1").select("item_id")
        links = links.unionByName(able.join(_large(again), "item_id", "left_semi").join(_large(first), cell).select(F.col("item_id").alias("a"), F.col("first").alias("b")))
        groups = keep(stash(connected(links)))
        first = keep(stash(first.join(_large(groups), F.col("first") == F.col("id"), "left").select(*cell, F.coalesce("component", "first").alias("_group"))))
    # Items in no cell may share their item_id with one that is.
    alone = groups.select(F.col("id").alias("_id"), F.col("component").alias("_own"))
    lost = placed.where("gx IS NULL OR gy IS NULL").join(_large(alone), F.col("item_id") == F.col("_id"), "left").select(*items.columns, F.coalesce("_own", "item_id").alias("group_id"))
    return placed.join(_large(first), cell).select(*items.columns, F.col("_group").alias("group_id")).unionByName(lost)


def spatial_groups(items: DataFrame, threshold: float = 0.04) -> DataFrame:
    """Groups of near items in reading order; texts under 3 characters are dropped."""
    member = near_groups(items, threshold)
    order = F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "item_id", "text"))), lambda t: t["text"])
    groups = member.groupBy("page_index", "group_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.array_join(order, " ").alias("text"),
        F.avg(F.col("x") + F.col("width") / 2).alias("cx"),
        F.avg(F.col("y") + F.col("height") / 2).alias("cy"),
        F.min("x").alias("min_x"),
        F.min("y").alias("min_y"),
        F.max(F.col("x") + F.col("width")).alias("max_x"),
        F.max(F.col("y") + F.col("height")).alias("max_y"),
        F.min("page_width").alias("pw"),
        F.min("page_height").alias("ph"),
    )
    return groups.where(F.length("text") >= 3).withColumn("nx", F.col("cx") / F.col("pw")).withColumn("ny", F.col("cy") / F.col("ph")).drop("pw", "ph")


def diagram_layout(groups: DataFrame, key: str = "document_id") -> DataFrame:
    """groups(key, text, nx, ny) -> is_diagram and confidence; fewer than three groups are none."""
    level = F.floor(F.col("ny") * 10 + 0.5)
    per = groups.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.length("text")).alias("mean_length"),
        F.avg((F.length("text") < 80).cast("double")).alias("short"),
        (F.max("nx") - F.min("nx")).alias("spread"),
        F.count_distinct(level).alias("levels"),
    )
    add = lambda rule, v: F.when(rule, v).otherwise(0.0)
    points = add(F.col("short") > 0.6, 0.3) + add(F.col("mean_length") < 60, 0.2) + add(F.col("spread") > 0.4, 0.25) + add(F.col("levels") / F.col("n") > 0.3, 0.25)
    sure = F.when(F.col("n") < 3, 0.0).otherwise(F.round(F.least(F.lit(1.0), points), 9))
    return per.select(key, "n", sure.alias("confidence"), (sure >= 0.5).alias("is_diagram"))


def blend(coords: DataFrame, sentences: DataFrame, groups: DataFrame, layout: DataFrame) -> DataFrame:
    """coords(document_id, idx, x, y) moved towards the page place of the best matching group.

    sentences(document_id, idx, text), groups(document_id, group_order, text, nx, ny), layout(document_id, confidence).
    A document's sentences are compared with its own groups; the first of equal matches wins.
    """
    low = F.lower("text")
    s = sentences.select("document_id", "idx", low.alias("s"))
    g = groups.select("document_id", "group_order", low.alias("g"), "nx", "ny")
    overlap = F.when((F.length("s") > 0) & F.col("g").contains(F.substring("s", 1, 40)), F.length("s")).otherwise(common_words(F.col("s"), F.col("g")))
    met = s.join(g, "document_id").withColumn("overlap", overlap).where(F.col("overlap") > 0)
    best = met.groupBy("document_id", "idx").agg(F.max_by(F.struct("overlap", "nx", "ny", F.length("s").alias("len")), F.struct("overlap", -F.col("group_order"))).alias("m"))
    best = best.where(F.col("m.overlap") >= F.least(F.lit(5), F.col("m.len")))
    out = coords.join(best, ["document_id", "idx"], "left").join(layout.select("document_id", "confidence"), "document_id", "left")
    w = F.when(F.col("m").isNotNull() & (F.coalesce("confidence", F.lit(0.0)) >= 0.2), F.col("confidence") * 0.7).otherwise(0.0)
    to = lambda v, n: (F.col(v) * (1 - w) + F.coalesce(F.col(n) * 7 - 3.5, F.lit(0.0)) * w).alias(v)
    return out.select("document_id", "idx", to("x", "m.nx"), to("y", "m.ny"))
