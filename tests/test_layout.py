"""Groups of near items against union-find over all pairs."""

import math
import random

import pytest

from loomfield.operators import layout
from test_shared import by_union

ITEM = "page_index int, item_id long, text string, x double, y double, width double, height double, page_width double, page_height double"


def near(rows, threshold=0.04):
    """group_id of each row, by comparing every pair of a page."""
    links = []
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if None in (a[0], a[3], b[3]) or a[0] != b[0]:
                continue
            reach = math.sqrt(a[7] * a[7] + a[8] * a[8]) * threshold
            dx, dy = (a[3] + a[5] / 2) - (b[3] + b[5] / 2), (a[4] + a[6] / 2) - (b[4] + b[6] / 2)
            if math.sqrt(dx * dx + dy * dy) < reach:
                links.append((a[1], b[1]))
    heads = by_union(links)
    return sorted((r[0] is None, r[0] or 0, r[1], heads.get(r[1], r[1])) for r in rows)


def made(kind):
    r = random.Random(5)
    row = lambda p, i, x, y, size=1000.0: (p, i, f"item {i}", x, y, 0.0, 0.0, size * 0.6, size * 0.8)
    if kind == "spread":
        return [row(i % 3, i, r.uniform(-900, 900), r.uniform(-900, 900)) for i in range(400)]
    if kind == "two crowds just out of reach":  # reach is 40: parts of cells must be told apart, down to single points
        return [row(1, i, r.choice([0.0, 45.0]) + r.choice([0.0, 5.0]) * r.random() ** 9, i * 0.05) for i in range(400)]
    if kind == "exactly the reach":
        return [row(1, i, 40.0 * (i % 5), 100.0 * (i // 5)) for i in range(20)] + [row(1, 50, 39.999, 0.0)]
    if kind == "crowd":
        return [row(2, i, 10 + 20 * r.random(), 10 + 20 * r.random()) for i in range(300)] + [row(2, 999, 30.0, 69.0)]
    # Items that repeat or have no place, on pages without size, far off.
    odd = [row(1, 1, 0.0, 0.0), row(1, 1, 500.0, 0.0), row(1, 2, 510.0, 0.0), row(1, 3, 5.0, 0.0), row(2, 3, 0.0, 0.0), row(2, 9, 3.0, 3.0), row(None, 7, 0.0, 0.0), row(1, 8, None, 0.0), row(4, 10, 0.0, 0.0, 0.0), row(4, 11, 0.0, 0.0, 0.0)]
    return odd + [row(1, 2, None, 0.0), row(5, 20, 1e12, 1e12), row(5, 21, 1e12 + 1, 1e12)]


@pytest.mark.parametrize("kind", ["spread", "two crowds just out of reach", "exactly the reach", "crowd", "odd"])
def test_groups_equal_all_pairs(spark, kind, monkeypatch):
    monkeypatch.setattr(layout, "MET", 9)
    rows = made(kind)
    got = layout.near_groups(spark.createDataFrame(rows, ITEM)).select("page_index", "item_id", "group_id").collect()
    assert sorted((r[0] is None, r[0] or 0, r[1], r[2]) for r in got) == near(rows)


def test_crowded_pages_make_few_links(spark, monkeypatch):
    """Links grow with the cells of a page, not with the pairs of its items."""
    seen, connected = [], layout.connected

    def noted(links):
        seen.append(links.count())
        return connected(links)

    monkeypatch.setattr(layout, "connected", noted)
    groups = layout.spatial_groups(spark.createDataFrame(made("crowd"), ITEM)).collect()
    assert [(g.group_id, g.n_items) for g in groups] == [(0, 301)] and seen[0] <= 20


def test_no_table_of_items_is_broadcast(spark, monkeypatch):
    """The driver holds no table that grows with the items, whatever the planner takes for small."""
    plans, stash = [], layout.stash
    shown = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(layout, "MET", 9)
    monkeypatch.setattr(layout, "stash", lambda df: shown(df) or stash(df))
    shown(layout.diagram_layout(layout.spatial_groups(spark.createDataFrame(made("two crowds just out of reach"), ITEM)), "page_index"))
    assert sum("Join" in p for p in plans) >= 5 and not [p for p in plans if "Broadcast" in p]
