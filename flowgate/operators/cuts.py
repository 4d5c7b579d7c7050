"""Exact quota cuts in a deterministic order, without sorting the table.

"The first q rows of each class in key order" and "whole groups until 70 % of the rows are placed" both
ask for one thing: the key at which a running count reaches a target. It is found by histograms over key
prefixes. Each pass counts rows per prefix (some thousand cells, combined map-side), locates the cell in
which the target falls and descends into that cell only: after two passes a cell holds one row in 16
million. The table is never shuffled, a key with very many rows is just a large number in its cell, and
the result does not depend on the partitioning. Only histograms of a fixed size and the cuts themselves
reach the driver, as fitted parameters; applying a cut is one comparison per row.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bounds on what a pass may bring to the driver, beyond one cell for each cut.
MAX_CELLS = 65_536
MAX_KEYS = 100_000
# The prefix of a key is extended by at most this many hex digits per pass.
STEP_DIGITS = 3


@dataclass(frozen=True)
class Cut:
    """The last key that begins before the target, the rows before that key, the rows with that key."""

    key: str
    before: float
    rows: float
    target: float

    @property
    def take(self) -> float:
        """How many of the key's rows lie before the target."""
        return min(self.target - self.before, self.rows)

    @property
    def straddles(self) -> bool:
        return self.take < self.rows


Targets = Mapping[tuple[object, int], float]


def _conditions(cells: Iterable[tuple[object, str]], y: Column, k: Column) -> Column:
    """Whether a row is in one of the cells. One flat map, however many classes there are."""
    by_class: dict[object, set[str]] = {}
    for cls, prefix in cells:
        by_class.setdefault(cls, set()).add(prefix)
    if not by_class:
        return F.lit(False)
    prefixes = class_values({c: sorted(p) for c, p in by_class.items()}, y)
    return F.coalesce(F.array_contains(prefixes, k), F.lit(False))


def class_values(values: Mapping[object, Sequence[str | None]], y: Column) -> Column:
    """The texts that belong to the row's class, missing for other classes: one constant map, planned as a single value."""
    if all(isinstance(c, (bool, int, str)) for c in values):
        named = {str(c).lower() if isinstance(c, bool) else str(c): list(v) for c, v in values.items()}
        table = F.from_json(F.lit(json.dumps(named)), "map<string,array<string>>")
    else:
        # other kinds of classes are written as Spark writes them
        table = F.create_map(*[x for c, v in values.items() for x in (F.lit(c).cast("string"), F.array(*[F.lit(t).cast("string") for t in v]))])
    return F.try_element_at(table, y.cast("string"))


def _descend(state: dict, targets: Targets, cells: Iterable) -> dict:
    """Move every open cut into the cell that contains its target; ``cells`` are (y, p, q, w, n)."""
    inside: dict[tuple[object, str], list] = {}
    for r in cells:
        inside.setdefault((r.y, r.p), []).append(r)
    out = {}
    for (cls, cut), (prefix, start, _, _) in state.items():
        running = start
        for r in sorted(inside.get((cls, prefix), ()), key=lambda r: r.q):
            if running >= targets[cls, cut]:
                break
            out[cls, cut] = (r.q, running, r.w, r.n)
            running += r.w
    return out


def find_cuts(rows: DataFrame, targets: Targets, label: str, key: str, weight: str | None = None) -> dict[tuple[object, int], Cut]:
    """For each (class, cut number) the boundary key; no entry where the target is 0.

    ``rows`` has a class column, an order key in hex digits and optionally a weight; equal keys form one
    group and are never divided.
    """
    y, k = F.col(label), F.col(key)
    w = F.lit(1) if weight is None else F.col(weight)

    def counted(parent_digits: int, prefix: Column, open_cells: set) -> DataFrame:
        parent = F.substring(k, 1, parent_digits)
        return (
            rows.where(_conditions(open_cells, y, parent))
            .groupBy(y.alias("y"), parent.alias("p"), prefix.alias("q"))
            .agg(F.sum(w).cast("double").alias("w"), F.count(F.lit(1)).alias("n"))
        )

    state = {cut: ("", 0.0, float("inf"), float("inf")) for cut, target in targets.items() if target > 0}
    digits, passes = 0, 0
    while state:
        open_cells = {(c, p) for (c, _), (p, _, _, _) in state.items()}
        size = sum({(c, p): n for (c, _), (p, _, _, n) in state.items()}.values())
        # A cell of few rows, or one that two passes have narrowed down, is read key by key.
        if passes >= 2 or size <= MAX_KEYS:
            cells = counted(digits, k, open_cells).limit(MAX_KEYS + 1).collect()
            if len(cells) <= MAX_KEYS:
                state = _descend(state, targets, cells)
                break
        step = next((d for d in range(STEP_DIGITS, 1, -1) if 16**d * len(open_cells) <= MAX_CELLS), 1)
        cells = counted(digits, F.substring(k, 1, digits + step), open_cells).collect()
        state, digits, passes = _descend(state, targets, cells), digits + step, passes + 1
        # Prefixes that did not get longer are whole keys.
        if all(len(q) < digits for q, _, _, _ in state.values()):
            break

    return {cut: Cut(q, before, w, float(targets[cut])) for cut, (q, before, w, _) in state.items()}


def segment(cuts: Mapping[tuple[object, int], Cut], y: Column, k: Column, classes: Iterable[object], n_cuts: int) -> Column:
    """The number of cuts a row's key lies behind: 0 for rows up to the first cut, 1 up to the second, …"""
    own = {cls: [cuts.get((cls, j)) for j in range(n_cuts)] for cls in classes}
    ends = class_values({cls: [cut.key if cut else None for cut in found] for cls, found in own.items()}, y)
    passed = F.array_min(F.transform(ends, lambda key, j: F.when(k <= key, j.cast("int"))))
    return F.when(ends.isNotNull(), F.coalesce(passed, F.lit(n_cuts)))


def totals(rows: DataFrame, label: str) -> dict[object, int]:
    """Rows per class: one number for each value of the label."""
    found = rows.groupBy(F.col(label).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()
    if any(r.y is None for r in found):
        raise ValueError(f"column {label} has missing values; map them to a class first")
    return {r.y: r.n for r in sorted(found, key=lambda r: r.y)}
