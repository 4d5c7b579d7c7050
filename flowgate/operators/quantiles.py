"""Exact quantiles by descent through histograms, all columns at once."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgate.functions.columns import named
from flowgate.functions.numbers import finite

STEPS = 32  # first cells per factor e; a column has at most 96,000 of them, whatever its values
ABOVE = 24_000  # more than STEPS times the logarithm of the smallest number, so that cells of positive numbers are positive
PARTS = 4096  # of a cell that is looked into
READ = 20_000  # values of a cell from which its parts are counted instead of the values


class _Cell(NamedTuple):
    """Values from ``low`` to ``high`` (both occur), how many there are and how many values are smaller."""

    low: float
    high: float
    n: int
    before: int


def _placed(cells: list[tuple], before: int) -> list[_Cell]:
    """Disjoint cells (low, high, n) in order, on top of ``before`` smaller values."""
    out = []
    for low, high, n in sorted(cells):
        out.append(_Cell(low, high, n, before))
        before += n
    return out


def _holder(cells: list[_Cell], rank: int) -> _Cell:
    return next(c for c in cells if rank < c.before + c.n)


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], read: int = READ) -> DataFrame:
    """Interpolated quantiles of the finite values: one row per (feature, probability); null for a feature without any.

    A first pass counts cells of near equal ratio, with the smallest and largest value of each. Cells that hold a wanted rank are then split into
    equal parts again, until a cell has few values, which are counted one by one, or a single one. Counts are combined map-side, no value is ever
    sorted or moved, and the driver sees cells only: their number depends on the probabilities, not on the rows. Two or three passes are
    the rule. Equal values end in one cell, so any share of the rows may be equal.
    """
    names = list(columns)

    def collected(rows: DataFrame) -> dict[int, list]:
        kept = [c for c in rows.columns if c != "x"]
        found: dict[int, list] = {i: [] for i in range(len(names))}
        for r in rows.groupBy(*kept).agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count(F.lit(1)).alias("n")).collect():
            found[r.f].append(r)
        return found

    def first_pass() -> DataFrame:
        x = F.col("x")
        size = (F.floor(F.log(F.abs(x)) * STEPS) + ABOVE) * F.signum(x).cast("long")
        cells = F.array(*[F.struct(F.lit(i).alias("f"), finite(named(c)).alias("x")) for i, c in enumerate(names)])
        return df.select(F.explode(cells).alias("c")).select("c.*").where("x is not null").select("f", "x", F.when(x == 0, F.lit(0).cast("long")).otherwise(size).alias("cell"))

    def narrower(open_cells: dict[int, list[_Cell]]) -> DataFrame:
        own = []
        for i, cells in open_cells.items():
            x = finite(named(names[i]))
            inside = [
                F.when((x >= c.low) & (x <= c.high), F.struct(F.lit(k).alias("k"), F.lit(c.low).alias("low"), F.lit(c.high).alias("high"), F.lit(c.n <= read).alias("each")))
                for k, c in enumerate(cells)
            ]
            own.append(F.struct(F.lit(i).alias("f"), x.alias("x"), F.coalesce(*inside).alias("c")))
        rows = df.select(F.explode(F.filter(F.array(*own), lambda s: s["c"].isNotNull())).alias("s")).select("s.f", "s.x", "s.c")
        part = F.least(F.floor((F.col("x") - F.col("c.low")) / (F.col("c.high") - F.col("c.low")) * PARTS), F.lit(PARTS - 1))
        each = F.col("c.each")
        return rows.select("f", "x", F.col("c.k").alias("k"), F.when(~each, part).alias("part"), F.when(each, F.col("x")).alias("value"))

    placed = {i: _placed([(r.low, r.high, r.n) for r in rows], 0) for i, rows in collected(first_pass()).items()} if names else {}
    wanted: dict[int, set[int]] = {}
    for i, cells in placed.items():
        total = sum(c.n for c in cells)
        wanted[i] = {min(int((total - 1) * p) + k, total - 1) for p in probabilities for k in (0, 1)} if total else set()

    values: dict[tuple[int, int], float] = {}
    while True:
        open_cells: dict[int, list[_Cell]] = {}
        for i, ranks in wanted.items():
            for rank in sorted(ranks - {r for f, r in values if f == i}):
                cell = _holder(placed[i], rank)
                if cell.low == cell.high:
                    values[i, rank] = cell.low
                elif cell not in open_cells.setdefault(i, []):
                    open_cells[i].append(cell)
        open_cells = {i: cells for i, cells in open_cells.items() if cells}
        if not open_cells:
            break

        found = collected(narrower(open_cells))
        for i, cells in open_cells.items():
            inside = [(cell, _placed([(r.low, r.high, r.n) for r in found[i] if r.k == k], cell.before)) for k, cell in enumerate(cells)]
            kept = [c for c in placed[i] if c not in cells]
            placed[i] = sorted(kept + [c for _, parts in inside for c in parts])

    out = []
    for i, name in enumerate(names):
        total = sum(c.n for c in placed[i])
        for p in probabilities:
            if not total:
                out.append((name, float(p), None))
                continue
            at = (total - 1) * p
            low, high = values[i, int(at)], values[i, min(int(at) + 1, total - 1)]
            out.append((name, float(p), low + (high - low) * (at - int(at))))
    return df.sparkSession.createDataFrame(out, "feature string, probability double, quantile double")
