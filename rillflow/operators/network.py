"""Flow networks of D8 grids: each cell drains to one neighbour, so a grid is an edge table (cell, down)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.operators.lineage import Rounds, written
from rillflow.operators.raster import Grid

#: Direction codes around a cell, from the top left.
CODES = [[32, 64, 128], [16, 0, 1], [8, 4, 2]]
SINK, OUTSIDE = -2, -1


def downstream(code: Column, cell: Column, grid: Grid) -> Column:
    """The cell that a cell drains to; -2 at a sink, -1 off the grid or for an unknown code."""
    r, c, out = grid.row(cell), grid.col(cell), F.when(code == 0, SINK)
    for i, line in enumerate(CODES):
        for j, k in enumerate(line):
            if k:
                inside = (r + i - 1).between(0, grid.nrows - 1) & (c + j - 1).between(0, grid.ncols - 1)
                out = out.when((code == k) & inside, cell + (i - 1) * grid.ncols + (j - 1))
    return out.otherwise(OUTSIDE).cast("bigint")


def edges(cells: DataFrame, grid: Grid) -> DataFrame:
    """cell, down of a table (cell, value) of direction codes."""
    return cells.select("cell", downstream(F.col("value"), F.col("cell"), grid).alias("down"))


def upstream(edge: DataFrame) -> DataFrame:
    """cell, ups: the ascending cells that drain to each cell."""
    return edge.where("down >= 0").groupBy(F.col("down").alias("cell")).agg(F.sort_array(F.collect_list("cell")).alias("ups"))


def _length(grid: Grid, a: Column, b: Column) -> Column:
    return F.when(F.abs(a - b).isin(1, grid.ncols), 1.0).otherwise(math.sqrt(2))


def _reaching(edge: DataFrame, outlet: int, stops: list[int], grid: Grid | None = None) -> DataFrame:
    """cell, length of the way of every cell that drains to the outlet, itself left out, and not through `stops`.

    Each round doubles every cell's pointer, so their number is the logarithm of the longest way.
    Cells that circle never reach the outlet.
    """
    length = _length(grid, F.col("cell"), F.col("down")) if grid else F.lit(0.0)
    state = Rounds(edge.where(F.col("down") >= 0).where(~F.col("cell").isin(outlet, *stops)).select("cell", F.col("down").alias("to"), length.alias("length")), "ways")
    steps, cells = 1, state.now.count()
    while steps <= cells and not (active := state.now.where(F.col("to") != outlet)).isEmpty():
        jump = state.now.select(F.col("cell").alias("to"), F.col("to").alias("next"), F.col("length").alias("more"))
        further = active.join(jump, "to").select("cell", F.col("next").alias("to"), (F.col("length") + F.col("more")).alias("length"))
        state.step(state.now.where(F.col("to") == outlet).union(further))
        steps *= 2
    return state.now.where(F.col("to") == outlet).select("cell", "length")


def area(edge: DataFrame, outlet: int, inlets: list[int] = ()) -> DataFrame:
    """cell: all that drains to the outlet, itself included, not beyond inlets; none for a cell that nothing drains to."""
    above = _reaching(edge, outlet, [*inlets]).select("cell")
    return above.union(above.limit(1).select(F.lit(outlet).cast("bigint").alias("cell")))


def path_lengths(edge: DataFrame, outlet: int, grid: Grid) -> DataFrame:
    """start, stop, length of the flow path of every cell of an outlet's area; the outlet's own has length 0."""
    ways = _reaching(edge, outlet, [], grid).select(F.col("cell").alias("start"), F.lit(outlet).cast("bigint").alias("stop"), "length")
    own = edge.where(F.col("cell") == outlet).agg(F.max("down").alias("stop"))
    return ways.union(own.select(F.lit(outlet).cast("bigint"), "stop", F.lit(0.0)))


def river(edge: DataFrame, start: int, grid: Grid) -> DataFrame:
    """step, cell, dist, dx, dy, x, y of the way down from a cell; dx and dy are up minus down.

    Each round doubles every cell's pointer and with it the known part of the way.
    """
    spark, n = edge.sparkSession, grid.ncols
    pointers = Rounds(edge.where("down >= 0").select("cell", F.col("down").alias("to"), F.col("cell").alias("before"), _length(grid, F.col("cell"), F.col("down")).alias("length")), "pointers")
    way = Rounds(spark.createDataFrame([(start, 0, 0.0, start)], "cell bigint, step int, dist double, before bigint"), "way")
    steps, cells = 1, pointers.now.count()
    while True:
        more = way.now.drop("before").join(pointers.now.where("to is not null"), "cell")
        if more.isEmpty():
            break
        if steps > cells:
            raise ValueError("the way down goes in a circle")
        way.step(way.now.union(more.select("to", (F.col("step") + steps).cast("int"), F.col("dist") + F.col("length"), "before")))
        jump = pointers.now.select(F.col("cell").alias("to"), F.col("to").alias("next"), F.col("before").alias("last"), F.col("length").alias("rest"))
        pointers.step(pointers.now.join(jump, "to", "left").select("cell", F.col("next").alias("to"), F.col("last").alias("before"), (F.col("length") + F.col("rest")).alias("length")))
        steps *= 2
    dx, dy = F.col("before") % n - F.col("cell") % n, F.floor(F.col("before") / n) - F.floor(F.col("cell") / n)
    return way.now.select("step", "cell", "dist", dx.alias("dx"), dy.alias("dy"), grid.x(F.col("cell")).alias("x"), grid.y(F.col("cell")).alias("y"))


def accumulate(edge: DataFrame, field: DataFrame, receiver: bool = True, max_accumulated_cells: int = -1) -> DataFrame:
    """cell, value: what drains to each cell that drains on, its own value included.

    With `receiver` every cell above adds the receiving cell's own value, else its own. Only cells up
    to `max_accumulated_cells` + 1 steps above add, if that isn't -1. Round k holds the sums of all
    cells less than 2^k steps above and pointers 2^k steps down, so a row per cell and a number of
    rounds that is the logarithm of the longest way. Raises on a circle, if no such bound ends it.
    """
    if max_accumulated_cells != -1 and max_accumulated_cells < 1:
        raise ValueError("max_accumulated_cells must be -1 or at least 1")
    own = edge.where("down >= 0").select("cell", "down")
    to = own.join(own.select(F.col("cell").alias("down"), F.lit(True).alias("on")), "down", "left").select("cell", F.when(F.col("on"), F.col("down")).alias("to"))
    total = F.lit(1.0) if receiver else F.coalesce(F.col("value").cast("double"), F.lit(0.0))
    state = Rounds(to.join(field, "cell").select("cell", "to", total.alias("total")), "sums")
    reach = max_accumulated_cells + 2 if max_accumulated_cells != -1 else 0
    done, k, cells = None, 0, state.now.count()

    def gained(totals):
        """The cells' sums and, 2^k steps further, those of `totals` (cell, total)."""
        up = state.now.select("cell", "to").where("to is not null").join(totals.select("cell", "total"), "cell")
        more = up.groupBy(F.col("to").alias("cell")).agg(F.sum("total").alias("more"))
        return state.now.join(more, "cell", "left").select("cell", "to", (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"))

    while True:
        if reach >> k & 1:
            done = written(gained(done).select("cell", "total") if done else state.now.select("cell", "total"), "sums")[0]
        if reach and not reach >> (k + 1):
            break
        if state.now.where("to is not null").isEmpty():
            done = state.now
            break
        if not reach and 1 << k > cells:
            raise ValueError("the network has a circle")
        summed = gained(state.now)
        jump = state.now.select(F.col("cell").alias("to"), F.col("to").alias("next"))
        state.step(summed.join(jump, "to", "left").select("cell", F.col("next").alias("to"), "total"))
        k += 1
    if not receiver:
        return done.select("cell", F.col("total").alias("value"))
    return done.join(field, "cell").select("cell", (F.col("total") * F.col("value")).alias("value"))


def filled(cells: DataFrame, grid: Grid) -> DataFrame:
    """cell: an area with its holes, i.e. all that a flood from the border round its box doesn't reach.

    One catchment's box is a bitmap on the driver: a bit for each cell.
    """
    box = cells.agg(F.min(grid.row(F.col("cell"))), F.max(grid.row(F.col("cell"))), F.min(grid.col(F.col("cell"))), F.max(grid.col(F.col("cell")))).first()
    r0, r1, c0, c1 = box[0] - 1, box[1] + 1, box[2] - 1, box[3] + 1
    w, h = c1 - c0 + 1, r1 - r0 + 1
    spark = cells.sparkSession
    own = cells.select((grid.row(F.col("cell")) - r0).alias("r"), (grid.col(F.col("cell")) - c0).alias("c"))
    import numpy as np

    taken = np.zeros((h, w), bool)  # a bit for each cell of the area's box
    for r in own.collect():
        taken[r["r"], r["c"]] = True
    out = np.zeros_like(taken)
    out[0, 0] = True
    while True:
        grown = out.copy()
        grown[1:] |= out[:-1]
        grown[:-1] |= out[1:]
        grown[:, 1:] |= out[:, :-1]
        grown[:, :-1] |= out[:, 1:]
        grown &= ~taken
        if (grown == out).all():
            break
        out = grown
    found = [(int(r + r0) * grid.ncols + int(c + c0),) for r, c in zip(*np.nonzero(~out), strict=True)]
    return spark.createDataFrame(found, "cell long")


def boundary_cells(cells: DataFrame, grid: Grid) -> DataFrame:
    """cell: those of an area with a side neighbour outside it."""
    sides = F.array(*[F.struct((grid.row(F.col("cell")) + a).alias("r"), (grid.col(F.col("cell")) + b).alias("c")) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))])
    near = cells.select("cell", F.explode(sides).alias("n"))
    inside = F.col("n.r").between(0, grid.nrows - 1) & F.col("n.c").between(0, grid.ncols - 1)
    near = near.select("cell", F.when(inside, F.col("n.r") * grid.ncols + F.col("n.c")).otherwise(-1).alias("other"))
    return near.join(cells.select(F.col("cell").alias("other")), "other", "left_anti").select("cell").distinct()


def boundary(cells: DataFrame, grid: Grid) -> DataFrame:
    """seq, cell, x, y: boundary cells in order, each followed by the nearest one left, closed at the start.

    The way depends on what was visited, so one area is one pandas loop.
    """
    n = grid.ncols

    def run(pdf):
        import numpy as np
        import pandas as pd

        left = sorted(pdf["cell"].tolist())
        total, way = len(left), [left[0]]
        pending = np.array(left[1:], dtype=np.int64)
        while len(pending):
            r, c = divmod(way[-1], n)
            d = (pending // n - r) ** 2 + (pending % n - c) ** 2
            k = int(d.argmin())
            r0, c0 = divmod(way[0], n)
            if len(way) > 0.8 * total and (r0 - r) ** 2 + (c0 - c) ** 2 < d[k]:
                break
            way.append(int(pending[k]))
            pending = np.delete(pending, k)
        way.append(way[0])
        return pd.DataFrame({"seq": range(len(way)), "cell": way})

    out = boundary_cells(cells, grid).withColumn("area", F.lit("one")).groupBy("area").applyInPandas(run, "seq int, cell bigint")
    return out.select("seq", "cell", grid.x(F.col("cell")).alias("x"), grid.y(F.col("cell")).alias("y"))


def shoelace_area(line: DataFrame, seq: str = "seq", x: str = "x", y: str = "y") -> DataFrame:
    """area in km2 of a closed line in metres."""
    from pyspark.sql import Window

    w = Window.partitionBy(F.lit(0)).orderBy(seq)
    t = line.select((F.col(x) * F.lead(y).over(w) - F.lead(x).over(w) * F.col(y)).alias("d"))
    return t.agg((F.abs(F.sum("d")) * 0.5e-6).alias("area"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("cell").union(b.select("cell")).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("cell").distinct().join(b.select("cell"), "cell", "left_anti")


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("cell").distinct().join(b.select("cell"), "cell", "left_semi")


def contains(cells: DataFrame, others: DataFrame) -> DataFrame:
    """`others` with `inside`: whether its cell is one of an area's."""
    own = cells.select("cell").distinct().withColumn("inside", F.lit(True))
    return others.join(own, "cell", "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def extent(cells: DataFrame, grid: Grid) -> DataFrame:
    """xmin, xmax, ymin, ymax of an area's cells."""
    h, x, y = grid.cellsize / 2, grid.x(F.col("cell")), grid.y(F.col("cell"))
    return cells.agg((F.min(x) - h).alias("xmin"), (F.max(x) + h).alias("xmax"), (F.min(y) - h).alias("ymin"), (F.max(y) + h).alias("ymax"))
