"""Grids as a header and a table of cells (cell, value): cell 0 is the top left one, rows run east."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.functions.nulls import clean, ratio


@dataclass(frozen=True)
class Grid:
    """Geometry of a raster; x and y of the lower left corner."""

    ncols: int
    nrows: int
    cellsize: float = 1.0
    xll: float = 0.0
    yll: float = 0.0
    nodata: float = 0.0
    dtype: str = "float64"
    name: str = "grid"
    comment: str = ""

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Grid:
        return cls(**json.loads(text))

    def same_geometry(self, other: Grid) -> bool:
        return (self.ncols, self.nrows) == (other.ncols, other.nrows) and all(math.isclose(getattr(self, k), getattr(other, k)) for k in ("cellsize", "xll", "yll"))

    def xlim(self) -> tuple[float, float]:
        return self.xll, self.xll + self.ncols * self.cellsize

    def ylim(self) -> tuple[float, float]:
        return self.yll, self.yll + self.nrows * self.cellsize

    def coord2cell(self, x: Column, y: Column) -> Column:
        """Cell of a place, -1 outside; division truncates towards 0."""
        col = ((x - self.xll) / self.cellsize).cast("bigint")
        row = F.lit(self.nrows - 1) - ((y - self.yll) / self.cellsize).cast("bigint")
        return F.when(col.between(0, self.ncols - 1) & row.between(0, self.nrows - 1), row * self.ncols + col).otherwise(-1)

    def valid(self, cell: Column) -> Column:
        return cell.between(0, self.ncols * self.nrows - 1)

    def row(self, cell: Column) -> Column:
        return F.when(self.valid(cell), F.floor(cell / self.ncols)).otherwise(-1).cast("bigint")

    def col(self, cell: Column) -> Column:
        return F.when(self.valid(cell), F.pmod(cell, F.lit(self.ncols))).otherwise(-1).cast("bigint")

    def x(self, cell: Column) -> Column:
        """Centre of a cell; NULL if there is no such cell."""
        return F.when(self.valid(cell), self.xll + self.cellsize * (F.pmod(cell, F.lit(self.ncols)) + 0.5))

    def y(self, cell: Column) -> Column:
        return F.when(self.valid(cell), self.yll + self.cellsize * (self.nrows - 1 - F.floor(cell / self.ncols) + 0.5))

    def neighbours(self, cell: Column) -> Column:
        """Array of the 3 x 3 cells around a cell, from the top left; -1 for itself and outside."""
        r, c = self.row(cell), self.col(cell)
        out = []
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                inside = (r + i).between(0, self.nrows - 1) & (c + j).between(0, self.ncols - 1)
                out.append(F.lit(-1).cast("bigint") if i == j == 0 else F.when(inside, cell + i * self.ncols + j).otherwise(-1).cast("bigint"))
        return F.when(self.valid(cell), F.array(*out)).otherwise(F.raise_error(F.lit("no such cell")))

    def clip_values(self, value: Column, low: float = -math.inf, high: float = math.inf) -> Column:
        if low > high:
            raise ValueError("the lower bound exceeds the upper one")
        return F.greatest(F.least(value, F.lit(high)), F.lit(low))

    def window(self, xll: float, yll: float, xur: float, yur: float) -> tuple[Grid, int, int]:
        """The part of the grid between two corners, with its first column and row here."""
        c0, c1 = (min(max(int((x - self.xll) / self.cellsize), 0), self.ncols - 1) for x in (xll, xur))
        r1, r0 = (self.nrows - 1 - min(max(int((y - self.yll) / self.cellsize), 0), self.nrows - 1) for y in (yll, yur))
        part = Grid(c1 - c0 + 1, r1 - r0 + 1, self.cellsize, self.xll + c0 * self.cellsize, self.yll + (self.nrows - 1 - r1) * self.cellsize, self.nodata, self.dtype, self.name)
        return part, c0, r0

    def clip(self, cells: DataFrame, xll: float, yll: float, xur: float, yur: float) -> tuple[Grid, DataFrame]:
        part, c0, r0 = self.window(xll, yll, xur, yur)
        r, c = self.row(F.col("cell")) - r0, self.col(F.col("cell")) - c0
        return part, cells.where(r.between(0, part.nrows - 1) & c.between(0, part.ncols - 1)).withColumn("cell", r * part.ncols + c)


def _literals(rows: list[dict], kind: str) -> Column:
    """A constant array of structs of any length: parsed once, so expressions don't grow with it."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{', '.join(': '.join(f.split()) for f in kind.split(', '))}>>")


def points_inside(points: DataFrame, x: str, y: str, polygon: list[tuple[float, float]], atol: float = 1e-8) -> DataFrame:
    """`points` with `inside`: box test, then even-odd ray casting, folded over one array of the edges.

    An edge holds its lower and upper y, its larger x, and the line at which points count as left of it.
    """
    px, py = F.col(x), F.col(y)
    xs, ys = [p[0] for p in polygon], [p[1] for p in polygon]
    edges = []
    for (ax, ay), (bx, by) in zip(polygon, [*polygon[1:], polygon[0]], strict=True):
        sloping = abs(bx - ax) >= atol and by != ay
        edges.append({"low": min(ay, by), "high": max(ay, by), "right": max(ax, bx), "x": ax, "y": ay, "run": (bx - ax) / (by - ay) if sloping else None})

    def cross(n, e):
        hit = (py > e["low"]) & (py <= e["high"]) & (px <= e["right"]) & F.coalesce(px <= (py - e["y"]) * e["run"] + e["x"], F.lit(True))
        return n + F.when(hit, 1).otherwise(0)

    crossings = F.aggregate(_literals(edges, "low double, high double, right double, x double, y double, run double"), F.lit(0), cross)
    box = px.between(min(xs), max(xs)) & py.between(min(ys), max(ys))
    return points.withColumn("inside", (box & (crossings % 2 == 1)).cast("int"))


def slope(edges: DataFrame, altitude: DataFrame, grid: Grid) -> DataFrame:
    """cell, slope along the flow: drop over distance; `edges` (cell, down), `altitude` (cell, value)."""
    z = edges.join(altitude.withColumnRenamed("value", "z"), "cell").join(altitude.select(F.col("cell").alias("down"), F.col("value").alias("zd")), "down", "left")
    straight = (F.col("down") - F.col("cell")).isin(1, -1, grid.ncols, -grid.ncols)
    return z.select("cell", ((F.col("z") - F.col("zd")) / F.when(straight, grid.cellsize).otherwise(grid.cellsize * math.sqrt(2))).alias("slope"))


def smooth(cells: DataFrame, grid: Grid, sigma: float = 5.0, coast: int = 50, low: float = -math.inf, mask: DataFrame | None = None) -> DataFrame:
    """cell, value: missing or low cells get the largest value near them, then a separable Gaussian
    filter, edges extended; cells whose mask is 0 are missing in the result."""
    v = F.when(clean("value") > low, clean("value"))
    x = cells.select("cell", grid.row(F.col("cell")).alias("r"), grid.col(F.col("cell")).alias("c"), v.alias("v"))
    half = coast // 2
    for a, b in (("r", "c"), ("c", "r")):
        x = x.withColumn(f"m{a}", F.max("v" if a == "r" else "mr").over(Window.partitionBy(a).orderBy(b).rowsBetween(-half, half)))
    x = x.withColumn("v", F.coalesce("v", "mc"))
    reach = int(4 * sigma + 0.5)
    kernel = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    total = sum(kernel)
    weights = F.array(*[F.lit(k / total) for k in kernel])
    for a, b, size in (("r", "c", grid.ncols), ("c", "r", grid.nrows)):
        line = x.groupBy(a).agg(F.transform(F.sort_array(F.collect_list(F.struct(b, "v"))), lambda s: s["v"]).alias("line"))
        spread = line.withColumn(b, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(size - 1).cast("bigint"))))
        at = F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda k: F.greatest(F.least(F.col(b) + k, F.lit(size - 1)), F.lit(0)).cast("int"))
        parts = F.zip_with(at, weights, lambda i, w: F.get("line", i) * w)
        x = spread.select("r", "c", F.aggregate(parts, F.lit(0.0), lambda s, q: s + q).alias("v"))
    out = x.select((F.col("r") * grid.ncols + F.col("c")).alias("cell"), F.col("v").alias("value"))
    if mask is not None:
        out = out.join(mask.select("cell", F.col("value").alias("__m")), "cell").select("cell", F.when(F.col("__m") != 0, F.col("value")).alias("value"))
    return out


def interpolate(cells: DataFrame, grid: Grid, to: Grid) -> DataFrame:
    """cell, value of another geometry, bilinear between the four nearest centres; missing outside them."""
    if grid.same_geometry(to):
        return cells.select("cell", "value")
    t = cells.sparkSession.range(to.ncols * to.nrows).withColumnRenamed("id", "target")
    fx = (to.x(F.col("target")) - grid.xll) / grid.cellsize - 0.5
    fy = (grid.nrows - 1) - ((to.y(F.col("target")) - grid.yll) / grid.cellsize - 0.5)
    t = t.withColumn("fx", fx).withColumn("fy", fy).where(F.col("fx").between(0, grid.ncols - 1) & F.col("fy").between(0, grid.nrows - 1))
    t = t.withColumn("i", F.least(F.floor("fy"), F.lit(max(grid.nrows - 2, 0)))).withColumn("j", F.least(F.floor("fx"), F.lit(max(grid.ncols - 2, 0))))
    u, v = F.col("fx") - F.col("j"), F.col("fy") - F.col("i")
    corner = [F.struct((F.col("i") + a).alias("r"), (F.col("j") + b).alias("c"), ((v if a else 1 - v) * (u if b else 1 - u)).alias("w")) for a in (0, 1) for b in (0, 1)]
    e = t.select("target", F.explode(F.array(*corner)).alias("k")).select("target", (F.col("k.r") * grid.ncols + F.col("k.c")).alias("cell"), "k.w").where("w > 0")
    got = e.join(cells, "cell").groupBy("target").agg(F.sum(F.col("w") * clean("value")).alias("value"), F.sum("w").alias("w"))
    return got.where("w > 1 - 1e-9").select(F.col("target").alias("cell"), "value")


def slice_at(cells: DataFrame, grid: Grid, points: DataFrame, key: str, x: str = "x", y: str = "y") -> DataFrame:
    """key, value at places: the plane through the nearest cell and its neighbours towards the place."""
    cell = grid.coord2cell(F.col(x), F.col(y))
    p = points.select(key, x, y, cell.alias("cell")).where("cell >= 0")
    dx, dy = (F.col(x) - grid.x(F.col("cell"))) / grid.cellsize, (F.col(y) - grid.y(F.col("cell"))) / grid.cellsize
    r, c = grid.row(F.col("cell")), grid.col(F.col("cell"))
    sx, sy = F.when(dx >= 0, 1).otherwise(-1), F.when(dy >= 0, 1).otherwise(-1)
    cx = F.when((c + sx).between(0, grid.ncols - 1), F.col("cell") + sx)
    cy = F.when((r - sy).between(0, grid.nrows - 1), F.col("cell") - sy * grid.ncols)
    p = p.select(key, "cell", F.abs(dx).alias("ax"), F.abs(dy).alias("ay"), cx.alias("cx"), cy.alias("cy"))
    for name, on in (("v", "cell"), ("vx", "cx"), ("vy", "cy")):
        p = p.join(cells.select(F.col("cell").alias(on), F.col("value").alias(name)), on, "left")
    flat = F.col("v") + F.col("ax") * (F.col("vx") - F.col("v")) + F.col("ay") * (F.col("vy") - F.col("v"))
    return p.select(key, F.coalesce(flat, "v").alias("value"))


def intersect(fine_cells: DataFrame, fine: Grid, coarse: Grid) -> DataFrame:
    """cell, weight of a coarse grid: the share of each of its cells that the fine cells cover."""
    at = coarse.coord2cell(fine.x(F.col("cell")), fine.y(F.col("cell")))
    return fine_cells.select(at.alias("cell")).where("cell >= 0").groupBy("cell").agg((F.count("*") * (fine.cellsize / coarse.cellsize) ** 2).alias("weight"))


def voronoi(cells: DataFrame, grid: Grid, points: list[tuple[float, float]]) -> DataFrame:
    """point, weight: the share of cells nearest to each of a list of points, the first winning ties."""
    x, y = grid.x(F.col("cell")), grid.y(F.col("cell"))
    places = _literals([{"i": i, "x": float(a), "y": float(b)} for i, (a, b) in enumerate(points)], "i int, x double, y double")
    nearest = F.array_min(F.transform(places, lambda p: F.struct(((x - p["x"]) * (x - p["x"]) + (y - p["y"]) * (y - p["y"])).alias("d"), p["i"].alias("i"))))
    got = cells.select(nearest["i"].alias("point")).groupBy("point").agg(F.count("*").alias("n"))
    total = cells.agg(F.count("*").alias("total"))
    spine = cells.sparkSession.range(len(points)).select(F.col("id").cast("int").alias("point"))
    out = spine.join(got, "point", "left").crossJoin(F.broadcast(total))  # one row
    return out.select("point", ratio(F.coalesce("n", F.lit(0)).cast("double"), F.col("total").cast("double")).alias("weight"))


def cells_inside(spark, grid: Grid, polygon: list[tuple[float, float]]) -> DataFrame:
    """cell: those whose centre is inside a polygon."""
    c = F.col("id")
    return points_inside(spark.range(grid.ncols * grid.nrows).select(c.alias("cell"), grid.x(c).alias("x"), grid.y(c).alias("y")), "x", "y", polygon).where("inside = 1").select("cell")
