"""ESRI band files: a text header and little-endian values, row by row."""

from __future__ import annotations

import io
import os
import zipfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from rillflow.operators.raster import Grid

KINDS = {"FLOAT": "f", "SIGNEDINT": "i", "UNSIGNEDINT": "u"}


def parse_header(text: str) -> Grid:
    """A grid from header lines; keys in any case, unknown keys ignored."""
    h = {k.upper(): v for k, v in (line.split(None, 1) for line in text.splitlines() if len(line.split(None, 1)) == 2)}
    nrows, ncols = int(h["NROWS"]), int(h["NCOLS"])
    if "XDIM" in h and float(h["XDIM"]) != float(h.get("YDIM", h["XDIM"])):
        raise ValueError("cells are not square")
    size = float(h.get("CELLSIZE", h.get("XDIM", 1)))
    if "ULXMAP" in h:
        x, y = float(h["ULXMAP"]), float(h["ULYMAP"]) - size * nrows
    else:
        x, y = float(h.get("XLLCORNER", 0)), float(h.get("YLLCORNER", 0))
    kind = KINDS[h.get("PIXELTYPE", "FLOAT").strip().upper()]
    dtype = np.dtype(f"{kind}{int(h.get('NBITS', 64)) // 8}").name
    return Grid(ncols, nrows, size, x, y, float(h.get("NODATA", h.get("NODATA_VALUE", 0))), dtype, h.get("NAME", "grid").strip(), h.get("COMMENT", "").strip())


def header_text(g: Grid) -> str:
    kind = {v: k for k, v in KINDS.items()}[np.dtype(g.dtype).kind]
    return f"NROWS {g.nrows}\nNCOLS {g.ncols}\nCELLSIZE {g.cellsize!r}\nXLLCORNER {g.xll!r}\nYLLCORNER {g.yll!r}\nPIXELTYPE {kind}\nNBITS {np.dtype(g.dtype).itemsize * 8}\nBYTEORDER I\nNODATA {g.nodata!r}\nNAME {g.name}\nCOMMENT {g.comment}\n"


def _values(content: bytes, grid: Grid):
    """Frames (cell, value) of a band's bytes."""
    import pandas as pd

    v = np.frombuffer(content, np.dtype(grid.dtype).newbyteorder("<"))
    if len(v) != grid.ncols * grid.nrows:
        raise ValueError(f"{len(v)} values for {grid.ncols * grid.nrows} cells")
    for k in range(0, len(v), 100_000):
        part = v[k : k + 100_000].astype(float)
        yield pd.DataFrame({"cell": np.arange(k, k + len(part)), "value": part})


def read_band(spark: SparkSession, path: str, grid: Grid) -> DataFrame:
    """cell, value of a band file."""

    def run(batches):
        for b in batches:
            for content in b["content"]:
                yield from _values(content, grid)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "cell long, value double")


def read_zip(spark: SparkSession, path: str, header: str) -> tuple[DataFrame | None, Grid]:
    """cell, value and geometry of a header and band in a zip file; without a band only the geometry."""
    base = os.path.splitext(header)[0]
    # of the archive the driver sees its names and the header alone
    head = spark.read.format("binaryFile").load(path).select("content").mapInPandas(_headers(base), "head string, band boolean").first()
    grid = parse_header(head["head"])
    if not head["band"]:
        return None, grid

    def run(batches):
        for b in batches:
            for content in b["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    yield from _values(z.read(base + ".bil"), grid)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "cell long, value double"), grid


def _headers(base: str):
    def run(batches):
        import pandas as pd

        for b in batches:
            for content in b["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    yield pd.DataFrame({"head": [z.read(base + ".hdr").decode()], "band": [base + ".bil" in z.namelist()]})

    return run


def write_band(cells: DataFrame, grid: Grid, path: str) -> None:
    """Header and band of a grid that fits the driver."""
    if not path.endswith(".bil"):
        raise ValueError("a band file ends with .bil")
    v = np.full(grid.ncols * grid.nrows, grid.nodata)
    for r in cells.toLocalIterator():
        v[r["cell"]] = r["value"]
    v.astype(np.dtype(grid.dtype).newbyteorder("<")).tofile(path)
    with open(path[:-4] + ".hdr", "w") as f:
        f.write(header_text(grid))
