"""Images: whole, in tiles, cut out, in batches, and their statistics."""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
from array import array
from collections.abc import Iterator, Sequence
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import images, layout
from ..sources.header import BLOCK, HDU, Header, check_name, find, index
from .table import register

_SECTION = re.compile(r"(.*?)(?:\[([^\[\]:,]+)\])?(?:\[([\d:,\s]+)\])\Z")


def read_image(path: str, hdu: int | str | None = None, raw: bool = False) -> np.ndarray:
    """All pixels of one image on the driver. A name like ``file[0][1:100,1:50]`` cuts out 1-based inclusive ranges."""
    bare, unit_name, box = parse_section(path)
    if box is not None:
        unit = find(bare, unit_name if unit_name is not None else 0)
        return images.read_array(bare, unit, box, raw)
    return images.read_array(path, _image(path, hdu), raw=raw)


def _image(path: str, hdu: int | str | None) -> HDU:
    unit = find(path, hdu)
    if unit.kind in ("BINTABLE", "TABLE"):
        raise ValueError(f"{path}: unit {unit.number} is a table")
    return unit


def parse_section(name: str) -> tuple[str, str | None, tuple[slice, ...] | None]:
    """File, unit and box (C order, 0-based) of an extended name; no box where the name has no section."""
    found = _SECTION.match(name)
    if not found or not found[3]:
        return name, None, None
    box = []
    for part in reversed(found[3].split(",")):
        low, _, high = part.partition(":")
        box.append(slice(int(low) - 1, int(high or low)))
    return found[1], found[2], tuple(box)


def cutout(path: str, hdu: int | str, x1: int, y1: int, x2: int, y2: int, raw: bool = False) -> np.ndarray:
    """Pixels with x1 <= x < x2 and y1 <= y < y2, cut at the borders, of the first plane; only tiles that overlap are read."""
    unit = _image(path, hdu)
    shape = images.image_shape(unit)
    if len(shape) < 2:
        raise ValueError("a cutout needs two axes")
    ys, xs = slice(max(0, y1), min(y2, shape[-2])), slice(max(0, x1), min(x2, shape[-1]))
    if ys.stop <= ys.start or xs.stop <= xs.start:
        return np.zeros((0, 0), images.stored_dtype(unit))
    box = tuple(slice(0, 1) for _ in shape[:-2]) + (ys, xs)
    return images.read_array(path, unit, box, raw).reshape(ys.stop - ys.start, xs.stop - xs.start)


class SubsetReader:
    """Many cutouts of one image; nothing can be read once it is closed."""

    def __init__(self, path: str, hdu: int | str = 0) -> None:
        self.path, self.hdu, self.closed = path, _image(path, hdu).number, False

    def __call__(self, x1: int, y1: int, x2: int, y2: int) -> np.ndarray:
        if self.closed:
            raise ValueError("the reader is closed")
        return cutout(self.path, self.hdu, x1, y1, x2, y2)

    def close(self) -> None:
        self.closed = True

    def __enter__(self) -> SubsetReader:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


class LazyImage:
    """``image[y, x]`` with integers and slices, negative ones from the end, steps of 1."""

    def __init__(self, path: str, hdu: int | str = 0) -> None:
        self.path, self.unit = path, _image(path, hdu)
        self.shape = images.image_shape(self.unit)

    def __getitem__(self, key: tuple) -> np.ndarray:
        if not isinstance(key, tuple) or len(key) != 2 or len(self.shape) != 2:
            raise ValueError("two axes are needed")
        box, drop = [], []
        for axis, (k, n) in enumerate(zip(key, self.shape, strict=True)):
            if isinstance(k, slice):
                if k.step not in (None, 1):
                    raise ValueError("the step must be 1")
                box.append(slice(*k.indices(n)[:2]))
            else:
                at = k + n if k < 0 else k
                if not 0 <= at < n:
                    raise IndexError(f"{k} of an axis of {n}")
                box.append(slice(at, at + 1))
                drop.append(axis)
        return np.squeeze(images.read_array(self.path, self.unit, tuple(box)), axis=tuple(drop))


def tiles(spark: SparkSession, path: str | Sequence[str], hdu: int | str = "auto", hdus: Sequence[int | str] | None = None, strict: bool = True) -> DataFrame:
    """Rows (path, hdu, tile, origin, shape, pixels) of one or many images; with ``strict`` off, files that can't be read are
    passed over."""
    register(spark)
    options = {"as": "tiles", "hdu": str(hdu), "mode": "FAILFAST" if strict else "PERMISSIVE"}
    options |= {"path": check_name(path)} if isinstance(path, str) else {"paths": json.dumps(list(path)), "path": path[0] if path else ""}
    if hdus is not None:
        options["hdus"] = json.dumps(list(hdus))
    return spark.read.format("hdu").options(**options).load()


def stats(tiles_: DataFrame) -> DataFrame:
    """Per image: pixels, NaN, least, greatest, mean and standard deviation of the others. Each tile is reduced to sums first, so
    one row a tile is shuffled; deviations are added up about each tile's own mean."""

    def reduce(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = []
            pixels = batch.column(2)
            for k in range(batch.num_rows):
                x = pixels[k].values.to_numpy(zero_copy_only=False)
                good = x[~np.isnan(x)]
                mean = float(good.mean()) if len(good) else 0.0
                out.append((len(x), len(x) - len(good), len(good), float(good.min()) if len(good) else None, float(good.max()) if len(good) else None, mean, float(((good - mean) ** 2).sum())))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["path", "hdu", "count", "nan", "n", "low", "high", "mean", "m2"])

    schema = "path string, hdu int, count bigint, nan bigint, n bigint, low double, high double, mean double, m2 double"
    parts = tiles_.select("path", "hdu", "pixels").mapInArrow(reduce, schema)
    total = F.sum("n")
    mean = F.sum(F.col("n") * F.col("mean")) / total
    spread = F.sum(F.col("m2") + F.col("n") * F.col("mean") ** 2) - total * mean**2
    return parts.groupBy("path", "hdu").agg(F.sum("count").alias("pixels"), F.sum("nan").alias("nans"), F.min("low").alias("min"), F.max("high").alias("max"), mean.alias("mean"), F.sqrt(F.greatest(spread, F.lit(0.0)) / total).alias("stddev"))


#: Rows of boxes and bands that are broadcast, at most.
SMALL = 100_000


def cutouts(tiles_: DataFrame, boxes: DataFrame, cell: int = 256) -> DataFrame:
    """Many cutouts at once: ``boxes`` has id, x1, y1, x2, y2 (0-based, ends excluded), and path and hdu where a box is about one
    image only. Rows (id, y, x, value) of two-axis images. The overlap of boxes and tiles becomes a join on bands of ``cell`` rows,
    and on the image where boxes name it; up to ``SMALL`` boxes are broadcast, so that no pixels are shuffled."""
    top, rows, x0, wide = F.col("origin")[0], F.col("shape")[0], F.col("origin")[1], F.col("shape")[1]
    bands = lambda first, last: F.explode(F.sequence((first / cell).cast("long"), (last / cell).cast("long")))
    left = tiles_.where(rows > 0).withColumn("band", bands(top, top + rows - 1))
    right = boxes.where("y2 > y1 AND x2 > x1 AND y2 > 0 AND x2 > 0").withColumn("band", bands(F.greatest("y1", F.lit(0)), F.col("y2") - 1))
    few = right.limit(SMALL + 1).count() <= SMALL
    met = left.join(F.broadcast(right) if few else right, ["band", *(c for c in ("path", "hdu") if c in boxes.columns)]).where((F.col("x1") < x0 + wide) & (F.col("x2") > x0))
    low = F.greatest(F.col("y1"), top, F.col("band") * cell)
    high = F.least(F.col("y2"), top + rows, (F.col("band") + 1) * cell)
    x_low, x_high = F.greatest(F.col("x1"), x0), F.least(F.col("x2"), x0 + wide)
    met = met.withColumn("low", low).withColumn("high", high).withColumn("x_low", x_low).withColumn("x_high", x_high).where("high > low AND x_high > x_low")
    lines = met.withColumn("y", F.explode(F.sequence(F.col("low").cast("long"), F.col("high").cast("long") - 1)))
    start = (F.col("y") - top) * wide + (F.col("x_low") - x0)
    part = F.slice("pixels", (start + 1).cast("int"), (F.col("x_high") - F.col("x_low")).cast("int"))
    return lines.select("id", "y", F.posexplode(part).alias("k", "value"), "x_low").select("id", "y", (F.col("x_low") + F.col("k")).alias("x"), "value")


def write_image(path: str, pixels: np.ndarray, header: Header | dict | None = None, overwrite: bool = False, compress: bool | str = False) -> None:
    """A primary image; compressed, an empty primary unit and one of tiles. ``compress``: true for Rice, or a codec's name."""
    if compress:
        units = [layout.primary_header().to_bytes(), images.compressed_unit(pixels, "RICE" if compress is True else compress, header=header)]
    else:
        units = [layout.image_unit(pixels, True, header=header)]
    layout.write_units(path, units, overwrite)


def write_lines(path: str, lines: DataFrame, dtype: str, compress: bool | str = False, overwrite: bool = False) -> None:
    """An image of two axes from rows (y, pixels), y from 0 without gaps, all lines of one width. Tasks encode them in the order of
    y; the driver appends what comes to a file beside the target, and holds one partition of it and the size of each line."""
    path, kind, stored = check_name(path.removeprefix("!")), "", np.dtype(dtype)
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    if compress:
        kind = images.CODECS["RICE" if compress is True else compress.upper()]
        if (stored.kind == "f" and not kind.startswith("GZIP")) or (stored.itemsize == 8 and kind == "RICE_1"):
            kind = "GZIP_2"

    def encode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            pixels = [np.asarray(x.values.to_numpy(zero_copy_only=False), stored) for x in batch.column(1)]
            data = [images.pack(x[None, :], kind) if kind else layout.image_bytes(x) for x in pixels]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, pixels)), pa.int32()), pa.array(data, pa.binary())], names=["y", "n", "data"])

    part, width, sizes = f"{path}.{uuid.uuid4().hex}", 0, array("q")
    try:
        with open(part, "wb") as out:
            for r in lines.select(F.col("y").cast("long"), "pixels").orderBy("y").mapInArrow(encode, "y bigint, n int, data binary").toLocalIterator():
                if r.y != len(sizes) or r.n != (width or r.n):
                    raise ValueError(f"line {r.y} of {r.n} pixels where line {len(sizes)} of {width or r.n} should be")
                width = r.n
                sizes.append(out.write(r.data))
        shape, packed = (len(sizes), width), np.array(sizes, np.int64)

        def write(file: BinaryIO) -> None:
            if kind:
                head, rows = images.compressed_head(kind, stored, shape, (1, width), packed)
                file.write(layout.primary_header().to_bytes() + head + rows)
            else:
                rows = b""
                file.write(layout.image_header(shape, stored.name, True).to_bytes())
            with open(part, "rb") as data:
                shutil.copyfileobj(data, file)
            file.write(bytes(-(len(rows) + int(packed.sum())) % BLOCK))

        layout.replace_file(path, write)
    finally:
        os.remove(part)


def write_units(path: str, payloads: Sequence, overwrite: bool = False) -> None:
    """A file of several units: arrays, Arrow tables or dictionaries of columns; a primary unit is put first if needed."""
    from .mutate import _unit_bytes

    units = []
    for k, payload in enumerate(payloads):
        is_image = isinstance(payload, np.ndarray)
        if k == 0 and not is_image:
            units.append(layout.primary_header().to_bytes())
        units.append(_unit_bytes(payload, None, None, False, k == 0 and is_image))
    layout.write_units(path, units or [layout.primary_header().to_bytes()], overwrite)


def batch_info(paths: Sequence[str]) -> dict[str, int]:
    return {"num_files": len(paths), "valid_files": sum(map(os.path.exists, paths))}


def catalog(spark: SparkSession, path: str | Sequence[str], strict: bool = True) -> DataFrame:
    """One row per unit of one or many files."""
    register(spark)
    options = {"as": "catalog", "mode": "FAILFAST" if strict else "PERMISSIVE"} | ({"path": check_name(path)} if isinstance(path, str) else {"paths": json.dumps(list(path)), "path": path[0] if path else ""})
    return spark.read.format("hdu").options(**options).load()


def headers(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One row per card of all units."""
    register(spark)
    options = {"as": "headers"} | ({"path": check_name(path)} if isinstance(path, str) else {"paths": json.dumps(list(path)), "path": path[0] if path else ""})
    return spark.read.format("hdu").options(**options).load()


def header(path: str, hdu: int | str | None = None) -> Header:
    return find(path, hdu).header


def info(path: str) -> str:
    lines = ["No.  Name             Type              Cards  Dimensions"]
    for u in index(path):
        size = f"{u.header.get('NAXIS2')}R x {u.header.get('TFIELDS')}C" if u.kind in ("BINTABLE", "TABLE") else str(tuple(images.image_shape(u)))
        lines.append(f"{u.number:<4} {u.name:<16} {u.kind:<17} {len(u.header.cards):<6} {size}")
    return "\n".join(lines)
