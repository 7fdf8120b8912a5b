"""Raster layers as pixel tables (layer_id, row, col, value): Parquet as is, GeoTIFF decoded in Arrow batches.

The TIFF reader takes single-band files, classic or BigTIFF, striped or tiled,
uncompressed, deflate, LZW, PackBits or Zstandard, in the usual sample types,
with predictor 1, 2 or 3. Each file is one task, which decodes and hands on
one strip or tile after the other; a grid is read from the header alone.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.scalars import finite


class RasterError(ValueError):
    """A raster or a stack of them breaks its contract."""


_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}


def lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, highest bit first, one code early; 256 clears, 257 ends."""
    out, table, width, held, bits, last = [], [], 9, 0, 0, b""
    single = [bytes([i]) for i in range(256)]
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [], 9, b""
            continue
        if code < 256:
            word = single[code]
        elif code - 258 < len(table):
            word = table[code - 258]
        elif last:
            word = last + last[:1]
        else:
            raise RasterError("a broken LZW strip")
        out.append(word)
        if last:
            table.append(last + word[:1])
            width = min(12, max(9, (len(table) + 259).bit_length()))
        last = word
    return b"".join(out)


def packbits(data: bytes) -> bytes:
    """Runs and literals of PackBits."""
    out, at = [], 0
    while at < len(data):
        n, at = data[at], at + 1
        if n < 128:
            out.append(data[at : at + n + 1])
            at += n + 1
        elif n > 128:
            out.append(data[at : at + 1] * (257 - n))
            at += 1
    return b"".join(out)


def _zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


_UNPACK = {1: bytes, 5: lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: packbits, 50000: _zstd}


class Tiff:
    """A single-band TIFF: its header at once, its pixels block by block."""

    def __init__(self, data: bytes):
        try:
            order, tags = self._tags(data)
        except struct.error as e:
            raise RasterError("a broken TIFF header") from e
        if not {256, 257} <= tags.keys():
            raise RasterError("a TIFF without size")
        one = lambda tag, default=None: tags[tag][0] if tag in tags else default
        self.data, self.width, self.height = data, one(256), one(257)
        if one(277, 1) != 1:
            raise RasterError("a single band is needed")
        self.packing, self.predictor, form, bits = one(259, 1), one(317, 1), one(339, 1), one(258, 8)
        if self.packing not in _UNPACK or self.predictor not in (1, 2, 3) or (self.predictor == 3 and form != 3):
            raise RasterError(f"compression {self.packing} with predictor {self.predictor} is not supported")
        self.kind = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[form] }{bits // 8}")
        tiled = 322 in tags
        self.w, self.h = (one(322), one(323)) if tiled else (self.width, min(one(278, self.height), self.height))
        self.offsets, self.counts = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
        self.nodata = float(tags[42113]) if tags.get(42113, "").strip() else None
        scale, tie = tags.get(33550, (1.0, 1.0, 0.0)), tags.get(33922, (0, 0, 0, 0.0, 0.0, 0.0))
        self.transform = (scale[0], 0.0, tie[3] - tie[0] * scale[0], 0.0, -scale[1], tie[4] + tie[1] * scale[1])
        keys = tags.get(34735, ())
        self.epsg = next((keys[i + 3] for i in range(4, len(keys), 4) if keys[i] == 3072 and keys[i + 1] == 0), None)

    @staticmethod
    def _tags(data: bytes) -> tuple[str, dict]:
        order = {b"II": "<", b"MM": ">"}.get(data[:2])
        magic = struct.unpack_from(order + "H", data, 2)[0] if order else 0
        if magic not in (42, 43):
            raise RasterError("not a TIFF")
        big = magic == 43
        word, count, entry, inline = ("Q", "Q", 20, 8) if big else ("I", "H", 12, 4)
        at = struct.unpack_from(order + word, data, 8 if big else 4)[0]
        first = at + struct.calcsize("<" + count)
        tags: dict = {}
        for i in range(struct.unpack_from(order + count, data, at)[0]):
            here = first + entry * i
            tag, kind, n = struct.unpack_from(order + "HH" + word, data, here)
            spot = here + entry - inline
            if _SIZES.get(kind, 1) * n > inline:
                spot = struct.unpack_from(order + word, data, spot)[0]
            if kind == 2:
                tags[tag] = data[spot : spot + n].rstrip(b"\0").decode("latin-1")
            elif kind in _CODES:
                tags[tag] = struct.unpack_from(f"{order}{n}{_CODES[kind]}", data, spot)
        return order, tags

    def blocks(self):
        """(first row, first column, values as float64 with nodata as NaN) of each strip or tile, cut to the raster."""
        across, unpack = -(-self.width // self.w), _UNPACK[self.packing]
        for i, (start, size) in enumerate(zip(self.offsets, self.counts, strict=True)):
            r, c = i // across * self.h, i % across * self.w
            raw = unpack(self.data[start : start + size])
            rows = len(raw) // (self.w * self.kind.itemsize)
            raw = raw[: rows * self.w * self.kind.itemsize]
            if self.predictor == 3:  # bytes of equal weight stand together, highest first, each as the difference to the one before
                planes = np.cumsum(np.frombuffer(raw, dtype=np.uint8).reshape(rows, -1), axis=1, dtype=np.uint8)
                planes = planes.reshape(rows, self.kind.itemsize, self.w).transpose(0, 2, 1)
                block = np.ascontiguousarray(planes).view(self.kind.newbyteorder(">")).reshape(rows, self.w)
            else:
                block = np.frombuffer(raw, dtype=self.kind).reshape(rows, self.w)
                if self.predictor == 2:
                    block = np.cumsum(block, axis=1, dtype=self.kind)
            values = block[: max(0, self.height - r), : self.width - c].astype(float)
            if self.nodata is not None:
                values[values == self.nodata] = np.nan
            yield r, c, values

    def values(self) -> np.ndarray:
        out = np.zeros((self.height, self.width))
        for r, c, block in self.blocks():
            out[r : r + block.shape[0], c : c + block.shape[1]] = block
        return out


def read_tiff(data: bytes) -> dict:
    """values (float64, nodata as NaN), transform (a, b, c, d, e, f), nodata, epsg."""
    t = Tiff(data)
    return {"values": t.values(), "transform": t.transform, "nodata": t.nodata, "epsg": t.epsg}


def write_tiff(values: np.ndarray, transform: tuple, nodata: float | None = None, epsg: int | None = None) -> bytes:
    """A single-band float64 TIFF with one deflate strip, for tests and small products."""
    h, w = values.shape
    body = zlib.compress(np.ascontiguousarray(values, dtype="<f8").tobytes())
    entries = {256: (4, (w,)), 257: (4, (h,)), 258: (3, (64,)), 259: (3, (8,)), 262: (3, (1,)), 273: (4, (8,)), 277: (3, (1,)), 278: (4, (h,)), 279: (4, (len(body),)), 339: (3, (3,))}
    entries[33550], entries[33922] = (12, (transform[0], -transform[4], 0.0)), (12, (0.0, 0.0, 0.0, transform[2], transform[5], 0.0))
    if epsg:
        entries[34735] = (3, (1, 1, 0, 1, 3072, 0, 1, epsg))
    if nodata is not None:
        entries[42113] = (2, f"{nodata:g}\0".encode())
    at = 8 + len(body)
    extra, table, room = b"", b"", at + 2 + 12 * len(entries) + 4
    for tag, (kind, v) in sorted(entries.items()):
        raw = v if kind == 2 else struct.pack(f"<{len(v)}{_CODES[kind]}", *v)
        n = len(v)
        if len(raw) > 4:
            held, extra = struct.pack("<I", room + len(extra)), extra + raw
        else:
            held = raw.ljust(4, b"\0")
        table += struct.pack("<HHI", tag, kind, n) + held
    return struct.pack("<2sHI", b"II", 42, at) + body + struct.pack("<H", len(entries)) + table + struct.pack("<I", 0) + extra


def read_pixels(spark: SparkSession, path: str, nodata: float | None = None) -> DataFrame:
    """A Parquet pixel table; nodata, NaN and infinities become null."""
    rows = spark.read.parquet(path)
    v = finite(F.col("value"))
    return rows.withColumn("value", F.when(v != nodata, v) if nodata is not None else v)


def read_layers(spark: SparkSession, layers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pixels, grids) of GeoTIFF layers; masks (0 is invalid) and nodata make null.

    pixels: layer_id, row, col, value; grids: layer_id, a, b, c, d, e, f,
    height, width, epsg. Each layer is decoded by one task.
    """
    rows = layers.select("layer_id", "path", "quality_mask_path", "nodata", "ordinal")
    given = [r.asDict() for r in rows.collect()]  # one record for each layer
    paths = sorted({r["path"] for r in given} | {r["quality_mask_path"] for r in given if r["quality_mask_path"]})
    files = spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")
    joined = rows.join(files, "path").join(files.select(F.col("path").alias("quality_mask_path"), F.col("content").alias("mask")), "quality_mask_path", "left")

    def decode(frames):
        for frame in frames:
            for r in frame.itertuples():
                t, mask = Tiff(bytes(r.content)), None
                if r.mask is not None and not isinstance(r.mask, float):
                    m = Tiff(bytes(r.mask))
                    if (m.height, m.width, m.transform) != (t.height, t.width, t.transform):
                        raise RasterError(f"{r.layer_id}: the quality mask's grid differs")
                    mask = m.values() == 0
                for r0, c0, v in t.blocks():
                    h, w = v.shape
                    if r.nodata is not None and not pd.isna(r.nodata):
                        v[v == r.nodata] = np.nan
                    if mask is not None:
                        v[mask[r0 : r0 + h, c0 : c0 + w]] = np.nan
                    flat = v.ravel()
                    yield pd.DataFrame({"layer_id": r.layer_id, "row": np.repeat(np.arange(r0, r0 + h, dtype=np.int32), w), "col": np.tile(np.arange(c0, c0 + w, dtype=np.int32), h), "value": np.where(np.isfinite(flat), flat, np.nan)})

    def grid(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples():
                t = Tiff(bytes(r.content))  # the header alone
                out.append((r.layer_id, *t.transform, t.height, t.width, t.epsg))
            yield pd.DataFrame(out, columns=["layer_id", "a", "b", "c", "d", "e", "f", "height", "width", "epsg"])

    one = joined.repartition("layer_id")
    pixels = one.select("layer_id", "content", "mask", "nodata").mapInPandas(decode, "layer_id string, row int, col int, value double")
    pixels = pixels.withColumn("value", finite(F.col("value")))
    grids = one.select("layer_id", "content").mapInPandas(grid, "layer_id string, a double, b double, c double, d double, e double, f double, height int, width int, epsg int")
    return pixels, grids


def check_stack(layers: DataFrame, grids: DataFrame, crs: str, aoi: tuple[float, float, float, float] | None = None) -> None:
    """Raise where layers disagree: no layer, another CRS or resolution than declared, several grids of one resolution, an area not covered."""
    rows = layers.join(grids, "layer_id", "left")
    if layers.limit(1).count() == 0:
        raise RasterError("the manifest has no raster layers")
    bad = rows.where(F.col("a").isNull() | (F.abs(F.col("a") - F.col("resolution_m")) > 1e-6) | (F.abs(F.col("e") + F.col("resolution_m")) > 1e-6)).select("layer_id").limit(3).collect()
    if bad:
        raise RasterError(f"resolution differs from the manifest: {[r[0] for r in bad]}")
    other = rows.where((F.col("crs") != crs) | (F.col("epsg").isNotNull() & (F.concat(F.lit("EPSG:"), F.col("epsg").cast("string")) != crs))).select("layer_id").limit(3).collect()
    if other:
        raise RasterError(f"CRS differs from the manifest: {[r[0] for r in other]}")
    several = rows.groupBy("resolution_m").agg(F.count_distinct(F.struct("a", "b", "c", "d", "e", "f", "height", "width")).alias("n")).where("n > 1").limit(1).count()
    if several:
        raise RasterError("layers of one resolution lie on several grids")
    if aoi is not None:
        x0, y0, x1, y1 = aoi
        short = rows.where((F.col("c") > x0) | (F.col("f") < y1) | (F.col("c") + F.col("a") * F.col("width") < x1) | (F.col("f") + F.col("e") * F.col("height") > y0)).select("layer_id").limit(3).collect()
        if short:
            raise RasterError(f"the area is not covered by {[r[0] for r in short]}")
