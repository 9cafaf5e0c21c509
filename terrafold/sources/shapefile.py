"""A Spark data source for shapefiles (.shp with .dbf): polygons and lines.

``spark.read.format("shapefile").load(path)`` gives ``geometry`` (nested
points) and the .dbf columns as strings.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from terrafold.functions.geometry import GEOMETRY


def read_dbf(data: bytes) -> tuple[list[str], list[list[str | None]]]:
    n, head, size = struct.unpack("<IHH", data[4:12])
    fields, at = [], 32
    while data[at] != 0x0D:
        name = data[at : at + 11].split(b"\0")[0].decode("latin-1")
        fields.append((name, data[at + 16]))
        at += 32
    rows = []
    for i in range(n):
        record, at, own = data[head + i * size : head + (i + 1) * size], 1, []
        for _, width in fields:
            value = record[at : at + width].decode("utf-8", "replace").strip(" \0")
            own.append(value or None)
            at += width
        rows.append(own)
    return [f for f, _ in fields], rows


def _signed(ring: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2


def read_shapes(data: bytes) -> Iterator[list | None]:
    """Nested parts of each record; clockwise rings open a part, others are holes."""
    at = 100
    while at + 8 <= len(data):
        length = struct.unpack(">i", data[at + 4 : at + 8])[0] * 2
        body = data[at + 8 : at + 8 + length]
        at += 8 + length
        kind = struct.unpack("<i", body[:4])[0]
        if kind not in (3, 5, 13, 15, 23, 25):
            yield None
            continue
        n_parts, n_points = struct.unpack("<ii", body[36:44])
        starts = [*struct.unpack(f"<{n_parts}i", body[44 : 44 + 4 * n_parts]), n_points]
        flat = struct.unpack(f"<{2 * n_points}d", body[44 + 4 * n_parts : 44 + 4 * n_parts + 16 * n_points])
        points = list(zip(flat[::2], flat[1::2], strict=True))
        parts: list[list] = []
        for a, b in zip(starts, starts[1:], strict=False):
            ring = points[a:b]
            if kind in (5, 15, 25) and parts and _signed(ring) > 0:
                parts[-1].append(ring)
            else:
                parts.append([ring])
        yield parts


class ShapefileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def _fields(self) -> list[str]:
        with open(self.options["path"].removesuffix(".shp") + ".dbf", "rb") as f:
            return read_dbf(f.read())[0]

    def schema(self) -> str:
        return ", ".join([f"geometry {GEOMETRY}", "row_pos long", *(f"`{n}` string" for n in self._fields())])

    def reader(self, schema) -> ShapefileReader:
        return ShapefileReader(self.options["path"])


class ShapefileReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removesuffix(".shp")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]  # the records of a file have no places to split at

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(self.path + ".shp", "rb") as shp, open(self.path + ".dbf", "rb") as dbf:
            shapes, (_, rows) = read_shapes(shp.read()), read_dbf(dbf.read())
        for i, (parts, row) in enumerate(zip(shapes, rows, strict=False)):
            yield (None if parts is None else [[[(x, y) for x, y in ring] for ring in part] for part in parts], i, *row)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ShapefileSource)
