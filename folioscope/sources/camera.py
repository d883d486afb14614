"""A stream source of a made-up camera: frames of a moving pattern.

Stands in for a device where none is attached, as capture rules need a stream to run on.
Register with spark.dataSource.register(CameraSource), then
spark.readStream.format("camera").option("width", 1280).load().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "camera string, seq long, w int, h int, data binary"


def negotiated(options: dict) -> tuple[int, int]:
    """The size a device gives for the one asked for: as asked where it can, its own where the
    wish is larger or none."""
    top_w, top_h = int(options.get("max_width", 64)), int(options.get("max_height", 48))
    w, h = int(options.get("width", 0)), int(options.get("height", 0))
    return (w, h) if 0 < w <= top_w and 0 < h <= top_h else (top_w, top_h)


def frame(seq: int, w: int, h: int) -> bytes:
    """A bright square that wanders over a dark ramp."""
    x, y = np.meshgrid(np.arange(w), np.arange(h))
    px = np.repeat(((x + y) % 64)[..., None], 3, axis=2)
    side = max(1, min(w, h) // 3)
    at = (3 * seq) % max(1, w - side)
    px[:side, at : at + side] = 230
    return px.astype(np.uint8).tobytes()


def _rows(options: dict, first: int, last: int) -> Iterator[tuple]:
    w, h = negotiated(options)
    return ((options.get("device", "camera-0"), k, w, h, frame(k, w, h)) for k in range(first, last))


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.options, self.step, self.total = options, int(options.get("per_batch", 30)), int(options.get("frames", 1 << 40))

    def initialOffset(self) -> dict:
        return {"seq": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = min(self.total, start["seq"] + self.step)
        return iter(list(_rows(self.options, start["seq"], end))), {"seq": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return _rows(self.options, start["seq"], end["seq"])

    def commit(self, end: dict) -> None: ...


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _rows(self.options, 0, int(self.options.get("frames", 30)))


class CameraSource(DataSource):
    """Options: device, width, height (wished), max_width, max_height (the device's), frames, per_batch."""

    @classmethod
    def name(cls) -> str:
        return "camera"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(dict(self.options))
