"""Image files in and out: a decoded image source, encoders, and binary sinks."""

from __future__ import annotations

import os
import shutil
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .codec import jpeg, png, unpng

#: kinds of files that are written, with the ends of their names
EXTENSIONS = {"png": "png", "jpeg": "jpg"}


def is_image(mime: Column) -> Column:
    return mime.rlike("^image/")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Files as packed RGB images (id, w, h, data); what does not decode is left out."""
    raw = spark.read.format("image").option("dropInvalid", True).load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                px = np.frombuffer(r.data, dtype=np.uint8).reshape(r.height, r.width, r.nChannels)
                px = np.repeat(px, 3, axis=2) if r.nChannels == 1 else px[..., 2::-1]  # stored as BGR
                rows.append((r.origin, r.width, r.height, np.ascontiguousarray(px).tobytes()))
            yield pd.DataFrame(rows, columns=["id", "w", "h", "data"])

    return raw.select("image.origin", "image.width", "image.height", "image.nChannels", "image.data").mapInPandas(run, "id string, w int, h int, data binary")


def encode(images: DataFrame, kind: str = "png", quality: float = 0.9) -> DataFrame:
    """(id, w, h, file, n_bytes) of packed images as PNG or JPEG files; PNG has no quality."""
    if kind not in EXTENSIONS:
        raise ValueError(f"{kind} is not written; one of {', '.join(EXTENSIONS)} is")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                px = np.frombuffer(r.data, dtype=np.uint8).reshape(r.h, r.w, 3)
                body = png(px) if kind == "png" else jpeg(px, quality)
                yield pd.DataFrame([(r.id, r.w, r.h, body, len(body))], columns=["id", "w", "h", "file", "n_bytes"])

    return images.select("id", "w", "h", "data").mapInPandas(run, "id string, w int, h int, file binary, n_bytes long")


def decode_png(files: DataFrame) -> DataFrame:
    """(id, w, h, data) of PNG files (id, file), without a file system; what does not decode is left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                try:
                    px = unpng(r.file)
                except (ValueError, TypeError, KeyError, IndexError, struct.error, zlib.error):
                    continue
                yield pd.DataFrame([(r.id, px.shape[1], px.shape[0], np.ascontiguousarray(px).tobytes())], columns=["id", "w", "h", "data"])

    return files.select("id", "file").mapInPandas(run, "id string, w int, h int, data binary")


def write_folder(files: DataFrame, path: str, name: str = "id", body: str = "file") -> None:
    """One folder `name=...` for each row with its bytes in one file, by Spark's own writer and commit:
    any store that Spark reaches will do.  The writer ends a file with a line end, which image
    and PDF readers pass over.  Rows of one name lie side by side in its folder."""
    rows = files.select(F.col(name).cast("string").alias("name"), F.col(body).cast("string").alias("body"))
    rows.write.mode("overwrite").partitionBy("name").option("maxRecordsPerFile", 1).text(path)


def file_name(name: str) -> str:
    """The name of a file for a name: each has its own, and none leads out of its folder."""
    if not name:
        raise ValueError("a file needs a name")
    quoted = quote(name, safe=" ")
    return quoted if quoted.strip(".") else quoted.replace(".", "%2E")


class _Staged(WriterCommitMessage):
    def __init__(self, folder: str, names: list[str]):
        self.folder, self.names = folder, names


class _FileWriter(DataSourceWriter):
    """Tasks write into folders of their own; the driver moves the files of the tasks that
    count, and clears the rest away."""

    def __init__(self, path: str, job: str):
        self.path, self.stage = path, os.path.join(path, f".staged-{job}")

    def write(self, rows) -> WriterCommitMessage:
        folder, names = os.path.join(self.stage, uuid.uuid4().hex), []
        os.makedirs(folder, exist_ok=True)
        for row in rows:
            names.append(file_name(row[0]))
            with open(os.path.join(folder, names[-1]), "wb") as f:
                f.write(row[1])
        return _Staged(folder, names)

    def commit(self, messages) -> None:
        for m in messages:
            for name in m.names if m else ():
                os.replace(os.path.join(m.folder, name), os.path.join(self.path, name))
        shutil.rmtree(self.stage, ignore_errors=True)

    def abort(self, messages) -> None:
        shutil.rmtree(self.stage, ignore_errors=True)


class FileSink(DataSource):
    """Writes rows (name string, body binary) as one file each under `path`, a mounted folder
    that all machines and the driver share; write_folder() needs none.  Names are quoted as in
    addresses, so no two become one; of rows of one name the last committed stays.  Nothing
    shows under `path` before all tasks are done.  Register with spark.dataSource.register(FileSink)."""

    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return "name string, body binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _FileWriter(self.options["path"], uuid.uuid4().hex)


def write_files(df: DataFrame, name: Column, body: Column, path: str) -> None:
    df.sparkSession.dataSource.register(FileSink)
    df.select(name.alias("name"), body.alias("body")).write.format("files").mode("append").option("path", path).save()


def estimate(images: DataFrame) -> DataFrame:
    """Sizes that an export would have."""
    return images.select("id", "w", "h", F.octet_length("file").alias("n_bytes"))
