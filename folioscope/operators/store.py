"""A settings store: keys with values as JSON, and how an upsert or a log of writes settles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pages import upsert


def latest(log: DataFrame, *order: str) -> DataFrame:
    """(key, value): the last value put under each key, by an aggregate."""
    return log.groupBy("key").agg(F.max_by("value", F.struct(*order)).alias("value"))


def put(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store (key, value string) with `new` (key, and any value) over it, as JSON."""
    return upsert(store, new.select("key", as_json(F.col("value"), dict(new.dtypes)["value"]).alias("value")), "key")


def as_json(value: Column, kind: str) -> Column:
    """A value as JSON text; to_json() takes no plain ones."""
    if kind.startswith(("struct", "array", "map")):
        return F.to_json(value)
    if kind == "string":
        return F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'^\{"v":(.*)\}$', 1)
    return value.cast("string")


def get(store: DataFrame, key: str, schema: str) -> DataFrame:
    """(value): what lies under a key, read as `schema`; no row if nothing does, null if it can't be read."""
    wrapped = F.from_json(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), f"v {schema}")
    return store.filter(F.col("key") == key).select(wrapped["v"].alias("value"))
