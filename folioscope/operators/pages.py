"""Collections of pages: order, upsert, delete, text export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def restored(pages: DataFrame, key: str) -> DataFrame:
    """Pages in order, a missing order as 0 and ties by id, renumbered from 0."""
    w = W.partitionBy(key).orderBy(F.coalesce("ord", F.lit(0)), "id")
    return pages.withColumn("ord", F.row_number().over(w) - 1)


def move(pages: DataFrame, key: str, source: int, target: int) -> DataFrame:
    """Takes the page at `source` out, puts it in at `target`, and renumbers all."""
    place = F.when(F.col("ord") == source, F.lit(target) + (0.5 if target > source else -0.5)).otherwise(F.col("ord").cast("double"))
    return pages.withColumn("_p", place).withColumn("ord", F.row_number().over(W.partitionBy(key).orderBy("_p", "id")) - 1).drop("_p")


def delete(pages: DataFrame, gone: Column, key: str | None = None) -> DataFrame:
    """Without the pages that `gone` holds for.  The others keep their order as it is; with
    `key` they are renumbered, so that no gap is left."""
    left = pages.filter(~F.coalesce(gone, F.lit(False)))
    return restored(left, key) if key else left


def clear(pages: DataFrame, chosen: Column) -> DataFrame:
    """Without any page of the collections that `chosen` holds for."""
    return delete(pages, chosen)


def redetected(pages: DataFrame, found: DataFrame) -> DataFrame:
    """pages (id, corners, ...) with the corners of `found` (id, corners) in place of theirs; an
    outline that was looked for and not found is null there, and clears them."""
    new = found.select("id", F.col("corners").alias("_corners"), F.lit(True).alias("_seen"))
    j = pages.join(new, "id", "left").withColumn("corners", F.when(F.col("_seen"), F.col("_corners")).otherwise(F.col("corners")))
    return j.select(*pages.columns)


def upsert(pages: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """`new` rows over those of equal key."""
    return pages.join(new.select(key), key, "left_anti").select(*pages.columns).unionByName(new.select(*pages.columns))


def select_at(pages: DataFrame, index: int) -> DataFrame:
    return pages.filter(F.col("ord") == index)


def neighbours(pages: DataFrame, key: str) -> DataFrame:
    """The ids before and after each page."""
    w = W.partitionBy(key).orderBy("ord", "id")
    return pages.withColumn("previous", F.lag("id").over(w)).withColumn("next", F.lead("id").over(w))


def export_text(pages: DataFrame, key: str) -> DataFrame:
    """All texts of a collection, each under its page number; null where no page has any."""
    entry = F.concat(F.lit("── page "), (F.col("ord") + 1).cast("string"), F.lit(" ──\n"), F.coalesce("text", F.lit("")))
    rows = F.array_sort(F.collect_list(F.struct("ord", entry.alias("e"))))
    some = F.max(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)
    return pages.groupBy(key).agg(F.when(some, F.concat_ws("\n\n", F.transform(rows, lambda r: r["e"]))).alias("text"), F.count("*").alias("n_pages"))


def file_name(stamp: Column, number: Column, extension: str) -> Column:
    return F.concat(F.lit("scan-"), F.date_format(stamp, "yyyyMMdd-HHmmss"), F.lit("-p"), number.cast("string"), F.lit(f".{extension}"))


def append(pages: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`new` pages (without ord) after the last one of their collection."""
    last = pages.groupBy(key).agg(F.max("ord").alias("_last"))
    placed = new.join(last, key, "left").withColumn("ord", F.coalesce(F.col("_last") + 1, F.lit(0)) + F.row_number().over(W.partitionBy(key).orderBy("id")) - 1)
    return pages.unionByName(placed.select(*pages.columns))


def write_texts(pages: DataFrame, path: str, key: str) -> None:
    """One text file a collection, in a folder of its own name; Spark's writer reaches any store."""
    pages.select(F.col(key), "text").repartition(F.col(key)).write.mode("overwrite").partitionBy(key).option("lineSep", "\n").text(path)


def page_texts(pages: DataFrame, stamp: Column) -> DataFrame:
    """(name, body): one text file for each page that has a text, named as exports are."""
    some = pages.filter(F.length(F.coalesce("text", F.lit(""))) > 0)
    return some.select(file_name(stamp, F.col("ord") + 1, "txt").alias("name"), F.encode("text", "utf-8").alias("body"))


def short_number(v: Column) -> Column:
    """A figure for people: no decimals from 100 on, one from 1 on, else three; halves go up."""
    shown = lambda d: F.format_string(f"%.{d}f", F.floor(F.abs(v) * 10**d + 0.5) / 10**d)
    size = F.when(F.abs(v) >= 100, shown(0)).when(F.abs(v) >= 1, shown(1)).otherwise(shown(3))
    return F.concat(F.when(v < 0, "-").otherwise(""), size)


def page_id(stamp: Column, salt: Column) -> Column:
    """A page's id: `p`, the milliseconds in base 36, five characters made of the salt."""
    millis = F.floor(F.unix_micros(stamp) / 1000)
    return F.concat(F.lit("p"), F.lower(F.conv(millis.cast("string"), 10, 36)), F.left(F.md5(salt.cast("string").cast("binary")), F.lit(5)))
