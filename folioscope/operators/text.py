"""Recognised text: clean-up, word lists, boxes.  Recognition itself is a callable the user supplies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

WORD = StructType([StructField("text", StringType()), StructField("conf", DoubleType()), *[StructField(k, DoubleType()) for k in ("x0", "y0", "x1", "y1")]])
RESULT = StructType([StructField("text", StringType()), StructField("confidence", DoubleType()), StructField("words", ArrayType(WORD)), StructField("error", StringType())])
#: Recognition languages on offer; English comes along, others are fetched.
LANGUAGES = {
    "eng": "English", "fra": "French", "deu": "German", "spa": "Spanish", "ita": "Italian", "por": "Portuguese", "nld": "Dutch", "rus": "Russian", "pol": "Polish", "tur": "Turkish", "ara": "Arabic",
    "hin": "Hindi", "jpn": "Japanese", "kor": "Korean", "chi_sim": "Chinese (simplified)", "chi_tra": "Chinese (traditional)", "osd": "Orientation & script only",
}
BUNDLED = ("eng",)
#: Segmentation modes on offer, the default first.
SEGMENTATION = (3, 4, 6, 11, 1)


def language_table(spark) -> DataFrame:
    return spark.createDataFrame([(k, v, k in BUNDLED) for k, v in LANGUAGES.items()], "code string, name string, bundled boolean")


def tidy(text: Column) -> Column:
    """Three or more line ends become two; white space at the end goes."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\n{3,}", "\n\n"), r"[\s  -     　﻿]+$", "")


def word_list(words: Column, blocks: Column) -> Column:
    """A flat list if it has words, else those of blocks, paragraphs and lines; words without a box go."""
    nested = F.flatten(F.flatten(F.flatten(F.transform(blocks, lambda b: F.transform(b["paragraphs"], lambda p: F.transform(p["lines"], lambda l: l["words"]))))))
    found = F.when(F.size(F.coalesce(words, F.array())) > 0, words).otherwise(nested)
    boxed = F.filter(found, lambda w: w["x0"].isNotNull())
    return F.transform(boxed, lambda w: F.struct(F.coalesce(w["text"], F.lit("")).alias("text"), F.coalesce(w["conf"], F.lit(0.0)).alias("conf"), *[w[k].alias(k) for k in ("x0", "y0", "x1", "y1")]))


def rescaled(words: Column, sx: Column, sy: Column) -> Column:
    """Boxes from the recognised image's pixels to the page's."""
    return F.transform(words, lambda w: F.struct(w["text"].alias("text"), w["conf"].alias("conf"), (w["x0"] * sx).alias("x0"), (w["y0"] * sy).alias("y0"), (w["x1"] * sx).alias("x1"), (w["y1"] * sy).alias("y1")))


def box_class(conf: Column) -> Column:
    return F.when(conf > 85, "good").when(conf > 60, "warn").otherwise("bad")


def segmentation_table(spark) -> DataFrame:
    return spark.createDataFrame([(m, k == 0) for k, m in enumerate(SEGMENTATION)], "mode int, is_default boolean")


def edited(pages: DataFrame, new: Column) -> DataFrame:
    """Recognised text (struct `ocr`) overwritten where `new` is not null; a page that was never
    read gets an entry without words, of an image of one pixel."""
    w = F.col("ocr")
    kept = F.when(w.isNotNull(), w.withField("text", new))
    stub = F.struct(*[(new if k == "text" else F.lit(1) if k in ("imgW", "imgH") else F.array() if k == "words" else F.lit(None)).cast(t).alias(k) for k, t in _fields(pages, "ocr")])
    return pages.withColumn("ocr", F.when(new.isNull(), w).otherwise(F.coalesce(kept, stub)))


def _fields(df: DataFrame, name: str) -> list:
    return [(f.name, f.dataType) for f in df.schema[name].dataType.fields]


class Job:
    """Work that can be called off: run(f) calls f under a job group, cancel() ends its tasks."""

    def __init__(self, spark, name: str):
        self.context, self.name = spark.sparkContext, name

    def run(self, f: Callable):
        self.context.setJobGroup(self.name, self.name, interruptOnCancel=True)
        try:
            return f()
        finally:
            self.context.setLocalProperty("spark.jobGroup.id", None)

    def cancel(self) -> None:
        self.context.cancelJobGroup(self.name)


def recognise(pages: DataFrame, engine: Callable[[bytes, str, int], dict], image: str = "image", lang: str = "eng", psm: int = SEGMENTATION[0]) -> DataFrame:
    """pages with `ocr` from engine(image, lang, psm) -> {text, confidence, words}; a page
    that fails has its error there and does not stop the others."""
    if lang not in LANGUAGES or psm not in SEGMENTATION:
        raise ValueError(f"no language {lang} or no mode {psm}")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for images in batches:
            rows = []
            for i in images:
                try:
                    rows.append({"text": None, "confidence": None, "words": [], "error": None} | engine(i, lang, psm))
                except Exception as e:  # whatever an engine raises concerns its page alone
                    rows.append({"text": None, "confidence": None, "words": [], "error": str(e)[:200]})
            yield pd.DataFrame(rows, columns=["text", "confidence", "words", "error"])

    found = pages.withColumn("ocr", F.pandas_udf(run, RESULT)(F.col(image)))
    return found.withColumn("ocr", F.struct(tidy(F.col("ocr.text")).alias("text"), F.col("ocr.confidence").alias("confidence"), F.col("ocr.words").alias("words"), F.col("ocr.error").alias("error")))
