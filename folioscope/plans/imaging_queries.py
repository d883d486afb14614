"""Registered queries of the pixel, statistics and neighbourhood operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pixel
from ..operators import neighbour, settings, stats
from ..sources import views
from .registered import registry

QUERIES, SQL, query = registry()


RASTER = """raster AS (SELECT vec_id AS image_id, p % 8 AS x, p // 8 AS y,
  round_even(least(255.0, greatest(0.0, 128.0::DOUBLE + 256.0::DOUBLE * embedding[p + 1]::DOUBLE)), 0)::BIGINT AS v
  FROM embeddings, (SELECT unnest(range(64)) AS p))"""
RGB = """rgb AS (SELECT l_suppkey AS image_id, l_orderkey AS k1, l_linenumber AS k2,
 round_even(least(255.0, greatest(0.0, l_quantity / 50.0::DOUBLE * 255)), 0)::BIGINT AS r,
  round_even(least(255.0, greatest(0.0, l_discount / 0.1::DOUBLE * 255)), 0)::BIGINT AS g,
 round_even(least(255.0, greatest(0.0, l_tax / 0.08::DOUBLE * 255)), 0)::BIGINT AS b FROM lineitem)"""
LUM = "(r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE)"


def c8(x: str) -> str:
    return f"round_even(least(255.0::DOUBLE, greatest(0.0::DOUBLE, {x})), 0)::BIGINT"


def sql_shoulder(x: str) -> str:
    return f"""CASE WHEN {x} <= 232.0 THEN greatest({x}, 0.0::DOUBLE)
      ELSE 232.0::DOUBLE + 23.0::DOUBLE * tanh((({x}) - 232.0::DOUBLE) / 23.0::DOUBLE) END"""


def _rgb(e) -> list:
    return [F.col("image_id"), F.col("k1"), F.col("k2"), *e]


# ---------------------------------------------------------------- pointwise
@query(f"WITH {RGB} SELECT image_id, k1, k2, (77 * r + 150 * g + 29 * b) >> 8 AS luma FROM rgb")
def luma601(spark, d):
    return views.rgb(spark, d).select(*_rgb([pixel.luma601(F.col("r"), F.col("g"), F.col("b")).cast("long").alias("luma")]))


@query(f"WITH {RGB} SELECT image_id, k1, k2, round({LUM}, 6) AS luma FROM rgb")
def luma709(spark, d):
    return views.rgb(spark, d).select(*_rgb([F.round(pixel.luma709(F.col("r"), F.col("g"), F.col("b")), 6).alias("luma")]))


@query(f"WITH {RASTER} SELECT image_id, x, y, round({sql_shoulder('v * 1.3::DOUBLE')}, 6) AS rolled FROM raster")
def shoulder(spark, d):
    return views.raster8(spark, d).select("image_id", "x", "y", F.round(pixel.shoulder(F.col("v") * F.lit(1.3)), 6).alias("rolled"))


@query(f"""WITH {RGB} SELECT image_id, k1, k2, {c8('r * ((1 + 20 / 300.0::DOUBLE) * (1 - (-10 / 300.0::DOUBLE) * 0.5))')}
  AS r, {c8('g * (1 + (-10 / 300.0::DOUBLE))')} AS g,
  {c8('b * ((1 - 20 / 300.0::DOUBLE) * (1 - (-10 / 300.0::DOUBLE) * 0.5))')} AS b FROM rgb""")
def temp_tint(spark, d):
    out = pixel.temp_tint(F.col("r"), F.col("g"), F.col("b"), 20, -10)
    return views.rgb(spark, d).select(*_rgb([c.cast("long").alias(k) for c, k in zip(out, "rgb")]))


def _tone_rows() -> str:
    keys = ("exposure", "contrast", "gamma", "highlights", "shadows")
    return ", ".join(f"('{n}', " + ", ".join(f"{settings.preset_record(n)[k]}::DOUBLE" for k in keys) + ")" for n in settings.PRESETS)


TONE = f"""presets(name, exposure, contrast, gamma, highlights, shadows) AS (VALUES {_tone_rows()}),
 level AS (SELECT unnest(range(256)) AS i),
 t1 AS (SELECT *, least(100.0, greatest(-100.0, contrast)) * 2.55::DOUBLE AS c FROM presets, level),
 t2 AS (SELECT *, (259.0::DOUBLE * (c + 255)) / (255.0::DOUBLE * (259.0::DOUBLE - c)) * ((i + exposure * 1.28::DOUBLE)
  - 128) + 128 AS v0 FROM t1),
 t3 AS (SELECT *, 255.0::DOUBLE * pow(least(255.0::DOUBLE, greatest(0.0::DOUBLE, v0)) / 255,
  1.0::DOUBLE / least(10.0::DOUBLE, greatest(0.05::DOUBLE, gamma))) AS v1 FROM t2),
 t4 AS (SELECT *, v1 + shadows * 1.15::DOUBLE * pow(1.0::DOUBLE - v1 / 255,
  2.2::DOUBLE) + highlights * 1.15::DOUBLE * pow(v1 / 255, 2.2::DOUBLE) AS v2 FROM t3),
 tone AS (SELECT name, i, least(255, greatest(0, floor((CASE WHEN v2 > 232 THEN {sql_shoulder('v2')}
  ELSE v2 END) + 0.5)))::BIGINT AS level FROM t4)"""


def _tone(spark):
    t = settings.preset_table(spark).select(F.col("filter").alias("name"), "exposure", "contrast", "gamma", "highlights", "shadows")
    i = spark.range(256).select(F.col("id").alias("i"))
    cols = [F.col(k) for k in ("exposure", "contrast", "gamma", "highlights", "shadows")]
    return t.crossJoin(F.broadcast(i)).select("name", "i", pixel.tone(F.col("i").cast("double"), *cols).cast("long").alias("level"))  # 8 by 256 rows


@query(f"WITH {TONE} SELECT name, i, level FROM tone")
def tone_lut(spark, d):
    return _tone(spark)


@query(f"WITH {RASTER}, {TONE} SELECT image_id, x, y, level AS v FROM raster JOIN tone ON tone.i = raster.v WHERE name = 'ink'")
def tone_apply(spark, d):
    lut = _tone(spark).filter("name = 'ink'").select(F.col("i").alias("v"), "level")
    return views.raster8(spark, d).join(F.broadcast(lut), "v").select("image_id", "x", "y", F.col("level").alias("v"))  # 256 rows


_AMOUNT = "((1 + 30 / 100.0::DOUBLE) + (25 / 100.0::DOUBLE) * (1.0::DOUBLE - (greatest(r, g, b) - least(r, g, b)) / 255.0::DOUBLE))"


@query(f"WITH {RGB} SELECT image_id, k1, k2, " + ", ".join(f"{c8(f'{LUM} + ({c} - {LUM}) * {_AMOUNT}')} AS {c}" for c in "rgb") + " FROM rgb")
def saturation(spark, d):
    out = pixel.saturate(F.col("r"), F.col("g"), F.col("b"), 30, 25)
    return views.rgb(spark, d).select(*_rgb([c.cast("long").alias(k) for c, k in zip(out, "rgb")]))


@query(f"WITH {RGB} SELECT image_id, k1, k2, {c8(LUM)} AS v FROM rgb")
def grayscale(spark, d):
    return views.rgb(spark, d).select(*_rgb([pixel.grayscale(F.col("r"), F.col("g"), F.col("b")).cast("long").alias("v")]))


@query(f"WITH {RGB} SELECT image_id, k1, k2, 255 - r AS r, 255 - g AS g, 255 - b AS b FROM rgb")
def invert(spark, d):
    return views.rgb(spark, d).select(*_rgb([(255 - F.col(k)).cast("long").alias(k) for k in "rgb"]))


@query("""WITH s AS (SELECT doc_id, (n_chars * n_chars * CASE WHEN doc_id % 3 = 0 THEN 7 ELSE 1 END)::BIGINT AS n FROM documents)
 SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN floor(n / 1024 + 0.5)::BIGINT || ' KB'
 WHEN n < 10485760 THEN printf('%.1f', floor(n / 1048576 * 10 + 0.5) / 10) || ' MB'
  ELSE floor(n / 1048576 + 0.5)::BIGINT || ' MB' END AS size_text FROM s""")
def bytes_format(spark, d):
    n = (F.col("n_chars") * F.col("n_chars") * F.when(F.col("doc_id") % 3 == 0, 7).otherwise(1)).cast("long")
    return views.table(spark, d, "documents").select("doc_id", pixel.size_text(n).alias("size_text"))


# ---------------------------------------------------------------- statistics
@query(f"WITH {RASTER} SELECT image_id, v, count(*)::BIGINT AS n FROM raster GROUP BY 1, 2")
def histogram(spark, d):
    return stats.histogram(views.raster8(spark, d), F.col("v").cast("long"))


OTSU = f"""{RASTER}, hist AS (SELECT image_id, v, count(*) AS n FROM raster GROUP BY 1, 2),
 o1 AS (SELECT image_id, v, sum(n) OVER a AS wb, sum(n * v) OVER a AS sb, sum(n) OVER b AS w, sum(n * v) OVER b AS s FROM hist
  WINDOW a AS (PARTITION BY image_id ORDER BY v ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY image_id)),
 o2 AS (SELECT image_id, v, CASE WHEN w > wb
  THEN wb::DOUBLE * (w - wb)::DOUBLE * (sb::DOUBLE / wb - (s - sb)::DOUBLE / (w - wb)) * (sb::DOUBLE / wb - (s -
  sb)::DOUBLE / (w - wb)) END AS q FROM o1),
 otsu AS (SELECT image_id, coalesce(arg_max(v, (q, -v)) FILTER (q IS NOT NULL), 128)::BIGINT AS threshold FROM o2 GROUP BY 1)"""


@query(f"WITH {OTSU} SELECT image_id, threshold FROM otsu")
def otsu_threshold(spark, d):
    return stats.otsu(histogram(spark, d)).select("image_id", F.col("threshold").cast("long").alias("threshold"))


def _level_sql(source: str, value: str, p: float, key: str = "image_id") -> str:
    return f"""h AS (SELECT {key}, {value} AS v, count(*) AS n FROM {source} GROUP BY 1, 2),
 acc AS (SELECT {key}, v, sum(n) OVER (PARTITION BY {key} ORDER BY v ROWS UNBOUNDED PRECEDING) AS a, sum(n) OVER (PARTITION BY {key}) AS t FROM h),
 lev AS (SELECT {key}, min(v)::BIGINT AS level FROM acc WHERE a >= t * {p}::DOUBLE GROUP BY 1)"""


PAPER = f"{RGB}, {_level_sql('rgb', f'least(255, trunc({LUM})::BIGINT)', 0.9)}"


@query(f"WITH {PAPER} SELECT image_id, level FROM lev")
def paper_level(spark, d):
    return stats.paper_level(views.rgb(spark, d)).select("image_id", F.col("level").cast("long").alias("level"))


GRAY = f"""{PAPER}, light AS (SELECT rgb.image_id, count(*) AS n, sum(r)::DOUBLE / count(*) AS r,
  sum(g)::DOUBLE / count(*) AS g, sum(b)::DOUBLE / count(*) AS b
  FROM rgb JOIN lev USING (image_id) WHERE {LUM} >= greatest(24.0::DOUBLE, level * 0.55::DOUBLE) GROUP BY 1),
 gains AS (SELECT i.image_id, """ + ", ".join(f"""coalesce(CASE WHEN n < 32 THEN 1.0::DOUBLE
   ELSE least(1.9::DOUBLE, greatest(0.55::DOUBLE, (r + g + b) / 3 / CASE WHEN {c} = 0 THEN 1 ELSE {c} END)) END, 1.0::DOUBLE) AS g{c}""" for c in "rgb") + " FROM (SELECT DISTINCT image_id FROM rgb) i LEFT JOIN light USING (image_id))"


@query(f"WITH {GRAY} SELECT image_id, round(gr, 6) AS gr, round(gg, 6) AS gg, round(gb, 6) AS gb FROM gains")
def wb_gray(spark, d):
    return stats.gray_gains(views.rgb(spark, d)).select("image_id", *[F.round(f"g{c}", 6).alias(f"g{c}") for c in "rgb"])


@query(f"WITH {GRAY} SELECT image_id, k1, k2, {c8('r * gr')} AS r, {c8('g * gg')} AS g, {c8('b * gb')} AS b FROM rgb JOIN gains USING (image_id)")
def wb_apply(spark, d):
    p = views.rgb(spark, d)
    return stats.apply_gains(p, stats.gray_gains(p)).select("image_id", "k1", "k2", *[F.col(c).cast("long").alias(c) for c in "rgb"])


@query(f"""WITH {RGB}, one AS (SELECT image_id, 'r' AS ch, r AS v FROM rgb UNION ALL SELECT image_id, 'g', g FROM rgb
  UNION ALL SELECT image_id, 'b', b FROM rgb),
 h AS (SELECT image_id, ch, v, count(*) AS n FROM one GROUP BY 1, 2, 3),
 acc AS (SELECT image_id, ch, v, sum(n) OVER (PARTITION BY image_id, ch ORDER BY v ROWS UNBOUNDED PRECEDING) AS a,
  sum(n) OVER (PARTITION BY image_id, ch) AS t FROM h),
 lev AS (SELECT image_id, ch, least(1.9::DOUBLE, greatest(0.55::DOUBLE, 248.0::DOUBLE / greatest(min(v), 1))) AS gain
  FROM acc WHERE a >= t * 0.97::DOUBLE GROUP BY 1, 2)
 SELECT image_id, round(max(gain) FILTER (ch = 'r'), 6) AS gr, round(max(gain) FILTER (ch = 'g'), 6) AS gg,
  round(max(gain) FILTER (ch = 'b'), 6) AS gb FROM lev GROUP BY 1""")
def wb_white(spark, d):
    return stats.white_gains(views.rgb(spark, d)).select("image_id", *[F.round(f"g{c}", 6).alias(f"g{c}") for c in "rgb"])


@query(f"""WITH {RASTER}, z AS (SELECT *, (x < 2 OR y < 2 OR x >= 6 OR y >= 6) AS edge,
  (x > 2.8 AND x < 5.2 AND y > 2.8 AND y < 5.2) AS mid FROM raster)
 SELECT image_id, coalesce(avg(v) FILTER (mid AND NOT edge), 0) >= coalesce(avg(v) FILTER (edge), 0) AS bright FROM z GROUP BY 1""")
def polarity(spark, d):
    return stats.polarity(views.raster8(spark, d), 8, 8)


@query(f"""WITH {OTSU}, j AS (SELECT raster.image_id, sum(v) FILTER (v > threshold) AS si,
  count(*) FILTER (v > threshold) AS ni, sum(v) FILTER (v <= threshold) AS so, count(*) FILTER (v <= threshold) AS no
  FROM raster JOIN otsu USING (image_id) GROUP BY 1)
 SELECT image_id, ni::BIGINT AS n_inside, coalesce(ni > 0 AND no > 0 AND abs(si::DOUBLE / ni - so::DOUBLE / no) >= 12,
  false) AS stands_out FROM j""")
def contrast_gate(spark, d):
    p = views.raster8(spark, d)
    return stats.contrast_gate(p, stats.otsu(stats.histogram(p, F.col("v"))))


@query(f"""WITH {OTSU}, j AS (SELECT raster.image_id, count(*) FILTER (v > threshold) AS m, count(*) AS n FROM raster
  JOIN otsu USING (image_id) GROUP BY 1)
 SELECT image_id, m::BIGINT AS n_mask, (m >= n * 0.05::DOUBLE AND m <= n * 0.985::DOUBLE) AS passes FROM j""")
def size_gate(spark, d):
    p = views.raster8(spark, d)
    return stats.size_gate(p, stats.otsu(stats.histogram(p, F.col("v"))))


@query(f"""WITH {RASTER}, j AS (SELECT a.image_id, a.v AS a, b.v AS b FROM raster a
  JOIN raster b ON b.image_id = a.image_id + 1 AND a.x = b.x AND a.y = b.y),
 s AS (SELECT image_id, count(*)::DOUBLE AS n, sum(a)::DOUBLE AS sa, sum(b)::DOUBLE AS sb, sum(a * a)::DOUBLE AS saa,
  sum(b * b)::DOUBLE AS sbb, sum(a * b)::DOUBLE AS sab FROM j GROUP BY 1),
 t AS (SELECT image_id, sab / n - (sa / n) * (sb / n) AS cov,
  sqrt(greatest((saa / n - (sa / n) * (sa / n)) * (sbb / n - (sb / n) * (sb / n)), 0.0)) AS den FROM s)
 SELECT image_id, round(CASE WHEN den <= 1e-6 THEN 0.0 ELSE greatest(0.0, cov / den) END, 6) AS match FROM t""")
def fov_match(spark, d):
    return stats.view_match(views.raster8(spark, d)).select("image_id", F.round("match", 6).alias("match"))


@query(f"""WITH {RASTER}, mid AS (SELECT * FROM raster WHERE (x + 0.5) / 8 BETWEEN 0.25 AND 0.75
  AND (y + 0.5) / 8 BETWEEN 0.25 AND 0.75), {_level_sql('mid', 'v', 0.9)} SELECT image_id, level FROM lev""")
def level_meter(spark, d):
    return stats.centre_level(views.raster8(spark, d), 8, 8).select("image_id", F.col("level").cast("long").alias("level"))


@query("SELECT conv_id AS session, count(*)::BIGINT AS n_pages, sum(octet_length(encode(text)))::BIGINT AS n_bytes FROM conversations GROUP BY 1")
def page_counts(spark, d):
    return stats.page_counts(views.page_list(spark, d), "session", "text")


@query(f"""WITH {RGB}, p AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY k1, k2, r, g, b) - 1 AS pos,
  count(*) OVER (PARTITION BY image_id) AS total FROM rgb)
 SELECT image_id, k1, k2, r, g, b FROM p WHERE pos % greatest(1, total // 100) = 0""")
def systematic_sample(spark, d):
    return stats.systematic(views.rgb(spark, d), ["k1", "k2", "r", "g", "b"], 100).select("image_id", "k1", "k2", *[F.col(c).cast("long").alias(c) for c in "rgb"])


# ---------------------------------------------------------------- neighbourhoods
@query(f"""WITH {RASTER}, m AS (SELECT image_id, x, y, CASE WHEN v > 160 THEN 1 ELSE 0 END AS v FROM raster),
 a AS (SELECT image_id, x, y, max(v) OVER (PARTITION BY image_id, y ORDER BY x RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM m)
 SELECT image_id, x, y, max(v) OVER (PARTITION BY image_id, x ORDER BY y RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM a""")
def dilate(spark, d):
    return neighbour.dilate(views.raster8(spark, d).withColumn("v", F.when(F.col("v") > 160, 1).otherwise(0)), 1)


@query(f"""WITH {RASTER}, a AS (SELECT image_id, x, y, sum(v) OVER (PARTITION BY image_id, y ORDER BY x ROWS UNBOUNDED PRECEDING) AS s FROM raster)
 SELECT image_id, x, y, (sum(s) OVER (PARTITION BY image_id, x ORDER BY y ROWS UNBOUNDED PRECEDING))::BIGINT AS total FROM a""")
def integral(spark, d):
    return neighbour.integral(views.raster8(spark, d)).select("image_id", "x", "y", "total")


@query(f"""WITH {RASTER} SELECT a.image_id, a.x, a.y, CASE WHEN any_value(a.v) * count(*) < sum(b.v) * (1 - 0.13::DOUBLE) THEN 0 ELSE 255 END AS v
 FROM raster a JOIN raster b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 3 AND abs(a.y - b.y) <= 3 GROUP BY 1, 2, 3""")
def adaptive_threshold(spark, d):
    return neighbour.adaptive_threshold(views.raster8(spark, d), 8, 8)


TAPS = f"""{RASTER}, o AS (SELECT unnest([-1, 0, 1]) AS k), taps AS (SELECT a.image_id, a.x, a.y, a.v AS v0, b.v AS v FROM raster a, o ox, o oy
  JOIN raster b ON b.image_id = a.image_id AND b.x = least(7, greatest(0, a.x + ox.k)) AND b.y = least(7, greatest(0, a.y + oy.k)))"""


@query(f"WITH {TAPS} SELECT image_id, x, y, round(sum(v) / 9.0::DOUBLE, 6) AS blur FROM taps GROUP BY 1, 2, 3")
def box_blur(spark, d):
    return neighbour.box_blur(views.raster8(spark, d), 8, 8).select("image_id", "x", "y", F.round("blur", 6).alias("blur"))


@query(f"""WITH {TAPS}, s AS (SELECT image_id, x, y, any_value(v0) AS v0, list_sort(list(v))[5] AS m FROM taps GROUP BY 1, 2, 3)
 SELECT image_id, x, y, {c8('v0 + (m - v0) * 0.4::DOUBLE')} AS v FROM s""")
def median3(spark, d):
    return neighbour.median3(views.raster8(spark, d), 8, 8, 40).select("image_id", "x", "y", F.col("v").cast("long").alias("v"))


@query(f"""WITH {TAPS}, s AS (SELECT image_id, x, y, any_value(v0) AS v0, sum(v) / 9.0::DOUBLE AS m FROM taps GROUP BY 1, 2, 3)
 SELECT image_id, x, y, {c8(sql_shoulder('(v0 + (v0 - m) * 0.57::DOUBLE)'))} AS v FROM s""")
def sharpen(spark, d):
    return neighbour.sharpen(views.raster8(spark, d), 8, 8, 57).select("image_id", "x", "y", F.col("v").cast("long").alias("v"))


@query(f"""WITH {RASTER} SELECT image_id, least(9, floor(x * 10 / 8))::INT AS bx, least(9, floor(y * 10 / 8))::INT AS by,
  max(v)::BIGINT AS level FROM raster GROUP BY 1, 2, 3""")
def illumination_blocks(spark, d):
    return neighbour.illumination_blocks(views.raster8(spark, d), 8, 8).select("image_id", "bx", "by", F.col("level").cast("long").alias("level"))


@query(f"""WITH RECURSIVE {RASTER}, p AS (SELECT image_id, x, y, (y * 4294967296 + x)::BIGINT AS id FROM raster WHERE v > 130),
 reach(image_id, x, y, label) AS (SELECT image_id, x, y, id FROM p UNION SELECT p.image_id, p.x, p.y, reach.label
  FROM reach JOIN p ON p.image_id = reach.image_id AND abs(p.x - reach.x) + abs(p.y - reach.y) = 1)
 SELECT image_id, x, y, min(label)::BIGINT AS label FROM reach GROUP BY 1, 2, 3""")
def components(spark, d):
    return neighbour.components(views.raster8(spark, d).withColumn("v", F.when(F.col("v") > 130, 1).otherwise(0)))
