"""Registered queries of packed images: resampling, light, outlines, files; and their SQL.

The SQL computes each over the tall rasters by itself, from the rules, pixel by pixel.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detect as detector
from ..operators import export, geometry, neighbour, pages, raster, settings
from ..sources import camera, images, views
from .imaging_queries import RASTER, TONE, c8, sql_shoulder
from .page_queries import SQUARE
from .registered import registry

QUERIES, SQL, query = registry()


# ---------------------------------------------------------------- views
def packed(spark, d, level=None) -> DataFrame:
    """The 8x8 rasters as packed gray RGB images; level: another value made of v, x, y and image_id."""
    r = views.raster8(spark, d)
    r = r if level is None else r.withColumn("v", level)
    v = r.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("p"))  # 64 pixels an image
    one = F.concat(*[F.unhex(F.lpad(F.hex(F.col("p")[i]["v"].cast("long")), 2, "0")) for i in range(64) for _ in range(3)])
    return v.select("image_id", F.col("image_id").cast("string").alias("id"), F.lit(8).alias("w"), F.lit(8).alias("h"), one.alias("data"))


def tall(found: DataFrame) -> DataFrame:
    """(image_id, x, y, v) of packed gray images."""
    p = found.select("id", "w", "data", F.explode(F.sequence(F.lit(0), F.col("w") * F.col("h") - 1)).alias("p"))
    v = F.conv(F.hex(F.substring(F.col("data"), F.col("p") * 3 + 1, F.lit(1))), 16, 10)
    return p.select(F.col("id").cast("long").alias("image_id"), (F.col("p") % F.col("w")).cast("long").alias("x"), F.expr("p div w").alias("y"), v.cast("long").alias("v"))


def preset(name: str, **more) -> dict:
    return {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in (settings.preset_record(name) | more).items()}


def as_map(record: dict):
    return F.create_map(*[F.lit(x) for pair in record.items() for x in pair])


def no_corners():
    return F.lit(None).cast("array<double>")


LISTS = f"{RASTER}, px AS (SELECT image_id, list(v::DOUBLE ORDER BY y, x) AS vs FROM raster GROUP BY 1)"


def _bilinear(values: str, width: int, height: int) -> str:
    """The value at (sx, sy) of a list of rows, between the four places around it."""
    x0, y0 = (f"least({n - 1}, greatest(0, floor({c})))::BIGINT" for c, n in (("sx", width), ("sy", height)))
    x1, y1 = f"least({width - 1}, {x0} + 1)", f"least({height - 1}, {y0} + 1)"
    fx, fy = f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, sx - {x0}))", f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, sy - {y0}))"
    at = lambda y, x: f"{values}[{y} * {width} + {x} + 1]"
    return f"({at(y0, x0)} * (1 - {fx}) * (1 - {fy}) + {at(y0, x1)} * {fx} * (1 - {fy}) + {at(y1, x0)} * (1 - {fx}) * {fy} + {at(y1, x1)} * {fx} * {fy})"


def _grid(w: int, h: int) -> str:
    return f"grid AS (SELECT i, j FROM (SELECT unnest(range({w})) AS i), (SELECT unnest(range({h})) AS j))"


# ---------------------------------------------------------------- resampling
@query(f"WITH {RASTER} SELECT image_id, x // 2 AS x, y // 2 AS y, round_even(avg(v), 0)::BIGINT AS v FROM raster GROUP BY ALL")
def fit(spark, d):
    """Every raster shrunk to four pixels."""
    return tall(raster.fit_images(packed(spark, d), 4))


_T = math.radians(30)


@query(f"""WITH {LISTS}, {_grid(11, 11)},
 s AS (SELECT image_id, vs, i, j, (i + 0.5::DOUBLE - 5.5::DOUBLE) * {math.cos(_T)!r}::DOUBLE + (j + 0.5::DOUBLE -
  5.5::DOUBLE) * {math.sin(_T)!r}::DOUBLE + 4 - 0.5::DOUBLE AS sx,
  -(i + 0.5::DOUBLE - 5.5::DOUBLE) * {math.sin(_T)!r}::DOUBLE + (j + 0.5::DOUBLE - 5.5::DOUBLE) *
  {math.cos(_T)!r}::DOUBLE + 4 - 0.5::DOUBLE AS sy FROM px, grid)
 SELECT image_id, i AS x, j AS y, CASE WHEN sx < -0.5 OR sy < -0.5 OR sx > 7.5 OR sy > 7.5 THEN 255
  ELSE {c8(_bilinear('vs', 8, 8))} END AS v FROM s""")
def transform(spark, d):
    """Every raster turned by 30 degrees on white."""
    p = packed(spark, d).withColumn("corners", no_corners()).withColumn("settings", as_map(preset("original", straighten=30.0)))
    return tall(raster.render_pages(p))


QUAD = (0.1, 0.1, 0.9, 0.2, 0.85, 0.95, 0.05, 0.9)


@query(f"""WITH {LISTS}, {_grid(16, 16)}, q AS (SELECT
  {', '.join(f'{8 * v}::DOUBLE AS {a}{k // 2}' for k, (v, a) in enumerate(zip(QUAD, 'xyxyxyxy')))}), {SQUARE.format(quads='q')},
 m AS (SELECT x1 - x0 + g * x1 AS a, x3 - x0 + h_ * x3 AS b, x0 AS c, y1 - y0 + g * y1 AS d, y3 - y0 + h_ * y3 AS e,
  y0 AS f, g, h_ FROM u2),
 s0 AS (SELECT image_id, vs, i, j, (i + 0.5::DOUBLE) / 16 AS p, (j + 0.5::DOUBLE) / 16 AS q_ FROM px, grid),
 s AS (SELECT image_id, vs, i, j, (a * p + b * q_ + c) / (g * p + h_ * q_ + 1) - 0.5::DOUBLE AS sx,
  (d * p + e * q_ + f) / (g * p + h_ * q_ + 1) - 0.5::DOUBLE AS sy FROM s0, m)
 SELECT image_id, i AS x, j AS y, CASE WHEN sx < -1 OR sy < -1 OR sx > 8 OR sy > 8 THEN 255 ELSE {c8(_bilinear('vs', 8, 8))} END AS v FROM s""")
def warp(spark, d):
    """Every raster straightened from a fixed quad by the packed pipeline, without colour stages."""
    p = packed(spark, d).withColumn("corners", F.array(*[F.lit(v) for v in QUAD])).withColumn("settings", as_map(preset("original")))
    return tall(raster.render_pages(p))


# ---------------------------------------------------------------- light and colour
def _taps(source: str, r: int) -> str:
    return f"""o AS (SELECT unnest(range(-{r}, {r + 1})) AS k), taps AS (SELECT a.image_id, a.x, a.y, a.v AS v0, b.v AS v FROM {source} a, o ox, o oy
  JOIN {source} b ON b.image_id = a.image_id AND b.x = least(7, greatest(0, a.x + ox.k)) AND b.y = least(7, greatest(0, a.y + oy.k)))"""


@query(f"""WITH {RASTER}, {TONE}, toned AS (SELECT image_id, x, y, level AS v FROM raster
  JOIN tone ON tone.i = raster.v WHERE name = 'photo' AND image_id % 2 = 1), {_taps('toned', 1)},
 s AS (SELECT image_id, x, y, any_value(v0) AS v0, sum(v) / 9.0::DOUBLE AS m FROM taps GROUP BY 1, 2, 3)
 SELECT image_id, x, y, {c8(sql_shoulder('(v0 + (v0 - m) * 0.08::DOUBLE)'))} AS v FROM s UNION ALL SELECT image_id, x,
  y, v FROM raster WHERE image_id % 2 = 0""")
def render_pipeline(spark, d):
    """Every raster rendered by the whole pipeline: as it is, or with tone, saturation and sharpening."""
    both = F.when(F.col("image_id") % 2 == 1, as_map(preset("photo"))).otherwise(as_map(preset("original")))
    return tall(raster.render_pages(packed(spark, d).withColumn("corners", no_corners()).withColumn("settings", both)))


def _soft(source: str, r: int, out: str) -> str:
    """Means along rows, then columns, of a 10 by 10 grid (image_id, gx, gy, a), past an edge its point
    reflection; stored as single floats after either."""
    weights = f"""{out}_w AS (SELECT i, t, sum(w)::DOUBLE AS w FROM (SELECT i, i + k AS at,
      unnest(CASE WHEN i + k < 0 THEN [{{'t': 0, 'w': 2}}, {{'t': least(-(i + k), 9), 'w': -1}}]
  WHEN i + k > 9 THEN [{{'t': 9, 'w': 2}}, {{'t': greatest(18 - (i + k), 0), 'w': -1}}] ELSE [{{'t': i + k,
      'w': 1}}] END, recursive := true) FROM (SELECT unnest(range(10)) AS i), (SELECT unnest(range(-{r}, {r + 1})) AS k)) GROUP BY 1, 2)"""
    once = f"""{out}_1 AS (SELECT image_id, i AS gx, gy, (sum(a::DOUBLE * w) / {2 * r + 1})::FLOAT AS a FROM {source}
      JOIN {out}_w ON t = gx GROUP BY 1, 2, 3)"""
    return f"""{weights}, {once}, {out} AS (SELECT image_id, gx, i AS gy, (sum(a::DOUBLE * w) / {2 * r + 1})::FLOAT AS a
      FROM {out}_1 JOIN {out}_w ON t = gy GROUP BY 1, 2, 3)"""


@query(f"""WITH {RASTER}, cells AS (SELECT gx, gy FROM (SELECT unnest(range(10)) AS gx), (SELECT unnest(range(10)) AS gy)),
 blocks AS (SELECT i.image_id, gx, gy, coalesce(a, 0)::FLOAT AS a FROM (SELECT DISTINCT image_id FROM raster) i CROSS
  JOIN cells LEFT JOIN (SELECT image_id, least(9, x * 10 // 8) AS gx, least(9, y * 10 // 8) AS gy, max(v) AS a
  FROM raster GROUP BY 1, 2, 3) m USING (image_id, gx, gy)),
 {_soft('blocks', 3, 'broad')}, {_soft('blocks', 1, 'near')},
 light AS (SELECT image_id, gx, gy, greatest(broad.a, (near.a::DOUBLE * 0.8::FLOAT::DOUBLE)::FLOAT) AS a FROM broad
  JOIN near USING (image_id, gx, gy)),
 floors AS (SELECT image_id, greatest(16.0::DOUBLE, greatest(1.0::DOUBLE,
  max(a)::DOUBLE) * 0.35::DOUBLE)::FLOAT AS least_ FROM light GROUP BY 1),
 gains AS (SELECT image_id, list(least(3.5::DOUBLE, greatest(0.2::DOUBLE,
  255 / greatest(a, least_)::DOUBLE))::FLOAT::DOUBLE ORDER BY gy, gx) AS gs FROM light JOIN floors USING (image_id) GROUP BY 1),
 s AS (SELECT image_id, x, y, v, gs, (x + 0.5::DOUBLE) / 8 * 10 - 0.5::DOUBLE AS sx,
  (y + 0.5::DOUBLE) / 8 * 10 - 0.5::DOUBLE AS sy FROM raster JOIN gains USING (image_id)),
 g AS (SELECT image_id, x, y, v * {_bilinear('gs', 10, 10)} AS lit FROM s)
 SELECT image_id, x, y, {c8(sql_shoulder('lit'))} AS v FROM g""")
def flatten(spark, d):
    """Every raster divided by its light."""
    p = packed(spark, d).withColumn("corners", no_corners()).withColumn("settings", as_map(preset("original", flatten=100.0)))
    return tall(raster.render_pages(p))


@query(f"""WITH {RASTER}, b AS (SELECT a.image_id, a.x, a.y,
  any_value(a.v) * count(*) < sum(b.v) * (1 - 0.13::DOUBLE) AS dark FROM raster a
  JOIN raster b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 3 AND abs(a.y - b.y) <= 3 GROUP BY 1, 2, 3)
 SELECT image_id, x, y, CASE WHEN dark THEN 255 ELSE 0 END::BIGINT AS v FROM b""")
def bilevel(spark, d):
    """Every raster as black and white, inverted, by the packed pipeline."""
    p = packed(spark, d).withColumn("corners", no_corners()).withColumn("settings", as_map(preset("original", mode="bw", invert=True)))
    return tall(raster.render_pages(p))


@query(f"WITH {RASTER}, {_taps('raster', 2)} SELECT image_id, x, y, round(sum(v) / 25.0::DOUBLE, 6) AS blur FROM taps GROUP BY 1, 2, 3")
def box_blur_wide(spark, d):
    return neighbour.box_blur(views.raster8(spark, d), 8, 8, 2).select("image_id", "x", "y", F.round("blur", 6).alias("blur"))


@query(f"""WITH {RASTER}, {_taps('raster', 2)}, s AS (SELECT image_id, x, y, any_value(v0) AS v0,
  sum(v) / 25.0::DOUBLE AS m FROM taps GROUP BY 1, 2, 3)
 SELECT image_id, x, y, {c8(sql_shoulder('(v0 + (v0 - m) * 0.57::DOUBLE)'))} AS v FROM s""")
def sharpen_wide(spark, d):
    return neighbour.sharpen(views.raster8(spark, d), 8, 8, 57, 2).select("image_id", "x", "y", F.col("v").cast("long").alias("v"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {all(settings.preset_record(n)[k] == (1 if k == 'gamma' else 0) for k in ('contrast', 'exposure', 'highlights', 'shadows', 'gamma'))})" for n in settings.PRESETS) + ") AS t(name, identity)")
def identity_tone(spark, d):
    cols = [F.col(k) for k in ("contrast", "exposure", "gamma", "highlights", "shadows")]
    return settings.preset_table(spark).select(F.col("filter").alias("name"), raster.identity_tone(*cols).alias("identity"))


# ---------------------------------------------------------------- outlines
def _hull(points: str) -> str:
    """hull (id, pts: a list of corners by angle from the least x, then y) of `points` (id, x, y): a side
    is a pair that no point lies to the right of, nor on its line outside of it."""
    return f"""side AS (SELECT p.id, p.x, p.y FROM {points} p JOIN {points} q ON q.id = p.id
      AND (p.x, p.y) <> (q.x, q.y) JOIN {points} r ON r.id = p.id
  GROUP BY p.id, p.x, p.y, q.x, q.y HAVING min((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x)) >= 0
      AND count(*) FILTER ((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) = 0
   AND NOT ((r.x - p.x) * (q.x - p.x) + (r.y - p.y) * (q.y - p.y) BETWEEN 0 AND (q.x - p.x) ** 2 + (q.y - p.y) ** 2)) = 0
  UNION ALL SELECT id, any_value(x), any_value(y) FROM {points} GROUP BY id HAVING count(*) = 1),
 corner AS (SELECT id, x, y, atan2(y - avg(y) OVER (PARTITION BY id), x - avg(x) OVER (PARTITION BY id)) AS turn FROM side),
 around AS (SELECT id, list({{'x': x, 'y': y}} ORDER BY turn) AS ps, arg_min(turn, (x, y)) AS t0,
      list(turn ORDER BY turn) AS ts FROM corner GROUP BY id),
 hull AS (SELECT id, ps[list_position(ts, t0):] || ps[:list_position(ts, t0) - 1] AS pts FROM around)"""


#: needs WITH RECURSIVE: corners go one by one, each time the first that costs least area
CUT = """cut(id, pts) AS (SELECT id, pts FROM hull UNION ALL
  SELECT id, pts[:k - 1] || pts[k + 1:] FROM (SELECT id, pts, list_position(loss, list_min(loss)) AS k
  FROM (SELECT id, pts, list_transform(range(1, len(pts) + 1), lambda i: abs(
   (pts[i].x - pts[(i + len(pts) - 2) % len(pts) + 1].x) * (pts[i % len(pts) + 1].y - pts[(i + len(pts) - 2) % len(pts) + 1].y)
   - (pts[i % len(pts) + 1].x - pts[(i + len(pts) - 2) % len(pts) + 1].x) * (pts[i].y - pts[(i + len(pts) - 2) %
  len(pts) + 1].y))) AS loss FROM cut WHERE len(pts) > 4))),
 quad AS (SELECT id, pts FROM cut WHERE len(pts) <= 4)"""
_SHOWN = "array_to_string(list_transform({0}, lambda p: p.x::BIGINT || ',' || p.y::BIGINT), ';')"


@query(f"""WITH RECURSIVE {RASTER}, points AS (SELECT image_id AS id, x, y FROM raster WHERE v > 150), {_hull('points')},
  {CUT} SELECT id AS image_id, {_SHOWN.format('hull.pts')} AS hull, {_SHOWN.format('quad.pts')} AS quad FROM hull JOIN quad USING (id)""")
def hull(spark, d):
    """The convex hull of the bright pixels of each raster, and the quad it is cut down to."""
    shown = lambda p: ";".join(f"{int(x)},{int(y)}" for x, y in p)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        points = geometry.hull(p[["x", "y"]].to_numpy())
        return pd.DataFrame({"image_id": [p["image_id"].iloc[0]], "hull": [shown(points)], "quad": [shown(geometry.to_quad(points))]})

    return views.raster8(spark, d).filter("v > 150").select("image_id", "x", "y").groupBy("image_id").applyInPandas(run, "image_id long, hull string, quad string")


#: rasters with a sheet on them, bright or dark, of several shapes; every fourth stays as it is, or flat
SHEETS = f"""{RASTER.replace('raster AS', 'plain AS')}, raster AS (SELECT image_id, x, y, CASE WHEN image_id % 16 = 0
  THEN 128 WHEN image_id % 4 = 0 THEN v
  WHEN (x >= 1 + image_id % 2 AND x <= 5 + image_id % 3 AND y >= image_id % 3 AND y <= 6 + image_id % 2
  AND x + y >= 2 + image_id % 5) = (image_id % 4 < 3) THEN 180 + v % 60 ELSE v % 70 END AS v FROM plain)"""


def _sheet():
    x, y, v, i = (F.col(c) for c in ("x", "y", "v", "image_id"))
    there = (x >= 1 + i % 2) & (x <= 5 + i % 3) & (y >= i % 3) & (y <= 6 + i % 2) & (x + y >= 2 + i % 5)
    return F.when(i % 16 == 0, 128).when(i % 4 == 0, v).when(there == (i % 4 < 3), 180 + v % 60).otherwise(v % 70)


_Q = {f"{a}{k}": f"q[{k + 1}].{a}" for k in range(4) for a in "xy"}


def _corner_angle(k: int) -> str:
    p, c, n = (k + 3) % 4, k, (k + 1) % 4
    ux, uy, vx, vy = (f"({_Q[f'{a}{o}']} - {_Q[f'{a}{c}']})" for o in (p, n) for a in "xy")
    return f"abs(degrees(acos(least(1.0, greatest(-1.0, ({ux} * {vx} + {uy} * {vy}) / (sqrt({ux} * {ux} + {uy} * {uy}) * sqrt({vx} * {vx} + {vy} * {vy})))))) - 90) <= 45 + 1e-9"


_SIZE = "abs(" + " + ".join(f"({_Q[f'x{k}']} * {_Q[f'y{(k + 1) % 4}']} - {_Q[f'x{(k + 1) % 4}']} * {_Q[f'y{k}']})" for k in range(4)) + ") / 2"
DETECT = f"""{SHEETS}, h0 AS (SELECT image_id, v, count(*) AS n FROM raster GROUP BY 1, 2),
  o1 AS (SELECT image_id, v, sum(n) OVER a AS wb, sum(n * v) OVER a AS sb, sum(n) OVER b AS w, sum(n * v) OVER b AS s FROM h0
  WINDOW a AS (PARTITION BY image_id ORDER BY v ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY image_id)),
 o2 AS (SELECT image_id, v, CASE WHEN w > wb
  THEN wb::DOUBLE * (w - wb)::DOUBLE * (sb::DOUBLE / wb - (s - sb)::DOUBLE / (w - wb)) * (sb::DOUBLE / wb - (s -
  sb)::DOUBLE / (w - wb)) END AS q FROM o1),
 otsu AS (SELECT image_id, coalesce(arg_max(v, (q, -v)) FILTER (q IS NOT NULL), 128) AS threshold FROM o2 GROUP BY 1),
 guess AS (SELECT image_id, avg(v) FILTER (x BETWEEN 3 AND 5 AND y BETWEEN 3 AND 5) >= avg(v) FILTER (x < 2 OR y < 2
  OR x >= 6 OR y >= 6) AS bright FROM raster GROUP BY 1),
 mask AS (SELECT image_id * 2 + p AS id, x, y, v FROM raster JOIN otsu USING (image_id), (SELECT unnest([0, 1]) AS p)
  WHERE CASE WHEN p = 1 THEN v > threshold ELSE v < threshold END),
 wide AS (SELECT DISTINCT id, x + dx AS x, y + dy AS y FROM mask, (SELECT unnest(range(-2, 3)) AS dx),
  (SELECT unnest(range(-2, 3)) AS dy) WHERE x + dx BETWEEN 0 AND 7 AND y + dy BETWEEN 0 AND 7),
 reach(id, x, y, label) AS (SELECT id, x, y, y * 8 + x FROM wide UNION SELECT w.id, w.x, w.y, reach.label FROM reach
  JOIN wide w ON w.id = reach.id AND abs(w.x - reach.x) + abs(w.y - reach.y) = 1),
 part AS (SELECT id, x, y, min(label) AS label FROM reach GROUP BY 1, 2, 3),
  best AS (SELECT id, arg_max(label, (n, -label)) AS label FROM (SELECT id, label, count(*) AS n FROM part GROUP BY 1, 2) GROUP BY 1),
 page AS (SELECT id, x, y, v FROM mask JOIN part USING (id, x, y) JOIN best USING (id, label)),
 body AS (SELECT id, n, cells FROM (SELECT id, count(*) AS n, sum(v) AS s,
  2 * (count(DISTINCT x) + count(DISTINCT y)) AS cells FROM page GROUP BY 1)
  JOIN (SELECT image_id, sum(v) AS total FROM raster GROUP BY 1) t ON t.image_id = id // 2
  WHERE n >= 64 * 0.05::DOUBLE AND n <= 64 * 0.985::DOUBLE AND cells >= 8 AND abs(s::DOUBLE / n - (total - s)::DOUBLE / (64 - n)) >= 12),
 points AS (SELECT id, unnest([min(x), max(x)]) AS x, y FROM page JOIN body USING (id) GROUP BY id, y UNION SELECT id,
  x, unnest([min(y), max(y)]) FROM page JOIN body USING (id) GROUP BY id, x),
 {_hull('points')}, {CUT},
 turned AS (SELECT id, list_sort(list_transform(pts, lambda p: {{'t': atan2(p.y - list_avg(list_transform(pts,
  lambda z: z.y)), p.x - list_avg(list_transform(pts, lambda z: z.x))), 'x': p.x, 'y': p.y}})) AS ts FROM quad WHERE len(pts) = 4),
 begun AS (SELECT id, ts, list_position(list_transform(ts, lambda p: p.x + p.y),
  list_min(list_transform(ts, lambda p: p.x + p.y))) AS k FROM turned),
 ordered AS (SELECT id, ts[k:] || ts[:k - 1] AS q FROM begun),
 good AS (SELECT id, q, list_avg(list_transform(q, lambda p: p.x)) AS cx,
  list_avg(list_transform(q, lambda p: p.y)) AS cy FROM ordered JOIN body USING (id)
  WHERE {_SIZE} >= 0.045::DOUBLE * 64 AND {' AND '.join(_corner_angle(k) for k in range(4))} AND n >= {_SIZE} / 2
  AND {_SIZE} <= 0.95::DOUBLE * 64),
 chosen AS (SELECT image_id, g.bright, a.id AS first_id, CASE WHEN a.id IS NOT NULL THEN a.id ELSE b.id END AS id
  FROM guess g LEFT JOIN good a ON a.id = image_id * 2 + g.bright::INT LEFT JOIN good b ON b.id = image_id * 2 + 1 - g.bright::INT)"""
_PULLED = ", ".join(f"""CASE WHEN cx IS NOT NULL THEN round(least(1.0::DOUBLE,
  greatest(0.0::DOUBLE, (q[{k + 1}].{a} - 0.8::DOUBLE * (q[{k + 1}].{a} - c{a}) / sqrt((q[{k + 1}].x - cx) *
  (q[{k + 1}].x - cx) + (q[{k + 1}].y - cy) * (q[{k + 1}].y - cy))) / 8)), 9) END AS {a}{k}""" for k in range(4) for a in "xy")


@query(f"""WITH RECURSIVE {DETECT} SELECT image_id, CASE WHEN chosen.id IS NOT NULL THEN chosen.id % 2 = 1 END AS bright,
  {_PULLED} FROM chosen LEFT JOIN good USING (id)""")
def detect(spark, d):
    """The outline found on every raster at its own size, null where none convinces."""
    found = detector.detect_pages(packed(spark, d, _sheet()), 8, 8)
    return found.select(F.col("id").cast("long").alias("image_id"), "bright", *[F.round(F.col("corners")[k], 9).alias(c) for k, c in enumerate(geometry.QUAD)])


@query(f"""WITH RECURSIVE {DETECT} SELECT image_id, image_id % 3 = 0 AS kept, chosen.id IS NOT NULL AS found,
  image_id % 3 = 0 OR chosen.id IS NOT NULL AS written FROM chosen LEFT JOIN good USING (id)""")
def redetect(spark, d):
    """Outlines looked for anew on the pages that were asked for, and written back: a page without one loses its corners."""
    p = packed(spark, d, _sheet()).withColumn("corners", F.array(*[F.lit(v) for v in QUAD]))
    asked = p.filter(F.col("image_id") % 3 != 0)
    all_ = detector.detect_pages(p, 8, 8).select("id", F.col("corners").isNotNull().alias("found"))
    out = pages.redetected(p, detector.detect_pages(asked, 8, 8)).join(all_, "id")
    same = F.coalesce(F.col("corners") == F.array(*[F.lit(v) for v in QUAD]), F.lit(False))
    return out.select("image_id", same.alias("kept"), "found", F.col("corners").isNotNull().alias("written"))


@query("""WITH RECURSIVE o AS (SELECT c_custkey % 20 AS camera, c_custkey // 20 AS seq, c_custkey % 3 = 0 AS guess,
  c_custkey % 7 < 4 AS bright_ok, c_custkey % 5 < 3 AS dark_ok FROM customer),
 s AS (SELECT *, row_number() OVER (PARTITION BY camera ORDER BY seq) AS n FROM o),
 e(camera, n, held, bright) AS (SELECT DISTINCT camera, 0::BIGINT, NULL::BOOLEAN, NULL::BOOLEAN FROM s UNION ALL
  SELECT s.camera, s.n, coalesce(z.b, e.held), z.b FROM e JOIN s ON s.camera = e.camera AND s.n = e.n + 1,
  LATERAL (SELECT CASE WHEN coalesce(e.held, s.guess) THEN CASE WHEN bright_ok THEN true WHEN dark_ok THEN false END
  ELSE CASE WHEN dark_ok THEN false WHEN bright_ok THEN true END END AS b) z)
 SELECT s.camera, s.seq, e.bright FROM e JOIN s USING (camera, n)""")
def sticky_polarity(spark, d):
    """Which reading of a page holds on each frame of a camera, the one that held last being tried first."""
    k = F.col("c_custkey")
    o = views.table(spark, d, "customer").select((k % 20).alias("camera"), F.expr("c_custkey div 20").alias("seq"), (k % 3 == 0).alias("guess"), (k % 7 < 4).alias("bright_ok"), (k % 5 < 3).alias("dark_ok"))
    return detector.polarity_track(o)


# ---------------------------------------------------------------- files
_BYTES = "sha256(string_agg(printf('%02X%02X%02X', v, v, v), '' ORDER BY y, x))"


@query(f"""WITH {RASTER} SELECT image_id, 'scan-20240131-120000-p' || (image_id + 1) || '.png' AS name, 8::BIGINT AS w,
  8::BIGINT AS h, true AS sized, {_BYTES} AS pixels_sha256 FROM raster GROUP BY 1""")
def image_export(spark, d):
    """Every raster as a PNG file, with its name, and what is read back from it."""
    p = packed(spark, d).withColumns({"ord": F.col("image_id"), "corners": no_corners(), "settings": as_map(preset("original"))})
    files = export.export_images(p, F.lit("2024-01-31 12:00:00").cast("timestamp"))
    back = images.decode_png(files).select("id", "w", "h", F.sha2(F.hex("data").cast("binary"), 256).alias("pixels_sha256"))
    rows = files.select("id", "name", (F.col("n_bytes") == F.octet_length("file")).alias("sized")).join(back, "id")
    return rows.select(F.col("id").cast("long").alias("image_id"), "name", F.col("w").cast("long").alias("w"), F.col("h").cast("long").alias("h"), "sized", "pixels_sha256")


def _jpeg_rows(files, body):
    whole = (F.hex(F.substring(body, 1, 2)) == "FFD8") & (F.hex(F.substring(body, -2, 2)) == "FFD9")
    return files.select(F.col("id").cast("long").alias("image_id"), F.col("w").cast("long").alias("w"), F.col("h").cast("long").alias("h"), whole.alias("is_jpeg"))


@query("SELECT vec_id AS image_id, 4::BIGINT AS w, 4::BIGINT AS h, true AS is_jpeg FROM embeddings")
def thumbnail(spark, d):
    """Every raster rendered small, fitted, and encoded."""
    p = packed(spark, d).withColumn("corners", no_corners()).withColumn("settings", F.lit(None).cast("map<string,string>"))
    t = export.thumbnails(p, 6, 4)
    return _jpeg_rows(t, F.unbase64(F.substring_index("url", ",", -1)))


@query("SELECT vec_id AS image_id, 5::BIGINT AS w, 5::BIGINT AS h, true AS is_jpeg FROM embeddings")
def print_render(spark, d):
    p = packed(spark, d).withColumn("corners", no_corners()).withColumn("settings", as_map(preset("original")))
    return _jpeg_rows(export.print_images(p, 5), F.col("file"))


_CAMERA = {"width": 48, "height": 36, "frames": 40}


@query(f"""WITH f AS (SELECT unnest(range(40)) AS seq), {_grid(48, 36)}
 SELECT 'camera-0' AS camera, seq, 48::BIGINT AS w, 36::BIGINT AS h,
  sum(CASE WHEN j < 12 AND i >= 3 * seq % 36 AND i < 3 * seq % 36 + 12 THEN 230 ELSE (i + j) % 64 END)::BIGINT AS light
  FROM f, grid GROUP BY 1, 2""")
def camera_frames(spark, d):
    """The frames of the made-up camera at the size it is asked for."""
    spark.dataSource.register(camera.CameraSource)
    reader = spark.read.format("camera")
    for k, v in _CAMERA.items():
        reader = reader.option(k, v)
    f = reader.load()
    one = f.select("camera", "seq", "w", "h", F.explode(F.sequence(F.lit(0), F.col("w") * F.col("h") - 1)).alias("p"), "data")
    v = F.conv(F.hex(F.substring(F.col("data"), F.col("p") * 3 + 1, F.lit(1))), 16, 10).cast("long")
    return one.groupBy("camera", "seq", "w", "h").agg(F.sum(v).alias("light")).select("camera", "seq", F.col("w").cast("long").alias("w"), F.col("h").cast("long").alias("h"), "light")


