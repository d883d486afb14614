"""Registered queries of settings, page collections, geometry, text, PDF and streams, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry, pages, pdf, settings, stats, store, text
from ..sources import images, views
from ..streaming import capture
from .imaging_queries import RASTER
from .registered import registry

QUERIES, SQL, query = registry()


# ---------------------------------------------------------------- settings
FIELDS = list(settings.DEFAULTS)


def _preset_rows() -> str:
    value = lambda v: f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE"
    return ", ".join(f"('{n}', " + ", ".join(value(settings.preset_record(n)[k]) for k in FIELDS) + ")" for n in settings.PRESETS)


NAMES = "[" + ", ".join(f"'{n}'" for n in views.PRESET_NAMES) + "]"
PRESETS = f"presets(filter, {', '.join(f'\"{k}\"' if k == 'window' else k for k in FIELDS)}) AS (VALUES {_preset_rows()})"
SETTINGS = f"""settings AS (SELECT doc_id AS id, ({NAMES})[doc_id % 8 + 1] AS filter,
  ((doc_id % 4) * 90)::DOUBLE AS rotate, doc_id % 3 = 0 AS flipH, (n_chars % 31 - 15)::DOUBLE AS straighten, n_chars AS n FROM documents)"""
LIST = ", ".join("\"window\"" if k == "window" else k for k in FIELDS)


@query(f"WITH {PRESETS}, {SETTINGS} SELECT id, rotate, flipH, straighten, filter, {LIST} FROM settings JOIN presets USING (filter)")
def set_filter(spark, d):
    return settings.apply_preset(views.settings(spark, d), F.col("filter")).drop("n")


@query(f"WITH {PRESETS}, {SETTINGS} SELECT id, 'custom' AS filter, least(100.0, greatest(-100.0, n - 1200.0))::DOUBLE AS contrast FROM settings")
def slider_edit(spark, d):
    p = settings.apply_preset(views.settings(spark, d), F.col("filter"))
    return settings.edit(p, "contrast", F.col("n") - F.lit(1200.0)).select("id", "filter", "contrast")


@query(f"""WITH {PRESETS}, {SETTINGS}, s AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'custom' ELSE filter END AS filter FROM settings)
 SELECT id, s.filter, coalesce(sharpen, 16.0::DOUBLE) AS sharpen FROM s LEFT JOIN presets USING (filter)""")
def slider_reset(spark, d):
    """Pages of even id were edited before, so no preset is left to go back to."""
    p = views.settings(spark, d).withColumns({"sharpen": F.lit(99.0), "filter": F.when(F.col("id") % 2 == 0, "custom").otherwise(F.col("filter"))})
    return settings.reset_field(p, "sharpen").select("id", "filter", "sharpen")


@query(f"""WITH {PRESETS}, {SETTINGS} SELECT id, rotate, straighten, 'original' AS filter, {LIST} FROM settings,
  (SELECT * EXCLUDE (filter) FROM presets WHERE filter = 'original')""")
def neutral_adjust(spark, d):
    return settings.neutral(settings.apply_preset(views.settings(spark, d), F.col("filter"))).select("id", "rotate", "straighten", "filter", *FIELDS)


@query(f"""WITH {PRESETS}, {SETTINGS}, one AS (SELECT presets.* FROM settings JOIN presets USING (filter) WHERE id = 13)
  SELECT id, rotate, flipH, straighten, one.filter, {LIST} FROM settings, one""")
def apply_all(spark, d):
    p = settings.apply_preset(views.settings(spark, d), F.col("filter"))
    return settings.apply_to_all(p, F.col("id") == 13).drop("n")


@query("""WITH s AS (SELECT conv_id AS session, turn, role = 'user' AND turn > 0 AS own,
  turn * 7.0::DOUBLE AS contrast, CASE WHEN turn % 2 = 0 THEN 'auto' ELSE 'ink' END AS filter, 90.0::DOUBLE AS rotate,
  turn % 3 = 0 AS flipH FROM conversations),
 h AS (SELECT *, max(CASE WHEN own THEN turn END) OVER (PARTITION BY session ORDER BY turn ROWS UNBOUNDED PRECEDING) AS giver FROM s)
 SELECT h.session, h.turn, coalesce(g.contrast, h.contrast) AS contrast, coalesce(g.filter, h.filter) AS filter, CASE
  WHEN h.own OR giver IS NULL THEN h.rotate ELSE 0 END::DOUBLE AS rotate, CASE WHEN h.own OR giver IS NULL THEN h.flipH
  ELSE false END AS flipH
 FROM h LEFT JOIN s g ON g.session = h.session AND g.turn = h.giver""")
def inherit(spark, d):
    p = views.page_list(spark, d).select("session", F.col("ord").alias("turn"), ((F.col("role") == "user") & (F.col("ord") > 0)).alias("own"), (F.col("ord") * F.lit(7.0)).alias("contrast"), F.when(F.col("ord") % 2 == 0, "auto").otherwise("ink").alias("filter"), F.lit(90.0).alias("rotate"), (F.col("ord") % 3 == 0).alias("flipH"))
    return settings.inherit(p, "session", "turn", F.col("own")).drop("own")


@query(f"""WITH {PRESETS}, {SETTINGS} SELECT id, abs(flatten - 65) > 1e-9 AS flatten_changed,
  abs(gamma - 1) > 1e-9 AS gamma_changed, abs(sharpen - 16) > 1e-9 AS sharpen_changed FROM settings JOIN presets USING (filter)""")
def mark_dirty(spark, d):
    p = settings.apply_preset(views.settings(spark, d), F.col("filter"))
    return p.select("id", *[settings.changed(F.col(k), settings.DEFAULTS[k]).alias(f"{k}_changed") for k in ("flatten", "gamma", "sharpen")])


@query(f"WITH {SETTINGS} SELECT id, ((rotate - 90) % 360 + 360) % 360 AS rotate FROM settings")
def rotate_setting(spark, d):
    return views.settings(spark, d).select("id", settings.turn(F.col("rotate"), -90).alias("rotate"))


# ---------------------------------------------------------------- collections
PAGES = "pages_ AS (SELECT conv_id AS session, conv_id || '-' || turn AS id, turn AS ord, role, text FROM conversations)"


@query(f"""WITH {PAGES} SELECT session, id, row_number() OVER (PARTITION BY session
  ORDER BY coalesce(CASE WHEN ord % 3 <> 1 THEN ord END, 0), id) - 1 AS ord FROM pages_""")
def restore_pages(spark, d):
    p = views.page_list(spark, d).withColumn("ord", F.when(F.col("ord") % 3 != 1, F.col("ord")))
    return pages.restored(p, "session").select("session", "id", F.col("ord").cast("long").alias("ord"))


@query(f"""WITH {PAGES}, q AS (SELECT session, id, CASE WHEN ord = 0 THEN 2.5 ELSE ord::DOUBLE END AS p FROM pages_)
  SELECT session, id, row_number() OVER (PARTITION BY session ORDER BY p, id) - 1 AS ord FROM q""")
def move_page(spark, d):
    return pages.move(views.page_list(spark, d), "session", 0, 2).select("session", "id", F.col("ord").cast("long").alias("ord"))


@query(f"WITH {PAGES} SELECT session, id, ord FROM pages_ WHERE ord <> 1")
def delete_page(spark, d):
    """The others keep their order."""
    return pages.delete(views.page_list(spark, d), F.col("ord") == 1).select("session", "id", "ord")


@query(f"WITH {PAGES} SELECT session, id, row_number() OVER (PARTITION BY session ORDER BY ord, id) - 1 AS ord FROM pages_ WHERE ord <> 1")
def delete_renumbered(spark, d):
    return pages.delete(views.page_list(spark, d), F.col("ord") == 1, "session").select("session", "id", F.col("ord").cast("long").alias("ord"))


@query(f"WITH {PAGES} SELECT session, id, ord FROM pages_ WHERE session % 2 = 1")
def clear_pages(spark, d):
    return pages.clear(views.page_list(spark, d), F.col("session") % 2 == 0).select("session", "id", "ord")


@query(f"WITH {PAGES} SELECT session, id, ord, CASE WHEN ord = 2 THEN upper(role) ELSE role END AS role FROM pages_")
def upsert(spark, d):
    p = views.page_list(spark, d).drop("text")
    return pages.upsert(p, p.filter("ord = 2").withColumn("role", F.upper("role")))


@query(f"WITH {PAGES} SELECT session, id, role FROM pages_ WHERE ord = 1")
def select_page(spark, d):
    return pages.select_at(views.page_list(spark, d), 1).select("session", "id", "role")


@query(f"""WITH {PAGES} SELECT session, id, lag(id) OVER w AS previous, lead(id) OVER w AS next
  FROM pages_ WINDOW w AS (PARTITION BY session ORDER BY ord, id)""")
def page_neighbours(spark, d):
    return pages.neighbours(views.page_list(spark, d), "session").select("session", "id", "previous", "next")


@query(f"""WITH {PAGES} SELECT session, string_agg('── page ' || (ord + 1) || ' ──' || chr(10) || text,
  chr(10) || chr(10) ORDER BY ord) AS text, count(*)::BIGINT AS n_pages FROM pages_ GROUP BY 1""")
def export_text(spark, d):
    return pages.export_text(views.page_list(spark, d), "session")


@query("SELECT event_id, 'scan-' || strftime(ts, '%Y%m%d-%H%M%S') || '-p' || user_id || '.png' AS name FROM events")
def file_names(spark, d):
    e = views.table(spark, d, "events")
    return e.select("event_id", pages.file_name(F.col("ts"), F.col("user_id"), "png").alias("name"))


# ---------------------------------------------------------------- geometry
QUADS = """quads AS (SELECT c_custkey AS id, c_custkey % 23 / 100.0::DOUBLE AS x0,
  c_custkey % 29 / 100.0::DOUBLE AS y0, 1 - c_custkey % 31 / 100.0::DOUBLE AS x1, c_custkey % 37 / 100.0::DOUBLE AS y1,
 1 - c_custkey % 41 / 100.0::DOUBLE AS x2, 1 - c_custkey % 43 / 100.0::DOUBLE AS y2,
  c_custkey % 47 / 100.0::DOUBLE AS x3, 1 - c_custkey % 19 / 100.0::DOUBLE AS y3, c_custkey % 800 + 200 AS w,
  c_custkey % 700 + 300 AS h FROM customer)"""


def _side(i: int, j: int) -> str:
    return f"sqrt((x{i} - x{j}) * w * ((x{i} - x{j}) * w) + (y{i} - y{j}) * h * ((y{i} - y{j}) * h))"


SIZED = f"""{QUADS}, sized AS (SELECT *, greatest(16, floor(greatest({_side(0, 1)}, {_side(3, 2)}) + 0.5))::BIGINT AS ow,
  greatest(16, floor(greatest({_side(0, 3)}, {_side(1, 2)}) + 0.5))::BIGINT AS oh FROM quads)"""


@query(f"WITH {SIZED} SELECT id, ow AS out_w, oh AS out_h FROM sized")
def output_size(spark, d):
    ow, oh = geometry.output_size(F.col("w"), F.col("h"))
    return views.quads(spark, d).select("id", ow.cast("long").alias("out_w"), oh.cast("long").alias("out_h"))


_PAPER = "CASE id % 3 WHEN 0 THEN CASE WHEN {up} THEN {a} ELSE {b} END WHEN 1 THEN CASE WHEN {up} THEN {c} ELSE {d} END ELSE {o} END"
TARGET = f"""{SIZED}, t AS (SELECT id, {_PAPER.format(up='oh >= ow', a=2480, b=3508, c=2550, d=3300, o='ow')} AS pw,
  {_PAPER.format(up='oh >= ow', a=3508, b=2480, c=3300, d=2550, o='oh')} AS ph FROM sized)"""


@query(f"WITH {TARGET} SELECT id, " + ", ".join(f"""CASE WHEN 1000.0::DOUBLE / greatest(pw, ph) < 1
  THEN greatest(16, floor({c} * (1000.0::DOUBLE / greatest(pw, ph)) + 0.5)) ELSE {c} END::BIGINT AS {n}""" for c, n in (("pw", "out_w"), ("ph", "out_h"))) + " FROM t")
def target_size(spark, d):
    paper = F.when(F.col("id") % 3 == 0, "a4").when(F.col("id") % 3 == 1, "letter").otherwise("detected")
    ow, oh = geometry.target_size(F.col("w"), F.col("h"), paper, 1000)
    return views.quads(spark, d).select("id", ow.cast("long").alias("out_w"), oh.cast("long").alias("out_h"))


@query(f"""WITH {SIZED} SELECT id, floor(greatest(ow, oh) / 11.69::DOUBLE + 0.5)::BIGINT AS dpi,
  floor(sqrt(ow * oh / (w * h)::DOUBLE) * 100 + 0.5)::BIGINT AS covers,
  floor(sqrt(ow * oh / (w * h)::DOUBLE) * 100 + 0.5) < 55 AS thin FROM sized""")
def dpi_coverage(spark, d):
    ow, oh = geometry.output_size(F.col("w"), F.col("h"))
    c = geometry.coverage(ow, oh, F.col("w"), F.col("h")).cast("long")
    return views.quads(spark, d).select("id", geometry.dots_per_inch(ow, oh).cast("long").alias("dpi"), c.alias("covers"), (c < 55).alias("thin"))


def _angle(i: int) -> str:
    a, c = (i + 3) % 4, (i + 1) % 4
    ux, uy, vx, vy = (f"({k}{p} - {k}{i})" for p in (a, c) for k in "xy")
    return f"degrees(acos(least(1.0, greatest(-1.0, ({ux} * {vx} + {uy} * {vy}) / (sqrt({ux} * {ux} + {uy} * {uy}) * sqrt({vx} * {vx} + {vy} * {vy})))))) BETWEEN 45 AND 135"


_AREA = "abs((x0 * y1 - x1 * y0) + (x1 * y2 - x2 * y1) + (x2 * y3 - x3 * y2) + (x3 * y0 - x0 * y3)) / 2"


@query(f"WITH {QUADS}, p AS (SELECT id, w, h, " + ", ".join(f"x{i} * w AS x{i}, y{i} * h AS y{i}" for i in range(4)) + f" FROM quads) SELECT id, round({_AREA}, 6) AS area, {_AREA} >= 0.045 * w * h AND " + " AND ".join(_angle(i) for i in range(4)) + " AS valid FROM p")
def valid_quad(spark, d):
    q = views.quads(spark, d).withColumns({f"{a}{i}": F.col(f"{a}{i}") * F.col(s) for i in range(4) for a, s in (("x", "w"), ("y", "h"))})
    return q.select("id", F.round(geometry.area(), 6).alias("area"), geometry.is_valid(F.col("w"), F.col("h")).alias("valid"))


@query(f"WITH {QUADS} SELECT id, " + " AND ".join(f"abs({c} - {v}) <= 1e-4" for c, v in zip(geometry.QUAD, (0, 0, 1, 0, 1, 1, 0, 1))) + " AS full_frame FROM quads")
def full_frame(spark, d):
    return views.quads(spark, d).select("id", geometry.is_full_frame().alias("full_frame"))


def _cross(i: int, j: int, x: str, y: str) -> str:
    return f"sign((x{j} - x{i}) * ({y} - y{i}) - (y{j} - y{i}) * ({x} - x{i}))"


_SIGNS = ", ".join(_cross(i, (i + 1) % 4, "(id % 97 / 97.0::DOUBLE)", "(id % 89 / 89.0::DOUBLE)") for i in range(4))


@query(f"WITH {QUADS} SELECT id, NOT (greatest({_SIGNS}) > 0 AND least({_SIGNS}) < 0) AS inside FROM quads")
def inside_quad(spark, d):
    return views.quads(spark, d).select("id", geometry.inside(F.col("id") % 97 / F.lit(97.0), F.col("id") % 89 / F.lit(89.0)).alias("inside"))


@query(f"""WITH {QUADS}, p AS (SELECT *, (x0 + x1 + x2 + x3) / 4 AS cx, (y0 + y1 + y2 + y3) / 4 AS cy
  FROM (SELECT id, x2 AS x0, y2 AS y0, x0 AS x1, y0 AS y1, x3 AS x2, y3 AS y2, x1 AS x3, y1 AS y3 FROM quads)),
 u AS (SELECT id, cx, cy, i, ([x0, x1, x2, x3])[i + 1] AS x, ([y0, y1, y2, y3])[i + 1] AS y FROM p, (SELECT unnest(range(4)) AS i)),
 r AS (SELECT id, x, y, row_number() OVER (PARTITION BY id ORDER BY atan2(y - cy, x - cx), i) - 1 AS k FROM u),
 s AS (SELECT id, arg_min(k, (x + y, k)) AS s FROM r GROUP BY 1)
 SELECT id, """ + ", ".join(f"max({a}) FILTER ((k - s + 4) % 4 = {i}) AS {a}{i}" for i in range(4) for a in "xy") + " FROM r JOIN s USING (id) GROUP BY 1")
def order_corners(spark, d):
    swapped = views.quads(spark, d).select("id", *[F.col(f"{a}{j}").alias(f"{a}{i}") for i, j in enumerate((2, 0, 3, 1)) for a in "xy"])
    return swapped.select("id", *geometry.ordered())


@query(f"""WITH {QUADS}, u AS (SELECT id, w, i, sqrt(pow((([x0, x1, x2, x3])[i + 1] - id % 13 / 100.0::DOUBLE) * w,
  2.0) + pow((([y0, y1, y2, y3])[i + 1] - id % 17 / 100.0::DOUBLE) * h, 2.0)) / w AS dist FROM quads, (SELECT unnest(range(4)) AS i))
 SELECT id, CASE WHEN min(dist) < 26.0::DOUBLE / greatest(any_value(w), 1)
  THEN arg_min(i, (dist, i)) END::BIGINT AS corner FROM u GROUP BY 1""")
def corner_pick(spark, d):
    return views.quads(spark, d).select("id", geometry.nearest_corner(F.col("id") % 13 / F.lit(100.0), F.col("id") % 17 / F.lit(100.0), F.col("w"), F.col("h")).cast("long").alias("corner"))


@query(f"WITH {RASTER} SELECT image_id, 7 - y AS x, x AS y, v FROM raster")
def rotate90(spark, d):
    return geometry.turned(views.raster8(spark, d), 8, 8, 1)


@query(f"WITH {RASTER} SELECT image_id, 7 - x AS x, 7 - y AS y, v FROM raster")
def flip(spark, d):
    return geometry.flipped(views.raster8(spark, d), 8, 8, True, True)


#: the map of the unit square onto a quad, as SQL over x0..y3
SQUARE = """u AS (SELECT *, x1 - x2 AS ux, y1 - y2 AS uy, x3 - x2 AS vx, y3 - y2 AS vy, x0 - x1 + x2 - x3 AS sx,
  y0 - y1 + y2 - y3 AS sy FROM {quads}),
 u1 AS (SELECT *, ux * vy - vx * uy AS det, (x1 - x0) * (y3 - y0) - (x3 - x0) * (y1 - y0) AS flat FROM u),
 u2 AS (SELECT *, (sx * vy - vx * sy) / det AS g, (ux * sy - sx * uy) / det AS h_ FROM u1 WHERE abs(det) >= 1e-12 AND abs(flat) >= 1e-12)"""
_COEFFICIENTS = ("x1 - x0 + g * x1", "x3 - x0 + h_ * x3", "x0", "y1 - y0 + g * y1", "y3 - y0 + h_ * y3", "y0", "g", "h_", "1.0::DOUBLE")


@query(f"WITH {QUADS}, {SQUARE.format(quads='quads')} SELECT quads.id, " + ", ".join(f"round({c}, 9) AS m{k}" for k, c in enumerate(f"m.{x}" for x in ("a", "b", "c", "d", "e", "f", "g", "h", "i"))) + " FROM quads LEFT JOIN (SELECT id, " + ", ".join(f"{c} AS {n}" for c, n in zip(_COEFFICIENTS, "abcdefghi")) + " FROM u2) m USING (id)")
def homography(spark, d):
    """Coefficients of the map from the unit square onto each quad; null where there is none."""
    m = views.quads(spark, d).select("id", geometry.unit_square_map().alias("m"))
    return m.select("id", *[F.round(F.col("m")[k], 9).alias(f"m{k}") for k in range(9)])


# ---------------------------------------------------------------- text
@query("""SELECT doc_id, rtrim(regexp_replace(regexp_replace(replace(text, '. ',
  chr(10) || chr(10) || chr(10) || chr(10)) || '  ' || chr(10), chr(10) || '{3,}', chr(10) || chr(10), 'g'), '\\s+$',
  '')) AS text FROM documents""")
def normalise_text(spark, d):
    t = F.concat(F.regexp_replace("text", r"\. ", "\n\n\n\n"), F.lit("  \n"))
    return views.table(spark, d, "documents").select("doc_id", text.tidy(t).alias("text"))


WORDS = """lab AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1),
  w0 AS (SELECT doc_id, string_split(text, ' ') AS ws FROM documents),
 w1 AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS word FROM w0),
 words AS (SELECT doc_id, i, word, (coalesce(quality, 0) * 40 + i % 60)::DOUBLE AS conf, (i % 10 * 100)::DOUBLE AS x0,
  (i // 10 * 20)::DOUBLE AS y0, (i % 10 * 100 + length(word) * 9)::DOUBLE AS x1, (i // 10 * 20 + 16)::DOUBLE AS y1
  FROM w1 LEFT JOIN lab USING (doc_id))"""


@query(f"WITH {WORDS} SELECT doc_id, i, word AS text, conf FROM words WHERE i % 7 <> 3")
def flatten_words(spark, d):
    """Words nested in blocks, paragraphs and lines, and back to a list; some lack a box."""
    w = views.ocr_words(spark, d).withColumn("x0", F.when(F.col("i") % 7 != 3, F.col("x0")))
    word = F.struct(F.col("word").alias("text"), "conf", "x0", "y0", "x1", "y1")
    own = w.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", word.alias("w")))).alias("ws"))  # the words of one text
    line = lambda k: F.transform(F.slice("ws", k * 10 + 1, 10), lambda x: x["w"])
    block = lambda k: F.struct(F.array(F.struct(F.array(F.struct(line(k).alias("words"))).alias("lines"))).alias("paragraphs"))
    blocks = own.select("doc_id", F.transform(F.sequence(F.lit(0), F.floor((F.size("ws") - 1) / 10).cast("int")), block).alias("blocks"))
    none = F.lit(None).cast("array<struct<text:string,conf:double,x0:double,y0:double,x1:double,y1:double>>")
    out = blocks.select("doc_id", F.explode(text.word_list(none, F.col("blocks"))).alias("w"))
    return out.select("doc_id", (F.floor(F.col("w.y0") / 20) * 10 + F.floor(F.col("w.x0") / 100)).cast("long").alias("i"), "w.text", "w.conf")


@query(f"""WITH {WORDS} SELECT doc_id, i, round(x0 * 0.75, 4) AS x0, round(y0 * 1.25, 4) AS y0,
  round(x1 * 0.75, 4) AS x1, round(y1 * 1.25, 4) AS y1 FROM words""")
def scale_words(spark, d):
    w = views.ocr_words(spark, d).withColumn("ws", text.rescaled(F.array(F.struct(F.col("word").alias("text"), "conf", "x0", "y0", "x1", "y1")), F.lit(0.75), F.lit(1.25)))
    return w.select("doc_id", F.col("i").cast("long").alias("i"), *[F.round(F.col("ws")[0][k], 4).alias(k) for k in ("x0", "y0", "x1", "y1")])


@query(f"""WITH {WORDS} SELECT doc_id, CASE WHEN conf > 85 THEN 'good' WHEN conf > 60 THEN 'warn'
  ELSE 'bad' END AS class, count(*)::BIGINT AS n FROM words GROUP BY 1, 2""")
def box_class(spark, d):
    return views.ocr_words(spark, d).groupBy("doc_id", text.box_class(F.col("conf")).alias("class")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- PDF
WIDTHS = ", ".join(str(v) for v in pdf.HELVETICA)
LAYOUT = """boxes AS (SELECT id, w, h, CASE WHEN id % 2 = 0 THEN CASE WHEN w > h THEN 841.89 ELSE 595.28 END ELSE CASE
  WHEN w >= h THEN 841.89::DOUBLE ELSE 841.89::DOUBLE * w / h END END::DOUBLE AS pw,
 CASE WHEN id % 2 = 0 THEN CASE WHEN w > h THEN 595.28 ELSE 841.89 END ELSE CASE WHEN w >= h
  THEN 841.89::DOUBLE * h / w ELSE 841.89::DOUBLE END END::DOUBLE AS ph FROM quads),
 placed AS (SELECT *, w * least(pw / w, ph / h) AS dw, h * least(pw / w, ph / h) AS dh,
  (pw - w * least(pw / w, ph / h)) / 2 AS ox, (ph - h * least(pw / w, ph / h)) / 2 AS oy FROM boxes)"""


def _placed(q):
    boxes = [F.when(F.col("id") % 2 == 0, a).otherwise(b) for a, b in zip(pdf.page_box(F.col("w"), F.col("h"), "a4"), pdf.page_box(F.col("w"), F.col("h"), "auto"))]
    q = q.withColumn("pw", boxes[0]).withColumn("ph", boxes[1])
    return q.withColumns(pdf.placement(F.col("w"), F.col("h"), F.col("pw"), F.col("ph")))


@query(f"""WITH {QUADS}, {LAYOUT} SELECT id, round(pw, 4) AS pw, round(ph, 4) AS ph, round(dw, 4) AS dw,
  round(dh, 4) AS dh, round(ox, 4) AS ox, round(oy, 4) AS oy FROM placed""")
def pdf_layout(spark, d):
    return _placed(views.quads(spark, d)).select("id", *[F.round(c, 4).alias(c) for c in ("pw", "ph", "dw", "dh", "ox", "oy")])


@query(f"""WITH {WORDS} SELECT doc_id, i, round(list_sum(list_transform(string_split(word, ''), lambda c: CASE
  WHEN unicode(c) BETWEEN 32 AND 126 THEN ([{WIDTHS}])[unicode(c) - 31] ELSE 500 END)) * 12 / 1000.0::DOUBLE,
  6) AS width FROM words WHERE word <> ''""")
def text_width(spark, d):
    return views.ocr_words(spark, d).filter("word <> ''").select("doc_id", F.col("i").cast("long").alias("i"), F.round(pdf.text_width(F.col("word"), F.lit(12.0)), 6).alias("width"))


@query(f"""WITH {WORDS}, {QUADS}, {LAYOUT}, t AS (SELECT doc_id, i, trim(word) AS word, (x1 - x0) * (dw / w) AS bw,
  (y1 - y0) * (dh / h) AS bh, ox + x0 * (dw / w) AS tx, oy + dh - y1 * (dh / h) AS ty FROM words JOIN placed ON placed.id = doc_id + 1),
 s AS (SELECT *, least(bh * 0.92, 200.0::DOUBLE) AS size FROM t WHERE word <> '' AND bw > 0.3 AND bh > 0.3),
 n AS (SELECT *, list_sum(list_transform(string_split(word, ''), lambda c: CASE WHEN unicode(c) BETWEEN 32 AND 126
  THEN ([{WIDTHS}])[unicode(c) - 31] ELSE 500 END)) * size / 1000 AS nat FROM s)
 SELECT doc_id, i, round(size, 6) AS size, round(greatest(1.0::DOUBLE, least(3000.0::DOUBLE, bw / nat * 100)),
  6) AS stretch, round(tx, 6) AS tx, round(ty + size * 0.16, 6) AS ty FROM n WHERE nat > 0""")
def text_layer(spark, d):
    page = _placed(views.quads(spark, d)).select((F.col("id") - 1).alias("doc_id"), "w", "h", "dw", "dh", "ox", "oy")
    t = pdf.text_layer(views.ocr_words(spark, d).join(page, "doc_id"))
    return t.select("doc_id", F.col("i").cast("long").alias("i"), F.round("size", 6).alias("size"), F.round("stretch", 6).alias("stretch"), F.round("tx", 6).alias("tx"), F.round("ty", 6).alias("ty"))




# ---------------------------------------------------------------- streams
MOTION = """motion AS (SELECT event_type AS camera, ts, event_id,
  coalesce(least(1.0::DOUBLE, abs(value - lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id)) / 500),
  0.0::DOUBLE) AS m FROM events)"""
LIMIT, DWELL = capture.threshold(50), 1800.0


@query(f"""WITH {MOTION} SELECT camera, event_id, round(m, 9) AS m,
  round(least(100.0, m / 0.12::DOUBLE * 100), 6) AS percent, CASE WHEN m < {LIMIT}::DOUBLE THEN 'still'
  ELSE 'moving' END AS label FROM motion""")
def motion(spark, d):
    return views.motion(spark, d).select("camera", "event_id", F.round("m", 9).alias("m"), *[c for c in capture.meter(F.col("m"), LIMIT)]).withColumn("percent", F.round("percent", 6))


@query(f"""WITH {RASTER}, f AS (SELECT image_id % 5 AS camera, image_id AS frame, x, y,
  abs(v - lag(v) OVER (PARTITION BY image_id % 5, x, y ORDER BY image_id)) AS dv FROM raster) SELECT camera, frame,
  round(coalesce(avg(dv) / 255, 0.0), 9) AS m FROM f GROUP BY 1, 2""")
def frame_motion(spark, d):
    f = views.raster8(spark, d).select((F.col("image_id") % 5).alias("camera"), F.col("image_id").alias("frame"), "x", "y", "v")
    return capture.frame_motion(f).withColumn("m", F.round("m", 9))


SHOTS = f"""{MOTION}, i AS (SELECT *, epoch_us(ts) / 1e6 AS t, sum(CASE WHEN m >= {LIMIT}::DOUBLE THEN 1 ELSE 0 END)
  OVER (PARTITION BY camera ORDER BY ts, event_id) AS island FROM motion),
 s AS (SELECT *, min(t) OVER (PARTITION BY camera, island) AS start FROM i WHERE m < {LIMIT}::DOUBLE AND island > 0),
 shots AS (SELECT camera, event_id, row_number() OVER (PARTITION BY camera, island ORDER BY ts, event_id) AS n FROM s
  WHERE t - start >= {DWELL} AND t > start)"""


@query(f"WITH {SHOTS} SELECT camera, event_id FROM shots WHERE n = 1")
def auto_capture(spark, d):
    return capture.auto_capture(views.motion(spark, d), LIMIT, DWELL).select("camera", "event_id")


@query(f"WITH {SHOTS} SELECT camera, event_id FROM shots WHERE n = 1")
def auto_capture_fold(spark, d):
    """The state machine over each camera; at this dwell equal to the window form."""
    return capture.auto_capture_fold(views.motion(spark, d), LIMIT, DWELL, 1400.0).select("camera", "event_id")


@query(f"""WITH {MOTION}, r AS (SELECT camera, event_id, row_number()
  OVER (PARTITION BY camera, epoch_us(ts) // 3600000000 ORDER BY ts, event_id) AS n FROM motion) SELECT camera, event_id FROM r WHERE n = 1""")
def interval_capture(spark, d):
    return capture.interval_capture(views.motion(spark, d), 3600).select("camera", "event_id")


READ = """readings AS (SELECT image_id % 20 AS camera, image_id // 20 AS seq, CASE WHEN image_id % 7 < 5
  THEN v / 255.0::DOUBLE END AS q FROM raster WHERE x = 3 AND y = 3)"""


@query(f"""WITH RECURSIVE {RASTER}, {READ}, e(camera, seq, q, miss) AS (SELECT camera, seq, q, CASE WHEN q IS NULL
  THEN 1 ELSE 0 END FROM readings WHERE seq = 0
 UNION ALL SELECT r.camera, r.seq, CASE WHEN r.q IS NULL THEN CASE WHEN e.miss + 1 > 3 THEN NULL ELSE e.q END
  WHEN e.q IS NULL THEN r.q WHEN sqrt(2 * (r.q - e.q) * (r.q - e.q)) > 0.05 THEN e.q + (r.q - e.q) * 1.0::DOUBLE
  ELSE e.q + (r.q - e.q) * 0.4::DOUBLE END, CASE WHEN r.q IS NULL THEN e.miss + 1 ELSE 0 END
 FROM e JOIN readings r ON r.camera = e.camera AND r.seq = e.seq + 1)
 SELECT camera, seq, round(q, 9) AS q FROM e""")
def quad_easing(spark, d):
    p = views.raster8(spark, d).filter("x = 3 AND y = 3")
    v = F.col("v") / F.lit(255.0)
    r = p.select((F.col("image_id") % 20).alias("camera"), F.expr("image_id div 20").alias("seq"), F.when(F.col("image_id") % 7 < 5, F.array(*[v] * 8)).alias("quad"))
    return capture.quad_easing(r).select("camera", "seq", F.round(F.col("quad")[0], 9).alias("q"))


CAPS = """caps AS (SELECT s_suppkey AS device, s_nationkey AS n,
  (['iso', 'exposureTime', 'brightness', 'focus', 'exposureCompensation'])[s_nationkey % 5 + 1] AS key,
  0.0::DOUBLE AS lo, 100.0::DOUBLE AS hi, (s_suppkey % 101)::DOUBLE AS value, CASE WHEN s_suppkey % 4 > 0
  THEN (s_suppkey % 9)::DOUBLE END AS step FROM supplier)"""


@query(f"""WITH {CAPS} SELECT device, least(hi, greatest(lo, value + greatest(coalesce(step, 0.0),
  (hi - lo) / 20))) AS up, least(hi, greatest(lo, value - greatest(coalesce(step, 0.0), (hi - lo) / 20))) AS down FROM caps""")
def nudge_exposure(spark, d):
    s = views.table(spark, d, "supplier").select(F.col("s_suppkey").alias("device"), F.lit(0.0).alias("lo"), F.lit(100.0).alias("hi"), (F.col("s_suppkey") % 101).cast("double").alias("value"), F.when(F.col("s_suppkey") % 4 > 0, (F.col("s_suppkey") % 9).cast("double")).alias("step"))
    args = [F.col(c) for c in ("value", "lo", "hi", "step")]
    return s.select("device", capture.nudged(*args, 1).alias("up"), capture.nudged(*args, -1).alias("down"))


@query("""WITH c AS (SELECT s_nationkey AS device, s_suppkey AS id,
  (['iso', 'exposureTime', 'brightness', 'focus', 'exposureCompensation'])[s_suppkey % 5 + 1] AS key FROM supplier),
 r AS (SELECT device, key, list_position(['exposureCompensation', 'exposureTime', 'iso', 'brightness'], key) AS p FROM c)
 SELECT device, arg_min(key, p) AS key FROM r WHERE p > 0 GROUP BY 1""")
def exposure_knob(spark, d):
    names = F.array(*[F.lit(k) for k in ("iso", "exposureTime", "brightness", "focus", "exposureCompensation")])
    s = views.table(spark, d, "supplier").select(F.col("s_nationkey").alias("device"), F.element_at(names, (F.col("s_suppkey") % 5 + 1).cast("int")).alias("key"), F.lit("range").alias("kind"))
    return capture.first_knob(s).select("device", "key")


@query("""WITH m AS (SELECT p_size AS device, p_partkey AS id, ([1200, 960, 720, 480])[p_partkey % 4 + 1] AS h,
  ([1600, 1280, 960, 1920])[p_partkey % 4 + 1] AS w, p_partkey % 40 AS fps FROM part),
 r AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY h DESC, w, id) AS n FROM m WHERE h IN (1200, 960, 720)
  AND abs(w / h::DOUBLE - 4 / 3.0::DOUBLE) < 0.02 AND fps >= 20)
 SELECT device, w, h FROM r WHERE n = 1""")
def preview_mode(spark, d):
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("p_partkey") % 4 + 1).cast("int"))
    m = views.table(spark, d, "part").select(F.col("p_size").alias("device"), pick(1200, 960, 720, 480).alias("h"), pick(1600, 1280, 960, 1920).alias("w"), (F.col("p_partkey") % 40).alias("fps"), F.lit(4 / 3).alias("aspect"))
    return capture.preview_mode(m).select("device", "w", "h")


@query(f"""WITH {QUADS} SELECT id, x0 + 0.7 >= 0.82 AS same_view, (x0 + 0.7 >= 0.82 AND w * h > 500 * 600 * 1.1) AS bigger FROM quads""")
def still_probe(spark, d):
    return views.quads(spark, d).select("id", *capture.still_verdict(F.col("x0") + F.lit(0.7), F.col("w"), F.col("h"), F.lit(500), F.lit(600)))


@query("SELECT page_id, url LIKE '%1' AS is_image FROM pages")
def mime_filter(spark, d):
    mime = F.when(F.col("url").endswith("1"), "image/png").otherwise("text/html")
    return views.table(spark, d, "pages").select("page_id", images.is_image(mime).alias("is_image"))


@query("SELECT event_type AS key, arg_max(props, (ts, event_id)) AS value FROM events GROUP BY 1")
def key_value_store(spark, d):
    """The last value put under each key, as a settings store keeps it."""
    log = views.table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("props").alias("value"), "ts", "event_id")
    return store.latest(log, "ts", "event_id")


# ---------------------------------------------------------------- and more
@query(f"""WITH {QUADS}, s AS (SELECT *, id % 3 > 0 AND w * h > 600 * 500 AS still FROM quads) SELECT id, CASE WHEN still
  THEN w ELSE 600 END::BIGINT AS w, CASE WHEN still THEN h ELSE 500 END::BIGINT AS h, still AS via_still FROM s""")
def grab(spark, d):
    out = capture.grabbed(F.col("w"), F.col("h"), F.lit(600), F.lit(500), F.col("id") % 3 > 0)
    return views.quads(spark, d).select("id", *out).withColumns({k: F.col(k).cast("long") for k in "wh"})


@query(f"""WITH {QUADS} SELECT id, CASE WHEN NOT (id % 3 > 0 AND w * h > 600 * 500) OR x0 > 0.1 THEN CASE WHEN id % 5 > 0
  THEN 'live' ELSE 'none' END ELSE CASE WHEN id % 7 > 0 THEN 'shot' ELSE 'none' END END AS outline FROM quads""")
def capture_decision(spark, d):
    q = views.quads(spark, d)
    still = capture.grabbed(F.col("w"), F.col("h"), F.lit(600), F.lit(500), F.col("id") % 3 > 0)[2]
    return q.select("id", capture.outline_source(still, F.col("x0") > 0.1, F.col("id") % 5 > 0, F.col("id") % 7 > 0).alias("outline"))


@query("""WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS t, lead(epoch_us(ts))
  OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events)
 SELECT user_id, event_id FROM e WHERE after IS NULL OR after - t >= 36000 * 1e6""")
def debounce(spark, d):
    e = views.table(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return capture.settled(e, "user_id", 36000).select("user_id", "event_id")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}', {k in text.BUNDLED})" for k, v in text.LANGUAGES.items()) + ") AS t(code, name, bundled)")
def languages(spark, d):
    return text.language_table(spark)


@query(f"""WITH {PAGES}, l AS (SELECT session, max(ord) AS last FROM pages_ GROUP BY 1) SELECT session, id, ord
  FROM pages_ UNION ALL SELECT session, 'new-' || id, last + row_number() OVER (PARTITION BY session ORDER BY id)
  FROM pages_ JOIN l USING (session) WHERE role = 'user'""")
def append_pages(spark, d):
    p = views.page_list(spark, d).select("session", "id", "ord")
    new = views.page_list(spark, d).filter("role = 'user'").select("session", F.concat(F.lit("new-"), "id").alias("id"))
    return pages.append(p, new, "session")


@query(f"""WITH {SETTINGS} SELECT id, coalesce(CASE WHEN n % 2 = 0 THEN n * 0.1::DOUBLE END, 65.0::DOUBLE) AS flatten,
  1.0::DOUBLE AS gamma, filter FROM settings""")
def settings_defaults(spark, d):
    p = views.settings(spark, d).withColumn("flatten", F.when(F.col("n") % 2 == 0, F.col("n") * F.lit(0.1)))
    return settings.with_defaults(p).select("id", "flatten", "gamma", "filter")


@query(f"WITH {SETTINGS} SELECT id, straighten BETWEEN -15 AND 15 AND n / 20.0 BETWEEN 0 AND 100 AS valid FROM settings")
def settings_valid(spark, d):
    p = views.settings(spark, d).withColumn("flatten", F.col("n") / F.lit(20.0))
    return p.select("id", settings.in_range(p).alias("valid"))


@query(f"""WITH {RASTER}, {QUADS}, j AS (SELECT image_id, v, x0, x1, x2, x3, y0, y1, y2, y3, (x + 0.5) / 8 AS px,
  (y + 0.5) / 8 AS py FROM raster JOIN quads ON quads.id = image_id + 1),
 z AS (SELECT image_id, v, """ + ", ".join(_cross(i, (i + 1) % 4, "px", "py") + f" AS s{i}" for i in range(4)) + """ FROM j),
 h AS (SELECT image_id, v, count(*) AS n FROM z WHERE NOT (greatest(s0, s1, s2, s3) > 0 AND least(s0, s1, s2, s3) < 0) GROUP BY 1, 2),
 acc AS (SELECT image_id, v, sum(n) OVER (PARTITION BY image_id ORDER BY v ROWS UNBOUNDED PRECEDING) AS a, sum(n)
   OVER (PARTITION BY image_id) AS t FROM h)
 SELECT image_id, min(v)::BIGINT AS level FROM acc WHERE a >= t * 0.9::DOUBLE GROUP BY 1""")
def level_in_outline(spark, d):
    """The 90 % level of each raster inside an outline."""
    q = views.quads(spark, d).withColumn("image_id", F.col("id") - 1).drop("id", "w", "h")
    p = views.raster8(spark, d).join(q, "image_id").filter(geometry.inside((F.col("x") + 0.5) / 8, (F.col("y") + 0.5) / 8))
    return stats.percentile_level(stats.histogram(p, F.col("v")), 0.9).select("image_id", F.col("level").cast("long").alias("level"))


_MARKS = "".join(map(chr, pdf.WIN_ANSI))
_CODES = "".join(map(chr, pdf.WIN_ANSI.values()))


@query(rf"""WITH t AS (SELECT doc_id, replace(text, 'e',
  '(\') || chr(8212) || chr(8364) || chr(9) || chr(26085) || chr(128512) AS s FROM documents),
 u AS (SELECT doc_id, regexp_replace(regexp_replace(s, '[\x{{10000}}-\x{{10FFFF}}]', '??', 'g'),
  '[^\x00-\xff{_MARKS}]', '?', 'g') AS s FROM t)
 SELECT doc_id, '(' || regexp_replace(regexp_replace(translate(s, '{_MARKS}', '{_CODES}'), '[\x00-\x1f]', ' ', 'g'),
  '([()\\])', '\\\1', 'g') || ')' AS literal FROM u""")
def pdf_string(spark, d):
    s = F.concat(F.replace("text", F.lit("e"), F.lit("(\\")), F.lit("—€\t日\U0001f600"))
    return views.table(spark, d, "documents").select("doc_id", pdf.literal_text(s).alias("literal"))
