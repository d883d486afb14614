"""Registered queries of documents, recognition, stores and devices, and their SQL."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import export, pages, pdf, settings, store, text
from ..sources import codec, images, views
from ..streaming import capture
from .imaging_queries import RASTER
from .packed_queries import as_map, no_corners, packed, preset
from .page_queries import PAGES, PRESETS, SETTINGS, WIDTHS
from .registered import registry

QUERIES, SQL, query = registry()

# ---------------------------------------------------------------- settings
_FRESH = settings.preset_record("auto")


@query(f"""WITH {PRESETS}, {SETTINGS} SELECT id, CASE WHEN id % 3 = 0 THEN 'auto' ELSE filter END AS filter, CASE
  WHEN id % 3 = 0 THEN {_FRESH['contrast']}::DOUBLE ELSE contrast END AS contrast,
 CASE WHEN id % 3 = 0 THEN '{_FRESH['wb']}' ELSE wb END AS wb, CASE WHEN id % 3 = 0 THEN 0::DOUBLE
  ELSE rotate END AS rotate, CASE WHEN id % 3 = 0 THEN false ELSE flipH END AS flipH FROM settings JOIN presets USING (filter)""")
def reset_all(spark, d):
    p = settings.apply_preset(views.settings(spark, d), F.col("filter"))
    return settings.reset_all(p, F.col("id") % 3 == 0).select("id", "filter", "contrast", "wb", "rotate", "flipH")


@query(f"""WITH {PRESETS}, {SETTINGS} SELECT id, filter, CASE WHEN id % 2 = 0 THEN 'white' ELSE 'off' END AS wb,
  id % 5 = 0 AS invert, 'a4' AS outSize, (id % 3 = 0) <> (id % 4 = 1) AS flipH FROM settings JOIN presets USING (filter)""")
def choices(spark, d):
    """White balance, inversion, size and flips edited; the preset's name stays."""
    p = settings.apply_preset(views.settings(spark, d), F.col("filter"))
    for field, value in (("wb", F.when(F.col("id") % 2 == 0, "white").otherwise("off")), ("invert", F.col("id") % 5 == 0), ("outSize", F.lit("a4"))):
        p = settings.choose(p, field, value)
    return settings.flip(p, "flipH", F.col("id") % 4 == 1).select("id", "filter", "wb", "invert", "outSize", "flipH")


# ---------------------------------------------------------------- store
@query("""SELECT (k.value ->> 'k')::BIGINT AS value FROM (SELECT event_type AS key,
  arg_max(props, (ts, event_id)) AS value FROM events GROUP BY 1) k WHERE key = 'error'""")
def preference_read(spark, d):
    log = views.table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("props").alias("value"), "ts", "event_id")
    return store.get(store.latest(log, "ts", "event_id"), "error", "struct<k: bigint>").select("value.k").withColumnRenamed("k", "value")


@query("""WITH s AS (SELECT event_type AS key, arg_max(props, (ts, event_id)) AS value FROM events GROUP BY 1),
  n AS (SELECT n_name AS key, '{"key":' || n_nationkey || ',"name":"' || n_name || '"}' AS value FROM nation UNION ALL
  SELECT 'error', '{"key":-1,"name":"over"}')
 SELECT key, value FROM n UNION ALL SELECT key, value FROM s WHERE key NOT IN (SELECT key FROM n)""")
def preference_write(spark, d):
    """Settings put as JSON over those that are there."""
    log = views.table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("props").alias("value"), "ts", "event_id")
    value = lambda k, n: F.struct(k.cast("long").alias("key"), n.alias("name")).alias("value")
    new = views.table(spark, d, "nation").select(F.col("n_name").alias("key"), value(F.col("n_nationkey"), F.col("n_name")))
    new = new.unionByName(spark.range(1).select(F.lit("error").alias("key"), value(F.lit(-1), F.lit("over"))))
    return store.put(store.latest(log, "ts", "event_id"), new)


# ---------------------------------------------------------------- PDF
CREATED = "D:20240131120000+01'00'"


@functools.lru_cache(maxsize=1)
def sheet() -> bytes:
    """A JPEG file of 100 by 140 pixels."""
    x, y = np.meshgrid(np.arange(100), np.arange(140))
    return codec.jpeg(np.repeat(((x + y) % 256)[..., None], 3, axis=2).astype(np.uint8))


def _documents(spark, d):
    """One document of each conversation, a page a turn, its words unseen on the page."""
    p = views.page_list(spark, d).select("session", "ord", F.lit(sheet()).alias("jpeg"), F.lit(100).alias("w"), F.lit(140).alias("h"), F.split("text", " ").alias("ws"))
    x, y = (lambda i: ((i % 10) * 10).cast("double")), (lambda i: (F.floor(i / 10) * 2).cast("double"))
    words = F.transform("ws", lambda t, i: F.struct(t.alias("text"), x(i).alias("x0"), y(i).alias("y0"), (x(i) + 8).alias("x1"), (y(i) + 1.6).alias("y1")))
    return pdf.build_documents(p.withColumn("words", words).drop("ws"), "session", created=CREATED)


_MARKS, _CODES = ("".join(map(chr, x)) for x in (pdf.WIN_ANSI, pdf.WIN_ANSI.values()))
_SIDE = "/Type /XObject /Subtype /Image /Width 100 /Height 140 /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /DCTDecode "
OBJECTS = rf"""pg AS (SELECT session, ord, row_number() OVER (PARTITION BY session ORDER BY ord) - 1 AS k, text
  FROM (SELECT conv_id AS session, turn AS ord, text FROM conversations)),
 box AS (SELECT 841.89::DOUBLE * 100 / 140 AS pw, 841.89::DOUBLE AS ph),
  fitted AS (SELECT *, least(pw / 100, ph / 140) AS f FROM box),
  lay AS (SELECT pw, ph, 100 * f AS dw, 140 * f AS dh, (pw - 100 * f) / 2 AS ox, (ph - 140 * f) / 2 AS oy FROM fitted),
 w0 AS (SELECT session, k, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS i
  FROM pg WHERE text IS NOT NULL),
 w1 AS (SELECT session, k, i, regexp_replace(word, '^\s+|\s+$', '', 'g') AS word, (i % 10 * 10)::DOUBLE AS x0,
  (i // 10 * 2)::DOUBLE AS y0, (i % 10 * 10)::DOUBLE + 8 AS x1, (i // 10 * 2)::DOUBLE + 1.6::DOUBLE AS y1 FROM w0),
 w2 AS (SELECT *, (x1 - x0) * dw / 100 AS bw, (y1 - y0) * dh / 140 AS bh FROM w1, lay WHERE word <> ''),
  w3 AS (SELECT *, least(bh * 0.92::DOUBLE, 200.0::DOUBLE) AS font FROM w2),
 w4 AS (SELECT *, list_sum(list_transform(string_split(word, ''), lambda c: CASE WHEN unicode(c) BETWEEN 32 AND 126
  THEN ([{WIDTHS}])[unicode(c) - 31] ELSE 500 END)) * font / 1000 AS nat,
  '(' || regexp_replace(regexp_replace(translate(regexp_replace(word, '[^\x00-\xff{_MARKS}]', '?', 'g'), '{_MARKS}',
  '{_CODES}'), '[\x00-\x1f]', ' ', 'g'), '([()\\])', '\\\1', 'g') || ')' AS lit FROM w3),
 drawn AS (SELECT session, k, sum(length('/F1 ' || printf('%.2f', font) || ' Tf.' || printf('%.1f',
  greatest(1.0::DOUBLE, least(3000.0::DOUBLE, 100 * bw / nat))) || ' Tz.1 0 0 1 ' || printf('%.2f',
  ox + x0 * dw / 100) || ' ' || printf('%.2f',
  oy + dh - y1 * dh / 140 + 0.16::DOUBLE * font) || ' Tm.' || lit || ' Tj.'))::BIGINT AS n FROM w4 GROUP BY 1, 2),
 content AS (SELECT session, k, length('q.' || printf('%.2f', dw) || ' 0 0 ' || printf('%.2f',
  dh) || ' ' || printf('%.2f', ox) || ' ' || printf('%.2f', oy) || ' cm./Im0 Do.Q.') + CASE WHEN text IS NULL THEN 0
  ELSE 8 + 3 + coalesce(n, 0) END AS n FROM pg LEFT JOIN drawn USING (session, k), lay),
 total AS (SELECT session, count(*) AS n FROM pg GROUP BY 1),
 body AS (SELECT session, 1 AS object, length('<< /Type /Catalog /Pages 2 0 R >>') AS n FROM total UNION ALL
  SELECT session, 2, length('<< /Type /Pages /Count ' || n || ' /Kids [' || array_to_string(list_transform(range(n),
  lambda i: (5 + 3 * i) || ' 0 R'), ' ') || '] >>') FROM total UNION ALL
  SELECT session, 3, length('<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>') FROM total UNION ALL
  SELECT session, 4, length('<< /Producer ({pdf.PRODUCER}) /Title (Scan) /CreationDate ({CREATED.replace("'", "''")}) >>')
  FROM total UNION ALL
  SELECT session, 5 + 3 * k, length('<< /Type /Page /Parent 2 0 R /MediaBox [0 0 ' || printf('%.2f',
  pw) || ' ' || printf('%.2f', ph) || '] /Resources << /XObject << /Im0 ' || (7 + 3 * k) ||
  ' 0 R >> /Font << /F1 3 0 R >> >> /Contents ' || (6 + 3 * k) || ' 0 R >>') FROM pg, lay UNION ALL
  SELECT session, 6 + 3 * k, length('<< /Length ' || n || ' >>.stream.') + n + length('.endstream') FROM content UNION ALL
  SELECT session, 7 + 3 * k, length('<< {_SIDE}/Length {{n}} >>.stream.') + {{n}} + length('.endstream') FROM pg),
 sized AS (SELECT session, object, (length(object || ' 0 obj.') + n + length('.endobj.'))::BIGINT AS n FROM body)"""


def _objects() -> str:
    return OBJECTS.replace("{n}", str(len(sheet())))


@query(f"""WITH {_objects()}, s AS (SELECT session, 15 + sum(n) AS table_at, count(*) + 1 AS size FROM sized GROUP BY 1)
 SELECT session, (size - 5) // 3 AS n_pages,
  (table_at + length('xref.0 ' || size || '.') + 20 * size + length('trailer.<< /Size ' || size ||
  ' /Root 1 0 R /Info 4 0 R >>.startxref.' || table_at || '.%%EOF.'))::BIGINT AS n_bytes FROM s""")
def pdf_build(spark, d):
    return _documents(spark, d).select("session", "n_pages", F.octet_length("pdf").cast("long").alias("n_bytes"))


@query(f"""WITH {_objects()} SELECT session, object::BIGINT AS object,
  (15 + coalesce(sum(n) OVER (PARTITION BY session ORDER BY object ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  0))::BIGINT AS at, true AS found FROM sized""")
def xref_offsets(spark, d):
    """Where the xref table of each document says its objects are; found: they do begin there."""
    return pdf.objects(_documents(spark, d), "session")


@query("""WITH e AS (SELECT event_id, ts, (event_id % 49 - 24) * 30 AS away FROM events)
 SELECT event_id, 'D:' || strftime(ts, '%Y%m%d%H%M%S') || CASE WHEN away >= 0 THEN '+'
  ELSE '-' END || printf('%02d', abs(away) // 60) || '''' || printf('%02d', abs(away) % 60) || '''' AS created FROM e""")
def pdf_date(spark, d):
    e = views.table(spark, d, "events")
    return e.select("event_id", pdf.date_text(F.col("ts"), (F.col("event_id") % 49 - 24) * 30).alias("created"))


@query("""SELECT doc_id, coalesce(sum(unicode(c) & 255), 0)::BIGINT AS total
  FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY 1""")
def latin1(spark, d):
    """The low bytes of whole texts, summed; the tables have no character beyond 16 bits."""

    @F.pandas_udf("long")
    def total(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sum(pdf.low_bytes(t)))

    return views.table(spark, d, "documents").filter("text <> ''").select("doc_id", total("text").alias("total"))


# ---------------------------------------------------------------- chains
def _pages(spark, d):
    """Rasters as pages of seven sessions, read at 16 pixels a side."""
    p = packed(spark, d).withColumns({"session": F.col("image_id") % 7, "ord": F.expr("cast(image_id div 7 as int)"), "corners": no_corners(), "settings": as_map(preset("original"))})
    word = lambda t, x: F.struct(F.lit(t).alias("text"), F.lit(90.0).alias("conf"), x.alias("x0"), F.lit(2.0).alias("y0"), (x + 4).alias("x1"), F.lit(6.0).alias("y1"))
    x = (F.col("image_id") % 10).cast("double")
    ocr = F.struct(F.array(word("one", x), word(" ", x), word("two", x + 1)).alias("words"), F.lit(16).alias("imgW"), F.lit(16).alias("imgH"))
    return p.withColumn("ocr", F.when(F.col("image_id") % 3 < 2, ocr))


@query("""WITH p AS (SELECT vec_id AS image_id, vec_id % 7 AS session, vec_id // 7 AS ord, vec_id % 3 < 2 AS read FROM embeddings),
 f AS (SELECT session, min(ord) FILTER (read) AS ord FROM p GROUP BY 1)
 SELECT p.session, count(*)::BIGINT AS n_pages, (4 + 3 * count(*))::BIGINT AS n_objects, (2 * count(*) FILTER (read))::BIGINT AS n_words,
  any_value(printf('%.2f', (f.ord * 7 + p.session) % 10 * (8 / 16.0::DOUBLE) * (841.89::DOUBLE / 8 * 8) / 8)) AS
  first_x FROM p JOIN f USING (session) GROUP BY 1""")
def pdf_export(spark, d):
    """Pages rendered, encoded, with their words moved to the rendering, bound into one document a session."""
    out = export.export_pdf(_pages(spark, d), created=CREATED)
    body = F.decode("pdf", "ISO-8859-1")
    return out.select("session", "n_pages", F.regexp_count(body, F.lit(r"\n\d+ 0 obj\n")).cast("long").alias("n_objects"), F.regexp_count(body, F.lit(r"\) Tj\n")).cast("long").alias("n_words"), F.regexp_extract(body, r"Tz\n1 0 0 1 (\S+) \S+ Tm", 1).alias("first_x"))


def measuring(body: bytes, lang: str, psm: int) -> dict:
    """Stands in for a recogniser: it tells size and brightness, and fails on dark images."""
    px = codec.unpng(body)
    if px.mean() < 120:
        raise ValueError("too dark")
    return {"text": f"{px.shape[1]}x{px.shape[0]}\n\n\n\n{lang} {psm}  ", "confidence": float(px.mean()), "words": [{"text": "all", "conf": 1.0, "x0": 0.0, "y0": 0.0, "x1": float(px.shape[1]), "y1": float(px.shape[0])}]}


@query(f"""WITH {RASTER}, m AS (SELECT image_id, avg(v) AS mean FROM raster GROUP BY 1)
 SELECT image_id, CASE WHEN mean < 120 THEN '' ELSE '8x8' || chr(10) || chr(10) || 'deu 6' END AS text,
  mean < 120 AS failed, CASE WHEN mean < 120 THEN 'too dark' END AS error, CASE WHEN mean < 120 THEN 0
  ELSE 1 END::BIGINT AS n_words, 'deu' AS lang, 8::BIGINT AS img_w, 8::BIGINT AS img_h FROM m""")
def ocr_chain(spark, d):
    """Every page rendered for reading and read; a failure stays with its page."""
    out = export.recognised(_pages(spark, d), measuring, "deu", 6)
    o = F.col("ocr")
    return out.select(F.col("id").cast("long").alias("image_id"), o["text"].alias("text"), o["error"].isNotNull().alias("failed"), o["error"].alias("error"), F.size(o["words"]).cast("long").alias("n_words"), o["lang"].alias("lang"), o["imgW"].cast("long").alias("img_w"), o["imgH"].cast("long").alias("img_h"))


@query(f"""WITH {PAGES} SELECT id, CASE WHEN ord % 2 = 0 THEN 'typed' ELSE CASE WHEN ord % 3 = 0
  THEN text END END AS text, CASE WHEN ord % 3 = 0 THEN 16 WHEN ord % 2 = 0 THEN 1 END::BIGINT AS img_w, CASE
  WHEN ord % 3 = 0 THEN 1 WHEN ord % 2 = 0 THEN 0 END::BIGINT AS n_words, CASE WHEN ord % 3 = 0
  THEN 88.0::DOUBLE END AS confidence FROM pages_""")
def edit_text(spark, d):
    """Text typed over what was recognised, also on pages that were never read."""
    word = F.struct(F.lit("w").alias("text"), *[F.lit(1.0).alias(k) for k in ("conf", "x0", "y0", "x1", "y1")])
    ocr = F.struct(F.col("text"), F.lit(88.0).alias("confidence"), F.array(word).alias("words"), F.lit(16).alias("imgW"), F.lit(16).alias("imgH"))
    p = views.page_list(spark, d).withColumn("ocr", F.when(F.col("ord") % 3 == 0, ocr))
    out = text.edited(p, F.when(F.col("ord") % 2 == 0, "typed"))
    return out.select("id", "ocr.text", F.col("ocr.imgW").cast("long").alias("img_w"), F.when(F.col("ocr").isNotNull(), F.size("ocr.words")).cast("long").alias("n_words"), "ocr.confidence")


@query(f"WITH {PAGES} SELECT session, 'scan-20240131-120000-p' || (ord + 1) || '.txt' AS name, text AS body FROM pages_ WHERE text <> ''")
def page_texts(spark, d):
    p = views.page_list(spark, d)
    stamp = F.lit("2024-01-31 12:00:00").cast("timestamp")
    out = pages.page_texts(p.withColumn("ord", F.col("ord") + F.col("session") * 10_000), stamp)  # a name tells its session here
    n = F.regexp_extract("name", r"p(\d+)\.", 1).cast("long") - 1
    return out.select(F.floor(n / 10_000).alias("session"), F.concat(F.lit("scan-20240131-120000-p"), (n % 10_000 + 1).cast("string"), F.lit(".txt")).alias("name"), F.decode("body", "utf-8").alias("body"))


@query("SELECT * FROM (VALUES " + ", ".join(f"({m}, {k == 0})" for k, m in enumerate(text.SEGMENTATION)) + ") AS t(mode, is_default)")
def segmentation_modes(spark, d):
    return text.segmentation_table(spark)


@query(f"WITH {RASTER} SELECT image_id, 8::BIGINT AS w, 8::BIGINT AS h, sum(v)::BIGINT * 3 AS light FROM raster GROUP BY 1")
def image_import(spark, d):
    """Rasters written as files, and read back as the images of a folder; what is no image is left out."""
    import uuid

    held = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{held.rstrip('/')}/import-{uuid.uuid4().hex}"
    files = images.encode(packed(spark, d), "png").select("id", "file")
    images.write_folder(files.unionByName(spark.range(1).select(F.lit("none").alias("id"), F.lit(b"no image").alias("file"))), path)
    found = images.read_images(spark, path)
    one = found.select(F.regexp_extract("id", "name=(\\d+)", 1).cast("long").alias("image_id"), "w", "h", F.explode(F.sequence(F.lit(0), F.length("data") - 1)).alias("p"), "data")
    light = F.sum(F.conv(F.hex(F.substring(F.col("data"), F.col("p") + 1, F.lit(1))), 16, 10).cast("long"))
    return one.groupBy("image_id", "w", "h").agg(light.alias("light")).select("image_id", F.col("w").cast("long").alias("w"), F.col("h").cast("long").alias("h"), "light")


# ---------------------------------------------------------------- figures
@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -value ELSE value / CASE WHEN event_id % 3 = 1
  THEN 1000 ELSE 1 END END AS v FROM events), a AS (SELECT *, abs(v) AS a FROM e)
 SELECT event_id, CASE WHEN v < 0 THEN '-' ELSE '' END || CASE WHEN a >= 100 THEN printf('%.0f', floor(a + 0.5))
  WHEN a >= 1 THEN printf('%.1f', floor(a * 10 + 0.5) / 10) ELSE printf('%.3f', floor(a * 1000 + 0.5) / 1000) END AS shown FROM a""")
def short_number(spark, d):
    e = views.table(spark, d, "events")
    v = F.when(F.col("event_id") % 3 == 0, -F.col("value")).otherwise(F.col("value") / F.when(F.col("event_id") % 3 == 1, 1000).otherwise(1))
    return e.select("event_id", pages.short_number(v).alias("shown"))


@query("SELECT event_id, left(md5(event_id::VARCHAR), 5) AS salt, epoch_us(ts) // 1000 AS millis FROM events")
def page_ids(spark, d):
    """The parts of page ids, read back from them."""
    i = views.table(spark, d, "events").select("event_id", pages.page_id(F.col("ts").cast("timestamp"), F.col("event_id")).alias("id"))
    return i.select("event_id", F.right("id", F.lit(5)).alias("salt"), F.conv(F.expr("substring(id, 2, length(id) - 6)"), 36, 10).cast("long").alias("millis"))


# ---------------------------------------------------------------- devices
@query("SELECT s_suppkey AS device FROM supplier WHERE s_suppkey % 3 = 1")
def list_devices(spark, d):
    kind = F.element_at(F.array(F.lit("audioinput"), F.lit("videoinput"), F.lit("audiooutput")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return capture.video_devices(views.table(spark, d, "supplier").select(F.col("s_suppkey").alias("device"), kind.alias("kind"))).select("device")


@query("""WITH dev AS (SELECT s_suppkey AS device, 640 + s_suppkey % 5 * 600 AS start_w,
  1920 + s_suppkey % 7 * 500 AS max_w, 1080 + s_suppkey % 7 * 400 AS max_h FROM supplier),
 r AS (SELECT device, start_w, 0 AS rung, max_w AS w, max_h AS h FROM dev UNION ALL SELECT device, start_w, 1, 3840,
  2160 FROM dev UNION ALL SELECT device, start_w, 2, 2560, 1440 FROM dev),
 a AS (SELECT *, CASE WHEN (device + rung) % 4 > 0 THEN least(w, 1500 + device % 9 * 400) END AS got_w,
  (device + rung) % 3 > 0 AS renders FROM r WHERE w > start_w)
 SELECT device, min(rung)::BIGINT AS rung, arg_min(w, rung)::BIGINT AS w, arg_min(h, rung)::BIGINT AS h,
  arg_min(got_w, rung)::BIGINT AS got_w FROM a WHERE got_w > start_w AND renders GROUP BY 1""")
def raise_stream(spark, d):
    k = F.col("s_suppkey")
    dev = views.table(spark, d, "supplier").select(k.alias("device"), (640 + k % 5 * 600).alias("start_w"), (1920 + k % 7 * 500).cast("int").alias("max_w"), (1080 + k % 7 * 400).cast("int").alias("max_h"))
    a = capture.ladder(dev)
    got = F.when((F.col("device") + F.col("rung")) % 4 > 0, F.least(F.col("w").cast("long"), 1500 + F.col("device") % 9 * 400))
    out = capture.raised_mode(a.withColumn("got_w", got).withColumn("renders", (F.col("device") + F.col("rung")) % 3 > 0))
    return out.select("device", *[F.col(c).cast("long").alias(c) for c in ("rung", "w", "h", "got_w")])


_KEYS = [c[0] for c in capture.CONTROLS] + ["unknown"]
RAW = f"""raw AS (SELECT s_suppkey AS device, ([{', '.join(f"'{k}'" for k in _KEYS)}])[s_suppkey % 15 + 1] AS key, CASE
  WHEN s_suppkey % 4 > 0 THEN (s_suppkey % 3)::DOUBLE END AS low, (s_suppkey % 5 * 2)::DOUBLE AS high,
 CASE WHEN s_suppkey % 2 = 0 THEN 0.5::DOUBLE END AS step, CASE s_suppkey % 4 WHEN 0 THEN ['manual', 'continuous']
  WHEN 1 THEN ['false', 'true'] WHEN 2 THEN ['none'] END AS options, CASE WHEN s_suppkey % 3 = 0 THEN 'true' END AS value FROM supplier)"""


def _raw(spark, d):
    k = F.col("s_suppkey")
    few = lambda *v: F.array(*[F.lit(x) for x in v])
    return views.table(spark, d, "supplier").select(
        k.alias("device"), F.element_at(few(*_KEYS), (k % 15 + 1).cast("int")).alias("key"), F.when(k % 4 > 0, (k % 3).cast("double")).alias("low"), (k % 5 * 2).cast("double").alias("high"),
        F.when(k % 2 == 0, F.lit(0.5)).alias("step"), F.when(k % 4 == 0, few("manual", "continuous")).when(k % 4 == 1, few("false", "true")).when(k % 4 == 2, few("none")).alias("options"), F.when(k % 3 == 0, "true").alias("value"),
    )


_SPEC = ", ".join(f"({i}, '{k}', '{label}', '{kind}', {capture.NEEDS_MANUAL.get(k) and repr(capture.NEEDS_MANUAL[k]) or 'NULL'})" for i, (k, label, kind) in enumerate(capture.CONTROLS))


@query(f"""WITH {RAW}, spec(place, key, label, kind, needs) AS (VALUES {_SPEC})
 SELECT device, place::BIGINT AS place, key, label, kind, CASE WHEN kind = 'range' THEN low END AS low, CASE
  WHEN kind = 'range' THEN high END AS high, CASE WHEN kind = 'range' THEN coalesce(step, (high - low) / 100) END AS step,
  CASE kind WHEN 'range' THEN coalesce(value, low::VARCHAR) WHEN 'bool' THEN CASE WHEN value = 'true' THEN 'true'
  ELSE 'false' END ELSE value END AS value, CASE WHEN kind = 'enum' THEN array_to_string(options, '|') END AS options, needs
 FROM raw JOIN spec USING (key) WHERE CASE kind WHEN 'range' THEN low IS NOT NULL AND low <> high WHEN 'enum'
  THEN coalesce(len(options), 0) >= 2 ELSE coalesce(list_contains(options, 'true'), false) END""")
def capabilities(spark, d):
    out = capture.capabilities(_raw(spark, d))
    return out.withColumns({"options": F.concat_ws("|", "options"), "place": F.col("place").cast("long")}).withColumn("options", F.when(F.col("kind") == "enum", F.col("options")))


@query(f"""WITH {RAW}, n AS (SELECT *, CASE key {' '.join(f"WHEN '{k}' THEN '{m}'" for k, m in capture.NEEDS_MANUAL.items())}
  END AS mode FROM raw)
 SELECT device, CASE WHEN mode IS NOT NULL AND coalesce(list_contains(options, 'manual'), false) AND device % 5 > 0
  THEN mode || '=manual,' || key ELSE key END AS steps,
  CASE WHEN list_contains(options, 'continuous') THEN CASE WHEN list_contains(options, 'manual')
  THEN 'manual,continuous' ELSE 'continuous' END END AS refocus FROM n""")
def control_steps(spark, d):
    """What to set to change a control, and to focus again."""
    now = F.when(F.col("device") % 5 == 0, "manual").otherwise("continuous")
    r = _raw(spark, d)
    again = capture.refocus_steps(F.col("options"))
    return r.select("device", F.concat_ws(",", capture.control_steps(F.col("key"), F.col("options"), now)).alias("steps"), F.when(again.isNotNull(), F.concat_ws(",", again)).alias("refocus"))


_LEVEL = "least(255.0::DOUBLE, greatest(0.0::DOUBLE, 80 + device % 100 + (20 + device % 7) * {v}))"


@query(f"""WITH RECURSIVE dev AS (SELECT s_suppkey AS device FROM supplier),
 e(device, k, low, high, value, level, going) AS (SELECT device, 0, -4.0::DOUBLE, 4.0::DOUBLE, 0.0::DOUBLE,
  {_LEVEL.format(v='0.0::DOUBLE')}, true FROM dev UNION ALL
  SELECT device, k + 1, low2, high2, CASE WHEN stop THEN value ELSE mid END, CASE WHEN stop THEN level
  ELSE {_LEVEL.format(v='mid')} END, NOT stop FROM
   (SELECT *, (low2 + high2) / 2 AS mid, abs((low2 + high2) / 2 - value) < 0.05 AS stop
  FROM (SELECT *, CASE WHEN level < 205 THEN value ELSE low END AS low2, CASE WHEN level < 205 THEN high
  ELSE value END AS high2 FROM e WHERE going AND k < 7 AND abs(level - 205) > 7)))
 SELECT device, round(arg_max(value, k), 9) AS value, round(arg_max(level, k), 6) AS level,
  arg_max(abs(level - 205) <= 14, k) AS settled FROM e GROUP BY 1""")
def auto_expose(spark, d):
    """Exposure brought near its target on made-up cameras whose brightness follows the control."""

    def settle(devices: pd.Series) -> pd.DataFrame:
        knob, rows = {"min": -4.0, "max": 4.0, "step": 0.1, "value": 0.0}, []
        for n in devices:
            rows.append(capture.auto_expose(knob, lambda v: min(255.0, max(0.0, 80 + n % 100 + (20 + n % 7) * v))))  # noqa: B023
        return pd.DataFrame(rows, columns=["value", "level", "settled"])

    found = F.pandas_udf(settle, "value double, level double, settled boolean")
    s = views.table(spark, d, "supplier").select(F.col("s_suppkey").alias("device"), found("s_suppkey").alias("r"))
    return s.select("device", F.round("r.value", 9).alias("value"), F.round("r.level", 6).alias("level"), "r.settled")
