"""Searchable PDF pages: layout as columns, documents as bytes."""

from __future__ import annotations

from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Page sizes in points.
SIZES = {"a4": (595.28, 841.89), "letter": (612.0, 792.0)}
LONG = 841.89
#: Helvetica advance widths, /1000 em, for characters 32 to 126; 500 for others.
HELVETICA = [
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278,
    556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778,
    667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556,
    556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
]
#: Characters beyond Latin-1 that the WinAnsi encoding has.
WIN_ANSI = {0x2018: 0x91, 0x2019: 0x92, 0x201C: 0x93, 0x201D: 0x94, 0x2022: 0x95, 0x2013: 0x96, 0x2014: 0x97, 0x2026: 0x85, 0x20AC: 0x80, 0x2122: 0x99}
PRODUCER = "folioscope"


# ---------------------------------------------------------------- columns
def _units() -> np.ndarray:
    out = np.full(1 << 16, 500, dtype=np.int64)
    out[32:127] = HELVETICA
    return out


def text_width(text: Column, size: Column) -> Column:
    """The natural width of a text: one look-up a UTF-16 unit, over all texts of a batch at once."""

    @F.pandas_udf("long")
    def total(texts: pd.Series) -> pd.Series:
        raw = [t.encode("utf-16-le", "surrogatepass") if t is not None else b"" for t in texts]
        ends = np.cumsum([len(r) // 2 for r in raw], dtype=np.int64)
        acc = np.concatenate([[0], np.cumsum(_units()[np.frombuffer(b"".join(raw), dtype="<u2")])])
        return pd.Series(np.diff(acc[np.concatenate([[0], ends]).astype(np.int64)])).mask(texts.isna().to_numpy())

    return total(text) * size / 1000


def date_text(stamp: Column, offset_minutes: Column) -> Column:
    """A PDF date: local time with the zone's distance from universal time."""
    away = F.abs(offset_minutes)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    zone = F.concat(F.when(offset_minutes >= 0, "+").otherwise("-"), two(F.floor(away / 60)), F.lit("'"), two(away % 60), F.lit("'"))
    return F.concat(F.lit("D:"), F.date_format(stamp, "yyyyMMddHHmmss"), zone)


def literal_text(text: Column) -> Column:
    """literal() as a column of characters below 256: one for each byte."""
    t = F.regexp_replace(text, r"[\x{10000}-\x{10FFFF}]", "??")
    t = F.regexp_replace(t, "[^\u0000-\u00ff" + "".join(map(chr, WIN_ANSI)) + "]", "?")
    t = F.regexp_replace(F.translate(t, "".join(map(chr, WIN_ANSI)), "".join(map(chr, WIN_ANSI.values()))), r"[\x00-\x1f]", " ")
    return F.concat(F.lit("("), F.regexp_replace(t, r"([()\\])", r"\\$1"), F.lit(")"))


def page_box(w: Column, h: Column, size: str) -> tuple[Column, Column]:
    """The page in points: a paper size turned to the image, or the image at A4's long edge."""
    if size in SIZES:
        short, long = SIZES[size]
        return F.when(w > h, F.lit(long)).otherwise(F.lit(short)), F.when(w > h, F.lit(short)).otherwise(F.lit(long))
    return F.when(w >= h, F.lit(LONG)).otherwise(F.lit(LONG) * w / h), F.when(w >= h, F.lit(LONG) * h / w).otherwise(F.lit(LONG))


def placement(w: Column, h: Column, pw: Column, ph: Column) -> dict[str, Column]:
    """Where the image lies on the page: as large as fits, in the middle."""
    k = F.least(pw / w, ph / h)
    return {"dw": w * k, "dh": h * k, "ox": (pw - w * k) / 2, "oy": (ph - h * k) / 2}


def text_layer(words: DataFrame) -> DataFrame:
    """Words (word, x0..y1) on pages (w, h, dw, dh, ox, oy): font size, stretch and place of
    each; blank words and tiny boxes go."""
    bw, bh = (F.col("x1") - F.col("x0")) * (F.col("dw") / F.col("w")), (F.col("y1") - F.col("y0")) * (F.col("dh") / F.col("h"))
    t = words.withColumns({"word": F.trim("word"), "bw": bw, "bh": bh}).filter((F.col("word") != "") & (F.col("bw") > 0.3) & (F.col("bh") > 0.3))
    t = t.withColumn("size", F.least(F.col("bh") * 0.92, F.lit(200.0))).withColumn("natural", text_width(F.col("word"), F.col("size")))  # above 0, as every character is wide
    return t.withColumns({
        "stretch": F.greatest(F.lit(1.0), F.least(F.lit(3000.0), F.col("bw") / F.col("natural") * 100)),
        "tx": F.col("ox") + F.col("x0") * (F.col("dw") / F.col("w")),
        "ty": F.col("oy") + F.col("dh") - F.col("y1") * (F.col("dh") / F.col("h")) + F.col("size") * 0.16,
    })


# ---------------------------------------------------------------- bytes
def literal(text: str) -> bytes:
    """A PDF string: WinAnsi bytes, `?` for what it lacks, brackets and backslashes escaped."""
    out = bytearray(b"(")
    for c in text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace"):
        for unit in [ord(c)] if ord(c) < 0x10000 else [0x3F, 0x3F]:  # a pair of UTF-16 units gives two marks
            unit = WIN_ANSI.get(unit, unit)
            byte = 0x3F if unit > 255 else 0x20 if unit < 32 else unit
            out += b"\\" * (byte in b"()\\") + bytes([byte])
    return bytes(out + b")")


def low_bytes(text: str) -> bytes:
    """The low byte of every UTF-16 unit."""
    return text.encode("utf-16-le", "surrogatepass")[::2]


def created_now(now: datetime | None = None) -> str:
    """The PDF date of now, or of a time with a zone."""
    now = now or datetime.now().astimezone()
    minutes = int((now.utcoffset().total_seconds() if now.utcoffset() else 0) // 60)
    return f"D:{now:%Y%m%d%H%M%S}{'+' if minutes >= 0 else '-'}{abs(minutes) // 60:02d}'{abs(minutes) % 60:02d}'"


def natural_width(text: str, size: float) -> float:
    units = len(text.encode("utf-16-le", "surrogatepass")) // 2
    plain = [HELVETICA[ord(c) - 32] for c in text if 32 <= ord(c) <= 126]
    return (sum(plain) + 500 * (units - len(plain))) * size / 1000


def layout(w: int, h: int, size: str) -> tuple[float, float, float, float, float, float]:
    if size in SIZES:
        pw, ph = SIZES[size] if w <= h else SIZES[size][::-1]
    else:
        pw, ph = (LONG, LONG * h / w) if w >= h else (LONG * w / h, LONG)
    k = min(pw / w, ph / h)
    return pw, ph, w * k, h * k, (pw - w * k) / 2, (ph - h * k) / 2


def content(w: int, h: int, size: str, words: list[dict]) -> bytes:
    """The drawing of one page: its image, and its words unseen on top."""
    _, _, dw, dh, ox, oy = layout(w, h, size)
    out = [b"q\n%.2f 0 0 %.2f %.2f %.2f cm\n/Im0 Do\nQ\n" % (dw, dh, ox, oy)]
    if words:
        out.append(b"BT\n3 Tr\n")
        for x in words:
            text, bw, bh = (x["text"] or "").strip(), (x["x1"] - x["x0"]) * dw / w, (x["y1"] - x["y0"]) * dh / h
            font = min(bh * 0.92, 200)
            natural = natural_width(text, font)
            if text and bw > 0.3 and bh > 0.3 and natural > 0:
                out.append(b"/F1 %.2f Tf\n%.1f Tz\n1 0 0 1 %.2f %.2f Tm\n" % (font, max(1, min(3000, 100 * bw / natural)), ox + x["x0"] * dw / w, oy + dh - x["y1"] * dh / h + 0.16 * font) + literal(text) + b" Tj\n")
        out.append(b"ET\n")
    return b"".join(out)


def build(pages: list[dict], size: str = "auto", title: str = "Scan", created: str | None = None, searchable: bool = True) -> bytes:
    """A PDF 1.4 of pages {jpeg, w, h, words}, created now unless said otherwise."""
    created = created or created_now()
    stream = lambda head, body: b"<< " + head + b"/Length %d >>\nstream\n" % len(body) + body + b"\nendstream"
    kids = b" ".join(b"%d 0 R" % (5 + 3 * i) for i in range(len(pages)))
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Count %d /Kids [" % len(pages) + kids + b"] >>",
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>",
        b"<< /Producer " + literal(PRODUCER) + b" /Title " + literal(title) + b" /CreationDate " + literal(created) + b" >>",
    ]
    for i, p in enumerate(pages):
        n = 5 + 3 * i
        pw, ph = layout(p["w"], p["h"], size)[:2]
        objects += [
            b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %.2f %.2f] /Resources << /XObject << /Im0 %d 0 R >> /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (pw, ph, n + 2, n + 1),
            stream(b"", content(p["w"], p["h"], size, p.get("words") or [] if searchable else [])),
            stream(b"/Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /DCTDecode " % (p["w"], p["h"]), p["jpeg"]),
        ]
    out, places = bytearray(b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n"), []
    for n, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    at = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R /Info 4 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, at))


def build_documents(pages: DataFrame, key: str, size: str = "auto", title: str = "Scan", created: str | None = None, searchable: bool = True) -> DataFrame:
    """One PDF for each key of pages (key, ord, jpeg, w, h, words): a document is one file,
    so its pages meet in one task."""
    created = created or created_now()  # one date for all, also of tasks that run again

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        rows = [{"jpeg": r.jpeg, "w": r.w, "h": r.h, "words": [dict(x) if isinstance(x, dict) else x.asDict() for x in (r.words if r.words is not None else [])]} for r in pdf.itertuples()]
        return pd.DataFrame({key: [pdf[key].iloc[0]], "n_pages": [len(rows)], "pdf": [build(rows, size, title, created, searchable)]})

    kind = dict(pages.dtypes)[key]
    return pages.groupBy(key).applyInPandas(run, f"{key} {kind}, n_pages long, pdf binary")


def offsets(objects: DataFrame, key: str, order: str, body: str) -> DataFrame:
    """Byte offsets of objects laid one after another, as columns."""
    size = F.octet_length(body)
    return objects.withColumn("at", F.coalesce(F.sum(size).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


def objects(documents: DataFrame, key: str) -> DataFrame:
    """(key, object, at, found): what the xref table of each PDF says of its objects, and
    whether an object of that number begins there."""

    @F.pandas_udf("array<struct<object:long,at:long,found:boolean>>")
    def read(files: pd.Series) -> pd.Series:
        out = []
        for body in files:
            start = int(body[body.rindex(b"startxref") + 9 :].split()[0])
            rows = body[start:].split(b"\n")
            places = [int(r[:10]) for r in rows[3 : 2 + int(rows[1].split()[1])]]
            out.append([{"object": n, "at": p, "found": body[p:].startswith(b"%d 0 obj" % n)} for n, p in enumerate(places, 1)])
        return pd.Series(out)

    return documents.select(key, F.explode(read("pdf")).alias("o")).select(key, "o.object", "o.at", "o.found")
