"""PDF structure, streams against batches, sources and sinks, and the pipeline over Spark."""

import os
import re
import struct
import zlib

import numpy as np
import pandas as pd
import pytest

from folioscope.operators import detect, pdf, raster, settings, text
from folioscope.plans.registry import QUERIES
from folioscope.sources import camera, codec, images
from folioscope.streaming import capture


def pages():
    words = [{"text": t, "x0": 50.0, "y0": 50.0 + 40 * i, "x1": 250.0, "y1": 80.0 + 40 * i} for i, t in enumerate(("Hello", "world (2)", "småll", "  ", "“x”…\\"))]
    return [{"jpeg": b"\xff\xd8one\xff\xd9", "w": 600, "h": 800, "words": words}, {"jpeg": b"\xff\xd8two\xff\xd9", "w": 800, "h": 600, "words": []}]


def test_pdf_strings_of_whole_texts(spark, tmp_path):
    """A registered query gives every text whole, as pdf.literal() does."""
    rows = [(1, None), (2, ""), (3, "short\n\x00 (one)"), (4, "x" * 61 + "—é日\\)"), (5, "tail e “q” \U0001f600\t" * 400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.literal for r in QUERIES["pdf_string"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else pdf.literal(t.replace("e", "(\\") + "—€\t日\U0001f600").decode("latin-1") for i, t in rows}


def test_pdf_offsets_and_content():
    out = pdf.build(pages(), "a4")
    at = int(re.search(rb"startxref\n(\d+)", out)[1])
    rows = out[at:].split(b"\n")
    assert rows[0] == b"xref" and rows[1] == b"0 11"
    for n, row in enumerate(rows[3:13], 1):
        assert out[int(row[:10]) :].startswith(b"%d 0 obj" % n)
    assert out.startswith(b"%PDF-1.4") and out.endswith(b"%%EOF\n")
    assert rb"(world \(2\)) Tj" in out and "(småll) Tj".encode("latin-1") in out and b"(\x93x\x94\x85\\\\) Tj" in out
    assert out.count(b" Tj\n") == 4 and b"3 Tr" in out
    assert b"/MediaBox [0 0 595.28 841.89]" in out and b"/MediaBox [0 0 841.89 595.28]" in out
    for m in re.finditer(rb"/Length (\d+) >>\nstream\n", out):
        assert out[m.end() + int(m[1]) :].startswith(b"\nendstream")
    assert b"Tj" not in pdf.build(pages(), "a4", searchable=False)


def test_pdf_widths_agree(spark):
    texts = ["Hello", "a b", "", "é日", "WWW..."]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    from pyspark.sql import functions as F

    got = [r.w for r in df.select(pdf.text_width(F.col("t"), F.lit(10.0)).alias("w")).collect()]
    assert np.allclose(got, [pdf.natural_width(t, 10) for t in texts])


def samples(seed=3, n=400):
    rng = np.random.default_rng(seed)
    moving = np.repeat(rng.random(n // 8) < 0.4, 8)
    return pd.DataFrame({"camera": np.where(np.arange(n) % 2, "a", "b"), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n) * 90, unit="ms"), "event_id": np.arange(n), "m": np.where(moving, 0.05, 0.001)})


@pytest.mark.parametrize("dwell", [0.6, 1.4, 3.0])
def test_captures_of_stream_fold_and_windows(spark, tmp_path, dwell):
    pdf_ = samples()
    df = spark.createDataFrame(pdf_)
    fold = {r.event_id for r in capture.auto_capture_fold(df, 0.032, dwell).collect()}
    assert fold
    if dwell >= capture.COOLDOWN:
        assert fold == {r.event_id for r in capture.auto_capture(df, 0.032, dwell).collect()}
    source = str(tmp_path / "in")
    for k in range(4):  # four micro-batches
        spark.createDataFrame(pdf_.iloc[100 * k : 100 * k + 100]).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = capture.auto_capture_stream(stream, 0.032, dwell).writeStream.format("memory").queryName("shots").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.event_id for r in spark.table("shots").collect()}
    assert got == fold


def test_trigger_rules():
    t = capture.Trigger(0.032, 0.55)
    assert not any(t.see(k * 0.1, 0.0) for k in range(50))  # never moved
    t.see(5.0, 0.1)
    fired = [k for k in range(60) if t.see(5.1 + k * 0.1, 0.0)]
    assert fired == [6]
    t.see(5.8, 0.1)
    fired = [round(5.9 + k * 0.1, 1) for k in range(60) if t.see(5.9 + k * 0.1, 0.0)]
    assert fired and fired[0] >= 5.7 + capture.COOLDOWN - 1e-9


def test_outline_easing():
    a, b = [0.1] * 8, [0.12] * 8
    held, missed = capture.steadied(None, 0, a)
    held, missed = capture.steadied(held, missed, b)
    assert np.allclose(held, 0.108)
    assert capture.steadied(held, missed, [0.9] * 8)[0] == [0.9] * 8
    for _ in range(3):
        held, missed = capture.steadied(held, missed, None)
        assert held is not None
    assert capture.steadied(held, missed, None)[0] is None


def test_streams_of_outlines_and_bursts(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = [("a", k, None if k % 5 == 4 else [k / 100.0] * 8) for k in range(20)]
    df = spark.createDataFrame(rows, "camera string, seq long, quad array<double>")
    want = {(r.seq, tuple(r.quad or ())) for r in capture.quad_easing(df).collect()}
    df.coalesce(1).write.parquet(str(tmp_path / "q"))
    events = spark.createDataFrame([("k", k, k * 10 + (100 if k > 3 else 0)) for k in range(8)] + [("k", 99, 10_000)], "key string, event_id long, s long").select("key", "event_id", F.timestamp_seconds("s").alias("ts"))
    last = {r.event_id for r in capture.settled(events, "key", 60).collect()}
    assert last == {3, 7, 99}
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    streams = {
        "quads": (capture.quad_easing_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "q"))), lambda r: (r.seq, tuple(r.quad or ()))),
        "bursts": (capture.settled_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")).withWatermark("ts", "1 second"), "key", "60 seconds"), lambda r: r.event_id),
    }
    got = {}
    for name, (stream, key) in streams.items():
        stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        got[name] = {key(r) for r in spark.table(name).collect()}
    assert got["quads"] == want
    assert got["bursts"] == {3, 7}  # the last window stays open


def test_text_files(spark, tmp_path):
    from folioscope.operators import pages as collections

    df = spark.createDataFrame([("a", 0, "one"), ("a", 1, "two"), ("b", 0, " ")], "session string, ord int, text string")
    out = collections.export_text(df, "session")
    assert {r.session: r.text for r in out.collect()} == {"a": "── page 1 ──\none\n\n── page 2 ──\ntwo", "b": None}
    collections.write_texts(out.filter("text is not null"), str(tmp_path / "t"), "session")
    assert [r.value for r in spark.read.text(str(tmp_path / "t" / "session=a"), wholetext=True).collect()] == ["── page 1 ──\none\n\n── page 2 ──\ntwo\n"]


def test_auto_expose():
    knob = {"min": -4.0, "max": 4.0, "step": 0.1, "value": 0.0}
    out = capture.auto_expose(knob, lambda v: 120 + 30 * v)
    assert out["settled"] and abs(out["level"] - 205) <= 14
    assert not capture.auto_expose(knob, lambda v: 10)["settled"]


def test_images_round_trip(spark, tmp_path):
    rng = np.random.default_rng(2)
    px = {f"a{k}": rng.integers(0, 256, (5 + k, 7, 3), dtype=np.uint8) for k in range(3)}
    df = spark.createDataFrame([(k, v.shape[1], v.shape[0], bytearray(v.tobytes())) for k, v in px.items()], raster.IMAGE)
    from pyspark.sql import functions as F

    files = images.encode(df)
    images.write_files(files, F.concat("id", F.lit(".png")), F.col("file"), str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["a0.png", "a1.png", "a2.png"]
    (tmp_path / "out" / "broken.png").write_bytes(b"no image")
    back = {r.id.rsplit("/", 1)[1][:-4]: raster.unpack(r.w, r.h, r.data) for r in images.read_images(spark, str(tmp_path / "out")).collect()}
    assert set(back) == set(px) and all((back[k] == px[k]).all() for k in px)
    plain = {r.id: raster.unpack(r.w, r.h, r.data) for r in images.decode_png(files.select("id", "file").unionByName(spark.createDataFrame([("x", bytearray(b"none"))], "id string, file binary"))).collect()}
    assert set(plain) == set(px) and all((plain[k] == px[k]).all() for k in px)
    with pytest.raises(ValueError):
        images.encode(df, "webp")


def test_file_names_stay_apart(spark, tmp_path):
    """Names that differ by signs a path can't hold give files of their own; a failed job leaves nothing."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(n, bytearray(n.encode())) for n in ("a/b", "a_b", "a b", "..")], "name string, body binary")
    images.write_files(df, F.col("name"), F.col("body"), str(tmp_path / "o"))
    assert sorted((tmp_path / "o" / n).read_bytes().decode() for n in os.listdir(tmp_path / "o")) == ["..", "a b", "a/b", "a_b"]
    bad = df.withColumn("name", F.when(F.col("name") == "a b", F.raise_error(F.lit("stop")).cast("string")).otherwise(F.col("name")))
    with pytest.raises(Exception):
        images.write_files(bad, F.col("name"), F.col("body"), str(tmp_path / "p"))
    assert not os.path.isdir(tmp_path / "p") or os.listdir(tmp_path / "p") == []


def test_jpeg_files_decode(spark, tmp_path):
    """A reader of its own decodes them to nearly the same pixels; larger quality, less loss."""
    rng = np.random.default_rng(4)
    x, y = np.meshgrid(np.arange(97), np.arange(61))
    px = {"ramp": np.stack([x * 2, y * 3, x + y], -1).astype(np.uint8), "flat": np.full((8, 8, 3), 77, dtype=np.uint8), "noise": rng.integers(0, 256, (33, 41, 3), dtype=np.uint8), "one": np.array([[[250, 3, 128]]], dtype=np.uint8)}
    for k, v in px.items():
        for q in (30, 95):
            (tmp_path / f"{k}-{q}.jpg").write_bytes(codec.jpeg(v, q / 100))
    loss = {}
    for r in images.read_images(spark, str(tmp_path)).collect():
        name, q = r.id.rsplit("/", 1)[1][:-4].split("-")
        assert (r.h, r.w) == px[name].shape[:2]
        loss[name, int(q)] = float(((raster.unpack(r.w, r.h, r.data).astype(float) - px[name]) ** 2).mean())
    assert len(loss) == 8 and all(loss[k, 95] <= loss[k, 30] for k in px)
    assert loss["ramp", 95] < 2 and loss["flat", 95] < 2 and loss["noise", 95] < 30


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    rng = np.random.default_rng(kind)
    for channels, colour in ((3, 2), (4, 6), (1, 0)):
        px = rng.integers(0, 256, (6, 5, channels), dtype=np.uint8)
        rows, above = [], np.zeros(5 * channels, dtype=int)
        for y in range(6):
            row = px[y].reshape(-1).astype(int)
            left = np.concatenate([np.zeros(channels, dtype=int), row[:-channels]])
            corner = np.concatenate([np.zeros(channels, dtype=int), above[:-channels]])
            p = left + above - corner
            near = np.stack([abs(p - left), abs(p - above), abs(p - corner)]).argmin(0)
            guess = (0 * row, left, above, (left + above) // 2, np.choose(near, [left, above, corner]))[kind]
            rows.append(bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes())
            above = row
        chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
        body = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 6, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")
        want = np.repeat(px, 3, axis=2) if channels == 1 else px[..., :3]
        assert (codec.unpng(body) == want).all()


def test_camera_stream_and_outlines(spark, tmp_path):
    """Frames of the made-up camera as a stream equal those as a batch; so do their outlines."""
    spark.dataSource.register(camera.CameraSource)
    reader = lambda r: r.format("camera").option("width", 999).option("frames", 9).option("per_batch", 4)
    batch = reader(spark.read).load()
    rows = {(r.seq, r.w, r.h, bytes(r.data)) for r in batch.collect()}
    assert len(rows) == 9 and {(w, h) for _, w, h, _ in rows} == {(64, 48)}  # a size it can't give: its own
    stream = reader(spark.readStream).load()
    q = stream.writeStream.format("memory").queryName("frames").option("checkpointLocation", str(tmp_path / "f")).trigger(processingTime="0 seconds").start()
    for _ in range(100):
        q.processAllAvailable() if q.isActive else None
        if spark.table("frames").count() >= 9:
            break
    q.stop()
    assert {(r.seq, r.w, r.h, bytes(r.data)) for r in spark.table("frames").collect()} == rows
    rng = np.random.default_rng(2)
    px = []
    for k in range(12):
        img = np.full((40, 60, 3), 200 if k % 3 else 30, dtype=np.uint8)
        img[6:34, 8:52] = 30 if k % 3 else 200
        px.append((k, raster.store(img + rng.normal(0, 1, img.shape))))
    frames = spark.createDataFrame([("ab"[k % 2], k, 60, 40, bytearray(v.tobytes())) for k, v in px], "camera string, seq long, w int, h int, data binary")
    seen = lambda df: sorted((r.camera, r.seq, tuple(r.corners or ()), r.bright) for r in df.collect())
    want = seen(detect.detect_frames(frames))
    assert len(want) == 12 and all(c for _, _, c, _ in want)
    for k in range(3):
        frames.filter(f"seq div 4 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    detect.detect_frames_stream(s).writeStream.format("memory").queryName("outlines").option("checkpointLocation", str(tmp_path / "o")).trigger(availableNow=True).start().awaitTermination()
    assert seen(spark.table("outlines")) == want


def test_pages_looked_at_again(spark):
    img = np.full((60, 80, 3), 20, dtype=np.uint8)
    img[10:50, 12:70] = 220
    flat = np.full((60, 80, 3), 90, dtype=np.uint8)
    rows = [(k, 80, 60, bytearray(v.tobytes()), [0.0] * 8) for k, v in (("page", img), ("flat", flat))]
    out = {r.id: r.corners for r in detect.redetect(spark.createDataFrame(rows, "id string, w int, h int, data binary, corners array<double>")).collect()}
    assert out["flat"] is None and np.abs(np.array(out["page"]) - [0.15, 1 / 6, 0.875, 1 / 6, 0.875, 5 / 6, 0.15, 5 / 6]).max() < 0.03


def test_settings_of_all_pages(spark):
    df = spark.createDataFrame([(k, "ink", float(k), 90.0 * k, k == 1) for k in range(4)], "id long, filter string, contrast double, rotate double, invert boolean")
    from pyspark.sql import functions as F

    assert sorted(map(tuple, settings.apply_to_all(df, F.col("id") == 99).collect())) == sorted(map(tuple, df.collect()))  # none chosen
    two = settings.apply_to_all(df, F.col("id") >= 2).collect()
    assert {(r.contrast, r.invert) for r in two} == {(2.0, False)} and {r.rotate for r in two} == {0.0, 90.0, 180.0, 270.0}
    null = settings.apply_to_all(df.withColumn("contrast", F.when(F.col("id") != 1, F.col("contrast"))), F.col("id") == 1).collect()
    assert {r.contrast for r in null} == {None}  # a null of the chosen page is taken over, too


def test_work_is_called_off(spark):
    import threading
    import time

    from pyspark.sql import functions as F

    @F.udf("int")
    def slow(x):
        time.sleep(0.5)
        return 1

    job, seen = text.Job(spark, "reading"), []

    def work():
        try:
            seen.append(job.run(lambda: spark.range(0, 400, 1, 4).select(slow("id").alias("x")).agg(F.sum("x")).collect()))
        except Exception as e:
            seen.append(e)

    t = threading.Thread(target=work)
    t.start()
    time.sleep(3)
    job.cancel()
    t.join(60)
    assert not t.is_alive() and isinstance(seen[0], Exception)
    assert text.Job(spark, "short").run(lambda: spark.range(3).count()) == 3


def test_created_dates():
    from datetime import datetime, timedelta, timezone

    at = datetime(2024, 3, 5, 7, 8, 9, tzinfo=timezone(timedelta(hours=-5, minutes=-30)))
    assert pdf.created_now(at) == "D:20240305070809-05'30'" and pdf.low_bytes("aé日") == b"a\xe9\xe5"
    assert re.search(rb"/CreationDate \(D:\d{14}[+-]\d\d'\d\d'\)", pdf.build(pages()))


def test_entry_without_the_text_operators(tmp_path):
    """Without llm the other queries are there; an error inside of it is not passed over."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "folioscope"), tmp_path / "folioscope", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op1_') for k in e.queries()))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert run().stdout.split() == [str(len(QUERIES)), "False"]
    (tmp_path / "folioscope" / "llm").mkdir()
    (tmp_path / "folioscope" / "llm" / "__init__.py").write_text("")
    (tmp_path / "folioscope" / "llm" / "queries.py").write_text("import a_library_that_is_not_there")
    assert "a_library_that_is_not_there" in run().stderr


def test_render_pages(spark):
    img = np.full((30, 20, 3), 200, dtype=np.uint8)
    plain = {k: str(v) for k, v in settings.preset_record("original").items()}
    rows = [("a", 20, 30, bytearray(img.tobytes()), None, plain | {"rotate": "90", "invert": "true"}), ("b", 20, 30, bytearray(img.tobytes()), [0.0, 0.0, 0.5, 0.0, 0.5, 0.5, 0.0, 0.5], None)]
    df = spark.createDataFrame(rows, "id string, w int, h int, data binary, corners array<double>, settings map<string,string>")
    out = {r.id: r for r in raster.render_pages(df).collect()}
    assert (out["a"].w, out["a"].h) == (30, 20) and set(out["a"].data) == {55}
    assert (out["b"].w, out["b"].h) == (16, 16)


def test_recognition_adapter(spark):
    def engine(image, lang, psm):
        if image == b"bad":
            raise ValueError("unreadable")
        return {"text": "a\n\n\n\nb \n", "confidence": 90.0, "words": [{"text": "a", "conf": 90.0, "x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0}]}

    df = spark.createDataFrame([(1, bytearray(b"x")), (2, bytearray(b"bad"))], "id int, image binary")
    out = {r.id: r.ocr for r in text.recognise(df, engine).collect()}
    assert out[1].text == "a\n\nb" and out[1].words[0].text == "a" and out[1].error is None
    assert out[2].error == "unreadable" and out[2].text == ""
