"""Streams of frames: motion, automatic and timed capture, a steadied outline.

Each rule is written once as a plain function of (state, row); a batch folds it over a
camera's rows in order, a stream keeps the state between micro-batches.  Event time
is `ts`; rows of a camera are taken in order of (ts, event_id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CALM, LIVELY = 0.06, 0.004  # motion thresholds at sensitivity 0 and 100
COOLDOWN = 1.4


def threshold(sensitivity: float) -> float:
    return CALM + (LIVELY - CALM) * (sensitivity / 100)


def meter(m: Column, limit: float) -> list[Column]:
    """Percent of the motion bar, and the label beside it."""
    return [F.least(F.lit(100.0), m / F.lit(0.12) * 100).alias("percent"), F.when(m < limit, "still").otherwise("moving").alias("label")]


def frame_motion(frames: DataFrame) -> DataFrame:
    """Mean difference, 0..1, of each frame (camera, frame, x, y, v) to the one before; 0 for the first."""
    w = W.partitionBy("camera", "x", "y").orderBy("frame")
    d = frames.withColumn("d", F.abs(F.col("v") - F.lag("v").over(w)))
    return d.groupBy("camera", "frame").agg(F.coalesce(F.avg("d") / 255, F.lit(0.0)).alias("m"))


# ---------------------------------------------------------------- automatic capture
class Trigger:
    """Fires once the scene, having moved, has been still for `dwell` seconds, and not
    within `cooldown` of the last time."""

    def __init__(self, limit: float, dwell: float, cooldown: float = COOLDOWN, state: tuple = (False, None, None)):
        self.limit, self.dwell, self.cooldown = limit, dwell, cooldown
        self.armed, self.since, self.last = state

    def see(self, t: float, m: float) -> bool:
        if m >= self.limit:
            self.armed, self.since = True, None
        elif self.armed and self.since is None:
            self.since = t
        elif self.armed and t - self.since >= self.dwell and (self.last is None or t - self.last > self.cooldown):
            self.armed, self.since, self.last = False, None, t
            return True
        return False

    @property
    def state(self) -> tuple:
        return self.armed, self.since, self.last


def auto_capture(samples: DataFrame, limit: float, dwell: float) -> DataFrame:
    """Shots by windows alone: one for each still stretch after a movement, at its first
    sample `dwell` or more after the stretch began.  Exact where dwell >= the cooldown."""
    w = W.partitionBy("camera").orderBy("ts", "event_id")
    s = samples.withColumn("t", F.unix_micros("ts") / 1e6).withColumn("island", F.sum((F.col("m") >= limit).cast("int")).over(w))
    still = s.filter((F.col("m") < limit) & (F.col("island") > 0))
    start = still.withColumn("start", F.min("t").over(W.partitionBy("camera", "island")))
    ripe = start.filter((F.col("t") - F.col("start") >= dwell) & (F.col("t") > F.col("start")))
    first = ripe.withColumn("rank", F.row_number().over(W.partitionBy("camera", "island").orderBy("ts", "event_id")))
    return first.filter("rank = 1").select("camera", "ts", "event_id")


SHOTS = "camera string, ts timestamp, event_id long"


def auto_capture_fold(samples: DataFrame, limit: float, dwell: float, cooldown: float = COOLDOWN) -> DataFrame:
    """Shots by the state machine itself, for any dwell."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "event_id"])
        trigger = Trigger(limit, dwell, cooldown)
        fired = [trigger.see(t, m) for t, m in zip(pdf["ts"].astype("datetime64[us]").astype("int64") / 1e6, pdf["m"])]
        return pdf.loc[np.array(fired, dtype=bool), ["camera", "ts", "event_id"]]

    return samples.select("camera", "ts", "event_id", "m").groupBy("camera").applyInPandas(run, SHOTS)


def auto_capture_stream(samples: DataFrame, limit: float, dwell: float, cooldown: float = COOLDOWN) -> DataFrame:
    """The same over a stream: a camera's state lives in the state store."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        armed, since, last = state.get if state.exists else (False, -1.0, -1.0)
        trigger = Trigger(limit, dwell, cooldown, (armed, None if since < 0 else since, None if last < 0 else last))
        pdf = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        fired = [trigger.see(t, m) for t, m in zip(pdf["ts"].astype("datetime64[us]").astype("int64") / 1e6, pdf["m"])]
        armed, since, last = trigger.state
        state.update((armed, -1.0 if since is None else since, -1.0 if last is None else last))
        yield pdf.loc[np.array(fired, dtype=bool), ["camera", "ts", "event_id"]]

    return samples.select("camera", "ts", "event_id", "m").groupBy("camera").applyInPandasWithState(run, SHOTS, "armed boolean, since double, last double", "append", GroupStateTimeout.NoTimeout)


def interval_capture(samples: DataFrame, seconds: int) -> DataFrame:
    """The first frame of every `seconds`, for each camera; a stream needs a watermark first."""
    if samples.isStreaming:
        w = F.window("ts", f"{seconds} seconds")
        return samples.groupBy("camera", w).agg(F.min(F.struct("ts", "event_id")).alias("f")).select("camera", "f.ts", "f.event_id")
    slot = F.floor(F.unix_micros("ts") / F.lit(seconds * 1_000_000)).alias("slot")
    return samples.groupBy("camera", slot).agg(F.min(F.struct("ts", "event_id")).alias("f")).select("camera", "f.ts", "f.event_id")


# ---------------------------------------------------------------- outline
def steadied(held: list[float] | None, missed: int, seen: list[float] | None, jump: float = 0.05, pace: float = 0.4, patience: int = 3) -> tuple[list[float] | None, int]:
    """The outline shown after a reading: eased towards it, at once if a corner moved far;
    a few misses keep the last one."""
    if seen is None:
        return (None if missed + 1 > patience else held), missed + 1
    if held is None:
        return list(seen), 0
    far = max(float(np.hypot(seen[k] - held[k], seen[k + 1] - held[k + 1])) for k in range(0, len(held), 2))
    a = 1.0 if far > jump else pace
    return [h + (s - h) * a for h, s in zip(held, seen)], 0


def quad_easing(readings: DataFrame) -> DataFrame:
    """(camera, seq, quad array<double> or null) with the steadied outline after each reading."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq").reset_index(drop=True)
        held, missed, out = None, 0, []
        for q in pdf["quad"]:
            held, missed = steadied(held, missed, None if q is None else list(q))
            out.append(held)
        return pd.DataFrame({"camera": pdf["camera"], "seq": pdf["seq"], "quad": out})

    kind = dict(readings.dtypes)["camera"]
    return readings.select("camera", "seq", "quad").groupBy("camera").applyInPandas(run, f"camera {kind}, seq long, quad array<double>")


def quad_easing_stream(readings: DataFrame) -> DataFrame:
    """The same over a stream."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, missed = state.get if state.exists else ([], 0)
        held = list(held) or None
        pdf = pd.concat(list(parts)).sort_values("seq").reset_index(drop=True)
        out = []
        for q in pdf["quad"]:
            held, missed = steadied(held, missed, None if q is None else list(q))
            out.append(held)
        state.update(([float(x) for x in held or []], int(missed)))
        yield pd.DataFrame({"camera": pdf["camera"], "seq": pdf["seq"], "quad": out})

    kind = dict(readings.dtypes)["camera"]
    return readings.select("camera", "seq", "quad").groupBy("camera").applyInPandasWithState(run, f"camera {kind}, seq long, quad array<double>", "quad array<double>, missed int", "append", GroupStateTimeout.NoTimeout)


# ---------------------------------------------------------------- exposure and devices
KNOBS = ("exposureCompensation", "exposureTime", "iso", "brightness")


def auto_expose(knob: dict, measure, target: float = 205, tolerance: float = 7, steps: int = 7) -> dict:
    """Bisects a control {min, max, step, value} until measure(value) is near the target."""
    low, high, value = knob["min"], knob["max"], knob["value"]
    level = measure(value)
    for _ in range(steps):
        if abs(level - target) <= tolerance:
            return {"value": value, "level": level, "settled": True}
        low, high = (value, high) if level < target else (low, value)
        new = (low + high) / 2
        if abs(new - value) < (knob.get("step") or (knob["max"] - knob["min"]) / 100) / 2:
            break
        value = new
        level = measure(value)
    return {"value": value, "level": level, "settled": abs(level - target) <= 2 * tolerance}


def nudged(value: Column, low: Column, high: Column, step: Column, direction: int) -> Column:
    """A control moved by its step, a twentieth of its span at least, within its range."""
    by = F.greatest(F.coalesce(step, F.lit(0.0)), (high - low) / 20) * direction
    return F.least(high, F.greatest(low, value + by))


def first_knob(capabilities: DataFrame, device: str = "device") -> DataFrame:
    """Of each device the first exposure control it has, in order of preference."""
    rank = F.array_position(F.array(*[F.lit(k) for k in KNOBS]), F.col("key"))
    return capabilities.filter((F.col("kind") == "range") & (rank > 0)).withColumn("n", F.row_number().over(W.partitionBy(device).orderBy(rank))).filter("n = 1").drop("n")


def video_devices(devices: DataFrame) -> DataFrame:
    """The devices that give video."""
    return devices.filter(F.col("kind") == "videoinput")


#: Sizes asked for after the sensor's own, largest first.
LADDER = ((3840, 2160), (2560, 1440))


def ladder(devices: DataFrame) -> DataFrame:
    """(device, start_w, rung, w, h): sizes to ask of each device (device, start_w, max_w, max_h),
    in order: those wider than what it gives now."""
    sizes = F.array(F.struct(F.col("max_w").alias("w"), F.col("max_h").alias("h")), *[F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")) for w, h in LADDER])
    rungs = devices.select("device", "start_w", F.posexplode(sizes).alias("rung", "size")).select("device", "start_w", "rung", "size.w", "size.h")
    return rungs.filter(F.col("w") > F.coalesce("start_w", F.lit(0)))


def raised_mode(attempts: DataFrame) -> DataFrame:
    """What each device ends with, of its attempts (device, start_w, rung, w, h, got_w, renders):
    the first that was taken (got_w is null if refused), is wider than before, and gives frames.
    Any other is undone; a device without one keeps its size and is left out."""
    good = attempts.filter((F.col("got_w") > F.coalesce("start_w", F.lit(0))) & F.col("renders"))
    return good.groupBy("device").agg(F.min(F.struct("rung", "w", "h", "got_w")).alias("m")).select("device", "m.rung", "m.w", "m.h", "m.got_w")


#: Controls in the order they are shown: key, label, kind.
CONTROLS = (
    ("exposureMode", "Exposure mode", "enum"), ("exposureCompensation", "Exposure compensation", "range"), ("exposureTime", "Exposure time", "range"), ("iso", "ISO", "range"),
    ("brightness", "Brightness", "range"), ("contrast", "Contrast", "range"), ("saturation", "Saturation", "range"), ("sharpness", "Sharpness", "range"), ("zoom", "Zoom", "range"),
    ("focusMode", "Focus", "enum"), ("focusDistance", "Focus distance", "range"), ("whiteBalanceMode", "White balance", "enum"), ("colorTemperature", "Colour temp.", "range"), ("torch", "Torch / lamp", "bool"),
)
#: Controls that do nothing before a mode is set to `manual`.
NEEDS_MANUAL = {"exposureTime": "exposureMode", "iso": "exposureMode", "focusDistance": "focusMode", "colorTemperature": "whiteBalanceMode"}


def capabilities(raw: DataFrame) -> DataFrame:
    """(device, place, key, label, kind, low, high, step, value, options, needs): the controls worth
    showing, of what devices report (device, key, low, high, step, options array<string>, value
    string).  A range must have room, a choice two options, a switch the option `true`."""
    spec = raw.sparkSession.createDataFrame([(k, *c, NEEDS_MANUAL.get(c[0])) for k, c in enumerate(CONTROLS)], "place int, key string, label string, kind string, needs string")
    j = raw.join(F.broadcast(spec), "key")  # fourteen rows
    ranged, n = F.col("kind") == "range", F.size(F.coalesce("options", F.array().cast("array<string>")))
    room = F.col("low").isNotNull() & F.coalesce(F.col("high") != F.col("low"), F.lit(True))
    shown = F.when(ranged, room).when(F.col("kind") == "enum", n >= 2).otherwise(F.coalesce(F.array_contains("options", "true"), F.lit(False)))
    step = F.when(ranged, F.when(F.coalesce(F.col("step"), F.lit(0.0)) != 0, F.col("step")).otherwise((F.col("high") - F.col("low")) / 100))
    value = F.when(ranged, F.coalesce("value", F.col("low").cast("string"))).when(F.col("kind") == "bool", F.coalesce(F.col("value") == "true", F.lit(False)).cast("string")).otherwise(F.col("value"))
    return j.filter(shown).select(
        "device", "place", "key", "label", "kind", F.when(ranged, F.col("low")).alias("low"), F.when(ranged, F.col("high")).alias("high"), step.alias("step"), value.alias("value"),
        F.when(F.col("kind") == "enum", F.col("options")).alias("options"), "needs",
    )


def control_steps(key: Column, mode_options: Column, mode_now: Column) -> Column:
    """What to set, in order, to change a control: its mode first, where the device can be set to
    `manual` and is not."""
    mode = F.lit(None).cast("string")
    for k, m in NEEDS_MANUAL.items():
        mode = F.when(key == k, F.lit(m)).otherwise(mode)
    first = mode.isNotNull() & F.coalesce(F.array_contains(mode_options, "manual"), F.lit(False)) & ~F.coalesce(mode_now == "manual", F.lit(False))
    return F.when(first, F.array(F.concat(mode, F.lit("=manual")), key)).otherwise(F.array(key))


def refocus_steps(modes: Column) -> Column:
    """The focus modes to set, in order, to make a lens focus again; null if it can't."""
    has = lambda m: F.array_contains(modes, m)
    again = F.when(has("manual"), F.array(F.lit("manual"), F.lit("continuous"))).otherwise(F.array(F.lit("continuous")))
    return F.when(has("single-shot"), F.array(F.lit("single-shot"))).when(has("continuous"), again)


def preview_mode(modes: DataFrame, device: str = "device", heights: tuple[int, ...] = (1200, 960, 720), slack: float = 0.02, fps: float = 20) -> DataFrame:
    """Of each device (w, h, fps, aspect of its sensor) the first height that keeps the aspect and the rate."""
    rank = F.array_position(F.array(*[F.lit(h) for h in heights]), F.col("h"))
    good = modes.filter((rank > 0) & (F.abs(F.col("w") / F.col("h") - F.col("aspect")) < slack) & (F.col("fps") >= fps))
    return good.withColumn("n", F.row_number().over(W.partitionBy(device).orderBy(rank, "w"))).filter("n = 1").drop("n")


def still_verdict(match: Column, sw: Column, sh: Column, vw: Column, vh: Column) -> list[Column]:
    """Whether a still shows the same view as the stream, and is worth taking."""
    same = match >= 0.82
    return [same.alias("same_view"), (same & (sw * sh > vw * vh * F.lit(1.1))).alias("bigger")]


def grabbed(still_w: Column, still_h: Column, frame_w: Column, frame_h: Column, wanted: Column) -> list[Column]:
    """Size and origin of a shot: the still if one is wanted, there, and larger than the frame."""
    still = F.coalesce(wanted & (still_w * still_h > frame_w * frame_h), F.lit(False))
    return [F.when(still, still_w).otherwise(frame_w).alias("w"), F.when(still, still_h).otherwise(frame_h).alias("h"), still.alias("via_still")]


def outline_source(via_still: Column, same_view: Column, live: Column, detect: Column) -> Column:
    """Where a shot's outline comes from: the live one if it holds for the shot, else the shot itself."""
    return F.when(~via_still | same_view, F.when(live, "live").otherwise("none")).otherwise(F.when(detect, "shot").otherwise("none"))


def settled(events: DataFrame, key: str, quiet: float) -> DataFrame:
    """The last event of every burst: none follows within `quiet` seconds."""
    after = F.lead(F.unix_micros("ts")).over(W.partitionBy(key).orderBy("ts", "event_id"))
    return events.withColumn("_after", after).filter(F.col("_after").isNull() | (F.col("_after") - F.unix_micros("ts") >= quiet * 1e6)).drop("_after")


def settled_stream(events: DataFrame, key: str, quiet: str) -> DataFrame:
    """The same over a stream with a watermark: the last event of each session window."""
    return events.groupBy(key, F.session_window("ts", quiet)).agg(F.max(F.struct("ts", "event_id")).alias("e")).select(key, "e.ts", "e.event_id")
