"""Tones of notes, and levels of sampled sound.

Sound is a table of pieces (id, first, samples), each a run of samples of one
recording from position ``first`` on. Levels are taken from partial sums of
pieces, so that a recording is never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The strengths of a timbre's partials, seconds of a tone's rise and fall, and a plucked tone's decay over its length.
PARTIALS = {"sine": (1.0,), "flute": (0.90, 0.07, 0.03), "reed": (0.72, 0.19, 0.07, 0.02), "pluck": (0.66, 0.20, 0.09, 0.05)}
RISE, FALL, DECAY = 0.008, 0.045, 2.5
#: How far below the peak, in decibels, sound counts as silence; the faintest sample that may count at all.
SILENCE_DB, FAINT = -45.0, 1e-12


def pitch_curve(midi: float, n: int, rate: int, start: float | None = None, glide: int = 0, vibrato_cents: float = 0.0, vibrato_hz: float = 5.5, vibrato_from: int = 0) -> np.ndarray:
    """The pitch at each of ``n`` samples: gliding in from ``start`` over ``glide`` samples, with vibrato from a sample on."""
    out = np.full(n, float(midi))
    if start is not None and glide > 0:
        g = min(n, glide)
        out[:g] = np.linspace(start, midi, g)
    if vibrato_cents:
        out[vibrato_from:] += vibrato_cents / 100 * np.sin(2 * np.pi * vibrato_hz * np.arange(max(0, n - vibrato_from)) / rate)
    return out


def tone(curve: np.ndarray, rate: int, amplitude: float = 1.0, timbre: str = "sine") -> np.ndarray:
    """Samples of a tone whose pitch follows ``curve``: the timbre's partials under an envelope."""
    n = len(curve)
    phase = 2 * np.pi * np.cumsum(440.0 * 2.0 ** ((curve - 69.0) / 12.0)) / rate
    wave = sum(strength * np.sin((i + 1) * phase) for i, strength in enumerate(PARTIALS[timbre]))
    shape = np.exp(-DECAY * np.arange(n) / max(1, n)) if timbre == "pluck" else np.ones(n)
    rise, fall = (min(n, max(1, int(s * rate))) for s in (RISE, FALL))
    if rise > 1:
        shape[:rise] = shape[:rise] * np.arange(rise) / rise
    if fall > 1:
        shape[n - fall :] *= np.linspace(1.0, 0.0, fall)
    return wave * shape * amplitude


def tones(notes: DataFrame, rate: int = 8000, timbre: str = "sine") -> DataFrame:
    """Pieces (id, first, samples) of notes (id, first, midi, seconds, amplitude), a piece a note; a null or empty note has none."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("midi", "seconds", "amplitude")))
            sound = [tone(pitch_curve(m, max(1, round(s * rate)), rate), rate, a, timbre) for m, s, a in rows]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("first"), pa.array(sound, pa.list_(pa.float64()))], ["id", "first", "samples"])

    usable = notes.select(F.col("id").cast("bigint"), F.col("first").cast("bigint"), F.col("midi").cast("double"), F.col("seconds").cast("double"), F.col("amplitude").cast("double")).dropna().filter("seconds > 0")
    return usable.mapInArrow(local, "id bigint, first bigint, samples array<double>")


def levels(sound: DataFrame) -> DataFrame:
    """id, peak, rms of each recording's active samples: those no more than SILENCE_DB below its peak; silence has 0."""

    def measured(df: DataFrame, schema: str, of) -> DataFrame:
        names = [x.split()[0] for x in schema.split(", ")]

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lists = b.column("samples")
                floor = b.column("floor").to_numpy() if "floor" in b.schema.names else np.zeros(b.num_rows)
                rows = [of(np.abs(np.asarray(lists[i].as_py() or [0.0], float)), floor[i]) for i in range(b.num_rows)]
                yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, pa.float64()) for c in (zip(*rows) if rows else [[]] * (len(names) - 1)))], names)

        return df.mapInArrow(local, schema)

    peaks = measured(sound.select("id", "samples"), "id bigint, peak double", lambda x, _: (float(x.max()),)).groupBy("id").agg(F.max("peak").alias("peak"))
    floored = sound.join(peaks, "id").select("id", "samples", F.greatest(F.col("peak") * 10 ** (SILENCE_DB / 20), F.lit(FAINT)).alias("floor"))
    active = measured(floored, "id bigint, n double, squares double", lambda x, floor: (float((x >= floor).sum()), float(np.square(x[x >= floor]).sum())))
    sums = active.groupBy("id").agg(F.sum("n").alias("n"), F.sum("squares").alias("squares"))
    return peaks.join(sums, "id").select("id", "peak", F.coalesce(F.sqrt(F.try_divide("squares", "n")), F.lit(0.0)).alias("rms"))


def level_gains(measured: DataFrame, target_db: float = -20.0, ceiling: float = 0.98) -> DataFrame:
    """``measured`` (id, peak, rms) with ``gain``: what brings the level to ``target_db`` without a peak above ``ceiling``; silence stays."""
    wanted = F.lit(10 ** (target_db / 20)) / F.col("rms")
    return measured.withColumn("gain", F.when((F.col("rms") > 0) & (F.col("peak") > 0), F.least(wanted, ceiling / F.col("peak"))).otherwise(F.lit(1.0)))
