"""Queries on tones, levels and mixed posteriors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelore.operators import segments, sound
from tunelore.operators.events import EVENT_SQL, melody_events

#: Samples a second, and seconds of a frame.
RATE, FRAME_S = 2000, 0.01


def _tones(spark: SparkSession, folder: str, timbre: str = "flute") -> DataFrame:
    ev = melody_events(spark, folder)
    notes = ev.select(F.col("file_id").alias("id"), F.col("start_frame").alias("first"), F.col("source_midi").alias("midi"), (F.col("frames") * FRAME_S).alias("seconds"), ((F.col("event_id") % 5 + 1) / 6.0).alias("amplitude"))
    return sound.tones(notes, RATE, timbre)


def note_tones(spark: SparkSession, folder: str) -> DataFrame:
    """Samples and energy of the tone of every event."""
    energy = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x * x)
    return _tones(spark, folder).select("id", "first", F.size("samples").alias("samples"), F.round(energy, 6).alias("energy"))


def song_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Peak, level and gain of each file's tones."""
    found = sound.level_gains(sound.levels(_tones(spark, folder)))
    return found.withColumns({c: F.round(c, 6) for c in ("peak", "rms", "gain")})


def mixed_posteriors(spark: SparkSession, folder: str) -> DataFrame:
    """Salience and onset evidence mixed from posteriors made of the adapter's events."""
    part = lambda m: (F.col("event_id") % m) / float(m)
    cells = melody_events(spark, folder).select("file_id", F.col("seq").alias("frame"), "pitch", part(7).alias("note"), (part(5) * 1.5).alias("onset"), F.array(part(3), part(4), part(11)).alias("contour"), part(9).alias("rise"), part(2).alias("attack"))
    mixed = segments.mixed_posteriors(cells, 40, 76, 0.3)
    return mixed.withColumns({c: F.round(c, 6) for c in ("salience", "onset")})


_E = f"with {EVENT_SQL.strip()} "
_TONE = f"""{_E}, t as (select file_id, start_frame, greatest(1, round_even(frames * {FRAME_S} * {RATE}, 0))::integer as n, 440 * 2 ^ ((source_midi - 69) / 12) as hz, (event_id % 5 + 1) / 6.0::double as amp from ev),
x as (select *, unnest(range(n)) as i, 2 * pi() * hz / {RATE} as step, least(n, {int(sound.RISE * RATE)}) as rise, least(n, {int(sound.FALL * RATE)}) as fall from t),
w as (select file_id, start_frame, n, i, amp * ({" + ".join(f"{s} * sin({j + 1} * step * (i + 1))" for j, s in enumerate(sound.PARTIALS["flute"]))}) * case when i < rise and rise > 1 then i / rise else 1 end * case when i >= n - fall and fall > 1 then 1 - (i - (n - fall)) / (fall - 1) else 1 end as v from x) """
QUERIES = {f.__name__: f for f in (note_tones, song_levels, mixed_posteriors)}
SQL = {
    "note_tones": _TONE + "select file_id as id, start_frame as first, any_value(n) as samples, round(sum(v * v), 6) as energy from w group by all",
    "song_levels": _TONE + f"""select file_id as id, round(peak, 6) as peak, round(rms, 6) as rms, round(least(0.1 / rms, 0.98 / peak), 6) as gain from (
      select file_id, any_value(peak) as peak, sqrt(avg(v * v) filter (abs(v) >= peak * {10 ** (sound.SILENCE_DB / 20)!r})) as rms from w join (select file_id, max(abs(v)) as peak from w group by all) using (file_id) group by file_id)""",
    "mixed_posteriors": _E + """, c as (select file_id, seq as frame, pitch, (event_id % 7) / 7 as note, least(1, (event_id % 5) / 5 * 1.5) as ons, greatest((event_id % 3) / 3, (event_id % 4) / 4, (event_id % 11) / 11) as contour, (event_id % 9) / 9 as rise, (event_id % 2) / 2 as attack from ev where pitch between 40 and 76),
    s as (select *, least(1, 0.82 * note + 0.18 * contour + 0.04 * ons) as salience from c)
    select file_id, frame, pitch, round(salience, 6) as salience, round(least(1, 0.55 * ons + 0.15 * rise + 0.3 * attack * least(1, salience / 0.18)), 6) as onset from s""",
}
