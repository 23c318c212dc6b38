"""Windows, sessions and phrases over streams of note events.

A stream's events carry ``ts``; a watermark bounds how late they may come and
how long state is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tunelore.operators.phrases import PhraseRule


def windowed_counts(events: DataFrame, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """window_start, channel, n_events, frames of tumbling or sliding windows."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    counts = events.withWatermark("ts", late).groupBy(window.alias("w"), "channel").agg(F.count("*").alias("n_events"), F.sum("frames").alias("frames"))
    return counts.select(F.col("w.start").alias("window_start"), "channel", "n_events", "frames")


def gap_sessions(events: DataFrame, gap: int, frame_ms: int = 10, late: str = "10 minutes") -> DataFrame:
    """file_id, session_start, n_events, frames of sessions that end where no note begins within ``gap`` frames of the last one's end.

    ``ts`` is a note's onset; each note keeps its session open for its own
    length and the gap, which measures from end to onset like the batch form.
    A window that touches the next one would merge with it, so it ends a
    millisecond before.
    """
    hold = F.concat(((F.col("frames") + gap) * frame_ms - 1).cast("string"), F.lit(" milliseconds"))
    grouped = events.withWatermark("ts", late).groupBy("file_id", F.session_window("ts", hold).alias("s")).agg(F.count("*").alias("n_events"), F.sum("frames").alias("frames"))
    return grouped.select("file_id", F.col("s.start").alias("session_start"), "n_events", "frames")


def phrases(events: DataFrame, typical: float, rule: PhraseRule = PhraseRule(), idle_ms: int = 60_000, late: str = "10 minutes") -> DataFrame:
    """file_id, phrase, n_events, start_frame, end_frame of each phrase as soon as it has ended.

    The rule of batch detection before short phrases are joined, with
    ``typical`` frames in place of the file's median, which a stream doesn't
    know. Events of a file that arrive behind later ones already seen are left
    out. A phrase open for ``idle_ms`` of event time after its last note ends.
    """
    schema = "file_id bigint, phrase bigint, n_events bigint, start_frame bigint, end_frame bigint"
    state_schema = "phrase long, n long, first long, seq long, last_end long, frames long, cents long, largest_end long"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else None
        out = []
        if state.hasTimedOut:
            if held and held[1]:
                out.append((key[0], held[0], held[1], held[2], held[7]))
                state.update((held[0] + 1, 0, *held[2:]))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])
            return
        rows = pd.concat(list(batches)).sort_values("seq")
        for r in rows.itertuples():
            if held and r.seq <= held[3]:
                continue
            if held and held[1]:
                gap = max(0, r.start_frame - held[4])
                soft = held[5] >= rule.long * typical and (gap > 0 or abs(r.midi_cents - held[6]) >= rule.leap)
                if gap >= rule.gap or (held[1] >= rule.least and soft):
                    out.append((key[0], held[0], held[1], held[2], held[7]))
                    held[0], held[1] = held[0] + 1, 0
            number, n = (held[0], held[1]) if held else (0, 0)
            held = [number, n + 1, held[2] if n else r.start_frame, r.seq, r.end_frame, r.frames, r.midi_cents, max(r.end_frame, held[7]) if n else r.end_frame]
        if held:
            state.update(tuple(int(x) for x in held))
            state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    slim = events.withWatermark("ts", late).select("file_id", "ts", "seq", "start_frame", "end_frame", "frames", "midi_cents")
    return slim.groupBy("file_id").applyInPandasWithState(step, schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout)
