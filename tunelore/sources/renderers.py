"""Notes as files of the formats that ``tunelore.sources.scores`` reads: one document per song.

Each renderer takes a song's notes (start, duration in ticks, pitch, lyric), in
order of start, and gives the bytes of a file. A song is a document, and its
notes are in memory while it is written.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelore.sources.scores import TICKS, wav_bytes

Notes = list[tuple[int, int, int, str]]
#: Letter and alteration of each pitch class, sharps only.
SPELLED = [("C", 0), ("C", 1), ("D", 0), ("D", 1), ("E", 0), ("F", 0), ("F", 1), ("G", 0), ("G", 1), ("A", 0), ("A", 1), ("B", 0)]


def _length(n: int) -> bytes:
    """A MIDI quantity of variable length."""
    out = [n & 127]
    while n := n >> 7:
        out.append(n & 127 | 128)
    return bytes(reversed(out))


def midi(notes: Notes, channel: int = 0, tempo: int = 500_000) -> bytes:
    """A file of one track: tempo, name, and notes, ends before beginnings at one tick."""
    events = sorted([(s, 1, p) for s, _, p, _ in notes] + [(s + d, 0, p) for s, d, p, _ in notes])
    body = b"\x00\xff\x51\x03" + tempo.to_bytes(3, "big") + b"\x00\xff\x03\x05notes"
    at = 0
    for tick, on, pitch in events:
        body += _length(tick - at) + bytes([0x90 | channel, pitch, 80 if on else 0])
        at = tick
    body += b"\x00\xff\x2f\x00"
    return b"MThd" + struct.pack(">IHHH", 6, 0, 1, TICKS) + b"MTrk" + struct.pack(">I", len(body)) + body


def vsqx(notes: Notes) -> bytes:
    rows = "".join(f"<note><t>{s}</t><dur>{d}</dur><n>{p}</n><y>{escape(w)}</y></note>" for s, d, p, w in notes)
    return f"<?xml version='1.0'?><vsq4 xmlns='urn:notes'><masterTrack><resolution>{TICKS}</resolution></masterTrack><vsTrack><tNo>0</tNo><name>line</name><vsPart><t>0</t>{rows}</vsPart></vsTrack></vsq4>".encode()


def ustx(notes: Notes, bpm: float = 120.0) -> bytes:
    rows = "".join(f"  - {{position: {s}, duration: {d}, tone: {p}, lyric: \"{w}\"}}\n" for s, d, p, w in notes)
    return f"resolution: {TICKS}\nbpm: {bpm}\ntracks:\n- track_name: line\nvoice_parts:\n- track_no: 0\n  position: 0\n  notes:\n{rows}".encode()


def ust(notes: Notes, bpm: float = 120.0) -> bytes:
    """A project of one line: a rest before each note that doesn't begin where the last one ended."""
    parts, at = [f"[#SETTING]\nTempo = {bpm}\n"], 0
    for s, d, p, w in notes:
        for length, pitch, lyric in ([(s - at, 60, "R")] if s > at else []) + [(d, p, w)]:
            parts.append(f"[#{(len(parts) - 1) % 10_000:04d}]\nLength={length}\nLyric = {lyric}\nNoteNum={pitch}\n")
        at = s + d
    return "".join([*parts, "[#TRACKEND]\n"]).encode()


def musicxml(notes: Notes) -> bytes:
    """A score of one part and measure, in ticks a quarter, with rests between the notes."""
    rows, at = [], 0
    for s, d, p, _ in notes:
        if s > at:
            rows.append(f"<note><rest/><duration>{s - at}</duration></note>")
        step, alter = SPELLED[p % 12]
        rows.append(f"<note><pitch><step>{step}</step><alter>{alter}</alter><octave>{p // 12 - 1}</octave></pitch><duration>{d}</duration></note>")
        at = s + d
    mark = "<direction><direction-type><metronome><beat-unit>half</beat-unit><per-minute>50</per-minute></metronome></direction-type></direction>"
    return f"<?xml version='1.0'?><score-partwise><part id='P1'><measure number='1'><attributes><divisions>{TICKS}</divisions></attributes>{mark}{''.join(rows)}</measure></part></score-partwise>".encode()


def wav(notes: Notes, rate: int = 8000) -> bytes:
    """A sound file of one sample a note: the pitch's distance from 64, over 64."""
    import numpy as np

    return wav_bytes(np.array([(p - 64) / 64 for _, _, p, _ in notes]), rate)


def archive(notes: Notes) -> bytes:
    """An archive of the song's project and score."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("song/line.ust", ust(notes))
        z.writestr("song/line.xml", musicxml(notes))
    return out.getvalue()


def rendered(notes: DataFrame, render: Callable[[Notes], bytes], suffix: str) -> DataFrame:
    """Rows (path, content) of the songs of notes (song, start, duration, pitch, lyric)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "pitch"])
        rows = list(zip(pdf["start"].tolist(), pdf["duration"].tolist(), pdf["pitch"].tolist(), pdf["lyric"].tolist()))
        return pd.DataFrame({"path": [f"song_{pdf['song'].iloc[0]}.{suffix}"], "content": [render(rows)]})

    typed = notes.select("song", F.col("start").cast("bigint"), F.col("duration").cast("bigint"), F.col("pitch").cast("int"), "lyric")
    return typed.groupBy("song").applyInPandas(one, "path string, content binary")
