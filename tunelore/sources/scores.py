"""Score and project files as tables: one task parses a batch of whole files.

Each reader lists files as binary rows and hands every file's bytes to a
parser that yields rows. A file that can't be parsed gives one row with its
error and no values, so that a corpus is read to its end.
"""

from __future__ import annotations

import io
import re
import struct
import uuid
import wave
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Rows = Iterator[tuple]
NOTE = "format string, track int, track_name string, resolution int, start bigint, duration bigint, pitch int, lyric string, tempo double"
MESSAGE = "track int, seq int, tick bigint, type string, channel int, note int, velocity int, control int, value int, tempo int, name string, ticks_per_beat int"
SCORE = "start_q double, duration_q double, midi int, tie_start boolean, tie_stop boolean, tempo double"
SAMPLES = "rate int, channels int, first bigint, samples array<float>"
#: Lyrics that are rests, and the encodings of an INI-like project, in order.
REST_LYRICS = {"r", "rest", "pau", "sil"}
UST_CODES = ("utf-8-sig", "cp932", "shift_jis", "utf-16", "latin-1")
TICKS = 480
#: Quarters of a metronome's beat, and the tempo of a score that tells none.
BEATS, FALLBACK_TEMPO = {"whole": 4.0, "half": 2.0, "quarter": 1.0, "eighth": 0.5, "16th": 0.25}, 120.0
STEPS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}


def read_files(spark: SparkSession, path: str, pattern: str, parse: Callable[[bytes], Rows], fields: str, recursive: bool = True) -> DataFrame:
    """path, the parser's fields, and error, of every file under ``path`` that fits ``pattern``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    names = [f.split()[0] for f in fields.split(", ")]

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"]):
                try:
                    rows = list(parse(bytes(data)))
                    error = None
                except Exception as e:  # the file's failure is a row of the result
                    rows, error = [(None,) * len(names)], f"{type(e).__name__}: {e}"[:500]
                out = pd.DataFrame(rows, columns=names, dtype=object)
                yield out.assign(path=name, error=error)[["path", *names, "error"]]

    return files.select("path", "content").mapInPandas(local, f"path string, {fields}, error string")


# Standard MIDI files


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = 0
    while True:
        value = value << 7 | data[at] & 127
        at += 1
        if data[at - 1] < 128:
            return value, at


def parse_midi(data: bytes) -> Rows:
    """Messages with absolute ticks; a note-on of velocity 0 is a note-off."""
    if data[:4] != b"MThd":
        raise ValueError("no MIDI header")
    size, _, tracks, division = struct.unpack(">IHHH", data[4:14])
    if division & 0x8000:
        raise ValueError("SMPTE time isn't supported")
    at = 8 + size
    track = 0
    while at + 8 <= len(data) and track < tracks:
        kind, length = data[at : at + 4], struct.unpack(">I", data[at + 4 : at + 8])[0]
        body = data[at + 8 : at + 8 + length]
        at += 8 + length
        if kind != b"MTrk":
            continue
        pos = tick = seq = status = 0
        while pos < len(body):
            delta, pos = _varint(body, pos)
            tick += delta
            if body[pos] & 0x80:
                status = body[pos]
                pos += 1
            row = {"channel": None, "note": None, "velocity": None, "control": None, "value": None, "tempo": None, "name": None}
            if status == 0xFF:
                meta, (size, pos) = body[pos], _varint(body, pos + 1)
                held = body[pos : pos + size]
                pos += size
                what = {0x51: "set_tempo", 0x03: "track_name", 0x2F: "end_of_track"}.get(meta)
                if meta == 0x51:
                    row["tempo"] = int.from_bytes(held, "big")
                if meta == 0x03:
                    row["name"] = held.decode("utf-8", "replace")
            elif status in (0xF0, 0xF7):
                size, pos = _varint(body, pos)
                pos += size
                what = None
            else:
                high, row["channel"] = status >> 4, status & 15
                two = high not in (0xC, 0xD)
                first, second = body[pos], body[pos + 1] if two else 0
                pos += 2 if two else 1
                what = {8: "note_off", 9: "note_on", 0xB: "control_change", 0xC: "program_change", 0xE: "pitchwheel"}.get(high)
                if high in (8, 9):
                    row |= {"note": first, "velocity": second}
                    what = "note_off" if high == 9 and not second else what
                elif high == 0xB:
                    row |= {"control": first, "value": second}
                elif high == 0xC:
                    row["value"] = first
                elif high == 0xE:
                    row["value"] = (first | second << 7) - 8192
            if what:
                yield (track, seq, tick, what, row["channel"], row["note"], row["velocity"], row["control"], row["value"], row["tempo"], row["name"], division)
                seq += 1
        track += 1


# singing-synthesiser projects


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _value(e: ET.Element, names: set[str], default=None):
    return next(((c.text or "").strip() for c in e if _tag(c) in names), default)


def _number(text, default: int) -> int:
    try:
        return int(float(text))
    except (TypeError, ValueError):
        return default


def parse_vsqx(data: bytes) -> Rows:
    """Notes of an XML project, its parts' offsets added."""
    root = ET.fromstring(data)
    resolution = next((max(1, _number(e.text, TICKS)) for e in root.iter() if _tag(e) in {"resolution"}), TICKS)
    for i, track in enumerate(e for e in root.iter() if _tag(e) == "vsTrack"):
        index = _number(_value(track, {"tNo", "trackNo"}), i)
        name = _value(track, {"name"}) or f"Track {index}"
        for part in (e for e in track if _tag(e) in {"vsPart", "musicalPart"}):
            offset = _number(_value(part, {"t", "posTick"}), 0)
            for note in (e for e in part if _tag(e) == "note"):
                length, pitch = _number(_value(note, {"dur", "durTick"}), 0), _number(_value(note, {"n", "noteNum"}), -1)
                if length > 0 and 0 <= pitch <= 127:
                    yield ("vsqx", index, name, resolution, offset + _number(_value(note, {"t", "posTick"}), 0), length, pitch, _value(note, {"y", "lyric"}, ""), None)


def parse_ustx(data: bytes) -> Rows:
    """Notes of a YAML project; tone 0 counts as none."""
    import yaml

    project = yaml.safe_load(data.decode("utf-8-sig", "replace"))
    if not isinstance(project, dict):
        raise ValueError("the project is no mapping")
    names = [t.get("track_name") if isinstance(t, dict) else None for t in project.get("tracks") or []]
    resolution = max(1, int(project.get("resolution") or TICKS))
    for part in filter(lambda p: isinstance(p, dict), project.get("voice_parts") or []):
        index, offset = int(part.get("track_no") or 0), int(part.get("position") or 0)
        name = (names[index] if 0 <= index < len(names) else None) or f"Track {index}"
        for note in filter(lambda n: isinstance(n, dict), part.get("notes") or []):
            length, pitch = int(note.get("duration") or 0), int(note.get("tone") or -1)
            if length > 0 and 0 <= pitch <= 127:
                yield ("ustx", index, str(name), resolution, offset + int(note.get("position") or 0), length, pitch, str(note.get("lyric") or ""), float(project["bpm"]) if project.get("bpm") else None)


def decode(data: bytes, codes: tuple[str, ...] = UST_CODES) -> str:
    for code in codes:
        try:
            return data.decode(code)
        except UnicodeError:
            continue
    return data.decode("utf-8", "replace")


def parse_ust(data: bytes) -> Rows:
    """Notes of an INI-like project: lengths add up, rests only move on; a note has the last tempo stated before it."""
    cursor, tempo = 0, None
    for section in re.split(r"(?m)^(?=\[#)", decode(data)):
        head = re.match(r"\[#(\d{4})\]", section)
        values = {k.strip(): v.strip() for k, v in (line.split("=", 1) for line in section.splitlines() if "=" in line)}
        try:
            tempo = float(values["Tempo"])
        except (KeyError, ValueError):
            pass
        length = _number(values.get("Length"), 0)
        if head and length > 0:
            pitch, lyric = _number(values.get("NoteNum"), -1), values.get("Lyric", "")
            if lyric.strip().lower() not in REST_LYRICS and 0 <= pitch <= 127:
                yield ("ust", 0, "", TICKS, cursor, length, pitch, lyric, tempo)
            cursor += length


# MusicXML


def _metronome(e: ET.Element) -> float | None:
    """Quarters a minute of a metronome mark."""
    if _tag(e) != "metronome":
        return None
    try:
        beat = BEATS.get(_value(e, {"beat-unit"}, "quarter"), 1.0) * (1.5 if _value(e, {"beat-unit-dot"}) is not None else 1.0)
        return float(_value(e, {"per-minute"})) * beat or None
    except (TypeError, ValueError):
        return None


def parse_musicxml(data: bytes) -> Rows:
    """Notes of the first part, in quarters; rests have no pitch, grace notes take no time, chords share an onset.

    The tempo is the first sound element's, else the first metronome mark's, its
    beat taken in quarters, else FALLBACK_TEMPO.
    """
    if data[:2] == b"PK":
        data = next(content for name, content in zip_members(data) if name.endswith((".xml", ".musicxml")) and not name.startswith("META-INF"))
    root = ET.fromstring(data)
    tempo = next((float(e.attrib["tempo"]) for e in root.iter() if _tag(e) == "sound" and "tempo" in e.attrib), None) or next(filter(None, map(_metronome, root.iter())), FALLBACK_TEMPO)
    part = next((e for e in root if _tag(e) == "part"), None)
    if part is None:
        raise ValueError("no part")
    divisions, base = 1.0, 0.0
    for measure in (e for e in part if _tag(e) == "measure"):
        cursor = extent = onset = 0.0
        for e in measure:
            kind = _tag(e)
            length = float(_value(e, {"duration"}) or 0) / divisions
            if kind == "attributes":
                divisions = float(_value(e, {"divisions"}) or 0) or divisions
            elif kind == "backup":
                cursor -= length
            elif kind == "forward":
                cursor += length
                extent = max(extent, cursor)
            elif kind == "note":
                inner = {_tag(c): c for c in e}
                grace = "grace" in inner
                onset = onset if "chord" in inner else cursor
                shown = 0.125 if grace and "duration" not in inner else length
                pitch = inner.get("pitch")
                midi = None
                if pitch is not None:
                    midi = 12 * (int(_value(pitch, {"octave"})) + 1) + STEPS[_value(pitch, {"step"}).upper()] + _number(_value(pitch, {"alter"}), 0)
                ties = {c.attrib.get("type") for c in e if _tag(c) == "tie"}
                yield (base + onset, max(0.0, shown), midi, "start" in ties, "stop" in ties, tempo)
                if not grace:
                    cursor = cursor if "chord" in inner else cursor + length
                    extent = max(extent, onset + length)
        base += max(extent, cursor, 0.0)


# audio and archives


def parse_wav(data: bytes, chunk: int = 1 << 16) -> Rows:
    """PCM samples in -1..1, channels averaged, in rows of ``chunk`` samples."""
    with wave.open(io.BytesIO(data)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        first = 0
        while held := w.readframes(chunk):
            if width == 1:
                x = (np.frombuffer(held, np.uint8).astype(np.float32) - 128) / 128
            elif width == 3:
                b = np.frombuffer(held, np.uint8).reshape(-1, 3).astype(np.int32)
                x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8).astype(np.float32) / (1 << 23)
            else:
                x = np.frombuffer(held, f"<i{width}").astype(np.float32) / (1 << (8 * width - 1))
            x = x.reshape(-1, channels).mean(1)
            yield (rate, channels, first, x.tolist())
            first += len(x)


def wav_bytes(samples: np.ndarray, rate: int) -> bytes:
    """A 16-bit mono file of samples in -1..1."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def zip_members(data: bytes) -> Iterator[tuple[str, bytes]]:
    """Files of an archive; an absolute path or one that climbs out is an error."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in z.infolist():
            at = PurePosixPath(info.filename.replace("\\", "/"))
            if at.is_absolute() or ".." in at.parts or ":" in at.parts[0]:
                raise ValueError(f"unsafe member {info.filename}")
            if not info.is_dir():
                yield str(at), z.read(info)


def read_midi(spark: SparkSession, path: str) -> DataFrame:
    return read_files(spark, path, "*.{mid,midi,MID,MIDI}", parse_midi, MESSAGE)


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """Notes of all three kinds of singing-synthesiser projects."""
    kinds = (("*.vsqx", parse_vsqx), ("*.ustx", parse_ustx), ("*.ust", parse_ust))
    parts = [read_files(spark, path, p, f, NOTE) for p, f in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def read_musicxml(spark: SparkSession, path: str) -> DataFrame:
    return read_files(spark, path, "*.{xml,musicxml,mxl}", parse_musicxml, SCORE)


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    return read_files(spark, path, "*.{wav,WAV}", parse_wav, SAMPLES)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return read_files(spark, path, "*.zip", zip_members, "member string, content binary")


def write_files(files: DataFrame, folder: str) -> int:
    """Write one file per row of (path, content) under a folder of any file system Arrow knows; the number written.

    A plain path is one that all executors share. Files appear whole: each is
    written beside its place and moved there.
    """

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                at = f"{root.rstrip('/')}/{path}"
                system.create_dir(at.rpartition("/")[0], recursive=True)
                part = f"{at}.part-{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(bytes(content))
                system.move(part, at)
            yield pd.DataFrame({"n": [len(pdf)]})

    return files.select("path", "content").mapInPandas(local, "n bigint").agg(F.sum("n")).first()[0] or 0


def write_wav(notes: DataFrame, folder: str) -> int:
    """Write one sound file per row of (name, rate, samples) under a folder; the number written."""

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["name"] + ".wav", "content": [wav_bytes(np.asarray(x, np.float32), int(r)) for x, r in zip(pdf["samples"], pdf["rate"])]})

    return write_files(notes.select("name", "rate", "samples").mapInPandas(local, "path string, content binary"), folder)
