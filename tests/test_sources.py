"""Readers of scores, projects, audio and lists, on hand-made files."""

import io
import struct
import zipfile

import numpy as np
import pytest

from tunelore.sources import lists, scores


def midi(*tracks: bytes) -> bytes:
    return b"MThd" + struct.pack(">IHHH", 6, 1, len(tracks), 480) + b"".join(b"MTrk" + struct.pack(">I", len(t)) + t for t in tracks)


TRACK = b"\x00\xff\x03\x04Lead" + b"\x00\xff\x51\x03\x07\xa1\x20" + b"\x00\x90\x3c\x40" + b"\x83\x60\x3c\x00" + b"\x00\xe0\x00\x50" + b"\x10\xb0\x65\x00" + b"\x00\xc0\x05" + b"\x00\xf0\x01\xf7" + b"\x00\xff\x2f\x00"


def test_midi(spark, tmp_path):
    (tmp_path / "a.mid").write_bytes(midi(TRACK))
    (tmp_path / "b.mid").write_bytes(b"nonsense")
    rows = scores.read_midi(spark, str(tmp_path)).collect()
    good = [(r["tick"], r["type"], r["note"], r["velocity"], r["value"], r["tempo"], r["name"]) for r in rows if r["error"] is None]
    assert good == [
        (0, "track_name", None, None, None, None, "Lead"), (0, "set_tempo", None, None, None, 500000, None), (0, "note_on", 60, 64, None, None, None), (480, "note_off", 60, 0, None, None, None),
        (480, "pitchwheel", None, None, 2048, None, None), (496, "control_change", None, None, 0, None, None), (496, "program_change", None, None, 5, None, None), (496, "end_of_track", None, None, None, None, None),
    ]
    assert [r["error"] for r in rows if r["error"]] == ["ValueError: no MIDI header"]


def test_projects(spark, tmp_path):
    (tmp_path / "a.vsqx").write_text('<vsq4 xmlns="x"><masterTrack><resolution>480</resolution></masterTrack><vsTrack><tNo>1</tNo><name>Miku</name><vsPart><t>100</t><note><t>10</t><dur>20</dur><n>60</n><y>la</y></note><note><t>40</t><dur>0</dur><n>61</n></note></vsPart></vsTrack></vsq4>')
    (tmp_path / "b.ustx").write_text("resolution: 960\ntracks:\n- track_name: Voice\nvoice_parts:\n- track_no: 0\n  position: 5\n  notes:\n  - {position: 1, duration: 7, tone: 64, lyric: a}\n  - {position: 9, duration: 7, tone: 0, lyric: b}\n")
    (tmp_path / "c.ust").write_bytes("[#SETTING]\r\nTempo=120.00\r\n[#0000]\r\nLength=480\r\nLyric=R\r\nNoteNum=60\r\n[#0001]\r\nLength=240\r\nLyric=あ\r\nNoteNum=62\r\n[#TRACKEND]\r\n".encode("cp932"))
    rows = {(r["format"], r["track"], r["track_name"], r["resolution"], r["start"], r["duration"], r["pitch"], r["lyric"]) for r in scores.read_projects(spark, str(tmp_path)).collect()}
    assert rows == {("vsqx", 1, "Miku", 480, 110, 20, 60, "la"), ("ustx", 0, "Voice", 960, 6, 7, 64, "a"), ("ust", 0, "", 480, 480, 240, 62, "あ")}


XML = """<score-partwise><part id="P1"><measure><attributes><divisions>2</divisions></attributes><sound tempo="96"/>
<note><pitch><step>C</step><octave>4</octave></pitch><duration>2</duration><tie type="start"/></note>
<note><chord/><pitch><step>E</step><alter>-1</alter><octave>4</octave></pitch><duration>2</duration></note>
<note><grace/><pitch><step>D</step><octave>4</octave></pitch></note>
<note><rest/><duration>4</duration></note><backup><duration>6</duration></backup><note><pitch><step>G</step><octave>3</octave></pitch><duration>6</duration></note></measure>
<measure><note><pitch><step>B</step><octave>4</octave></pitch><duration>1</duration></note></measure></part></score-partwise>"""


def test_musicxml(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("META-INF/container.xml", "<x/>")
        z.writestr("score.xml", XML)
    (tmp_path / "b.mxl").write_bytes(packed.getvalue())
    rows = scores.read_musicxml(spark, str(tmp_path)).collect()
    for name in ("a.xml", "b.mxl"):
        got = [(r["start_q"], r["duration_q"], r["midi"], r["tie_start"]) for r in rows if r["path"].endswith(name)]
        assert got == [(0.0, 1.0, 60, True), (0.0, 1.0, 63, False), (1.0, 0.125, 62, False), (1.0, 2.0, None, False), (0.0, 3.0, 55, False), (3.0, 0.5, 71, False)]
    assert {r["tempo"] for r in rows} == {96.0}


def test_wav_and_archives(spark, tmp_path):
    x = np.sin(np.arange(3000) / 10).astype(np.float32) / 2
    df = spark.createDataFrame([("tone", 8000, x.tolist())], "name string, rate int, samples array<float>")
    assert scores.write_wav(df, str(tmp_path)) == 1
    rows = scores.read_wav(spark, str(tmp_path)).collect()
    assert [(r["rate"], r["channels"], r["first"], len(r["samples"])) for r in rows] == [(8000, 1, 0, 3000)]
    assert np.abs(np.array(rows[0]["samples"]) - x).max() < 1e-4
    for name, member in (("good.zip", "a/b.txt"), ("bad.zip", "../b.txt")):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr(member, "x")
    got = {r["path"].rsplit("/", 1)[1]: (r["member"], bytes(r["content"] or b""), (r["error"] or "")[:24]) for r in scores.read_archives(spark, str(tmp_path)).collect()}
    assert got == {"good.zip": ("a/b.txt", b"x", ""), "bad.zip": (None, b"", "ValueError: unsafe membe")}


def test_lists(spark, tmp_path):
    (tmp_path / "m.csv").write_text("enabled,url,id,title\n1, http://a ,x,A\nno,http://b,y,B\n,http://c,z,C\nyes,,w,D\n")
    assert [(r["url"], r["title"]) for r in lists.read_manifest(spark, str(tmp_path / "m.csv")).collect()] == [("http://a", "A"), ("http://c", "C")]
    pages = spark.createDataFrame([(1, "<a href='x.mid'>One <b>two</b></a><A HREF=\"/y.html\">no</A>"), (2, None)], "page_id bigint, html string")
    assert [(r["pos"], r["href"], r["text"]) for r in lists.links(pages).collect()] == [(0, "x.mid", "One two"), (1, "/y.html", "no")]
    assert lists.midi_links(pages).count() == 1
    df = spark.createDataFrame([(1, ""), (2, "notes<3"), (3, None)], "id int, reason string")
    lists.write_split(df, "reason", str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out/accepted"), header=True).count() == 2
    blind = lists.blind_pack(spark.createDataFrame([("c", f"{i}.wav") for i in range(9)], "case string, name string"), "case", "name", 3).collect()
    assert sorted(r["blind_id"] for r in blind) == list(range(1, 10)) and len({r["original"] for r in blind}) == 9
    lists.write_report(df, "id", str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 3


@pytest.mark.parametrize("width", [1, 2, 3])
def test_sample_widths(width):
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2), w.setsampwidth(width), w.setframerate(100)
        half = {1: b"\xc0", 2: b"\x00\x40", 3: b"\x00\x00\x40"}[width]
        w.writeframes(half * 4)
    assert [r[3] for r in scores.parse_wav(out.getvalue())] == [[0.5, 0.5]]
