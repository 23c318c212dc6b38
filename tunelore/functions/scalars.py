"""Column functions of melody data, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tunelore.functions.text import compatible

NOTE_NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
#: Pitch classes of natural notes, shifts of accidentals, and flat spellings.
NATURALS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
ACCIDENTALS = {"": 0, "#": 1, "##": 2, "x": 2, "b": -1, "bb": -2}
FLATS = {"DB": "C#", "EB": "D#", "GB": "F#", "AB": "G#", "BB": "A#"}
#: A pitch token is a rest, or a letter with at most one accidental and an octave.
_ACCIDENTAL = "|".join(["##?", "bb?", "[x♯♭]"])
PITCH_TOKEN = rf"(?i)(?:[a-g](?:{_ACCIDENTAL})?[-]?[0-9]+|rest)"
NUMBER_TOKEN = r"\d+(?:\.\d+)?(?:/\d+(?:\.\d+)?)?"


def lookup(values: dict) -> Column:
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.lit(v))))


def half_even(x: Column) -> Column:
    """Rounded to the nearest integer, halves to the even one."""
    return F.rint(x).cast("bigint")


def degree(midi: Column, root: Column) -> Column:
    """The rounded pitch's distance above the root, 0..11."""
    return F.pmod(half_even(midi) - root, F.lit(12)).cast("int")


def cents_residual(midi: Column) -> Column:
    """Cents off the nearest semitone, in [-50, 50)."""
    return F.pmod(100.0 * (midi - F.rint(midi)) + 50.0, F.lit(100.0)) - 50.0


def midi_to_hz(midi: Column) -> Column:
    return 440.0 * F.pow(F.lit(2.0), (midi - 69.0) / 12.0)


def note_name(midi: Column) -> Column:
    """Name and octave of a MIDI pitch, 60 being C4."""
    m = half_even(midi)
    return F.concat(F.element_at(F.array(*map(F.lit, NOTE_NAMES)), (F.pmod(m, F.lit(12)) + 1).cast("int")), (F.floor(m / 12) - 1).cast("string"))


def root_from_name(name: Column) -> Column:
    """Pitch class of a note name such as ``F#``, ``gb`` or ``B♭``; null of anything else."""
    sharp = F.upper(F.regexp_replace(F.regexp_replace(F.trim(name), "♭", "b"), "♯", "#"))
    sharp = F.coalesce(lookup(FLATS)[sharp], sharp)
    place = F.array_position(F.array(*map(F.lit, NOTE_NAMES)), sharp)
    return F.when(place > 0, (place - 1).cast("int"))


def token_to_midi(token: Column) -> Column:
    """MIDI pitch of a token such as ``C#4`` or ``E♭-1``; null for a rest, for no token and outside 0..127."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(token), "♯", "#"), "♭", "b")
    part = lambda i: F.regexp_extract(plain, r"(?i)^([A-G])(#{1,2}|b{1,2}|x)?(-?\d+)$", i)
    midi = 12 * (part(3).try_cast("int") + 1) + lookup(NATURALS)[F.upper(part(1))] + lookup(ACCIDENTALS)[F.lower(part(2))]
    return F.when(midi.between(0, 127), midi).cast("int")


def duration_value(token: Column) -> Column:
    """A decimal or fraction such as ``1/3`` in quarters; null unless above 0 and finite."""
    bits = F.split(F.trim(token), "/")
    value = F.when(F.size(bits) == 2, F.try_divide(bits[0].try_cast("double"), F.get(bits, F.lit(1)).try_cast("double"))).otherwise(bits[0].try_cast("double"))
    return F.when((value > 0) & (value < float("inf")), value)


def pitch_tokens(text: Column) -> Column:
    """The pitch and rest tokens of a text, however they are set apart."""
    return F.regexp_extract_all(text, F.lit(PITCH_TOKEN), F.lit(0))


def tempo_or(bpm: Column, fallback: float = 120.0) -> Column:
    """A tempo in 30..240, else the fallback."""
    return F.when(bpm.between(30, 240), bpm).otherwise(F.lit(fallback))


def dbfs(amplitude: Column) -> Column:
    """Level in dB of full scale, at least -120."""
    return F.greatest(F.lit(-120.0), 20.0 * F.log10(F.greatest(amplitude, F.lit(1e-6))))


def ticks_to_seconds(ticks: Column, bpm: Column, ticks_per_beat: int = 480) -> Column:
    return ticks / float(ticks_per_beat) * 60.0 / bpm


def similarity(displacement: Column) -> Column:
    """exp(-d / 3)."""
    return F.exp(-displacement / 3.0)


def loudness_amplitude(rms: Column, loud: Column) -> Column:
    """Amplitude of an event from its level against a loud one: 0.12..0.85."""
    return F.least(F.lit(0.85), F.greatest(F.lit(0.12), 0.12 + 0.62 * rms / loud))


def yes_no(text: Column) -> Column:
    """true, false or null (unknown) of a cell's text."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("yes", "y", "true", "1", "on"), True).when(t.isin("no", "n", "false", "0", "off"), False)


def slug(text: Column) -> Column:
    """Lower-case letters and digits of any script, compatibility forms (NFKC) made plain, joined by ``_``; ``song`` if nothing is left."""
    kept = F.regexp_replace(F.lower(F.trim(compatible(text))), r"[^\p{L}\p{N} \-_.()\[\]{}]", "")
    joined = F.regexp_replace(F.regexp_replace(kept, r"[ \-_.()\[\]{}]+", "_"), "^_+|_+$", "")
    return F.when(F.length(joined) > 0, joined).otherwise("song")


def case_and_condition(filename: Column) -> Column:
    """A test file's case and condition, as a struct; both null if the name has no case."""
    stem = F.regexp_replace(filename, r"\.[^.]*$", "")
    # the case ends with the first "_test", not at the name's start, that ends the stem or has an underscore behind it
    rest = F.substring(stem, F.lit(2), F.length(stem))
    at = F.instr(F.concat(F.lower(rest), F.lit("_")), "_test_")
    case = F.when((at > 0) & F.lower(filename).endswith(".wav"), F.substring(stem, F.lit(1), at + 5)).otherwise("")
    condition = F.when(stem == case, "original").otherwise(F.substring(stem, F.length(case) + 2, F.length(stem)))
    return F.struct(F.when(case != "", case).alias("case"), F.when(case != "", condition).alias("condition"))


def earliest_label(text: Column, aliases: dict[str, list[str]], default: str = "unknown") -> Column:
    """The label whose alias stands first in the text as whole words; of equal places the first by name."""
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), F.lit(" "))
    found = []
    for label, names in aliases.items():
        # of one label, the first listed alias that occurs counts
        place = F.coalesce(*(F.nullif(F.instr(plain, f" {n} "), F.lit(0)) for n in names))
        found.append(F.struct(place.alias("at"), F.lit(label).alias("label")))
    best = F.array_min(F.filter(F.array(*found), lambda x: x["at"].isNotNull()))
    return F.coalesce(best["label"], F.lit(default))


def has_all(text: Column, keywords: list[str]) -> Column:
    """Whether the normalised text holds every keyword."""
    plain = F.regexp_replace(F.lower(F.trim(text)), r"[\s_\-/()\[\]:]+", "")
    return F.forall(F.array(*map(F.lit, keywords)), lambda k: F.contains(plain, k))


def base64_path(text: Column) -> Column:
    """The text that a base64 string holds, or null."""
    return F.try_validate_utf8(F.try_to_binary(text, F.lit("base64")))
