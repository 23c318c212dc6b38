"""Subject areas of documents, from classifiers of their sentences.

Texts are cleaned (layouts, escapes, wrong decoding, invisible characters) and
cut into sentences without remarks. One-versus-rest linear classifiers on
hashed word n-grams are fitted to the sentences of labelled texts, by
regularised least squares in its dual form; its closed-form leave-one-out
scores show which labels are wrong and calibrate each subject's threshold. The
model is a small matrix; every document's sentences are scored with it.
"""

from __future__ import annotations

import functools
import html
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelore.llm.tokens import distinct_texts

#: Hash space of the features, and sentences of labelled texts used at most, those of the least hashes: the bound of the fit, whose memory is 24 bytes times its square.
DIMENSIONS, MOST_SENTENCES = 1 << 18, 4000
#: Weight of the squared weights; features of a block; the least threshold of a subject.
RIDGE, FEATURE_BLOCK, LEAST_THRESHOLD = 0.3, 4096, 0.05

_TAGS = re.compile(r"</?(?:p|br|div|li|ul|ol|h\d|span|b|i|em|strong|td|tr|table)\b[^>]*>", re.I)
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_ESCAPED = re.compile(r"\\u([0-9a-fA-F]{4})")
_LINE_MARK = re.compile(r"^\s*(?:[-*•>#|]+\s+|\d+[.)]\s+|\[\d+:\d+(?::\d+)?\]\s*)+")
_BRACKETS = re.compile(r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}")
_DIGIT = re.compile(r"\d")
_DASH = re.compile(r"\s+(?:[–—]|--?)\s+.*$", re.S)
#: Abbreviations before which and after which no sentence ends.
_SHORT = {"cf", "no", "nr", "vgl", "n", "nº", "bzw", "ca", "st", "dr", "mr", "mrs", "op", "vol", "p", "pp", "art", "abs", "núm"}
_LAST_WORD = re.compile(r"[^\W_]+$")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_ENDS = re.compile(r"[.!?…]+[\"'»”)]*\s+")
#: Single letters with an accidental or octave, and other tokens of note lists, are no words.
_NOTE = re.compile(r"\b[A-Ha-h](?:[#b♯♭])?-?\d\b")


def repair(text: str) -> str:
    """``text`` with UTF-8 that was read as a one-byte code put right, where that can be told."""
    if not re.search("[ÂÃâ]", text):
        return text
    out = []
    for part in re.split(r"(\s+)", text):
        if re.search("[ÂÃâ]", part):
            for code in ("cp1252", "latin-1"):
                try:
                    part = part.encode(code).decode("utf-8")
                    break
                except UnicodeError:
                    continue
        out.append(part)
    return "".join(out)


def plain(text: str) -> str:
    """Readable text of a document in any layout, one block a line."""
    text = text.strip("\ufeff \t\r\n")
    if text[:1] in "{[":
        try:
            held = json.loads(text)
        except ValueError:
            held = None
        if isinstance(held, (dict, list)):
            text = "\n".join(_strings(held))
    for _ in range(2):
        text = html.unescape(text)
    text = _ESCAPED.sub(lambda m: chr(int(m[1], 16)), text)
    text = re.sub(r"\\[nrt]", "\n", text)
    text = _INVISIBLE.sub("", repair(text))
    text = _TAGS.sub("\n", text)
    return unicodedata.normalize("NFKC", text)


def _strings(held) -> Iterator[str]:
    """Strings of more than one word in a JSON value, in order."""
    todo = [held]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if " " in x.strip():
                yield x
        elif isinstance(x, (dict, list)):
            todo.extend(reversed(list(x.values()) if isinstance(x, dict) else x))


def words(sentence: str) -> list[str]:
    """The words of a sentence; notes with their octave are none."""
    return _WORD.findall(_NOTE.sub(" ", sentence) if _DIGIT.search(sentence) else sentence)


def told(text: str | None) -> Iterator[tuple[str, list[str]]]:
    """The sentences of a text and their words, remarks in brackets and after a dash taken out; those of fewer than two words are none."""
    for line in plain(text or "").splitlines():
        line = _LINE_MARK.sub("", line).strip()
        at = 0
        for end in [*(m.end() for m in _ENDS.finditer(line) if not _abbreviated(line, m.start())), len(line)]:
            kept = line[at:end].strip()
            at = end
            if "(" in kept or "[" in kept or "{" in kept:
                kept = _BRACKETS.sub(" ", kept)
            if ("-" in kept or "–" in kept or "—" in kept) and _DASH.search(kept) and _WORD.search(bare := _DASH.sub("", kept)):
                kept = bare
            held = words(kept)
            if len(held) >= 2:
                yield kept, held


def sentences(text: str | None) -> list[str]:
    """The sentences of a text, as ``told`` has them."""
    return [s for s, _ in told(text)]


def _abbreviated(line: str, end: int) -> bool:
    before = _LAST_WORD.search(line, max(0, end - 8), end)
    return bool(before) and before[0].lower() in _SHORT


@functools.lru_cache(maxsize=200_000)
def _word(word: str) -> tuple[bytes, int, tuple[int, ...]]:
    """A word after a blank as bytes, its checksum, and the hashes of it, its beginning and its ending, without case."""
    word = word.casefold()
    own = zlib.crc32(word.encode())
    parts = [own]
    if len(word) > 5:
        parts.append(zlib.crc32(f"{word[:5]}*".encode()))
    if len(word) > 7:
        parts.append(zlib.crc32(f"*{word[-5:]}".encode()))
    return f" {word}".encode(), own, tuple(h % DIMENSIONS for h in parts)


def features(held: list[str]) -> list[int]:
    """Hashed words, word pairs, and beginnings and endings of longer words, each once."""
    out: set[int] = set()
    before = None
    for w in map(_word, held):
        out.update(w[2])
        if before is not None:
            out.add(zlib.crc32(w[0], before) % DIMENSIONS)
        before = w[1]
    return list(out)


@dataclass
class Model:
    """subjects, weights (feature x subject; zero for features never seen), the features' idf, and a threshold per subject."""

    subjects: list[str]
    slots: np.ndarray  # feature -> row of weights, -1 where unseen
    weights: np.ndarray
    idf: np.ndarray
    unseen: float
    thresholds: np.ndarray

    def scores(self, held: list[list[str]]) -> np.ndarray:
        """A row of scores, one per subject, for each sentence, given as its words; one without known features has zeros."""
        rows = [features(w) for w in held]
        of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        slots = self.slots[np.fromiter(chain.from_iterable(rows), np.int64, len(of))]
        idf = np.where(slots >= 0, self.idf[slots], self.unseen)
        norm = np.sqrt(np.bincount(of, idf * idf, len(rows)))
        known = slots >= 0
        part = (idf / np.maximum(norm[of], 1e-9))[known, None] * self.weights[slots[known]]
        return np.stack([np.bincount(of[known], part[:, j], len(rows)) for j in range(len(self.subjects))], 1)


def _fit(rows: list[list[int]], y: np.ndarray, groups: np.ndarray):
    """Weights, idf and leave-one-out scores of least squares on the given feature rows; features are taken in blocks."""
    seen = np.unique(np.concatenate([np.array(r, np.int64) for r in rows]))
    slots = np.full(DIMENSIONS, -1, np.int32)
    slots[seen] = np.arange(len(seen))
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at = slots[np.concatenate([np.array(r, np.int64) for r in rows])]
    df = np.bincount(at, minlength=len(seen))
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    value = idf[at] / np.sqrt(np.bincount(of, idf[at] ** 2, len(rows)))[of]

    def blocks() -> Iterator[tuple[int, np.ndarray]]:
        for start in range(0, len(seen), FEATURE_BLOCK):
            x = np.zeros((len(rows), min(FEATURE_BLOCK, len(seen) - start)), np.float32)
            own = (at >= start) & (at < start + FEATURE_BLOCK)
            x[of[own], at[own] - start] = value[own]
            yield start, x

    kernel = RIDGE * np.eye(len(rows))
    for _, x in blocks():
        kernel += x @ x.T
    inverse = np.linalg.inv(kernel)
    del kernel
    alpha = inverse @ y
    # the held-out scores of a text leave out all of its sentences
    held = np.zeros_like(y)
    for g in np.unique(groups):
        i = np.flatnonzero(groups == g)
        held[i] = y[i] - np.linalg.solve(inverse[np.ix_(i, i)], alpha[i])
    weights = np.zeros((len(seen), y.shape[1]), np.float32)
    for start, x in blocks():
        weights[start : start + x.shape[1]] = x.T @ alpha
    return slots, weights, idf, held


def fit(rows: list[list[int]], groups: list[int], labels: list[str]) -> tuple[Model, dict]:
    """A model from the features of sentences of labelled texts (``groups``), each about one subject; a few labels may be wrong.

    The subjects are those of the labels. Texts whose held-out scores clearly
    favour another subject are left out of the second fit, unless nothing of
    their subject is left then. Thresholds lie where a subject's held-out
    scores are best told from the others'. Also returns measures of the
    held-out scores.
    """
    subjects = sorted(set(labels))
    of = np.array([subjects.index(x) for x in labels])
    groups = np.unique(groups, return_inverse=True)[1]
    *_, held = _fit(rows, np.eye(len(subjects))[of], groups)
    total = np.zeros((groups.max() + 1, len(subjects)))
    np.add.at(total, groups, held)
    own = np.zeros(len(total), int)
    own[groups] = of
    wrong = total.argmax(1) != own
    wrong &= np.isin(own, own[~wrong])
    kept = ~wrong[groups]
    rows, groups, of = [r for r, k in zip(rows, kept) if k], groups[kept], of[kept]
    slots, weights, idf, held = _fit(rows, np.eye(len(subjects))[of], groups)
    thresholds = np.zeros(len(subjects))
    for j in range(len(subjects)):
        # nearer to the others' high scores, which new words don't raise, than to the subject's low ones, which they lower
        others = held[of != j, j]
        high, low = np.quantile(others, 0.995) if len(others) else 0.0, np.quantile(held[of == j, j], 0.02)
        thresholds[j] = max(LEAST_THRESHOLD, high + 0.3 * max(0.0, low - high))
    measures = {"texts": len(total), "left_out": int(wrong.sum()), "sentences": len(rows), "accuracy": float((held.argmax(1) == of).mean()), "recall": float(np.mean(held[np.arange(len(of)), of] > thresholds[of]))}
    return Model(subjects, slots, weights, idf, float(np.log(1 + len(rows)) + 1), thresholds), measures


def labelled_sentences(examples: DataFrame, subjects: DataFrame, most: int) -> DataFrame:
    """Rows (example_id, subject, n, features) of the sentences of usable examples, ``most`` of them at most: those of the least hashes."""
    kind = examples.schema["example_id"].dataType.simpleString()
    usable = examples.select("example_id", "text", "subject").dropna().dropDuplicates(["example_id"]).join(subjects.select("subject").distinct(), "subject", "left_semi")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, n, held = [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                for k, (_, own) in enumerate(told(text)):
                    at.append(i), n.append(k), held.append(features(own))
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("example_id").take(rows), b.column("subject").take(rows), pa.array(n, pa.int32()), pa.array(held, pa.list_(pa.int32()))], ["example_id", "subject", "n", "features"])

    rows = usable.select("example_id", "subject", "text").mapInArrow(local, f"example_id {kind}, subject string, n int, features array<int>")
    return rows.orderBy(F.xxhash64("example_id", "n"), "example_id", "n").limit(most)


def document_subjects(documents: DataFrame, examples: DataFrame, subjects: DataFrame, share: float = 0.25, most_sentences: int = MOST_SENTENCES) -> DataFrame:
    """One row (doc_id, subject, about, n_sentences) for each subject of each document.

    A document is about a subject if ``about`` of its sentences are, and these
    are at least ``share`` of all, or one in a text of one to three sentences.
    A sentence is about the subject of its best score above that subject's
    threshold, or above half of it where another sentence of the text is about
    that subject: what a sentence about something else says besides is a
    remark. Rows of one doc_id are one document, a row without doc_id is one
    of its own; null and empty texts and
    those without words have no subject. The model is fitted to at most
    ``most_sentences`` sentences of ``examples`` (example_id, text, subject),
    those of the least hashes; examples of unlisted subjects or without text
    are ignored, a subject without any usable example is no document's, and
    without any usable example at all no document has a subject.
    """
    sc = documents.sparkSession.sparkContext
    labelled = sorted(labelled_sentences(examples, subjects, most_sentences).collect(), key=lambda r: (r["example_id"], r["n"]))
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, subject string, about int, n_sentences int"
    if not labelled:
        return documents.sparkSession.createDataFrame([], schema)
    held = sc.broadcast(fit([list(r["features"]) for r in labelled], [r["example_id"] for r in labelled], [r["subject"] for r in labelled])[0])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in batches:
            texts = [[w for _, w in told(t)] for t in b.column(1).to_pylist()]
            doc, subject, about, total = [], [], [], []
            scores = model.scores(list(chain.from_iterable(texts)))
            ratio = scores / model.thresholds
            best = np.zeros(ratio.shape, bool)
            best[np.arange(len(best)), scores.argmax(1) if len(best) else []] = True
            sure = best & (ratio > 1)
            at = 0
            for i, t in enumerate(texts):
                own = slice(at, at + len(t))
                at += len(t)
                clear = sure[own].any(0)
                counts = (clear & best[own] & (ratio[own] > 0.5)).sum(0)
                for j in np.flatnonzero(counts >= (1 if len(t) <= 3 else share * len(t))):
                    if counts[j]:
                        doc.append(i), subject.append(model.subjects[j]), about.append(int(counts[j])), total.append(len(t))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc, pa.int64())), pa.array(subject, pa.string()), pa.array(about, pa.int32()), pa.array(total, pa.int32())], ["doc_id", "subject", "about", "n_sentences"])

    return distinct_texts(documents, "doc_id", "text").mapInArrow(local, schema)


def composition(found: DataFrame) -> DataFrame:
    """Of each subject: its documents, and its sentences in them."""
    return found.groupBy("subject").agg(F.count("*").alias("documents"), F.sum("about").cast("bigint").alias("sentences"))
