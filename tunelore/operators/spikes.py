"""Implausible spikes, stuck values and impossible readings in measurements, per source.

1. Plausibility: values outside the field's physical range.
2. Stuck: runs of equal consecutive values of a source, found over range-sorted
   chunks whose boundary runs are merged (``tunelore.operators.runs``).
3. Tails: the other values are counted by cells of a fixed grid over the
   field's range, per source and season. Residuals are taken from the season's
   median, a generalised Pareto distribution is fitted to the excesses over a
   high threshold of either tail, and its quantile at a fixed risk is the
   source's cutoff.

The chunk pass holds a bounded piece of its rows at a time and hands on only
what is faulty, what touches a chunk's ends, and the counts, whose number the
grid bounds. The values beyond a cutoff are then read from the table itself.
So a source may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tunelore.operators.runs import CLOSED, FIRST, LAST, RUN_COLUMNS, RUN_FIELDS, WHOLE, Likeness, OpenRun, chunk_count, chunk_number, column, encode_runs, merge_boundaries, pieces, range_chunks
from tunelore.staging import drop, stage

#: A table of one row per source and field is broadcast up to this many rows.
BROADCAST_ROWS = 20_000
#: Cells of a field's plausible range; values of a cell count as its least one in quantiles and cutoffs.
CELLS = 1 << 16
#: Stands for a missing source among the runs' keys.
_NO_SOURCE = -1 << 62


@dataclass(frozen=True)
class Field:
    """A measured column: its plausible range and the length from which a run of equal values is stuck."""

    name: str
    low: float
    high: float
    stuck: int


@dataclass(frozen=True)
class TailRule:
    """The peaks-over-threshold rule.

    share: the share of a source's values beyond the threshold, in either tail.
    risk: the probability of a normal value beyond the cutoff.
    shape: the shape of the fitted tail at most (at least half of it below zero).
    """

    share: float = 0.1
    risk: float = 1e-6
    shape: float = 0.2


@dataclass(frozen=True)
class Measured:
    """A table of measurements: its source, the columns of its time order, its id, its fields, and the season of a row."""

    df: DataFrame
    source: str
    order: list[str]
    ident: str
    fields: list[Field]
    season: Column | None = None

    def base(self) -> DataFrame:
        """source, the order's columns, ident, season, and value_0, value_1, .. of the fields."""
        order = [F.coalesce(F.col(c).cast("double"), F.lit(float("-inf"))).alias(f"order_{i}") for i, c in enumerate(self.order)]
        season = (self.season if self.season is not None else F.lit(0)).cast("int")
        return self.df.select(
            F.col(self.source).cast("bigint").alias("source"), *order, F.col(self.ident).cast("bigint").alias("ident"), F.coalesce(season, F.lit(0)).alias("season"), *(F.col(f.name).cast("double").alias(f"value_{i}") for i, f in enumerate(self.fields))
        )


_VALUE = {"field": pa.int32(), "source": pa.int64(), "season": pa.int32(), "ident": pa.int64(), "value": pa.float64(), "wild": pa.bool_(), "stuck": pa.bool_()}
_COUNT = {"cell": pa.int32(), "held": pa.int64(), "total": pa.float64(), "squares": pa.float64()}
_KINDS = {"bigint": pa.int64(), "double": pa.float64(), "int": pa.int32()}
_RUN = {c: _KINDS[t] for c, t in (x.split() for x in RUN_FIELDS.split(", ")) if c != "end"}
_READING = _VALUE | {"chunk": pa.int32(), "slot": pa.int32(), "head": pa.bool_()} | _COUNT | _RUN
_NAMES = {pa.int32(): "int", pa.int64(): "bigint", pa.float64(): "double", pa.bool_(): "boolean"}


def _reading(rows: int, /, **columns) -> pa.RecordBatch:
    """A batch of ``rows`` readings with the given columns, the others null."""
    given = {c: x if isinstance(x, pa.Array) else pa.array(x, _READING[c]) for c, x in columns.items()}
    return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(rows, t) for c, t in _READING.items()], list(_READING))


def _sources(key: np.ndarray) -> pa.Array:
    return pa.array(key, pa.int64(), mask=key == _NO_SOURCE)


class _FieldChunk:
    """One field's rows of a chunk, piece by piece."""

    def __init__(self, number: int, field: Field, chunk: int):
        self.number, self.field, self.chunk = number, field, chunk
        self.open, self.held, self.begun = OpenRun(Likeness(0.0, None)), None, False

    def take(self, key: np.ndarray, at: np.ndarray, value: np.ndarray, ident: np.ndarray, season: np.ndarray) -> Iterator[pa.RecordBatch]:
        """What is settled after a piece's present values, sorted and with the places ``at`` that tell copies."""
        if not len(key):
            return
        before, limit, was_first = self.open.run, self.field.stuck, self.open.first
        found, number, kept = encode_runs(self.open.like, key, at, at, value, ident, self.chunk)
        rows = [key[kept], value[kept], ident[kept], season[kept]]
        if before and (before["key"], before["last_start"], before["last_id"]) == (key[0], at[0], ident[0]):
            rows, number = [x[1:] for x in rows], number[1:]
        done, went_on = self.open.take(found)
        # runs of the piece by number, the one from before at its front if it ended there
        lengths = np.append(done["n"].to_numpy(np.int64), self.open.run["n"])
        own = np.append(np.arange(len(done)) == 0, False) & was_first
        number = number + (before is not None and not went_on)
        if self.held is not None:
            number = np.concatenate([np.zeros(len(self.held[0]), np.int64), number])
            rows = [np.concatenate([a, b]) for a, b in zip(self.held, rows)]
        last = number == len(lengths) - 1
        wait = last & (lengths[-1] < limit)
        self.held = [x[wait] for x in rows] if wait.any() else None
        slot = np.where(own, FIRST, CLOSED)[number]
        yield from self._rows([x[~wait] for x in rows], lengths[number[~wait]] >= limit, slot[~wait])
        for end in done[done["slot"] == FIRST].to_dict("records"):
            yield self._end(end)

    def close(self) -> Iterator[pa.RecordBatch]:
        for end in self.open.close().to_dict("records"):
            if self.held is not None:
                yield from self._rows(self.held, np.zeros(len(self.held[0]), bool), np.full(len(self.held[0]), end["slot"]))
            yield self._end(end)

    def _end(self, run: dict) -> pa.RecordBatch:
        return _reading(1, field=[self.number], chunk=[self.chunk], slot=[int(run["slot"])], **{c: [run[c] if c.endswith("value") else int(run[c])] for c in _RUN})

    def _rows(self, rows: list[np.ndarray], stuck: np.ndarray, slot: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Faulty rows, those whose state the chunk's boundaries decide, and counts of the others."""
        key, value, ident, season = rows
        n = len(key)
        if not n:
            return
        wild = ~((value >= self.field.low) & (value <= self.field.high))
        # a run that is long enough in its chunk is settled; the chunk's first row may be a copy of the one before it
        slot = np.where(stuck, CLOSED, slot)
        head = np.zeros(n, bool)
        if not self.begun:
            head[0] = self.begun = True
        single = np.flatnonzero(wild | stuck | (slot != CLOSED) | head)
        if len(single):
            yield _reading(
                len(single), field=np.full(len(single), self.number), source=_sources(key[single]), season=season[single], ident=ident[single], value=value[single], wild=wild[single], stuck=stuck[single],
                chunk=np.full(len(single), self.chunk), slot=slot[single], head=head[single],
            )
        plain = ~(wild | stuck | (slot != CLOSED) | head)
        key, value, season = key[plain], value[plain], season[plain]
        if len(key):
            cell = cells(value, self.field)
            order = np.lexsort((value, cell, season, key))
            key, value, season, cell = key[order], value[order], season[order], cell[order]
            begin = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (season[1:] != season[:-1]) | (cell[1:] != cell[:-1])))
            yield _reading(
                len(begin), field=np.full(len(begin), self.number), source=_sources(key[begin]), season=season[begin], value=value[begin], cell=cell[begin],
                held=np.diff(np.append(begin, len(key))), total=np.add.reduceat(value, begin), squares=np.add.reduceat(value * value, begin),
            )


def cells(value: np.ndarray, field: Field) -> np.ndarray:
    """The grid cell of each plausible value."""
    return np.minimum((value - field.low) * (CELLS / (field.high - field.low)), CELLS - 1).astype(np.int32)


def readings(table: Measured, first_field: int = 0) -> tuple[DataFrame, DataFrame]:
    """Faulty values (field, ident, wild, stuck), and counts of the others by field, source, season and cell.

    wild: outside the plausible range. stuck: in a run of equal consecutive
    values of the source, missing values (null, NaN) skipped. Rows that repeat
    in source, order and ident count once. Values without a source are a source
    of their own (null); values without order come first. Fields are numbered
    from ``first_field``. Counts have held (how many), value (the cell's
    least), total and squares (sums).
    """
    fields = table.fields
    base = table.base()
    names = [c for c in base.columns if c.startswith("order_")]
    chunks = chunk_count(base)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = chunk_number()
        own = [_FieldChunk(first_field + i, f, chunk) for i, f in enumerate(fields)]
        for piece in pieces(batches):
            key, ident, season = (pa.compute.fill_null(piece.column(c), _NO_SOURCE if c == "source" else 0).to_numpy() for c in ("source", "ident", "season"))
            # a place's number only tells copies of a row from its neighbours
            place = reduce(lambda a, p: a * 1_000_003 + p.view(np.int64), (column(piece, n) for n in names), np.zeros(len(key), np.int64))
            for i, f in enumerate(own):
                value = column(piece, f"value_{i}")
                there = ~np.isnan(value)
                yield from f.take(key[there], place[there], value[there], ident[there], season[there])
        for f in own:
            yield from f.close()

    schema = ", ".join(f"{c} {_NAMES[t]}" for c, t in _READING.items())
    told = stage(range_chunks(base, ["source", *names], "ident", chunks).mapInArrow(local, schema), "readings")
    ends = told.filter(F.col("key").isNotNull()).select("field", *(F.lit(0).cast("bigint").alias(c) if c == "end" else F.col(c) for c in RUN_COLUMNS), "chunk", "slot")
    limits = F.element_at(F.array(*(F.lit(f.stuck) for f in fields)), F.col("field") + 1 - first_field)
    crossing = merge_boundaries(ends, Likeness(0.0, None), chunks, ["field"]).filter((F.col("chunk_from") < F.col("chunk_to")) & (F.col("n") >= limits))
    # the ends of chunks that a long enough crossing run covers: of its first chunk the last run, of its last chunk the first one, of those between all
    spans = crossing.select("field", "chunk_from", "chunk_to", F.explode(F.sequence("chunk_from", "chunk_to")).alias("chunk")).select(
        "field", "chunk", F.explode(F.when(F.col("chunk") == F.col("chunk_from"), F.array(F.lit(LAST), F.lit(WHOLE))).when(F.col("chunk") == F.col("chunk_to"), F.array(F.lit(FIRST), F.lit(WHOLE))).otherwise(F.array(F.lit(WHOLE)))).alias("slot"),
    ).distinct().withColumn("_joined", F.lit(True))
    single = told.filter(F.col("ident").isNotNull()).select(*_VALUE, "chunk", "slot", "head")
    # a chunk's first row may be a copy of the last one before it
    first, last = (F.struct("key", *c) for c in (("start", "first_id"), ("last_start", "last_id")))
    tips = ends.groupBy("field", "chunk").agg(F.min_by(first, "slot").alias("first"), F.max_by(last, "slot").alias("last"))
    again = tips.withColumn("before", F.lag("last").over(W.partitionBy("field").orderBy("chunk"))).filter(reduce(lambda x, y: x & y, (F.col(f"first.{a}") == F.col(f"before.{b}") for a, b in (("key", "key"), ("start", "last_start"), ("first_id", "last_id")))))
    again = again.select("field", "chunk", F.lit(True).alias("head"))
    edge = (F.col("slot") != CLOSED) | F.col("head")
    settled = single.filter(edge).join(again, ["field", "chunk", "head"], "left_anti").join(spans, ["field", "chunk", "slot"], "left").withColumn("stuck", F.coalesce("_joined", "stuck"))
    settled = stage(settled.select(*_VALUE), "settled")
    faulty = single.filter(~edge).select(*_VALUE).unionByName(settled.filter(F.col("wild") | F.col("stuck"))).select("field", "ident", "wild", "stuck")
    low, width = (F.element_at(F.array(*(F.lit(float(x)) for x in xs)), F.col("field") + 1 - first_field) for xs in ([f.low for f in fields], [CELLS / (f.high - f.low) for f in fields]))
    late = settled.filter(~F.col("wild") & ~F.col("stuck")).select(
        "field", "source", "season", F.least(F.floor((F.col("value") - low) * width), F.lit(CELLS - 1)).cast("int").alias("cell"), "value", F.lit(1).cast("bigint").alias("held"), F.col("value").alias("total"), (F.col("value") * F.col("value")).alias("squares")
    )
    counts = told.filter(F.col("held").isNotNull()).select("field", "source", "season", "value", *_COUNT).unionByName(late)
    return faulty, counts


def frequencies(counts: DataFrame) -> DataFrame:
    """Staged counts by field, source, season and cell: value (the least), n, total, squares."""
    return stage(counts.groupBy("field", "source", "season", "cell").agg(F.min("value").alias("value"), F.sum("held").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares")), "frequencies")


def _same(a: str, b: str, by: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by))


def cutoffs(freq: DataFrame, rule: TailRule = TailRule()) -> DataFrame:
    """Of each field, source and season: centre, and both tails' cutoffs, in values.

    Thresholds and fits are the source's, over its seasonal residuals. The
    generalised Pareto distribution of the excesses over the threshold is
    fitted by their quartiles (its median and upper quartile), which spikes
    among the peaks hardly move; the shape lies between -``rule.shape`` / 2
    and ``rule.shape``. A tail whose excesses have no spread has its cutoff at the
    threshold.
    """
    by = ["field", "source"]
    centre = freq.groupBy(*by, "season").agg(F.percentile("value", F.lit(0.5), F.col("n")).alias("centre"))
    res = freq.alias("f").join(centre.alias("c"), _same("f", "c", [*by, "season"])).select(*(F.col(f"f.{c}").alias(c) for c in by), "f.n", (F.col("f.value") - F.col("c.centre")).alias("residual"))
    at = [1 - rule.share, 1 - rule.share / 2, 1 - rule.share / 4, rule.share, rule.share / 2, rule.share / 4]
    fit = res.groupBy(*by).agg(F.percentile("residual", F.array(*map(F.lit, at)), F.col("n")).alias("q"), F.sum("n").alias("values"))
    for side, sign, i in (("high", 1.0, 0), ("low", -1.0, 3)):
        u, half, quarter = (sign * F.col("q")[i + j] for j in range(3))
        m, spread = half - u, quarter - half
        shape = F.when((m > 0) & (spread > 0), F.least(F.greatest(F.log(spread / m) / float(np.log(2)), F.lit(-rule.shape / 2)), F.lit(rule.shape))).otherwise(F.lit(0.0))
        # the excess that half of the peaks exceed tells the scale, or where ties hide it the quarter's
        k = F.when(F.abs(shape) < 1e-9, F.lit(1e-9)).otherwise(shape)
        scale = F.greatest(m * k / (F.pow(F.lit(2.0), k) - 1), (quarter - u) * k / (F.pow(F.lit(4.0), k) - 1))
        reach = u + F.greatest(scale * (F.pow(F.lit(rule.share / rule.risk), k) - 1) / k, F.lit(0.0))
        fit = fit.withColumn(f"reach_{side}", reach)
    return centre.alias("c").join(fit.alias("t"), _same("c", "t", by)).select(
        *(F.col(f"c.{c}").alias(c) for c in [*by, "season", "centre"]), "t.values", (F.col("c.centre") + F.col("t.reach_high")).alias("cut_high"), (F.col("c.centre") - F.col("t.reach_low")).alias("cut_low"),
    )


def _level(good: DataFrame) -> DataFrame:
    """Mean and standard deviation of each field and source of counts."""
    n = F.sum("n")
    return good.groupBy("field", "source").agg((F.sum("total") / n).alias("mean"), F.sqrt(F.greatest(F.sum("squares") / n - F.pow(F.sum("total") / n, F.lit(2)), F.lit(0.0))).alias("sd"), n.alias("good"))


def confirmed(freq: DataFrame, cuts: DataFrame, sigmas: float) -> tuple[DataFrame, DataFrame]:
    """Mean and deviation of each field and source over its faultless values, and the counts that are no faults.

    The candidates are the values beyond their cutoffs; at first all of them
    are faults. Mean and deviation are taken over the other values, and
    candidates within ``sigmas`` deviations of the mean are faults no more,
    until none is released. As faults only grow fewer, this ends.
    """
    by = ["field", "source"]
    beyond = (F.col("f.value") > F.col("k.cut_high")) | (F.col("f.value") < F.col("k.cut_low"))
    judged = stage(freq.alias("f").join(cuts.alias("k"), _same("f", "k", [*by, "season"])).select("f.*", beyond.alias("fault")), "judged")
    while True:
        level = stage(_level(judged.filter(~F.col("fault"))), "level")
        free = F.coalesce(F.abs(F.col("j.value") - F.col("l.mean")) <= sigmas * F.col("l.sd"), F.lit(False))
        after = judged.alias("j").join(level.alias("l"), _same("j", "l", by), "left").select("j.field", "j.source", "j.season", "j.cell", "j.value", "j.n", "j.total", "j.squares", "j.fault", free.alias("free"))
        if not after.filter(F.col("fault") & F.col("free")).limit(1).count():
            return level, judged.filter(~F.col("fault"))
        before, judged = judged, stage(after.select(*judged.columns[:-1], (F.col("fault") & ~F.col("free")).alias("fault")), "judged")
        drop(before)
        drop(level)


def spikes(tables: list[Measured], rule: TailRule | None = None, sigmas: float | None = None) -> DataFrame:
    """Cases (field, record_id, reason): reason lists ``range``, ``stuck`` and ``tail``, joined by ``+``.

    A value is in the tail beyond its source's peaks-over-threshold cutoff.
    With ``sigmas``, values beyond the cutoffs are candidates only, and an exact
    check keeps those more than so many standard deviations from the mean of
    the source's faultless values; cutoffs and check are taken again without
    the faults until they stay. The risk is then 1 / (1 + sigmas²) unless a rule
    is given: no distribution has a larger share beyond so many deviations on
    one side (Cantelli), so its quantile at that risk is never farther out than
    the check. Missing values are never cases; an empty table
    has none. After the chunk pass, the fields of all tables are judged
    together.
    """
    rule = rule or (TailRule() if sigmas is None else TailRule(risk=1 / (1 + sigmas * sigmas)))
    fields = [f for t in tables for f in t.fields]
    starts = [sum(len(t.fields) for t in tables[:i]) for i in range(len(tables))]
    faulty, counts = zip(*(readings(t, n) for t, n in zip(tables, starts)))
    freq = frequencies(reduce(DataFrame.unionByName, counts))
    by = ["field", "source", "season"]
    good, size = freq, None
    while True:
        cuts = stage(cutoffs(good, rule), "cutoffs")
        if sigmas is None:
            bounds = cuts.select(*by, F.col("cut_low").alias("low"), F.col("cut_high").alias("high"))
            break
        level, good = confirmed(freq, cuts, sigmas)
        low, high = F.col("l.mean") - sigmas * F.col("l.sd"), F.col("l.mean") + sigmas * F.col("l.sd")
        bounds = stage(cuts.alias("c").join(level.alias("l"), _same("c", "l", by[:2])).select(
            *(F.col(f"c.{c}").alias(c) for c in by), F.least("c.cut_low", low).alias("low"), F.greatest("c.cut_high", high).alias("high"), ((F.col("c.cut_low") < low) | (F.col("c.cut_high") > high)).alias("farther"),
        ), "bounds")
        # where no cutoff is farther out than the check, nearer ones would change nothing
        if not bounds.filter("farther").limit(1).count():
            break
        now = good.agg(F.sum("n")).first()[0]
        # nor does a fit that has no more faults than the last one
        if size is not None and now >= size:
            break
        size = now
    small = bounds.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    found = [x.select("field", "ident", "wild", "stuck", F.lit(False).alias("tail")) for x in faulty]
    for t, first in zip(tables, starts):
        values = F.explode(F.array(*(F.struct(F.lit(first + i).alias("field"), F.col(f"value_{i}").alias("value")) for i in range(len(t.fields))))).alias("v")
        present = t.base().select("source", "season", F.coalesce("ident", F.lit(0)).alias("ident"), values).select("source", "season", "ident", "v.*").filter(F.col("value").isNotNull() & ~F.isnan("value"))
        far = present.alias("v").join((F.broadcast(bounds) if small else bounds).alias("b"), _same("v", "b", by)).filter((F.col("v.value") > F.col("b.high")) | (F.col("v.value") < F.col("b.low")))
        found.append(far.select("v.field", "v.ident", F.lit(False).alias("wild"), F.lit(False).alias("stuck"), F.lit(True).alias("tail")))
    whole = reduce(DataFrame.unionByName, found).groupBy("field", "ident").agg(*(F.max(c).alias(c) for c in ("wild", "stuck", "tail")))
    reason = F.concat_ws("+", F.when(F.col("wild"), "range"), F.when(F.col("stuck"), "stuck"), F.when(F.col("tail"), "tail"))
    return whole.select(F.element_at(F.array(*(F.lit(f.name) for f in fields)), F.col("field") + 1).alias("field"), F.col("ident").alias("record_id"), reason.alias("reason"))
