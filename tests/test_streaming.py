"""Streams give what the batch forms give."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tunelore.operators.events import melody_events
from tunelore.operators.phrases import PhraseRule
from tunelore.streaming import events as s


@pytest.fixture(scope="module")
def timed(spark, tmp_path_factory):
    """Note events with onset times, in two files, the second one later; and a last event far ahead that moves the watermark."""
    folder = str(tmp_path_factory.mktemp("stream"))
    ev = melody_events(spark, "/root/testdata/sf0.001").filter("file_id <= 6").withColumn("ts", F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("start_frame") * 10))
    ev = ev.select("file_id", "seq", "ts", "channel", "start_frame", "end_frame", "frames", "midi_cents")
    for part in (ev.filter("start_frame < 600"), ev.filter("start_frame >= 600")):
        part.coalesce(1).write.mode("append").parquet(folder)
    last = ev.limit(1).select(F.lit(-1).cast("bigint").alias("file_id"), F.lit(1).alias("seq"), (F.col("ts") + F.expr("interval 10 days")).alias("ts"), "channel", "start_frame", "end_frame", "frames", "midi_cents")
    last.coalesce(1).write.mode("append").parquet(folder)
    return folder, ev


def run(spark, folder, build, name):
    source = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = build(source).writeStream.outputMode("append").format("memory").queryName(name).start()
    try:
        query.processAllAvailable()
        return [r for r in spark.table(name).collect()]
    finally:
        query.stop()


def test_windows(spark, timed):
    folder, ev = timed
    got = {(r["window_start"], r["channel"]): (r["n_events"], r["frames"]) for r in run(spark, folder, lambda d: s.windowed_counts(d, "2 seconds"), "windows")}
    batch = {(r["w"]["start"], r["channel"]): (r["n"], r["f"]) for r in ev.groupBy(F.window("ts", "2 seconds").alias("w"), "channel").agg(F.count("*").alias("n"), F.sum("frames").alias("f")).collect()}
    assert got == batch


def test_sessions(spark, timed):
    folder, ev = timed
    got = sorted((r["file_id"], r["n_events"], r["frames"]) for r in run(spark, folder, lambda d: s.gap_sessions(d, 15), "sessions"))
    w = W.partitionBy("file_id").orderBy("seq")
    fresh = F.coalesce(F.col("start_frame") - F.lag("end_frame").over(w) >= 15, F.lit(True))
    batch = ev.withColumn("k", F.count_if(fresh).over(w.rowsBetween(W.unboundedPreceding, 0))).groupBy("file_id", "k").agg(F.count("*").alias("n"), F.sum("frames").alias("f"))
    assert got == sorted((r["file_id"], r["n"], r["f"]) for r in batch.collect())


def test_phrases(spark, timed):
    folder, ev = timed
    rule = PhraseRule()
    got = sorted(tuple(r) for r in run(spark, folder, lambda d: s.phrases(d, 14.0, rule), "phrases") if r["file_id"] >= 0)
    expected = []
    for f in {r["file_id"] for r in ev.select("file_id").collect()}:
        rows, phrase, number = ev.filter(F.col("file_id") == f).orderBy("seq").collect(), [], 0
        for r in rows:
            if phrase:
                b = phrase[-1]
                gap = max(0, r["start_frame"] - b["end_frame"])
                soft = b["frames"] >= rule.long * 14 and (gap > 0 or abs(r["midi_cents"] - b["midi_cents"]) >= rule.leap)
                if gap >= rule.gap or (len(phrase) >= rule.least and soft):
                    expected.append((f, number, len(phrase), phrase[0]["start_frame"], max(x["end_frame"] for x in phrase)))
                    phrase, number = [], number + 1
            phrase.append(r)
        expected.append((f, number, len(phrase), phrase[0]["start_frame"], max(x["end_frame"] for x in phrase)))
    # the last phrase of a file ends by its timeout
    assert got == sorted(expected)
