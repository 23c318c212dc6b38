"""Manifests, link lists and report writers."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelore.functions.scalars import yes_no


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """url, id, title, creator, license, filename of a source list; switched-off rows and those without url are left out.

    ``enabled`` keeps a row unless it says no; unknown texts and nulls keep it.
    """
    raw = spark.read.csv(path, header=True)
    trimmed = raw.select(*(F.trim(F.col(c)).alias(c.strip().lower()) for c in raw.columns))
    for c in ("enabled", "url", "id", "title", "creator", "license", "filename"):
        if c not in trimmed.columns:
            trimmed = trimmed.withColumn(c, F.lit(None).cast("string"))
    return trimmed.filter(~yes_no(F.col("enabled")).eqNullSafe(F.lit(False)) & (F.length("url") > 0)).select("url", "id", "title", "creator", "license", "filename")


def links(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with a row for each anchor: pos, href, text; of an anchor's text the tags are taken out."""
    anchors = F.regexp_extract_all(html, F.lit(r"""(?is)<a\b[^>]*?href\s*=\s*["'][^"']*["'][^>]*>.*?</a>"""), F.lit(0))
    rows = pages.select("*", F.posexplode(anchors).alias("pos", "_a")).drop(html)
    return rows.withColumn("href", F.trim(F.regexp_extract("_a", r"""(?is)href\s*=\s*["']([^"']*)["']""", 1))).withColumn("text", F.trim(F.regexp_replace(F.regexp_replace("_a", "(?s)<[^>]*>", " "), r"\s+", " "))).drop("_a")


def midi_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """The anchors that lead to MIDI files."""
    return links(pages, html).filter(F.lower("href").rlike(r"\.midi?($|[?#])"))


def write_split(df: DataFrame, reason: str, folder: str) -> None:
    """Accepted rows (no reason) and rejected ones as CSV in two folders."""
    has = F.length(F.coalesce(F.col(reason), F.lit(""))) > 0
    df.filter(~has).drop(reason).write.csv(f"{folder}/accepted", header=True, mode="errorifexists")
    df.filter(has).write.csv(f"{folder}/rejected", header=True, mode="errorifexists")


def write_report(rows: DataFrame, by: str, folder: str) -> None:
    """One JSON document per value of ``by`` with its rows' values, rows of one document bounded by the report's own limits."""
    rest = [c for c in rows.columns if c != by]
    rows.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("rows")).write.json(folder, mode="errorifexists")


def blind_archives(pack: DataFrame, contents: DataFrame, name: str, content: str = "content") -> DataFrame:
    """case, path, content: of each case of ``pack`` (as ``blind_pack`` gives it) an archive of its files under their blind names.

    contents has each original's ``name`` and bytes. An archive is a document:
    the files of a case are in memory while it is made.
    """
    files = pack.join(contents.select(F.col(name).alias("original"), F.col(content).alias("content")), "original").select("case", "blind_id", "blind_filename", "content")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for row in pdf.sort_values("blind_id").itertuples(index=False):
                z.writestr(zipfile.ZipInfo(row.blind_filename, (1980, 1, 1, 0, 0, 0)), bytes(row.content))
        return pd.DataFrame({"case": pdf["case"].iloc[:1], "path": [f"{pdf['case'].iloc[0]}.zip"], "content": [out.getvalue()]})

    return files.groupBy("case").applyInPandas(one, "case string, path string, content binary")


def blind_pack(items: DataFrame, case: str, name: str, seed: int) -> DataFrame:
    """case, blind_id, blind_filename, original: a seeded shuffle of each case's files, numbered from 1."""
    from pyspark.sql import Window as W

    order = W.partitionBy(case).orderBy(F.xxhash64(F.lit(seed), F.col(name)), name)
    numbered = items.withColumn("blind_id", F.row_number().over(order))
    return numbered.select(F.col(case).alias("case"), "blind_id", F.concat(F.col(case), F.lit("_"), F.format_string("%02d", "blind_id"), F.lit(".wav")).alias("blind_filename"), F.col(name).alias("original"))
