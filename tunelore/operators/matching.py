"""Pairing, looking up and de-duplicating records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelore.functions.scalars import slug
from tunelore.operators.ordered import Running, ordered
from tunelore.staging import stage


def pair_sides(left: DataFrame, right: DataFrame, key: str, size: str) -> DataFrame:
    """key, left_size, right_size, status of two sides with one row a key.

    status: paired, length_mismatch, missing_left or missing_right.
    """
    both = left.select(key, F.col(size).alias("left_size")).join(right.select(key, F.col(size).alias("right_size")), key, "full_outer")
    status = F.when(F.col("left_size").isNull(), "missing_left").when(F.col("right_size").isNull(), "missing_right").when(F.col("left_size") != F.col("right_size"), "length_mismatch").otherwise("paired")
    return both.withColumn("status", status)


def first_by_content(df: DataFrame, content: str, order: str) -> DataFrame:
    """Each row's digest, whether it is the first of its content by ``order``, and that first one.

    Null contents are each their own.
    """
    digest = F.sha2(F.coalesce(F.col(content), F.lit("")), 256)
    firsts = df.filter(F.col(content).isNotNull()).groupBy(digest.alias("digest")).agg(F.min(order).alias("first"))
    keyed = df.select(order, F.when(F.col(content).isNotNull(), digest).alias("digest"))
    return keyed.join(firsts, "digest", "left").select(order, "digest", F.coalesce("first", order).alias("first"), (F.coalesce("first", order) == F.col(order)).alias("kept"))


def keep_by_two_keys(df: DataFrame, order: str, first: str, second: str) -> DataFrame:
    """Rows (order, kept, reason) of a walk in order that keeps a row unless an earlier kept row has its first or second key.

    Null keys never match. Instead of walking, each round keeps every open row
    that is the earliest open one under both keys and drops the open rows
    behind kept ones, until none is open.
    """
    rows = stage(df.select(order, F.col(first).alias("k1"), F.col(second).alias("k2")), "keys")
    open_rows, all_kept = rows, []

    def leading(k: str) -> DataFrame:
        """The earliest open row of each key, which partial aggregation finds however many rows a key has."""
        return open_rows.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min(order).alias(order)).select(order, F.lit(True).alias(f"_{k}"))

    while True:
        both = open_rows.join(leading("k1"), order, "left").join(leading("k2"), order, "left")
        kept = stage(both.filter((F.col("k1").isNull() | F.col("_k1")) & (F.col("k2").isNull() | F.col("_k2"))).select(order, "k1", "k2"), "kept")
        if not kept.limit(1).count():
            break
        all_kept.append(kept)
        rest = open_rows.join(kept.select(order), order, "left_anti")
        for k in ("k1", "k2"):
            # a kept row is the earliest open one of its keys, so all others of them come after it
            rest = rest.join(kept.select(k).dropna().distinct(), k, "left_anti").select(order, "k1", "k2")
        open_rows = stage(rest, "open")
    kept = reduce(DataFrame.unionByName, all_kept, rows.limit(0))
    held = kept.filter(F.col("k1").isNotNull()).select("k1", F.col(order).alias("_by"))
    dropped = rows.join(kept.select(order), order, "left_anti").join(held, "k1", "left")
    reason = F.when(F.col("_by") < F.col(order), "first_key").otherwise("second_key")
    return kept.select(order, F.lit(True).alias("kept"), F.lit(None).cast("string").alias("reason")).unionByName(dropped.select(order, F.lit(False).alias("kept"), reason.alias("reason")))


def ancestors(path: Column) -> Column:
    """A path and all folders above it."""
    bits = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(bits)), lambda n: F.concat_ws("/", F.slice(bits, F.lit(1), n)))


def under_first_root(paths: DataFrame, path: str, roots: DataFrame, root: str, rank: str) -> DataFrame:
    """``paths`` with the lowest-ranked root that they lie under, null if none.

    A path meets its roots by equality with one of its own ancestors, so no
    pair is tried that doesn't match.
    """
    distinct = paths.select(path).distinct()
    pairs = distinct.select(path, F.explode(ancestors(F.col(path))).alias("_a")).join(roots.select(F.col(root).alias("_a"), F.col(rank).alias("_rank")), "_a")
    best = pairs.groupBy(path).agg(F.min_by("_a", "_rank").alias(root))
    return paths.join(best, path, "left")


def _substrings(text: Column, shortest: int, longest: int) -> Column:
    """The distinct parts of a text of each length from ``shortest`` to ``longest``."""
    of = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.array(*(of(n) for n in range(shortest, longest + 1)))))


def find_names(wanted: DataFrame, name: str, pages: DataFrame, title: str, ident: str, gram: int = 3, wide: int = 8) -> DataFrame:
    """name, ident, how: the page of each distinct name: equal title, else the first whose title holds the name or is held by it.

    Containment is an equality that a shuffle can join: the shorter side, or
    its first ``wide`` characters, equals a part of the longer one. So short
    names meet only what holds them, and long ones what holds their beginning,
    however common three letters are. Names and titles shorter than ``gram``,
    null and empty ones match only exactly.
    """
    names = wanted.select(F.col(name).alias("name")).dropna().distinct()
    titles = pages.select(F.col(title).alias("title"), F.col(ident).alias("ident")).dropna(subset=["title"])
    exact = names.join(titles, F.col("name") == F.col("title")).groupBy("name").agg(F.min("ident").alias("ident")).withColumn("how", F.lit("exact"))
    rest = names.join(exact.select("name"), "name", "left_anti").filter(F.length("name") >= gram)
    # of equal titles the first page counts
    long = titles.filter(F.length("title") >= gram).groupBy("title").agg(F.min("ident").alias("ident"))
    parts, start = (lambda c: F.explode(_substrings(F.col(c), gram, wide))), (lambda c: F.substring(c, 1, wide))
    held = rest.withColumn("g", start("name")).join(long.withColumn("g", parts("title")), "g").filter(F.contains("title", "name"))
    holds = rest.withColumn("g", parts("name")).join(long.withColumn("g", start("title")), "g").filter(F.contains("name", "title"))
    near = held.select("name", "ident").unionByName(holds.select("name", "ident")).groupBy("name").agg(F.min("ident").alias("ident")).withColumn("how", F.lit("contains"))
    return exact.unionByName(near)


def unique_slugs(df: DataFrame, text: str, order: str) -> DataFrame:
    """order, slug: each row's slug, the later of equals numbered from ``_2``; a number that another slug already spells is passed over."""
    rows = stage(ordered(df.select(order, slug(F.col(text)).alias("base")), ["base"], [order], Running("n")), "slugs")
    spelled = rows.select(F.col("base").alias("slug")).distinct()
    while True:
        named = stage(rows.withColumn("slug", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", F.col("n").cast("string")))), "named")
        clash = named.filter("n > 1").join(spelled, "slug", "left_semi").select("base", F.col("n").alias("_at"))
        if not clash.limit(1).count():
            return named.select(order, "slug")
        # from a clash on, the numbers of that base move up by one
        first = clash.groupBy("base").agg(F.min("_at").alias("_at"))
        rows = named.join(first, "base", "left").withColumn("n", F.when(F.col("n") >= F.col("_at"), F.col("n") + 1).otherwise(F.col("n"))).drop("_at", "slug")


def choose_records(records: DataFrame, group: str, kind: str, size: str, path: str, priority: dict[str, int]) -> DataFrame:
    """``records`` with ``chosen``: of each group the one of the kind of highest priority (0 if unlisted), the larger, the first path."""
    from tunelore.functions.scalars import lookup

    rank = F.coalesce(lookup(priority)[F.lower(kind)], F.lit(0))
    best = records.groupBy(group).agg(F.min(F.struct((-rank).alias("a"), (-F.col(size)).alias("b"), F.col(path).alias("path"))).alias("_best"))
    return records.alias("r").join(best.alias("b"), F.col(f"r.{group}").eqNullSafe(F.col(f"b.{group}"))).select("r.*", (F.col(f"r.{path}") == F.col("b._best.path")).alias("chosen"))
