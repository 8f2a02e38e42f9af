"""Ordered operators that hold up when one key owns a large share of the rows.

A plain ``lag`` puts a whole key into one task. Here the rows of a key with more than ``CHUNK`` of them are
cut into chunks by the value of the ordering number (a unique whole number), at quantiles of the key's own
numbers, so chunks fill evenly however the numbers lie. The
neighbour is found inside each chunk, and only one row per chunk travels to the next level to fill the
chunk's first row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.session import staged

CHUNK = 1 << 20
QUANTILES = 64


def _wide_keys(df: DataFrame, keys: Sequence[str], chunk: int) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > chunk)


def _with_chunk(df: DataFrame, levels: Sequence[str], number: str, chunk: int) -> DataFrame:
    """Add _chunk (0 for keys of up to ``chunk`` rows) and _wide, whether a key has more. One row in ``chunk`` is such a key at most.

    A wide key is cut at QUANTILES of its own numbers, found by a sketch, parts are put together or cut evenly so that a chunk has about
    ``chunk`` rows; so numbers may lie as unevenly as they like, and no chunk holds more than a part does. Whether there is any wide key
    is asked first, in a job of its own: there hardly ever is, and then nothing else is done. The marks are a stage, as a sketch comes out
    differently with the order its parts arrive in, and rows and sizes of chunks must be cut at the same places.
    """
    value = F.col(number).cast("double")
    many = _wide_keys(df, levels, chunk)
    if many.isEmpty():
        return df.withColumn("_chunk", F.lit(0).cast("bigint")).withColumn("_wide", F.lit(False))
    marks = F.percentile_approx(value, F.lit([i / QUANTILES for i in range(QUANTILES + 1)]), F.lit(10_000))
    wide = staged(df.join(F.broadcast(many), list(levels)).groupBy(*levels).agg(marks.alias("_marks"), F.max("_rows").alias("_rows")), "chunk-marks")
    part = F.size(F.filter(F.slice("_marks", 2, QUANTILES - 1), lambda m: m < value))
    lo, hi = F.get("_marks", part), F.get("_marks", part + 1)
    pieces = F.ceil(F.col("_rows") / (QUANTILES * chunk))
    piece = F.least(pieces - 1, F.greatest(F.lit(0), F.floor((value - lo) * pieces / (hi - lo + 1))))
    together = F.floor(part * F.least(F.lit(QUANTILES), F.ceil(F.col("_rows") / chunk)) / QUANTILES)
    at = F.when(F.col("_rows").isNotNull(), together.cast("bigint") * (1 << 20) + piece).otherwise(F.lit(0).cast("bigint"))
    return df.join(F.broadcast(wide), list(levels), "left").withColumn("_chunk", at).withColumn("_wide", F.col("_rows").isNotNull()).drop("_marks", "_rows")


def _fill_from_level(df: DataFrame, keys: Sequence[str], level: str, inner: Column, payload: Column, wide_only: bool = False) -> DataFrame:
    """Give each (keys, level) group's first row the last payload of the level before it.

    With ``wide_only`` just the keys that were cut have several levels: their tails, one a chunk, are few enough to be broadcast, and
    the other rows are not shuffled again.
    """
    tails = (df.where("_wide") if wide_only else df).groupBy(*keys, level).agg(F.max_by(payload, inner).alias("_tail"))
    carry = (
        tails.withColumn("_carry", F.lag("_tail").over(Window.partitionBy(*keys).orderBy(level)))
        .where(F.col("_carry").isNotNull())
        .select(*keys, level, "_carry")
    )
    return (
        df.join(F.broadcast(carry) if wide_only else carry, [*keys, level], "left")
        .withColumn("_prev", F.coalesce("_prev", "_carry"))
        .drop("_carry")
    )


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    number: str,
    payload: Sequence[str],
    outer: str | None = None,
    name: str = "prev",
    chunk: int = CHUNK,
) -> DataFrame:
    """Add struct ``name`` = ``payload`` of the row before this one within ``keys``.

    Rows are ordered by ``number`` (a unique whole number), or by (``outer``, ``number``) when an outer
    ordering column such as a date is given. Keys and ordering columns must not be null. With an outer column, keys without
    more than ``chunk`` rows, which is nearly always all of them, need one shuffle and no level for each outer value.
    """
    keys = list(keys)
    value = F.struct(*payload)
    order = F.col(number)
    if outer and _wide_keys(df, keys, chunk).isEmpty():
        row = F.lag(F.struct(value.alias("value"), F.col(outer).alias("outer"), order.alias("number"))).over(Window.partitionBy(*keys).orderBy(outer, number))
        out = df.repartition(*keys).withColumn("_row", row)
        # as by levels, whose joins a null does not pass: rows without a key have a row before them only under the same outer value
        known = F.col("_row.number").isNotNull()
        for k in keys:
            known = known & F.col(k).isNotNull()
        return out.withColumn(name, F.when(known | F.col("_row.outer").eqNullSafe(F.col(outer)), F.col("_row.value"))).drop("_row")
    levels = keys + ([outer] if outer else [])
    # dealt explicitly: the rows may be a union, whose parts are not to be taken as dealt alike
    out = _with_chunk(df, levels, number, chunk).repartition(*levels, "_chunk")
    inside = Window.partitionBy(*levels, "_chunk").orderBy(number)
    out = out.withColumn("_prev", F.lag(value).over(inside))
    out = _fill_from_level(out, levels, "_chunk", order, value, wide_only=True)
    if outer:
        out = _fill_from_level(out, keys, outer, order, value)
    return out.drop("_chunk", "_wide").withColumnRenamed("_prev", name)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """The first row per key as a map-side-combined aggregate; no sort, no window."""
    best = F.min_by(F.struct(*cols), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(best).select(*keys, "_first.*")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The k first rows per key. ``row_number() <= k`` is cut to k per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def with_rank(df: DataFrame, keys: Sequence[str], number: str, name: str = "rank", chunk: int = CHUNK) -> DataFrame:
    """Exact 1-based position by a unique whole number within ``keys``: position in the chunk plus the rows before it."""
    keys = list(keys)
    d = _with_chunk(df, keys, number, chunk).repartition(*keys, "_chunk")
    inside = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(number))
    sizes = d.where("_wide").groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))  # of cut keys only: one row a chunk
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*keys, "_chunk", before.alias("_before"))
    ranked = d.withColumn(name, inside).join(F.broadcast(sizes), [*keys, "_chunk"], "left")
    return ranked.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_chunk", "_before", "_wide")


def cumulative_counts(df: DataFrame, value: str, counts: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Per distinct value in [0, 1]: the counts at it and, as ``<name>_below``, the counts under it.

    Rows are first collapsed to distinct values; running sums then go through two levels of 10 000 buckets,
    so no task orders more than one bucket.
    """
    keys = list(keys)
    d = df.groupBy(*keys, value).agg(*[c.alias(n) for n, c in counts.items()])
    scaled = F.col(value) * 10000
    d = d.withColumn("_b1", F.floor(scaled)).withColumn("_b2", F.floor((scaled - F.floor(scaled)) * 10000))
    under = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fine = d.groupBy(*keys, "_b1", "_b2").agg(*[F.sum(n).alias(n) for n in counts])
    coarse = fine.groupBy(*keys, "_b1").agg(*[F.sum(n).alias(n) for n in counts])
    top, mid, low = (Window.partitionBy(*keys).orderBy("_b1"), Window.partitionBy(*keys, "_b1").orderBy("_b2"),
                     Window.partitionBy(*keys, "_b1", "_b2").orderBy(value))
    coarse = coarse.select(*keys, "_b1", *[under(n, top).alias(f"_c_{n}") for n in counts])
    fine = fine.select(*keys, "_b1", "_b2", *[under(n, mid).alias(f"_f_{n}") for n in counts])
    d = d.select("*", *[under(n, low).alias(f"_v_{n}") for n in counts])
    d = d.join(fine, [*keys, "_b1", "_b2"]).join(coarse, [*keys, "_b1"])
    return d.select(*keys, value, *counts, *[(F.col(f"_v_{n}") + F.col(f"_f_{n}") + F.col(f"_c_{n}")).alias(f"{n}_below") for n in counts])


def exact_quantile(df: DataFrame, value: str, q: float) -> DataFrame:
    """One row: the linearly interpolated quantile of values in [0, 1], without gathering them."""
    c = cumulative_counts(df, value, {"n": F.count("*")})
    size = c.agg(F.sum("n").alias("total")).select(F.lit(0).alias("_k"), ((F.col("total") - 1) * F.lit(q)).alias("at"))
    d = c.withColumn("_k", F.lit(0)).join(F.broadcast(size), "_k")  # one row
    inside = lambda p: (F.col("n_below") <= p) & (p < F.col("n_below") + F.col("n"))
    lo, hi = F.floor("at"), F.ceil("at")
    picked = d.agg(F.max(F.when(inside(lo), F.col(value))).alias("a"), F.max(F.when(inside(hi), F.col(value))).alias("b"),
                   F.max(F.col("at") - F.floor("at")).alias("w"))
    return picked.select((F.col("a") + (F.col("b") - F.col("a")) * F.col("w")).alias("quantile"))
