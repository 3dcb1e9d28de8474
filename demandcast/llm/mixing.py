"""Mixing sources to target weights along a time-varying curriculum.

Every source has a size (its words), a target (the words the mix takes from it)
and a weight schedule over training time ``t`` in [0, 1]. With the linear
schedule ``1 + slope * (2t - 1)`` the source's cumulative demand is
``target * (t + slope * (t * t - t))``. The source's documents stand in one
shuffled line (hash order), once per pass; a copy at offset ``o`` of that line is
due when the cumulative demand reaches ``o``, so inverting the demand gives its
training position, and sorting by position (a range partitioning) gives the
training order.

Targets: all sources share ``share`` x the total size by their weights; a target
stops at ``most`` x its source's size and the excess is shared again by weight
(water filling, solved in closed form over the sources).

A copy is taken when its middle lies before the target, so a source's taken
words differ from its target by at most half of one document. Hot sources are
not one group: running sums are taken per (source, hash cell) and the cells'
totals are summed up per source, ``cells`` rows each.

Defined cases: a null text has size 0; a null source is a source of its own and
stands last; documents of size 0 are never taken; rows that agree in everything
are interchangeable; an empty table gives an empty result; extra columns are
ignored (or carried by :func:`training_order`).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandcast.llm.common import text_or_empty, words

#: Weights by rank of the source (code point order, null last), repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Schedule slopes by rank, repeating: falling, flat, rising.
SLOPES = (-0.5, 0.0, 0.5)
CELLS = 1024


def _by_rank(values: Sequence[float], rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]),
                        (F.pmod(rank, F.lit(len(values))) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS,
                   slopes: Sequence[float] = SLOPES, share: float = 1.5,
                   most: float = 2.0) -> DataFrame:
    """``__group, source_size, target, slope`` from ``(__group, source_size)`` rows.

    ``__group`` is the source with a prefix that sorts null last.

    With the sources sorted by the level that fills them (cap / weight), the
    level left to the others once the first ones are full is (total - caps of
    the full ones) / (weights of the others). It rises as long as it fills the
    next source and falls from there on, so the common level is its largest
    value. The windows run over one row per source.
    """
    by_name = Window.orderBy("__group")
    by_level = Window.orderBy("__full_at", "__group")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rank = F.row_number().over(by_name) - 1
    level = (F.col("__total") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) \
        / F.sum("__weight").over(onward)
    return (sizes.withColumn("__rank", rank)
            .withColumn("__weight", _by_rank(weights, F.col("__rank")))
            .withColumn("slope", _by_rank(slopes, F.col("__rank")))
            .withColumn("__cap", F.col("source_size") * F.lit(float(most)))
            .withColumn("__full_at", F.col("__cap") / F.col("__weight"))
            .withColumn("__total", F.sum("source_size").over(everything) * F.lit(float(share)))
            .withColumn("__level", level)
            .withColumn("__common", F.max("__level").over(everything))
            .select("__group", "source_size", "slope",
                    F.least(F.col("__cap"), F.col("__common") * F.col("__weight")).alias("target")))


def position(offset: Column, target: Column, slope: Column) -> Column:
    """The time at which ``target * (t + slope * (t * t - t))`` reaches ``offset``."""
    share = offset / target
    b = F.lit(1.0) - slope
    root = (F.sqrt(b * b + F.lit(4.0) * slope * share) - b) / (F.lit(2.0) * slope)
    return F.when(F.abs(slope) < 1e-9, share).otherwise(root)


def _keyed(docs: DataFrame, *keep: Column, cells: int) -> DataFrame:
    """Documents with their size, their source's key (never null) and hash cell."""
    text = text_or_empty()
    group = F.when(F.col("source").isNull(), F.lit("1")) \
        .otherwise(F.concat(F.lit("0"), F.col("source")))
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), text))
    key = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    return docs.select(*keep, F.col("doc_id").alias("__id"),
                       group.alias("__group"), F.size(words(text)).cast("long").alias("__size"),
                       key.alias("__key")) \
        .withColumn("__cell", F.pmod(F.col("__key"), F.lit(cells)).cast("int"))


def _mixed(docs: DataFrame, *keep: Column, weights: Sequence[float] = WEIGHTS,
           slopes: Sequence[float] = SLOPES, share: float = 1.5, most: float = 2.0,
           cells: int = CELLS) -> DataFrame:
    # cell totals of every source: at most sources x cells rows
    per_cell = _keyed(docs, cells=cells).groupBy("__group", "__cell") \
        .agg(F.sum("__size").alias("__n"))
    start = F.sum("__n").over(Window.partitionBy("__group").orderBy("__cell")) - F.col("__n")
    targets = source_targets(per_cell.groupBy("__group").agg(
        F.sum("__n").alias("source_size")), weights, slopes, share, most)
    lines = per_cell.withColumn("__start", start).join(targets, "__group")
    # numbered and joined under one partitioning: a single shuffle of the rows
    in_cell = Window.partitionBy("__group", "__cell").orderBy("__key", "__id", "__size")
    numbered = _keyed(docs, *keep, cells=cells).withColumn(
        "__offset", F.sum("__size").over(in_cell.rowsBetween(Window.unboundedPreceding, 0))
        - F.col("__size"))
    rows = numbered.join(lines, ["__group", "__cell"])
    place = F.col("__start") + F.col("__offset")
    passes = F.transform(F.sequence(F.lit(0), F.lit(math.ceil(most) - 1)),
                         lambda p: p * F.col("source_size") + place)
    due = F.filter(passes, lambda o: o + F.col("__size") / 2.0 <= F.col("target"))
    copies = F.when(F.col("__size") > 0, due).otherwise(F.array().cast("array<bigint>"))
    # a copy's position: when the demand reaches its first word
    return rows.withColumn("__positions", F.transform(
        copies, lambda o: position(o, F.col("target"), F.col("slope"))))


def curriculum_mix(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, positions`` of every document.

    ``positions`` holds the training position (0 to 1) of every copy that the
    mix takes, none for a document that it leaves out.
    """
    return _mixed(docs, **options).select(
        F.col("__id").alias("doc_id"), F.col("__size").alias("size"), "source_size", "target",
        F.col("__positions").alias("positions"))


def by_first_copy(mixed: DataFrame) -> DataFrame:
    """The rows of :func:`curriculum_mix` in training order: each document where its first
    copy stands, those that the mix leaves out at the end."""
    return mixed.orderBy(F.array_min("positions").asc_nulls_last(), "doc_id", "size")


def training_order(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of ``docs``, a row per copy, sorted by training position."""
    mixed = _mixed(docs, F.struct("*").alias("__row"), **options)
    copies = mixed.select("__row", F.explode("__positions").alias("__position"))
    return copies.orderBy("__position", "__row.doc_id").select("__row.*")
