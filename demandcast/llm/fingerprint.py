"""Document fingerprints by consistent weighted sampling.

A document is a set of weighted terms (its words and their counts). For sample
``k`` every term draws, from its hash, ``r`` and ``c`` from Gamma(2, 1) and ``b``
from [0, 1); with weight ``w``::

    t = floor(ln w / r + b)      ln y = r (t - b)      a = c / (y e^r)

The term with the least ``a`` is the sample, identified by (term, t). Two
documents share a sample with a probability equal to their generalised Jaccard
similarity (sum of least weights / sum of largest), so the share of equal
samples estimates it.

Everything is built-in expressions. A draw only depends on the term, so a
document and its edited version are sampled in one pass. The texts move once:
rows are dealt into ranges of doc_id of about equal size (bounds from an
approximate quantile of the ids, a fixed number of values on the driver); the
first row of each range is also sent to the range above it as the last row's
neighbour. Numbering, term counts, samples and likenesses all keep that
partitioning.

Defined cases: a null text is empty and has the empty fingerprint; two empty
ones have likeness 1, an empty and another 0; rows without a doc_id stand after
the smallest id; rows that share a doc_id are ordered by text hash; a single
document is its own next one; whole texts of any length count; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandcast.llm.common import partitions, text_or_empty, words

#: Samples per fingerprint, and samples that one aggregation row carries.
SAMPLES, BLOCK = 32, 4
#: Ranges of doc_id per shuffle partition, and their least number.
RANGES, LEAST_RANGES = 2, 96
_LAST = -(1 << 63)


def sample(term: Column, k: Column, log_weights: list[Column]) -> list[Column]:
    """The packed candidates of one term for sample ``k``, one per weight.

    Packed as ``ln a`` (scaled, 31 bits) above the identity of (term, t)
    (32 bits): the least packed value is the sample. Null weights give null.
    """
    low = F.lit(0xFFFFFFFF)
    one = F.xxhash64(term, k)
    two = F.xxhash64(one)

    def unit(bits: Column, width: int) -> Column:  # in (0, 1)
        return (bits + F.lit(0.5)) / F.lit(float(1 << width))

    def product(bits: Column) -> Column:  # of two uniforms
        return unit(F.shiftrightunsigned(bits, 32), 32) * unit(bits.bitwiseAND(low), 32)

    b = unit(F.xxhash64(two).bitwiseAND(low), 32)
    r = -F.log(product(one))
    log_c = F.log(-F.log(product(two)))
    out = []
    for log_weight in log_weights:
        t = F.floor(log_weight / r + b)
        log_a = log_c - r * (t + F.lit(1.0) - b)
        scaled = F.greatest(F.lit(0.0), (log_a + F.lit(128.0)) * F.lit(float(1 << 23)))
        identity = term.bitwiseXOR(t * F.lit(65537)).bitwiseAND(low)
        out.append(F.shiftleft(scaled.cast("long"), 32).bitwiseOR(identity))
    return out


def _range_of(key: Column, bounds: list[int]) -> Column:
    """The number of bounds below the key, by two steps of about sqrt(n) compares."""
    if not bounds:
        return F.lit(0)
    width = math.isqrt(len(bounds)) + 1
    chunks = [bounds[i:i + width] for i in range(0, len(bounds), width)]
    chunk = F.size(F.filter(F.lit([c[-1] for c in chunks]), lambda x: x < key))
    inside = F.size(F.filter(F.get(F.array(*map(F.lit, chunks)), chunk), lambda x: x < key))
    return F.when(chunk >= len(chunks), F.lit(len(bounds))) \
        .otherwise(chunk * width + inside)


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """``__range, __n, __own, doc_id, text, next_text`` in descending doc_id.

    Rows with ``__own`` false are the copies that close a range. The last
    document's next one is the first.
    """
    spark = docs.sparkSession
    ranges = ranges or max(LEAST_RANGES, RANGES * partitions(spark))
    keyed = docs.select("doc_id", text_or_empty().alias("text"),
                        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("__key"))
    cuts = keyed.agg(F.percentile_approx(
        "__key", [i / ranges for i in range(1, ranges)], max(10_000, 20 * ranges))).first()[0]
    bounds = sorted(set(cuts or []))
    keyed = keyed.withColumn("__range", _range_of(F.col("__key"), bounds).cast("int"))
    # the first id of every range: as many rows as there are ranges
    tops = sorted((r[0], r[1]) for r in
                  keyed.groupBy("__range").agg(F.max("__key")).collect())
    above = {tops[i][1]: tops[(i + 1) % len(tops)][0] for i in range(len(tops))}
    targets = spark.createDataFrame(list(above.items()) or [(0, -1)], "__key long, __above int")
    own = F.struct(F.col("__range").alias("__range"), F.lit(True).alias("__own"))
    copy = F.struct(F.col("__above").alias("__range"), F.lit(False).alias("__own"))
    places = F.when(F.col("__above").isNull(), F.array(own)).otherwise(F.array(own, copy))
    dealt = keyed.join(F.broadcast(targets), "__key", "left") \
        .select("doc_id", "text", "__key", F.inline(places))
    order = Window.partitionBy("__range").orderBy(
        F.desc("__own"), F.desc("__key"), F.desc(F.xxhash64("text")), "text")
    return dealt.select("__range", "__own", "doc_id", "text", F.row_number().over(order).alias("__n"),
                        F.coalesce(F.lead("text").over(order), F.lit("")).alias("next_text"))


def edited_text(text: Column, next_text: Column) -> Column:
    """The last third of the code points replaced by as many of the next text's first."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third),
                    F.substring(next_text, F.lit(1), third))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples of two fingerprints (arrays; empty for no terms)."""
    equal = F.size(F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: z["a"] == z["b"]))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)) \
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)) \
        .otherwise(equal / F.size(a))


def hex_text(fingerprint: Column) -> Column:
    """A fingerprint as hexadecimal text, eight digits a sample."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def fingerprints(docs: DataFrame, samples: int = SAMPLES, ranges: int | None = None) -> DataFrame:
    """Fingerprint every document and its edited version.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint``
    (arrays of samples), ``near_edited, near_next``.
    """
    if samples % BLOCK:
        raise ValueError(f"samples must be a multiple of {BLOCK}")
    rows = with_next(docs, ranges)
    edited = edited_text(F.col("text"), F.col("next_text"))
    facts = {"own": F.col("__own").cast("long"), "doc_id": F.col("doc_id"),
             "n_chars": F.length("text").cast("long"),
             **{f"sha{i}": F.conv(F.substring("__sha", 1 + 13 * i, 13), 16, 10).cast("long")
                for i in range(5)}}
    versions = rows.withColumn("edited", edited).withColumn("__sha", F.sha2("edited", 256)).select(
        "__range", "__n", *[c.alias(f"__{name}") for name, c in facts.items()],
        F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("body")),
                         F.struct(F.lit(1).alias("side"), F.col("edited").alias("body")))))
    # the document's own values travel as rows beside its words (empty words in
    # front of its text), so that groups hold a single value column besides
    front = F.when(F.col("side") == 0, F.array_repeat(F.lit(""), len(facts))) \
        .otherwise(F.array().cast("array<string>"))
    value = F.coalesce(*[F.when(F.col("__at") == i, F.col(f"__{name}"))
                         for i, name in enumerate(facts)])
    is_fact = F.col("word") == ""
    tokens = versions.select("__range", "__n", "side", *[f"__{name}" for name in facts],
                             F.posexplode(F.concat(front, words(F.col("body")))).alias("__at", "word")) \
        .select("__range", "__n", "side",
                F.when(is_fact, -1 - F.col("__at")).otherwise(F.lit(0)).alias("fact"),
                F.when(~is_fact, F.xxhash64("word")).alias("term"),
                F.when(is_fact, value).alias("value"))
    counted = tokens.groupBy("__range", "__n", "fact", "term").agg(
        F.sum(1 - F.col("side")).alias("w0"), F.sum("side").alias("w1"), F.max("value").alias("value"))
    weights = [F.when(F.col(w) > 0, F.log(F.col(w).cast("double"))).alias(f"l{w}")
               for w in ("w0", "w1")]
    # a term goes to every block of samples, a fact to a block of its own
    blocks = counted.select("__range", "__n", "term", "value", *weights, F.explode(
        F.when(F.col("fact") < 0, F.array("fact")).otherwise(
            F.sequence(F.lit(0), F.lit(samples // BLOCK - 1)))).alias("block"))
    least = []
    for i in range(BLOCK):
        own, other = sample(F.col("term"), F.col("block") * BLOCK + i,
                            [F.col("lw0"), F.col("lw1")])
        least += [F.min(own).alias(f"own{i}"), F.min(other).alias(f"other{i}")]
    by_block = blocks.groupBy("__range", "__n", "block").agg(*least, F.max("value").alias("value"))

    def gathered(side: str) -> Column:
        parts = F.array_sort(F.collect_list(F.when(F.col("block") >= 0, F.struct(
            "block", *[F.col(f"{side}{i}").alias(f"v{i}") for i in range(BLOCK)]))))
        flat = F.flatten(F.transform(parts, lambda p: F.array(*[p[f"v{i}"] for i in range(BLOCK)])))
        low = F.lit(0xFFFFFFFF)
        return F.transform(F.filter(flat, lambda v: v.isNotNull()), lambda v: v.bitwiseAND(low))

    per_doc = by_block.groupBy("__range", "__n").agg(
        gathered("own").alias("fingerprint"), gathered("other").alias("edited_fingerprint"),
        *[F.max(F.when(F.col("block") == -1 - i, F.col("value"))).alias(f"__{name}")
          for i, name in enumerate(facts)])
    following = F.lead("fingerprint").over(Window.partitionBy("__range").orderBy("__n"))
    sha = F.concat(*[F.lower(F.lpad(F.hex(f"__sha{i}"), 13 if i < 4 else 12, "0")) for i in range(5)])
    return per_doc.withColumn("__following", following).filter(F.col("__own") == 1).select(
        F.col("__doc_id").alias("doc_id"), F.col("__n_chars").alias("n_chars"),
        sha.alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("__following")).alias("near_next"))
