"""Filter interaction audit: which rows every filter removes, in every filter order.

Five filters judge a document: A few words, B few distinct words, C many capitals,
D holds a mark, E repeats the text of a smaller doc_id. A to D read one text each;
E needs the whole table, and a counting-Bloom prepass spares it most of the work:

1. every text adds one to three counters of one segment of a sketch (segment and
   counters come from the text's hash). Tasks count their own rows; the counts are
   merged per counter. A text with a counter at one is unique for certain.
2. texts whose counters are all two or more are possible repeats. Only these are
   shuffled, whole, and give the exact least doc_id per full text. A text is counted
   within its task first, so a text that holds a third of all rows is a few rows.
3. a row fails E if its text is a possible repeat and the row's id is not the least
   one. The least ids meet the rows on (digest, doc_id), a key that no group shares.
4. the five flags make a mask of 0 to 31. Rows, good and toxic rows are counted per
   part and mask; every order, step and Shapley share follows from these 32 counts.

The sketch has 16 counters a row, in segments of 32,768 (a bitmap of the counters
that reached two: 4 KB), so a unique text passes as a possible repeat in about one of
200 cases, whatever the table's size; the exact step then clears it. Its size is known
from the row count: up to ``SKETCH_BYTES`` it is broadcast, beyond that it is joined
by segment, which moves the documents once.

Defined cases: a null text is empty (0 words: fails A only, and E if it repeats); rows
with a null doc_id never fail E and carry no label; rows that repeat doc_id and text
count each, and none of them is smaller than the other; a doc_id with several label
rows is good (toxic) if one of them says so; a null source is the part ``''``; an empty
table has no part, so no row; extra columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandcast.llm.common import text_or_empty, words

#: Filter letters; filter i sets bit i of a mask.
FILTERS = "ABCDE"
REPEAT = 1 << FILTERS.index("E")
MIN_WORDS = 50
MARKS = r"[#$%&*|]"
#: Counters of a segment (the bits of one of Spark's bitmaps), counters that a text
#: adds to, and rows that one segment is meant for.
CELLS, PROBES, SEGMENT_ROWS = 32768, 3, 2048
#: Largest sketch that is broadcast.
SKETCH_BYTES = 64 << 20


def text_mask(text: Column) -> Column:
    """Bits of filters A to D."""
    of = words(text)
    n = F.size(of)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    fails = [n < MIN_WORDS, F.size(F.array_distinct(of)) * 100 < n * 65,
             capitals * 100 > F.length(text) * 5, F.regexp_like(text, F.lit(MARKS))]
    return sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)),
               F.lit(0))


def _probes(text: Column, segments: int) -> tuple[Column, list[Column]]:
    """The segment of a text and its counters there."""
    h = F.xxhash64(text)
    bits = F.xxhash64(h, F.lit("counters"))
    return (F.pmod(h, F.lit(segments)),
            [F.shiftrightunsigned(bits, 15 * i).bitwiseAND(F.lit(CELLS - 1)) for i in range(PROBES)])


def repeat_sketch(texts: DataFrame, segments: int) -> DataFrame:
    """``segment, twice``: per segment the bitmap of the counters that reached two."""
    segment, cells = _probes(F.col("text"), segments)
    counters = texts.select(F.explode(F.array(*[segment * CELLS + c for c in cells])).alias("counter"))
    return (counters.groupBy("counter").count().filter("count >= 2")
            .groupBy(F.floor(F.col("counter") / CELLS).alias("segment"))
            .agg(F.bitmap_construct_agg(F.col("counter") % CELLS).alias("twice")))


def _is_set(bitmap: Column, cell: Column) -> Column:
    octet = F.conv(F.hex(F.substring(bitmap, F.shiftright(cell, 3).cast("int") + 1, F.lit(1))), 16, 10)
    return F.pmod(F.floor(octet.cast("long") / F.pow(F.lit(2.0), cell % 8)), F.lit(2)) == 1


def with_possible_repeats(texts: DataFrame, segments: int,
                          sketch_bytes: int = SKETCH_BYTES) -> DataFrame:
    """``texts`` with ``possible``: false only for texts that occur once for certain."""
    sketch = repeat_sketch(texts, segments)
    if segments * CELLS // 8 <= sketch_bytes:
        sketch = F.broadcast(sketch)
    segment, cells = _probes(F.col("text"), segments)
    hit = F.lit(True)
    for cell in cells:
        hit = hit & _is_set(F.col("twice"), cell)
    return (texts.withColumn("segment", segment).join(sketch, "segment", "left")
            .withColumn("possible", F.coalesce(hit, F.lit(False))).drop("segment", "twice"))


def failure_masks(docs: DataFrame, sketch_bytes: int = SKETCH_BYTES) -> DataFrame:
    """``doc_id, part, mask`` of every row: the filters that it fails."""
    texts = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                        text_or_empty().alias("text"))
    segments = max(1, ceil(docs.count() / SEGMENT_ROWS))
    marked = with_possible_repeats(texts, segments, sketch_bytes)
    digest = F.unhex(F.sha2("text", 256))
    first = (marked.filter("possible and doc_id is not null").groupBy("text")
             .agg(F.min("doc_id").alias("first"))
             .select(digest.alias("digest"), F.col("first").alias("id"), F.lit(True).alias("least")))
    # a row outside the search for repeats gets a key of its own, so no task gathers them
    judged = F.col("possible") & F.col("doc_id").isNotNull()
    id_type = docs.schema["doc_id"].dataType
    rows = marked.select(
        "doc_id", "part", text_mask(F.col("text")).alias("mask"), F.when(judged, digest).alias("digest"),
        F.when(judged, F.col("doc_id")).otherwise(F.monotonically_increasing_id().cast(id_type)).alias("id"))
    repeats = F.col("digest").isNotNull() & F.col("least").isNull()
    return rows.join(first, ["digest", "id"], "left").select(
        "doc_id", "part", (F.col("mask") + F.when(repeats, REPEAT).otherwise(0)).alias("mask"))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: at most 32 rows a part."""
    marks = (labels.filter("doc_id is not null").groupBy("doc_id")
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"),
                  F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
             .select(F.col("doc_id").alias("id"), F.lit(True).alias("known"), "good", "toxic"))
    spread = F.coalesce("doc_id", F.monotonically_increasing_id().cast(masks.schema["doc_id"].dataType))
    rows = masks.select("part", "mask", spread.alias("id"), F.col("doc_id").isNotNull().alias("known"))
    return (rows.join(marks, ["id", "known"], "left").groupBy("part", "mask")
            .agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
                 F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")))


def order_steps(letters: str = FILTERS) -> Column:
    """Every order of the filters with its steps: ``filter_order, step, bit, before``,
    ``before`` the mask of the filters applied earlier."""
    steps = []
    for order in permutations(letters):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << letters.index(letter)
            steps.append(F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(step).alias("step"),
                                  F.lit(bit).alias("bit"), F.lit(before).alias("before")))
            before |= bit
    return F.array(*steps)


def audit(counts: DataFrame, letters: str = FILTERS) -> DataFrame:
    """Per part, filter order and step: kept, removed, redundant, unique_fails,
    good_lost, toxic_lost and shapley, all from the counts per mask."""
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    steps = parts.select("part", "cells", F.explode(order_steps(letters)).alias("s")) \
        .select("part", "cells", "s.*")
    bit, before = F.col("bit"), F.col("before")
    orders = 1
    for i in range(2, len(letters) + 1):
        orders *= i

    def total(field: str, keep, weigh=lambda c: F.lit(1)) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(
            keep(c["mask"]), c[field] * weigh(c["mask"])).otherwise(F.lit(0)).cast("long"))

    fails = lambda m: m.bitwiseAND(bit) != 0
    passed = lambda m: m.bitwiseAND(before) == 0
    # in orders / k of all orders a filter comes first of the k that a row fails
    share = lambda m: (F.lit(orders) / F.bit_count(m)).cast("long")
    return steps.select(
        "part", "filter_order", "step",
        total("n", lambda m: m.bitwiseAND(bit.bitwiseOR(before)) == 0).alias("kept"),
        total("n", lambda m: fails(m) & passed(m)).alias("removed"),
        total("n", lambda m: fails(m) & ~passed(m)).alias("redundant"),
        total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", lambda m: fails(m) & passed(m)).alias("good_lost"),
        total("toxic", lambda m: fails(m) & passed(m)).alias("toxic_lost"),
        total("n", fails, share).alias("shapley"))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over all documents."""
    return audit(mask_counts(failure_masks(docs), labels))
