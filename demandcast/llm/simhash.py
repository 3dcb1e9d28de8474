"""SimHash near-dedup by deletion-variant signatures.

A fingerprint has 64 bits. It is cut into as few segments as leave one of them
with at most one differing bit: ``distance // 2 + 1`` segments (two for three
bits). Each segment is indexed under its one-wildcard variants (the segment with
one bit deleted, once per bit), so two fingerprints within the distance share a
variant; an equality join on the variants finds them and the full bit distance
verifies them. A pair that shares several variants is kept at one of them only.

Equal fingerprints are one node before the join (copies never make pairs), only
verified pairs leave the join, and components are found by distributed
smallest-label propagation with pointer jumping over reliable checkpoints.

Defined cases: a null text is empty; a text without words has fingerprint zero,
linked like any other; a row without a doc_id belongs to its component but never
names it (a component of such rows only has a null id); repeated rows have equal
fingerprints; an empty table gives an empty result; extra columns are ignored
(or carried by :func:`drop_near_copies`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandcast.llm.common import checkpointed, row_key, text_or_empty, with_fields

BITS = 64
SEED = 42
#: Shingles whose bits are unpacked at a time (64 bytes each).
BLOCK = 65_536


def simhash(text: bytes, shingle: int = 3) -> int:
    """The unsigned fingerprint of a UTF-8 text (0 without words)."""
    from xxhash import xxh64_intdigest

    # bytes.lower() and bytes.split() know ASCII only: A-Z, and \x20 \x09-\x0D
    found = text.lower().split()
    if not found:
        return 0
    parts = ([b" ".join(found)] if len(found) < shingle else
             map(b" ".join, zip(*(found[i:] for i in range(shingle)))))
    n = max(1, len(found) - shingle + 1)
    hashes = np.fromiter((xxh64_intdigest(p, SEED) for p in parts), dtype=np.uint64, count=n)
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, n, BLOCK):
        block = hashes[i:i + BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *keep: Column, shingle: int = 3) -> DataFrame:
    """``*keep, fingerprint`` (a signed long with the 64 bits) of every whole text."""
    rows = docs.select(*keep, text_or_empty().alias("__text"))
    names = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("__text").cast(pa.binary()).to_pylist()
            values = np.array([simhash(t, shingle) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(values.view(np.int64))],
                names=[*names, "fingerprint"])

    return rows.mapInArrow(run, with_fields(rows.schema.fields[:-1], "fingerprint long"))


def variants(nodes: DataFrame, distance: int = 3) -> DataFrame:
    """``variant, masked, fingerprint``: each node under its one-wildcard variants.

    ``variant`` numbers (segment, deleted bit); ``masked`` is the segment's bits
    with the deleted one cleared, kept at their place.
    """
    count = distance // 2 + 1
    edges = [BITS * i // count for i in range(count + 1)]
    masks = []
    for low, high in zip(edges, edges[1:]):
        whole = ((1 << (high - low)) - 1) << low
        masks += [whole & ~(1 << bit) for bit in range(low, high)]
    signed = [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in masks]
    return nodes.select("fingerprint", F.posexplode(F.array(*map(F.lit, signed)))
                        .alias("variant", "mask")) \
        .select("variant", F.col("mask").bitwiseAND(F.col("fingerprint")).alias("masked"),
                "fingerprint")


def near_pairs(nodes: DataFrame, distance: int = 3) -> DataFrame:
    """``a, b``: every pair of distinct fingerprints within the distance, once."""
    count = distance // 2 + 1
    edges = [BITS * i // count for i in range(count + 1)]
    index = variants(nodes, distance)
    a, b = index.alias("a"), index.alias("b")
    differ = F.col("a.fingerprint").bitwiseXOR(F.col("b.fingerprint"))
    # the first variant that a pair shares: the first segment with at most one
    # differing bit, at that bit (at the segment's first bit where none differs)
    first = F.lit(None)
    for low, high in reversed(list(zip(edges, edges[1:]))):
        part = F.shiftrightunsigned(differ, low).bitwiseAND(F.lit((1 << (high - low)) - 1)) \
            if high - low < BITS else differ
        at = F.lit(low) + F.when(part == 0, F.lit(0)).when(part < 0, F.lit(BITS - 1)) \
            .otherwise(F.bit_count(part - 1))
        first = F.when(F.bit_count(part) <= 1, at).otherwise(first)
    return (a.join(b, (F.col("a.variant") == F.col("b.variant"))
                   & (F.col("a.masked") == F.col("b.masked"))
                   & (F.col("a.fingerprint") < F.col("b.fingerprint"))
                   & (F.bit_count(differ) <= distance)
                   & (F.col("a.variant") == first))
            .select(F.col("a.fingerprint").alias("a"), F.col("b.fingerprint").alias("b")))


def components(pairs: DataFrame) -> DataFrame:
    """``node, label``: the smallest node of each node's connected component.

    Every round takes the smallest label among the neighbours, then the label of
    that label, and is written to the shared checkpoint folder; the rounds grow
    with the logarithm of a component's width, not with its size.
    """
    links = checkpointed(pairs.select("a", "b").union(pairs.select("b", "a")))
    labels = links.groupBy(F.col("a").alias("node")).agg(
        F.least(F.min("b"), F.first("a")).alias("label"))
    while True:
        near = links.join(labels, links.b == labels.node).groupBy("a") \
            .agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a) \
            .select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        step = checkpointed(step)
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = checkpointed(step.join(jump, "label").select("node", "old",
                                                             F.col("next").alias("label")))
        labels = after.select("node", "label")
        if after.filter(F.col("old") != F.col("label")).isEmpty():
            return labels


def component_table(marked: DataFrame, distance: int = 3) -> DataFrame:
    """``fingerprint, label`` of every fingerprint that has a link."""
    nodes = checkpointed(marked.select("fingerprint").distinct())
    return components(near_pairs(nodes, distance)) \
        .withColumnRenamed("node", "fingerprint")


def _labelled(marked: DataFrame, distance: int) -> DataFrame:
    linked = component_table(marked, distance)
    return marked.join(linked, "fingerprint", "left") \
        .withColumn("label", F.coalesce("label", "fingerprint"))


def near_copies(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    ``component_id`` is the smallest doc_id that links reach from the row's
    fingerprint, itself included.
    """
    marked = checkpointed(fingerprints(docs, F.col("doc_id"), shingle=shingle))
    per_node = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    node_labels = _labelled(per_node, distance)
    names = node_labels.groupBy("label").agg(F.min("least").alias("component_id"))
    nodes = node_labels.join(names, "label").select("fingerprint", "component_id")
    return marked.join(nodes, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component.

    The row with the smallest doc_id stays (rows without one come last, then
    the smallest text hash; of rows that agree in both, any).
    """
    keys = (F.col("doc_id"), row_key("doc_id", "text").alias("__key"))
    marked = checkpointed(fingerprints(docs, *keys, shingle=shingle))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__key"))
    per_node = marked.groupBy("fingerprint").agg(first.alias("least"))
    stay = _labelled(per_node, distance).groupBy("label") \
        .agg(F.min("least").alias("least")).select(F.col("least.__key").alias("__key"))
    rows = docs.select(F.struct("*").alias("__row"), keys[1])
    return rows.join(stay, "__key").dropDuplicates(["__key"]).select("__row.*")
