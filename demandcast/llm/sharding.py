"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``points`` places (virtual nodes) on a ring of ``cells`` equal
hash cells; a row's key hashes to a cell and belongs to the next place
clockwise. A shard takes rows until it is full; rows that find it full continue
clockwise to the next place of a shard with room. Capacities add up to the row
count and differ by at most one, so the counts of any two shards do, whatever
the keys are (law ``rows``); with another shard count only the arcs that the
new places cut and the overflow move.

What runs where: rows are hashed and counted per cell on the executors; the
``cells`` counts (a fixed number, whatever the table size) go to the driver,
which walks the ring once and returns at most ``places x shards`` pieces, each a
run of consecutive rows of one arc that one shard takes. A row finds its piece
by its running number in the arc: the cell's offset plus its number in the cell.
Nothing but narrow rows (id, size, checksum, hash) is shuffled, by cell.

Defined cases: a null text is empty (size 1); rows without a doc_id are placed
by their text; rows that agree in id and text are interchangeable; an empty
table gives an empty result; extra columns are ignored (or carried by
:func:`shard_documents`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from demandcast.llm.common import text_or_empty

#: Hash cells of the ring (the unit that is counted) and places per shard.
CELLS = 4096
POINTS = 64
_CELL, _KEY = "__cell", "__key"


def ring(spark: SparkSession, shards: int, points: int = POINTS,
         cells: int = CELLS) -> list[tuple[int, int]]:
    """The places of all shards as (cell, shard), clockwise.

    A place ends its cell; two places that hash to one cell stand in shard
    order there, and the first of them takes the cell's rows.
    """
    place = F.pmod(F.xxhash64(F.concat_ws("#", F.lit("place"), F.col("shard").cast("string"),
                                          F.col("point").cast("string"))), F.lit(cells))
    rows = (spark.range(shards).select(F.col("id").alias("shard"),
                                       F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
            .select(place.alias("cell"), F.col("shard").cast("int").alias("shard")).collect())
    return sorted((r.cell, r.shard) for r in rows)


def walk(counts: dict[int, int], places: list[tuple[int, int]],
         shards: int) -> tuple[dict[int, tuple[int, int]], list[tuple[int, int, int, int, int]]]:
    """Let every arc's rows walk clockwise until each has a shard with room.

    Returns the offset of every cell in its arc, ``cell -> (arc, offset)``, and
    the pieces ``(arc, first, last, shard, slot)``: rows ``first`` to ``last``
    (exclusive) of the arc go to ``shard``, the first of them to ``slot``.
    """
    n = sum(counts.values())
    room = [n // shards + (s < n % shards) for s in range(shards)]
    taken = [0] * shards
    arcs = [[0, 0] for _ in places]          # rows of the arc: all, placed
    offsets: dict[int, tuple[int, int]] = {}
    at = 0
    for cell in sorted(counts):
        while at < len(places) and places[at][0] < cell:
            at += 1
        arc = at % len(places)                # beyond the last place: the first
        offsets[cell] = (arc, arcs[arc][0])
        arcs[arc][0] += counts[cell]
    pieces = []
    waiting = [a for a, x in enumerate(arcs) if x[0]]
    for step in range(len(places)):
        for arc in waiting:
            shard = places[(arc + step) % len(places)][1]
            take = min(room[shard] - taken[shard], arcs[arc][0] - arcs[arc][1])
            if take > 0:
                first = arcs[arc][1]
                pieces.append((arc, first, first + take, shard, taken[shard]))
                arcs[arc][1] += take
                taken[shard] += take
        waiting = [a for a in waiting if arcs[a][1] < arcs[a][0]]
        if not waiting:
            break
    return offsets, pieces


def _hashed(docs: DataFrame, *keep: Column, cells: int) -> DataFrame:
    key = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit("text"), text_or_empty())) \
        .otherwise(F.xxhash64(F.col("doc_id")))
    return (docs.select(*keep, key.alias(_KEY))
            .withColumn(_CELL, F.pmod(F.col(_KEY), F.lit(cells)).cast("int")))


def _place(rows: DataFrame, order: list[str], counts: dict[int, int], shards: int,
           points: int, cells: int) -> DataFrame:
    """Add ``__shard`` and ``__slot`` to rows that have a cell."""
    spark = rows.sparkSession
    offsets, pieces = walk(counts, ring(spark, shards, points, cells), shards)
    runs: dict[int, list] = {}
    for piece in pieces:
        runs.setdefault(piece[0], []).append(piece[1:])
    table = [(cell, offset, runs[arc]) for cell, (arc, offset) in offsets.items()]
    # at most `cells` rows; each lists the few pieces of its arc
    lookup = spark.createDataFrame(
        table, f"{_CELL} int, __offset long, "
        "__runs array<struct<first: long, last: long, shard: int, slot: long>>")
    w = Window.partitionBy(_CELL).orderBy(_KEY, *order)
    nth = rows.withColumn("__nth", F.row_number().over(w).cast("long") - 1)
    run = F.filter("__runs", lambda r: (r["first"] <= F.col("__index"))
                   & (F.col("__index") < r["last"]))[0]
    return (nth.join(F.broadcast(lookup), _CELL)
            .withColumn("__index", F.col("__offset") + F.col("__nth"))
            .withColumn("__run", run)
            .withColumn("__shard", F.col("__run.shard"))
            .withColumn("__slot", F.col("__run.slot") + F.col("__index") - F.col("__run.first")))


def _counts(rows: DataFrame) -> dict[int, int]:
    """Rows per cell: at most ``cells`` numbers."""
    return {r[0]: r[1] for r in rows.groupBy(_CELL).count().collect()}


def assign_shards(docs: DataFrame, shards: int = 8, points: int = POINTS,
                  cells: int = CELLS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row."""
    text = text_or_empty()
    size = (F.octet_length(text) + 1).cast("long")
    rows = _hashed(docs, F.col("doc_id"), size.alias("size"),
                   F.crc32(text.cast("binary")).alias("text_crc32"), cells=cells)
    placed = _place(rows, ["doc_id", "size", "text_crc32"],
                    _counts(_hashed(docs, cells=cells)), shards, points, cells)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
                         F.col("__shard").alias("shard"), F.col("__slot").alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"))


def shard_documents(docs: DataFrame, shards: int = 8, points: int = POINTS,
                    cells: int = CELLS) -> DataFrame:
    """Every row with all its columns, plus ``shard`` and ``slot``.

    The columns travel as one struct, so any names are fine; an input column
    called ``shard`` or ``slot`` is replaced.
    """
    text = text_or_empty()
    keep = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    rows = _hashed(docs, F.struct(*keep).alias("__row"), F.col("doc_id").alias("__id"),
                   F.xxhash64(text).alias("__text"), cells=cells)
    placed = _place(rows, ["__id", "__text"], _counts(_hashed(docs, cells=cells)),
                    shards, points, cells)
    return placed.select("__row.*", F.col("__shard").alias("shard"), F.col("__slot").alias("slot"))
