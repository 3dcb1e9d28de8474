"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandcast.session import checkpointed, ensure_checkpoint_dir  # noqa: F401

#: ASCII white space and words, as the query contracts define them.
WORD_SPLIT = r"[\x20\x09-\x0D]+"
#: Spans that are replaced together, and code points that are cut together.
CHUNK, BLOCK = 256, 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """The ASCII-white-space separated words of a text as an array (never null)."""
    # split() leaves one empty string at either end of a text that begins or
    # ends with white space, and for an empty text
    return F.array_remove(F.split(text, WORD_SPLIT), "")


def row_key(*names: str) -> Column:
    """A 64-bit hash of the given columns; nulls count by their position."""
    return F.xxhash64(*[c for n in names
                        for c in (F.col(n), F.col(n).isNull())])


def partitions(spark: SparkSession) -> int:
    """The session's shuffle partition count."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_fields(fields: list[T.StructField], ddl: str) -> T.StructType:
    """The given fields followed by those of a DDL text."""
    return T.StructType([*fields, *T.StructType.fromDDL(ddl).fields])


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def redacted(text: Column, spans: Column, chunk: int = CHUNK, block: int = BLOCK) -> Column:
    """The text with every span (sorted by start) replaced by ``[kind]``; overlaps count once.

    A span stands if it begins at or after every end before it. What lies between spans is
    taken from blocks of the text, and pieces are appended within chunks of spans, so a
    long text with many spans costs little more than its length.
    """
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))

    def piece(held: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / block).cast("int")
        last = F.floor((F.greatest(end, start + 1) - 1) / block).cast("int")
        some = F.array_join(F.slice(held, first + 1, last - first + 1), "")
        return F.substring(some, (start - first * block + 1).cast("int"), (end - start).cast("int"))

    def ends(part: Column, first: Column) -> Column:
        return F.aggregate(part, first, lambda at, s: F.greatest(at, s["end"].cast("long")))

    def replaced(held: Column, part: Column, first: Column) -> Column:
        return F.aggregate(
            part, F.struct(first.alias("at"), F.array().cast("array<string>").alias("out")),
            lambda acc, s: F.struct(
                F.greatest(acc["at"], s["end"].cast("long")).alias("at"),
                F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(F.concat(
                    piece(held, acc["at"], s["start"].cast("long")), F.lit("["), s["kind"], F.lit("]")))))
                .otherwise(acc["out"]).alias("out")),
            lambda acc: acc["out"])

    def of(held: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / chunk).cast("int")),
                            lambda c: F.slice(spans, c * chunk + 1, chunk))
        return once(parts, lambda cut: once(_running(cut, ends), lambda at: F.concat(
            F.array_join(F.flatten(F.zip_with(cut, at, lambda p, a: F.when(
                a.isNotNull() & p.isNotNull(), replaced(held, p, a)).otherwise(F.array().cast("array<string>")))), ""),
            piece(held, F.element_at(at, -1), F.length(text).cast("long")))))

    return F.when(F.size(spans) == 0, text).otherwise(once(blocks, of))


def _running(parts: Column, ends) -> Column:
    """The end reached before every part, and after the last one."""
    return F.aggregate(
        parts, F.array(F.lit(0).cast("long")),
        lambda acc, part: F.concat(acc, F.array(ends(part, F.element_at(acc, -1)))))
