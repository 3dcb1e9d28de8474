"""Token ids in Arrow files of equal-length sequences, for zero-copy random access.

The ids of all documents, in ascending doc_id order and each followed by an end id,
form one stream. Spark deals the documents into ranges of doc_id; a task sorts its
range, encodes it and writes two Arrow files (the random-access form of Arrow's stream
format):

- ``sequences``: batches of ``fixed_size_list<uint16>[length]`` ids (uint32 for
  vocabularies beyond 65,536) and ``fixed_size_list<bool>[length]`` mask. All batches
  but the last hold the same number of sequences, so sequence i is row ``i % batch`` of
  batch ``i // batch``, read from a memory map without a copy (:func:`sequence`). Only
  the file's last sequence is padded (id 0, mask false).
- ``documents``: doc_id, its first position in the file's ids and its number of ids.

A task names its files by part and attempt. Spark's committed write of the manifest
decides which attempt counts, so a retried or speculative task leaves an unlisted file,
never a wrong one. :func:`read_documents` reads the listed files back, a batch at a time.

Encoding: the vocabulary drops white space and never looks across it, so the ids of a
text are those of its white-space separated pieces. Arrow splits the texts of a batch
and finds their distinct pieces; those are encoded by the library, thousands at a time,
once per Python worker while they are met again.

Defined cases: a null or empty text is its end id alone; the vocabulary's special
strings inside a text are one id each, as the library does by default; texts of any
length are encoded whole and may fill many sequences; null doc_ids come last, rows that
share a doc_id follow in the order of their texts' hashes, equal rows are
interchangeable; an empty table writes no file and reads back no row; extra columns are
ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from demandcast.llm.common import partitions, text_or_empty

#: Ids of a sequence, and sequences of a batch.
LENGTH, BATCH = 1024, 64
#: Id after every document (the query's contract), and the id of padding.
END_ID, PAD_ID = 2, 0
#: Pieces kept per Python worker (twice as many at most, beside those of one part of a
#: batch), the longest one kept, and how many are encoded at once.
CACHE_ENTRIES, CACHE_CHARS, AT_ONCE = 250_000, 48, 4096
#: Documents of an Arrow batch that are encoded together.
HELD_TEXTS = 4096
#: Stands between pieces that are encoded at once: one id, and no part of another token.
BETWEEN = "\x01"
_MANIFEST = "part int, sequences string, documents string, n_docs long, n_ids long"


@lru_cache(maxsize=2)
def _library(path: str | None):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))


@lru_cache(maxsize=2)
def id_dtype(path: str | None = None) -> np.dtype:
    """The narrowest type that holds every id of the vocabulary, little-endian."""
    return np.dtype("<u2" if max(_library(path).get_vocab().values()) < 1 << 16 else "<u4")


def split_tails(pieces: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Pieces as the vocabulary reads them: lower case, closing marks apart.

    Both only where that cannot change the ids: ASCII pieces (other letters may compose
    differently in another case), and marks that follow an ASCII letter or digit.
    """
    low = pc.if_else(pc.string_is_ascii(pieces), pc.ascii_lower(pieces), pieces)
    parts = pc.extract_regex(low, r"\A(?P<core>(?s:.*)[A-Za-z0-9])(?P<tail>[.,;:!?]+)\z")
    core, tail = (pc.struct_field(parts, i) for i in (0, 1))
    return pc.coalesce(core, low), pc.coalesce(tail, pa.scalar(""))


@lru_cache(maxsize=2)
def text_encoder(path: str | None = None) -> Callable[[pa.Array], tuple[memoryview, list[int]]]:
    """``encode(texts)``: the ids of all texts as bytes (as :func:`id_dtype`), and where
    each text's ids start, with the end of the last."""
    library, dtype = _library(path), id_dtype(path)
    width = dtype.itemsize

    def ids_of(text: str) -> np.ndarray:
        return np.array(library.encode(text, add_special_tokens=False).ids, dtype)

    special = [t.content for t in library.get_added_tokens_decoder().values()]
    odd = re.compile("|".join(map(re.escape, [*special, BETWEEN]))).search
    (between,) = ids_of(BETWEEN).tolist()
    # the pieces met lately, and those met before; what is met again moves over
    known: dict[str, bytes] = {}
    older: dict[str, bytes] = {}

    def encode_all(pieces: list[str]) -> Iterator[bytes]:
        """Ids of many pieces, a few thousand in one call."""
        for at in range(0, len(pieces), AT_ONCE):
            ids = ids_of(f" {BETWEEN} ".join(pieces[at:at + AT_ONCE]))
            raw, start = ids.tobytes(), 0
            for end in (*np.flatnonzero(ids == between).tolist(), len(ids)):
                yield raw[width * start:width * end]
                start = end + 1

    def encode(texts: pa.Array) -> tuple[memoryview, list[int]]:
        nonlocal known, older
        if len(known) > CACHE_ENTRIES:
            known, older = {}, known
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        parts = [part.dictionary_encode() for part in split_tails(coded.dictionary)]
        # to_numpy() makes the strings in one go, to_pylist() an Arrow scalar for each
        met = [part.dictionary.to_numpy(zero_copy_only=False).tolist() for part in parts]
        new = [p for p in dict.fromkeys([*met[0], *met[1]]) if p not in known]
        known.update([(p, older[p]) for p in new if p in older])
        new = [p for p in new if p not in older]
        plain = [p for p in new if not odd(p)]
        known.update(zip(plain, encode_all(plain)))
        known.update([(p, ids_of(p).tobytes()) for p in new if odd(p)])
        found = [pa.array([known[p] for p in words], pa.large_binary()).take(part.indices)
                 for words, part in zip(met, parts)]
        ids = pc.binary_join_element_wise(*found, pa.scalar(b"", pa.large_binary())).take(coded.indices)
        for p in new:
            if len(p) > CACHE_CHARS:
                del known[p]
        _, ends, raw = ids.buffers()
        ends = np.frombuffer(ends, np.int64)[:len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        return memoryview(raw or b""), ends[split.offsets.to_numpy()].tolist()

    return encode


class _SequenceFile:
    """Collects id bytes and writes them as batches of equal-length sequences."""

    def __init__(self, sink, dtype: np.dtype, length: int, batch: int):
        self.dtype, self.length, self.batch, self.n = dtype, length, batch, 0
        self.full = dtype.itemsize * length * batch
        self.schema = sequence_schema(length, dtype)
        self.file = pa.ipc.new_file(sink, self.schema)
        self.waiting: list[bytes] = []
        self.size = 0

    def add(self, ids: bytes) -> None:
        self.waiting.append(ids)
        self.size += len(ids)
        self.n += len(ids) // self.dtype.itemsize
        if self.size >= self.full:
            self._write(whole=True)

    def _write(self, whole: bool) -> None:
        raw, full = b"".join(self.waiting), self.full
        end = len(raw) // full * full if whole else len(raw)
        for at in range(0, end, full):
            self._write_batch(np.frombuffer(raw[at:min(at + full, end)], self.dtype))
        self.waiting, self.size = [raw[end:]], len(raw) - end

    def _write_batch(self, ids: np.ndarray) -> None:
        rows = -(-len(ids) // self.length)
        padded = np.full(rows * self.length, PAD_ID, self.dtype)
        mask = np.arange(rows * self.length) < len(ids)
        padded[:len(ids)] = ids
        self.file.write_batch(pa.RecordBatch.from_arrays(
            [pa.FixedSizeListArray.from_arrays(pa.array(v), self.length) for v in (padded, mask)],
            schema=self.schema))

    def close(self) -> None:
        if self.size:
            self._write(whole=False)
        self.file.close()


def sequence_schema(length: int, dtype: np.dtype) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)),
                      ("mask", pa.list_(pa.bool_(), length))])


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID,
                      length: int = LENGTH, batch: int = BATCH, parts: int | None = None) -> DataFrame:
    """Write all documents below ``folder``; return the manifest, a row per written part.

    ``folder`` is a URI that the executors reach (local path, hdfs, s3, ...), ``path``
    the vocabulary file as they see it.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, encode, dtype = task.partitionId(), text_encoder(path), id_dtype(path)
        end = np.array([end_id], dtype).tobytes()
        store, base = pafs.FileSystem.from_uri(folder)
        names = [f"{kind}-{part:06d}-{task.taskAttemptId()}.arrow" for kind in ("sequences", "documents")]
        n_docs, sinks = 0, []
        # what is held beside a batch grows with the distinct pieces of the part encoded
        for got in (b.slice(at, HELD_TEXTS) for b in batches for at in range(0, b.num_rows, HELD_TEXTS)):
            if not sinks:
                sinks = [store.open_output_stream(f"{base}/{name}") for name in names]
                sequences = _SequenceFile(sinks[0], dtype, length, batch)
                table = pa.schema([("doc_id", got.schema.field("doc_id").type), ("start", pa.int64()),
                                   ("n_tokens", pa.int64())])
                documents = pa.ipc.new_file(sinks[1], table)
            starts, sizes = [], []
            raw, places = encode(got.column("text"))
            for first, last in zip(places, places[1:]):
                starts.append(sequences.n)
                sequences.add(raw[first:last].tobytes() + end)
                sizes.append(sequences.n - starts[-1])
            documents.write_batch(pa.RecordBatch.from_arrays(
                [got.column("doc_id"), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=table))
            n_docs += got.num_rows
        if sinks:
            sequences.close()
            documents.close()
            for sink in sinks:
                sink.close()
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "sequences": [names[0]], "documents": [names[1]],
                 "n_docs": [n_docs], "n_ids": [sequences.n]})

    make_folder(folder)
    text = text_or_empty()
    # rows that share a doc_id, copies included, still spread over several ranges
    order = [F.col("doc_id").asc_nulls_last(), "__text", "__row"]
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("__text"),
                       F.monotonically_increasing_id().alias("__row"))
    dealt = rows.repartitionByRange(parts or partitions(spark), *order).sortWithinPartitions(*order)
    manifest = f"{folder}/manifest"
    dealt.select("doc_id", "text").mapInArrow(run, _MANIFEST).write.parquet(manifest)
    return spark.read.schema(_MANIFEST).parquet(manifest)


def make_folder(folder: str) -> None:
    """Create ``folder``; object stores need none."""
    store, base = pafs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)


def open_arrow(folder: str, name: str) -> pa.ipc.RecordBatchFileReader:
    """An Arrow file below ``folder``, memory-mapped where the file is local."""
    store, base = pafs.FileSystem.from_uri(folder)
    local = isinstance(store, pafs.LocalFileSystem)
    at = f"{base}/{name}"
    return pa.ipc.open_file(pa.memory_map(at) if local else store.open_input_file(at))


def sequence(reader: pa.ipc.RecordBatchFileReader, i: int) -> tuple[np.ndarray, pa.Array]:
    """Ids and mask of the file's sequence ``i``: views of the mapped file, no copy.

    The mask is an Arrow array of bits; numpy has no view of those.
    """
    size = reader.get_batch(0).num_rows
    batch = reader.get_batch(i // size)
    n = batch.schema.field("ids").type.list_size
    ids, mask = (batch.column(c).flatten().slice(i % size * n, n) for c in ("ids", "mask"))
    return ids.to_numpy(zero_copy_only=True), mask


def stored_ids(reader: pa.ipc.RecordBatchFileReader) -> Iterator[np.ndarray]:
    """The file's ids without padding, a batch at a time."""
    for i in range(reader.num_record_batches):
        batch = reader.get_batch(i)
        ids, mask = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("ids", "mask"))
        yield ids if mask.all() else ids[mask]


def read_documents(spark: SparkSession, folder: str, manifest: DataFrame, id_type: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the listed files.

    ``start`` counts the ids of all documents before it; ``ids_crc32`` is taken over the
    ids as they stand in the sequences, each as 32 bits.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            for row in got.to_pylist():
                chunks = stored_ids(open_arrow(folder, row["sequences"]))
                chunk, at = next(chunks), 0
                table = open_arrow(folder, row["documents"])
                for i in range(table.num_record_batches):
                    docs = table.get_batch(i)
                    sums = []
                    for need in docs.column("n_tokens").to_pylist():
                        crc = 0
                        while need:
                            if at == len(chunk):
                                chunk, at = next(chunks), 0
                            take = min(need, len(chunk) - at)
                            crc = zlib.crc32(chunk[at:at + take].astype("<u4").tobytes(), crc)
                            at, need = at + take, need - take
                        sums.append(crc)
                    starts = pa.array(docs.column("start").to_numpy() + row["before"], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [docs.column("doc_id"), starts, docs.column("n_tokens"), pa.array(sums, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # one row a written part: few, whatever the documents
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    listed = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))
    return (listed.repartitionByRange(partitions(spark), "part")
            .mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long"))
