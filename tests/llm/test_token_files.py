"""Operator 13 against the tokenizer library, and its files' layout."""

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from demandcast.llm import queries, token_files
from demandcast.session import shared_path

CHECK = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, start long, n_tokens long, part int, ids_crc32 string"


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def plain(rows, library):
    """doc_id, start, n_tokens, crc of (doc_id, text) rows that are in order."""
    out, start = [], 0
    for doc_id, text in rows:
        ids = np.array([*library(text), 2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def encoded(texts):
    raw, places = token_files.text_encoder()(pa.array(texts, pa.string()))
    return [np.frombuffer(raw[a:b], token_files.id_dtype()).tolist() for a, b in zip(places, places[1:])]


def written(spark, docs, **options):
    folder = shared_path(spark, f"test-tokens/{uuid.uuid4().hex}")
    manifest = token_files.write_token_files(docs, folder, **options)
    return folder, manifest, token_files.read_documents(spark, folder, manifest, "bigint")


def test_query_equals_the_library(spark, library):
    rows = spark.read.parquet(f"{CHECK}/documents.parquet").select("doc_id", "text").collect()
    want = plain(sorted((r.doc_id, r.text) for r in rows), library)
    got = queries.op13_token_files(spark, CHECK)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(
    st.characters(exclude_categories=("Cs", "Cn")),
    st.sampled_from("<|endoftext|> \n\t'sdtlrev09½Ⅷ\u0085\xa0\x1ćΣς̇İ<|startoftext|>")), max_size=60), max_size=6))
def test_pieces_equal_the_library_on_any_text(texts):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert encoded(texts) == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_special_strings_and_long_pieces(library):
    texts = ["a <|endoftext|> b<|startoftext|>c", "x" * 5000, "", "<|endoftext|>", " \n", "it's 2024, naïve é é"]
    assert encoded(texts) == [library(x) for x in texts]


def test_pieces_are_forgotten_by_generations(library, monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_ENTRIES", 5)
    for i in range(6):
        texts = [f"always word{i} <|endoftext|> {'long' * 30}", f"word{i - 1} word{i - 2} \x01 a\x01b"]
        assert encoded(texts) == [library(x) for x in texts]


def test_a_batch_is_encoded_in_parts(spark, library):
    docs = spark.createDataFrame([(i, f"piece{i} of {i % 7}", 9, 9, 9, "x") for i in range(token_files.HELD_TEXTS + 50)],
                                 SCHEMA).coalesce(1)
    folder, manifest, read = written(spark, docs, parts=1)
    table = token_files.open_arrow(folder, manifest.first().documents)
    sizes = [table.get_batch(i).num_rows for i in range(table.num_record_batches)]
    assert sizes == [token_files.HELD_TEXTS, 50]
    got = sorted((r.doc_id, r.start, r.n_tokens) for r in read.collect())
    place = 0
    for (doc_id, start, n), i in zip(got, range(len(got))):
        assert (doc_id, start, n) == (i, place, len(library(f"piece{i} of {i % 7}")) + 1)
        place += n


def test_edges(spark, library):
    long = "many words here " * 20_000
    rows = [(5, "five"), (None, "no id"), (1, None), (2, ""), (3, long), (3, long), (4, "four"), (4, "other four"),
            (None, None), *[(7, "hot row")] * 300]
    docs = spark.createDataFrame([(*r, 9, 9, 9, "x") for r in rows], SCHEMA).repartition(5)
    folder, manifest, read = written(spark, docs, length=16, batch=4, parts=6)
    got = sorted(map(tuple, read.collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [1, 2, 3, 3, 4, 4, 5, *[7] * 300, None, None]  # nulls last
    texts = {}
    for i, t in rows:
        texts.setdefault(i, set()).add(zlib.crc32(np.array([*library(t), 2], "<u4").tobytes()))
    place = 0
    for doc_id, start, n, crc in got:
        assert start == place and crc in texts[doc_id]
        place += n
    assert place == sum(r.n_ids for r in manifest.collect())
    assert manifest.count() > 2  # the copies of one row are split over parts


def test_sequences_are_equal_length_views(spark, library):
    docs = spark.createDataFrame([(i, f"document number {i} of many") for i in range(200)], "doc_id long, text string")
    folder, manifest, _ = written(spark, docs, length=32, batch=3, parts=2)
    stream = []
    for row in sorted(manifest.collect(), key=lambda r: r.part):
        reader = token_files.open_arrow(folder, row.sequences)
        assert reader.schema.equals(token_files.sequence_schema(32, token_files.id_dtype()))
        sizes = [reader.get_batch(i).num_rows for i in range(reader.num_record_batches)]
        assert set(sizes[:-1]) <= {3} and sum(sizes) == -(-row.n_ids // 32)
        before = pa.total_allocated_bytes()
        parts = [token_files.sequence(reader, i) for i in range(sum(sizes))]
        assert pa.total_allocated_bytes() == before  # views of the mapped file
        ids = np.concatenate([p[0] for p in parts])
        mask = np.concatenate([p[1].to_numpy(zero_copy_only=False) for p in parts])
        assert mask.sum() == row.n_ids and mask[:row.n_ids].all()
        assert (ids[row.n_ids:] == token_files.PAD_ID).all()
        stream += ids[:row.n_ids].tolist()
    assert stream == [x for i in range(200) for x in (*library(f"document number {i} of many"), 2)]


def test_empty_table(spark):
    _, manifest, read = written(spark, spark.createDataFrame([], SCHEMA))
    assert manifest.count() == 0 and read.count() == 0
