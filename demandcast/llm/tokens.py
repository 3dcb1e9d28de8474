"""Token counts: heap-and-linked-list byte-pair merging, no identifiers emitted.

A text is cut into pre-tokens, each pre-token into its bytes. The adjacent pair
with the lowest merge rank is popped from a heap and joined in a doubly linked
list until no ranked pair is left; the token count is the number of bytes minus
the number of merges. The vocabulary file (public byte-level BPE, json) is read
where the work runs, its path is a parameter.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); the vocabulary's
special strings inside a text count one token each, as its library does by
default; texts of any length are counted whole (merging is ``O(n log n)``);
repeated rows each give a row; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandcast.llm.common import text_or_empty

#: Fixed pre-token pattern of the public byte-level vocabularies.
PRE_TOKEN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
             r"|\s+(?!\S)|\s+")
#: Pre-tokens whose count is remembered per Python worker, and their longest length.
CACHE_ENTRIES = 1_000_000
CACHE_CHARS = 64


def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Bits that hold a symbol, and a position, in the packed integers below.
SYMBOL_BITS, PLACE_BITS = 17, 31
_SYMBOL, _PLACE = (1 << SYMBOL_BITS) - 1, (1 << PLACE_BITS) - 1


def pack_ranks(merges: list[tuple[int, int, int]]) -> dict[int, int]:
    """(left, right, joined) in rank order -> pair to ``(rank + 1, joined)``, packed."""
    return {left << SYMBOL_BITS | right: (rank + 1) << SYMBOL_BITS | joined
            for rank, (left, right, joined) in enumerate(merges)}


def count_merges(symbols: list[int], ranks: dict[int, int]) -> int:
    """Merges that byte-pair encoding makes in a sequence of symbols.

    ``ranks`` as from :func:`pack_ranks`. ``best[i]`` is the ranked merge of
    the pair that starts at ``i`` (0: none); the heap holds ``(best[i], i)``,
    and an entry that no longer equals ``best[i]`` is skipped when popped.
    """
    s, n, get = list(symbols), len(symbols), ranks.get
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    best = [get(a << SYMBOL_BITS | b, 0) for a, b in zip(s, s[1:])]
    best.append(0)
    heap = [f << PLACE_BITS | i for i, f in enumerate(best) if f]
    heapq.heapify(heap)
    push, pop = heapq.heappush, heapq.heappop
    merges = 0
    while heap:
        entry = pop(heap)
        i, f = entry & _PLACE, entry >> PLACE_BITS
        if best[i] != f:
            continue
        merges += 1
        j = after[i]
        best[j] = 0
        after[i] = k = after[j]
        s[i] = joined = f & _SYMBOL
        best[i] = 0
        if k < n:
            before[k] = i
            if g := get(joined << SYMBOL_BITS | s[k], 0):
                best[i] = g
                push(heap, g << PLACE_BITS | i)
        if (h := before[i]) >= 0:
            best[h] = g = get(s[h] << SYMBOL_BITS | joined, 0)
            if g:
                push(heap, g << PLACE_BITS | h)
    return merges


class _Counts(dict):
    """Pre-token -> token count, computed on first use, bounded in size."""

    def __init__(self, count: Callable[[str], int]):
        super().__init__()
        self.count = count

    def __missing__(self, token: str) -> int:
        n = self.count(token)
        if len(token) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[token] = n
        return n


@lru_cache(maxsize=4)
def token_counter(path: str | None = None) -> Callable[[str], int]:
    """``count(text)`` for a byte-level BPE vocabulary file, kept per process."""
    import regex

    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    ids = model["model"]["vocab"]
    of_byte = [0] * 256
    for char, byte in byte_alphabet().items():
        of_byte[byte] = ids[char]
    pairs = [p.split(" ") if isinstance(p, str) else p for p in model["model"]["merges"]]
    ranks = pack_ranks([(ids[a], ids[b], ids[a + b]) for a, b in pairs])
    special = [t["content"] for t in model.get("added_tokens", [])]
    split_special = (regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True))))
                     if special else None)
    pre_tokens = regex.compile(PRE_TOKEN).findall

    def count_piece(token: str) -> int:
        raw = token.encode("utf-8", "replace")
        return len(raw) - count_merges([of_byte[b] for b in raw], ranks) if len(raw) > 1 else len(raw)

    counts = _Counts(count_piece)
    get = counts.__getitem__

    def count(text: str) -> int:
        if split_special is not None and any(s in text for s in special):
            parts = split_special.split(text)
            return len(parts) - 1 + sum(sum(map(get, pre_tokens(p))) for p in parts)
        return sum(map(get, pre_tokens(text)))

    return count


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text.

    ``path`` is the vocabulary file as the executors see it; by default the
    installed public one. No shuffle: each partition counts its own rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(path)
        for batch in batches:
            n_tokens = [count(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(n_tokens, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", F.octet_length(text_or_empty()).cast("long").alias("n_bytes"),
                       text_or_empty().alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
