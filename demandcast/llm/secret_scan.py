"""Secret scan: base patterns plus dictionary-primed zstandard novelty.

Base spans come from three patterns (``assign``, ``access``, ``hex``). The
method adds ``novel`` spans: a candidate is a run of token characters that stands in
the block of a sensitive word, before or after it, and lies outside the base spans. A
block is what blank lines enclose (with the next block, if it ends in ``:`` or ``=``),
and the whole of a ``-----BEGIN ...`` to its ``-----END`` marker (or to the blank line
after it, if there is none). Its novelty is its marginal compressed size per byte:

- a run of 16 or more with letters and digits (dotted runs of such length are one, as in
  web tokens) is compressed alone, primed with a raw dictionary of identifiers and of
  the text around it; the bytes of an empty frame are taken off;
- any other plain run of letters and digits, from ``SHORT`` on, is compressed at the end of the text around it, less that text alone,
  primed with the identifiers. There the letters' own frequencies count, so natural words stay
  far below random ones. Shorter runs need more (``WITHIN``). Digits alone are left out: from
  16 on they are base spans (``hex``), below that numbers of every sort.

Natural identifiers and strings that the surrounding text repeats compress away;
random keys do not and are reported.

Offsets are code points, end exclusive. Defined cases: a null text counts as
empty (no spans); whole texts of any length are searched; repeated rows each
give a row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame

from demandcast.llm.common import text_or_empty, with_fields

KINDS = ("assign", "access", "hex", "novel")
BASE = KINDS[:3]


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
#: Fixed patterns of the base spans. Cases are spelled out: ignoring case would
#: also fold letters outside ASCII.
ASSIGN = re.compile(rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST = 12

#: Words that make their block a sensitive context.
SENSITIVE = ("password", "passwd", "passphrase", "secret", "token", "api_?key", "apikey",
             "auth", "bearer", "credential", "private", "access", "signature")
_SENSITIVE = re.compile("|".join(map(_either_case, SENSITIVE)))
#: Least lengths of a run, and of one that is compressed alone.
SHORT, LONG = 12, 16
_TOKEN = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORT},}}(?:\.[A-Za-z0-9+/_=-]{{{LONG},}})*")
_PLAIN = re.compile(r"[A-Za-z0-9]+")
_LETTER_AND_DIGIT = re.compile(r"(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])")
_BLANK = re.compile(r"\n[^\S\n]*(?=\n)|\r[^\S\r\n]*(?=\r)")
_BEGIN, _END = "-----BEGIN ", "-----END"
#: Code points around a candidate that are looked at.
AROUND = 512
#: Marginal compressed bytes per byte from which a candidate is reported.
NOVELTY = 0.8
#: The same for plain runs measured within the text: below ``LONG``, and from there on.
WITHIN = (1.0, 0.75)
#: Names common in configuration and program text, priming the compressor.
IDENTIFIERS = """
access_key access_token account admin api_key application authorization bearer
certificate client_id client_secret config configuration connection connection_string
credential credentials database default description development encryption endpoint
environment false function hostname identifier import localhost null number object
parameter password private_key production property protocol public_key refresh_token
region repository request response return schema secret_key server service session
session_token signature string system timeout token true undefined update username
value variable version abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789
example placeholder changeme your_token_here xxxxxxxxxxxxxxxx 0000000000000000
""".split()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of the base spans."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text)
             if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


@lru_cache(maxsize=8)
def _identifiers(words: tuple[str, ...]) -> bytes:
    return " ".join(words).encode()


def novelty(candidate: str, around: str, identifiers: tuple[str, ...] = tuple(IDENTIFIERS)) -> float:
    """Marginal compressed bytes per byte of a candidate, primed with its surroundings."""
    import zstandard as zstd

    primed = zstd.ZstdCompressionDict(_identifiers(identifiers) + b" " + around.encode("utf-8", "replace"),
                                      dict_type=zstd.DICT_TYPE_RAWCONTENT)
    compress = zstd.ZstdCompressor(level=19, dict_data=primed, write_content_size=False,
                                   write_dict_id=False).compress
    raw = candidate.encode()
    return (len(compress(raw)) - len(compress(b""))) / len(raw)


def novelty_within(candidate: str, around: str,
                   identifiers: tuple[str, ...] = tuple(IDENTIFIERS)) -> float:
    """Marginal compressed bytes per byte of a candidate at the end of its surroundings."""
    import zstandard as zstd

    primed = zstd.ZstdCompressionDict(_identifiers(identifiers), dict_type=zstd.DICT_TYPE_RAWCONTENT)
    compress = zstd.ZstdCompressor(level=19, dict_data=primed, write_content_size=False,
                                   write_dict_id=False).compress
    context = around.encode("utf-8", "replace") + b" "
    return (len(compress(context + candidate.encode())) - len(compress(context))) / len(candidate)


def _is_novel(candidate: str, around: str, least: float) -> bool:
    if len(candidate) >= LONG and _LETTER_AND_DIGIT.match(candidate):
        return novelty(candidate, around) >= least
    if candidate.isdigit() or not _PLAIN.fullmatch(candidate):
        return False
    return novelty_within(candidate, around) >= WITHIN[len(candidate) >= LONG]


def sensitive_blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of the blocks with a sensitive word, in order and apart.

    Words, markers and line ends are located once each and looked up by place, so a
    text full of markers costs no more than its length.
    """
    words = [m.span() for m in _SENSITIVE.finditer(text)]
    if not words:
        return []
    starts = [s for s, _ in words]
    edges = sorted({0, len(text), *(m.start() for m in _BLANK.finditer(text))})
    found, announced = [], False
    for start, end in zip(edges, edges[1:]):
        word = bisect_left(starts, start)
        body = text[start:end].strip()
        if announced or (word < len(starts) and starts[word] < end):
            found.append((start, end))
            # a heading or a key whose value stands below the blank line
            own = word < len(starts) and starts[word] < end
            announced = body.endswith((":", "=")) if own else announced and not body
    # a marker's block may hold blank lines; markers inside a block found are part of it
    ends, lines = ([m.start() for m in re.finditer(p, text)] for p in (_END, "\n"))
    done = 0
    for marker in re.finditer(_BEGIN, text) if ends else ():
        at = marker.start()
        place = bisect_left(ends, at)
        if place == len(ends):
            break
        if at < done:
            continue
        line = bisect_left(lines, at)
        stop = min(ends[place], lines[line]) if line < len(lines) else ends[place]
        word = bisect_left(starts, at)
        if word < len(words) and words[word][1] <= stop:
            done = ends[place]
            found.append((at, done))
    merged = []
    for start, end in sorted(found):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def novel_spans(text: str, base: list[tuple[int, int, int]],
                least: float = NOVELTY) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of incompressible strings in sensitive context."""
    found, cuts = [], sorted((s, e) for s, _, e in base)
    ends = list(accumulate((e for _, e in cuts), max))
    for first, last in sensitive_blocks(text):
        for m in _TOKEN.finditer(text, first):
            start, end = m.span()
            if start >= last:
                break
            before = bisect_left(cuts, (end,))   # base spans that begin before its end
            if before and ends[before - 1] > start:
                continue
            around = text[max(0, start - AROUND):start] + text[end:end + AROUND]
            if _is_novel(m[0], around, least):
                found.append((start, 3, end))
    return found


def scan_secrets(docs: DataFrame, *keep: Column, least: float = NOVELTY) -> DataFrame:
    """``*keep, spans`` of every whole text, spans by start, then kind as listed.

    ``spans`` is ``array<struct<kind, start, end>>``; kinds as in :data:`KINDS`.
    """
    rows = docs.select(*keep, text_or_empty().alias("__text"))
    names = rows.columns[:-1]
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("__text").to_pylist():
                base = base_spans(text)
                out.append([{"kind": KINDS[k], "start": s, "end": e}
                            for s, k, e in sorted(base + novel_spans(text, base, least))])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(out, pa.list_(span))],
                names=[*names, "spans"])

    return rows.mapInArrow(run, with_fields(
        rows.schema.fields[:-1], "spans array<struct<kind: string, start: long, end: long>>"))
