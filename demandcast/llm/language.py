"""Language identification: script ranges, then Viterbi over per-word scores.

A model holds, per language, log probabilities of hashed character n-grams of
words, and the scripts in which the language is written. A word's script narrows
the candidate languages (script ranges); its score per candidate is the sum of
its n-grams' log probabilities, relative to the best and cut off below. Viterbi
with a switching penalty labels the words, so a text of several languages is
cut into spans; the prediction is the language with most letters.

The model is fitted on every labelled document: tasks count n-grams into arrays of
``languages x buckets``, and the table of that size that comes back doesn't grow
with the input.

Defined cases: a null text, and one without a letter, is ``und`` with score 0; a
word in a script that no language was learned in is neutral; without any labelled
row every prediction is ``und``; ties go to the first language in code point
order; whole texts of any length are labelled; repeated rows each give a row; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from itertools import chain, islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandcast.llm.common import text_or_empty, with_fields

UNKNOWN = "und"
#: Hash buckets of n-grams and their lengths.
BUCKETS, GRAMS = 1 << 16, (1, 2, 3)
#: Sums of log probabilities are kept as whole numbers of this part.
UNITS = 1 << 20
#: Cost of changing language between two words, and the least score of a word.
SWITCH, FLOOR = 12.0, -6.0
#: Share of a language's training letters from which a script is one of its own.
SCRIPT_SHARE = 0.02
#: Words whose scores are remembered per Python worker, and scores (words x languages).
CACHE_WORDS, CACHE_SCORES = 300_000, 1 << 21
#: Words of several texts from which on they are scored together.
TOGETHER = 1 << 15
#: Distinct words that a task holds, of all languages, before the n-grams of the most are
#: counted; words whose n-grams are made at once; and texts of an Arrow batch that are
#: made Python strings at once.
HELD_WORDS, GRAM_WORDS, HELD_TEXTS = 100_000, 8192, 256

#: First code points of the ranges, and the script that starts there.
SCRIPT_STARTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"),
    (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "telugu"),
    (0x0C80, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"),
    (0x3190, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
    (0x323B0, "other"),
)
_STARTS = np.array([s for s, _ in SCRIPT_STARTS])
#: Runs of letters.
WORD = re.compile(r"[^\W\d_]+")


SCRIPTS = sorted({name for _, name in SCRIPT_STARTS})
_SCRIPT_AT = np.array([SCRIPTS.index(name) for _, name in SCRIPT_STARTS])
#: Fixed odd factors that mix the code points of an n-gram.
_MIX = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def grams_by_length(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash buckets of all words' n-grams, the number of each one's word, and the words'
    scripts.

    Words are lower-cased and their ends marked; the script is that of the first
    letter. At least one word is expected.
    """
    # the marks < and > are no letters, so they only stand at the ends
    text = ("<" + "><".join(words) + ">").lower()
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    starts = np.flatnonzero(codes == ord("<"))
    word = np.cumsum(codes == ord("<")) - 1
    ends = np.append(starts[1:], len(codes))
    left = ends[word] - np.arange(len(codes))        # code points up to the word's end
    found, owner = [], []
    for n in GRAMS:
        here = np.flatnonzero(left >= n)
        mixed = np.full(len(here), n, dtype=np.uint64)
        for i in range(n):
            mixed = (mixed + codes[here + i]) * _MIX[i]
            mixed ^= mixed >> np.uint64(29)
        found.append((mixed >> np.uint64(24)) % np.uint64(BUCKETS))
        owner.append(word[here])
    script = _SCRIPT_AT[np.searchsorted(_STARTS, codes[starts + 1], side="right") - 1]
    return np.concatenate(found).astype(np.int64), np.concatenate(owner), script


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of :func:`grams_by_length` word by word, where each word's begin, and its
    script."""
    buckets, owner, script = grams_by_length(words)
    order = np.argsort(owner, kind="stable")
    return buckets[order], np.searchsorted(owner[order], np.arange(len(words))), script


class _Places(dict):
    """Words by place: a word that is asked for the first time gets the next one."""

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        return place


@dataclass
class LanguageModel:
    """Log probabilities (languages x buckets) and the languages of each script."""

    languages: list[str]
    logp: np.ndarray
    scripts: dict[str, list[int]]
    #: Per language, mean log probability of an n-gram below which words fit it no
    #: better than random letters (set by :func:`with_least_fit`).
    least: np.ndarray | None = None
    index: _Places = field(default_factory=_Places, repr=False, compare=False)
    held: tuple | None = field(default=None, repr=False, compare=False)

    def measure(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scores and log probabilities per word and language, n-grams per word, and
        whether its script is a learned one.

        Scores are 0 for the best and :data:`FLOOR` at least. Only the languages of
        the word's script compete; the others get the floor. A word in a script
        without languages is 0 for all.
        """
        buckets, begins, script = grams_of(words)
        total = np.add.reduceat(self.logp[:, buckets], begins, axis=1).T
        competes = np.zeros((len(SCRIPTS), len(self.languages)), dtype=bool)
        for name, own in self.scripts.items():
            competes[SCRIPTS.index(name), own] = True
        own = np.where(competes[script], total, -np.inf)
        best = own.max(axis=1, keepdims=True)
        known = np.isfinite(best)
        scores = np.where(known, np.maximum(own - np.where(known, best, 0), FLOOR), 0)
        return scores, total, np.diff(np.append(begins, len(buckets))), \
            competes.any(axis=1)[script]

    def places(self, words: list[str]) -> np.ndarray:
        """Where many words' measures are held, remembered per process."""
        k = len(self.languages)
        if self.held is None or len(self.index) + len(words) > len(self.held[0]):
            n = max(min(CACHE_WORDS, CACHE_SCORES // k), len(words))
            self.index = _Places()
            self.held = (np.zeros((n, k), np.float32), np.zeros((n, k), np.float32),
                         np.zeros(n, np.int32), np.zeros(n, bool), np.zeros(n, np.int32))
        index, at = self.index, len(self.index)
        places = np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words))
        if len(index) > at:
            new = list(islice(reversed(index), len(index) - at))[::-1]
            letters = np.fromiter(map(len, new), dtype=np.int32, count=len(new))
            self.held[4][at:at + len(new)] = letters
            for a in range(0, len(new), GRAM_WORDS):
                part = new[a:a + GRAM_WORDS]
                for held, found in zip(self.held, self.measure(part)):
                    held[at + a:at + a + len(part)] = found
        return places

    def scores(self, words: list[str]) -> np.ndarray:
        """Scores of many words (words x languages)."""
        places = self.places(words)
        return self.held[0][places]


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of every word (rows of ``scores``) under a switching cost.

    If no stretch of words gains ``switch`` or more over the best single
    language, no path with a switch can be better (each stretch costs one at
    least), and that language labels all; else the full recursion runs.
    """
    n, k = scores.shape
    scores = scores.astype(np.float64)
    best = int(scores.sum(axis=0).argmax())
    gain = np.vstack([np.zeros(k), np.cumsum(scores - scores[:, [best]], axis=0)])
    if float((gain - np.minimum.accumulate(gain, axis=0)).max()) < switch:
        return np.full(n, best)
    rows = scores.tolist()
    value, came, stay = rows[0], [], list(range(k))
    for row in rows[1:]:
        top = max(value)
        least = top - switch
        if min(value) < least:
            at = value.index(top)
            came.append([at if v < least else i for i, v in enumerate(value)])
            value = [(least if v < least else v) + s for v, s in zip(value, row)]
        else:
            came.append(stay)
            value = [v + s for v, s in zip(value, row)]
    path = [value.index(max(value))]
    for back in reversed(came):
        path.append(back[path[-1]])
    return np.array(path[::-1])


def _together(texts: Iterable[str], model: LanguageModel) \
        -> Iterator[tuple[str, list[str], np.ndarray, tuple[np.ndarray, ...]]]:
    """Every text with its words, their places in what the model holds, and that.

    Texts are looked up together until they hold :data:`TOGETHER` words, so short ones
    share the work on words that are new; a longer text is taken alone or with the
    short ones before it.
    """
    def placed(group: list[tuple[str, list[str]]]):
        at = model.places(list(chain.from_iterable(words for _, words in group)))
        first = 0
        for text, words in group:
            yield text, words, at[first:first + len(words)], model.held
            first += len(words)

    group, n = [], 0
    for text in texts:
        words = WORD.findall(text) if model.languages else []
        group.append((text, words))
        n += len(words)
        if n >= TOGETHER:
            yield from placed(group)
            group, n = [], 0
    if group:
        yield from placed(group) if n else ((text, words, np.zeros(0, np.int64), ()) for text, words in group)


def label(text: str, model: LanguageModel) -> tuple[str, float, list[dict]]:
    """The language of a text, its score, and the spans (code points) by language.

    The score is the language's share of the letters times its probability
    against the runner-up on the words that are labelled with it.
    """
    return next(label_all([text], model))


def label_all(texts: Iterable[str], model: LanguageModel) -> Iterator[tuple[str, float, list[dict]]]:
    """:func:`label` of many texts."""
    for text, words, places, held in _together(texts, model):
        if not words:
            yield UNKNOWN, 0.0, []
            continue
        scores, letters = held[0][places], held[4][places]
        path = viterbi(scores)
        share = np.bincount(path, weights=letters, minlength=len(model.languages)) / letters.sum()
        pick = int(share.argmax())
        total = scores[path == pick].sum(axis=0, dtype=np.float64)
        margin = total[pick] - np.delete(total, pick).max() if len(total) > 1 else np.inf
        sure = 1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30)))
        cuts = np.flatnonzero(np.diff(path)) + 1
        if len(cuts):
            at = [m.span() for m in WORD.finditer(text)]
            spans = [{"lang": model.languages[path[a]], "start": at[a][0], "end": at[b - 1][1]}
                     for a, b in zip([0, *cuts], [*cuts, len(path)])]
        else:
            spans = [{"lang": model.languages[pick], "start": WORD.search(text).start(),
                      "end": text.rindex(words[-1]) + len(words[-1])}]
        yield model.languages[pick], float(share[pick] * sure), spans


def _labelled(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """``text, lang`` of the documents that have both."""
    return docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()) \
        .select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, ...]]:
    """The columns of small parts of the batches as lists."""
    for batch in batches:
        for at in range(0, batch.num_rows, HELD_TEXTS):
            yield tuple(c.to_pylist() for c in batch.slice(at, HELD_TEXTS).columns)


def _strings(texts: pa.Array) -> Iterator[str]:
    """The texts, few of them Python strings at once."""
    for at in range(0, len(texts), HELD_TEXTS):
        yield from texts.slice(at, HELD_TEXTS).to_pylist()


def _fullest(held: dict) -> object:
    """The key with most words once all hold more than :data:`HELD_WORDS`, else None."""
    if sum(map(len, held.values())) <= HELD_WORDS:
        return None
    return max(held, key=lambda key: len(held[key]))


def _word_parts(words: Counter) -> Iterator[tuple[list[str], np.ndarray]]:
    """Counted words and their counts, :data:`GRAM_WORDS` at a time."""
    left = iter(words.items())
    while part := list(islice(left, GRAM_WORDS)):
        yield [word for word, _ in part], np.fromiter((n for _, n in part), dtype=np.int64, count=len(part))


def fit_languages(labelled: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Fit on all labelled documents."""
    known = _labelled(labelled, text, lang)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: dict[str, Counter] = {}
        seen: dict[str, np.ndarray] = {}
        letters: Counter = Counter()

        def add(language: str) -> None:
            for words, counts in _word_parts(vocabulary.pop(language)):
                buckets, owner, script = grams_by_length(words)
                seen.setdefault(language, np.zeros(BUCKETS, np.int64))[:] += np.bincount(
                    buckets, weights=counts[owner], minlength=BUCKETS).astype(np.int64)
                for place, word, n in zip(script.tolist(), words, counts.tolist()):
                    letters[language, SCRIPTS[place]] += n * len(word)

        for bodies, languages in _parts(batches):
            for body, language in zip(bodies, languages):
                vocabulary.setdefault(language, Counter()).update(WORD.findall(body))
                while (full := _fullest(vocabulary)) is not None:
                    add(full)
        for language in list(vocabulary):
            add(language)

        def rows(language: str, script: list[str], bucket: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([language] * len(n), pa.string()), pa.array(script, pa.string()),
                 pa.array(bucket, pa.int64()), pa.array(n, pa.int64())], names=["lang", "script", "bucket", "n"])

        for language, counts in seen.items():
            found = np.flatnonzero(counts)
            yield rows(language, [""] * len(found), found, counts[found])
        for (language, script), n in letters.items():
            yield rows(language, [script], np.array([-1]), np.array([n]))

    table = known.mapInArrow(count, "lang string, script string, bucket long, n long") \
        .groupBy("lang", "script", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(table["lang"].unique())
    place = {name: i for i, name in enumerate(languages)}
    counts = np.full((len(languages), BUCKETS), 0.5)
    grams = table[table["bucket"] >= 0]
    counts[grams["lang"].map(place).to_numpy(dtype=np.int64),
           grams["bucket"].to_numpy(dtype=np.int64)] += grams["n"].to_numpy()
    logp = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)
    scripts: dict[str, list[int]] = {}
    for language, own in table[table["bucket"] < 0].groupby("lang"):
        for script, n in zip(own["script"], own["n"]):
            if n >= SCRIPT_SHARE * own["n"].sum():
                scripts.setdefault(script, []).append(place[language])
    return LanguageModel(languages, logp, {k: sorted(v) for k, v in scripts.items()})


def fit_of(text: str, model: LanguageModel) -> tuple[float, float]:
    """How far a text is evidence of a learned language.

    The share of its letters in learned scripts; and for the words in those, the
    mean log probability per n-gram under the language they are labelled with,
    less the least of that language. A text without letters is (0, 0).
    """
    return next(fit_all([text], model))


def fit_all(texts: Iterable[str], model: LanguageModel) -> Iterator[tuple[float, float]]:
    """:func:`fit_of` of many texts."""
    for _, words, at, held in _together(texts, model):
        if not words or not (learned := held[3][at]).any():
            yield 0.0, 0.0
            continue
        scores, total, grams, _, letters = held
        path = viterbi(scores[at])
        letters, grams = letters[at], grams[at]
        over = total[at, path] - grams * (0 if model.least is None else model.least[path])
        yield float(letters[learned].sum() / letters.sum()), \
            float(over[learned].sum() / grams[learned].sum())


def _drawn(words: list[str], seed: int) -> list[str]:
    """Words of the same lengths, their letters drawn evenly from the letters of ``words``."""
    letters = sorted(set("".join(words).lower()))
    ends = np.cumsum(list(map(len, words))).tolist()
    # most letters are one code point each, a few are two in lower case
    line = np.random.default_rng(seed).choice(letters, ends[-1]).tolist()
    return ["".join(line[a:b]) for a, b in zip([0, *ends], ends)]


def with_least_fit(model: LanguageModel, labelled: DataFrame, text: str = "text",
                   lang: str = "lang") -> LanguageModel:
    """The model with its least fit per language, from the texts that it was fitted on.

    Half-way between the mean log probability of an n-gram of the language's
    training words and that of words of the same lengths whose letters are drawn
    evenly from the letters of those words. The draw follows the text and the sums are
    whole numbers, so the limits do not depend on how the rows are dealt.
    """
    known = _labelled(labelled, text, lang)
    place = {name: i for i, name in enumerate(model.languages)}
    shared = labelled.sparkSession.sparkContext.broadcast(model)
    kinds = ("own", "drawn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.rint(shared.value.logp.astype(np.float64) * UNITS).astype(np.int64)
        sums = {(language, kind): [0, 0] for language in place for kind in kinds}
        held: dict[tuple[str, str], Counter] = {}

        def add(language: str, kind: str) -> None:
            total = sums[language, kind]
            for words, counts in _word_parts(held.pop((language, kind))):
                buckets, owner, _ = grams_by_length(words)
                total[0] += int((whole[place[language], buckets] * counts[owner]).sum())
                total[1] += int(counts[owner].sum())

        for bodies, languages in _parts(batches):
            for body, language in zip(bodies, languages):
                if not (words := WORD.findall(body)):
                    continue
                for kind in kinds:
                    held.setdefault((language, kind), Counter()).update(
                        words if kind == "own" else _drawn(words, crc32(body.encode("utf-8", "replace"))))
                while (full := _fullest(held)) is not None:
                    add(*full)
        for key in list(held):
            add(*key)
        out = [(language, *map(Decimal, (*sums[language, "own"], *sums[language, "drawn"])))
               for language in place]
        whole_number = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], whole_number if i else pa.string()) for i in range(5)],
            names=["lang", "own", "n_own", "drawn", "n_drawn"])

    names = ("own", "n_own", "drawn", "n_drawn")
    sums = {r["lang"]: {c: int(r[c]) for c in names} for r in known.mapInArrow(
        run, "lang string, " + ", ".join(f"{c} decimal(38,0)" for c in names))
        .groupBy("lang").agg(*[F.sum(c).alias(c) for c in names]).collect()}
    model.least = np.array([(r["own"] / r["n_own"] + r["drawn"] / r["n_drawn"]) / 2 / UNITS
                            for r in map(sums.__getitem__, model.languages)])
    return model


def fitting_languages(docs: DataFrame, model: LanguageModel, *keep: Column) -> DataFrame:
    """``*keep, known, fit`` of every whole text, as :func:`fit_of` gives them.

    Only the text goes to Python; what is kept waits in the JVM.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<known: double, fit: double>")
    def fits(texts: pa.Array) -> pa.Array:
        found = list(fit_all(_strings(texts), shared.value))
        return pa.StructArray.from_arrays(
            [pa.array([f[i] for f in found], pa.float64()) for i in (0, 1)], names=["known", "fit"])

    rows = docs.select(*keep, fits(text_or_empty()).alias("__fits"))
    return rows.select(*rows.columns[:-1], "__fits.known", "__fits.fit")


def label_languages(docs: DataFrame, model: LanguageModel, *keep: Column) -> DataFrame:
    """``*keep, lang_pred, score, spans`` of every whole text."""
    rows = docs.select(*keep, text_or_empty().alias("__text"))
    names = rows.columns[:-1]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            out = list(label_all(_strings(batch.column("__text")), fitted))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array([o[0] for o in out], pa.string()),
                 pa.array([o[1] for o in out], pa.float64()),
                 pa.array([o[2] for o in out], pa.list_(span))],
                names=[*names, "lang_pred", "score", "spans"])

    return rows.mapInArrow(run, with_fields(
        rows.schema.fields[:-1], "lang_pred string, score double, "
        "spans array<struct<lang: string, start: long, end: long>>"))


def held_out(folds: int, fold: int) -> Column:
    """Whether crc32(doc_id as text) mod ``folds`` is ``fold`` (false without a doc_id)."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return F.coalesce(F.pmod(crc, F.lit(folds)) == fold, F.lit(False))


def learnable(docs: DataFrame, folds: int, fold: int) -> DataFrame:
    """The rows that a model may learn from: those with a doc_id outside the fold."""
    return docs.filter(F.col("doc_id").isNotNull() & ~held_out(folds, fold))
