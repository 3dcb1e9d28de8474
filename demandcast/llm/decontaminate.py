"""Benchmark decontamination by template canonicalisation.

Numbers, names and units are replaced by typed placeholders, so a benchmark item
and a copy of it with other numbers or names have the same template. Windows of
five template tokens are hash-joined between documents and benchmark; a document
is a candidate for an item if its windows cover a share of 0.8 or more of the
item's. Candidates are verified by their slots: along one alignment, equal item
values must stand where equal document values stand and different ones where
different ones do, or the passage is another question of the same form. Only
windows with two literal tokens, or with the item's own values, count.

A name is a capitalised word (or a run of them) inside a sentence; a unit is a
unit word right after a number, or a currency or per cent sign; words are
compared in lower case, punctuation is left out. A text with fewer than five
tokens is one window.

Beside this stated form (the one of the SQL text) items and documents have a
plain form, in which names are lower-case words and white space is any run with
at most one line break. In it an item of 2 to 8 tokens is one window of its own
length, looked for at every place of a document; an item of one token holds no
passage and only matches a text that consists of it. An item that the stated form
does not find is held if another form covers it; the coverage is that of the
first form that does. A third, named form takes every capitalised word (or run)
as a name, also at the start of a sentence, a line or a quotation, so that names
can be swapped there too. An item that is one window has few literals to tell it
by: in its named form a capitalised word that is no name in the stated sense
(such as the question word that it begins with) must be the same in the document.

Documents are identified by their text, so copies are judged once: the window
rows of a text are reduced to distinct (text, item, window) before they move.
The benchmark's windows are broadcast only after their number has been checked;
beyond ``BROADCAST_ROWS`` both sides are shuffled by window.

Defined cases: null and empty texts and items without tokens match nothing; a
null item id is kept as an item of its own; repeated documents each give a row,
repeated items count once per id; whole texts of any length are searched; empty
tables give an empty result; extra columns are ignored (or carried by
:func:`drop_contaminated`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandcast.llm.common import bounded_broadcast, checkpointed, partitions, text_or_empty

WINDOW, SHARE = 5, 0.8
#: Template forms: as the SQL states them, with names as lower-case words, and with
#: every capitalised word as a name.
STATED, PLAIN, NAMED = 0, 1, 2
FORMS = (STATED, PLAIN, NAMED)
#: Tokens of the longest and shortest item that is one window of its own length.
WHOLE, LEAST = 8, 2
#: Literal tokens from which a window counts whatever its values are.
LITERALS = 2
#: Windows (two longs and an id each) or texts (a long) up to which a side is broadcast.
BROADCAST_ROWS = 500_000

#: Unit words, recognised right after a number.
UNITS = ("km", "cm", "mm", "m", "mi", "miles", "mile", "ft", "feet", "foot", "inches", "inch",
         "meters", "meter", "metres", "metre", "kilometers", "kilometres", "kg", "g", "mg", "lb",
         "lbs", "pounds", "ounces", "oz", "grams", "tons", "l", "ml", "liters", "litres",
         "gallons", "s", "ms", "seconds", "second", "minutes", "minute", "min", "hours", "hour",
         "h", "days", "day", "weeks", "week", "months", "month", "years", "year", "dollars",
         "dollar", "euros", "euro", "cents", "percent", "degrees", "mph", "kmh", "hz", "w", "kw",
         "v", "a", "j", "n", "usd", "eur", "gb", "mb", "kb")
# placeholders: name, unit, number; the last character ends a kept value
_NAME, _UNIT, _NUMBER, _END = "\u0001", "\u0002", "\u0003", "\u0004"
# the first letter is looked at before what stands in front of it, which is faster
_NAMES = r"\p{Lu}(?<=[\p{Ll}\p{Nd},;:] \p{Lu})\p{Ll}+(?: \p{Lu}\p{Ll}+)*+"
_UNIT_WORDS = rf"(\p{{Nd}})( ?)((?i:{'|'.join(UNITS)}))(?![\p{{L}}\p{{M}}\p{{Nd}}])"
# white space with at most one line break
_WRAP = r"(?:[^\S\n]++\n?[^\S\n]*+|\n[^\S\n]*+)"
_UNIT_WORDS_WRAPPED = _UNIT_WORDS.replace("( ?)", f"({_WRAP}?)")
# a number and a word with other white space between them than one blank
_WRAPPED = r"\p{Nd}(?! \p{L})\s++\p{L}"
# every capitalised word or run of them, wherever it stands; not a unit's kept value
_ALL_NAMES = rf"\p{{Lu}}(?<![\p{{L}}\p{{M}}{_UNIT}]\p{{Lu}})\p{{Ll}}++(?:{_WRAP}\p{{Lu}}\p{{Ll}}++)*+"
_UNIT_SIGNS = r"[%$€£¥]"
_SLOT_MAYBE = r"[\p{Nd}%$€£¥]"
_NUMBERS = r"\p{Nd}++(?:[.,]\p{Nd}++)*+"


def _tokens(marked: Column, valued: bool) -> Column:
    token = rf"[\p{{L}}\p{{M}}]+|[{_NAME}{_UNIT}{_NUMBER}]" \
        + (rf"[^{_END}]*{_END}" if valued else "")
    return F.regexp_extract_all(F.lower(marked), F.lit(token), F.lit(0))


def template_tokens(text: Column, valued: bool = False, form: int = STATED) -> Column:
    """The template tokens of a text; with ``valued`` placeholders keep their value."""
    end = _END if valued else ""

    def slot(kind: str, value: str, front: str = "") -> Column:
        return F.lit(f"{front} {kind}{value if valued else ''}{end} ")

    marks = _NAME + _UNIT + _NUMBER + _END
    marked = F.when(text.rlike(f"[{marks}]"), F.translate(text, marks, "    ")).otherwise(text)
    if form == STATED:
        marked = F.regexp_replace(marked, F.lit(_NAMES), slot(_NAME, "$0"))
    units = _UNIT_WORDS if form == STATED else _UNIT_WORDS_WRAPPED
    slots = F.regexp_replace(marked, F.lit(units), slot(_UNIT, "$3", "$1"))
    slots = F.regexp_replace(slots, F.lit(_UNIT_SIGNS), slot(_UNIT, "$0"))
    slots = F.regexp_replace(slots, F.lit(_NUMBERS), slot(_NUMBER, "$0"))
    marked = F.when(text.rlike(_SLOT_MAYBE), slots).otherwise(marked)
    if form == NAMED:
        marked = F.regexp_replace(marked, F.lit(_ALL_NAMES), slot(_NAME, "$0"))
    return _tokens(marked, valued)


def _windows(tokens: Column, form: int, lengths: list[int]) -> Column:
    """Every window of a token array, as token arrays.

    Of the stated form the whole array if it is shorter than a window (none if
    empty); of the others every window of the given lengths.
    """
    def of(n: int) -> Column:
        last = F.greatest(F.size(tokens) - n, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
            i.alias("at"), F.slice(tokens, i + 1, n).alias("valued")))

    none = F.array().cast("array<struct<at: int, valued: array<string>>>")
    if form == STATED:
        return F.when(F.size(tokens) == 0, none).otherwise(of(WINDOW))
    return F.concat(none, *[F.when(F.size(tokens) >= n, of(n)).otherwise(none) for n in lengths])


def _hashes(tokens: Column, form: int, lengths: list[int]) -> Column:
    """The hash of every window, as :func:`_window_hash` gives it, from hashes of the tokens."""
    def of(n: int) -> Column:
        last = F.greatest(F.size(tokens) - n, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(
            *[F.get(tokens, i + k) for k in range(n)]))

    none = F.array().cast("array<bigint>")
    if form == STATED:
        return F.when(F.size(tokens) == 0, none).otherwise(of(WINDOW))
    return F.concat(none, *[F.when(F.size(tokens) >= n, of(n)).otherwise(none) for n in lengths])


def _near_names(tokens: Column, lengths: list[int]) -> Column:
    """The hashes of the windows that hold a name's placeholder or stand beside one."""
    size, name = F.size(tokens), F.xxhash64(F.lit(_NAME))
    places = F.filter(F.transform(tokens, lambda t, i: F.when(t == name, i)), lambda i: i.isNotNull())

    def of(n: int) -> Column:
        starts = F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(
            F.greatest(p - n, F.lit(0)), F.least(p + 1, size - n)))))
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(n)]))

    none = F.array().cast("array<bigint>")
    return F.concat(none, *[F.when(size >= n, of(n)).otherwise(none) for n in lengths])


def window_hashes(texts: DataFrame, lengths: list[int]) -> DataFrame:
    """``text_key, window``: the distinct window hashes of a text, all forms together.

    The plain form has all its windows made. Of the named form only those at a name are:
    the others hold the same tokens as a plain window. A text without a stated name and
    without a unit that is wrapped away from its number has the plain form's tokens as
    its stated ones, so the stated form is made for the other texts only.
    """
    text = F.col("text")
    apart = text.rlike(_NAMES) | text.rlike(_WRAPPED)
    # the tokens are columns of their own: inside a lambda they would be found anew
    # for every window
    tokens = texts.select("text_key", F.when(apart, template_tokens(text, False, STATED)).alias(f"t{STATED}"),
                          *[template_tokens(text, False, f).alias(f"t{f}") for f in (PLAIN, NAMED)])
    hashed = tokens.select("text_key", *[F.transform(f"t{f}", lambda t: F.xxhash64(t)).alias(f"t{f}")
                                         for f in FORMS])
    stated, plain, named = (F.col(f"t{f}") for f in FORMS)
    as_plain = F.lit(WINDOW in lengths) & (F.size(plain) >= WINDOW)
    none = F.array().cast("array<bigint>")
    own = F.when(stated.isNotNull(), _hashes(stated, STATED, lengths)) \
        .when(as_plain, none).otherwise(_hashes(plain, STATED, lengths))
    # one expression: a filter that Spark adds below the explode of a column would be
    # pushed down to the text, and find the tokens anew for every window
    return hashed.select("text_key", F.explode(F.array_distinct(F.concat(
        own, _hashes(plain, PLAIN, lengths), _near_names(named, lengths)))).alias("window"))


def _window_hash(template: Column) -> Column:
    """The hash of a template window of at most :data:`WHOLE` tokens."""
    # a hash passes over nulls, so the length needs no argument of its own
    return F.xxhash64(*[F.when(F.size(template) > k, F.xxhash64(F.get(template, F.lit(k))))
                        for k in range(WHOLE)])


def _valued_windows(rows: DataFrame, lengths: list[int] | None, *keys: str,
                    only: DataFrame | None = None, forms: tuple[int, ...] = FORMS) -> DataFrame:
    """``*keys, form, at, length, window, slots, fixed, literals`` of every window of column ``text``.

    ``slots`` holds the placeholder values with their place in the text, ``fixed``
    those that a document may not change (null unless the text is one window in
    its named form). Without ``lengths`` the rows are items, which have one window
    length each. With ``only`` (``form, window``) the other windows are left out
    before they move.
    """
    kinds = _NAME + _UNIT + _NUMBER

    def is_slot(t: Column) -> Column:
        return F.instr(F.lit(kinds), F.substring(t, 1, 1)) > 0

    out = None
    for form in forms:
        tokens = rows.select(*keys, template_tokens(F.col("text"), True, form).alias("tokens"),
                             F.transform(F.regexp_extract_all(
                                 F.regexp_replace("text", r"\s+", " "), F.lit(_NAMES), F.lit(0)),
                                 lambda t: F.concat(F.lit(_NAME), F.lower(t), F.lit(_END))).alias("names"))
        if lengths is not None or form == STATED:
            found = _windows(F.col("tokens"), form, lengths or [])
        else:
            n = F.size("tokens")
            found = F.when(n > WHOLE, _windows(F.col("tokens"), form, [WINDOW])).when(
                n >= LEAST, F.array(F.struct(F.lit(0).alias("at"), F.col("tokens").alias("valued"))))
        fixed = F.lit(form == NAMED) & (F.size("tokens") <= WHOLE)
        wide = tokens.select(*keys, "names", fixed.alias("fixed"), F.inline(found))
        template = F.transform("valued", lambda t: F.when(is_slot(t), F.substring(t, 1, 1)).otherwise(t))
        wide = wide.withColumn("form", F.lit(form)).withColumn("window", _window_hash(template)) \
            .withColumn("length", F.size("valued"))
        if only is not None:
            wide = wide.join(only, ["form", "window"], "left_semi")
        placed = F.transform("valued", lambda t, i: F.struct(
            (F.col("at") + i).alias("place"), F.regexp_replace(t, r"\s+", " ").alias("value")))
        wide = wide.select(*keys, "form", "at", "length", "window",
                           F.filter(placed, lambda p: is_slot(p["value"])).alias("slots"),
                           F.when(F.col("fixed"), F.filter(placed, lambda p: p["value"].startswith(_NAME)
                                                           & ~F.array_contains("names", p["value"])))
                           .alias("fixed"),
                           F.size(F.filter("valued", lambda t: ~is_slot(t))).alias("literals"))
        out = wide if out is None else out.unionByName(wide)
    return out


def _candidates(texts: DataFrame, items: DataFrame, lengths: list[int], share: float) -> DataFrame:
    """``text_key, item, form``: texts whose templates cover enough of an item's windows.

    A text's windows of all forms are taken together here, so a form can have
    candidates that :func:`_verified` finds to cover less.
    """
    index = items.select("item", "form", "window").distinct()
    sizes = index.groupBy("item", "form").agg(F.count("*").alias("n"))
    found = window_hashes(texts, lengths)
    hits = found.join(bounded_broadcast(index, BROADCAST_ROWS), "window").distinct() \
        .groupBy("text_key", "item", "form").agg(F.count("*").alias("hits"))
    return hits.join(bounded_broadcast(sizes, BROADCAST_ROWS), ["item", "form"]) \
        .filter(F.col("hits") >= share * F.col("n")).select("text_key", "item", "form")


def _last_words(name: Column, n: Column) -> Column:
    """A kept name without what stands before its last ``n`` words (a heading, say)."""
    words = F.split(F.substring(name, 2, 2**31 - 1), " ")
    return F.when(~name.startswith(_NAME) | (F.size(words) <= n), name).otherwise(
        F.concat(F.lit(_NAME), F.array_join(F.slice(words, -n, n), " ")))


def _verified(texts: DataFrame, items: DataFrame, lengths: list[int], candidates: DataFrame,
              share: float, forms: tuple[int, ...] = FORMS) -> DataFrame:
    """``text_key, item, coverage`` of the candidates whose slots are consistent in a form."""
    candidates = candidates.filter(F.col("form").isin(*forms))
    items = items.filter(F.col("form").isin(*forms))
    keys = bounded_broadcast(candidates.select("text_key").distinct(), BROADCAST_ROWS)
    # one row per distinct text: copies are the same text. The texts are few bytes but
    # much work, so they keep this number of tasks, which a merge by size would reduce
    chosen = texts.join(keys, "text_key", "left_semi") \
        .repartition(partitions(texts.sparkSession), "text_key").groupBy("text_key") \
        .agg(F.min("text").alias("text"))
    held = bounded_broadcast(items.select("form", "window").distinct(), BROADCAST_ROWS)
    inside = _valued_windows(chosen, lengths, "text_key", only=held, forms=forms).drop("length", "fixed") \
        .join(candidates, ["text_key", "form"])
    index = items.select("item", "form", "window", F.col("at").alias("item_at"),
                         F.col("slots").alias("item_slots"), "fixed", "literals")
    pairs = inside.drop("literals").join(index, ["item", "form", "window"])
    same = F.transform("slots", lambda s: s["value"]) == F.transform("item_slots", lambda s: s["value"])
    pairs = pairs.filter((F.col("literals") >= LITERALS) | same) \
        .withColumn("shift", F.col("at") - F.col("item_at"))
    # such a word may end a run of names in the document
    kept = F.forall("fixed", lambda i: F.exists("slots", lambda d: (
        d["place"] == i["place"] + F.col("shift")) & ((d["value"] == i["value"]) | d["value"].endswith(
            F.concat(F.lit(" "), F.substring(i["value"], 2, 2**31 - 1))))))
    # read twice below: the templates of the candidates are much work for few rows
    pairs = checkpointed(pairs.filter(F.coalesce(kept, F.lit(True))))
    by = ["text_key", "item", "form"]
    slots = pairs.select(*by, "shift", F.explode(
        F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d"))).alias("z")) \
        .select(*by, "shift", F.col("z.i.value").alias("i"),
                F.when((F.col("form") == NAMED) & (F.col("z.i.place") == 0), _last_words(
                    F.col("z.d.value"), F.size(F.split("z.i.value", " "))))
                .otherwise(F.col("z.d.value")).alias("d")) \
        .distinct()
    clashes = slots.groupBy(*by, "shift").agg(
        F.count("*").alias("both"), F.countDistinct("i").alias("n_i"), F.countDistinct("d").alias("n_d")) \
        .filter((F.col("both") > F.col("n_i")) | (F.col("both") > F.col("n_d")))
    sound = pairs.join(clashes, [pairs[c].eqNullSafe(clashes[c]) for c in (*by, "shift")], "left_anti")
    # windows that an item repeats count by their template, as in the first pass
    covered = sound.select(*by, "window").distinct() \
        .groupBy(*by).agg(F.count("*").alias("hits"))
    sizes = items.select("item", "form", "window").distinct() \
        .groupBy("item", "form").agg(F.count("*").alias("n"))
    found = covered.join(sizes, ["item", "form"]).withColumn("coverage", F.col("hits") / F.col("n")) \
        .filter(F.col("hits") >= share * F.col("n"))
    # the first form that holds the item states the coverage
    return found.groupBy("text_key", "item").agg(F.min_by("coverage", "form").alias("coverage"))


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """``text_key, item, coverage``: texts that hold a benchmark item (a checkpoint)."""
    texts = docs.filter(F.col("text").isNotNull()) \
        .select(F.xxhash64("text").alias("text_key"), "text")
    # items are numbered by content, so a null id joins like any other
    items = benchmark.select(F.xxhash64(F.col("item_id").isNull(), "item_id").alias("item"),
                             text_or_empty().alias("text"))
    indexed = checkpointed(_valued_windows(items, None, "item"))
    # at most WHOLE lengths
    lengths = sorted(r[0] for r in indexed.filter(F.col("form") != STATED)
                     .select("length").distinct().collect())
    candidates = checkpointed(_candidates(texts, indexed, lengths, share))
    # the first form that holds an item states the coverage, so what the stated form
    # holds is not looked at in the others
    stated = checkpointed(_verified(texts, indexed, lengths, candidates, share, (STATED,)))
    others = candidates.join(stated, ["text_key", "item"], "left_anti")
    return checkpointed(stated.unionByName(
        _verified(texts, indexed, lengths, others, share, (PLAIN, NAMED))))


def find_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """``doc_id, item_id, coverage``: one row per document and item that it holds."""
    held = contaminated_texts(docs, benchmark, share)
    ids = benchmark.select(F.xxhash64(F.col("item_id").isNull(), "item_id").alias("item"), "item_id") \
        .distinct()
    return docs.select("doc_id", F.xxhash64("text").alias("text_key")) \
        .join(bounded_broadcast(held, BROADCAST_ROWS), "text_key").join(ids, "item") \
        .select("doc_id", "item_id", "coverage")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    held = contaminated_texts(docs, benchmark, share).select(F.col("text_key").alias("__key")).distinct()
    rows = docs.select(F.struct("*").alias("__row"), F.xxhash64("text").alias("__key"))
    return rows.join(bounded_broadcast(held, BROADCAST_ROWS), "__key", "left_anti").select("__row.*")
