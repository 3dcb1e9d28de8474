"""Personal data: base patterns plus information-theoretic sanitisation of terms.

Base spans (``email``, ``ip``, ``card``, ``phone``) are the protected entities.
Terms of the same documents can give an entity away; how strongly is estimated from
co-occurrence in whole documents. With ``N`` documents, of which ``n_e`` hold the
entity, ``n_t`` the term and ``n_te`` both::

    PMI(t, e) = log2(n_te N / (n_t n_e))      IC(e) = log2(N / n_e)

``PMI / IC`` is the share of the entity's information that the term discloses (1:
the term occurs with this entity only). Terms whose share reaches ``GENERALISE``
become ``term`` spans wherever they stand in a document that holds the entity: from
``REMOVE`` on they are taken out, below that generalised to a placeholder.

Single-text rule: a term and an entity must be seen together in ``SUPPORT`` different
texts. One text shows no co-occurrence: each of its rare words would disclose each of
its entities. ``support=1`` asks for just that.

All counts cover all documents; only built-in functions are used. Spans are found
once per row and checkpointed without the text. Entities that stand in the same texts
have the same counts with every term, so do terms that stand in the same texts: a
class of each is paired once (classes are told by 128 bits hashed from their
texts). As ``n_te <= n_e``, a share ``s`` needs ``n_t <= n_e (N / n_e)^(1 - s)``, so
frequent terms leave before they are paired. Neither drops a pair that would be reported.

Offsets are code points, end exclusive. Defined cases: a null text is empty (no
spans); whole texts of any length are searched (the patterns are written
without backtracking over long runs); rows with equal texts get equal spans; words
inside base spans count as terms and are not marked there; an entity in every document
carries no information and discloses nothing; an empty table gives an empty result;
extra columns are ignored (or carried by :func:`sanitised`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandcast.llm.common import (bounded_broadcast, checkpointed, redacted, text_or_empty)

KINDS = ("email", "ip", "card", "phone", "term")
BASE = KINDS[:4]

# Equivalent to the plain patterns, with possessive loops: Java's greedy groups
# recurse, and a run that has failed once is not tried again from its middle.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_IP_VALID = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"
_CARD_MAYBE = r"[0-9](?:[\x20-]?[0-9]){13}"

TERM = r"\p{L}[\p{L}\p{M}\p{Nd}_]{2,}"
#: Different texts that must show a term together with an entity.
SUPPORT = 2
#: Shares of an entity's information from which a term is generalised, or removed.
GENERALISE, REMOVE = 0.75, 0.95
#: Matches whose places are added up together.
CHUNK = 256
#: Terms (a hash each) up to which they are broadcast.
BROADCAST_ROWS = 500_000


def _luhn(digits: Column) -> Column:
    total = F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(
            i % 2 == 0, d.cast("int")).otherwise(
            d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0))),
        F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0)))
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(_IP_VALID)
    if kind == "card":
        digits = F.regexp_replace(value, "[^0-9]", "")
        return F.length(digits).between(14, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def _maybe(kind: str, text: Column) -> Column:
    """A cheap necessary condition for a valid match."""
    return {"email": F.instr(text, "@") > 0, "ip": text.rlike(PATTERNS["ip"]),
            "card": text.rlike(_CARD_MAYBE), "phone": F.instr(text, "+") > 0}[kind]


def located(text: Column, pattern: str) -> Column:
    """All matches as ``array<struct<start, end, value>>``, leftmost and non-overlapping.

    The text between the matches (``split``) and the matches themselves
    alternate, so their lengths add up to the offsets. Running sums append to an array,
    which copies it, so they are taken within chunks of matches and over the chunks.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    steps = F.filter(F.zip_with(between, matches, lambda b, m: F.struct(
        F.length(b).alias("gap"), m.alias("value"))), lambda s: s["value"].isNotNull())
    empty = F.array().cast("array<struct<start: int, end: int, value: string>>")

    def placed(chunk: Column, first: Column) -> Column:
        return F.aggregate(
            chunk, F.struct(first.alias("at"), empty.alias("out")),
            lambda acc, s: F.struct(
                (acc["at"] + s["gap"] + F.length(s["value"])).alias("at"),
                F.concat(acc["out"], F.array(F.struct(
                    (acc["at"] + s["gap"]).alias("start"),
                    (acc["at"] + s["gap"] + F.length(s["value"])).alias("end"),
                    s["value"].alias("value")))).alias("out")),
            lambda acc: acc["out"])

    def of(found: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / CHUNK).cast("int")),
                             lambda c: F.slice(found, c * CHUNK + 1, CHUNK))
        return _once(chunks, joined)

    def joined(chunks: Column) -> Column:
        firsts = F.aggregate(
            chunks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda acc, c: F.struct(
                F.aggregate(c, acc["at"], lambda n, s: n + s["gap"] + F.length(s["value"])).alias("at"),
                F.concat(acc["out"], F.array(acc["at"])).alias("out")),
            lambda acc: acc["out"])
        return F.flatten(F.zip_with(chunks, firsts, placed))

    return _once(steps, lambda found: F.when(F.size(found) == 0, empty).when(
        F.size(found) <= CHUNK, placed(found, F.lit(0))).otherwise(of(found)))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _base(docs: DataFrame, *keep: Column) -> DataFrame:
    """``*keep, text_key, base``: base spans with their values."""
    text = F.col("__text")
    empty = F.array().cast("array<struct<start: int, end: int, value: string>>")
    rows = docs.select(*keep, text_or_empty().alias("__text"))
    names = rows.columns[:-1]
    for kind in BASE:
        rows = rows.withColumn(f"__{kind}", F.when(_maybe(kind, text), located(text, PATTERNS[kind]))
                               .otherwise(empty))

    def spans(rank: int, kind: str) -> Column:
        valid = F.filter(f"__{kind}", lambda s: _valid(kind, s["value"]))
        return F.transform(valid, lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"),
            F.lit(kind).alias("kind"), F.lower(s["value"]).alias("value")))

    base = F.array_sort(F.concat(*[spans(i, k) for i, k in enumerate(BASE)]))
    return rows.select(*names, F.xxhash64("__text").alias("text_key"), base.alias("base"))


def _class(prefix: str) -> list[Column]:
    """Two hashes of a group's set of ``text_key``."""
    return [F.bit_xor(F.xxhash64(F.lit(i), F.col("text_key"))).alias(f"{prefix}{i}") for i in (1, 2)]


def _keyed(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``text_key, __text`` of the rows whose text is one of ``keys``."""
    return docs.select(F.xxhash64(text_or_empty()).alias("text_key"), text_or_empty().alias("__text")) \
        .join(bounded_broadcast(keys, BROADCAST_ROWS), "text_key", "left_semi")


def _terms(text: Column) -> Column:
    """The hashes of a text's different terms."""
    return F.transform(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))),
                       lambda t: F.xxhash64(t))


def disclosing_terms(docs: DataFrame, found: DataFrame, share: float = GENERALISE,
                     support: int = SUPPORT) -> DataFrame:
    """``text_key, term, disclosure``: the terms that give an entity of their text away,
    each with the greatest share of an entity's information.

    ``found`` has a row per document (``text_key, base``).
    """
    total = float(found.count())
    most = F.col("n_e") * F.pow(F.lit(total) / F.col("n_e"), F.lit(1.0 - share)) * (1 + 1e-9)
    holds = found.filter(F.size("base") > 0).select("text_key", F.explode(F.array_distinct(F.transform(
        "base", lambda s: F.xxhash64(s["kind"], s["value"])))).alias("entity")) \
        .groupBy("text_key", "entity").agg(F.count("*").alias("copies"))
    entities = holds.groupBy("entity").agg(
        F.count("*").alias("texts"), F.sum("copies").alias("n_e"), *_class("e")) \
        .filter((F.col("texts") >= support) & (F.col("n_e") < total))
    holds = checkpointed(holds.join(entities, "entity")
                         .select("text_key", "copies", "n_e", "e1", "e2", most.alias("most")).distinct())
    texts = holds.groupBy("text_key").agg(F.max("most").alias("bound"))

    postings = checkpointed(_keyed(docs, texts.select("text_key"))
                            .select("text_key", F.explode(_terms(F.col("__text"))).alias("term")).distinct())
    wanted = postings.groupBy("term").agg(F.count("*").alias("texts")).filter(F.col("texts") >= support)
    every = docs.select(F.explode(_terms(text_or_empty())).alias("term"))
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        every = every.join(F.broadcast(wanted.select("term")), "term", "left_semi")
    counts = every.groupBy("term").agg(F.count("*").alias("n_t")).join(wanted.select("term"), "term", "left_semi")
    postings = postings.join(counts, "term").join(texts, "text_key") \
        .filter(F.col("n_t") <= F.col("bound")).select("text_key", "term", "n_t")
    classes = postings.groupBy("term").agg(*_class("t"))
    postings = checkpointed(postings.join(classes, "term"))
    terms = postings.select("text_key", "n_t", "t1", "t2").distinct()

    pair = ["e1", "e2", "t1", "t2"]
    known = F.log2(F.lit(total) / F.col("n_e"))
    pmi = F.log2(F.col("n_te") * F.lit(total) / (F.col("n_t") * F.col("n_e")))
    telling = checkpointed(
        holds.join(terms, "text_key").filter(F.col("n_t") <= F.col("most"))
        .groupBy(*pair, "n_e", "n_t").agg(F.count("*").alias("texts"), F.sum("copies").alias("n_te"))
        .filter(F.col("texts") >= support).withColumn("disclosure", pmi / known)
        .filter(F.col("disclosure") >= share).select(*pair, "disclosure"))
    marked = terms.join(telling, ["t1", "t2"]).join(holds, ["text_key", "e1", "e2"]) \
        .groupBy("text_key", "t1", "t2").agg(F.max("disclosure").alias("disclosure"))
    return postings.join(marked, ["text_key", "t1", "t2"]).select("text_key", "term", "disclosure")


def personal_spans(docs: DataFrame, *keep: Column, support: int = SUPPORT) -> DataFrame:
    """``doc_id, *keep, text_key, spans``, spans by start, then kind as listed.

    ``spans`` is ``array<struct<kind, start, end, action>>``; the action is
    ``mask`` for base spans, ``generalise`` or ``remove`` for terms.
    """
    found = checkpointed(_base(docs, F.col("doc_id"), *keep))
    telling = checkpointed(disclosing_terms(docs, found, support=support))
    # the places of every term of the texts that hold a telling one
    places = _keyed(docs, telling.select("text_key").distinct()) \
        .select("text_key", F.explode(located(F.col("__text"), TERM)).alias("t")) \
        .select("text_key", F.xxhash64(F.lower("t.value")).alias("term"),
                F.col("t.start").alias("start"), F.col("t.end").alias("end"))
    marks = places.join(telling, ["text_key", "term"]) \
        .groupBy("text_key", "start", "end").agg(F.max("disclosure").alias("disclosure")) \
        .groupBy("text_key").agg(F.collect_list(F.struct("start", "end", "disclosure")).alias("terms"))
    rows = found.join(marks, "text_key", "left")
    rank = len(BASE)
    terms = F.filter(F.coalesce("terms", F.array().cast(marks.schema["terms"].dataType)),
                     lambda t: ~F.exists("base", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    every = F.concat(
        F.transform("base", lambda s: F.struct(
            s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"),
            s["kind"].alias("kind"), F.lit("mask").alias("action"))),
        F.transform(terms, lambda t: F.struct(
            t["start"].alias("start"), F.lit(rank).alias("rank"), t["end"].alias("end"),
            F.lit(KINDS[rank]).alias("kind"),
            F.when(t["disclosure"] >= REMOVE, "remove").otherwise("generalise").alias("action"))))
    names = [c for c in found.columns if c != "base"]
    return rows.select(*names, F.transform(F.array_sort(every), lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].cast("long").alias("start"),
        s["end"].cast("long").alias("end"), s["action"].alias("action"))).alias("spans"))


def sanitised(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with personal data masked, disclosing terms generalised
    or removed in ``text``; null texts stay null."""
    spans = personal_spans(docs).select(F.col("text_key").alias("__key"), F.col("spans").alias("__spans")) \
        .filter(F.size("__spans") > 0).dropDuplicates(["__key"])
    rows = docs.select(F.struct("*").alias("__row"), F.xxhash64(text_or_empty()).alias("__key")) \
        .join(spans, "__key", "left")
    named = F.transform("__spans", lambda s: F.struct(
        F.when(s["action"] == "remove", F.lit("removed")).otherwise(s["kind"]).alias("kind"),
        s["start"].alias("start"), s["end"].alias("end")))
    text = F.col("__row.text")
    clean = F.when(F.col("__spans").isNull(), text).otherwise(redacted(text, named))
    return rows.select(F.col("__row").withField("text", clean).alias("__row")).select("__row.*")
