"""Operators 2, 4, 5, 6, 7 and the pipeline against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from demandcast.llm import decontaminate, fingerprint, mixing, privacy, queries, sharding

CHECK = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, " \
    "spans string, slot string, target double, fingerprint string, term string"
LONG = "lorem ipsum " * 5_000


def edge_rows():
    texts = [(1, "one two three four five"), (1, "one two three four five"),
             (2, "one two three four five"), (None, "one two three four five"), (3, None),
             (4, ""), (5, " \n\t "), (6, LONG), (7, "x" * 50_000), (8, "Ünïcödé 😀 a@b.cd x 12 km"),
             (None, None)]
    return [(i, t, None, None if i == 1 else "s", 0, 3, "x", "y", 0.5, "f", "t") for i, t in texts]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{CHECK}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# -------------------------------------------------------------- fingerprints --

def test_fingerprints_against_brute_force(spark, rows):
    texts = {r.doc_id: r.text for r in rows}
    order = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in queries.op2_document_fingerprints(spark, CHECK).collect()}
    assert set(got) == set(texts)
    errors = {"near_edited": [], "near_next": []}
    by_text = {}
    for i, doc in enumerate(order):
        text, after = texts[doc], texts[order[(i + 1) % len(order)]]
        third = len(text) // 3
        edited = text[:len(text) - third] + after[:third]
        r = got[doc]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        by_text.setdefault(text, set()).add(r.fingerprint)
        for name, other in (("near_edited", edited), ("near_next", after)):
            a, b = Counter(split(text)), Counter(split(other))
            errors[name].append(r[name] - sum((a & b).values()) / sum((a | b).values()))
    assert all(len(v) == 1 for v in by_text.values())
    for e in errors.values():
        assert abs(sum(e) / len(e)) < 0.03
        # a share of 32 samples deviates by at most sqrt(1/4/32) on average
        assert math.sqrt(sum(x * x for x in e) / len(e)) < 0.1


def test_sampling_equals_generalised_jaccard(spark):
    """Many samples of one pair of weighted sets: the collision rate is the similarity."""
    a = ["x"] * 9 + ["y"] * 3 + ["z"]
    b = ["x"] * 4 + ["y"] * 6 + ["w"] * 2
    pair = spark.createDataFrame([(2, " ".join(a)), (1, " ".join(b))], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprint.fingerprints(pair, samples=2000).collect()}
    assert got[2].near_next == pytest.approx((4 + 3) / (9 + 6 + 1 + 2), abs=0.04)
    assert got[1].near_next == got[2].near_next


def test_fingerprint_edges(edge, empty):
    got = fingerprint.fingerprints(edge).collect()
    assert len(got) == len(edge_rows())
    of = {}
    for r in got:
        of.setdefault(r.doc_id, []).append(r)
    assert of[1][0].fingerprint == of[2][0].fingerprint == of[1][1].fingerprint
    assert of[3][0].fingerprint == [] and of[4][0].n_chars == 0
    assert of[4][0].near_next == 1.0          # empty beside empty
    assert of[5][0].near_next == 1.0 and of[6][0].near_next == 0.0
    assert fingerprint.fingerprints(empty).count() == 0
    one = edge.filter("doc_id = 6")
    assert fingerprint.fingerprints(one).first().near_next == 1.0


def test_every_range_count_gives_the_same(edge, docs):
    some = docs.filter("doc_id < 200")
    base = {r.doc_id: r for r in fingerprint.fingerprints(some, ranges=1).collect()}
    for ranges in (3, 500):
        assert {r.doc_id: r for r in fingerprint.fingerprints(some, ranges=ranges).collect()} == base


# -------------------------------------------------------------------- privacy --

PLAIN = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
         ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_valid(kind, value):
    if kind == "email":
        return True
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    digits = re.sub("[^0-9]", "", value)
    if kind == "phone":
        return 10 <= len(digits) <= 15
    total = sum(int(d) if i % 2 == 0 else int(d) * 2 - 9 * (int(d) > 4)
                for i, d in enumerate(reversed(digits)))
    return 14 <= len(digits) <= 19 and total % 10 == 0


def plain_spans(text):
    return [(k, s, e) for s, _, k, e in sorted(
        (m.start(), n, k, m.end()) for n, (k, p) in enumerate(PLAIN)
        for m in re.finditer(p, text or "") if plain_valid(k, m[0]))]


PERSONAL = ["a@b.c_d@e.f", "x.y+z@mail-1.example.com.", "a@b", "@@a@b.c@d.e", "a@b..c", "%@-.-",
            "1.2.3.4.5.6.7.8", "256.1.1.1 007.08.9.255", "1.2.3", "1.2.3.4.", "300.1.2.3.4",
            "4404189497460879 4041894974608795", "4041 8949-7460 8795", "4041  8949 7460 8795",
            "40418949746087951", "1 2 3 4", "+1 (456) 555-2186", "+15", "+1234567890123456", "+1-+12 345 678 90",
            "é😀 a@b.cd", "9" * 3000, "a" * 3000 + "@", "1.1." * 800, "a@" + "b." * 800, "+" + "1 " * 900]


def base_of(df):
    got = {}
    for r in privacy.personal_spans(df).collect():
        got[r.doc_id] = [(s.kind, s.start, s.end) for s in r.spans if s.kind != "term"]
    return got


def test_personal_base_spans(spark):
    rng = random.Random(11)
    parts = ["a", "B9", "@", ".", "..", "-", " ", "  ", "+", "(", ")", "1", "42", "255", "256", "_", "é", "\n",
             "4041894974608795", "4041 8949 7460 8795", "x@y.zz", "10.0.0.1", "+1 456 555 2186"]
    texts = PERSONAL + ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = base_of(df)
    for i, text in enumerate(texts):
        assert got[i] == plain_spans(text), text


def test_personal_query(spark, rows):
    got = {r.doc_id: r for r in queries.op4_pii(spark, CHECK).collect()}
    assert len(got) == len(rows)
    for r in rows:
        spans = plain_spans(r.text)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [got[r.doc_id][f"n_{k}"] for k in privacy.BASE] == \
            [sum(x[0] == k for x in spans) for k in privacy.BASE]


def term_corpus():
    """40 documents; `zorblatt` stands with one address only, `often` everywhere."""
    out = [(i, f"often here are words number w{i}x and often there") for i in range(36)]
    out += [(100 + i, f"often write to zorblatt at zed@mail.example.com or call w{i}y") for i in range(3)]
    return out + [(200, "often without any address")]


def test_disclosing_terms_against_brute_force(spark):
    rows = term_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end, s.action) for s in r.spans]
           for r in privacy.personal_spans(docs).collect()}
    total, entity = len(rows), "zed@mail.example.com"
    n_e = sum(entity in t for _, t in rows)
    for doc, text in rows:
        want = [("email", text.index(entity), text.index(entity) + len(entity), "mask")] if entity in text else []
        for m in re.finditer(r"[^\W\d_]\w{2,}", text) if entity in text else ():
            if want[0][1] <= m.start() < want[0][2]:
                continue
            n_t = sum(m[0] in re.findall(r"[^\W\d_]\w{2,}", t) for _, t in rows)
            n_te = sum(m[0] in re.findall(r"[^\W\d_]\w{2,}", t) and entity in t for _, t in rows)
            share = math.log2(n_te * total / (n_t * n_e)) / math.log2(total / n_e)
            if n_te >= 2 and share >= privacy.GENERALISE:
                want.append(("term", m.start(), m.end(),
                             "remove" if share >= privacy.REMOVE else "generalise"))
        assert got[doc] == sorted(want, key=lambda s: s[1])
    words = {text[s:e] for d, text in rows for k, s, e, _ in got[d] if k == "term"}
    assert "zorblatt" in words and "often" not in words
    clean = {r.doc_id: r.text for r in privacy.sanitised(docs).collect()}
    assert "zorblatt" not in clean[100] and "[removed]" in clean[100] and "[email]" in clean[100]
    assert clean[5] == rows[5][1]


def plain_terms(rows, support):
    """Term spans by the definition: every entity against every term, in whole documents."""
    word = r"[^\W\d_]\w{2,}"
    entities = {d: {(k, t[s:e].lower()) for k, s, e in plain_spans(t)} for d, t in rows}
    terms = {d: set(re.findall(word, t.lower())) for d, t in rows}
    out = {}
    for d, t in rows:
        base = plain_spans(t)
        out[d] = [(k, s, e, "mask") for k, s, e in base]
        best = {}
        for entity in entities[d]:
            with_e = [x for x, _ in rows if entity in entities[x]]
            for term in terms[d]:
                with_t = [x for x, _ in rows if term in terms[x]]
                both = set(with_e) & set(with_t)
                if len({dict(rows)[x] for x in both}) < support or len(with_e) == len(rows):
                    continue
                share = math.log2(len(both) * len(rows) / (len(with_t) * len(with_e))) \
                    / math.log2(len(rows) / len(with_e))
                best[term] = max(best.get(term, 0), share)
        for m in re.finditer(word, t):
            share = best.get(m[0].lower(), 0)
            if share >= privacy.GENERALISE and not any(s < m.end() and m.start() < e for _, s, e in base):
                out[d].append(("term", m.start(), m.end(),
                               "remove" if share >= privacy.REMOVE else "generalise"))
        out[d].sort(key=lambda x: x[1])
    return out


@pytest.mark.parametrize("support", [1, 2])
def test_terms_of_whole_documents_against_brute_force(spark, support):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(60)] + ["the", "and", "von", "Élan"]
    people = [("Vixxen", "10.1.2.3"), ("Zorblatt", "zed@mail.example.com"), ("Quopp", "+1 (456) 555-2186")]
    texts = []
    for i in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        if i % 4 == 0:    # name and entity far apart, the name again at the end
            name, entity = people[i // 4 % 3]
            text = [name, *text, "filler " * 30, entity, *rng.choices(words, k=30), name]
        texts.append(" ".join(text))
    texts += [texts[0], texts[0], "Vixxen alone", "Solo wrote from solo@x.yz", "10.1.2.3 zed@mail.example.com"]
    rows = list(enumerate(texts))
    got = {r.doc_id: [(s.kind, s.start, s.end, s.action) for s in r.spans] for r in privacy.personal_spans(
        spark.createDataFrame(rows, "doc_id long, text string"), support=support).collect()}
    assert got == plain_terms(rows, support)
    marked = [texts[0][s:e] for k, s, e, _ in got[0] if k == "term"]
    assert marked.count("Vixxen") == 2
    solo = [texts[63][s:e] for k, s, e, _ in got[63] if k == "term"]
    assert ("Solo" in solo) == (support == 1)


def test_privacy_edges(edge, empty):
    got = privacy.personal_spans(edge).collect()
    assert len(got) == len(edge_rows())
    assert {r.doc_id for r in got if len(r.spans)} == {8}
    clean = privacy.sanitised(edge)
    assert clean.columns == edge.columns and clean.count() == len(edge_rows())
    assert {r.text for r in clean.filter("doc_id in (3)").collect()} == {None}
    assert privacy.personal_spans(empty).count() == 0 and privacy.sanitised(empty).count() == 0


# ------------------------------------------------------------ decontamination --

def test_decontamination_against_brute_force(spark, rows):
    items = spark.read.parquet(f"{CHECK}/benchmark.parquet").collect()
    plain = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    index = {i.item_id: {tuple(w[k:k + 5]) for w in [plain(i.text)] for k in range(len(w) - 4)} for i in items}
    want = set()
    for r in rows:
        w = plain(r.text)
        own = {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
        want |= {(r.doc_id, i) for i, shingles in index.items() if len(own & shingles) >= 0.8 * len(shingles)}
    got = {(r.doc_id, r.item_id) for r in queries.op5_decontamination(spark, CHECK).collect()}
    assert got == want and len(want) > 10


QUESTION = ("Anna has 12 apples and buys 5 more for Ben at 3 dollars each. "
            "How many apples are there, and what did they cost in total?")


def test_reparameterised_questions(spark):
    bench = spark.createDataFrame([(0, QUESTION), (1, "x"), (2, None), (None, "w1 q r s t u v w x y z")],
                                  "item_id long, text string")
    texts = {
        1: "foo. " + QUESTION.replace("12", "44").replace(" 5 ", " 7 ").replace("Ben", "Carl Maria") + " bar",
        2: QUESTION.replace(" 5 ", " 12 "),        # two slots of the item become one
        3: QUESTION.upper(), 4: "apples cost 3 dollars", 5: None, 6: "", 7: "x",
        8: QUESTION.replace("apples", "pears").replace("buys", "sells"),
        9: "w1 q r s t u v w x y z", 10: "some words around. " + QUESTION + " and after"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_contaminated(docs, bench).collect()}
    assert {(1, 0), (10, 0), (7, 1), (9, None)} <= got
    assert not {d for d, _ in got} & {2, 4, 5, 6, 8}
    kept = decontaminate.drop_contaminated(docs, bench)
    assert {r.doc_id for r in kept.collect()} == set(texts) - {d for d, _ in got}


def held_in(spark, items, texts):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontaminate.find_contaminated(docs, bench).collect()}


def test_short_items_inside_documents(spark):
    items = ["Name the largest planet", "What is the capital of France?", "planet",
             "How far is it in 12 km of the way we go"]
    got = held_in(spark, items, [
        "Some words first. Name the largest planet of them all, and go on with the lesson.",
        "We consider this: What is the capital of France? Nobody knew.",
        "they asked us what is the capital of France and nobody knew",
        "He may name the\nlargest planet there", "the largest of them, name the planet", "planet",
        "so how far is it in 12\nkm of the way we go", "What was the capital of France?"])
    assert got == {(0, 0), (1, 1), (2, 1), (3, 0), (5, 2), (6, 3)}


def test_names_at_any_place(spark):
    item = ("Tom bought twelve. Anna bought half of what her brother had. Tom gave his sister two more. "
            "\"Anna should share them,\" said Paul Miller. How many did each of them have?")
    swapped = item.replace("Tom", "Raj").replace("Anna", "Mia").replace("Paul Miller", "Eve")
    texts = ["Before it. " + swapped + " After it.", item.replace(" Tom", "\n\nTom").replace(" Paul", "\n  Paul"),
             item.lower(), "Quiz\n" + swapped.replace(" Mia", "\tMia"), item.replace("Paul Miller", "Paul\nMiller"),
             swapped.replace("Mia", "Raj"),       # two names of the item become one
             "Which is the capital of Spain?", "We say: What is the capital of Spain?",
             "Paris is the capital of France"]
    got = held_in(spark, [item, "What is the capital of France?"], texts)
    assert got == {(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (7, 1)}


def test_decontamination_edges(spark, edge, empty):
    bench = spark.createDataFrame([(1, "one two three four five"), (1, "one two three four five")],
                                  "item_id long, text string")
    got = decontaminate.find_contaminated(edge, bench).collect()
    assert sorted((r.doc_id for r in got), key=str) == [1, 1, 2, None]
    kept = decontaminate.drop_contaminated(edge, bench)
    assert kept.columns == edge.columns and kept.count() == len(edge_rows()) - 4
    assert decontaminate.find_contaminated(empty, bench).count() == 0
    assert decontaminate.drop_contaminated(edge, bench.limit(0)).count() == len(edge_rows())


# ------------------------------------------------------------------- sharding --

def check_shards(rows, shards):
    counts = Counter(r.shard for r in rows)
    full = [counts.get(s, 0) for s in range(shards)]
    assert max(full) - min(full) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(full[s]))


def test_sharding_query(spark, rows):
    import zlib
    got = queries.op6_sharding(spark, CHECK).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in rows)
    check_shards(got, 8)
    texts = {r.doc_id: (r.text or "").encode() for r in rows}
    for r in got:
        assert (r.size, r.text_crc32) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]))
        assert r.law == "rows" and r.grown_shard is None


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(0, 63), st.integers(1, 40), max_size=30), st.integers(1, 6),
       st.randoms(use_true_random=False))
def test_walk_against_one_row_at_a_time(counts, shards, rng):
    places = sorted((rng.randrange(64), s) for s in range(shards) for _ in range(5))
    offsets, pieces = sharding.walk(counts, places, shards)
    n = sum(counts.values())
    # every arc's rows are covered once, every shard is filled to its room
    per_arc = Counter()
    for cell, (arc, offset) in sorted(offsets.items()):
        assert offset == per_arc[arc]
        per_arc[arc] += counts[cell]
        ahead = [i for i, (c, _) in enumerate(places) if c >= cell]
        assert arc == (ahead[0] if ahead else 0)
    taken = Counter()
    for arc in per_arc:
        runs = sorted(p for p in pieces if p[0] == arc)
        assert [r[1] for r in runs] == [0, *[r[2] for r in runs[:-1]]] and runs[-1][2] == per_arc[arc]
    for _, first, last, shard, slot in pieces:
        assert slot == taken[shard]
        taken[shard] += last - first
    assert [taken[s] for s in range(shards)] == [n // shards + (s < n % shards) for s in range(shards)]


def test_sharding_moves_little(docs):
    before = {r.doc_id: r.shard for r in sharding.assign_shards(docs, 8).collect()}
    after = {r.doc_id: r.shard for r in sharding.assign_shards(docs, 9).collect()}
    assert sum(before[d] != after[d] for d in before) < 0.5 * len(before)
    assert before == {r.doc_id: r.shard for r in sharding.assign_shards(docs.repartition(7), 8).collect()}


def test_sharding_edges(edge, empty):
    got = sharding.assign_shards(edge, 3).collect()
    assert len(got) == len(edge_rows())
    check_shards(got, 3)
    whole = sharding.shard_documents(edge, 3)
    assert set(whole.columns) == set(edge.columns) | {"shard"}
    check_shards(whole.collect(), 3)
    assert sharding.assign_shards(empty).count() == 0 and sharding.shard_documents(empty).count() == 0


# --------------------------------------------------------------------- mixing --

def plain_targets(sizes, weights, share=1.5, most=2.0):
    """Share, cap, and share the excess again until nothing is above its cap."""
    total, full = share * sum(sizes.values()), {}
    while True:
        free = {s: w for s, w in weights.items() if s not in full}
        left = total - sum(full.values())
        target = {s: left * w / sum(free.values()) for s, w in free.items()}
        above = {s for s in free if target[s] > most * sizes[s]}
        if not above:
            return {**full, **target}
        full |= {s: most * sizes[s] for s in above}


def test_mixing_query(spark, rows):
    got = queries.op7_mixing(spark, CHECK).collect()
    of = {r.doc_id: r for r in rows}
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(split(r.text))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    targets = plain_targets(sizes, weights)
    taken = Counter()
    assert len(got) == len(rows)
    for r in got:
        source = of[r.doc_id].source
        assert (r.size, r.source_size) == (len(split(of[r.doc_id].text)), sizes[source])
        assert r.target == pytest.approx(targets[source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[source] += r.taken
    largest = max(r.size for r in got)
    assert all(abs(taken[s] - targets[s]) <= largest / 2 for s in sizes)
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.op7_mixing(spark, CHECK).collect()))


def test_mixing_query_is_in_training_order(spark, tmp_path):
    """The last step of the curriculum: documents come where their first copy stands."""
    rows = [(i, "word " * (1 + i % 9), "abc"[i % 3]) for i in range(300)] + [(300, None, "a"), (None, "x", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5) \
        .write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op7_mixing(spark, str(tmp_path))
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken", "first_position"]
    at = [(2.0 if r.first_position is None else r.first_position, r.doc_id or -1) for r in got.collect()]
    assert len(at) == len(rows) and at[-1][0] == 2.0
    assert [p for p, _ in at] == sorted(p for p, _ in at)
    # as in the order of the copies: a document's first copy
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    first = list(dict.fromkeys(r.doc_id for r in mixing.training_order(docs).collect()))
    assert [r.doc_id for r in got.collect() if r.first_position is not None] == first


def test_positions_invert_the_demand(spark):
    df = spark.range(101).select((F.col("id") / 100 * 70.0).alias("o"))
    for slope in (-0.9, -0.5, 0.0, 0.5, 0.9):
        for r in df.select("o", mixing.position(F.col("o"), F.lit(70.0), F.lit(slope)).alias("t")).collect():
            assert 0 <= r.t <= 1 + 1e-9
            assert 70.0 * (r.t + slope * (r.t * r.t - r.t)) == pytest.approx(r.o, abs=1e-6)


def test_training_order(spark, docs):
    order = mixing.training_order(docs)
    assert order.columns == docs.columns
    mixed = mixing.curriculum_mix(docs).select(F.sum(F.size("positions"))).first()[0]
    assert order.count() == mixed
    # the falling source comes early, the rising one late
    ranks = {0: [], 2: []}
    rank = {s: i for i, s in enumerate(sorted({r.source for r in docs.select("source").collect()}))}
    for place, r in enumerate(order.select("source").collect()):
        if rank[r.source] % 3 in ranks:
            ranks[rank[r.source] % 3].append(place)
    assert sum(ranks[0]) / len(ranks[0]) < sum(ranks[2]) / len(ranks[2])


def test_mixing_edges(edge, empty):
    got = mixing.curriculum_mix(edge).collect()
    assert len(got) == len(edge_rows())
    assert all(not r.positions for r in got if r["size"] == 0)
    order = mixing.training_order(edge)
    assert order.columns == edge.columns and order.count() == sum(len(r.positions) for r in got)
    assert mixing.curriculum_mix(empty).count() == 0 and mixing.training_order(empty).count() == 0


# ------------------------------------------------------------------- pipeline --

def test_language_stage_rejects_foreign_and_gibberish(spark, docs, rows):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("bcdfghjklmnpqrstvwxzaeiou", k=rng.randint(4, 9)))
    planted = {-1: "это очень большой дом и собака там " * 5, -2: "これはとても大きな家です。" * 5,
               -3: " ".join(word() for _ in range(60)), -4: " ".join(word() for _ in range(25)), -5: "12 %"}
    latin = next(r.text for r in rows if r.lang == "fr" and len(r.text) > 800)
    planted[-6] = latin[:700] + " это дом"
    row = docs.limit(1).drop("doc_id", "text", "lang")
    extra = spark.createDataFrame([(i, t) for i, t in planted.items()], "doc_id long, text string") \
        .crossJoin(row).withColumn("lang", F.lit(None).cast("string"))
    kept = {r.doc_id for r in corpus_pipeline.language(
        spark, docs.unionByName(extra.select(*[F.col(c).cast(docs.schema[c].dataType) for c in docs.columns])),
        CHECK).select("doc_id").collect()}
    assert {i for i in kept if i < 0} == {-6}
    assert len(kept) - 1 > 0.99 * len(rows)


def test_pipeline(spark, docs, rows):
    from test_text_operators import plain_components, plain_simhash
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_dedup", "decontaminate", "mix", "shard"]
    kept, frames = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, CHECK)
        frames[name] = kept
        assert set(docs.columns) <= set(kept.columns)
        if name != "shard":
            assert kept.columns == docs.columns
        if name == "decontaminate":
            break
    ids = {n: sorted(r.doc_id for r in f.select("doc_id").collect()) for n, f in frames.items()}
    assert len(ids["language"]) > 0.99 * len(rows)
    texts = {r.doc_id: r.text for r in rows}
    prints = {i: plain_simhash(texts[i]) for i in ids["language"]}
    label = plain_components(prints.values())
    least = {}
    for i, p in prints.items():
        least[label[p]] = min(i, least.get(label[p], i))
    assert ids["near_dedup"] == sorted(least.values())
    leaked = {r.doc_id for r in queries.op5_decontamination(spark, CHECK).collect()}
    assert ids["decontaminate"] == [i for i in ids["near_dedup"] if i not in leaked]
    out = corpus_pipeline.run(spark, CHECK)
    got = out.collect()
    check_shards(got, 8)
    # the mix holds 150 % of the words that were kept, near enough
    words = sum(len(split(texts[i])) for i in ids["decontaminate"])
    assert sum(len(split(r.text)) for r in got) == pytest.approx(1.5 * words, rel=0.05)
    assert {r.doc_id for r in got} <= set(ids["decontaminate"])


def test_verification_looks_at_an_item_in_one_form(spark, monkeypatch):
    """What the stated form holds isn't verified again in the other two."""
    stated = "the train leaves the station at nine and comes back to the city before the night"
    plain = "then Anna Smith asked the Tom Brown group for seven more apples from the old garden"
    items = spark.createDataFrame([(1, stated), (2, plain)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"see: {stated}"), (2, f"well, {plain.lower()}"), (3, "nothing of them at all")],
                                 "doc_id long, text string")
    asked, verified = [], decontaminate._verified

    def spy(texts, indexed, lengths, candidates, share, forms=decontaminate.FORMS):
        asked.append((forms, candidates.filter(F.col("form").isin(*forms)).select("text_key").distinct().collect()))
        return verified(texts, indexed, lengths, candidates, share, forms)

    monkeypatch.setattr(decontaminate, "_verified", spy)
    got = {(r.doc_id, r.item_id): r.coverage for r in decontaminate.find_contaminated(docs, items).collect()}
    assert set(got) == {(1, 1), (2, 2)}
    key = {r.doc_id: r.k for r in docs.select("doc_id", F.xxhash64("text").alias("k")).collect()}
    forms = {f: {r.text_key for r in rows} for f, rows in asked}
    assert key[1] in forms[(decontaminate.STATED,)]
    assert forms[(decontaminate.PLAIN, decontaminate.NAMED)] == {key[2]}


def test_verification_makes_its_pairs_once(spark, monkeypatch):
    """What the clashes and the rows that stay are both made from is written and read, not made twice."""
    items = spark.createDataFrame([(1, "Anna had 12 apples and gave 5 to the tall man at the gate")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "see: Anna had 13 apples and gave 4 to the tall man at the gate"),
                                  (2, "see: Anna had 7 apples and gave 7 to the tall man at the gate")],
                                 "doc_id long, text string")
    plans, verified = [], decontaminate._verified

    def spy(*args):
        found = verified(*args)
        plans.append(found._jdf.queryExecution().optimizedPlan().toString())
        return found

    monkeypatch.setattr(decontaminate, "_verified", spy)
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_contaminated(docs, items).collect()} == {(1, 1)}
    assert plans and not any("regexp_extract_all" in p for p in plans)


def test_shared_windows_equal_those_of_every_form(spark):
    """The windows that are made once are all windows that the three forms have."""
    from demandcast.llm import decontaminate as D
    rng = random.Random(12)
    words = ["the", "in", "Anna", "McDonald", "John Smith", "km", "5", "12.5", "3km", "4  miles", "7\nhours", "8\n\nkg",
             "USA", "Éva", "Zoë.", "and,", ";", "\"Tom", "$9", "é̀", "o'Neil", "A", "x", "-", "9 Miles"]
    texts = ["", "Anna", "one two", "In Paris", "5 km", "\u0001 odd \u0004 marks here now and then"]
    texts += [rng.choice(["", "\n", " "]).join(w + rng.choice([" ", " ", "\n", "  "]) for w in rng.choices(words, k=n))
              for n in list(range(1, 14)) * 12]
    docs = spark.createDataFrame(list(enumerate(texts)), "text_key long, text string")
    for lengths in ([5], [2, 3, 8], [4, 5, 6], []):
        want = {}
        for form in D.FORMS:
            tokens = docs.select("text_key", D.template_tokens(F.col("text"), False, form).alias("t"))
            hashed = tokens.select("text_key", F.transform("t", lambda t: F.xxhash64(t)).alias("t"))
            for r in hashed.select("text_key", D._hashes(F.col("t"), form, lengths).alias("w")).collect():
                want.setdefault(r.text_key, set()).update(r.w)
        got = {}
        for r in D.window_hashes(docs, lengths).collect():
            got.setdefault(r.text_key, set()).add(r.window)
        assert got == {k: v for k, v in want.items() if v}


def test_located_many_matches_in_linear_time(spark, monkeypatch):
    import time
    rng = random.Random(5)
    texts = ["", "none", "a@b.cc", "é😀 a@b.cc"] + ["".join(rng.choice(["a@b.cc ", "é ", "😀", "long@mail.example ", "x"])
                                                      for _ in range(n)) for n in (3, 40, 255, 256, 257, 600, 1500)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    pattern = privacy.PATTERNS["email"]
    want = {t: [(m.start(), m.end(), m[0]) for m in re.finditer(
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", t)] for t in texts}
    for chunk in (privacy.CHUNK, 3):
        monkeypatch.setattr(privacy, "CHUNK", chunk)
        got = docs.select("text", privacy.located(F.col("text"), pattern).alias("m")).collect()
        assert {r.text: [tuple(x) for x in r.m] for r in got} == want
    monkeypatch.undo()
    many = spark.createDataFrame([("a@b.cc " * 60_000,)], "text string")
    start = time.time()
    assert many.select(F.size(privacy.located(F.col("text"), pattern)).alias("n")).first().n == 60_000
    assert time.time() - start < 60
