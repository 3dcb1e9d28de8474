"""Operator 11 against brute force."""

import re
from itertools import permutations

import pytest

from demandcast.llm import filter_audit

SCHEMA = "doc_id long, text string, source string, part string, mask int, segment int, first int"
LONG = " ".join(f"word{i}" for i in range(60_000))
CLEAN = " ".join(f"term{i}" for i in range(60))


def rows():
    texts = [(1, CLEAN, "a"), (2, CLEAN, "a"), (3, CLEAN, "b"), (4, CLEAN + " #", "b"), (5, None, None),
             (6, "", ""), (7, "same " * 70, "a"), (8, "SHOUT " * 60, "a"), (8, "SHOUT " * 60, "a"),
             (None, CLEAN, "a"), (None, None, None), (9, LONG, "b"), (10, LONG, "b"), (11, CLEAN + " é😀", "a"),
             (12, " \t\n ", "b"), (13, "a b " * 30, "b"), (3, "x", "b"), (14, "x", "b"), (15, "x", "b")]
    texts += [(100 + i, "the hot text " * 20, "hot") for i in range(200)]
    texts += [(1000 + i, f"{CLEAN} {i}", "c") for i in range(300)]
    return [(*t, "q", 3, 1, 2) for t in texts]


LABELS = [(1, 1, 0), (2, 1, 1), (8, 1, 0), (8, 0, 1), (100, 1, 0), (101, 1, 1), (None, 1, 1), (5, 0, 1), (77, 1, 1)]


def brute(docs, labels):
    plain = [(i, t or "", s or "") for i, t, s, *_ in docs]
    least = {}
    for i, t, _ in plain:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out, fails = {}, []
    for i, t, s in plain:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w),
             "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
             "E": i is not None and i > least[t]}
        fails.append((i, s, {k for k in f if f[k]}))
    names = ("kept", "removed", "redundant", "unique", "good", "toxic")
    for order in map("".join, permutations("ABCDE")):
        for step, letter in enumerate(order, 1):
            for part in {s for _, s, _ in fails}:
                out[part, order, step] = dict.fromkeys(names, 0)
            for i, s, f in fails:
                c, before = out[s, order, step], set(order[:step - 1])
                gone = bool(f & before)
                c["kept"] += not gone and letter not in f
                c["removed"] += not gone and letter in f
                c["redundant"] += gone and letter in f
                c["unique"] += f == {letter}
                c["good"] += not gone and letter in f and i in good
                c["toxic"] += not gone and letter in f and i in toxic
    shapley = {}
    for (part, order, step), c in out.items():
        key = part, order[step - 1]
        shapley[key] = shapley.get(key, 0) + c["removed"]
    return sorted((*k, *c.values(), shapley[k[0], k[1][k[2] - 1]]) for k, c in out.items())


@pytest.mark.parametrize("sketch_bytes", [filter_audit.SKETCH_BYTES, 0])
def test_audit_equals_brute_force(spark, sketch_bytes):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    masks = filter_audit.failure_masks(docs, sketch_bytes)
    got = filter_audit.audit(filter_audit.mask_counts(masks, labels))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
                           "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == brute(rows(), LABELS)


def test_sketch_clears_unique_texts_only(spark):
    texts = [f"unique {i}" for i in range(4000)] + [f"twice {i % 500}" for i in range(1000)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7)
    got = filter_audit.with_possible_repeats(frame, 3).collect()
    assert len(got) == len(texts)
    assert all(r.possible for r in got if r.text.startswith("twice"))  # never clears a repeat
    assert sum(r.possible for r in got if r.text.startswith("unique")) < 0.02 * 4000


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(docs, labels).count() == 0


def test_text_doc_ids(spark):
    docs = spark.createDataFrame([("a", "x", "s"), ("b", "x", "s"), (None, "x", "s")],
                                 "doc_id string, text string, source string")
    got = {(r.doc_id, r.mask) for r in filter_audit.failure_masks(docs).collect()}
    assert got == {("a", 1), ("b", 17), (None, 1)}
