"""Benchmark items in documents: short ones against brute force, and the share found of items with exchanged words."""

import random

import pytest

from dealtrace.llm import decontaminate as D

SCHEMA = "doc_id long, text string"


def places(words, item):
    return [i for i in range(len(words) - len(item) + 1) if words[i : i + len(item)] == item]


def test_items_of_one_to_four_words_equal_brute_force(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(60)}"
    docs = [(i, [word() for _ in range(rng.randrange(0, 40))]) for i in range(150)]
    items = [(k, [word() for _ in range(n)]) for k, n in enumerate([1, 2, 2, 3, 3, 3, 4, 4] * 6)]
    items += [(100, ["nowhere"]), (101, []), (102, ["w1", "nowhere"])]
    frame = lambda rows, schema: spark.createDataFrame([(i, " ".join(x)) for i, x in rows], schema)
    found = D.leaks(frame(docs, SCHEMA), frame(items, "item_id long, text string"), shortest=1).collect()
    want = {(d, k) for d, words in docs for k, item in items if item and places(words, item)}
    assert want and {(r.doc_id, r.item_id) for r in found} == want
    words, texts = dict(docs), dict(items)
    assert all(r.at_word in places(words[r.doc_id], texts[r.item_id]) and r.matched == r.n_words for r in found)


@pytest.mark.parametrize("n, least", [(5, 1.0), (10, 1.0), (15, 1.0), (16, 0.95), (20, 0.97), (40, 0.99)])
def test_items_with_a_fifth_of_the_words_exchanged_are_found(spark, n, least):
    rng = random.Random(n)
    word = lambda: f"t{rng.randrange(10**6)}"
    items = [(k, [word() for _ in range(n)]) for k in range(200)]
    docs = []
    for k, item in items:
        changed = list(item)
        for i in rng.sample(range(n), n // 5):
            changed[i] = word()
        before, after = rng.randrange(30), rng.randrange(30)
        docs.append((k, [word() for _ in range(before)] + changed + [word() for _ in range(after)]))
    frame = lambda rows, schema: spark.createDataFrame([(i, " ".join(x)) for i, x in rows], schema)
    found = D.leaks(frame(docs, SCHEMA), frame(items, "item_id long, text string")).collect()
    pairs = {(r.doc_id, r.item_id) for r in found}
    assert pairs <= {(k, k) for k, _ in items}
    print(n, len(pairs) / len(items))
    assert len(pairs) >= least * len(items)
