"""Sets as bits against Python sets: long dictionaries, hot entities, parts merged, selection."""

import random

import pytest

from dealtrace.operators import dictionary, having, listed, marks, memberships, merged

SCHEMA = "who string, what string"


def pairs(seed=3, n=4_000, values=150):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", f"e{rng.randrange(40)}", None]), f"v{rng.randrange(values):03d}") for _ in range(n)]
    return rows + [(f"e{i}", None) for i in range(3)] + [("lone", None), ("few", "v000"), ("few", "v000")]


def sets_of(rows):
    out = {}
    for who, what in rows:
        if who is not None and what is not None:
            out.setdefault(who, set()).add(what)
    return out


@pytest.fixture(scope="module")
def data(spark):
    rows = pairs()
    df = spark.createDataFrame(rows, SCHEMA)
    codes = dictionary(df, "what")
    return rows, df, codes, memberships(df, "who", "what", codes)


def test_lists_equal_sets_over_several_words(data):
    rows, _, codes, members = data
    got = {r.who: r.x for r in listed(members, "who", codes, "x").collect()}
    assert got == {k: sorted(v) for k, v in sets_of(rows).items()}
    counts = {r.who: r.n_x for r in listed(members, "who", codes, "x").collect()}
    assert counts == {k: len(v) for k, v in sets_of(rows).items()}
    assert members.groupBy("who").count().agg({"count": "max"}).first()[0] <= 3


def test_parts_merge_to_the_whole(spark, data):
    rows, _, codes, members = data
    parts = [memberships(spark.createDataFrame(rows[i::3], SCHEMA), "who", "what", codes) for i in range(3)]
    whole = lambda df: sorted(map(tuple, df.collect()))
    assert whole(merged(*parts, parts[0])) == whole(members)


def test_selection_equals_set_algebra(data):
    rows, _, codes, members = data
    sets = sets_of(rows)
    cases = [
        ([], [], []),
        (["v000"], [], []),
        (["v000", "v000", "v149"], [], []),
        ([], ["v001", "v140"], ["v002"]),
        (["v070"], ["v003", "nobody's"], ["v004", "v100"]),
        (["nobody's"], [], []),
        ([], ["nobody's"], []),
        ([], [], ["nobody's"]),
    ]
    for all_of, any_of, none_of in cases:
        got = {r.who for r in having(members, "who", codes, all_of, any_of, none_of).collect()}
        want = {
            k
            for k, v in sets.items()
            if set(all_of) <= v and (not any_of or v & set(any_of)) and not v & set(none_of)
        }
        assert got == want, (all_of, any_of, none_of)


def test_sets_are_reduced_by_a_hash_aggregate_before_the_shuffle(data):
    members = data[3]
    plan = members._jdf.queryExecution().executedPlan().toString()
    assert "partial_bit_or" in plan and "ObjectHashAggregate" not in plan and "SortAggregate" not in plan


def test_empty_tables_have_no_sets(spark):
    none = spark.createDataFrame([], SCHEMA)
    codes = dictionary(none, "what")
    members = memberships(none, "who", "what", codes)
    assert listed(members, "who", codes, "x").collect() == []
    assert having(members, "who", codes, ["a"]).collect() == []


def test_marks_tell_which_frames_have_an_entity(spark):
    a = spark.createDataFrame([("x",), ("y",), ("y",), (None,)], "who string")
    b = spark.createDataFrame([("y",), ("z",)], "who string")
    assert sorted(map(tuple, marks({"a": a, "b": b}, "who").collect())) == [
        ("x", True, False),
        ("y", True, True),
        ("z", False, True),
    ]
    with pytest.raises(ValueError):
        marks({str(i): a for i in range(64)}, "who")
