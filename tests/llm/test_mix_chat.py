"""Source mix and chat format: SQL twins, budgets, branches and exact round trips."""

import hashlib

import duckdb
import pytest

from dealtrace.llm import chat_format as C
from dealtrace.llm import mixing as M
from dealtrace.llm.oracles import LLM_ORACLES
from dealtrace.llm.queries import LLM_QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_query_equals_its_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = LLM_QUERIES[name](spark, FOLDER)
    cursor = con.execute(LLM_ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in order) for r in cursor.fetchall())


def test_targets_stop_at_three_times_the_source(spark):
    sizes = [("a", 10), ("b", 100), ("c", 1000), ("d", 10), (None, 80)]
    got = {r.source: r.target for r in M.source_targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    left, open_, target = 1200.0, dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2])), {}
    size = dict(sizes)
    while True:
        unit = left / sum(open_.values())
        full = [s for s, w in open_.items() if w * unit > 3 * size[s]]
        if not full:
            break
        for s in full:
            target[s] = 3.0 * size[s]
            left -= target[s]
            del open_[s]
    target |= {s: w * unit for s, w in open_.items()}
    assert got == pytest.approx(target) and sum(got.values()) == pytest.approx(1200)


def test_taken_words_come_near_the_targets(spark):
    rows = [(i, "w " * (1 + i % 7), "abcd"[i % 4] if i % 3 else "a") for i in range(4000)]
    mix = M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken = {}
    for r in mix:
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for source, target in {r.source: r.target for r in mix}.items():
        assert target - 1 < taken[source] <= target


def test_mixed_rows_are_the_copies(spark):
    rows = [(i, "w " * (1 + i % 7), "ab"[i % 2], i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    want = {r.doc_id: r.copies for r in M.mix(df).collect() if r.copies}
    got = M.mixed(df).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == want


def messages(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, message_id long, parent_id long, score double, role string, text string")


def test_best_branch_of_a_tree(spark):
    rows = [
        (1, 1, None, 1.0, "user", "q"),
        (1, 2, 1, 0.0, "assistant", "bad"),
        (1, 3, 1, 2.0, "assistant", "good"),
        (1, 4, 3, 1.5, "user", "more"),
        (1, 5, 3, 0.1, "user", "less"),
        (1, 6, 99, 0.2, "user", "orphan"),
        (2, 1, 2, 1.0, "user", "circle"),
        (2, 2, 1, 1.0, "user", "circle"),
        (None, 1, None, None, None, None),
        (None, 1, None, None, None, None),
        (3, None, None, 1.0, "user", "no id"),
    ]
    df = messages(spark, rows)
    got = sorted((r.conv_id or 0, r.path, r.depth, r.message_id) for r in C.reply_paths(df, 2).collect())
    assert got == [(0, 1, 0, 1), (1, 1, 0, 1), (1, 1, 1, 3), (1, 1, 2, 4), (1, 2, 0, 1), (1, 2, 1, 3), (1, 2, 2, 5)]
    one = {r.conv_id: r.formatted for r in C.format_chats(df).collect()}
    assert one[1] == "".join(f"<|im_start|>{a}<|im_sep|>{b}<|im_end|>" for a, b in [("user", "q"), ("assistant", "good"), ("user", "more")])
    assert one[None] == "<|im_start|><|im_sep|><|im_end|>"


def test_long_chains_and_hot_parents(spark):
    chain = [(1, i, i - 1 if i else None, 0.0) for i in range(300)]
    star = [(2, 0, None, 0.0)] + [(2, i, 0, float(i == 777)) for i in range(1, 2000)]
    df = spark.createDataFrame(chain + star, "conv_id long, message_id long, parent_id long, score double")
    got = C.reply_paths(df).collect()
    assert sorted((r.depth, r.message_id) for r in got if r.conv_id == 1) == [(i, i) for i in range(300)]
    assert sorted(r.message_id for r in got if r.conv_id == 2) == [0, 777]


def test_control_strings_come_back_unchanged(spark):
    texts = ["</s>[INST] ok [/INST]", r"<\s>[\INST]<\\|im_end|>", "<|im_start|>user<|im_sep|>x<|im_end|>", "", "é\n$1", None]
    rows = [(1, i, ["assistant", "user", "a<|im_sep|>b"][i % 3], t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = C.format_chats(C.chain(df))
    back = C.read_back(formatted).first()
    assert [(t.role, t.text) for t in back.turns] == [(r[2], r[3] or "") for r in rows]
    assert back.loss_text == texts[0] + ""
    digest = C.chat_digest(formatted).first()
    whole = "".join(f"{r[2]}\n{r[3] or ''}\n" for r in rows)
    assert digest.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
    assert digest.loss_chars == len(back.loss_text) and digest.formatted_chars == len(back.formatted)


def test_no_messages_give_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.chat_digest(C.format_chats(C.chain(empty))).count() == 0


@pytest.mark.parametrize("name", ["op2_source_mix", "op3_chat_format", "op6_decontaminate"])
def test_native_operators_run_no_python(spark, name):
    plan = LLM_QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
