"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import pytest

import corpus_pipeline
from dealtrace.llm import decontaminate, license_scan, mixing, quality, secret_scan, simhash, substring_dedup, toxicity
from dealtrace.llm.queries import LLM_QUERIES

LABELS = [(1, 1, 0), (2, 0, 0), (3, 0, 1), (6, 1, None), (7, None, 1), (None, 1, 1), (7, 0, 1)]


def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


BY_ROW = {
    "licences": lambda s, d: license_scan.license_digest(license_scan.license_spans(d)),
    "mix": lambda s, d: mixing.mix(d),
    "secrets": lambda s, d: secret_scan.secret_digest(secret_scan.secret_spans(d)),
    "simhash": lambda s, d: simhash.simhash_digest(simhash.simhash_groups(d)),
    "repeats": lambda s, d: substring_dedup.remove_repeats(d),
    "quality": lambda s, d: quality.quality_scores(d, labels(s)),
    "toxicity": lambda s, d: toxicity.toxicity_scores(d, labels(s)),
}


@pytest.mark.parametrize("name", sorted(BY_ROW))
def test_one_row_for_each_row(spark, odd_docs, name):
    rows = BY_ROW[name](spark, odd_docs).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "2", "3", "4", "6", "7", "None", "None"]
    ones = [r for r in rows if r.doc_id == 1]
    assert ones[0] == ones[1]


@pytest.mark.parametrize("name", sorted(BY_ROW))
def test_an_empty_table(spark, odd_docs, name):
    assert BY_ROW[name](spark, odd_docs.where("false")).count() == 0


def test_results_of_empty_texts(spark, odd_docs):
    empty = {2, 3, 4}
    by = {n: {r.doc_id: r for r in BY_ROW[n](spark, odd_docs).collect()} for n in ("licences", "secrets", "simhash", "repeats", "mix")}
    for d in empty:
        assert (by["licences"][d].n_words, by["licences"][d].labels, by["licences"][d].score) == (0, "", 0.0)
        assert by["secrets"][d].spans == "" and by["mix"][d].size == 0
        assert (by["simhash"][d].fingerprint, by["simhash"][d].component_id) == ("0" * 16, 2)
        assert (by["repeats"][d].n_words, by["repeats"][d].n_removed) == (0, 0)
    assert by["licences"][7].base_labels == "mit" and by["secrets"][7].n_assign == 1
    # Three equal texts of 45 words: every window repeats.
    assert by["repeats"][1].n_removed == by["repeats"][1].n_words == 45


def test_leaks_of_odd_rows(spark, odd_docs):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (None, None)], "item_id long, text string")
    assert sorted(str(r.doc_id) for r in decontaminate.leaks(odd_docs, items).collect()) == ["1", "None"]


def test_stages_keep_the_columns(spark, odd_docs, tmp_path):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd_docs, odd_docs.where("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, str(tmp_path)).columns == docs.columns
            stage(spark, docs, str(tmp_path)).collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()


def test_pipeline_of_the_given_tables(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.run(spark, folder).collect()
    ids = {r.doc_id for r in out}
    assert ids <= {r.doc_id for r in docs.collect()} and len(ids) > 100
    assert not ids & {r.doc_id for r in LLM_QUERIES["op6_decontaminate"](spark, folder).collect()}
    assert max(r.copy for r in out) <= 3 and len({(r.doc_id, r.copy) for r in out}) == len(out)
    assert not any(secret_scan.base_spans(r.text) for r in out)


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in LLM_QUERIES] == [f"op{i}" for i in range(1, 14)]
