"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docflow.llm import byte_bpe, embedding_dedup, importance_resampling, jaccard_join, language_id, mixing, periodic_runs, pii, quality_rules, secret_scan, substring_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n long, sid long, h long, size long, host string, component_id long, spans string, label string"
LONG = " ".join(f"word{i % 997}" for i in range(30_000))
ROWS = [
    (0, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "a"),
    (0, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "a"),
    (1, None, None, None),
    (2, "", "en", None),
    (3, " \n\t ", "en", "b"),
    (4, LONG, "en", "b"),
    (5, "x" * 20_000, "de", "b"),
    (None, "a text without an id", None, "a"),
    (6, "é 日本語 😀 # $ % password=abcdefghijkl0123456789abcdef", "fr", "a"),
]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 1, 0.5, 1, 2, 3, 4, "x", 5, "y", "z") for r in rows], SCHEMA)


def labels(spark):
    return spark.createDataFrame([(0, 1, 1), (4, 1, 0), (None, 1, 1), (5, 0, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "op1": jaccard_join.jaccard_components,
    "op2": lambda d: toxicity.op2_rows(d, labels(d.sparkSession)),
    "op4": byte_bpe.op4_rows,
    "op5": quality_rules.op5_rows,
    "op6": mixing.op6_rows,
    "op7": language_id.op7_rows,
    "op8": pii.pseudonymise,
    "op9": substring_dedup.repeat_digests,
    "op10": secret_scan.scan_secrets,
    "op12": lambda d: importance_resampling.resampled(d, d.select("text")),
    "op13": periodic_runs.run_digests,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_out_for_each_row_in(spark, name):
    out = OPERATORS[name](table(spark)).collect()
    assert sorted(map(str, (r["doc_id"] for r in out))) == sorted(str(r[0]) for r in ROWS)
    twice = [tuple(r) for r in out if r["doc_id"] == 0]
    assert twice[0] == twice[1]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](table(spark, [])).collect() == []


def test_defined_results(spark):
    docs = table(spark)
    by = lambda df: {r["doc_id"]: r for r in df.collect()}
    sets = by(jaccard_join.jaccard_components(docs))
    assert (sets[1]["n_shingles"], sets[1]["component_id"], sets[5]["n_shingles"]) == (0, 1, 1)
    assert by(language_id.op7_rows(docs))[1]["lang_pred"] == "und"
    assert by(byte_bpe.op4_rows(docs))[2]["n_tokens"] == 0
    judged = by(quality_rules.op5_rows(docs))
    assert (judged[1]["n_words"], judged[1]["kept"]) == (0, False)
    assert by(pii.pseudonymise(docs))[1]["text"] is None
    found = by(secret_scan.scan_secrets(docs))[6]
    assert (found["n_assign"], found["n_hex"]) == (1, 1)


def test_documents_keep_their_columns(spark):
    docs = table(spark)
    for f in (quality_rules.keep_good, jaccard_join.one_of_each, secret_scan.redact_secrets, mixing.mix_documents):
        assert f(docs).columns == docs.columns
    assert jaccard_join.one_of_each(docs).filter("doc_id IS NULL").count() == 1
    assert mixing.mix_documents(docs).filter(F.col("doc_id") == 4).count() <= 3


def test_vectors(spark):
    v = [1.0, 0.0, 0.0, 0.0]
    nan, inf = float("nan"), float("inf")
    rows = [(1, v, 0), (2, v, 0), (2, v, 0), (3, [0.99, 0.05, 0.0, 0.0], 0), (4, v, 1), (5, v, None), (6, None, 0), (7, [0.0] * 4, 0), (8, [nan, 1.0, 0.0, 0.0], 0), (9, [inf, 1.0, 0.0, 0.0], 0), (10, [1.0, None, 0.0, 0.0], 0), (11, [0.0, 1.0, 0.0, 0.0], 0), (12, [1.0, 0.0], 0)]
    table_ = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, list string, n int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(table_).collect())
    alone = [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12)]
    assert got == sorted([(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 3, 1, False), *alone])
    assert embedding_dedup.near_duplicates(table_.limit(0)).collect() == []
