"""Result documents: content, sink by cell, resume."""

import os

import pytest
from pyspark.sql import functions as F

from gradewright.sources import results

SETTINGS = {"evaluation_profile": "recorded-v1", "draft_weights": "a=1.0"}
KEYS = ("triage_model", "draft_model")


def cells(rows, tone=0.9, errors=0):
    cell = "triage_model STRING, draft_model STRING, "
    scores = rows([("1", "x", "tone match", tone), ("1", "x", "urgent recall", None),
                   ("2", "x", "tone match", 0.5)], cell + "metric STRING, value DOUBLE")
    counts = rows([("1", "x", "scored", 3), ("1", "x", "tone match scored", 2),
                   ("2", "x", "scored", 3), ("2", "x", "tone match scored", 1)], cell + "name STRING, n BIGINT")
    failures = rows([("1", "x", "tone match errors", errors), ("2", "x", "schema", 4)],
                    cell + "name STRING, n BIGINT")
    breaches = rows([("2", "x", "tone match", 0.5, 0.8)], cell + "metric STRING, value DOUBLE, bar DOUBLE")
    composites = rows([("1", "x", 0.7), ("2", "x", None), ("3", "x", None)], cell + "composite_triage DOUBLE")
    return results.documents(scores, counts, failures, breaches, composites, SETTINGS, KEYS)


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_document_holds_all_parts(rows):
    got = {r.triage_model: r.asDict(recursive=True) for r in cells(rows).collect()}
    assert got["1"]["scores"] == {"tone match": 0.9, "urgent recall": None}
    assert got["1"]["counts"] == {"scored": 3, "tone match scored": 2}
    assert got["2"]["breaches"] == [{"name": "tone match", "value": 0.5, "bar": 0.8}]
    assert got["2"]["failures"] == {"schema": 4} and got["1"]["breaches"] == []
    assert (got["3"]["scores"], got["3"]["breaches"]) == ({}, [])
    assert got["1"]["settings"] == SETTINGS


def test_only_changed_cells_are_written_and_the_rest_is_resumed(spark, rows, tmp_path):
    path = str(tmp_path / "documents")
    first = cells(rows)
    assert results.read_documents(spark, path, first.schema).count() == 0
    results.write_documents(first, path, KEYS)
    before = files(path)
    results.write_documents(cells(rows), path, KEYS)
    assert files(path) == before
    results.write_documents(cells(rows, tone=0.95), path, KEYS)
    after = files(path)
    assert {"triage_model=1" in f for f in before - after} == {True} and len(before & after) == 2
    stored = results.read_documents(spark, path, first.schema)
    assert results.damaged(stored).count() == 0
    assert results.damaged(stored.withColumn("composite_triage", F.lit(0.1))).count() == 3
    left = results.cells_to_resume(stored, stored.select(*KEYS), SETTINGS, 3, 2, ("tone match",), KEYS)
    assert sorted(r.triage_model for r in left.collect()) == ["2", "3"]


def test_a_cell_with_failed_ratings_is_run_again(rows):
    left = results.cells_to_resume(cells(rows, errors=1), cells(rows).select(*KEYS), SETTINGS, 3, 2,
                                   ("tone match",), KEYS)
    assert left.count() == 3


@pytest.mark.parametrize("settings", [{"evaluation_profile": "other"}, {"golden_set": "golden-v2"}])
def test_other_settings_are_refused(rows, settings):
    stored = cells(rows)
    left = results.cells_to_resume(stored, stored.select(*KEYS), settings, 3, 2, ("tone match",), KEYS)
    with pytest.raises(Exception, match="resume conflict"):
        left.collect()
