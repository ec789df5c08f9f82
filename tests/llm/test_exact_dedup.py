import hashlib

import pytest

from gradewright.llm import exact_dedup
from gradewright.llm.exact_dedup import DigestIndex
from gradewright.session import shared_dir

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))


def norm(text):
    return (text or "").encode().translate(bytes.maketrans(UPPER, LOWER))


@pytest.fixture
def index(spark):
    return DigestIndex(spark, shared_dir(spark, "test-index"), 4)


def test_largest_id_stays_and_case_counts_as_equal(rows, index):
    data = [(1, "Ab c"), (7, "aB C"), (3, "ab c"), (4, "äB"), (5, "ÄB"), (6, None), (2, ""), (9, "x" * 300_000)]
    got = {r.doc_id: r for r in index.add(rows(data, "doc_id long, text string"), "b").collect()}
    groups = {}
    for i, t in data:
        groups.setdefault(norm(t), []).append(i)
    for i, t in data:
        g, r = groups[norm(t)], got[i]
        assert (r.keep_id, r.group_size, r.kept) == (max(g), len(g), i == max(g))
        assert bytes(r.digest) == hashlib.sha256(norm(t)).digest()


def test_repeated_rows_null_ids_and_clashing_columns(rows, index):
    data = [(1, "a", 5, "k"), (1, "a", 6, "k"), (None, "a", 7, "k"), (None, "z", 8, "k")]
    got = index.add(rows(data, "doc_id long, text string, keep_id int, digest string"), "b").collect()
    assert len(got) == 4
    assert sorted((str(r.doc_id), r.group_size, r.kept) for r in got) == [
        ("1", 3, False), ("1", 3, True), ("None", 1, True), ("None", 3, False)]


def test_later_batches_meet_the_index_and_it_reopens(spark, rows):
    path = shared_dir(spark, "test-index")
    first = DigestIndex(spark, path, 4)
    first.add(rows([(1, "a"), (2, "b")], "doc_id long, text string"), "one").collect()
    again = DigestIndex(spark, path, 4)
    got = {r.doc_id: r for r in again.add(rows([(3, "A"), (4, "c"), (5, "C")], "doc_id long, text string"), "two").collect()}
    assert (got[3].keep_id, got[3].kept, got[3].group_size) == (1, False, 2)
    assert (got[4].keep_id, got[4].kept, got[5].kept) == (5, False, True)
    assert again.rows().count() == 3
    assert again.add(rows([(4, "c")], "doc_id long, text string"), "three").filter("kept").count() == 0


def test_empty_table(rows, index):
    assert index.add(rows([], "doc_id long, text string"), "b").count() == 0
    assert index.rows().count() == 0


TEXTS = "doc_id long, text string"


def answers(frame):
    return sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in frame.collect())


def test_a_batch_added_again_is_told_the_same(spark, rows, index):
    one, two = rows([(1, "a"), (2, "b"), (3, "B")], TEXTS), rows([(4, "b"), (5, "c")], TEXTS)
    first = answers(index.add(one, "one"))
    assert [k for *_, k in first] == [True, False, True]
    assert answers(index.add(one, "one")) == first and index.rows().count() == 2
    second = answers(index.add(two, "two"))
    assert second == [(4, 3, 3, False), (5, 5, 1, True)]
    assert answers(index.add(one, "one")) == first and answers(index.add(two, "two")) == second
    assert index.rows().count() == 3


def test_a_run_lost_between_registering_and_answering_loses_nothing(spark, rows, index, monkeypatch):
    data = rows([(1, "a"), (2, "b")], TEXTS)
    index.add(rows([(9, "a")], TEXTS), "other")

    def lost(*_):
        raise RuntimeError("lost")
    for step in ("join_by_key", "written"):  # after the insert, and before it
        with monkeypatch.context() as m:
            m.setattr(exact_dedup, step, lost)
            with pytest.raises(RuntimeError):
                index.add(data, "b")
        assert answers(index.add(data, "b")) == [(1, 9, 2, False), (2, 2, 1, True)]
    half = index._at("batch-half")  # a folder without its end mark is not read
    index._files().mkdirs(half)
    assert index.rows().count() == 2
    assert answers(index.add(rows([(7, "z")], TEXTS), "half")) == [(7, 7, 1, True)]


def test_merging_keeps_answers(spark, rows, index, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MOST_TABLES", 3)
    batches = {f"b{k}": rows([(10 * k, f"t{k}"), (10 * k + 1, f"t{k + 1}"), (10 * k + 2, "all")], TEXTS) for k in range(7)}
    first = {name: answers(index.add(docs, name)) for name, docs in batches.items()}
    assert len(index.folders()) <= 3
    assert sorted(r.keep_id for r in index.rows().collect()) == sorted(i for a in first.values() for i, _, _, kept in a if kept)
    for name, docs in batches.items():
        assert answers(index.add(docs, name)) == first[name]
    assert index.rows().select("digest").distinct().count() == index.rows().count() == 9
    # A merge that dies before it removes what it replaced: nothing is read twice.
    with monkeypatch.context() as m:
        m.setattr(exact_dedup.DigestIndex, "_settle", lambda self: None)
        index.merge()
        assert index.rows().count() == 9 and len(index.folders()) == 1
    assert answers(index.add(batches["b3"], "b3")) == first["b3"] and index.rows().count() == 9
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("digest_index")]


def test_index_side_has_neither_exchange_nor_sort(spark, rows, index):
    """After three batches: the new rows are shuffled and sorted once, the tables not at all."""
    for k in range(3):
        index.add(rows([(k, f"t{k}"), (k + 100, f"u{k}")], TEXTS), f"b{k}")
    seen = rows([(1, "a")], TEXTS).selectExpr("unhex(sha2(text, 256)) digest")
    with index._tables(index.folders()) as tables:
        plan = index.unseen(seen, tables, "new")._jdf.queryExecution().executedPlan().toString()
    assert len(tables) == 3 and plan.count("SortMergeJoin") == 3
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1


def test_batch_names_are_checked(rows, index):
    with pytest.raises(ValueError):
        index.add(rows([], TEXTS), "../x")
