import math

import numpy as np
import pytest

from gradewright.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>"


def brute(data, components=16, weighting="one"):
    """{(vec_id, component): (n, deviation, whitened, explained)}; python integers and numpy in one place."""
    good = [(i, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)) for i, v in data
            if v and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted({x for _, x in good})
    weight = [sum(x == y for _, y in good) if weighting == "count" else 1 for x in distinct]
    n = sum(weight)
    sums = [sum(w * x[k] for w, x in zip(weight, distinct)) for k in range(len(distinct[0]))]
    centred = {x: np.array([(n * a - s) / n for a, s in zip(x, sums)]) for x in distinct}
    m = np.array([centred[x] for x in distinct])
    v = (m.T * weight) @ m / n
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    out = []
    for i, x in good:
        dev = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        for k in range(min(components, len(e))):
            if e[k] > 1e-13 * np.trace(v):
                out.append((i, k + 1, n, dev, abs(centred[x] @ axes[:, k]) / math.sqrt(e[k]), e[k] / np.trace(v)))
    return sorted(out, key=str)


def check(got, want):
    rows = got.collect()
    have = sorted(((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in rows), key=str)
    key = [(r[0] is None, r[0] or 0, r[1], r[3]) for r in have], [(r[0] is None, r[0] or 0, r[1], r[3]) for r in want]
    assert sorted(key[0]) == sorted(key[1])
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], round(r[4], 6))
    for a, b in zip(sorted(have, key=order), sorted(want, key=order)):
        assert a[:4] == b[:4]
        assert a[4] == pytest.approx(b[4], abs=1e-7) and a[5] == pytest.approx(b[5], rel=1e-9)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-6
    return rows


def corpus(seed, rows, width):
    r = np.random.default_rng(seed)
    base = r.normal(size=(rows, width)) @ np.diag(np.linspace(.2, 3, width)) + r.normal(size=width)
    data = [(int(i), [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    hot = data[3][1]
    return data + [(1000 + k, hot) for k in range(rows // 2)] + [(2000 + k, data[k % 5][1]) for k in range(20)]


@pytest.mark.parametrize("weighting", ["one", "count"])
def test_matches_brute_force(rows, weighting):
    data = corpus(1, 120, 20)
    rows_ = check(whitening.whiten(rows(data, SCHEMA), weighting=weighting), brute(data, weighting=weighting))
    # One sign for all rows: signed values of two vectors differ as the brute force's do, up to one sign a component.
    z = {(r.vec_id, r.component): r.whitened for r in rows_}
    assert all(z[1000, k] == z[3, k] for k in range(1, 17))
    assert all(abs(sum(z[i, k] for i in range(120))) < 1e-6 for k in range(1, 17)) or weighting == "count"


def test_query(spark, rows, tmp_path):
    data = corpus(2, 90, 5) + [(1, None), (2, []), (3, [1.0, None, 2.0, 3.0, 4.0]), (4, [float("nan")] * 5),
                               (5, [1.0, 2.0, float("inf"), 0.0, 0.0]), (None, [0.5] * 5), (1, [1.25] * 5), (1, [1.25] * 5)]
    rows(data, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    check(queries.queries()["op13_whitening"](spark, str(tmp_path)), brute(data))


def test_degenerate_tables(rows):
    assert whitening.whiten(rows([], SCHEMA)).count() == 0
    assert whitening.whiten(rows([(1, None)], SCHEMA)).count() == 0
    assert whitening.whiten(rows([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).count() == 0
    flat = [(i, [float(i), 2.0 * i, 7.0]) for i in range(10)]  # one direction only
    assert {r.component for r in check(whitening.whiten(rows(flat, SCHEMA)), brute(flat))} == {1}


def test_other_widths_and_clashing_columns(rows):
    data = [(i, [float(i * i % 7), float(i)], 1, b"x", 2) for i in range(9)] + [(50, [1.0], 1, b"x", 2)]
    got = whitening.whiten(rows(data, SCHEMA + ", weight int, digest binary, component int"))
    check(got, brute([d[:2] for d in data[:9]]))


def test_huge_entries(rows):
    data = [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 3.0]), (4, [1.0, 2.5])]
    got = whitening.whiten(rows(data, SCHEMA)).collect()
    assert {r.deviation for r in got if r.vec_id < 3} == {None} and len({r.vec_id for r in got}) == 4


def test_copies_cost_one_row_a_task(rows):
    """A vector of a third of all rows leaves each map task once."""
    data = corpus(5, 60, 4) + [(9000 + k, [1.0] * 4) for k in range(3000)]
    plan = whitening.usable(rows(data, SCHEMA)).mapInArrow(whitening._named("x"), "digest binary, x binary") \
        .groupBy("digest", "x").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and "SortAggregate" not in plan
    assert whitening.distinct_vectors(rows(data, SCHEMA)).count() == 61
