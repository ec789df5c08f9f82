import hashlib
import math

import pytest

from gradewright.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def count(doc_id, rate, seed=mixing.SEED):
    parts = max(1, math.ceil(rate / mixing.PART_RATE))
    total = 0
    for part in range(1, parts + 1):
        u = int(hashlib.md5(f"{seed}:{'null' if doc_id is None else doc_id}:{part}".encode()).hexdigest()[:13], 16) / 2 ** 52
        p = cdf = math.exp(-rate / parts)
        k = 0
        while cdf <= u and k < mixing.TERMS:
            k += 1
            p *= rate / parts / k
            cdf += p
        total += k
    return total


def brute(data, weights=None):
    chars = {}
    for _, t, s in data:
        chars[s] = chars.get(s, 0) + len(t or "")
    w = {s: (math.sqrt(c) if weights is None else weights.get(s, 0.0)) for s, c in chars.items()}
    share = sum(w[s] for s in w if chars[s])
    rate = {s: 1.0 if not chars[s] else sum(chars.values()) * w[s] / share / chars[s] for s in chars}
    return sorted(str((i, s, c)) for i, _, s in data for c in range(1, count(i, rate[s]) + 1))


def data():
    return ([(i, "x" * (i % 90), "big") for i in range(900)] + [(i, "y" * 50, "small") for i in range(900, 950)]
            + [(950, "z", "tiny"), (951, None, "void"), (None, "q" * 30, "small"), (952, "n" * 40, None), (7, "x" * 7, "big")])


def test_counts_match_brute_force(rows):
    got = mixing.mix(rows(data(), SCHEMA)).collect()
    assert sorted(str((r.doc_id, r.source, r.copy)) for r in got) == brute(data())
    texts = {(r.doc_id, r.source, r.text) for r in got}
    assert texts <= set((i, s, t) for i, t, s in data())


def test_given_weights_and_large_rates(rows):
    weights = {"big": 1.0, "small": 1.0, "tiny": 5.0}
    w = rows(list(weights.items()), "source string, weight double")
    got = mixing.mix(rows(data(), SCHEMA), w).collect()
    assert sorted(str((r.doc_id, r.source, r.copy)) for r in got) == brute(data(), weights)
    size = {s: sum(len(r.text or "") for r in got if r.source == s) for s in weights}
    assert size["big"] == pytest.approx(size["small"], rel=0.25)


def test_many_sources_without_broadcast(rows, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    got = mixing.mix(rows(data(), SCHEMA)).collect()
    assert sorted(str((r.doc_id, r.source, r.copy)) for r in got) == brute(data())


def test_order_is_global_and_repeatable(spark, rows):
    from pyspark.sql import functions as F
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    mixed = mixing.mix(rows(data(), SCHEMA)).withColumn("part", F.spark_partition_id())
    a, b = ([(r.part, r.shuffle_key, r.doc_id, r.copy) for r in mixed.collect()] for _ in range(2))
    assert a == b and a == sorted(a, key=lambda r: r[:2])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r[0] for r in a if r[2] is not None and r[2] < 100}) > 1


def test_edges(rows):
    assert mixing.mix(rows([], SCHEMA)).count() == 0
    got = mixing.mix(rows([(1, "t", "s", 9, 8.0)], SCHEMA + ", copy int, rate double"))
    assert got.columns == ["doc_id", "text", "source", "rate", "copy", "shuffle_key"]
    got.collect()


def test_no_python_on_the_path(rows):
    plan = mixing.mix(rows(data(), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
