"""Skewed joins, the topic lookup and the leak index."""

import random

import pytest
from pyspark.sql import functions as F

from gradewright.operators import evidence, joins, safety


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("unique", [True, False])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_split_join_equals_join(rows, unique, how):
    data = [(i, "hot" if i % 3 else f"k{i}") for i in range(300)] + [(900, None)]
    facts = [(k, f"f{k}", n) for k in ["hot", "unused", *(f"k{i}" for i in range(0, 300, 6))] for n in range(1 if unique else 3)]
    left, right = rows(data, "i INT, id STRING"), rows(facts, "id STRING, fact STRING, n INT")
    assert joins.hot_values(left, "id", 100) == ["hot"]
    got = joins.split_join(left, right, "id", how, unique, share=100)
    assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, "id", how).collect()))


def test_hot_keys_are_bounded(rows):
    assert joins.hot_values(rows([], "id STRING"), "id") == []
    assert joins.hot_values(rows([("a",)] * 5, "id STRING"), "id") == []  # too few rows to be hot
    assert len(joins.hot_values(rows([(str(i % 7),) for i in range(700)], "id STRING"), "id", 10)) == 7


def test_one_evidence_id_on_every_case_stays_out_of_the_shuffle(rows, monkeypatch):
    cases = rows([(i, ["EV-1", f"EV-{i % 40 + 2}"]) for i in range(2000)], "record_id INT, evidence_ids ARRAY<STRING>")
    index = rows([(f"EV-{k}", "public", f"t{k}", "p", "g") for k in range(50)],
                 "id STRING, kind STRING, title STRING, publisher STRING, guidance STRING")
    wanted = cases.select("record_id", F.posexplode("evidence_ids").alias("pos", "id"))
    hot = joins.hot_values(wanted, "id", 10)
    assert hot == ["EV-1"]
    cold = wanted.filter(~F.col("id").isin(hot)).groupBy("id").count().agg(F.max("count")).first()[0]
    assert cold <= 2000 / 40  # the largest group of the shuffled part
    monkeypatch.setattr(joins, "HOT_SHARE", 10)
    got = {r.record_id: [e["id"] for e in r.evidence] for r in evidence.attach_evidence(cases, index, "record_id").collect()}
    assert got == {i: ["EV-1", f"EV-{i % 40 + 2}"] for i in range(2000)}


TAGGED = "record_id INT, topics ARRAY<STRING>"
ITEMS = "pack INT, ord INT, id STRING, topics ARRAY<STRING>"


def test_evidence_lookup_equals_brute_force(rows):
    rng = random.Random(4)
    topics = ["a", "b", "c", 'd "x"', "none"]
    cases = [(i, rng.sample(topics, rng.randint(0, 4))) for i in range(60)] + [(60, None), (61, ["unknown"])]
    items = [(rng.randint(0, 1), rng.randint(0, 5), f"E{k}", rng.sample(topics[:4], rng.randint(0, 3))) for k in range(25)]
    want = {i: [e for _, _, e in sorted((p, o, e) for p, o, e, ts in items if set(ts) & set(own or []))] for i, own in cases}
    for most in (0, 10_000):
        got = evidence.select_evidence(rows(cases, TAGGED), rows(items, ITEMS), "record_id", most)
        assert {r.record_id: r.evidence_ids for r in got.collect()} == want


def test_evidence_lookup_has_no_exchange(rows):
    got = evidence.select_evidence(rows([(1, ["a"])], TAGGED), rows([(0, 0, "E", ["a"])], ITEMS), "record_id")
    assert "Exchange" not in plan(got) and "Join" not in plan(got)


DRAFTS = "k INT, draft STRING"


def leaks(rows, drafts, probes, literals=("###",)):
    found = safety.leaked_probes(rows(drafts, DRAFTS), rows([(p,) for p in probes], "probe STRING"), "k", "draft", 40, literals)
    return sorted(map(tuple, found.collect()))


def brute(drafts, probes, literals=("###",)):
    return sorted((k, p) for k, d in drafts for p in {*probes, *literals} if d and p in d and (len(p) >= 40 or p in literals))


@pytest.mark.parametrize("bound", [0, 1_000_000])
def test_no_leak_is_missed(rows, monkeypatch, bound):
    monkeypatch.setattr(safety, "BROADCAST_ROWS", bound)
    rng = random.Random(bound + 1)
    def text(n):
        return "".join(rng.choice("ab é\n") for _ in range(n))
    probes = sorted({text(rng.choice([40, 41, 45, 59, 60, 80, 133, 39])) for _ in range(60)})
    drafts = [(i, text(rng.randint(0, 50)) + rng.choice(probes) + text(rng.randint(0, 50))
               + (rng.choice(probes)[:-1] if i % 3 else "###")) for i in range(120)] + [(500, None), (501, "")]
    assert leaks(rows, drafts, probes) == brute(drafts, probes)


def test_a_sentence_in_every_draft_and_in_a_thousand_probes(rows):
    """Rows between the scan and the exact test stay at one per draft and hash: here 20 a draft at most."""
    rng = random.Random(9)
    common = "This exact sentence stands everywhere ok"
    assert len(common) == 40
    own = ["".join(rng.choice("xyzw ") for _ in range(44)) for _ in range(1000)]
    probes = [common, *(o + common for o in own)]
    drafts = [(i, "p" * (i % 23) + (own[i] if i % 10 == 0 else "") + common + " and more") for i in range(300)]
    index = safety.probe_index(rows([(p,) for p in probes], "probe STRING"), 20)
    blocks = rows(drafts, DRAFTS).select("k", F.explode(safety._blocks(F.col("draft"), 20)).alias("h"))
    met = blocks.join(index, "h")
    assert met.count() <= 20 * len(drafts) and met.agg(F.max(F.size("probes"))).first()[0] <= safety.MOST_PROBES
    assert sum(r[0] for r in met.select(F.size("probes")).collect()) <= 3 * len(drafts)  # rarest slices name few probes
    assert leaks(rows, drafts, probes) == brute(drafts, probes)


def test_only_blocks_that_name_a_probe_are_shuffled(rows):
    drafts = [(i, f"draft number {i} has nothing in common with any probe at all, whatever is read") for i in range(500)]
    probes = ["a protected sentence that no draft of this test repeats anywhere."]
    found = safety.leaked_probes(rows(drafts, DRAFTS), rows([(p,) for p in probes], "probe STRING"), "k", "draft")
    text = plan(found)
    scan = text[:text.index("Generate explode(concat")] if "Generate explode(concat" in text else text
    assert "BroadcastHashJoin [h" in scan and "LeftSemi" in text
    assert found.count() == 0
