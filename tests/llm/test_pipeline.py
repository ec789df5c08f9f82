import test_jaccard
import test_line_dedup
import test_mixing

import corpus_pipeline as cp
from gradewright.llm import quality_rules
from gradewright.llm.common import written

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain(frame):
    return [(r.doc_id, r.text) for r in frame.collect()]


def test_every_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(cp.STAGES)
    assert len(cp.STAGES) == 5 and list(stages) == [n for n, _ in cp.STAGES]
    frames = [docs]
    for name, stage in cp.STAGES:
        frames.append(written(stage(spark, frames[-1], SF), "test-stage"))
        if name != cp.STAGES[-1][0]:
            assert frames[-1].columns == docs.columns
    # 1: base rules and model verdict
    model = quality_rules.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    cache = quality_rules._Words()
    want = []
    for i, t in plain(docs):
        n, _, _, _, repeated = quality_rules.base_counts(t)
        if n >= 50 and 100 * repeated <= 50 * n and model.probability(t, cache) >= quality_rules.KEEP_AT:
            want.append((i, t))
    assert sorted(plain(frames[1])) == sorted(want) and 100 < len(want) < 200
    # 2: lines
    want = sorted((i, t) for i, t, _, _ in test_line_dedup.brute(want))
    assert sorted(plain(frames[2])) == want
    assert all(r.n_chars == len(r.text) for r in frames[2].collect())
    # 3: one of each group
    low = {i: c for i, _, c in test_jaccard.brute(want)}
    want = [(i, t) for i, t in want if low[i] == i]
    assert sorted(plain(frames[3])) == sorted(want)
    # 4: counts
    third = [(r.doc_id, r.text, r.source) for r in frames[3].collect()]
    got = sorted((r.doc_id, r.source) for r in frames[4].collect())
    drawn = test_mixing.brute(third)
    assert len(got) == len(drawn)
    assert sorted(map(str, got)) == sorted(x.rsplit(",", 1)[0] + ")" for x in drawn)
    # 5: pieces
    last = frames[5].collect()
    assert sorted((r.doc_id, r.text) for r in last) == sorted(plain(frames[4]))
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) and (r.n_tokens > 0) == (r.text != "") for r in last)


def test_stages_take_edge_rows(rows):
    good = " ".join(f"word{i} other{i % 7}" for i in range(60))
    data = [(1, good, "en", "s", 0), (1, good, "en", "s", 0), (2, None, None, None, None), (None, good + " x", "en", None, 1),
            (3, "", "en", "s", 0)]
    docs = rows(data, SCHEMA)
    for name, stage in cp.STAGES[1:]:
        out = stage(docs.sparkSession, docs, SF)
        assert out.count() >= 0
    near = cp.join_near_duplicates(docs.sparkSession, docs, SF)
    assert sorted(str(r.doc_id) for r in near.collect()) == ["1", "2", "3", "None"]
    empty = rows([], SCHEMA)
    for name, stage in cp.STAGES:
        assert stage(docs.sparkSession, empty, SF).count() == 0
