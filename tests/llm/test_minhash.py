import random

import numpy as np
import pytest

from gradewright.llm import minhash
from gradewright.llm.jaccard import shingle_sets

SCHEMA = "doc_id long, text string"


def brute(data):
    """Rows of the operator, from all pairs of word-shingle sets."""
    sets = []
    for _, text in data:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(data)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and label[i] != label[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                old = label[i]
                label = [label[j] if x == old else x for x in label]
    low = {}
    for x, (i, _) in zip(label, data):
        low[x] = min(low.get(x, i), i)
    return sorted((i, len(s), low[x], i == low[x]) for (i, _), s, x in zip(data, sets, label))


def check(rows, data):
    got = sorted(map(tuple, minhash.near_duplicates(rows(data, SCHEMA)).collect()))
    assert got == brute(data)
    return got


def corpus(seed, docs, bases=5, edits=6, words=(20, 200)):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts = [[r.choice(vocab) for _ in range(r.randint(*words))] for _ in range(bases)]
    boiler = [r.choice(vocab) for _ in range(30)]
    data = []
    for i in range(docs):
        w = list(r.choice(texts))
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = r.choice(vocab)
        if r.random() < .3:
            w = w[:r.randint(1, len(w))] + boiler
        data.append((3 * i + 2, " ".join(w)))
    return data


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(rows, seed):
    got = check(rows, corpus(seed, 150))
    assert 10 < sum(not r[3] for r in got) < 140


def test_edges(rows):
    check(rows, [(9, "a b c d e"), (3, "A B\tc D\n e"), (5, None), (6, ""), (7, " \n"), (8, "one"), (2, "ONE"),
                 (10, "one two"), (11, "one two"), (12, "one two three four"), (13, "x " * 30_000), (14, "x x x x x"),
                 (15, "à b c d e"), (16, "À b c d e")])


def test_tiles_strips_and_small_blocks(rows, monkeypatch):
    for name, value in (("BLOCK", 16), ("STRIP", 5), ("HUBS", 1), ("KEYS", 2000), ("TOGETHER", 300), ("BROADCAST_IDS", 0)):
        monkeypatch.setattr(minhash, name, value)
    check(rows, corpus(3, 160, bases=2))


def test_hot_group_leaves_few_rows_per_task(rows):
    """A third of all classes are near copies: a task sends a few of each table entry, and finds all links."""
    r = random.Random(5)
    base = [f"b{k}" for k in range(300)]
    data = [(i, " ".join(base[:k] + [f"e{i}"] + base[k + 1:])) for i, k in ((i, r.randrange(300)) for i in range(120))]
    data += [(1000 + i, " ".join(f"v{r.randrange(10 ** 6)}" for _ in range(60))) for i in range(240)]
    texts = [t for _, t in data]
    n, names, mins = zip(*minhash.described(texts))
    h = minhash.hashes(np.frombuffer(b"".join(mins), "<u4").reshape(len(n), -1))
    key = minhash.table_keys(h).ravel()
    size = np.repeat(np.array(n), minhash.SIDE ** 2)
    order = np.lexsort((size, key))
    keep = minhash._thin(key[order], size[order])
    hot = key[order][keep]
    assert np.unique(hot, return_counts=True)[1].max() <= 2
    check(rows, data)


@pytest.mark.parametrize("seed", range(20))
def test_thinned_chains_stay_connected(seed):
    """Whatever else joins an entry later, the same members are connected as without thinning."""
    r = np.random.default_rng(seed)
    ours = np.sort(r.integers(1, 60, 25))
    others = np.sort(r.integers(1, 60, 6))
    key = np.zeros(len(ours), np.uint64)
    keep = minhash._thin(key, ours)

    def groups(sizes, edges):
        label = np.arange(len(sizes))
        for a, b in edges:
            label[label == label[a]] = label[b]
        return {frozenset(np.flatnonzero(label == x).tolist()) for x in label}
    every = np.r_[ours, others]
    order = np.argsort(every, kind="stable")
    want = [(order[k - 1], order[k]) for k in range(1, len(every)) if minhash.sizes_fit(every[order[k]], every[order[k - 1]])]
    local = [(k - 1, k) for k in range(1, len(ours)) if minhash.sizes_fit(ours[k], ours[k - 1])]
    here = np.r_[np.flatnonzero(keep), len(ours) + np.arange(len(others))]
    by = here[np.argsort(every[here], kind="stable")]
    later = [(by[k - 1], by[k]) for k in range(1, len(by)) if minhash.sizes_fit(every[by[k]], every[by[k - 1]])]
    assert groups(every, local + later) == groups(every, want)


def test_links_meet_in_a_table():
    """Sets of similarity 0.85 meet; unlike sets seldom do."""
    r = np.random.default_rng(2)
    met = unlike = 0
    for _ in range(300):
        shared = r.integers(0, 1 << 62, 170).astype(np.uint64)
        a, b = (np.unique(np.r_[shared, r.integers(0, 1 << 62, 15).astype(np.uint64)]) for _ in range(2))
        c = np.unique(np.r_[shared[:10], r.integers(0, 1 << 62, 175).astype(np.uint64)])
        h = minhash.hashes(minhash.signature(np.concatenate([a, b, c]), np.cumsum([0, len(a), len(b)])))
        assert (np.intersect1d(*minhash.table_keys(h[:2])).size > 0) == minhash.meet(h[:1], h[1:2])[0, 0]
        met += bool(minhash.meet(h[:1], h[1:2])[0, 0])
        unlike += bool(minhash.meet(h[:1], h[2:])[0, 0])
    assert met == 300 and unlike < 10


def test_minhashes_estimate_similarity():
    r = np.random.default_rng(1)
    pool = r.integers(0, 1 << 62, 300).astype(np.uint64)
    same = []
    for _ in range(60):
        a, b = np.sort(pool[:200]), np.sort(pool[100:])
        pool = r.integers(0, 1 << 62, 300).astype(np.uint64)
        m = minhash.signature(np.r_[a, b], np.array([0, 200]))
        same.append((m[0] == m[1]).mean())
    assert abs(np.mean(same) - 1 / 3) < .04  # 100 shared of 300


def test_empty_repeated_rows_null_ids_and_clashing_columns(rows):
    assert minhash.near_duplicates(rows([], SCHEMA)).count() == 0
    data = [(4, "a b c d e f", "x", 1), (4, "a b c d e f", "x", 2), (None, "a b c d e f", "x", 3), (None, None, "x", 4),
            (None, "p q r", "x", 4)]
    got = minhash.near_duplicates(rows(data, "doc_id long, text string, digest string, n int")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [
        (4, 2, 4, True), (4, 2, 4, True), (None, 2, 4, False), (None, 0, None, True), (None, 1, None, True)]))


def test_one_id_on_two_texts(rows):
    r = random.Random(7)
    base = [f"v{r.randrange(10 ** 6)}" for _ in range(200)]

    def edited(words, *places):
        return [f"e{i}" if i in places else w for i, w in enumerate(words)]
    other = base[:160] + [f"o{i}" for i in range(40)]
    check(rows, [(i, " ".join(w)) for i, w in (
        (0, edited(base, 190)), (1, base), (1, other), (5, edited(other, 10)), (1, base), (7, edited(base, 3)))])


def test_descriptions_do_not_depend_on_grouping(monkeypatch):
    texts = [t for _, t in corpus(7, 30)] + ["", None, "one", " "]
    alone = [next(minhash.described([t])) for t in texts]
    assert [len(s) for s in shingle_sets(texts)] == [d[0] for d in alone]
    for held in (1, 500, 1 << 15):
        monkeypatch.setattr(minhash, "TOGETHER", held)
        assert list(minhash.described(texts)) == alone


def test_the_last_plan_reads_each_written_step_a_few_times(rows):
    plan = minhash.near_duplicates(rows(corpus(3, 160, bases=2), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 8
