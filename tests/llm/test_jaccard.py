import random

import numpy as np
import pytest

from gradewright.llm import jaccard

SCHEMA = "doc_id long, text string"


def words(text):
    return (text or "").encode().lower().split()


def brute(data):
    sets = []
    for _, t in data:
        w = words(t)
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(data)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(data)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    low = {}
    for k, (i, _) in enumerate(data):
        low[root(k)] = min(low.get(root(k), i), i)
    return sorted((i, len(sets[k]), low[root(k)]) for k, (i, _) in enumerate(data))


def check(rows, data):
    got = jaccard.similar_components(rows(data, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == brute(data)


def corpus(seed, docs, base=6, edits=4):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    bases = [[r.choice(vocab) for _ in range(r.randint(20, 160))] for _ in range(base)]
    boiler = [r.choice(vocab) for _ in range(40)]
    data = []
    for i in range(docs):
        w = list(r.choice(bases))
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = r.choice(vocab)
        if r.random() < .3:
            w = w[:r.randint(1, len(w))] + boiler
        data.append((i * 3 + 1, " ".join(w)))
    return data


def test_matches_brute_force(rows):
    check(rows, corpus(1, 120))


def test_edges(rows):
    check(rows, [(9, "a b c d e"), (3, "A B\tc D\n e"), (5, None), (6, ""), (7, " \n"), (8, "one"), (2, "ONE"), (10, "one two"),
                 (11, "one two"), (12, "one two three four"), (13, "x " * 30_000), (14, "x x x x x"), (15, "à b c d e"), (16, "À b c d e")])


def test_large_groups_and_tiles(rows, monkeypatch):
    monkeypatch.setattr(jaccard, "RUN", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    check(rows, corpus(2, 150, base=2, edits=6))


def test_small_blocks_and_no_common_shingles(rows, monkeypatch):
    monkeypatch.setattr(jaccard, "MOST_COMMON", 0)
    monkeypatch.setattr(jaccard, "ITEMS", 500)
    check(rows, corpus(3, 60))


def test_empty_repeated_rows_null_ids_and_clashing_columns(rows):
    assert jaccard.similar_components(rows([], SCHEMA)).count() == 0
    data = [(4, "a b c d e f", "x", 1), (4, "a b c d e f", "x", 2), (None, "a b c d e f", "x", 3), (None, None, "x", 4)]
    got = jaccard.similar_components(rows(data, "doc_id long, text string, digest string, n int")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(4, 2, 4), (4, 2, 4), (None, 2, 4), (None, 0, None)]))


@pytest.mark.parametrize("segment", [1 << 18, 7, 1])
def test_word_hashes_name_words(monkeypatch, segment):
    monkeypatch.setattr(jaccard, "SEGMENT", segment)
    for text in ["", " ", "a", " a", "a ", "Ab\tcD\n\n ef  gh", "\x0bx\x0cy", "é É ß", "a" * 50, "to be or not To BE", "\x1ca b"]:
        want = words(text)
        got = jaccard.word_hashes(text.encode())[0].tolist()
        assert len(got) == len(want)
        assert len({(a, b) for a, b in zip(want, got)}) == len(set(want)) == len(set(got))


def test_sets_do_not_depend_on_grouping(monkeypatch):
    texts = [t for _, t in corpus(7, 40)] + ["", None, "one", "a b c d", " ", "a b c d e"]
    alone = [next(jaccard.shingle_sets([t])) for t in texts]
    for segment in (1, 300, 1 << 18):
        monkeypatch.setattr(jaccard, "SEGMENT", segment)
        assert [s.tolist() for s in jaccard.shingle_sets(texts)] == [s.tolist() for s in alone]
    assert [len(s) for s in alone[-6:]] == [0, 0, 1, 1, 0, 1]


@pytest.mark.parametrize("n", range(1, 60))
def test_prefix_is_long_enough(n):
    need = -(-80 * n // 100)
    assert jaccard.prefix_size(n) == n - need + 1 >= 1


def test_every_order_keeps_links(rows):
    r = np.random.default_rng(4)
    order = jaccard.Order(np.zeros(0, np.uint64), 8)
    for _ in range(200):
        a = np.unique(r.integers(0, 1 << 40, 50).astype(np.uint64))
        b = np.unique(np.r_[a[:r.integers(35, 50)], r.integers(0, 1 << 40, r.integers(0, 12)).astype(np.uint64)])
        if jaccard.linked(len(np.intersect1d(a, b)), len(a), len(b)):
            for k in range(jaccard.ORDERS):
                assert len(np.intersect1d(order.prefix(a, k), order.prefix(b, k)))


def test_one_id_on_two_texts(rows, monkeypatch):
    r = random.Random(7)
    base = [f"v{r.randrange(10 ** 6)}" for _ in range(200)]

    def edited(words, *places):
        return [f"e{i}" if i in places else w for i, w in enumerate(words)]
    other = base[:160] + [f"o{i}" for i in range(40)]  # shares two thirds with the base: a candidate, no link
    data = [(i, " ".join(w)) for i, w in ((0, edited(base, 190)), (1, base), (1, other), (5, edited(other, 10)), (1, base), (7, edited(base, 3)))]
    check(rows, data)
    monkeypatch.setattr(jaccard, "BLOCK", 2)
    check(rows, data)


def test_sketches_lose_no_link():
    r = np.random.default_rng(5)
    for n in (1, 3, 60, 64, 65, 130, 1000, 40_000):
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        for drop in {0, n // 10, n // 5, n // 2}:
            for add in {0, n // 20, n // 8}:
                b = np.unique(np.r_[a[drop:], r.integers(0, 1 << 63, add).astype(np.uint64)])
                if not len(b):
                    continue
                x, y = (jaccard._words([jaccard.sketch(s)]) for s in (a, b))
                if max(x.shape[1], y.shape[1]) > 2 * min(x.shape[1], y.shape[1]):
                    assert not jaccard.sizes_fit(len(a), len(b))
                    continue
                x, y = (jaccard._folded(s) if s.shape[1] > min(x.shape[1], y.shape[1]) else s for s in (x, y))
                assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
                if jaccard.linked(len(np.intersect1d(a, b)), len(a), len(b)):
                    assert jaccard._may_link(x, y, np.array([len(a)]), np.array([len(b)])).all()


@pytest.mark.parametrize("compared", [1 << 30, -1])
def test_long_runs_stay_connected_where_sets_link(monkeypatch, compared):
    monkeypatch.setattr(jaccard, "COMPARED", compared)
    sets = [s for s in jaccard.shingle_sets([t for _, t in corpus(11, 120)]) if len(s)]
    sets = list({jaccard._digest(s): s for s in sets}.values())
    rows = jaccard.pd.DataFrame({"b": [jaccard._digest(s) for s in sets], "n": [len(s) for s in sets],
                                 "sketch": [jaccard.sketch(s) for s in sets]})
    edges = jaccard._run_forest(rows)
    assert len(edges) < len(sets)
    root = {x: x for x in rows["b"]}
    for a, b in zip(edges["a"], edges["b"]):
        old, new = root[b], root[a]
        root = {k: new if v == old else v for k, v in root.items()}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if jaccard.linked(len(np.intersect1d(a, b)), len(a), len(b)):
                assert root[rows["b"][i]] == root[rows["b"][j]]
    assert (len(set(root.values())) > 1) == (compared > 0)


def test_unlike_sets_with_a_common_passage_do_not_travel(rows, monkeypatch):
    r, kept = random.Random(9), {}
    passage = [f"p{i}" for i in range(25)]
    data = [(i, " ".join(passage + [f"u{r.randrange(10 ** 9)}" for _ in range(12 + i % 5)])) for i in range(80)]
    data.append((100, data[0][1] + " tail"))
    write = jaccard.written

    def noted(frame, purpose):
        out = kept[purpose] = write(frame, purpose)
        return out
    monkeypatch.setattr(jaccard, "written", noted)
    check(rows, data)
    assert kept["token-sets"].count() == 2


def test_the_last_plan_reads_each_written_step_a_few_times(rows, monkeypatch):
    """Unwritten steps that are used twice each multiply: the driver then plans all of them many times over."""
    monkeypatch.setattr(jaccard, "RUN", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    plan = jaccard.similar_components(rows(corpus(2, 150, base=2, edits=6), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 8
