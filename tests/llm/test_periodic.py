import hashlib
import random
import zlib

import pytest

from gradewright.llm import periodic, queries, words

SCHEMA = "doc_id long, text string"


def brute_runs(w):
    """Every maximal stretch of every period that no smaller period also has."""
    found = []
    n = len(w)
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if length >= max(6, 4 * q):
                part = w[start:start + length]
                if not any(all(part[k] == part[k - d] for k in range(d, length)) for d in range(1, q)):
                    found.append((start, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text, loop=True):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if loop and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(w)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())


def periodic_text(r):
    out = []
    for _ in range(r.randint(0, 6)):
        block = [r.choice("abc") if r.random() < .7 else f"w{r.randrange(50)}" for _ in range(r.randint(1, 14))]
        if r.random() < .5:  # a period made of repeats itself
            block = block * r.randint(1, 4) + block[:r.randrange(len(block))]
        out += block * r.randint(1, 9) + block[:r.randrange(len(block) + 1)]
    return out


@pytest.mark.parametrize("seed", range(12))
def test_runs_match_brute_force(seed, monkeypatch):
    r = random.Random(seed)
    texts = [periodic_text(r) for _ in range(40)] + [[r.choice("ab") for _ in range(r.randint(0, 300))] for _ in range(40)]
    raws = [" ".join(t).encode() for t in texts]
    want = [brute_runs(t) for t in texts]
    got = []
    for group in words.groups(raws):
        got += periodic.runs_of(group)[0]
    assert got == want
    assert [periodic.runs_of([raw])[0][0] for raw in raws] == want


def test_structured_words():
    """Words with very many overlapping runs: powers, Fibonacci and Thue-Morse-like texts."""
    fib, other = ["a"], ["a", "b"]
    while len(other) < 600:
        fib, other = other, other + fib
    cube = ["a"]
    for k in range(6):
        cube = cube * 4 + [f"s{k}"] if k % 2 else cube * 5
    for text in (other, cube[:900], ["x"] * 500, (["x"] * 40 + ["y"]) * 9, ["a", "b", "a"] * 3 + ["a", "b"] * 30):
        assert periodic.runs_of([" ".join(text).encode()])[0][0] == brute_runs(text)


def test_hot_words_cost_one_match_each():
    raw = b"the " * 200_000
    assert periodic.runs_of([raw])[0][0] == [(0, 200_000, 1)]
    w, first = words.word_table([raw])
    assert sum(len(m[0]) for m in periodic._matches(w, first)) <= 2 * 200_000


def corpus(seed, docs):
    r = random.Random(seed)
    return [(i, " ".join(periodic_text(r) if i % 3 else [f"w{r.randrange(400)}" for _ in range(r.randint(0, 200))]))
            for i in range(docs)]


def test_query_matches_brute_force(spark, rows, tmp_path):
    data = corpus(3, 300) + [(7, None), (7, ""), (None, "a " * 9), (8, " \n\t\x0b"), (9, "é É " * 20 + "\x1c a\x1ca"),
                             (9, "é É " * 20 + "\x1c a\x1ca"), (10, "a b " * 7), (11, "x" * 5000), (-3, "a b " * 6)]
    rows(data, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.queries()["op11_periodic_runs"](spark, str(tmp_path))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(brute_row(*d)) for d in data)


def test_edges(rows):
    assert periodic.find_runs(rows([], SCHEMA)).count() == 0
    data = [(1, None, 5), (2, "a b a b a b a b c", 6), (None, "", 7)]
    got = periodic.find_runs(rows(data, "doc_id long, text string, runs int")).collect()
    assert {(r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in got} == {
        (1, 0, (), ""), (2, 9, ((0, 8, 2),), "a b c"), (None, 0, (), "")}


@pytest.mark.parametrize("segment", [1, 50, 1 << 18])
def test_word_table(monkeypatch, segment):
    monkeypatch.setattr(words, "SEGMENT", segment)
    texts = ["", " ", "a", " a", "a ", "Ab\tcD\n\n ef  gh", "\x0bx\x0cy", "é É ß", "a" * 50, "to be to be", "\x1ca b", "ab ba",
             "x" * 9000, "x" * 4095 + "y" + "x" * 4904, "x" * 8191 + "y" + "x" * 808, "x" * 9001]
    names = {}
    for group in words.groups([t.encode() for t in texts]):
        hashes, first = words.word_table(group)
        for k, raw in enumerate(group):
            own = hashes[first[k]:first[k + 1]].tolist()
            assert len(own) == len(raw.split())
            for word, name in zip(raw.split(), own):
                assert names.setdefault(word, name) == name
    assert len(set(names.values())) == len(names)
