import pickle
import random

import numpy as np
from pyspark.sql import functions as F

from gradewright.llm import line_dedup

SPACE = " \t\n\r\x0b\x0c"
SCHEMA = "doc_id long, text string"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(data):
    held = {}
    for i, t in data:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                held.setdefault(key(line), set()).add(i)
    out = []
    for i, t in data:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (i is not None and len(held.get(key(x), ())) > 1 and i != min(held[key(x)]))]
        out.append((i, None if t is None and len(kept) == 1 else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def check(rows, data):
    got = line_dedup.drop_repeated_lines(rows(data, SCHEMA)).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, brute(data)))


def test_matches_brute_force(rows):
    r = random.Random(3)
    pool = [f"shared line number {i}" for i in range(30)] + ["short", "", "  ", "ünïcodeline", "ÄÖÜ äöü ß", "\tShared Line number 3 "]
    check(rows, [(i, "\n".join(r.choice(pool) if r.random() < .6 else f"own {i} {j} text" for j in range(r.randint(0, 12))))
                 for i in range(80)])


def test_edges(rows):
    same = "the very same line"
    check(rows, [(5, same), (3, f"{same}\n{same}\nx"), (9, f"a\n {same.upper()}\t\nb\n"), (1, None), (2, ""),
                 (4, "\n\n"), (7, same), (7, same), (None, same), (10, same + "\n" + "z" * 200_000)])


def test_within_one_document_lines_stay(rows):
    check(rows, [(1, "only here, twice\nonly here, twice"), (2, "something else")])


def test_empty_and_clashing_columns(rows):
    assert line_dedup.drop_repeated_lines(rows([], SCHEMA)).count() == 0
    data = [(1, "a line of some length", "p", 7), (2, "a line of some length", "q", 8)]
    got = line_dedup.drop_repeated_lines(rows(data, "doc_id long, text string, tag string, n_lines int"))
    assert sorted((r.doc_id, r.text, r.tag, r.n_lines, r.n_dropped) for r in got.collect()) == [
        (1, "a line of some length", "p", 1, 0), (2, "", "q", 1, 1)]


def test_perfect_hash_is_minimal_and_survives_equal_halves():
    r = np.random.default_rng(1)
    hi, lo = (r.integers(0, 1 << 63, 20_000).astype(np.uint64) for _ in range(2))
    hi[:50] = hi[0]
    table = line_dedup.PerfectHash(hi, lo)
    assert sorted(table.index(hi, lo).tolist()) == list(range(20_000))
    assert table.n == 20_000 and len(table.bits) * 8 < 20_000 * 8
    none = line_dedup.PerfectHash(hi[:0], lo[:0])
    assert none.index(hi[:3], lo[:3]).tolist() == [-1, -1, -1]


def test_line_in_a_third_of_all_documents_is_spread(spark, rows, monkeypatch):
    monkeypatch.setattr(line_dedup, "LINES_PER_BLOCK", 64)
    data = [(i, "a line that very many hold" if i % 3 == 0 else f"own line of document {i}")
            for i in range(6000)]
    base = rows(data, SCHEMA).withColumn("tag", F.lit(0).cast("long")).repartition(8)
    seen = []
    whole = line_dedup.line_arrays(base)
    monkeypatch.setattr(line_dedup, "line_arrays", lambda docs: whole)
    keep = line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda f, name: seen.append(keep(f, name)) or seen[-1])
    drops = line_dedup.line_drops(base, per_group=256).collect()
    assert sorted(r.doc_id for r in drops) == list(range(3, 6000, 3))
    lines = {}
    for r in seen[-1].collect():
        lines[r.shard, r.salt] = lines.get((r.shard, r.salt), 0) + len(pickle.loads(r.block)[2])
    hot = [n for n in lines.values() if n > 2000 / 16]
    assert sum(lines.values()) == 6000 and max(lines.values()) < 1200 and len(hot) >= 4


def test_counts_are_of_documents(rows):
    base = rows([(1, "the very first line"), (1, "the very first line"), (2, "a second line here"),
                 (3, "A second line here")], SCHEMA).withColumn("tag", F.lit(0).cast("long")).repartition(4)
    arrays, shards, total = line_dedup.line_arrays(base)
    counts = [c for r in arrays.collect() for c in pickle.loads(r.arrays)[2].tolist()]
    assert sorted(counts) == [1, 2] and total == 4
