"""N-gram Jaccard join by multiple global token orders.

Two documents link when their sets of 5-word shingles have Jaccard similarity 0.8 or
more. In any total order of all shingles, linked sets share a shingle among the first
n - ceil(0.8 n) + 1 of each (their prefixes). Several orders are used, each putting
shingles that many documents hold last; a pair must share a prefix shingle in all.

1. Documents with equal sets form a class (digest of the set); one stands for it.
2. Shingle counts, from packed blocks dealt to shards, tell which shingles are common.
3. First order: prefixes are dealt to shards as packed blocks. Short runs of a shared
   shingle give pairs (less those that sizes and places rule out), long runs their members.
   Parity sketches of whole sets, about a bit a shingle, bound how much two sets share and
   rule out most pairs before any set travels; long runs leave a spanning forest.
4. Connected candidates form clusters, so that each set travels once to where its
   candidates are; a cluster over BLOCK sets is dealt to tiles of two blocks.
5. There the candidates of all orders are intersected, survivors are verified on whole
   sets, and the links leave as spanning stars, never as all pairs.

No link is lost: orders only rank shingles, so wrong or missing counts cost time.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, components, join_by_key, mix, partitions, text_batches, written

WORDS = 5
NUM, DEN = 80, 100           # link if DEN * intersection >= NUM * union
ORDERS = 3
COMMON = 10                  # a shingle in so many documents is common, and last in every order
MOST_COMMON = 2_000_000      # common shingles told to the tasks (16 MB); above, COMMON doubles
RUN = 32                     # longest run of documents that is spelled out as pairs
SKETCH_BITS = 1 << 14        # bits of a sketch at most; of larger sets it rules out less
COMPARED = 1 << 30           # words of sketches compared in a long run, above that the rest stays together
BLOCK = 256                  # sets compared at a time
ITEMS = 1 << 20              # shingles packed at a time
PER_SHARD = 4_000_000        # shingles a shard task holds
BROADCAST_IDS = 1_000_000    # ids broadcast for the second reading, if there are no more (some 40 MB)
SEGMENT = 1 << 18             # bytes of a text whose words are hashed together
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
               0x85EBCA77C2B2AE63], np.uint64)
_LOW = np.uint64(0xFFFFFFFF)


# Byte values for word hashes, capitals A-Z as their small letters, and powers of an odd number.
_BYTES = mix(np.arange(256, dtype=np.uint64), 77)
_BYTES[65:91] = _BYTES[97:123]
_BLANK = np.isin(np.arange(256), list(SPACE))
_BASE = 0xD1342543DE82EF95
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(size: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, at least ``size`` of each."""
    if len(_powers[0]) < size:
        for i, x in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            with np.errstate(over="ignore"):
                _powers[i] = np.cumprod(np.r_[np.uint64(1), np.full(2 * size, x, np.uint64)])
    return _powers


def _segments(raw: bytes):
    """The text in pieces of about SEGMENT bytes that end at white space."""
    start = 0
    while start < len(raw):
        end = start + SEGMENT
        while end < len(raw) and raw[end] not in SPACE:
            end += 1
        yield raw[start:end]
        start = end


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and place of every word of a text, A-Z lower-cased.

    A word's polynomial is a difference of two running sums, brought to power zero; so
    all words of a piece are hashed together.
    """
    out, places, before = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for part in _segments(raw):
        b = np.frombuffer(part, np.uint8)
        blank = _BLANK[b]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        starts = edge[::2] if blank[0] else np.r_[0, edge[1::2]]
        ends = edge[1::2] if blank[0] else edge[::2]
        if len(ends) < len(starts):
            ends = np.r_[ends, len(b)]
        up, down = _power_tables(len(b))
        with np.errstate(over="ignore"):
            run = np.empty(len(b) + 1, np.uint64)
            run[0] = 0
            np.cumsum(_BYTES[b] * up[:len(b)], out=run[1:])
            out.append(mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64), 3))
        places.append(starts + before)
        before += len(b)
    return np.concatenate(out), np.concatenate(places)


def shingle_sets(texts):
    """Sorted distinct 64-bit shingle hashes of each whole text, A-Z lower-cased.

    Short texts are hashed together, SEGMENT bytes at a time.
    """
    group, size = [], 0
    for text in texts:
        raw = (text or "").encode()
        group.append(raw)
        size += len(raw)
        if size >= SEGMENT:
            yield from _group_sets(group)
            group, size = [], 0
    yield from _group_sets(group)


def _group_sets(raws: list[bytes]):
    w, places = word_hashes(b"\n".join(raws))
    first = np.searchsorted(places, np.cumsum([0, *(len(r) + 1 for r in raws)]))
    with np.errstate(over="ignore"):
        total = w[:max(0, len(w) - WORDS + 1)] * _K[0]
        for j in range(1, WORDS):
            total += w[j:j + len(total)] * _K[j]
        total = mix(total, WORDS)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            n = b - a
            if n >= WORDS:
                own = total[a:b - WORDS + 1]
                own.sort()
                yield own[np.r_[True, own[1:] != own[:-1]]]
            elif n:
                yield mix((w[a:b] * _K[:n]).sum(keepdims=True), 100 + n)
            else:
                yield w[:0]


def prefix_size(n):
    """Shingles of a set of n, one of which every linked set has in its own prefix."""
    return n - (NUM * n + DEN - 1) // DEN + 1


def sizes_fit(a, b):
    return DEN * np.minimum(a, b) >= NUM * np.maximum(a, b)


def linked(inter, a, b):
    return DEN * inter >= NUM * (a + b - inter)


class Order:
    """Total orders of shingles: common ones last, otherwise by a seeded hash."""

    def __init__(self, common: np.ndarray, shards: int) -> None:
        self.common, self.shards = np.sort(common), shards
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.common & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def keys(self, tokens: np.ndarray) -> np.ndarray:
        """Shard and low half of each shingle: what counts are kept by."""
        return (((tokens >> np.uint64(32)) % np.uint64(self.shards)) << np.uint64(32)) | (tokens & _LOW)

    def is_common(self, tokens: np.ndarray) -> np.ndarray:
        out = self.seen[(tokens & np.uint64((1 << 20) - 1)).astype(np.int64)]
        if out.any():
            at = np.flatnonzero(out)
            keys = self.keys(tokens[at])
            place = np.minimum(np.searchsorted(self.common, keys), len(self.common) - 1)
            out[at] = self.common[place] == keys
        return out

    def prefix(self, tokens: np.ndarray, number: int) -> np.ndarray:
        """The prefix of a set in the order of that number, in order."""
        size = prefix_size(len(tokens))
        rank = mix(tokens, 1000 + number) >> np.uint64(1)
        rank |= self.is_common(tokens).astype(np.uint64) << np.uint64(63)
        first = np.argpartition(rank, size - 1)[:size] if size < len(rank) else np.arange(len(rank))
        return tokens[first[np.argsort(rank[first], kind="stable")]]


def _digest(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def sketch(tokens: np.ndarray) -> bytes:
    """Parities of the numbers of shingles that fall on each bit; a power of two of bits.

    Two sets differ in at least as many shingles as their sketches do in bits. The halves of
    a sketch, one exclusive-or the other, are the sketch of half its size.
    """
    bits = min(SKETCH_BITS, max(64, 1 << (len(tokens) - 1).bit_length()))
    odd = np.bincount((mix(tokens, 5000) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _folded(sketches: np.ndarray) -> np.ndarray:
    half = sketches.shape[1] // 2
    return sketches[:, :half] ^ sketches[:, half:]


def _may_link(x: np.ndarray, y: np.ndarray, a, b) -> np.ndarray:
    """Whether sketches of one size leave it open that sets of sizes a and b link."""
    differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return sizes_fit(a, b) & linked((a + b - differ) // 2, a, b)


def _words(sketches) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)


def _open_pairs(batches):
    """Pairs (a, b, na, nb, sa, sb) that sizes and sketches leave open."""
    for batch in batches:
        na, nb = (batch[c].to_numpy() for c in ("na", "nb"))
        sa, sb = (np.array(batch[c].to_pylist(), object) for c in ("sa", "sb"))
        la, lb = (np.array([len(s) for s in side], np.int64) for side in (sa, sb))
        keep = np.zeros(len(na), bool)
        for p, q in set(zip(la.tolist(), lb.tolist())):
            if max(p, q) > 2 * min(p, q):
                continue  # sizes that fit are less than a power of two apart
            at = np.flatnonzero((la == p) & (lb == q))
            x, y = _words(sa[at]), _words(sb[at])
            x, y = _folded(x) if p > q else x, _folded(y) if q > p else y
            keep[at] = _may_link(x, y, na[at], nb[at])
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep))


def _run_forest(rows: pd.DataFrame) -> pd.DataFrame:
    """Members of a long run, joined where sizes and sketches leave a link open: spanning edges.

    Every member looks once at those not reached yet, so copies cost little. Beyond
    COMPARED words the rest of the run stays together.
    """
    rows = rows.drop_duplicates("b")
    names, n = [bytes(x) for x in rows["b"]], rows["n"].to_numpy(np.int64)
    size = np.array([len(s) for s in rows["sketch"]])
    held = rows["sketch"].to_numpy()
    levels = {}  # sketches of a size, and those of twice the size folded to it, by the members' places
    for level in np.unique(size).tolist():
        own, twice = np.flatnonzero(size == level), np.flatnonzero(size == 2 * level)
        levels[level] = np.r_[own, twice], np.concatenate(
            [_words(held[own]), *([_folded(_words(held[twice]))] if len(twice) else [])])
    new, edges, work = np.ones(len(n), bool), [], 0
    for start in range(len(n)):
        if not new[start]:
            continue
        new[start] = False
        queue = [start]
        while queue and new.any():
            if work > COMPARED:
                rest = np.flatnonzero(new).tolist()
                new[:] = False
                edges += [(start, k) for k in (*queue, *rest) if k != start]
                break
            i = queue.pop()
            level = int(size[i])
            for at in (level, level // 2):
                if at not in levels:
                    continue
                places, words = levels[at]
                row = np.flatnonzero(places == i)[0] if at == level else None
                mine = words[row:row + 1] if row is not None else _folded(_words([held[i]]))
                look = np.flatnonzero(new[places])
                work += len(look) * words.shape[1] + len(places) // 8
                hit = places[look[_may_link(words[look], mine, n[places[look]], n[i])]]
                new[hit] = False
                edges += [(i, k) for k in hit.tolist()]
                queue += hit.tolist()
    return pd.DataFrame({"a": [names[i] for i, _ in edges], "b": [names[k] for _, k in edges]})


def _set_rows(batches):
    for batch in batches:
        n, digests, sketches = [], [], []
        for s in shingle_sets(batch["text"].to_pylist()):
            n.append(len(s))
            digests.append(_digest(s) if len(s) else None)
            sketches.append(sketch(s) if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(digests, pa.binary()),
                                          pa.array(sketches, pa.binary())], ["doc_id", "n", "digest", "sketch"])


def _sets(batches):
    """Sets of a few documents at a time, each different set once: [(digest, tokens)]."""
    found, size = {}, 0
    for batch in batches:
        for s in shingle_sets(batch["text"].to_pylist()):
            if len(s):
                d = _digest(s)
                if d not in found:
                    found[d] = s
                    size += len(s)
            if size >= ITEMS:
                yield list(found.items())
                found, size = {}, 0
    if found:
        yield list(found.items())


def _cut(shard: np.ndarray):
    cuts = np.r_[0, np.flatnonzero(np.diff(shard)) + 1, len(shard)]
    return zip(shard[cuts[:-1]].tolist(), cuts[:-1], cuts[1:])


def _rows(shards: list[int], blocks: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(blocks, pa.binary())],
                                      ["shard", "block"])


def _count_blocks(shards: int):
    def pack(batches):
        for sets in _sets(batches):
            t = np.concatenate([s for _, s in sets])
            keys = ((t >> np.uint64(32)) % np.uint64(shards) << np.uint64(32)) | (t & _LOW)
            keys.sort()
            out = [(k, keys[a:b].astype("<u4").tobytes())
                   for k, a, b in _cut((keys >> np.uint64(32)).astype(np.int64))]
            yield _rows(*map(list, zip(*out)))
    return pack


def _count_shard(blocks: pd.DataFrame) -> pd.DataFrame:
    """Common keys of a shard with their counts."""
    keys = np.concatenate([np.frombuffer(b, "<u4") for b in blocks["block"]])
    keys.sort()
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    count = np.diff(np.r_[first, len(keys)])
    many = count >= COMMON
    full = (np.uint64(blocks["shard"].iloc[0]) << np.uint64(32)) | keys[first[many]].astype(np.uint64)
    level = np.log2(count[many] / COMMON).astype(np.int64)
    return pd.DataFrame({"level": np.arange(level.max(initial=-1) + 1)}).assign(
        keys=lambda d: [full[level == k].tobytes() for k in d["level"]])


def common_shingles(docs: DataFrame, shards: int) -> np.ndarray:
    """Keys of the shingles held by COMMON documents or more, or by a power of two times as
    many where they would be over MOST_COMMON."""
    table = written(docs.mapInArrow(_count_blocks(shards), "shard long, block binary")
                    .groupBy("shard").applyInPandas(_count_shard, "level long, keys binary"), "common")
    totals = {r["level"]: r["n"] for r in
              table.groupBy("level").agg(F.sum(F.octet_length("keys") / 8).alias("n")).collect()}
    least, total = max(totals, default=0) + 1, 0
    while least > 0 and total + totals.get(least - 1, 0) <= MOST_COMMON:
        least -= 1
        total += totals.get(least, 0)
    rows = table.filter(F.col("level") >= least).select("keys").collect()
    return np.frombuffer(b"".join(bytes(r["keys"]) for r in rows), np.uint64)


def _prefix_blocks(order, shards: int):
    def pack(batches):
        for sets in _sets(batches):
            parts = [order.value.prefix(s, 0) for _, s in sets]
            size = np.array([len(p) for p in parts])
            t = np.concatenate(parts)
            doc = np.repeat(np.arange(len(sets)), size)
            place = np.arange(len(t)) - np.repeat(np.cumsum(size) - size, size)
            n = np.array([len(s) for _, s in sets], np.int64)
            names = np.frombuffer(b"".join(d for d, _ in sets), "V16")
            shard = ((t >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
            by = np.argsort(shard, kind="stable")
            shard, t, doc, place = shard[by], (t[by] & _LOW).astype("<u4"), doc[by], place[by].astype("<u4")
            out = []
            for k, a, b in _cut(shard):
                docs, local = np.unique(doc[a:b], return_inverse=True)
                out.append((k, pickle.dumps((t[a:b].tobytes(), local.astype("<u4").tobytes(),
                                             place[a:b].tobytes(), names[docs].tobytes(),
                                             n[docs].tobytes()))))
            yield _rows(*map(list, zip(*out)))
    return pack


def _pairs(blocks: pd.DataFrame) -> pd.DataFrame:
    """Candidates of a shard: pairs (a, b) of short runs, rows (run, b) of each member of long ones.

    Runs of equal members have one name, here and in other shards, and come once.
    """
    tokens, docs, places, names, sizes, base = [], [], [], [], [], 0
    for raw in blocks["block"]:
        t, d, p, names_, n = pickle.loads(raw)
        tokens.append(np.frombuffer(t, "<u4"))
        docs.append(np.frombuffer(d, "<u4").astype(np.int64) + base)
        places.append(np.frombuffer(p, "<u4").astype(np.int64))
        names.append(np.frombuffer(names_, "V16"))
        sizes.append(np.frombuffer(n, np.int64))
        base += len(names[-1])
    t, d, p = map(np.concatenate, (tokens, docs, places))
    every, n = np.concatenate(names), np.concatenate(sizes)
    text = every.view(np.uint64).reshape(-1, 2)  # the same class may come in several blocks
    ranked = np.lexsort((text[:, 1], text[:, 0]))
    new = np.r_[True, (text[ranked[1:]] != text[ranked[:-1]]).any(axis=1)]
    klass = np.empty(len(every), np.int64)
    klass[ranked] = np.cumsum(new) - 1
    every, n = every[ranked[new]], n[ranked[new]]
    d = klass[d]
    by = np.lexsort((d, t))
    t, d, p = t[by], d[by], p[by]
    once = np.r_[True, (t[1:] != t[:-1]) | (d[1:] != d[:-1])]
    t, d, p = t[once], d[once], p[once]
    first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    length = np.diff(np.r_[first, len(t)])
    left, right, runs = [], [], {}
    for size in np.unique(length[length > 1]):
        start = first[length == size]
        if size > RUN:
            for s in start:  # classes are numbered in the order of their digests
                members = d[s:s + size]
                runs.setdefault(xxhash.xxh3_128_digest(every[members].tobytes()), members)
            continue
        i, j = np.triu_indices(size, 1)
        a, b = (start[:, None] + i).ravel(), (start[:, None] + j).ravel()
        x, y = d[a], d[b]
        # The shared shingle is first possible at these places: so many can still be shared.
        most = 1 + np.minimum(n[x] - p[a] - 1, n[y] - p[b] - 1)
        fit = sizes_fit(n[x], n[y]) & linked(most, n[x], n[y])
        left.append(x[fit])
        right.append(y[fit])
    names = [x.tobytes() for x in every]
    pair = (np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0) if left
            else np.zeros((0, 2), np.int64))
    rows = [(None, names[i], names[j]) for i, j in pair.tolist()]
    rows += [(run, None, names[j]) for run, members in runs.items() for j in members.tolist()]
    return pd.DataFrame(rows, columns=["run", "a", "b"])


def _candidates(found: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (a, b) that sizes and sketches leave open, connected like all open pairs of the runs."""
    facts = classes.select("digest", "n", "sketch")

    def told(rows: DataFrame, key: str, n: str, words: str) -> DataFrame:
        return rows.join(facts.withColumnsRenamed({"digest": key, "n": n, "sketch": words}), key)
    pairs = told(told(found.filter("run is null").select("a", "b"), "a", "na", "sa"), "b", "nb", "sb")
    open_ = pairs.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_open_pairs, "a binary, b binary")
    runs = told(found.filter("run is not null").select("run", "b"), "b", "n", "sketch")
    return open_.unionByName(runs.groupBy("run").applyInPandas(_run_forest, "a binary, b binary"))


def _token_sets(batches):
    """Rows whose text has the set of the class; another text of the same id is left to its own class."""
    for batch in batches:
        sets = list(shingle_sets(batch["text"].to_pylist()))
        own = pa.array([_digest(s) == d for s, d in zip(sets, batch["digest"].to_pylist())], pa.bool_())
        rows = pa.RecordBatch.from_arrays(
            [batch["digest"], batch["cluster"], batch["members"], pa.array([s.tobytes() for s in sets], pa.binary())],
            ["digest", "cluster", "members", "tokens"])
        yield rows.filter(own)


def _shared(left: list[np.ndarray], right: list[np.ndarray]):
    """Shingles on both sides: for each, its sets on the left and on the right, as incidences."""
    def flat(sets):
        return (np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
    lt, li = flat(left)
    rt, ri = flat(right)
    both = np.intersect1d(lt, rt)
    lp, rp = np.searchsorted(both, lt), np.searchsorted(both, rt)
    lk = both[np.minimum(lp, len(both) - 1)] == lt if len(both) else np.zeros(len(lt), bool)
    rk = both[np.minimum(rp, len(both) - 1)] == rt if len(both) else np.zeros(len(rt), bool)
    return len(both), (lp[lk], li[lk]), (rp[rk], ri[rk])


def _overlap(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Number of shingles each left set shares with each right set."""
    total = np.zeros((len(left), len(right)), np.float32)
    n, (lp, li), (rp, ri) = _shared(left, right)
    step = 4096
    lo, ro = np.argsort(lp, kind="stable"), np.argsort(rp, kind="stable")
    lp, li, rp, ri = lp[lo], li[lo], rp[ro], ri[ro]
    for a in range(0, n, step):  # dense strips of shared shingles keep memory fixed
        x = np.zeros((len(left), min(step, n - a)), np.float32)
        y = np.zeros((len(right), min(step, n - a)), np.float32)
        s, e = np.searchsorted(lp, (a, a + step))
        x[li[s:e], lp[s:e] - a] = 1
        s, e = np.searchsorted(rp, (a, a + step))
        y[ri[s:e], rp[s:e] - a] = 1
        total += x @ y.T
    return total


def find_links(left: list[np.ndarray], right: list[np.ndarray] | None, order: Order) -> np.ndarray:
    """Linked (i, j), all orders' candidates intersected before verification.

    Without ``right``, pairs i < j of the left sets.
    """
    other = left if right is None else right
    a = np.array([len(s) for s in left])[:, None]
    b = np.array([len(s) for s in other])[None, :]
    open_ = sizes_fit(a, b)
    if right is None:
        open_ &= np.triu(np.ones(open_.shape, bool), 1)
    for number in range(ORDERS):
        if not open_.any():
            return np.zeros((0, 2), np.int64)
        x = [order.prefix(s, number) for s in left]
        y = x if right is None else [order.prefix(s, number) for s in right]
        open_ &= _overlap(x, y) > 0
    pairs = np.argwhere(open_)
    if not len(pairs):
        return pairs
    if len(pairs) <= 64:
        inter = np.array([len(np.intersect1d(left[i], other[j], assume_unique=True)) for i, j in pairs])
    else:
        rows, cols = np.unique(pairs[:, 0]), np.unique(pairs[:, 1])
        part = _overlap([left[i] for i in rows], [other[j] for j in cols])
        inter = part[np.searchsorted(rows, pairs[:, 0]), np.searchsorted(cols, pairs[:, 1])].astype(np.int64)
    return pairs[linked(inter, a[pairs[:, 0], 0], b[0, pairs[:, 1]])]


def _stars(names: list[bytes], pairs: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Each linked name with the smallest name it is connected to."""
    parent = {i: i for i in set(pairs.ravel().tolist())}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in pairs.tolist():
        i, j = sorted((root(i), root(j)), key=lambda k: names[k])
        parent[j] = i
    return [(names[root(i)], names[i]) for i in parent if root(i) != i]


def _link_bucket(order):
    """Whole clusters, none over BLOCK sets."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in rows.drop_duplicates("digest").groupby("cluster", sort=False):  # rows may repeat
            names = [bytes(x) for x in part["digest"]]
            out += _stars(names, find_links([np.frombuffer(t, np.uint64) for t in part["tokens"]], None,
                                            order.value))
        return pd.DataFrame(out, columns=["a", "b"])
    return run


def _link_tile(order):
    """Two blocks of a large cluster, or one with itself."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sides, names = [], []
        for block in (rows["low"].iloc[0], rows["high"].iloc[0]):
            part = rows[rows["own"] == block].drop_duplicates("digest")
            sides.append([np.frombuffer(t, np.uint64) for t in part["tokens"]])
            names.append([bytes(x) for x in part["digest"]])
        if rows["low"].iloc[0] == rows["high"].iloc[0]:
            return pd.DataFrame(_stars(names[0], find_links(sides[0], None, order.value)), columns=["a", "b"])
        if not (sides[0] and sides[1]):
            return pd.DataFrame({"a": [], "b": []})
        pairs = find_links(sides[0], sides[1], order.value) + [0, len(names[0])]
        return pd.DataFrame(_stars(names[0] + names[1], pairs), columns=["a", "b"])
    return run


def similar_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    component_id is the smallest doc_id reachable over links, the document's own
    included. Words are runs of anything but ASCII white space; a text of fewer than
    WORDS words is one shingle; a null text or one without words has no shingle and no
    link. Documents with equal sets are linked. Repeated rows give repeated results; a
    null doc_id is never smallest unless all ids of its component are null. Other
    columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = written(texts.mapInArrow(_set_rows, "doc_id long, n long, digest binary, sketch binary"), "sets")
    classes = written(sets.filter("n > 0").groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.any_value("sketch").alias("sketch")), "classes")
    sets = sets.drop("sketch")
    items = classes.agg(F.sum("n")).first()[0] or 0
    shards = max(2 * partitions(spark), -(-items // PER_SHARD))
    whole = texts.select("text")
    order = spark.sparkContext.broadcast(Order(common_shingles(whole, shards), shards))
    found = written(whole.mapInArrow(_prefix_blocks(order, shards), "shard long, block binary")
                    .groupBy("shard").applyInPandas(_pairs, "run binary, a binary, b binary").distinct(), "candidates")
    edges = written(_candidates(found, classes), "open-candidates")
    clusters = written(components(edges).withColumnsRenamed({"node": "digest", "component": "cluster"}),
                       "clusters")
    # Written, so that it is counted map-side: next to the join, Spark would deal out all rows.
    sizes = written(clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("members")), "sizes")
    wanted = written(join_by_key(clusters, sizes, "cluster").join(classes.select("digest", "rep"), "digest"),
                     "wanted")
    few = wanted.count() <= BROADCAST_IDS
    chosen = wanted.select(F.col("rep").alias("doc_id"), "digest", "cluster", "members").filter("rep is not null")
    loaded = texts.join(F.broadcast(chosen) if few else chosen.hint("shuffle_hash"), "doc_id")
    # Ids may repeat with other texts; _token_sets keeps the rows with the digest of the class.
    tokens = written(loaded.mapInArrow(_token_sets, "digest binary, cluster binary, members long, tokens binary"),
                     "token-sets")
    small, large = tokens.filter(F.col("members") <= BLOCK), tokens.filter(F.col("members") > BLOCK)
    weight = tokens.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
    buckets = max(2 * partitions(spark), weight // (1 << 24))
    links = written(small.withColumn("bucket", F.pmod(F.xxhash64("cluster"), F.lit(buckets)))
                    .groupBy("bucket").applyInPandas(_link_bucket(order), "a binary, b binary"), "links")
    if large.limit(1).count():
        blocks = F.ceil(F.col("members") / (BLOCK // 2)).cast("long")
        tiles = (large.withColumn("own", F.pmod(F.xxhash64("digest"), blocks))
                 .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
                 .withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
                 .drop("other"))
        found = written(tiles.groupBy("cluster", "low", "high")
                        .applyInPandas(_link_tile(order), "a binary, b binary"), "tile-links")
        links = links.unionByName(components(found).select(F.col("component").alias("a"), F.col("node").alias("b"))
                                  .filter("a <> b"))
    # Each is used several times: written, or the last plan holds all of it that often.
    joined = written(classes.select("digest", "rep")
                     .join(links.select(F.col("b").alias("digest"), F.col("a").alias("root")), "digest", "left")
                     .withColumn("root", F.coalesce("root", "digest")), "joined")
    lowest = written(joined.groupBy("root").agg(F.min("rep").alias("component_id")), "lowest")
    facts = written(join_by_key(joined.select("digest", "root"), lowest, "root").select("digest", "component_id"),
                    "facts")
    marked = sets.withColumn("digest", F.coalesce("digest", F.unhex(F.concat(F.lit("00"), F.hex("doc_id")))))
    return (join_by_key(marked, facts, "digest", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.coalesce("component_id", "doc_id").alias("component_id")))
