"""Near duplicates by MinHash with tensored banding; every link is verified on whole sets.

Plain banding with T tables of K minhashes each computes T * K of them. Here two small
collections of SIDE hashes are computed, each hash being PART minhashes, and table
(i, j) is keyed by hash i of the first and hash j of the second collection together:
SIDE * SIDE tables of 2 * PART minhashes from 2 * SIDE * PART minhash computations,
about the square root. Two sets of similarity s meet in a table if they share any hash
of the first and any of the second collection, so a link is missed with a probability
below 2 * (1 - s ** PART) ** SIDE: 4e-7 at 0.85.

1. One pass over the texts: set size, digest and signature (all minhashes, 32 bits each).
   Documents with equal sets form a class, which the digest names.
2. Screen: a class can only meet another in a table if it shares a hash of the first
   collection with some class and a hash of the second one too. Others drop out before
   their SIDE * SIDE keys are built.
3. Tables: keys are dealt to shards as packed blocks. Members of a table entry form a
   chain by set size, cut where sizes forbid a link, so there are never all pairs. A
   block thins each of its chains to a few sizes before it is shuffled: a group of
   copies a third of all classes belong to sends a handful of rows from each task.
4. Chains make clusters; the sets of a cluster travel to one task, a cluster over
   BLOCK sets to tiles of two blocks. Pairs that meet in a table there are verified on
   whole sets, unless links found before already join them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, join_by_key, mix, partitions, text_batches, written
from .jaccard import shingle_sets

NUM, DEN = 85, 100        # link if DEN * intersection >= NUM * union
SIDE, PART = 12, 2        # hashes of a collection, minhashes of a hash
BLOCK = 1024              # sets of a block of a large cluster
STRIP = 256               # sets compared at a time
HUBS = 8                  # sets compared one by one with all others before a strip is compared whole
KEYS = 1 << 20            # keys packed at a time
TOGETHER = 1 << 15        # shingles whose minhashes are computed together, to stay in the processor's cache
PER_SHARD = 2_000_000     # keys a shard task holds
BROADCAST_IDS = 1_000_000  # ids broadcast for the second reading, if there are no more (some 40 MB)
_MINS = 2 * SIDE * PART


def signature(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Minhashes of several sets that follow each other; ``first``: where each begins. No set is empty."""
    out = np.empty((len(first), _MINS), "<u4")
    for k in range(_MINS):
        out[:, k] = np.minimum.reduceat(mix(tokens, 500 + k), first) >> np.uint64(32)
    return out


def hashes(mins: np.ndarray) -> np.ndarray:
    """(sets, 2 * SIDE) hashes of PART minhashes each, named apart by their number."""
    part = mins.reshape(len(mins), 2 * SIDE, PART).astype(np.uint64)
    total = np.zeros(part.shape[:2], np.uint64)
    for k in range(PART):
        total = mix(total ^ part[:, :, k], 40 + k)
    with np.errstate(over="ignore"):
        return mix(total + np.arange(2 * SIDE, dtype=np.uint64), 9)


def table_keys(h: np.ndarray) -> np.ndarray:
    """(sets, SIDE * SIDE) keys: every hash of the first collection with every one of the second."""
    with np.errstate(over="ignore"):
        pairs = h[:, :SIDE, None] * np.uint64(3) + h[:, None, SIDE:]
    return mix(pairs.reshape(len(h), -1), 11)


def meet(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which sets of the left meet which of the right in some table, from their hashes."""
    sides = []
    for side in (slice(0, SIDE), slice(SIDE, 2 * SIDE)):
        hit = np.zeros((len(left), len(right)), bool)
        for a, b in zip(left[:, side].T, right[:, side].T):
            hit |= a[:, None] == b[None, :]
        sides.append(hit)
    return sides[0] & sides[1]


def sizes_fit(a, b):
    return DEN * np.minimum(a, b) >= NUM * np.maximum(a, b)


def linked(shared, a, b):
    return DEN * shared >= NUM * (a + b - shared)


def digest(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _described(sets: list[np.ndarray]):
    """(size, digest, signature) of several sets; the last two are None without shingles."""
    full = [s for s in sets if len(s)]
    if full:
        mins = iter(signature(np.concatenate(full), np.cumsum([0, *map(len, full[:-1])])))
    for s in sets:
        yield (len(s), digest(s), next(mins).tobytes()) if len(s) else (0, None, None)


def described(texts):
    """(size, digest, signature) of the set of each whole text."""
    group, held = [], 0
    for s in shingle_sets(texts):
        group.append(s)
        held += len(s)
        if held >= TOGETHER:
            yield from _described(group)
            group, held = [], 0
    yield from _described(group)


def _set_rows(batches):
    for batch in batches:
        n, names, mins = zip(*described(batch["text"].to_pylist())) if batch.num_rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(n, pa.int64()), pa.array(names, pa.binary()), pa.array(mins, pa.binary())],
            ["doc_id", "n", "digest", "mins"])


def _classes(batches):
    """A few classes at a time: names, sizes, hashes."""
    for batch in batches:
        step = KEYS // (SIDE * SIDE)
        for a in range(0, batch.num_rows, step):
            part = batch.slice(a, step)
            if part.num_rows:
                mins = np.frombuffer(b"".join(part["mins"].to_pylist()), "<u4").reshape(part.num_rows, _MINS)
                yield (np.frombuffer(b"".join(part["digest"].to_pylist()), "V16"),
                       part["n"].to_numpy(zero_copy_only=False), hashes(mins))


def _thin(key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Members, sorted by key and size, that keep every chain of sizes connected.

    Of a chain the first and the last stay, and between them each greatest member that
    still fits the one kept before it. Whoever fits a dropped member by size fits a kept
    one, or lies between two kept ones that fit each other.
    """
    keep = np.ones(len(key), bool)
    link = (key[1:] == key[:-1]) & sizes_fit(n[1:], n[:-1])
    inner = np.r_[False, link] & np.r_[link, False]
    for a, b in _stretches(inner):  # members a..b-1 have chain neighbours on both sides
        size = n[a - 1:b + 1].tolist()
        last = size[0]
        for i in range(1, b - a + 1):
            if DEN * last >= NUM * size[i + 1]:
                keep[a + i - 1] = False
            else:
                last = size[i]
    return keep


def _stretches(flags: np.ndarray):
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False]))
    return zip(edge[::2].tolist(), edge[1::2].tolist())


def _chains(key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Where a member, in order of key and size, is chained to the one before it."""
    return np.flatnonzero((key[1:] == key[:-1]) & sizes_fit(n[1:], n[:-1])) + 1


def _distinct_pairs(owner: np.ndarray, at: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Owners of the members before and at each chained place, each pair once."""
    return np.divmod(np.unique(owner[at - 1] * count + owner[at]), count)


def _table_blocks(shards: int):
    """Packed keys by shard, and (shard -1) the chain edges of members that stay behind."""
    def pack(batches):
        for names, n, h in _classes(batches):
            key = table_keys(h).ravel()
            owner = np.repeat(np.arange(len(n)), SIDE * SIDE)
            order = np.lexsort((n[owner], key))
            key, owner = key[order], owner[order]
            size = n[owner]
            keep = _thin(key, size)
            at = _chains(key, size)
            at = at[~(keep[at] & keep[at - 1])]  # chains between kept members are found again later
            if len(at):
                # A dropped member hangs on its neighbours; kept ones need no more.
                left, right = _distinct_pairs(owner, at, len(n))
                yield _rows([-1], [names[left].tobytes() + names[right].tobytes()])
            key, owner = key[keep], owner[keep]
            shard = (key >> np.uint64(33)).astype(np.int64) % shards
            order = np.argsort(shard, kind="stable")
            shard, key, owner = shard[order], key[order], owner[order]
            cuts = np.r_[0, np.flatnonzero(np.diff(shard)) + 1, len(shard)]
            out = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                own, local = np.unique(owner[a:b], return_inverse=True)
                out.append(b"".join([len(own).to_bytes(4, "little"), names[own].tobytes(), n[own].astype("<i8").tobytes(),
                                     key[a:b].astype("<u8").tobytes(), local.astype("<u4").tobytes()]))
            yield _rows(shard[cuts[:-1]].tolist(), out)
    return pack


def _rows(shards: list[int], blocks: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(blocks, pa.binary())],
                                      ["shard", "block"])


def _unpacked(raw: bytes):
    count = int.from_bytes(raw[:4], "little")
    at = 4 + 24 * count
    rest = (len(raw) - at) // 12
    return (np.frombuffer(raw, "V16", count, 4), np.frombuffer(raw, "<i8", count, 4 + 16 * count),
            np.frombuffer(raw, "<u8", rest, at), np.frombuffer(raw, "<u4", rest, at + 8 * rest))


def _shard_chains(blocks: pd.DataFrame) -> pd.DataFrame:
    """Chain edges of the table entries of a shard."""
    names, sizes, keys, owners, base = [], [], [], [], 0
    for raw in blocks["block"]:
        own, n, key, local = _unpacked(raw)
        names.append(own)
        sizes.append(n)
        keys.append(key)
        owners.append(local.astype(np.int64) + base)
        base += len(own)
    name, n, key, owner = map(np.concatenate, (names, sizes, keys, owners))
    order = np.lexsort((n[owner], key))
    key, owner = key[order], owner[order]
    at = _chains(key, n[owner])
    left, right = _distinct_pairs(owner, at, len(n))
    return pd.DataFrame({"a": [x.tobytes() for x in name[left]], "b": [x.tobytes() for x in name[right]]})


def _kept_edges(batches):
    for batch in batches:
        for raw in batch["block"].to_pylist():
            pairs = np.frombuffer(raw, "V16").reshape(2, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.tobytes() for x in side], pa.binary()) for side in pairs], ["a", "b"])


def _screen_blocks(shards: int):
    """Each class's hashes of both collections, dealt to shards; a hash met often leaves two names."""
    def pack(batches):
        for names, _, h in _classes(batches):
            key = h.ravel()
            owner = np.repeat(np.arange(len(names)), 2 * SIDE)
            side = np.tile(np.arange(2 * SIDE) // SIDE, len(names)).astype(np.uint64)
            key = (key & ~np.uint64(1)) | side
            order = np.argsort(key, kind="stable")
            key, owner = key[order], owner[order]
            same = key[1:] == key[:-1]
            shared = np.r_[False, same] | np.r_[same, False]
            for s in (0, 1):  # known here already: shared within the block
                own = np.unique(owner[shared & ((key & np.uint64(1)) == s)])
                if len(own):
                    yield _rows([-1 - s], [names[own].tobytes()])
            keep = np.r_[True, ~same]  # one of each hash is enough for others to meet
            key, owner = key[keep], owner[keep]
            shard = (key >> np.uint64(33)).astype(np.int64) % shards
            order = np.argsort(shard, kind="stable")
            shard, key, owner = shard[order], key[order], owner[order]
            cuts = np.r_[0, np.flatnonzero(np.diff(shard)) + 1, len(shard)]
            yield _rows(shard[cuts[:-1]].tolist(),
                        [key[a:b].astype("<u8").tobytes() + names[owner[a:b]].tobytes() for a, b in zip(cuts[:-1], cuts[1:])])
    return pack


def _screen_shard(blocks: pd.DataFrame) -> pd.DataFrame:
    """Classes that share a hash with another, and of which collection it is (1, 2 or both: 3)."""
    keys, names = [], []
    for raw in blocks["block"]:
        count = len(raw) // 24
        keys.append(np.frombuffer(raw, "<u8", count))
        names.append(np.frombuffer(raw, "V16", count, 8 * count))
    key, name = np.concatenate(keys), np.concatenate(names)
    order = np.argsort(key, kind="stable")
    key, name = key[order], name[order]
    same = key[1:] == key[:-1]
    shared = np.r_[False, same] | np.r_[same, False]
    sides = 1 + (key[shared] & np.uint64(1)).astype(np.int64)
    return pd.DataFrame({"digest": [x.tobytes() for x in name[shared]], "side": sides}).drop_duplicates()


def _screen_known(batches):
    for batch in batches:
        for shard, raw in zip(batch["shard"].to_pylist(), batch["block"].to_pylist()):
            names = [raw[a:a + 16] for a in range(0, len(raw), 16)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([-shard] * len(names), pa.int64())],
                                             ["digest", "side"])


def _dealt(blocks: DataFrame, own, per_shard, schema: str) -> DataFrame:
    """Results of the blocks' own finds (negative shards) and of the shards."""
    return (blocks.filter("shard < 0").mapInArrow(own, schema)
            .unionByName(blocks.filter("shard >= 0").groupBy("shard").applyInPandas(per_shard, schema)))


def candidates(classes: DataFrame) -> DataFrame:
    """Edges (a, b) between digests that connect all classes which meet in a table and fit by size."""
    spark = classes.sparkSession
    total = classes.count()
    columns = ["digest", "n", "mins"]
    shards = max(2 * partitions(spark), -(-total * 2 * SIDE // PER_SHARD))
    screened = written(classes.select(columns).mapInArrow(_screen_blocks(shards), "shard long, block binary"),
                       "screen-blocks")
    sides = written(_dealt(screened, _screen_known, _screen_shard, "digest binary, side long")
                    .groupBy("digest").agg(F.countDistinct("side").alias("sides")), "screened")
    able = written(classes.join(sides.filter("sides = 2"), "digest", "left_semi").select(columns), "able")
    shards = max(2 * partitions(spark), -(-able.count() * SIDE * SIDE // PER_SHARD))
    blocks = written(able.mapInArrow(_table_blocks(shards), "shard long, block binary"), "table-blocks")
    return written(_dealt(blocks, _kept_edges, _shard_chains, "a binary, b binary").distinct(), "candidates")


class _Linker:
    """Links among the sets of one task, as labels that linked sets share."""

    def __init__(self, tokens: list[np.ndarray]) -> None:
        self.tokens = tokens
        self.n = np.array([len(t) for t in tokens], np.int64)
        first = np.cumsum(np.r_[0, self.n[:-1]])
        self.h = hashes(signature(np.concatenate(tokens), first))
        self.label = np.arange(len(tokens))

    def join(self, i: int, others: np.ndarray) -> None:
        gone = np.unique(self.label[others])
        self.label[np.isin(self.label, gone)] = self.label[i]

    def shared(self, i: int, others: np.ndarray) -> np.ndarray:
        """Number of tokens each of the others has in common with set i."""
        own = self.tokens[i]
        flat = np.concatenate([self.tokens[j] for j in others])
        place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        size = self.n[others]
        return np.add.reduceat((own[place] == flat).astype(np.int64), np.cumsum(size) - size)

    def overlap(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Tokens in common of each left with each right set, by products of incidence strips."""
        sides = []
        for own in (left, right):
            t = np.concatenate([self.tokens[i] for i in own])
            sides.append((t, np.repeat(np.arange(len(own)), self.n[own])))
        both = np.intersect1d(sides[0][0], sides[1][0])
        total = np.zeros((len(left), len(right)), np.float32)
        if not len(both):
            return total
        held = []
        for t, owner in sides:
            place = np.minimum(np.searchsorted(both, t), len(both) - 1)
            hit = both[place] == t
            order = np.argsort(place[hit], kind="stable")
            held.append((place[hit][order], owner[hit][order]))
        for a in range(0, len(both), 4096):
            strips = []
            for (place, owner), own in zip(held, (left, right)):
                s, e = np.searchsorted(place, (a, a + 4096))
                strip = np.zeros((len(own), min(4096, len(both) - a)), np.float32)
                strip[owner[s:e], place[s:e] - a] = 1
                strips.append(strip)
            total += strips[0] @ strips[1].T
        return total

    def compare(self, left: np.ndarray, right: np.ndarray) -> None:
        """Join all linked sets of the left and the right strip that meet in a table."""
        def apart(rows, cols):
            return self.label[rows][:, None] != self.label[cols][None, :]
        open_ = apart(left, right)
        if left[0] == right[0]:
            open_ = np.triu(open_)
        if open_.any():
            open_ &= sizes_fit(self.n[left][:, None], self.n[right][None, :]) & meet(self.h[left], self.h[right])
        for _ in range(HUBS):  # one hub joins most of a group of copies
            count = open_.sum(axis=1)
            hub = int(count.argmax())
            if not count[hub]:
                return
            others = right[open_[hub]]
            i = left[hub]
            self.join(i, others[linked(self.shared(i, others), self.n[i], self.n[others])])
            open_[hub] = False
            open_ &= apart(left, right)
        rows, cols = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
        if len(rows):
            a, b = left[rows], right[cols]
            hit = linked(self.overlap(a, b), self.n[a][:, None], self.n[b][None, :]) & open_[np.ix_(rows, cols)]
            for r in np.flatnonzero(hit.any(axis=1)).tolist():
                self.join(a[r], b[hit[r]])

    def run(self, left: np.ndarray, right: np.ndarray | None = None) -> None:
        """All strips of the left with those of the right, or with themselves."""
        for k in range(0, len(left), STRIP):
            other = left[k:] if right is None else right
            for m in range(0, len(other), STRIP):
                self.compare(left[k:k + STRIP], other[m:m + STRIP])

    def stars(self, names: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Each set's name with the smallest name that shares its label."""
        low: dict[int, bytes] = {}
        for k, name in zip(self.label.tolist(), names):
            low[k] = min(low.get(k, name), name)
        return [(low[k], name) for k, name in zip(self.label.tolist(), names) if low[k] != name]


def _linker(rows: pd.DataFrame) -> tuple[_Linker, list[bytes]]:
    return _Linker([np.frombuffer(t, np.uint64) for t in rows["tokens"]]), [bytes(x) for x in rows["digest"]]


def _link_clusters(rows: pd.DataFrame) -> pd.DataFrame:
    """Whole clusters, none over BLOCK sets."""
    out = []
    for _, part in rows.drop_duplicates("digest").groupby("cluster", sort=False):
        if len(part) > 1:
            link, names = _linker(part)
            link.run(np.arange(len(names)))
            out += link.stars(names)
    return pd.DataFrame(out, columns=["a", "b"])


def _link_tile(rows: pd.DataFrame) -> pd.DataFrame:
    """Two blocks of a large cluster, or one with itself."""
    rows = rows.drop_duplicates("digest")
    link, names = _linker(rows)
    own, low, high = rows["own"].to_numpy(), rows["low"].iloc[0], rows["high"].iloc[0]
    if low == high:
        link.run(np.arange(len(names)))
    else:
        link.run(np.flatnonzero(own == low), np.flatnonzero(own == high))
    return pd.DataFrame(link.stars(names), columns=["a", "b"])


def _token_rows(batches):
    """Rows whose text has the set of the class; another text with the same id is not it."""
    for batch in batches:
        sets = list(shingle_sets(batch["text"].to_pylist()))
        own = pa.array([len(s) > 0 and digest(s) == d for s, d in zip(sets, batch["digest"].to_pylist())], pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [batch["digest"], batch["cluster"], batch["members"], pa.array([s.tobytes() for s in sets], pa.binary())],
            ["digest", "cluster", "members", "tokens"]).filter(own)


def _verified(tokens: DataFrame) -> DataFrame:
    """Links (a, b) that span each linked group; a is the group's smallest name."""
    spark = tokens.sparkSession
    pair = "a binary, b binary"
    weight = tokens.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
    buckets = max(2 * partitions(spark), weight // (1 << 24))
    small, large = tokens.filter(F.col("members") <= BLOCK), tokens.filter(F.col("members") > BLOCK)
    found = written(small.withColumn("bucket", F.pmod(F.xxhash64("cluster"), F.lit(buckets)))
                    .groupBy("bucket").applyInPandas(_link_clusters, pair), "links")
    if large.isEmpty():
        return found
    blocks = F.ceil(F.col("members") / (BLOCK // 2)).cast("long")
    tiles = (large.withColumn("own", F.pmod(F.xxhash64("digest"), blocks))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
             .withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("other"))
    edges = written(tiles.groupBy("cluster", "low", "high").applyInPandas(_link_tile, pair), "tile-links")
    return found.unionByName(components(edges).select(F.col("component").alias("a"), F.col("node").alias("b"))
                             .filter("a <> b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id reachable over links, the document's own
    included; kept says that it is the document's own. Words are runs of anything but
    ASCII white space with A-Z lower-cased; a text of fewer than five words is one
    shingle; a null text or one without words has no shingle and no link and is kept.
    Documents with equal sets are linked. Repeated rows give repeated results. A null
    doc_id is never the smallest unless all ids of its component are null, and then the
    rows are kept; rows without an id are linked by equal sets only, unless one with an id has the
    same set. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = written(texts.mapInArrow(_set_rows, "doc_id long, n long, digest binary, mins binary"), "sets")
    # Grouped by all three, which the digest decides, to stay a hash aggregate.
    classes = written(sets.filter("n > 0").groupBy("digest", "n", "mins").agg(F.min("doc_id").alias("rep")), "classes")
    edges = candidates(classes)
    clusters = written(components(edges).withColumnsRenamed({"node": "digest", "component": "cluster"}), "clusters")
    members = written(clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("members")), "members")
    wanted = written(join_by_key(clusters, members, "cluster").join(classes.select("digest", "rep"), "digest")
                     .select(F.col("rep").alias("doc_id"), "digest", "cluster", "members")
                     .filter("doc_id is not null"), "wanted")
    few = wanted.count() <= BROADCAST_IDS
    loaded = texts.join(F.broadcast(wanted) if few else wanted.hint("shuffle_hash"), "doc_id")
    tokens = written(loaded.mapInArrow(_token_rows, "digest binary, cluster binary, members long, tokens binary"),
                     "token-sets")
    links = _verified(tokens).select(F.col("b").alias("digest"), F.col("a").alias("root"))
    rooted = written(classes.select("digest", "rep").join(links, "digest", "left")
                     .withColumn("root", F.coalesce("root", "digest")), "rooted")
    # Both are used twice: written, or the last plan holds all of them that often.
    lowest = written(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "lowest")
    facts = written(join_by_key(rooted.select("digest", "root"), lowest, "root").select("digest", "component_id"),
                    "facts")
    # Texts without a set get a name of their own, so that they are no hot key.
    named = sets.select("doc_id", "n", F.coalesce("digest", F.unhex(F.concat(F.lit("00"), F.hex("doc_id")))).alias("digest"))
    return (join_by_key(named, facts, "digest", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
