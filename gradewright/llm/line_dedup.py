"""Line deduplication by sharded minimal perfect hashes.

1. Each task reduces its documents to (line hash, smallest id, largest id); Spark
   merges them. A line in two documents has two different ids.
2. The distinct hashes are dealt to shards. A shard task builds a minimal perfect
   hash over its keys (level bitmaps, as in the published BBHash scheme) that indexes compact
   arrays: 64-bit fingerprint, count of documents, smallest id. A line goes where its
   count is two or more.
3. Each task packs its documents' lines into binary blocks, one per shard, which probe
   the shard's arrays; no line is ever joined. A shard gets a copy of its arrays for
   every LINES_PER_GROUP lines that probe it, so a line that sits in a third of all
   documents is spread over as many groups as its lines need.
4. The positions to drop go back to their documents, which are split once more.

Keys are 128-bit hashes: 64 bits address the perfect hash, 64 bits are the
fingerprint that turns strangers away.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, mix, partitions, text_batches, written

MIN_CHARS = 10
KEYS_PER_SHARD = 1 << 18
LINES_PER_BLOCK = 1 << 16
LINES_PER_GROUP = 1 << 21
GAMMA = 2.0
LEVELS = 48


class PerfectHash:
    """Minimal perfect hash over distinct (hi, lo) keys, with vectorised look-up.

    Level i has a bitmap of about GAMMA bits per remaining key; a key whose bit no
    other key wants is settled there, the rest go on. A key's index is the number
    of bits set before its own. Keys left after all levels are listed.
    """

    def __init__(self, hi: np.ndarray, lo: np.ndarray) -> None:
        self.levels, self.sizes = [], []
        for level in range(LEVELS):
            if not len(hi):
                break
            size = max(64, int(GAMMA * len(hi)))
            at = self._place(hi, lo, level, size)
            single = np.bincount(at, minlength=size) == 1
            self.levels.append(single)
            self.sizes.append(size)
            rest = ~single[at]
            hi, lo = hi[rest], lo[rest]
        self.rest = (hi, lo)
        bits = np.concatenate(self.levels) if self.levels else np.zeros(0, bool)
        self.starts = np.cumsum([0, *self.sizes])
        self.bits = np.packbits(bits)
        self.ranks = np.cumsum(np.concatenate([[0], bits[:-1]])).astype(np.uint32) if len(bits) else \
            np.zeros(0, np.uint32)
        self.n = int(bits.sum()) + len(hi)
        del self.levels

    @staticmethod
    def _place(hi, lo, level, size):
        return (mix(hi ^ mix(lo, level + 1), 2 * level + 1) % np.uint64(size)).astype(np.int64)

    def index(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Index of each key; for keys outside the set any index, or -1."""
        out = np.full(len(hi), -1, np.int64)
        left = np.arange(len(hi))
        for level, size in enumerate(self.sizes):
            if not len(left):
                return out
            at = self._place(hi[left], lo[left], level, size) + self.starts[level]
            hit = (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            out[left[hit]] = self.ranks[at[hit]]
            left = left[~hit]
        for i, (h, w) in enumerate(zip(*self.rest)):  # normally none
            out[left[(hi[left] == h) & (lo[left] == w)]] = self.n - len(self.rest[0]) + i
        return out


def line_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes and positions of a text's lines whose keys have MIN_CHARS or more."""
    digests, places = [], []
    for i, line in enumerate(text.encode().split(b"\n")):
        key = line.strip(SPACE)
        if len(key) >= MIN_CHARS and (key.isascii() or len(key.decode()) >= MIN_CHARS):
            digests.append(xxhash.xxh3_128_digest(key.lower()))
            places.append(i)
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2), np.array(places, np.int32)


def _blocks(batches):
    """Hashes, ids, tags and positions of the lines of a few documents at a time."""
    parts, size = [], 0
    for batch in batches:
        for doc_id, text, tag in zip(batch["doc_id"].to_pylist(), batch["text"],
                                     batch["tag"].to_pylist()):
            if doc_id is None:
                continue
            keys, places = line_hashes(text.as_py() or "")
            if len(keys):
                parts.append((keys, np.full(len(keys), doc_id, np.int64),
                              np.full(len(keys), tag, np.int64), places))
                size += len(keys)
            if size >= LINES_PER_BLOCK:
                yield [np.concatenate(x) for x in zip(*parts)]
                parts, size = [], 0
    if parts:
        yield [np.concatenate(x) for x in zip(*parts)]


def _key_rows(batches):
    """One row per distinct line of a block: hash, ids that hold it, its lines, smallest and largest id."""
    for keys, ids, _, _ in _blocks(batches):
        order = np.lexsort((ids, keys[:, 1], keys[:, 0]))
        keys, ids = keys[order], ids[order]
        first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        last = np.r_[first[1:], len(keys)] - 1
        step = np.r_[True, (keys[1:] != keys[:-1]).any(axis=1) | (ids[1:] != ids[:-1])]
        yield pa.RecordBatch.from_pydict({
            "hi": keys[first, 0].view(np.int64), "lo": keys[first, 1].view(np.int64),
            "docs": np.add.reduceat(step.astype(np.int64), first),
            "lines": last - first + 1,
            "low": ids[first], "high": ids[last]})


def _build(shard: pd.DataFrame) -> pd.DataFrame:
    hi = shard["hi"].to_numpy(np.int64).view(np.uint64)
    lo = shard["lo"].to_numpy(np.int64).view(np.uint64)
    table = PerfectHash(hi, lo)
    at = table.index(hi, lo)
    marks, counts, low = (np.zeros(table.n, t) for t in (np.uint64, np.uint32, np.int64))
    marks[at] = lo
    counts[at] = np.minimum(shard["docs"], np.iinfo(np.uint32).max)
    low[at] = shard["low"]
    return pd.DataFrame({"shard": [int(shard["shard"].iloc[0])],
                         "arrays": [pickle.dumps((table, marks, counts, low))]})


def _pack(shards: int, total: int, per_group: int):
    """Blocks (shard, salt, block) that probe the arrays.

    A piece with n of a block's b lines may go to ceil(total * n / (b * per_group)) groups
    of its shard. Summed over all blocks, no group is expected to get more than
    ``per_group`` lines, however the lines of a shard lie among the documents.
    """
    def pack(batches):
        for number, (keys, ids, tags, places) in enumerate(_blocks(batches)):
            order = np.lexsort((keys[:, 1], keys[:, 0], keys[:, 0] % np.uint64(shards)))
            keys, ids, tags, places = keys[order], ids[order], tags[order], places[order]
            shard = (keys[:, 0] % np.uint64(shards)).astype(np.int64)
            cuts = np.r_[0, np.flatnonzero(np.diff(shard)) + 1, len(shard)]
            groups = -(-total * np.diff(cuts) // (len(shard) * per_group))
            mark = xxhash.xxh3_64_intdigest(ids[:64].tobytes() + tags[:64].tobytes(), seed=number)
            blocks = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                k = keys[a:b]
                new = np.r_[True, (k[1:] != k[:-1]).any(axis=1)]
                blocks.append(pickle.dumps((k[new], np.cumsum(new) - 1, ids[a:b], tags[a:b],
                                            places[a:b])))
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array(shard[cuts[:-1]], pa.int64()),
                "salt": pa.array([mark % max(1, int(g)) for g in groups], pa.int64()),
                "block": pa.array(blocks, pa.binary())})
    return pack


def _probe(blocks: pd.DataFrame, arrays: pd.DataFrame) -> pd.DataFrame:
    out = []
    if len(arrays) and len(blocks):
        table, marks, counts, low = pickle.loads(arrays["arrays"].iloc[0])
        for raw in blocks["block"]:
            keys, which, ids, tags, places = pickle.loads(raw)
            at = table.index(keys[:, 0], keys[:, 1])
            repeated = (at >= 0) & (marks[at] == keys[:, 1]) & (counts[at] > 1)
            gone = repeated[which] & (ids != low[at][which])
            if gone.any():
                out.append(pd.DataFrame({"doc_id": ids[gone], "tag": tags[gone],
                                         "place": places[gone]}))
    if not out:
        return pd.DataFrame({"doc_id": pd.Series(dtype="int64"), "tag": pd.Series(dtype="int64"),
                             "places": pd.Series(dtype="object")})
    rows = pd.concat(out).groupby(["doc_id", "tag"], sort=False)["place"].agg(list)
    return rows.rename("places").reset_index()


def _rewrite(batches):
    """Rows with the text less the dropped lines, and the counts."""
    for batch in batches:
        texts, lines, dropped = [], [], []
        for text, places in zip(batch["text"].to_pylist(), batch["places"].to_pylist()):
            rows = (text or "").split("\n")
            gone = set(places or ())
            lines.append(len(rows))
            dropped.append(len(gone))
            texts.append("\n".join(r for i, r in enumerate(rows) if i not in gone) if gone else text)
        at = batch.schema.get_field_index("text")
        out = batch.set_column(at, "text", pa.array(texts, batch.schema.field(at).type))
        out = out.drop_columns(["places"])
        yield (out.append_column("n_lines", pa.array(lines, pa.int64()))
               .append_column("n_dropped", pa.array(dropped, pa.int64())))


def line_arrays(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """(shard, arrays) over all distinct lines, the number of shards and that of all lines."""
    spark = docs.sparkSession
    found = docs.mapInArrow(_key_rows, "hi long, lo long, docs long, lines long, low long, high long")
    keys = written(
        found.groupBy("hi", "lo").agg(F.sum("docs").alias("docs"), F.sum("lines").alias("lines"),
                                      F.min("low").alias("low"), F.max("high").alias("high"))
        # Blocks with rows of one id counted it once each; it is one document.
        .withColumn("docs", F.when(F.col("low") == F.col("high"), 1).otherwise(F.col("docs")))
        .drop("high"), "line-keys")
    distinct, total = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("lines"), F.lit(0))).first()
    shards = max(2 * partitions(spark), -(-distinct // KEYS_PER_SHARD))
    # The keys are read as unsigned for the shard: hi mod shards, from its two halves.
    half = 1 << 32
    shard = ((F.shiftrightunsigned("hi", 32) % shards) * (half % shards)
             + F.col("hi").bitwiseAND(half - 1) % shards) % shards
    arrays = (keys.select(shard.alias("shard"), "hi", "lo", "docs", "low").groupBy("shard")
              .applyInPandas(_build, "shard long, arrays binary"))
    return written(arrays, "line-arrays"), shards, total


def line_drops(docs: DataFrame, per_group: int = LINES_PER_GROUP) -> DataFrame:
    """(doc_id, tag, places) of the lines that an earlier document holds, in parts."""
    arrays, shards, total = line_arrays(docs)
    blocks = written(docs.mapInArrow(_pack(shards, total, per_group),
                                     "shard long, salt long, block binary"), "line-blocks")
    groups = blocks.select(F.col("shard").alias("to_shard"), F.col("salt").alias("to_salt")).distinct()
    copies = groups.join(arrays, F.col("to_shard") == F.col("shard")).drop("shard")
    return (blocks.groupBy("shard", "salt").cogroup(copies.groupBy("to_shard", "to_salt"))
            .applyInPandas(_probe, "doc_id long, tag long, places array<int>"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """Documents without lines that an earlier document holds, plus n_lines and n_dropped.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased.
    Keys of MIN_CHARS code points or more found in two or more doc_ids lose all their
    lines except in the smallest doc_id. Lines repeated within one document only stay.

    Nulls: a null text is one empty line and stays null; a row with a null doc_id holds
    no lines and loses none. Rows with one doc_id count as one document even if their
    texts differ. Other columns pass through (not ``n_lines``, ``n_dropped``, which are
    replaced). Empty input gives an empty result.
    """
    text_batches(docs.sparkSession)
    docs = docs.drop("n_lines", "n_dropped")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.xxhash64("text").alias("tag"))
    drops = written(line_drops(base).groupBy("doc_id", "tag").agg(F.flatten(F.collect_list("places")).alias("places"))
                    .withColumnsRenamed({"doc_id": "_id", "tag": "_tag"}), "line-drops")
    joined = (docs.join(drops.hint("shuffle_hash"), (F.col("doc_id").cast("long") == F.col("_id"))
                        & (F.xxhash64("text") == F.col("_tag")), "left").drop("_id", "_tag"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(_rewrite, schema + ", n_lines long, n_dropped long")
