"""SentencePiece encoding and decoding with a Unigram Viterbi search.

The vocabulary (pieces with log scores) is read from a model file; nothing is
trained. Pieces are kept in a double-array trie over their UTF-8 bytes. As no piece
goes from a non-blank back to a blank, a text falls apart into units (blanks and the
word after them) that can be segmented one by one: each task searches its distinct
units, many at a time, and keeps recent ones in a bounded cache.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"  # stands for a blank inside pieces
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
SHORT = 40        # longest unit, in bytes, of the vectorised search
LOT = 8192        # units searched at a time
CACHED = 100_000  # units a task remembers
GROUP_CHARS = 2_000_000  # characters of texts whose units are searched together


def _fields(raw: bytes):
    """(number, value) of each field of a serialised message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, raw[at:at + size]
        at += size


@dataclass
class Vocabulary:
    """Pieces, scores and kinds by id, and the normaliser's switches."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    byte_fallback: bool = False
    dummy_prefix: bool = True
    squeeze_blanks: bool = True

    @classmethod
    def read(cls, path: str = MODEL_PATH) -> Vocabulary:
        v = cls()
        with open(path, "rb") as file:
            raw = file.read()
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                v.pieces.append(piece[1].decode())
                v.scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
                v.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                v.byte_fallback = bool(dict(_fields(value)).get(35, 0))
            elif number == 3:
                rules = dict(_fields(value))
                v.dummy_prefix = bool(rules.get(3, 1))
                v.squeeze_blanks = bool(rules.get(4, 1))
                if rules.get(2):
                    raise ValueError("only vocabularies with the identity normaliser are supported")
        return v


class DoubleArray:
    """Trie over byte strings: child of node s by byte c is base[s] + c + 1 if check[] there is s.

    A base may be negative; places before the first then fall on the free cells at the end.
    """

    def __init__(self, keys: dict[bytes, int]) -> None:
        size = 1 << 16
        base, check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        value = np.full(size, -1, np.int32)
        children: dict[bytes, set[int]] = {b"": set()}
        for key in keys:
            for i in range(len(key)):
                children.setdefault(key[:i], set()).add(key[i])
        place = {b"": 0}
        check[0] = -2
        first_free = 1
        for prefix in sorted(children, key=lambda p: (len(p), p)):
            codes = np.array(sorted(children[prefix])) + 1
            if not len(codes):
                continue
            window = 512
            while True:
                while first_free + window + 257 > len(check):
                    grow = len(check)
                    base = np.concatenate([base, np.zeros(grow, np.int32)])
                    check = np.concatenate([check, np.full(grow, -1, np.int32)])
                    value = np.concatenate([value, np.full(grow, -1, np.int32)])
                starts = np.flatnonzero(check[first_free:first_free + window] == -1) + first_free - codes[0]
                for code in codes[1:]:
                    starts = starts[check[starts + code] == -1]
                if len(starts):
                    break
                window *= 4
            s = place.pop(prefix)
            base[s] = starts[0]
            check[starts[0] + codes] = s
            for code in codes:
                key = prefix + bytes([code - 1])
                at = int(starts[0] + code)
                value[at] = keys.get(key, -1)
                if key in children:
                    place[key] = at
            while first_free < len(check) and check[first_free] != -1:
                first_free += 1
        self.base, self.check, self.value = base, check, value

    def find(self, key: bytes) -> int:
        """Value of a key, or -1."""
        node = 0
        for c in key:
            t = int(self.base[node]) + c + 1
            if self.check[t] != node:
                return -1
            node = t
        return int(self.value[node])


_CHAR_BYTES = np.array([1] * 192 + [2] * 32 + [3] * 16 + [4] * 16, np.int64)


class Codec:
    """Encoder and decoder of one vocabulary. Pickles whole; its size is that of the vocabulary."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        v = self.vocabulary = vocabulary
        if v.squeeze_blanks:
            raise ValueError("vocabularies that squeeze blanks are not supported: decoding would not invert")
        kinds = np.array(v.kinds)
        usable = {p.encode(): i for i, p in enumerate(v.pieces) if v.kinds[i] in (NORMAL, USER)}
        self.trie = DoubleArray(usable)
        self.scores = np.array(v.scores, np.float64)
        normal = self.scores[kinds == NORMAL]
        self.unknown = float(normal.min()) - UNKNOWN_PENALTY if len(normal) else -UNKNOWN_PENALTY
        top = float(normal.max()) if len(normal) else 0.0
        for i in np.flatnonzero(kinds == USER):
            self.scores[i] = len(v.pieces[i].encode()) * top - 0.1
        self.unk_id = int(np.flatnonzero(kinds == UNKNOWN)[0])
        self.byte_ids = {}
        if v.byte_fallback:
            self.byte_ids = {int(v.pieces[i][3:5], 16): int(i) for i in np.flatnonzero(kinds == BYTE)}
        #: Units may be searched alone if no piece holds a blank after a non-blank.
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", v.pieces[i]) for i in usable.values())
        self.raw = [b"" if k in (CONTROL, UNKNOWN) else bytes([int(p[3:5], 16)]) if k == BYTE
                    else p.replace(MARK, " ").encode() for p, k in zip(v.pieces, v.kinds)]
        self.raw[self.unk_id] = " ⁇ ".encode()
        # Units searched lately: their number, and their ids in pieces of (ids, sizes).
        self.known: dict[str, int] = {}
        self.chunks: list[tuple[np.ndarray, np.ndarray]] = []

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "chunks": []}

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        text = (" " if self.vocabulary.dummy_prefix else "") + text.replace(MARK, " ")
        return re.findall(" *[^ ]+| +", text) if self.splits else [text]

    def _emit(self, unit: bytes, cuts: list[tuple[int, int, int]]) -> list[int]:
        out: list[int] = []
        for piece, a, b in cuts:
            if piece >= 0:
                out.append(piece)
            elif self.byte_ids:
                out.extend(self.byte_ids[c] for c in unit[a:b])
            else:
                out.append(self.unk_id)
        return out

    def search(self, unit: bytes) -> list[int]:
        """Best segmentation of one unit; of equal sums, the one whose last piece starts first."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        n = len(unit)
        best, back = [float("-inf")] * (n + 1), [(-1, 0)] * (n + 1)
        best[0], s = 0.0, 0
        while s < n:
            size, single, node, here = min(int(_CHAR_BYTES[unit[s]]), n - s), False, 0, best[s]
            for e in range(s, n):
                t = int(base[node]) + unit[e] + 1
                if check[t] != node:
                    break
                node = t
                piece = int(value[node])
                if piece >= 0:
                    single |= e + 1 - s == size
                    total = here + self.scores[piece]
                    if total > best[e + 1]:
                        best[e + 1], back[e + 1] = total, (piece, s)
            if not single and here + self.unknown > best[s + size]:
                best[s + size], back[s + size] = here + self.unknown, (-1, s)
            s += size
        cuts, at = [], n
        while at:
            piece, start = back[at]
            cuts.append((piece, start, at))
            at = start
        return self._emit(unit, cuts[::-1])

    def search_many(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``search`` for many units at once: all ids in a row, and how many each unit has.

        Place by place, all units that have a character there walk the trie together. The
        padding is a byte that no piece holds, so a walk ends at the end of its unit.
        """
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        n, wide = len(units), max(map(len, units))
        size = np.array(list(map(len, units)))
        text = np.ascontiguousarray(np.frombuffer(
            b"".join(u.ljust(wide, b"\0") for u in units), np.uint8).reshape(n, wide).T)
        best = np.full((wide + 5, n), -np.inf)
        best[0] = 0
        came, took = np.zeros((wide + 5, n), np.int32), np.full((wide + 5, n), -1, np.int32)
        for s in range(wide):
            live = np.flatnonzero((size > s) & ((text[s] & 0xC0) != 0x80))
            chars = _CHAR_BYTES[text[s]]
            here = best[s]
            rows, node = live, 0
            single = np.zeros(n, bool)
            for e in range(s, wide):
                t = base[node] + text[e][rows] + 1
                ok = check[t] == node
                rows, node = rows[ok], t[ok]
                if not len(rows):
                    break
                piece = value[node]
                has = piece >= 0
                r, p = rows[has], piece[has]
                if e < s + 4:
                    single[r[chars[r] == e + 1 - s]] = True
                total = here[r] + scores[p]
                end = best[e + 1]
                better = total > end[r]
                r = r[better]
                end[r], came[e + 1][r], took[e + 1][r] = total[better], s, p[better]
            r = live[~single[live]]
            if len(r):
                end = s + np.minimum(chars[r], size[r] - s)
                total = here[r] + self.unknown
                better = total > best[end, r]
                r, end = r[better], end[better]
                best[end, r], came[end, r], took[end, r] = total[better], s, -1
        at, live, steps = size.copy(), np.arange(n), []
        while len(live):
            ends = at[live]
            starts = came[ends, live]
            steps.append((live, took[ends, live], starts, ends))
            at[live] = starts
            live = live[starts > 0]
        unit, piece, a, b = map(np.concatenate, zip(*steps))
        unknown = piece < 0
        if unknown.any() and self.byte_ids:
            byte_of = np.array([self.byte_ids.get(i, self.unk_id) for i in range(256)])
            extra = [(unit[unknown & (b - a > k)], a[unknown & (b - a > k)] + k) for k in range(4)]
            u, place = map(np.concatenate, zip(*extra))
            unit, a = np.r_[unit[~unknown], u], np.r_[a[~unknown], place]
            piece = np.r_[piece[~unknown], byte_of[text[place, u]]]
        else:
            piece = np.where(unknown, self.unk_id, piece)
        order = np.argsort(unit * np.int64(wide) + a)
        return piece[order].astype(np.int32), np.bincount(unit, minlength=n)

    def learn(self, units: set[str]) -> None:
        """Search the units that are not known yet and add their ids to the store."""
        new = [u for u in units if u not in self.known]
        raw = [u.replace(" ", MARK).encode() for u in new]
        order = sorted((i for i in range(len(new)) if len(raw[i]) <= SHORT), key=lambda i: len(raw[i]))
        for a in range(0, len(order), LOT):
            part = order[a:a + LOT]
            self._store([new[i] for i in part], *self.search_many([raw[i] for i in part]))
        for u, r in zip(new, raw):
            if len(r) > SHORT:
                ids = self.search(r)
                self._store([u], np.array(ids, np.int32), np.array([len(ids)]))

    def _store(self, units: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.known)
        self.known.update(zip(units, range(first, first + len(units))))
        self.chunks.append((ids, sizes))

    def _tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All stored ids, and the start and number of each unit's."""
        if len(self.chunks) != 1:
            self.chunks = [tuple(map(np.concatenate, zip(*self.chunks)))] if self.chunks else \
                [(np.zeros(0, np.int32), np.zeros(0, np.int64))]
        ids, sizes = self.chunks[0]
        return ids, np.cumsum(sizes) - sizes, sizes

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Ids of each text; a null text gives null, an empty one no ids."""
        out: list[np.ndarray | None] = []
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and size < GROUP_CHARS:
                size += len(texts[end] or "")
                end += 1
            parts = [self.units(t or "") for t in texts[start:end]]
            if len(self.known) > CACHED:
                self.known, self.chunks = {}, []
            self.learn(set(itertools.chain.from_iterable(parts)))
            ids, starts, sizes = self._tables()
            look = self.known.__getitem__
            for text, part in zip(texts[start:end], parts):
                which = np.fromiter(map(look, part), np.int64, len(part))
                many = sizes[which]
                ends = np.cumsum(many)
                places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[which] - ends + many, many)
                out.append(None if text is None else ids[places])
            start = end
        return out

    def decode(self, ids) -> str | None:
        """Text of ids: blanks for markers, bytes joined before decoding, dummy prefix removed."""
        if ids is None:
            return None
        ids = ids.tolist() if isinstance(ids, np.ndarray) else list(ids)
        if ids and min(ids) < 0:
            raise IndexError("negative piece id")
        raw = b"".join(map(self.raw.__getitem__, ids))
        if self.vocabulary.dummy_prefix and raw.startswith(b" "):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


def _schema(docs: DataFrame, added: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), added])


def encode(docs: DataFrame, codec: Codec, text: str = "text", out: str = "token_ids",
           check: str | None = None) -> DataFrame:
    """Add the piece ids of every whole text as ``array<int>``.

    A null text gives a null array, an empty text an empty one. A text of any length
    is encoded whole; what is not in the vocabulary becomes byte pieces. ``check`` names a
    boolean column that tells whether decoding gives the text back, decoded in the same
    pass. A column named like ``out`` or ``check`` is replaced, all others pass through.
    """
    text_batches(docs.sparkSession)
    docs = docs.drop(out, *([check] if check else []))
    shared = docs.sparkSession.sparkContext.broadcast(codec)

    def run(batches):
        for batch in batches:
            ids = shared.value.encode(batch[text].to_pylist())
            sizes = np.array([0 if i is None else len(i) for i in ids], np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            flat = np.concatenate([i for i in ids if i is not None] or [np.zeros(0, np.int32)])
            rows = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)),
                                            mask=pa.array([i is None for i in ids], pa.bool_()))
            done = batch.append_column(out, rows)
            if check:
                same = [shared.value.decode(i) == t for i, t in zip(ids, batch[text].to_pylist())]
                done = done.append_column(check, pa.array(same, pa.bool_()))
            yield done

    return docs.mapInArrow(run, _schema(docs, f"`{out}` array<int>" + (f", `{check}` boolean" if check else "")))


def decode(rows: DataFrame, codec: Codec, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add the text that the ids stand for. Null ids give null, no ids the empty text."""
    text_batches(rows.sparkSession)
    rows = rows.drop(out)
    shared = rows.sparkSession.sparkContext.broadcast(codec)

    def run(batches):
        for batch in batches:
            texts = [shared.value.decode(None if x is None else x.values.to_numpy())
                     for x in (v if v.is_valid else None for v in batch[ids])]
            yield batch.append_column(out, pa.array(texts, pa.string()))

    return rows.mapInArrow(run, _schema(rows, f"`{out}` string"))


def digests(rows: DataFrame, codec: Codec, ids: str = "token_ids", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, ids_sha256 (of little-endian int32) and round_trip."""
    shared = rows.sparkSession.sparkContext.broadcast(codec)
    is_byte = np.zeros(len(codec.raw), bool)
    is_byte[list(codec.byte_ids.values())] = True

    def run(batches):
        for batch in batches:
            out = {"n_tokens": [], "n_byte_tokens": [], "ids_sha256": [], "round_trip": []}
            for v, t in zip(batch[ids], batch[text]):
                found = v.values.to_numpy() if v.is_valid else np.zeros(0, np.int32)
                out["n_tokens"].append(len(found))
                out["n_byte_tokens"].append(int(is_byte[found].sum()))
                out["ids_sha256"].append(hashlib.sha256(found.astype("<i4").tobytes()).hexdigest())
                out["round_trip"].append(shared.value.decode(found) == (t.as_py() or ""))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(out["n_tokens"], pa.int64()),
                 pa.array(out["n_byte_tokens"], pa.int64()), pa.array(out["ids_sha256"], pa.string()),
                 pa.array(out["round_trip"], pa.bool_())], ["doc_id", *out])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return (rows.select(F.col("doc_id"), ids, text)
            .mapInArrow(run, f"doc_id {kind}, n_tokens long, n_byte_tokens long, ids_sha256 string, "
                             "round_trip boolean"))
