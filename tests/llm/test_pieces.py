import random

import numpy as np
import pytest
import sentencepiece

from gradewright.llm import pieces


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(pieces.Vocabulary.read())


def _message(number, body):
    def varint(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])
    return varint(number << 3 | 2) + varint(len(body)) + body


@pytest.fixture(scope="module")
def library():
    """The library's own Unigram search over the same pieces: the file with another model type."""
    with open(pieces.MODEL_PATH, "rb") as f:
        raw = f.read()
    out = b""
    for number, value in pieces._fields(raw):
        if number == 2:
            # Fields of later duplicates win: model_type (3) = 1, unigram.
            value = value + bytes([3 << 3, 1])
        out += _message(number, value)
    return sentencepiece.SentencePieceProcessor(model_proto=out)


TEXTS = ["", " ", "Hello world", "  two  blanks ", "tab\tand\nnewline\r\n", "Grüße aus Köln, été, niño", "漢字かな交じり",
         "😀👍🏽 emoji", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x=1;y=[2,3]", "\u0000\u0001",
         "Erth the ininfer onre.", "ẞ" * 30, " " * 40 + "end"]


def total(codec, ids):
    """Score of a segmentation; the bytes of an unknown character count as one unknown piece."""
    v = codec.vocabulary
    lead = [int(v.pieces[i][3:5], 16) & 0xC0 != 0x80 for i in ids if v.kinds[i] == pieces.BYTE]
    return sum(codec.scores[i] for i in ids if v.kinds[i] != pieces.BYTE) + sum(lead) * codec.unknown


def test_equals_the_library(codec, library):
    """The library's lattice search (its n-best form) finds the same best score."""
    r = random.Random(5)
    words = ["the", "tionhe", "éement", "ciónes", "Straße", "q", "zzzz", "don't", "12,345.6", "ñ"]
    texts = TEXTS + [" ".join(r.choice(words) + r.choice(["", ".", ","]) for _ in range(r.randint(1, 6))) for _ in range(60)]
    same = 0
    for text, ids in zip(texts, codec.encode(texts)):
        want = library.nbest_encode_as_ids(text, 2)[0] if text else []
        assert total(codec, ids) == pytest.approx(total(codec, want), rel=1e-6), text
        assert codec.decode(ids) == library.decode(ids.tolist()) == text
        same += ids.tolist() == want
    assert same > 0.8 * len(texts)  # others tie in score


def test_vectorised_search_equals_the_plain_one(codec):
    r = random.Random(2)
    units = [("▁" + "".join(r.choice("abcdeéß漢😀▁ ") for _ in range(r.randint(0, 9)))).encode()[:pieces.SHORT] for _ in range(400)]
    units = [u for u in units if u.decode("utf-8", "ignore").encode() == u]
    ids, sizes = codec.search_many(units)
    ends = np.cumsum(sizes).tolist()
    got = [ids[e - n:e].tolist() for e, n in zip(ends, sizes.tolist())]
    assert got == [codec.search(u) for u in units]


def test_search_is_optimal_by_brute_force(codec):
    def best(unit):
        top = {0: 0.0}
        for e in range(1, len(unit) + 1):
            for s in range(e):
                p = codec.trie.find(unit[s:e])
                if s in top and p >= 0:
                    top[e] = max(top.get(e, -1e18), top[s] + codec.scores[p])
        return top[len(unit)]
    for word in ("▁internationalisation", "▁tionhe", "▁Eredst", "▁worldwide"):
        unit = word.encode()
        assert sum(codec.scores[list(codec.search(unit))]) == pytest.approx(best(unit))


def test_double_array_holds_exactly_its_keys():
    keys = {bytes([a, b]): a * 256 + b for a in range(0, 256, 7) for b in range(0, 256, 5)} | {b"abc": 1 << 20, b"a": 3}
    trie = pieces.DoubleArray(keys)
    assert all(trie.find(k) == v for k, v in keys.items())
    assert trie.find(b"ab") == keys.get(b"ab", -1) and trie.find(b"abcd") == -1 and trie.find(b"\xff\xfe") == -1


def test_frames_nulls_long_texts_and_clashing_names(spark, rows, codec):
    long = " ".join(f"word{i}" for i in range(40_000)) + "x" * 5_000
    data = [(1, "Hello", 4), (2, None, 5), (3, "", 6), (4, long, 7), (1, "Hello", 4)]
    enc = pieces.encode(rows(data, "doc_id long, text string, token_ids int"), codec)
    got = pieces.decode(enc, codec).collect()
    assert sorted(map(str, ((r.doc_id, r.decoded) for r in got))) == sorted(map(str, ((i, t) for i, t, _ in data)))
    assert {r.doc_id: r.token_ids for r in got}[2] is None and {r.doc_id: r.token_ids for r in got}[3] == []
    checked = pieces.digests(enc, codec).collect()
    assert all(r.round_trip for r in checked) and {r.n_tokens for r in checked if r.doc_id in (2, 3)} == {0}
    assert pieces.encode(rows([], "doc_id long, text string"), codec).count() == 0


def test_small_stores_and_groups_change_nothing(codec, monkeypatch):
    texts = TEXTS + ["some more words", None]
    want = [None if x is None else x.tolist() for x in codec.encode(texts)]
    for name, value in (("CACHED", 3), ("GROUP_CHARS", 10), ("LOT", 2), ("SHORT", 4)):
        monkeypatch.setattr(pieces, name, value)
        codec.known, codec.chunks = {}, []
        assert [None if x is None else x.tolist() for x in codec.encode(texts)] == want


def test_bad_ids_fail(codec):
    with pytest.raises(IndexError):
        codec.decode(np.array([-1]))
    with pytest.raises(IndexError):
        codec.decode([10 ** 9])
