import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from crowdread.llm import byte_bpe, packing, queries

RANKS = P.path("byte_bpe_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")
PARTS = ["'s", "'", "'re", "'ll", " ", "  ", "\n", "\t", "a", "Zé", "9", "½", "!", "--", " ", "　", "日本", "😀", "\x1c", "\x85", "<|endoftext|>", "the", " of"]


def odd_texts():
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    return [None, "", " ", "x" * 5000, "the cat " * 9000, *texts, texts[0], texts[0]]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "ids", i, "x") for i, t in enumerate(odd_texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, length int, sequence_id string")


def test_encoding_equals_the_public_library(spark, odd):
    ranks = byte_bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = byte_bpe.encode_and_decode(odd, RANKS).collect()
    texts = dict(enumerate(odd_texts()))
    assert len(rows) == len(texts)
    for row in rows:
        assert list(row.ids) == library.encode_ordinary(texts[row.doc_id] or "")
        assert bytes(row.decoded) == (texts[row.doc_id] or "").encode()


def test_merge_takes_least_rank_leftmost_first():
    ranks = {b"a": 0, b"b": 1, b"aa": 2, b"aab": 3}
    assert byte_bpe.merge(b"aaab", ranks) == [2, 0, 1]
    assert byte_bpe.merge(b"aab", ranks) == [3]


def test_perfect_hash_has_one_slot_per_key():
    keys = [str(i).encode() for i in range(5000)]
    table = byte_bpe.PerfectHash(keys)
    assert sorted(table.key_at) == list(range(5000))


def test_query_digests(spark, sf):
    ranks = byte_bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in queries.table(spark, sf, "documents").collect()}
    rows = queries.op10_byte_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = library.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def check_packed(rows, texts, window=2048):
    library = Tokenizer.from_file(JSON)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for key, mine in by_doc.items():
        ids = [*library.encode(texts[key] or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(mine, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and 0 < r.length <= window
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for mine in by_sequence.values():
        at = 0
        for r in sorted(mine, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return sum(r.length for r in rows) / (window * len(by_sequence))


def test_packing_of_odd_texts(odd):
    check_packed(packing.packed(odd, JSON, group_docs=100).collect(), dict(enumerate(odd_texts())))


def test_packing_query(spark, sf):
    texts = {r.doc_id: r.text for r in queries.table(spark, sf, "documents").collect()}
    assert check_packed(queries.op9_packing(spark, sf).collect(), texts) > 0.97


def test_best_fit_is_the_tightest_window():
    lengths = np.array([6, 5, 4, 3, 2, 9])
    bins, offsets = packing.best_fit(lengths, 10)
    assert bins[5] == 0 and bins[0] == bins[2] == 1 and bins[1] == bins[3] == bins[4] == 2
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 100, 500)
    bins, offsets = packing.best_fit(lengths, 100)
    rooms = {}
    for i in np.argsort(-lengths, kind="stable"):  # brute force
        fits = [(room, b) for b, room in rooms.items() if room >= lengths[i]]
        assert (rooms[bins[i]] == min(fits)[0]) if fits else bins[i] not in rooms
        rooms[bins[i]] = rooms.get(bins[i], 100) - lengths[i]


def test_empty_tables(spark, odd):
    none = odd.filter("false")
    assert byte_bpe.encode_and_decode(none, RANKS).collect() == []
    assert packing.packed(none, JSON).collect() == []
