"""Texts whose polynomial hashes modulo 2**64 are equal for every base and seed."""

import hashlib
import random

import numpy as np
import pytest
import tiktoken
import public_tokenizers
from tokenizers import Tokenizer

from crowdread.llm import byte_bpe, minhash, packing, phrase_dedup, suffix_dedup
from crowdread.llm import bytetext as bt


def pair(size, letters="ab"):
    """A Thue-Morse word over two letters and its complement."""
    bits = [bin(i).count("1") % 2 for i in range(size)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


@pytest.mark.parametrize("size", [1024, 4096])
@pytest.mark.parametrize("seed", [0, 1, 22])
def test_segments(size, seed):
    one, two = (np.frombuffer(x.encode(), np.uint8) for x in pair(size))
    data = np.concatenate([one, two, one])
    starts = np.arange(3) * size
    a, b, c = bt.segment_hashes(data, starts, starts + size, seed)
    assert a == c != b


def test_short_and_long_segments_of_one_text():
    rng = random.Random(1)
    text = bytes(rng.choice(b"ab") for _ in range(500))
    spans = [(a, b) for a in range(0, 400, 7) for b in range(a, min(500, a + 90))]
    starts, ends = np.array(spans).T
    hashes = bt.segment_hashes(np.frombuffer(text, np.uint8), starts, ends)
    of = {}
    for (a, b), h in zip(spans, hashes.tolist()):
        assert of.setdefault(text[a:b], h) == h
    assert len(set(of.values())) == len(of)


def test_op10_and_op9(spark):
    one, two = pair(1024)
    rows = [(1, one), (2, two), (3, f"{one} x {two}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.ids, bytes(r.decoded).decode()) for r in
           byte_bpe.encode_and_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()}
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    assert got == {k: (library.encode(t), t) for k, t in rows}
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    import zlib
    want = {k: zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for k, t in rows}
    assert {r.doc_id: r.ids_crc32 for r in packing.packed(docs, path).collect()} == want


def test_op5(spark):
    one, two = pair(1024)
    common = [f"w{i}" for i in range(12)]
    docs = spark.createDataFrame([(1, " ".join([one, *common])), (2, " ".join([two, *common])), (3, " ".join([one, *common]))], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 3, 90).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_op8(spark):
    one, two = pair(1024)
    common = [f"w{i}" for i in range(12)]
    rows = [(1, " ".join([one, *common])), (2, " ".join([two, *common])), (3, " ".join([one, *common]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in phrase_dedup.dedup(docs).collect()} == {1: 0, 2: 0, 3: 13}


def test_op7(spark):
    one, two = pair(4096)
    rng = random.Random(2)
    noise = lambda: "".join(rng.choice("cdefgh") for _ in range(300))
    rows = [(1, noise() + one[:1024] + noise()), (2, noise() + two[:1024] + noise()), (3, noise() + one[:1024])]
    seen = {}
    texts = {k: t.encode() for k, t in rows}
    for k, t in texts.items():
        for i in range(len(t) - 399):
            seen.setdefault(t[i : i + 400], []).append((k, i))
    gone = {k: set() for k in texts}
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                gone[k].update(range(i, i + 400))
    want = {k: hashlib.sha256(bytes(b for i, b in enumerate(t) if i not in gone[k])).hexdigest() for k, t in texts.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: hashlib.sha256(bytes(r.kept)).hexdigest() for r in suffix_dedup.dedup(docs).collect()}
    assert got == want


def test_powers_are_little_longer_than_a_slice():
    """Each worker keeps two tables of powers; a slice may end with a long text."""
    up, down = bt.powers_for(bt.SLICE_BYTES + 200_000)
    assert len(up) >= bt.SLICE_BYTES + 200_000 and up.nbytes + down.nbytes <= 32 << 20
