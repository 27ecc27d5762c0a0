import pytest

import corpus_pipeline as cp
from crowdread.llm import queries
from test_byte_bpe_packing import check_packed
from test_minhash import WORD, roots
from test_pii_licences import plain
from test_phrase_dedup import brute


def test_stages_against_brute_force(spark, sf):
    docs = queries.table(spark, sf, "documents")
    before = docs
    texts = []
    for name, stage in cp.STAGES:
        after = cp.staged(stage(spark, before, sf), "stage")
        texts.append({r.doc_id: r.text for r in after.collect()} if name != "packing" else after.collect())
        if name != "packing":
            assert after.columns == docs.columns
        before = after
    good, single, phrases, masked, packed = texts
    everything = {r.doc_id: r.text for r in docs.collect()}
    scores = {r.doc_id: r.predicted for r in queries.op4_quality(spark, sf).collect()}
    assert good == {k: t for k, t in everything.items() if scores[k]}

    def shingles(t):
        w = WORD.findall(t.lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = {k: shingles(t) for k, t in good.items()}
    links = [(a, b) for a in sets for b in sets if a < b and (n := len(sets[a] & sets[b])) and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    assert set(single) == set(roots(sets, links).values())
    want = brute(list(single.items()))
    assert phrases == {k: (single[k] if not want[k][1] else want[k][2]) for k in single}
    assert set(masked) == set(phrases)
    for k, t in masked.items():
        assert not plain(t)
        if not plain(phrases[k]):
            assert t == phrases[k] or "<" in t
    check_packed(packed, masked)


ROWS = [
    (None, "free text without an id, a.b@c.de", "en", "s", 5), (None, None, None, None, None), (3, None, "en", "s", None), (3, None, "en", "s", None),
    (4, "", "en", "s", 0), (5, "word", None, None, 4), (6, "one two three four five six seven", "en", "s", 9),
    (6, "one two three four five six seven", "en", "s", 9), (7, "call +1 (988) 555-2485 now", "en", "s", 1),
]


@pytest.mark.parametrize("rows", [ROWS, []])
def test_stages_take_nulls_repeated_rows_and_empty_tables(spark, sf, rows):
    fields = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, "x", 2) for r in rows], f"{fields}, spans string, kept int")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == cp.COLUMNS, name
        assert out.count() <= len(rows) and out.filter("doc_id IS NULL").count() == sum(r[0] is None for r in rows), name
    packed = cp.STAGES[-1][1](spark, docs, sf)
    assert packed.count() == len(rows)


def test_stages_of_odd_rows(spark, sf):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(cp.STAGES)
    masked = stage["personal data"](spark, docs, sf)
    got = sorted(((r.doc_id, r.text) for r in masked.collect()), key=repr)
    want = [(k, t and t.replace("a.b@c.de", "<email>").replace("+1 (988) 555-2485", "<phone>")) for k, t, *_ in ROWS]
    assert got == sorted(want, key=repr)
    copies = stage["near-duplicate documents"](spark, docs, sf)
    assert sorted(((r.doc_id, r.text) for r in copies.collect()), key=repr) == sorted(((k, t) for k, t, *_ in ROWS), key=repr)
