import hashlib
import random
import re

import numpy as np
import pytest

from crowdread.llm import licences, pii, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    """The contract's patterns over the whole text."""
    text = text or ""
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(re.sub(r"\D", "", m[0])) <= 19 and pii.luhn(re.sub(r"\D", "", m[0]))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return out


def odd_texts():
    rng = random.Random(9)
    parts = ["a", "é", "@", ".", "-", " ", "  ", "\n", "+", "(", ")", "1", "42", "255", "256", "0", "4111111111111111", "4111 1111 1111 1111", "+1 (988) 555-2485", "x.y@b.co", "1.2.3.4", "%", "٣", " "]
    return [None, "", " ", "a@b@c.d.e", "1" * 3000, "a" * 3000 + "@", "x@y.z " * 500, *("".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000))]


def test_base_spans_equal_the_patterns(spark):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    for r in pii.found(docs).collect():
        base = [tuple(s) for s in r.base]
        assert base == plain(texts[r.doc_id]), texts[r.doc_id]
        spans = [tuple(s) for s in r.spans]
        assert set(base) <= set(spans)
        assert all(0 <= s < e <= len(texts[r.doc_id]) for _, s, e in spans)
        assert not any(a[1] < b[2] and b[1] < a[2] for a in set(spans) - set(base) for b in base)


def test_query_and_added_spans(spark, sf):
    texts = {r.doc_id: r.text for r in queries.table(spark, sf, "documents").collect()}
    rows = queries.op1_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[0] == k for b in base) for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(r.spans.split(","))


def test_field_finds_variants(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    field = pii.fitted(docs, 500, "text")
    for text, kind in (("call (988) 555-2485 now", 3), ("to hsr.29[at]mail5.example.com", 0), ("4111.1111.1111.1111", 2)):
        assert kind in [k for k, _, _ in pii.added(field, text.split(" ", 1)[-1] if kind == 3 else text, [])], text
    for text in ("version 4.0", "in 1999 and 2004", "token 80caf00312470a19c410a04f46e97e3432b5bd"):
        assert pii.added(field, text, []) == []


def test_dynamic_programming_is_the_best_segmentation():
    rng = random.Random(3)
    field = pii.fit([pii.example("+1 (988) 555-2485 and"), pii.example("1.2.3.4 x@y.zz 7")])
    words = ["+1", "(98)", "5-24", "x@y.zz", "7"]
    scores = field.scores(words)

    def every(i, last):
        if i == len(words):
            yield 0.0, []
        for j in range(i + 1, len(words) + 1):
            for k in range(5):
                if (i, j) in scores and scores[i, j][k] > -1e9:
                    for rest, segments in every(j, k):
                        yield scores[i, j][k] + field.pairs[last, k] + rest, ([(i, j, k)] if k < 4 else []) + segments

    assert max(every(0, 4))[1] == field.best(words)
    assert rng is not None


def test_masking(spark):
    docs = spark.createDataFrame([(1, "née a.b@c.de\nip 1.2.3.4 end", "x"), (2, None, "y"), (3, "nothing here", "z")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.text for r in pii.masked(docs).collect()}
    assert got == {1: "née <email>\nip <ip> end", 2: None, 3: "nothing here"}
    assert pii.masked(docs.filter("false")).collect() == [] and pii.found(docs.filter("false")).collect() == []


def test_licence_families(spark):
    texts = [
        None, "", "Licensed under CC BY-NC 4.0.\nwords", "x\nThis work is licensed under the GNU General Public License, version 3.",
        "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "All rights reserved.",
        "He lost his driving license in the city.", "Asking for permission is polite.\n" * 50, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.",
    ]
    plain_lines = queries.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").filter("doc_id >= 100")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").union(plain_lines)
    got = {r.doc_id: r for r in licences.licences(docs).collect()}
    assert [got[i].families for i in range(10)] == ["", "", "cc-by-nc", "gpl", "apache", "mit", "proprietary", "", "", "apache,mit"]
    assert got[8].n_unknown == got[8].n_lines == 0  # prose with a word of a notice speaks of no licence
    assert got[4].n_lines == 1 and got[9].n_lines == 2 and got[9].n_unknown == 0


def test_licence_query_is_native_and_finds_planted_lines(spark, sf):
    df = queries.op2_licences(spark, sf)
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
    names = {"CC BY-NC": "cc-by-nc", "GNU General": "gpl", "Apache License": "apache", "MIT License": "mit"}
    texts = {r.doc_id: r.text for r in queries.table(spark, sf, "documents").collect()}
    for r in df.collect():
        lines = [x for x in texts[r.doc_id].split("\n") if re.search("(?i)licensed under|released under", x)]
        assert {names[n] for x in lines for n in names if n in x} <= set(r.families.split(",")), lines


#: Short and wrapped notices, and what only resembles one.
NOTICES = [
    ("MIT License", "mit"), ("SPDX-License-Identifier: MIT", "mit"), ("BSD 3-Clause License", "bsd"), ("GNU GENERAL PUBLIC LICENSE", "gpl"),
    ("Apache License", "apache"), ("Licensed under CC BY 4.0.", "cc-by"), ("This text is available under CC BY-NC 4.0.", "cc-by-nc"),
    ("Distributed under the terms of the GNU GPL v3.", "gpl"), ("CC BY 4.0", "cc-by"), ("SPDX-License-Identifier: Apache-2.0", "apache"),
    ("GNU LESSER GENERAL PUBLIC LICENSE", "lgpl"), ("Licensed under CC BY-SA 4.0.", "cc-by-sa"), ("Mozilla Public License", "mpl"),
    ("Permission is hereby granted, free\n  of charge, to any person\n  obtaining a copy of\n  this software.", "mit"),
    ("This work is licensed under\nthe GNU General\nPublic License, version 3.", "gpl"), ("MIT License\nApache License", "apache,mit"),
    ("He got his license at MIT.", ""), ("General Clause met the public by 4.0 points.", ""), ("The software of the city\nis free for any person", ""),
]


def test_short_and_wrapped_notices(spark):
    plain_lines = queries.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").filter("doc_id >= 100")
    rows = [(1000 + i, text) for i, (text, _) in enumerate(NOTICES)]
    got = {r.doc_id: r for r in licences.licences(spark.createDataFrame(rows, "doc_id long, text string").union(plain_lines)).collect()}
    assert [(text, got[k].families) for k, text in rows] == NOTICES
    assert got[1013].n_unknown == got[1014].n_unknown == 0


def test_limits_come_from_rows_left_out_of_the_fit(spark):
    """A line that resembles a licence and no notice confirms counts as a negative, wherever it stands."""
    text = "\n".join(f"plain words number {i} of this text." for i in range(20))
    rows = [(i, f"{text}\nan apache chief has a license version {i}.") for i in range(30)]
    model = licences.fit(spark.createDataFrame(rows, "doc_id long, text string"), sample=2000)
    assert set(model.least) == {f for f, _, _ in licences.notices()} and all(x >= 0.5 for x in model.least.values())
    rows = licences.with_words(spark.createDataFrame([("an apache chief has a license version 99.",)], "line string"))
    assert licences.scored(rows, model).first().guess == licences.UNKNOWN


def test_many_addresses_in_one_text_take_linear_time():
    import time

    class Field:
        def best(self, words):
            return []

    words = [w for i in range(100_000) for w in (f"user{i}@mail{i % 7}.example.org", "or", f"x{i}")]
    text = " ".join(words)
    begin = time.process_time()
    base = pii.base_spans(text)
    assert len(base) == 100_000 and pii.added(Field(), text, base) == []
    assert time.process_time() - begin < 60


def test_free_words_are_those_that_no_base_span_overlaps(monkeypatch):
    rng = random.Random(2)
    seen = []

    class Field:
        def best(self, words):
            seen.extend(words)
            return []

    for _ in range(200):
        text = " ".join("".join(rng.choice("ab1") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 12)))
        cuts = [sorted(rng.sample(range(len(text) + 1), 2)) for _ in range(rng.randint(0, 4))] if len(text) > 1 else []
        base = [(0, a, b) for a, b in cuts]
        seen.clear()
        pii.added(Field(), text, base)
        want = [m[0] for m in pii.WORDS.finditer(text) if not any(m.start() < e and s < m.end() for _, s, e in base)]
        assert seen == want


def test_unknown_licences_and_prose(spark):
    plain_lines = queries.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    odd = ["Licensed under the Foo Public License, version 7.", "This program is licensed under the terms of the Bar software license."]
    rows = [(1000 + i, text) for i, text in enumerate(odd)]
    got = {r.doc_id: r for r in licences.licences(spark.createDataFrame(rows, "doc_id long, text string").union(plain_lines)).collect()}
    assert [(got[k].n_lines, got[k].n_unknown, got[k].families) for k, _ in rows] == [(1, 1, "")] * 2
    assert sum(r.n_unknown > 0 for k, r in got.items() if k < 1000) <= 0.05 * len(got)


def test_repeated_rows_and_rows_without_id(spark):
    mit, gpl = "Released under the MIT License.\nwords", "x\nThis work is licensed under the GNU General Public License, version 3."
    rows = [(7, mit), (7, mit), (7, mit), (8, mit), (8, gpl), (None, mit), (None, gpl), (None, None), (9, None)]
    plain_lines = queries.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").filter("doc_id >= 100")
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_lines int")
    got = licences.licences(docs.select("doc_id", "text").union(plain_lines)).filter("doc_id IS NULL OR doc_id < 100").collect()
    want = [(7, 1, 0, "mit")] * 3 + [(8, 1, 0, "mit"), (8, 1, 0, "gpl"), (None, 1, 0, "mit"), (None, 1, 0, "gpl"), (None, 0, 0, ""), (9, 0, 0, "")]
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)
    assert licences.licences(docs).count() == len(rows) and licences.licences(docs.limit(0)).collect() == []


def test_spelled_at_signs_are_looked_at_without_digits(spark):
    mails = [(i, f"write to {a}.{b}@{c}.example.com or call +1 (9{i:02d}) 555-2485 now") for i, (a, b, c) in enumerate(
        (a, b, c) for a in ("ann", "bob", "eve") for b in ("kay", "lee", "moe") for c in ("post", "mail", "web"))]
    texts = ["plain words (at] no", "please write to john.roe[at]mail.example.com today", "one more text ends with [a", "t] here", "no address, at all"]
    docs = spark.createDataFrame([*mails, *((100 + i, x) for i, x in enumerate(texts))], "doc_id long, text string").coalesce(1)
    rows = {r.doc_id: r for r in pii.found(docs).collect()}
    start = texts[1].index("john")
    assert [tuple(s) for s in rows[101].spans] == [("email", start, start + len("john.roe[at]mail.example.com"))] and rows[101].base == []
    assert not any(rows[100 + i].spans for i in (2, 3, 4))
    for text, wanted in ((texts[1], 1), (texts[4], 0)):
        data = np.frombuffer(text.encode(), np.uint8)
        assert len(pii.islands(data, np.array([0, len(data)]))[0]) == wanted


def test_limits_know_every_line_of_the_corpus(spark):
    """Eight lines of 1,208 resemble a licence: half of them, by hash, are above no limit, however few lines the corpus weighs as."""
    rows = [(i, "\n".join(f"plain words number {i} of text {k}." for k in range(40))) for i in range(30)]
    rows += [(100 + i, f"an apache chief has a license version {i}.") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = licences.fit(docs, sample=20)
    lines = licences.with_words(spark.createDataFrame([(r[1],) for r in rows[30:]], "line string"))
    for r in licences.scored(lines, model).collect():
        assert r.guess == licences.UNKNOWN or r.score <= model.least[r.guess]
    # Lines are counted, not drawn: three copies of the corpus have the same limits, up to the rounding of the fit.
    again = licences.fit(docs.union(docs).union(docs), sample=20)
    assert all(abs(again.least[f] - x) < 1e-6 for f, x in model.least.items()) and abs(again.licence - model.licence) < 1e-3
