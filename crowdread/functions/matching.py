"""Substring matching of term lists.

The rules only ask two things of a text: does any term of a list occur, and how many
different terms of a list occur. Two matchers answer them behind one interface:

* ``TextTerms`` asks the JVM, one ``contains`` per term. Best for one or two lists: it
  stays in generated code, short-circuits, and a filter on it is pushed to the scan.
* ``ScannedTerms`` reads what ``scan_terms`` found: one pass over the text finds the terms
  of all lists at once. The full analysis asks for about 600 terms per text, which as
  separate ``contains`` calls reads each text 600 times.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from crowdread.functions import lexicon

# Lists known to the one-pass scan; the list at place i is bit i of ``lists``.
SCANNED = (
    "INTENT_QUESTION", "INTENT_SUGGESTION", "INTENT_PRAISE", "INTENT_COMPLAINT",
    "PRAISE_NEGATION", "GENUINE_ANGER", "RULE_THANKS", "RULE_DELIGHT", "RULE_SURPRISE",
    "RULE_FEAR", "RULE_SADNESS", "RULE_ANGER", "PRAISE_WORDS", "JOY_WORDS", "ANGER_WORDS",
    "SADNESS_WORDS", "SURPRISE_WORDS", "FEAR_WORDS", "DISGUST_WORDS", "SINCERE_MARKERS",
    "SARCASM_SIGNALS", "HINGLISH_MARKERS", "HINGLISH_POSITIVE", "HELP_REQUESTS",
    "PRAISE_WITH_QUESTION_WORD", "CURIOUS_MARKERS", "CRITICISM_MARKERS", "REQUEST_WORDS",
    "COMPLIMENT_WORDS",
)
# Lists whose different terms are counted.
COUNTED = ("POSITIVE_TERMS", "NEGATIVE_TERMS", "POSITIVE_EMOJI")
#: Rows of a batch whose texts are Python strings at once; the others stay in Arrow's memory.
SLICE = 64


def minimal_terms(terms: tuple[str, ...]) -> list[str]:
    """Terms without those that hold another term: "thanks" adds nothing to "thank"."""
    return [t for t in terms if not any(o != t and o in t for o in terms)]


def quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


class TextTerms:
    """Term tests on a column of lower-cased text, given by name."""

    def __init__(self, lowered: str):
        self.text = f"`{lowered}`"

    def any(self, name: str) -> Column:
        tests = [f"contains({self.text}, {quoted(t)})" for t in minimal_terms(lexicon.terms(name))]
        return F.expr(f"coalesce({' OR '.join(tests)}, false)")

    def count(self, name: str) -> Column:
        hits = [f"int(contains({self.text}, {quoted(t)}))" for t in lexicon.terms(name)]
        return F.expr(f"coalesce({' + '.join(hits)}, 0)")


class ScannedTerms:
    """Term tests on text number ``n`` of a column made by ``scan_terms``, given by name."""

    def __init__(self, scan: str, n: int = 0):
        self.prefix = f"`{scan}`.t{n}_"

    def any(self, name: str) -> Column:
        return F.expr(f"({self.prefix}lists & {1 << SCANNED.index(name)}L) != 0")

    def count(self, name: str) -> Column:
        return F.expr(self.prefix + name.lower())


def scan_terms(*lowered: Column, lists: Sequence[str] = (*SCANNED, *COUNTED)) -> Column:
    """Finds the terms of the lists in one pass over each lower-cased text; other lists count as not found.

    Fields ``t0_...``, ``t1_...`` hold, for each text given, the bits of the lists with a term
    in it and the number of different terms for the counted lists. Texts that are equal, as raw
    and clean text mostly are, are searched once. The term tables travel with the function,
    so executors need no copy of this package. A batch is searched slice by slice, so that not all its texts
    are Python strings together.
    """
    names = [name.lower() for name in COUNTED]
    bits: dict[str, int] = {}
    counted: dict[str, tuple[int, ...]] = {}
    for i, name in enumerate(SCANNED):
        for t in lexicon.terms(name) if name in lists else ():
            bits[t] = bits.get(t, 0) | 1 << i
    for i, name in enumerate(COUNTED):
        for t in lexicon.terms(name) if name in lists else ():
            counted[t] = (*counted.get(t, ()), i)
    found = {t: (bits.get(t, 0), counted.get(t, ())) for t in (*bits, *counted)}
    none = (0,) * (1 + len(names))
    columns = [f"t{n}_{field}" for n in range(len(lowered)) for field in ("lists", *names)]
    kinds = [pa.int64() if c.endswith("_lists") else pa.int32() for c in columns]

    def scan(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for t in found:
            automaton.add_word(t, t)
        automaton.make_automaton()

        def one(text):
            hits = {t for _, t in automaton.iter(text)} if text else ()
            if not hits:
                return none
            lists, counts = 0, [0] * len(names)
            for t in hits:
                lists |= found[t][0]
                for i in found[t][1]:
                    counts[i] += 1
            return (lists, *counts)

        def row(texts):
            first = one(texts[0])
            others = [first if t == texts[0] else one(t) for t in texts[1:]]
            return sum(others, first)

        for batch in batches:
            texts = batch if isinstance(batch, tuple) else (batch,)
            rows = []
            for at in range(0, len(texts[0]), SLICE):
                rows += [row(t) for t in zip(*(c.slice(at, SLICE).to_pylist() for c in texts))]
            values = zip(*rows) if rows else [()] * len(columns)
            yield pa.StructArray.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], columns)

    fields = [
        T.StructField(c, T.LongType() if c.endswith("_lists") else T.IntegerType()) for c in columns
    ]
    return F.arrow_udf(scan, T.StructType(fields))(*lowered)
