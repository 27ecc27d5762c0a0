"""Language of texts by a character model that is fitted to labelled texts.

Letters are read in lower case, words stand between blanks, and every three characters within a word are a gram. The
model holds the log share of each of the ``VOCABULARY`` most frequent grams in each language; all others count as one that
no language has. A text's language is the one with the highest mean over its grams. It is unknown where the
text has no grams, where the second language is nearly as good, or where the text fits its own language worse than almost all
of that language's texts: the limit is taken from labelled texts that the model was not fitted to.

Texts are read whole, in Arrow batches. The model is a table of bounded size that goes to all tasks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

VOCABULARY = 20_000
UNKNOWN = "unknown"
#: Share of a language's own texts that may be told unknown, and the least log odds against the next language.
REFUSED, ODDS = 0.005, 3.0
PRIOR = 0.5
BLANK = 32
SLICE_CHARACTERS = 1 << 20


@cache
def letters() -> np.ndarray:
    """Which code points are letters or marks that belong to them."""
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)])


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all grams and the rows that they are in; null texts have none."""
    lowered = pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")).to_pylist()
    sizes = np.array([len(t) + 1 for t in lowered], np.int64)
    code = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(sizes)), sizes)
    letter = letters()[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first blank behind a word
    code, row = np.where(letter, code, BLANK)[keep].astype(np.uint64), row[keep]
    code, row = np.append(np.uint64(BLANK), code), np.append(0, row)
    middle = code[1:-1] != BLANK
    packed = (code[:-2] << np.uint64(42)) | (code[1:-1] << np.uint64(21)) | code[2:]
    return packed[middle], row[1:-1][middle]


def sliced(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of about ``SLICE_CHARACTERS``."""
    sizes = np.asarray(pc.utf8_length(texts).fill_null(0), np.int64)
    part = (np.cumsum(sizes) - sizes) // SLICE_CHARACTERS
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield texts.slice(a, b - a)


@dataclass(frozen=True)
class LanguageModel:
    """``weights``: one row per gram of the sorted ``codes`` and one for all others; ``limits``: the least mean weight of a text."""

    languages: tuple[str, ...]
    codes: np.ndarray
    weights: np.ndarray
    limits: np.ndarray

    def means_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The mean weight of each text under each language, and the number of its grams."""
        code, row = grams(texts)
        at = np.minimum(np.searchsorted(self.codes, code), max(0, len(self.codes) - 1))
        known = self.codes[at] == code if len(self.codes) else np.zeros(len(code), bool)
        at = np.where(known, at, len(self.codes))
        count = np.bincount(row, minlength=len(texts))
        sums = np.stack([np.bincount(row, self.weights[at, k], len(texts)) for k in range(len(self.languages))], axis=1)
        return sums / np.maximum(count, 1)[:, None], count

    def judged(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best language of each text, its log odds against the next one, and its mean weight."""
        means, count = self.means_of(texts)
        best = means.argmax(axis=1)
        rows = np.arange(len(best))
        others = means.copy()
        others[rows, best] = -np.inf
        odds = (means[rows, best] - others.max(axis=1)) * count
        return best, np.where(count > 0, odds, -np.inf), means[rows, best]

    def languages_of(self, texts: pa.Array) -> np.ndarray:
        best, odds, fit = self.judged(texts)
        names = np.array([*self.languages, UNKNOWN], object)
        return names[np.where((odds >= ODDS) & (fit >= self.limits[best]), best, len(self.languages))]


def fit_languages(labelled: DataFrame, text: str, label: str, held: Column, vocabulary: int = VOCABULARY) -> LanguageModel | None:
    """A model of the labelled texts; those where ``held`` is true are kept out of it and set the limits.

    Gram counts are summed per task before they are shuffled. None without a labelled text to fit to.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(label).alias("label"), held.alias("held")).filter("label IS NOT NULL")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = np.array(batch.column("label").to_pylist(), object)
            for texts in sliced(batch.column("text")):
                code, row = grams(texts)
                mine, kinds = kinds[: len(texts)], kinds[len(texts) :]
                for kind in dict.fromkeys(mine.tolist()):
                    found, n = np.unique(code[(mine == kind)[row]], return_counts=True)
                    columns = [pa.array([kind] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n)]
                    yield pa.RecordBatch.from_arrays(columns, ["label", "code", "n"])

    counts = rows.filter("NOT held").select("text", "label").mapInArrow(counted, "label string, code long, n long")
    counts = counts.groupBy("label", "code").agg(F.sum("n").alias("n"))
    by_code = counts.groupBy("code").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("of"))
    top = by_code.orderBy(F.desc("all"), "code").limit(vocabulary).collect()
    languages = tuple(sorted({k for r in top for k in r.of}))
    if not languages:
        return None
    top.sort(key=lambda r: r.code)
    table = np.array([[r.of.get(k, 0) for k in languages] for r in top] + [[0] * len(languages)], np.float64)
    weights = np.log((table + PRIOR) / (table.sum(axis=0) + PRIOR * len(table)))
    weights[-1] = weights[-1].min()  # a gram that no language has speaks for none
    none = np.full(len(languages), -np.inf)
    draft = LanguageModel(languages, np.array([r.code for r in top], np.uint64), weights, none)
    return LanguageModel(languages, draft.codes, weights, limits(rows.filter("held"), draft))


def limits(held: DataFrame, draft: LanguageModel) -> np.ndarray:
    """Per language the mean weight that all but a small share of its held-out texts reach; no limit where it has none."""

    def fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, done = batch.column("label").to_pylist(), 0
            for texts in sliced(batch.column("text")):
                best, odds, fit = draft.judged(texts)
                own = np.array([draft.languages[b] for b in best.tolist()], object) == np.array(kinds[done : done + len(texts)], object)
                own &= odds >= ODDS
                done += len(texts)
                yield pa.RecordBatch.from_arrays([pa.array(best[own]), pa.array(fit[own])], ["language", "fit"])

    rows = held.select("text", "label").mapInArrow(fits, "language long, fit double")
    found = rows.groupBy("language").agg(F.percentile_approx("fit", F.lit(REFUSED), F.lit(10_000)).alias("limit")).collect()
    out = np.full(len(draft.languages), -np.inf)
    for r in found:
        out[r.language] = r.limit
    return out


def language_of(text: Column, model: LanguageModel) -> Column:
    """The model's language of a text; null texts are unknown."""

    @F.pandas_udf("string")
    def detected(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            parts = [model.languages_of(t) for t in sliced(pa.array(batch, pa.string()))]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0, object))

    return detected(text)
