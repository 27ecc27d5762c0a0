"""Personal data: base patterns, and spans added by a semi-Markov conditional random field.

Base spans are the leftmost matches of four patterns that pass their checks. The field works on islands:
runs of words with digits, an at sign, written or spelled as ``[at]``, or only phone signs. No base match reaches out of an island, and
each example of an entity has a digit or such a sign, so the rest of a text needs no decoding. A candidate segment is a run of words of an island;
its features describe the whole span (shape, digits, checks, neighbours), and dynamic programming over
segments of at most ``LONGEST`` words chooses boundaries and kinds together. The weights are fitted
by the exact gradient on at most ``SAMPLE`` texts whose base spans are the labels, with variants of them
(no plus sign, other separators, a spelled at sign). Added spans never overlap base ones.

Null and empty texts have no spans. Texts of any length are searched whole. Repeated rows are searched
each; only the named columns are read.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crowdread.llm import bytetext as bt

KINDS = ("email", "ip", "card", "phone")
# The four base patterns; the first two start where a run of their characters starts.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LONGEST = 6
SAMPLE = 2000

TRIGGER = np.zeros(256, bool)
TRIGGER[list(b"0123456789@")] = True
SPELLED = re.compile(rb"[(\[]at[)\]]")
LOOSE = np.zeros(256, bool)
LOOSE[list(b"().+-")] = True


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] != "@" and EMAIL_LETTER[min(ord(text[start - 1]), 128)]:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


EMAIL_LETTER = [chr(i).isalnum() or chr(i) in "._%+-" for i in range(128)] + [False]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind and start."""
    out = [(0, *s) for s in emails(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:] or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = digits_of(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


@lru_cache(maxsize=1 << 16)
def shape(text: str) -> str:
    """Letters as a, digits as 0; runs are kept up to four signs."""
    kinds = "".join("0" if "0" <= c <= "9" else "a" if c.isalpha() else c for c in text)
    return re.sub(r"(.)\1{4,}", r"\1\1\1\1+", kinds)[:40]


def features(words: list[str], i: int, j: int) -> list[str]:
    """Features of the whole segment words[i:j]."""
    span = " ".join(words[i:j]).strip(".,;:!?\"'")
    digits = digits_of(span)
    parts = span.split(".")
    return [
        "bias", f"words={j - i}", "shape=" + shape(span), f"digits={min(len(digits), 20)}", f"at={span.count('@')}",
        f"points={min(span.count('.'), 4)}", f"dashes={min(span.count('-'), 4)}", f"plus={span[:1] == '+'}",
        f"bracket={'(' in span}", f"letters={any(c.isalpha() for c in span)}",
        f"octets={len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)}",
        f"card={13 <= len(digits) <= 19 and luhn(digits)}", f"spelled={bool(re.search(r'[(\[]at[)\]]', span))}",
        f"domain={bool(re.search(r'[a-z]\.[a-z]{2,}$', span))}",
        "left=" + (shape(words[i - 1])[:8] if i else "^"), "right=" + (shape(words[j])[:8] if j < len(words) else "$"),
    ]


class Field:
    """Semi-Markov field over kinds 0..3 and outside (4, single words), with weights per kind and kind pair."""

    def __init__(self, weights: dict[tuple[str, int], float], pairs: np.ndarray):
        self.weights, self.pairs = weights, pairs

    def scores(self, words: list[str]) -> dict[tuple[int, int], list[float]]:
        n, get = len(words), self.weights.get
        out = {}
        for i in range(n):
            for j in range(i + 1, min(n, i + LONGEST) + 1):
                f = features(words, i, j)
                out[i, j] = [sum(get((x, k), 0.0) for x in f) if k < 4 or j == i + 1 else -math.inf for k in range(5)]
        return out

    def best(self, words: list[str]) -> list[tuple[int, int, int]]:
        """The segments (i, j, kind) of the best segmentation, outside words left out."""
        n, scores = len(words), self.scores(words)
        best = np.full((n + 1, 5), -np.inf)
        back: dict[tuple[int, int], tuple[int, int]] = {}
        best[0, 4] = 0.0
        for j in range(1, n + 1):
            for i in range(max(0, j - LONGEST), j):
                reach = best[i][:, None] + self.pairs
                for k in range(5):
                    p = int(reach[:, k].argmax())
                    value = reach[p, k] + scores[i, j][k]
                    if value > best[j, k]:
                        best[j, k], back[j, k] = value, (i, p)
        out, j, k = [], n, int(best[n].argmax())
        while j:
            i, p = back[j, k]
            if k < 4:
                out.append((i, j, k))
            j, k = i, p
        return out[::-1]

    def gradient(self, words: list[str], truth: list[tuple[int, int, int]]) -> tuple[Counter, np.ndarray]:
        """Observed less expected counts of features and kind pairs."""
        n, scores = len(words), self.scores(words)
        ahead, behind = np.full((n + 1, 5), -np.inf), np.full((n + 1, 5), -np.inf)
        ahead[0, 4] = 0.0
        behind[n] = 0.0
        total = lambda x, axis=None: np.logaddexp.reduce(x, axis=axis)
        for j in range(1, n + 1):
            parts = [total(ahead[i][:, None] + self.pairs, 0) + scores[i, j] for i in range(max(0, j - LONGEST), j)]
            ahead[j] = total(np.array(parts), 0)
        for i in range(n - 1, -1, -1):
            parts = [total(self.pairs + (np.array(scores[i, j]) + behind[j])[None], 1) for j in range(i + 1, min(n, i + LONGEST) + 1)]
            behind[i] = total(np.array(parts), 0)
        norm = total(ahead[n])
        grad, pairs = Counter(), np.zeros((5, 5))
        for (i, j), score in scores.items():
            p = np.exp(ahead[i][:, None] + self.pairs + (np.array(score) + behind[j])[None] - norm)
            pairs -= p
            mass = p.sum(0)
            if mass.max() > 1e-4:
                for x in features(words, i, j):
                    for k in range(5):
                        grad[x, k] -= mass[k]
        last, at = 4, 0
        inside = {i: (j, k) for i, j, k in truth}
        while at < n:
            j, k = inside.get(at, (at + 1, 4))
            for x in features(words, at, j):
                grad[x, k] += 1
            pairs[last, k] += 1
            last, at = k, j
        return grad, pairs


def fit(examples: list[tuple[list[str], list[tuple[int, int, int]]]], rounds: int = 4, rate: float = 0.2) -> Field:
    """Weights by steps along the exact gradient, with their averages kept."""
    field = Field({}, np.zeros((5, 5)))
    order = random.Random(1)
    for step in range(rounds):
        order.shuffle(examples)
        for words, truth in examples:
            grad, pairs = field.gradient(words, truth)
            for key, value in grad.items():
                if abs(value) > 1e-4:
                    field.weights[key] = field.weights.get(key, 0.0) + rate / (1 + step) * value
            field.pairs = field.pairs + rate / (1 + step) * pairs
    return field


def islands(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the runs of words that can hold personal data, and their rows."""
    starts, ends, bounds = bt.word_spans(data, offsets)
    some = np.append(0, np.cumsum(TRIGGER[data]))
    other = np.append(0, np.cumsum(~LOOSE[data]))
    trigger = some[ends] > some[starts]
    for sign in SPELLED.finditer(data.tobytes()):
        word = int(np.searchsorted(starts, sign.start(), "right")) - 1
        if sign.end() <= ends[word]:  # else it runs over the end of a text
            trigger[word] = True
    hit = trigger | (other[ends] == other[starts])
    told = np.append(0, np.cumsum(trigger))
    at = np.flatnonzero(hit)
    rows = np.searchsorted(bounds, at, "right") - 1
    firsts, sizes = bt.runs(at, rows)
    keep = np.array([told[at[f + n - 1] + 1] > told[at[f]] for f, n in zip(firsts, sizes)], bool)
    firsts, sizes = firsts[keep], sizes[keep]
    return starts[at[firsts]], ends[at[firsts + sizes - 1]], rows[firsts]


WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def example(text: str) -> tuple[list[str], list[tuple[int, int, int]]]:
    """Words of an island and the word segments that its base spans cover."""
    spans = [m.span() for m in WORDS.finditer(text)]
    ends = [b for _, b in spans]
    truth: list[tuple[int, int, int]] = []
    for kind, a, b in sorted(base_spans(text), key=lambda s: (s[1], -s[2])):
        i, j = bisect_right(ends, a), bisect_left(ends, b) + 1
        if j - i <= LONGEST and (not truth or truth[-1][1] <= i):
            truth.append((i, j, kind))
    return [text[a:b] for a, b in spans], truth


def variants(words: list[str], truth: list[tuple[int, int, int]]) -> Iterator[tuple[list[str], list[tuple[int, int, int]]]]:
    """The example, and others in which its entities are written in another way."""
    yield words, truth
    for number, (i, j, kind) in enumerate(truth):
        span, new = words[i:j], None
        if kind == 3 and span[0].startswith("+") and len(span) > 1:
            new = span[1:]
        elif kind == 0 and len(span) == 1:
            new = [span[0].replace("@", "[at]")]
        elif kind == 2 and len(span) == 1 and len(span[0]) == 16:
            new = [".".join(span[0][k : k + 4] for k in (0, 4, 8, 12))]
        if new and not number:
            shift = len(new) - len(span)
            yield [*words[:i], *new, *words[j:]], [(i, i + len(new), kind), *((a + shift, b + shift, k) for a, b, k in truth[1:])]


def fitted(docs: DataFrame, sample: int, text: str) -> Field:
    """A field from a bounded sample of texts, taken by a hash of the text, so that it does not depend on the partitions."""
    # Hashes first: only the texts of the sample come to the driver.
    hashed = docs.filter(F.col(text).rlike("[0-9@]")).select(F.xxhash64(text).alias("h"), text)
    least = [r.h for r in hashed.select("h").distinct().orderBy("h").limit(sample).collect()]
    rows = hashed.filter(F.col("h") <= max(least)).dropDuplicates(["h"]).limit(sample).collect() if least else []
    texts = [r[1] for r in sorted(rows)]
    examples, seen = [], set()
    for value in texts:
        raw = value.encode("utf-8", "replace")
        for a, b, _ in zip(*islands(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))):
            if SPELLED.search(raw[a:b]):
                continue  # no base span says whether it is an address
            words, truth = example(raw[a:b].decode())
            if len(words) <= 4 * LONGEST and " ".join(map(shape, words)) not in seen:
                seen.add(" ".join(map(shape, words)))
                examples += list(variants(words, truth))
    return fit(examples[:sample])


def added(field: Field, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that the field finds and that no base span overlaps."""
    spans = [m.span() for m in WORDS.finditer(text)]
    out = []
    starts, ends = [a for a, _ in spans], [b for _, b in spans]
    covered = [0] * (len(spans) + 1)
    for _, s, e in base:  # the words that a base span overlaps stand together
        covered[bisect_right(ends, s)] += 1
        covered[bisect_left(starts, e)] -= 1
    free = [n == 0 for n in accumulate(covered)]
    at = 0
    while at < len(spans):  # words of base spans part the island
        end = at
        while end < len(spans) and free[end]:
            end += 1
        if end > at:
            for i, j, kind in field.best([text[a:b] for a, b in spans[at:end]]):
                a, b = spans[at + i][0], spans[at + j - 1][1]
                while a < b and text[a] in "\"'.,;:!?":
                    a += 1
                while b > a and text[b - 1] in "\"'.,;:!?":
                    b -= 1
                if b > a:
                    out.append((kind, a, b))
        at = max(end, at + 1)
    return out


def found(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, ``base`` and ``spans``: arrays of (kind, start, end) in code points, by kind and start."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, sample, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in bt.slices(batches, text):
            data, offsets = bt.text_bytes(batch.column(text))
            points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
            starts, ends, rows = islands(data, offsets)
            base: list[list] = [[] for _ in range(batch.num_rows)]
            every: list[list] = [[] for _ in range(batch.num_rows)]
            for a, b, row in zip(starts.tolist(), ends.tolist(), rows.tolist()):
                piece = data[a:b].tobytes().decode("utf-8", "replace")
                here = int(points[a] - points[offsets[row]])
                own = base_spans(piece)
                base[row] += [(k, here + s, here + e) for k, s, e in own]
                every[row] += [(k, here + s, here + e) for k, s, e in own + added(shared.value, piece, own)]
            named = [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in sorted(x)] for x in part], kind_type) for part in (base, every)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *named], ["doc_id", "base", "spans"])

    kinds = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(run, f"doc_id long, base {kinds}, spans {kinds}")


def masked(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The documents with each span replaced by its kind in angle brackets; of overlapping spans the first counts."""
    field = docs.sparkSession.sparkContext.broadcast(fitted(docs, sample, text))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bt.slices(batches, text):
            data, offsets = bt.text_bytes(batch.column(text))
            starts, ends, rows = islands(data, offsets)
            column = batch.column(text).to_pylist()
            change: dict[int, list[tuple[int, int, str]]] = {}
            for a, b, row in zip(starts.tolist(), ends.tolist(), rows.tolist()):
                piece = data[a:b].tobytes().decode("utf-8", "replace")
                own = base_spans(piece)
                out, done = [], 0
                for k, s, e in sorted(own + added(field.value, piece, own), key=lambda x: (x[1], x[0])):
                    if e > done:
                        out += [piece[done : max(s, done)], f"<{KINDS[k]}>"] if s >= done else []
                        done = e
                if done:
                    first = int(offsets[row])
                    change.setdefault(row, []).append((a - first, b - first, "".join(out) + piece[done:]))
            for row, parts in change.items():
                raw = column[row].encode()
                out, done = [], 0
                for a, b, new in parts:
                    out += [raw[done:a], new.encode()]
                    done = b
                column[row] = b"".join([*out, raw[done:]]).decode()
            columns = [pa.array(column, pa.string()) if c == text else batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, fields)
