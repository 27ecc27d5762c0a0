"""Quality rules: text statistics and a learned decision list, in DataFrame functions only.

Sequential covering learns rules for low quality from labelled statistics: a rule grows by the threshold
with the best information gain until it is pure, is pruned on rows it was not grown on, and the rows it
covers are set aside. The rules become one ordered conditional expression; what no rule covers is
kept. Thresholds are quantiles, and rows are learned as bin numbers, so a step brings
back one count per statistic and bin. At most ``SAMPLE`` labelled rows are learned from.

Null and empty texts have no words and fail the base rule. Repeated rows are judged each. Without labels
the list is empty. Windows are compared by a 64-bit hash within one text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from crowdread.llm.staging import staged

SPACES = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
SAMPLE = 20_000
BINS = 24
MOST_RULES, MOST_TERMS, PURE, LEAST_ROWS = 8, 3, 0.9, 2
RATIOS = ("word_size", "symbol_share", "bar_share", "bang_share", "upper_share", "dup_line_share", "repeat_share", "distinct_share", "n_words")


def occurrences(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, signs, ""))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, the base statistics and the ratios that rules may use."""
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumn("w", F.array_remove(F.split("t", SPLIT), ""))
    rows = rows.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0))
    rows = rows.withColumn("n", F.size("w"))
    # The few signs that are counted, taken out in one pass over the text.
    rows = rows.withColumn("signs", F.regexp_replace("t", r"[^#*$%&|<>!A-Z]+", ""))
    starts = F.when(F.col("n") >= 3, F.sequence(F.lit(0), F.col("n") - 3)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("h", F.transform(starts, lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))))
    # Most texts repeat no window: their hashes need not be sorted with their places.
    repeats = F.size(F.array_distinct("h")) < F.size("h")
    placed = F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    rows = rows.withColumn("g", F.when(repeats, placed).otherwise(F.array().cast("array<struct<h:bigint,p:int>>")))
    twice = F.filter("g", lambda x, i: (F.get("g", i + 1)["h"] == x["h"]) | ((i > 0) & (F.get("g", i - 1)["h"] == x["h"])))
    rows = rows.withColumn("at", F.sort_array(F.transform(twice, lambda x: x["p"])))
    steps = F.transform("at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("at", i + 1) - p, F.lit(3))))
    rows = rows.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        occurrences(F.col("signs"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(steps, F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        occurrences(F.col("signs"), "|").alias("n_bars"),
        occurrences(F.col("signs"), "!").alias("n_bangs"),
        occurrences(F.col("signs"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        F.size(F.array_distinct("w")).alias("n_distinct"),
    )
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return rows.withColumns(
        {
            "word_size": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "word_chars"),
            "bar_share": share("n_bars", "n_words"), "bang_share": share("n_bangs", "n_words"),
            "upper_share": share("n_upper", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"), "distinct_share": share("n_distinct", "n_words"),
        }
    )


Term = tuple[int, str, int]


def holds(bins: Column, terms: list[Term]) -> Column:
    out = F.lit(True)
    for k, side, cut in terms:
        out = out & (bins[k] >= cut if side == ">=" else bins[k] < cut)
    return out


def gain(p: int, n: int, p0: int, n0: int) -> float:
    if not p:
        return -math.inf
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def learned_rules(labelled: DataFrame) -> list[list[tuple[str, str, float]]]:
    """Ordered conjunctions (statistic, >= or <, threshold) of low quality from rows with RATIOS and ``bad``."""
    sample = staged(labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select("doc_id", "bad", *RATIOS), "labelled")
    marks = [i / BINS for i in range(BINS + 1)]
    found = sample.agg(*[F.percentile_approx(c, marks, 10_000) for c in RATIOS]).first()
    if found is None or found[0] is None:
        return []
    values = [sorted(set(map(float, x))) for x in found]
    cuts = [[(a + b) / 2 for a, b in zip(x, x[1:])] for x in values]  # midway between quantiles
    number = lambda c, values: F.size(F.filter(F.lit(values).cast("array<double>"), lambda t: F.col(c) > t))
    bins = F.array(*[number(c, values) for c, values in zip(RATIOS, cuts)])
    rows = staged(sample.select("bad", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0).alias("grow"), bins.alias("bins")).coalesce(1), "bins")
    rules: list[list[Term]] = []
    left = F.lit(True)
    while len(rules) < MOST_RULES:
        terms: list[Term] = []
        while len(terms) < MOST_TERMS:
            counts = (
                rows.filter(left & F.col("grow") & holds(F.col("bins"), terms))
                .select("bad", F.posexplode("bins").alias("k", "bin")).groupBy("k", "bin")
                .agg(F.sum(F.col("bad").cast("int")).alias("p"), F.sum((~F.col("bad")).cast("int")).alias("n")).collect()
            )
            p0, n0 = (sum(r[c] for r in counts if r.k == 0) for c in ("p", "n"))
            if not p0 or not n0:
                break
            best = (0.0, None)
            for k in range(len(RATIOS)):
                for cut in range(1, len(cuts[k]) + 1):
                    high = [r for r in counts if r.k == k and r.bin >= cut]
                    p, n = sum(r.p for r in high), sum(r.n for r in high)
                    best = max(best, (gain(p, n, p0, n0), (k, ">=", cut)), (gain(p0 - p, n0 - n, p0, n0), (k, "<", cut)), key=lambda x: x[0])
            if best[1] is None:
                break
            terms.append(best[1])
        if not terms:
            break
        prefixes = [holds(F.col("bins"), terms[: i + 1]) for i in range(len(terms))]
        test = rows.filter(left & ~F.col("grow")).agg(
            *[F.coalesce(F.sum((c & (F.col("bad") == b)).cast("int")), F.lit(0)) for c in prefixes for b in (True, False)]
        ).first()
        worth = [((test[2 * i] + 1) / (test[2 * i] + test[2 * i + 1] + 2), test[2 * i], -i) for i in range(len(terms))]
        _, covered, at = max(worth)
        if covered < LEAST_ROWS or covered < PURE * (covered + test[1 - 2 * at]):
            break
        rules.append(terms[: 1 - at])
        left = left & ~holds(F.col("bins"), rules[-1])
    return [[(RATIOS[k], ">" if side == ">=" else "<=", cuts[k][cut - 1]) for k, side, cut in rule] for rule in rules]


def verdict(rules: list[list[tuple[str, str, float]]]) -> Column:
    """The ordered conditional expression: false at the first rule that holds, else true."""
    out = F
    for rule in rules:
        test = F.lit(True)
        for name, side, cut in rule:
            test = test & (F.col(name) > cut if side == ">" else F.col(name) <= cut)
        out = out.when(test, F.lit(False))
    return F.lit(True) if out is F else out.otherwise(F.lit(True))


def judged(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text") -> DataFrame:
    """Statistics with base_failed and kept."""
    stats = staged(statistics(docs, text), "statistics")
    truth = labels.filter(F.col(label).isNotNull()).select("doc_id", (F.col(label) == 0).alias("bad"))
    rules = learned_rules(stats.join(truth, "doc_id"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules))
