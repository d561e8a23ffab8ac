"""Quality rules: text statistics and a decision list learned by sequential covering.

Everything here is DataFrame expressions; the learner sees only counts by feature and bin, so what
reaches the driver is bounded by (features x bins) whatever the size of the labelled table.

Null text counts as empty (no words, fails the base rule). Empty label tables learn no rule, and the
verdict is then the base rule alone. Repeated label rows of a document count once, worst label wins;
labels without a document, or null, are ignored. Extra columns are carried through unread; columns
the operator adds start with ``q_`` except the documented statistics.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, stored

#: Characters that separate words, besides the space.
GAPS = "\t\n\x0b\x0c\r"

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "q_upper", "q_bangs", "q_lines", "q_distinct")


def windows(hashes: Column) -> Column:
    """Hashes of the 3-word windows, in order, from the words' hashes."""
    mixed = F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)))
    return F.slice(mixed, 1, F.greatest(F.size(hashes) - 2, F.lit(0)))


def text_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds STATS to ``docs``; every statistic is computed over the whole text.

    Repeated words are those in a 3-word window found twice or more in the text, first included;
    windows are compared by 64-bit hash, and only texts with some repeated window are sorted.
    """
    flat = F.coalesce(F.col(text), F.lit(""))
    for gap in GAPS:
        flat = F.replace(flat, F.lit(gap), F.lit(" "))
    marks = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[^#*$%&|<>!\p{Lu}]+", "")
    out = docs.withColumns({"_flat": flat, "_marks": marks, "_lines": F.split(F.coalesce(F.col(text), F.lit("")), "\n")})
    out = out.withColumn("_words", F.transform(F.array_remove(F.split("_flat", " "), ""), lambda x: F.xxhash64(x)))
    out = out.withColumns(
        {
            "_grams": windows(F.col("_words")),
            "_chars": F.length(F.replace("_flat", F.lit(" "), F.lit(""))),
            "_signs": F.regexp_replace("_marks", r"[!\p{Lu}]+", ""),
            "_full": F.filter("_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        }
    )
    out = out.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_grams")) < F.size("_grams"),
            F.sort_array(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    )
    out = out.withColumn(
        "_found",
        F.sort_array(
            F.transform(
                F.filter("_sorted", lambda x, i: (F.get("_sorted", i + 1)["h"] == x["h"]) | ((i > 0) & (F.get("_sorted", i - 1)["h"] == x["h"]))),
                lambda x: x["i"],
            )
        ),
    )
    steps = F.transform("_found", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_found", k + 1), p + 3) - p))
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.col("_chars").cast("long"),
            "n_symbols": F.length("_signs").cast("long"),
            "n_dup_lines": (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"),
            "n_repeat_words": F.aggregate(steps, F.lit(0), lambda a, x: a + x).cast("long"),
            "q_upper": F.length(F.regexp_replace("_marks", r"\P{Lu}+", "")).cast("long"),
            "q_bangs": F.length(F.regexp_replace("_marks", "[^!]+", "")).cast("long"),
            "q_lines": F.size("_full").cast("long"),
            "q_distinct": F.size(F.array_distinct("_words")).cast("long"),
        }
    )
    return out.drop("_flat", "_marks", "_lines", "_words", "_grams", "_chars", "_signs", "_full", "_sorted", "_found")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> dict[str, Column]:
    """What conditions of learned rules test, by name."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return {
        "words": F.col("n_words").cast("double"),
        "mean_word_chars": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_lines_per_line": F.col("n_dup_lines") / F.greatest(F.col("q_lines"), F.lit(1)).cast("double"),
        "repeat_words_share": F.col("n_repeat_words") / words,
        "upper_share": F.col("q_upper") / chars,
        "bangs_per_word": F.col("q_bangs") / words,
        "distinct_words_share": F.col("q_distinct") / words,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def all_of(rule: Rule) -> Column:
    out = rule[0].column()
    for condition in rule[1:]:
        out = out & condition.column()
    return out


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional: the first rule that holds rejects, else keep."""
    out = None
    for rule in rules:
        out = F.when(all_of(rule), F.lit(False)) if out is None else out.when(all_of(rule), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def learn(
    labelled: DataFrame,
    target: str = "q_bad",
    key: str = "doc_id",
    bins: int = 48,
    max_rules: int = 8,
    max_conditions: int = 4,
    min_precision: float = 0.95,
    min_cover: float = 0.01,
) -> list[Rule]:
    """Sequential covering over ``labelled`` (STATS and a boolean ``target``, true for rows to reject).

    Two thirds of the rows (by hash of the key) grow a conjunction by information gain, one third
    prunes it: the prefix with the best (p - n) / (p + n) stays. A rule is kept if its precision on
    the pruning rows is at least ``min_precision`` and it covers ``min_cover`` of their positives.
    Rows that a rule covers leave, and the next rule is learned from the rest. Thresholds are
    quantiles of each class. All counts cover all labelled rows.
    """
    names = list(features())
    fraction = [i / bins for i in range(bins + 1)]
    cuts_row = (
        labelled.select(target, *(c.alias(k) for k, c in features().items()))
        .groupBy(target)
        .agg(*(F.percentile_approx(k, fraction, 10_000).alias(k) for k in names))
        .collect()
    )
    cuts = {k: sorted({float(v) for row in cuts_row for v in (row[k] or [])}) for k in names}
    if not any(cuts.values()):
        return []
    binned = {k: _cuts_below(c, cuts[k]) for k, c in features().items()}
    rows = stored(
        labelled.select(
            F.col(target).alias("bad"),
            (F.pmod(F.xxhash64(F.col(key)), F.lit(3)) == 0).alias("prune"),
            F.lit(True).alias("left"),
            *(c.alias(f"b_{k}") for k, c in binned.items()),
        ),
        "rule-bins",
    )

    def holds(conditions: list[tuple[str, bool, int]]) -> Column:
        out = F.lit(True)
        for name, above, cut in conditions:
            out = out & ((F.col(f"b_{name}") > cut) if above else (F.col(f"b_{name}") <= cut))
        return out

    rules: list[Rule] = []
    covered = F.lit(False)
    while len(rules) < max_rules:
        grown: list[tuple[str, bool, int]] = []
        while len(grown) < max_conditions:
            # bin k holds values in (cuts[k-1], cuts[k]]: "bin <= k" is "value <= cuts[k]"
            counts = (
                rows.filter(~covered & ~F.col("prune") & holds(grown))
                .select("bad", F.posexplode(F.array(*(F.col(f"b_{k}") for k in names))).alias("feature", "bin"))
                .groupBy("feature", "bin")
                .agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n"))
                .collect()
            )
            best = _best_cut(counts, names, cuts)
            if best is None:
                break
            grown.append(best)
        if not grown:
            break
        prefixes = [grown[: i + 1] for i in range(len(grown))]
        tested = rows.filter(~covered & F.col("prune")).agg(
            *(F.count_if(holds(c) & F.col("bad")).alias(f"p{i}") for i, c in enumerate(prefixes)),
            *(F.count_if(holds(c) & ~F.col("bad")).alias(f"n{i}") for i, c in enumerate(prefixes)),
            F.count_if("bad").alias("all"),
        ).first()
        worth = lambda i: (tested[f"p{i}"] - tested[f"n{i}"]) / max(1, tested[f"p{i}"] + tested[f"n{i}"])
        pick = max(range(len(grown)), key=lambda i: (worth(i), -i))
        p, n = tested[f"p{pick}"], tested[f"n{pick}"]
        if not p or p < min_precision * (p + n) or p < min_cover * tested["all"]:
            break
        rules.append(tuple(Condition(name, above, cuts[name][cut]) for name, above, cut in prefixes[pick]))
        covered = covered | holds(prefixes[pick])
    return rules


def _cuts_below(value: Column, cuts: list[float]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut < value))


def _best_cut(counts: list, names: list[str], cuts: dict[str, list[float]]) -> tuple[str, bool, int] | None:
    """The condition with the largest information gain, or None if none gains; ties: first listed."""
    tally: dict[int, dict[int, tuple[int, int]]] = {}
    for row in counts:
        tally.setdefault(row["feature"], {})[row["bin"]] = (row["p"], row["n"])
    best, best_gain = None, 1e-9
    for index, name in enumerate(names):
        own = tally.get(index, {})
        p0, n0 = sum(p for p, _ in own.values()), sum(n for _, n in own.values())
        if not p0 or not n0:
            continue
        below_p = below_n = 0
        for cut in range(len(cuts[name])):
            p, n = own.get(cut, (0, 0))
            below_p, below_n = below_p + p, below_n + n
            for above, p1, n1 in ((False, below_p, below_n), (True, p0 - below_p, n0 - below_n)):
                if p1:
                    gain = p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0)))
                    if gain > best_gain:
                        best, best_gain = (name, above, cut), gain
    return best


def labelled_stats(stats: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """STATS of labelled rows with ``q_bad``: true where the worst quality label of the key is 0."""
    worst = labels.filter(F.col(key).isNotNull() & F.col("quality").isNotNull()).groupBy(key).agg((F.min("quality") == 0).alias("q_bad"))
    return stats.select(key, *STATS).join(worst, key)


def quality_rules(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[Rule]]:
    """Statistics and verdict for each row of ``docs`` (doc_id, text), and the learned rules.

    Result: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    and the further statistics that rules may test.
    """
    stats = stored(text_stats(docs.select("doc_id", "text")).drop("text"), "text-stats")
    rules = learn(stored(labelled_stats(stats, labels), "labelled-stats"))
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & verdict(rules)), rules


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the base rule and the learned rules keep, columns unchanged.

    Texts are read twice, for the statistics of labelled rows and for the verdict, and never moved. The
    statistics pass through a generator, so that the optimizer does not repeat them in every condition.
    """
    with scratch(docs.sparkSession):
        stats = stored(text_stats(docs.select("doc_id", "text")).drop("text"), "text-stats")
        rules = learn(stored(labelled_stats(stats, labels), "labelled-stats"))
    own = text_stats(docs.select(F.struct("*").alias("doc"), "text")).select("doc", F.inline(F.array(F.struct(*STATS))))
    return own.filter(~base_failed() & verdict(rules)).select("doc.*")
