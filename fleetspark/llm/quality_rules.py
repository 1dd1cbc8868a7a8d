"""Quality rules: learned decision lists over text statistics, as ordered Spark conditions.

The statistics of every whole text are built-in expressions. From labelled rows a decision list for rejection
is learned by sequential covering: a rule (a conjunction of thresholds) grows greedily by information gain on
two thirds of the sample until it covers no good text, is pruned from its end on the other third, and is kept
while it is precise enough there; what it covers is taken away and the next rule is grown. The list becomes one
``when`` chain, the first rule that holds decides.

Learning takes ``most_labelled`` labelled rows at most, those with the smallest hash of the id; the statistics,
the base test and the list's application cover all rows.

Defined results. Null and empty texts have zero statistics and fail the base test. Ratios of texts without
words are zero. Without labels of both kinds there are no rules. A null label is no label. Rows that repeat an
id are judged each by its own text. Extra columns are carried along; a clash of names is an error.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspark.llm.common import cut

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\f\r"


def statistics(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) and the STATISTICS of each text.

    n_repeat_words: windows of three words are compared by a 64-bit hash within their own text. The windows
    that occur again are found by sorting (hash, position); their words are counted from the gaps between
    their sorted positions, so the work is n log n for a text of any length.
    """
    keep = docs.columns if keep is None else keep
    if clash := set(STATISTICS) & set(keep):
        raise ValueError(f"columns {sorted(clash)} are there already; rename them")
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(
        *keep,
        F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.length(F.translate(text, _BLANKS, "")).alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
    )
    windows = split.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.col("word_chars").cast("long"),
        F.col("n_symbols").cast("long"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr("transform(slice(_words, 1, greatest(size(_words) - 2, 0)), (w, i) -> xxhash64(w, _words[i + 1], _words[i + 2]))").alias("_windows"),
    )
    ranked = windows.withColumn("_ranked", F.expr("CASE WHEN size(array_distinct(_windows)) < size(_windows) THEN sort_array(transform(_windows, (h, i) -> struct(h, i))) END"))
    again = ranked.withColumn("_again", F.expr("sort_array(transform(filter(_ranked, (x, i) -> x.h = get(_ranked, i - 1).h OR x.h = get(_ranked, i + 1).h), x -> x.i))"))
    covered = F.expr("aggregate(zip_with(_again, slice(_again, 2, size(_again)), (a, b) -> least(3, b - a)), 0, (s, x) -> s + x)")
    return again.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).select(*keep, *STATISTICS)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: What the rules may ask: ratios of the statistics, so that thresholds hold for texts of any length.
FEATURES = {
    "words": "cast(n_words AS double)",
    "word_length": "coalesce(try_divide(word_chars, n_words), 0D)",
    "symbols_per_char": "coalesce(try_divide(n_symbols, word_chars), 0D)",
    "symbols_per_word": "coalesce(try_divide(n_symbols, n_words), 0D)",
    "dup_lines_per_word": "coalesce(try_divide(n_dup_lines, n_words), 0D)",
    "dup_lines": "cast(n_dup_lines AS double)",
    "repeated": "coalesce(try_divide(n_repeat_words, n_words), 0D)",
}


@dataclass
class Rule:
    """Rejects where all conditions (feature, '>=' or '<=', threshold) hold."""

    conditions: list[tuple[str, str, float]] = field(default_factory=list)

    def covers(self, x: dict[str, np.ndarray], n: int) -> np.ndarray:
        hit = np.ones(n, bool)
        for name, sign, value in self.conditions:
            hit &= x[name] >= value if sign == ">=" else x[name] <= value
        return hit

    def column(self) -> Column:
        return F.expr(" AND ".join(f"{FEATURES[name]} {sign} {value!r}D" for name, sign, value in self.conditions))


def _grown(x: dict[str, np.ndarray], bad: np.ndarray, thresholds: int, depth: int) -> Rule:
    rule, hit = Rule(), np.ones(len(bad), bool)
    while len(rule.conditions) < depth and (hit & ~bad).any():
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        best = (0.0, None, None)
        for name, values in x.items():
            for value in np.unique(np.quantile(values[hit], np.linspace(0, 1, thresholds), method="nearest")):
                for sign in (">=", "<="):
                    on = hit & (values >= value if sign == ">=" else values <= value)
                    good_p, good_n = (on & bad).sum(), (on & ~bad).sum()
                    if good_p and (gain := good_p * (np.log2(good_p / (good_p + good_n)) - np.log2(p / (p + n)))) > best[0] + 1e-9:
                        best = (float(gain), (name, sign, float(value)), on)
        if best[1] is None:
            break
        rule.conditions.append(best[1])
        hit = best[2]
    return rule


def learn(rows: list[dict], most_rules: int = 12, depth: int = 4, thresholds: int = 60, least_precision: float = 0.9, least_cover: int = 5) -> list[Rule]:
    """The decision list of rows with FEATURES, ``bad`` and ``prune`` (whether the row is of the pruning third)."""
    bad = np.array([r["bad"] for r in rows], bool)
    prune = np.array([r["prune"] for r in rows], bool)
    x = {name: np.array([r[name] for r in rows], float) for name in FEATURES}
    rules: list[Rule] = []
    left = np.ones(len(rows), bool)
    while len(rules) < most_rules and (left & bad & ~prune).sum() >= least_cover:
        on = left & ~prune
        rule = _grown({k: v[on] for k, v in x.items()}, bad[on], thresholds, depth)
        held = left & prune

        def worth(r: Rule) -> float:
            hit = r.covers(x, len(rows)) & held
            p, n = (hit & bad).sum(), (hit & ~bad).sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule.conditions) > 1 and worth(Rule(rule.conditions[:-1])) >= worth(rule):
            rule.conditions.pop()
        hit = rule.covers(x, len(rows)) & left
        if not rule.conditions or (hit & bad).sum() < least_cover or (hit & bad).sum() < least_precision * hit.sum() or worth(rule) < 2 * least_precision - 1:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def decision(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, or null."""
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules))):
        out = F.when(rule.column(), F.lit(i)).otherwise(out)
    return out


def rules_from(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", most_labelled: int = 20_000) -> list[Rule]:
    """The decision list of rows with the STATISTICS; ``labels`` has the id and ``quality`` (0: bad). ``stats`` should be
    a stored table: its statistics are asked for again and again here, and would be computed each time. An id with
    several labels is bad if one of them says so; of equally good conditions the one of the first feature is taken."""
    known = labels.filter("quality is not null").select(F.col(id_col).alias("_id"), (F.col("quality") == 0).alias("bad")).groupBy("_id").agg(F.max("bad").alias("bad"))
    sample = (
        stats.filter(~base_failed())
        .join(known, F.col(id_col) == F.col("_id"))
        .select(F.xxhash64("_id").alias("_order"), "bad", (F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(3)) == 0).alias("prune"), *(F.expr(e).alias(n) for n, e in FEATURES.items()))
        .orderBy("_order", *FEATURES)
        .limit(most_labelled)
    )
    return learn([r.asDict() for r in sample.collect()])


def verdict(rules: list[Rule]) -> Column:
    """Whether a row with the STATISTICS passes the base test and no rule rejects it."""
    return ~base_failed() & decision(rules).isNull()


def good_only(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, judged in one scan. A row is generated for each good text: a filter on the
    verdict would be pushed down, and would evaluate the statistics again within their own lambdas."""
    passes = F.explode(F.when(verdict(rules), F.array(F.lit(1)))).alias("_good")
    return statistics(docs, text_col).select(*docs.columns, passes).drop("_good")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents``, rules learned from ``labels.quality``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    stats = cut(statistics(docs, keep=["doc_id"]))
    rules = rules_from(stats, labels)
    return stats.select("doc_id", *STATISTICS, base_failed().alias("base_failed"), verdict(rules).alias("kept"))
