"""Quality rules: a decision list learned by sequential covering, applied as one ordered Spark conditional.

A rule is a conjunction of thresholds on document statistics that marks documents to drop. Learning grows one rule
at a time on the labelled rows that no earlier rule covers: each step adds the threshold with the best information gain
on the grow fold, then trailing thresholds that don't help on the prune fold are cut again. All counts come from
Spark aggregations over the rows' bin numbers, so the driver sees histograms only. DataFrame functions throughout.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, read

BLANKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"


def bind(value: Column, f) -> Column:
    """f(value) with value computed once, which a plain reference inside a lambda does not promise."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def word_array(text: Column) -> Column:
    r"""Words `[^\x20\x09-\x0D]+`."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def repeated_words(words: Column) -> Column:
    """Words that lie in 3-word windows found twice or more in the array, the first one included.

    Windows are compared by a 64-bit hash within one text. If all differ, nothing else is done; if not, a sorted array
    of (hash, place) shows the repeated places. Memory is linear in the text; there is no shuffle."""

    def count(order: Column) -> Column:  # of sorted (h, i): places whose hash a neighbour shares, then words they cover
        last = F.size(order) - 1
        hash_at = lambda k: F.get(order, k)["h"]
        same = F.filter(
            F.sequence(F.lit(0), last),
            lambda k: ((k > 0) & (hash_at(k) == hash_at(F.greatest(k - 1, F.lit(0))))) | ((k < last) & (hash_at(k) == hash_at(F.least(k + 1, last)))),
        )
        places = F.sort_array(F.transform(same, lambda k: F.get(order, k)["i"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("to"))
        return F.aggregate(places, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["to"])).alias("n"), i.alias("to")), lambda a: a["n"])

    def of(hashes: Column) -> Column:
        marks = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(bind(F.sort_array(marks), count))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    return bind(words, lambda w: F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(bind(windows(w), of)))


def text_statistics(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the counts of each whole text; a null text has no words. Other columns are dropped."""
    body = F.coalesce(F.col(text), F.lit(""))
    without = lambda chars: F.length(F.translate("_text", chars, ""))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = df.select(F.col(key), body.alias("_text")).select(
        key,
        F.struct(
            without(BLANKS).cast("long").alias("word_chars"),
            (F.length("_text") - without(SYMBOLS)).cast("long").alias("n_symbols"),
            (F.length("_text") - without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long").alias("n_upper"),
            (F.length("_text") - without("!")).cast("long").alias("n_bangs"),
            (F.length("_text") - without("0123456789")).cast("long").alias("n_digits"),
            bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            bind(lines, lambda x: F.size(x).cast("long")).alias("n_lines"),
        ).alias("s"),
        bind(
            word_array(F.col("_text")),
            lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_kinds"), repeated_words(w).alias("n_repeat_words")),
        ).alias("w"),
    )
    return counted.select(key, "w.*", "s.*")


#: What conditions look at: shares of counts, as SQL expressions of text_statistics()'s columns.
RATES = {
    "words": "cast(n_words as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "bang_share": "n_bangs / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "kind_share": "n_kinds / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
}


@dataclass(frozen=True)
class Condition:
    rate: str
    above: bool
    cut: float

    def test(self) -> Column:
        rate = F.expr(RATES[self.rate])
        return rate >= F.lit(self.cut) if self.above else rate < F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.rate} {'>=' if self.above else '<'} {self.cut:g}"


def all_of(rule: list[Condition]) -> Column:
    return reduce(lambda a, b: a & b, [c.test() for c in rule], F.lit(True))


def learn(labelled: DataFrame, max_rules: int = 8, max_conditions: int = 3, cuts: int = 40, least_rows: int = 12, precision: float = 0.75) -> list[list[Condition]]:
    """Rules for rows to drop, in order. labelled: the counts of text_statistics() and bad (0 or 1), grow (boolean).

    Cuts are quantiles over all labelled rows. A rule is kept if it covers least_rows rows of both folds together and
    the prune fold (or, where that has none, the grow fold) is bad in `precision` of its rows; the first rule
    that isn't ends the list. Without labelled rows of both kinds there are no rules."""
    steps = [i / cuts for i in range(1, cuts)]
    row = labelled.agg(F.sum("bad").alias("_bad"), F.count("*").alias("_n"), *[F.percentile_approx(F.expr(v), steps, 10_000).alias(k) for k, v in RATES.items()]).first()
    if not row["_bad"] or row["_bad"] == row["_n"]:
        return []
    grid = {k: sorted(set(row[k])) for k in RATES}
    number = lambda k: reduce(lambda a, c: a + c, [(F.expr(RATES[k]) >= F.lit(c)).cast("int") for c in grid[k]], F.lit(0))
    bins = F.posexplode(F.array(*[number(k) for k in RATES])).alias("rate", "bin")
    rules: list[list[Condition]] = []
    rest = labelled
    while len(rules) < max_rules:
        rule: list[Condition] = []
        while len(rule) < max_conditions:
            counts = rest.filter(F.col("grow") & all_of(rule)).select("bad", bins).groupBy("rate", "bin").agg(F.sum("bad").alias("p"), F.count("*").alias("n")).collect()
            best = best_condition(counts, grid, least_rows)
            if best is None:
                break
            rule.append(best)
        if not rule:
            break
        worth = rest.agg(*[f(F.when(all_of(rule[: i + 1]) & (F.col("grow") == g), F.col("bad"))).alias(f"{k}{i}{g}") for i in range(len(rule)) for g in (True, False) for k, f in (("p", F.sum), ("n", F.count))]).first()
        value = lambda i: ((worth[f"p{i}False"] or 0) - (worth[f"n{i}False"] - (worth[f"p{i}False"] or 0))) / max(1, worth[f"n{i}False"])
        keep = max(range(len(rule)), key=lambda i: (value(i), -i))
        fold = worth[f"n{keep}False"] > 0
        p, n = worth[f"p{keep}{not fold}"] or 0, worth[f"n{keep}{not fold}"]
        if n < 1 or p < precision * n or worth[f"n{keep}True"] + worth[f"n{keep}False"] < least_rows:
            break
        rules.append(rule[: keep + 1])
        rest = rest.filter(~all_of(rules[-1]))
    return rules


def best_condition(counts: list, grid: dict[str, list[float]], least_rows: int) -> Condition | None:
    """The threshold with the highest FOIL gain over histograms (rate, bin, p, n)."""
    best, found = 1e-9, None
    for j, (rate, cut) in enumerate(grid.items()):
        have = {r["bin"]: (r["p"], r["n"]) for r in counts if r["rate"] == j}
        all_p, all_n = (sum(x[k] for x in have.values()) for k in (0, 1))
        if not all_p or all_p == all_n:
            return None
        low_p = low_n = 0
        for b, c in enumerate(cut):
            low_p, low_n = low_p + have.get(b, (0, 0))[0], low_n + have.get(b, (0, 0))[1]
            for above, p, n in ((True, all_p - low_p, all_n - low_n), (False, low_p, low_n)):
                if n >= least_rows / 2 and p and (gain := p * (math.log2(p / n) - math.log2(all_p / all_n))) > best:
                    best, found = gain, Condition(rate, above, c)
    return found


def verdict(rules: list[list[Condition]]) -> Column:
    """The number of the first rule that drops a document, from 1; 0 if none does."""
    out = F.lit(0)
    for i, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(all_of(rule), F.lit(i)).otherwise(out)
    return out


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text_statistics() of docs with rule, the number of the learned rule that drops a document (0: none).
    labels: doc_id, quality. Rows with a null id or label teach nothing; a null text has no words, and is judged by its
    counts like an empty one. Rows that repeat an id are judged each by its own text; of thresholds with equal gain the
    first in the order of RATES, then of cuts, is taken. Other columns of docs are dropped; an empty table gives an
    empty result."""
    stats = durable(text_statistics(docs), "rule-stats")
    bad = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.avg("quality") < 0.5).cast("int").alias("bad"))
    labelled = durable(stats.join(bad, "doc_id").withColumn("grow", F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0), "rule-labelled")
    return stats.withColumn("rule", verdict(learn(labelled)))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdicts of all documents, with rules learned from all labels."""
    out = apply_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("rule") == 0)).alias("kept"))
