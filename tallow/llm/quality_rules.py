"""Quality rules whose thresholds carry a risk guarantee.

Base statistics come from built-in functions only.  On top of the fixed base
rules, each statistic may reject a document above a cutoff, chosen per stratum
on labelled documents: a cutoff is used only if an exact binomial test proves,
at the level left by a Bonferroni correction over all strata, rules and
cutoffs, that it rejects less than its share of ``risk`` of the good documents,
so that all rules of a stratum together reject less than ``risk`` of them.  Of
the cutoffs that pass, the lowest is taken; without one the rule stays unused.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallow.llm import scratch

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8

#: Rejecting statistics, in percent; each is compared with its cutoffs.
RULES = {
    "symbol_share": lambda: _share("n_symbols", F.col("n_symbols") + F.col("word_chars")),
    "dup_line_share": lambda: _share("n_dup_lines", F.col("n_lines")),
    "repeat_share": lambda: _share("n_repeat_words", F.col("n_words")),
    "long_words": lambda: F.col("word_chars") * F.lit(5) / F.greatest(F.col("n_words"), F.lit(1)),
}
CUTOFFS = (2, 4, 6, 8, 10, 12, 15, 20, 25, 30, 40, 50, 60, 70, 80, 90)

NUMBERS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _share(part: str, whole: Column) -> Column:
    return F.col(part) * F.lit(100.0) / F.greatest(whole, F.lit(1))


def _repeated(words: Column, n: Column) -> Column:
    """Words inside an 8-word window found twice or more, the first find included.

    Windows are compared by their 64-bit hashes.  Most texts have no repeated
    window, which a distinct count shows; only the others sort (hash, place).
    """
    at = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(n < WINDOW, F.array().cast("array<bigint>")).otherwise(at)


def statistics(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long) and base_failed.

    Words stand between white space; a null text has none.  word_chars counts
    code points in words, n_symbols characters of ``#*$%&|<>``; n_lines counts
    lines with a word, n_dup_lines those equal to an earlier line.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    out = docs.withColumns({"__text": text, "__words": words})
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumns({"__n": F.size("__words"), "__lines": lines})
    out = out.withColumns({"__hash": _repeated(F.col("__words"), F.col("__n"))})
    # Places of repeated windows: neighbours with an equal hash once (hash, place) are sorted.
    pairs = F.sort_array(F.transform("__hash", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("__pairs", F.when(F.size("__hash") > F.size(F.array_distinct("__hash")), pairs))
    near = lambda x, k: F.coalesce(F.get(F.col("__pairs"), k)["h"] == x["h"], F.lit(False))
    marked = F.transform("__pairs", lambda x, k: F.when(near(x, k - 1) | near(x, k + 1), x["i"]))
    out = out.withColumn("__at", F.when(F.col("__pairs").isNotNull(), F.sort_array(F.array_compact(marked))))
    cover = F.aggregate(
        F.transform("__at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("__at"), k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda s, x: s + x
    )
    out = out.withColumns(
        {
            "n_words": F.col("__n").cast("long"),
            "word_chars": F.length(F.translate("__text", " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": (F.length("__text") - F.length(F.translate("__text", "#*$%&|<>", ""))).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": F.coalesce(cover, F.lit(0)).cast("long"),
        }
    )
    out = out.drop("__text", "__words", "__lines", "__n", "__hash", "__pairs", "__at")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    # A row's number is never negative; a filter on the result is not moved below it, which would compute the arrays above again for each element.
    return out.withColumn("base_failed", failed & (F.monotonically_increasing_id() >= 0))


def _log_factorial(x: Column) -> Column:
    """ln x! by Stirling's series at x + 9, whose error is below 1e-10."""
    z = x.cast("double") + 9
    up = F.lit(1.0)
    for k in range(1, 9):
        up = up * (x.cast("double") + k)
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5))) - F.ln(up)


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p) and k up to n p, rounded up by 1e-4 of itself.

    The last term comes from factorials, those before it one from another;
    they fall like a bell curve, so that nine deviations of them are all that
    counts.
    """
    top = F.exp(_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * F.lit(math.log(p)) + (n - k) * F.lit(math.log(1 - p)))
    odds = (1 - p) / p

    def add(acc: Column, j: Column) -> Column:
        t = acc["t"] * j * F.lit(odds) / (n - j + 1)
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    least = F.greatest(F.lit(1).cast("long"), k - F.ceil(F.sqrt(n * p) * 9 + 40).cast("long"))
    steps = F.when(k >= 1, F.sequence(k, least, F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(steps, F.struct(top.alias("t"), top.alias("s")), add)["s"]
    return F.when(k >= n, F.lit(1.0)).otherwise(F.least(F.lit(1.0), total * 1.0001))


def thresholds(stats: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.02, level: float = 0.05) -> DataFrame:
    """(stratum, rule, cutoff) of the rules in use.

    stats has doc_id, the stratum's column and the statistics; labels has
    doc_id and quality (1: good).  Only good documents that pass the base
    rules are counted.  A document labelled twice counts twice; null labels
    and strata without labels give no rule.
    """
    good = labels.where("quality = 1").select(F.col("doc_id"))
    # Labels grow with the corpus: joined by shuffle, of keys and statistics only.
    counted = stats.where(~F.col("base_failed") & F.col(stratum).isNotNull()).select("doc_id", stratum, *NUMBERS)
    held = counted.join(good.hint("merge"), "doc_id")
    values = F.create_map(*[x for name, f in RULES.items() for x in (F.lit(name), f().cast("double"))])
    long = held.select(F.col(stratum).alias("stratum"), F.explode(values).alias("rule", "value"))
    # Reject counts of every cutoff at once: partial sums, one row per stratum and rule.
    counts = long.groupBy("stratum", "rule").agg(F.count("*").alias("n"), *[F.sum((F.col("value") > c).cast("long")).alias(f"k{c}") for c in CUTOFFS])
    counts = scratch.table(counts, "rejects")
    tests = max(1, counts.select("stratum").distinct().count() * len(RULES) * len(CUTOFFS))
    each = counts.select("stratum", "rule", "n", F.explode(F.array(*[F.struct(F.lit(c).alias("cutoff"), F.col(f"k{c}").alias("k")) for c in CUTOFFS])).alias("x"))
    each = each.select("stratum", "rule", "n", "x.cutoff", "x.k")
    # Above the risk no cutoff can pass; the sum is only formed where it may.
    part = risk / len(RULES)  # what each rule may reject, so that all together keep to the risk
    proven = F.when(F.col("k") > F.col("n") * part, F.lit(False)).otherwise(binomial_cdf(F.col("k"), F.col("n"), part) * tests <= level)
    return each.where(proven).groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def judge(stats: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """stats with rejected_by (names of the rules that reject, sorted) and kept.

    cutoffs has one row per stratum and rule in use; read from a written
    table, its size decides whether it is sent to all tasks.
    """
    by = cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", F.col("cutoff").cast("double")))).alias("__cut"))
    out = stats.join(by.withColumnRenamed("stratum", "__stratum"), stats[stratum] == F.col("__stratum"), "left")
    over = [F.when(f() > F.try_element_at("__cut", F.lit(name)), F.lit(name)) for name, f in sorted(RULES.items())]
    out = out.withColumn("rejected_by", F.array_compact(F.array(*over)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("__cut", "__stratum")


NEW = (*NUMBERS, "base_failed", "rejected_by", "kept")


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.02, level: float = 0.05, keep_text: bool = True) -> DataFrame:
    """docs with the statistics, base_failed, rejected_by and kept; without keep_text less the column text.

    All other columns of docs stay (one named like a new column is replaced),
    and so do all rows, repeated ones too.  A null text has no words and fails
    the base rules; a null stratum has the base rules only.  Empty labels leave
    the base rules, an empty docs an empty result.
    """
    stats = statistics(docs.drop(*NEW))
    # Written: the cutoffs and the verdicts use the same numbers, each text is gone through once.
    stats = scratch.table(stats if keep_text else stats.drop("text"), "statistics")
    cutoffs = scratch.table(thresholds(stats, labels.select("doc_id", "quality"), stratum, risk, level), "cutoffs")
    return judge(stats, cutoffs, stratum)
