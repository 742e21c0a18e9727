"""Quality rules whose cutoffs come from labelled holdouts, with a bound on false rejection.

Everything here is DataFrame operations on JVM columns. For each stratum and rule a
fixed grid of cutoffs is tested: with k of n good holdout documents above a cutoff, the
exact (Clopper-Pearson) upper bound on the share of good documents that it rejects is at
most `risk` exactly if P(Binomial(n, risk) <= k) <= alpha. alpha is divided by the number
of tests (strata x rules x cutoffs) and the risk by the number of rules, so that with
probability 1 - alpha no stratum loses more than `risk` of its good documents. The lowest
cutoff that passes is used; a rule without one rejects nothing in that stratum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import null_safe, unused, written

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Rules: a document is rejected if the value is above the stratum's cutoff.
RULES = {
    "repeat_share": [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5],
    "symbol_share": [0.005, 0.01, 0.02, 0.03, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5],
    "dup_line_share": [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.8],
    "long_words": [6.0, 6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0, 16.0, 24.0],
    "short_words": [0.2, 0.21, 0.22, 0.23, 0.25, 0.28, 0.33, 0.4, 0.5, 0.8],
}
#: A table of cutoffs of so many strata at most is sent to all tasks (about 100 bytes a row).
BROADCAST_STRATA = 10_000


def _measured(docs: DataFrame) -> DataFrame:
    """Adds the counts; docs has text."""
    trimmed = F.btrim("text", F.lit(SPACES))
    out = docs.withColumn("words", F.when(trimmed == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(trimmed, SPACE)))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    out = out.withColumn("lines", lines).withColumn("n_words", F.size("words").cast("long"))
    three = lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
    out = out.withColumn("hashes", F.when(F.col("n_words") >= 3, F.transform(F.expr("sequence(0, cast(n_words as int) - 3)"), three)))
    out = out.select(
        *[c for c in docs.columns if c != "text"],
        "n_words",
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        # only texts in which a window repeats go on: windows sorted by hash stand beside their equals
        F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("by_hash"),
    )
    same = lambda x, k: F.coalesce(F.get("by_hash", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("by_hash", k + 1)["h"] == x["h"], F.lit(False))
    out = out.withColumn("at", F.sort_array(F.transform(F.filter("by_hash", same), lambda x: x["i"]))).drop("by_hash")
    added = F.transform("at", lambda p, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), p - F.get("at", k - 1))))
    return out.withColumn("n_repeat_words", F.coalesce(F.aggregate(added, F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0).cast("bigint"))).drop("at")


def _rule_values() -> dict[str, Column]:
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return {"repeat_share": share("n_repeat_words", "n_words"), "symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"), "long_words": share("word_chars", "n_words"), "short_words": share("n_words", "word_chars")}


def _ln_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 9, and back."""
    z = n.cast("double") + 9.0
    series = (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    low = F.lit(0.0)
    for k in range(1, 9):
        low = low + F.ln(n.cast("double") + float(k))
    return series - low


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k) for k < n p, else 1.

    The terms fall from k downwards; after 12 standard deviations and 60 they are
    below 1e-25 of the first, so the sum's length grows with the root of n only.
    """
    k, n = k.cast("double"), n.cast("double")
    top = F.exp(_ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p))
    count = F.least(k, F.ceil(12 * F.sqrt(n * p * (1 - p)) + 60)).cast("int")
    steps = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.expr("cast(array() as array<int>)"))
    ratio = lambda j: (k - j + 1) / (n - k + j) * ((1 - p) / p)
    summed = F.aggregate(
        steps,
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda a, j: F.struct((a["term"] * ratio(j)).alias("term"), (a["sum"] + a["term"] * ratio(j)).alias("sum")),
        lambda a: a["sum"],
    )
    return F.when(k < n * p, F.least(F.lit(1.0), top * summed)).otherwise(1.0)


def controlled_cutoffs(measured: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", good_col: str = "quality", risk: float = 0.05, alpha: float = 0.05) -> DataFrame:
    """One row (stratum, n_good, a column for each rule); a null cutoff rejects nothing.

    measured: rows with stratum, base_failed and the counts. A document is good if all
    its labels are 1. Rows that the base rules reject anyway take no part.
    """
    good = labels.where(F.col(good_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(good_col).alias("__good")).where("__good = 1")
    held = measured.where(~F.col("base_failed")).join(good, F.col(id_col) == F.col("__id"))
    held = held.select("stratum", *[v.alias(rule) for rule, v in _rule_values().items()])
    # put as SQL text: a Column object for each of the grid's parts costs the driver seconds
    cuts = [(rule, i, c) for rule, grid in RULES.items() for i, c in enumerate(grid)]
    counts = held.groupBy("stratum").agg(F.count("*").alias("n_good"), *[F.expr(f"count_if({rule} > {c!r}D) AS {rule}_{i}") for rule, i, c in cuts])
    tests = ", ".join(f"struct('{rule}' AS rule, {c!r}D AS cutoff, {rule}_{i} AS k)" for rule, i, c in cuts)
    each = counts.select("stratum", "n_good", F.expr(f"explode(array({tests})) AS t")).select("stratum", "n_good", "t.*")
    n_strata = each.select(F.count_distinct(F.struct("stratum")).alias("n_strata"))
    n_tests = F.col("n_strata") * sum(map(len, RULES.values()))
    passing = each.crossJoin(F.broadcast(n_strata)).withColumn("ok", binomial_cdf(F.col("k"), F.col("n_good"), risk / len(RULES)) <= F.lit(alpha) / n_tests)
    return passing.groupBy("stratum").agg(F.first("n_good").alias("n_good"), *[F.min(F.when(F.col("ok") & (F.col("rule") == rule), F.col("cutoff"))).alias(f"cut_{rule}") for rule in RULES])


def quality_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", good_col: str = "quality", risk: float = 0.05, alpha: float = 0.05, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """One row for each row of docs: (id, sig, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, failed_rules).

    base_failed: n_words < min_words, or 100 * n_repeat_words > max_repeat_percent * n_words.
    kept: not base_failed and no value above its stratum's cutoff. sig is the text's
    xxhash64. A null text has no words; a null stratum is one of its own; repeated rows
    each give a row; labels with null ids or values, or without a document, don't count;
    other columns are ignored; without labels only the base rules reject; an empty table
    gives an empty result.
    """
    base = docs.select(docs[id_col].alias("id"), docs[stratum_col].cast("string").alias("stratum"), F.xxhash64(docs[text_col]).alias("sig"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    measured = written(_measured(base).withColumn("base_failed", failed).withColumnRenamed("id", id_col))
    cutoffs = written(controlled_cutoffs(measured, labels, id_col=id_col, good_col=good_col, risk=risk, alpha=alpha))
    if cutoffs.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA:
        cutoffs = F.broadcast(cutoffs)
    value = _rule_values()
    hits = F.array_compact(F.array(*[F.when(value[rule] > F.col(f"cut_{rule}"), F.lit(rule)) for rule in RULES]))
    judged = null_safe(measured, cutoffs, ["stratum"], "left").withColumn("failed_rules", hits)
    return judged.select(id_col, "sig", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), "failed_rules")


def keep_good(docs: DataFrame, judged: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that quality_rules kept, with all their columns, whatever their names.

    Rows meet their verdict by id and text, nulls included, so repeated ids don't mix.
    """
    sig = unused("__sig", docs)
    kept = judged.where("kept").select(id_col, F.col("sig").alias(sig))
    return null_safe(docs.withColumn(sig, F.xxhash64(text_col)), kept, [id_col, sig], "left_semi").drop(sig)
