"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

One pass over the whole texts computes each document's base measures; they are staged, and the rest works on them.
A rule rejects a document whose measure is above the rule's cutoff. Cutoffs are tightened one rule at a time, in one
fixed order from lenient to strict (`CUTOFFS`): after step s the first s + 1 cutoffs of that order hold, so a document
is rejected from one step of its own on, and each step rejects all that the step before does. For each stratum the
steps are tested in order on its labelled holdout: a step is admitted if the exact binomial (Clopper-Pearson) upper
bound of the share that all rules together reject, of the good documents that pass the base rules, is within the risk. As steps are tested in
a fixed order and none is skipped, steps and rules need no correction; Bonferroni's correction is over the strata. Of
the admitted steps the one with the best gain is taken, the most lenient of equal ones.

A stratum with fewer good labels than ln(FAILURE) / ln(1 - RISK) = 149 cannot get cutoffs even if they reject no good
document, so it is not tested and does not count in the correction. With four tested strata each needs 217.

Defined results: a null text has no words and no lines; a null stratum is a stratum of its own, with the empty one;
labels with a null key or grade are not used, and a document with contradicting labels counts as good; strata with too
few labels get no cutoff and lose only documents that fail the base rules; repeated rows are judged alike; texts are
taken whole, however long; empty tables give an empty result or no cutoffs; other columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACE_CLASS, staged

SPACES = "\x20\t\n\x0b\x0c\r"
#: Share of a stratum's good documents that the rules together may reject, and the chance that this fails anywhere.
RISK, FAILURE = 0.02, 0.05
#: A wrongly rejected good document weighs as much as so many rightly rejected bad ones.
GOOD_WEIGHT = 10
#: Cutoffs of each measure, from lenient to strict. Steps go through them in turn: the first of each rule, in this
#: order of rules, then the second of each, and so on.
CUTOFFS = {
    "symbol_share": [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06],
    "dup_line_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25],
    "repeat_share": [0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.17, 0.14, 0.12],
    "chars_per_word": [40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 13.0, 12.0, 11.0],
}
STEPS = len(CUTOFFS) * 10
#: Strata tables of up to this many rows are broadcast; larger ones are joined by a shuffle.
MOST_STRATA = 10_000


def words_of(text: Column) -> Column:
    """Words between white space, empty for an empty text."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS))


def chars_only(text: Column, others: str) -> Column:
    """How many characters are left when all stretches of `others` are taken out."""
    return F.length(F.regexp_replace(text, others, ""))


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text", *more: str) -> DataFrame:
    """Base measures of every row. Each step is a projection of its own, so that no array is computed twice.

    Words in repeated 3-word windows: windows are hashed first, and only texts with two equal hashes sort their
    windows (word by word, so the count is exact) to find the equal ones.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias(key), *[F.col(c) for c in more], whole.alias("_t"))
    rows = rows.select(
        key, *more, words_of(F.col("_t")).alias("_w"),
        (F.length("_t") - chars_only(F.col("_t"), r"[^\x20\x09-\x0D]+")).cast("long").alias("word_chars"),
        chars_only(F.col("_t"), r"[^#*$%&|<>]+").cast("long").alias("n_symbols"),
        F.filter(F.split("_t", "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "").alias("_l"),
    )
    rows = rows.select(
        key, *more, "word_chars", "n_symbols", "_w", F.size("_w").cast("long").alias("n_words"), F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.expr("CASE WHEN size(_w) >= 3 THEN transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) END").alias("_h"),
    )
    kept = [key, *more, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines"]
    rows = rows.select(*kept, F.expr("CASE WHEN _h IS NOT NULL AND size(array_distinct(_h)) < size(_h) THEN array_sort(transform(sequence(0, size(_w) - 3), i -> struct(concat_ws(' ', _w[i], _w[i + 1], _w[i + 2]) AS w, i AS at))) END").alias("_s"))
    rows = rows.select(*kept, F.expr("CASE WHEN _s IS NOT NULL THEN array_sort(transform(filter(_s, (x, i) -> (i > 0 AND _s[greatest(i - 1, 0)].w = x.w) OR (i < size(_s) - 1 AND _s[least(i + 1, size(_s) - 1)].w = x.w)), x -> x.at)) END").alias("_p"))
    return rows.select(*kept, F.expr("CASE WHEN _p IS NULL OR size(_p) = 0 THEN 0L ELSE 3L + aggregate(sequence(0, size(_p) - 1), 0L, (sum, i) -> sum + CASE WHEN i = 0 THEN 0 ELSE least(3, _p[i] - _p[greatest(i - 1, 0)]) END) END").alias("n_repeat_words"))


def failed() -> Column:
    """Whether the base rules reject a document."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def shares() -> dict[str, Column]:
    """The measures that rules compare with their cutoffs; null where undefined, which no rule rejects."""
    return {
        "symbol_share": F.when(F.col("word_chars") > 0, F.col("n_symbols") / F.col("word_chars")),
        "dup_line_share": F.when(F.col("n_lines") > 0, F.col("n_dup_lines") / F.col("n_lines")),
        "repeat_share": F.when(F.col("n_words") > 0, F.col("n_repeat_words") / F.col("n_words")),
        "chars_per_word": F.when(F.col("n_words") > 0, F.col("word_chars") / F.col("n_words")),
    }


def lower_tail(k: str, n: str, p: str) -> str:
    """SQL for the chance of at most k successes in n trials; summed as logarithms, so no term is lost.

    Only used for k below n * p. The bound of Clopper and Pearson is below p just if this is below their level.
    """
    first = f"{n} * ln(1 - {p})"
    step = f"acc.term + ln(({n} - i + 1D) / i) + ln({p} / (1 - {p}))"
    added = f"greatest(acc.total, {step}) + ln(1 + exp(-abs(acc.total - ({step}))))"
    return f"exp(CASE WHEN {k} = 0 THEN {first} ELSE aggregate(sequence(1L, greatest(1L, {k})), named_struct('term', {first}, 'total', {first}), (acc, i) -> named_struct('term', {step}, 'total', {added}), acc -> acc.total) END)"


def step_of() -> Column:
    """The first step that rejects a document; STEPS if none does."""
    own = []
    for rule, (name, share) in enumerate(shares().items()):
        passed = [F.when(share <= cut, 1).otherwise(0) for cut in CUTOFFS[name]]  # cutoffs fall, so those passed come first
        at = reduce(add, passed)
        own.append(F.when(share.isNotNull() & (at < len(passed)), at * len(CUTOFFS) + rule).otherwise(STEPS))
    return F.least(*own)


def thresholds(measured: DataFrame, labels: DataFrame, key: str, stratum: str, good: str, risk: float = RISK, failure: float = FAILURE) -> DataFrame:
    """One row per stratum that gets cutoffs: stratum, labelled_good, step."""
    graded = labels.where(F.col(key).isNotNull() & F.col(good).isNotNull()).groupBy(key).agg((F.max(good) > 0).alias("_good"))
    held = measured.where(~failed()).join(graded, key).select(F.coalesce(stratum, F.lit("")).alias("stratum"), "_good", step_of().alias("step"))
    counts = staged(held.groupBy("stratum", "step").agg(F.count_if("_good").alias("good"), F.count_if(~F.col("_good")).alias("bad")), "quality-steps")
    strata = counts.groupBy("stratum").agg(F.sum("good").alias("n")).where(F.col("n") >= math.log(failure) / math.log(1 - risk)).count()
    so_far, whole = Window.partitionBy("stratum").orderBy("step"), Window.partitionBy("stratum")  # STEPS + 1 rows at most
    run = counts.select("stratum", "step", F.sum("good").over(whole).alias("n"), F.sum("good").over(so_far).alias("good"), F.sum("bad").over(so_far).alias("bad"))
    admitted = run.where(F.col("step") < STEPS).where(F.expr(f"good < n * {risk}D AND {lower_tail('good', 'n', f'{risk}D')} <= {failure}D / {max(1, strata)}"))
    gain = (F.col("bad") - GOOD_WEIGHT * F.col("good")).alias("gain")
    best = admitted.groupBy("stratum").agg(F.max("n").alias("labelled_good"), F.max(F.struct(gain, (-F.col("step")).alias("lenient"))).alias("best"))
    return best.where("best.gain > 0").select("stratum", "labelled_good", (-F.col("best.lenient")).alias("step"))


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", good: str = "quality") -> DataFrame:
    """Base measures, base_failed and kept for every row; one text pass, one join of labelled keys, no Python."""
    measured = staged(measures(docs, key, text, stratum), "quality-measures")
    cuts = staged(thresholds(measured, labels, key, stratum, good).select(F.col("stratum").alias("_of"), F.col("step").alias("_cut")), "quality-cutoffs")
    table = F.broadcast(cuts) if cuts.limit(MOST_STRATA + 1).count() <= MOST_STRATA else cuts
    over = F.coalesce(step_of() <= F.col("_cut"), F.lit(False))
    rows = measured.withColumn("_stratum", F.coalesce(stratum, F.lit(""))).join(table, F.col("_stratum") == F.col("_of"), "left")
    return rows.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed().alias("base_failed"), (~failed() & ~over).alias("kept"))
