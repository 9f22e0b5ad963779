"""Quality rules whose cutoffs are chosen under a bound on false rejections.

Every rule rejects a document whose statistic is above a cutoff.  Labelled good documents of a stratum
are the holdout: a cutoff with ``k`` false rejections among ``n`` is admitted if, were the true rate
``alpha / rules`` or more, so few would be seen with probability ``delta / (rules * strata)`` at most
(exact binomial tail; Bonferroni over rules and strata; along a rule's fixed grid the cutoffs are tested
from lenient to strict, and as tails only grow along it this needs no further correction).  The strictest
admitted cutoff is taken; a rule without one is off in that stratum.  So with probability ``1 - delta``
all strata lose at most ``alpha`` of their good documents to the rules.

All of it is DataFrame functions: no Python runs on the executors and no text is shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.llm.common import WORD, bounded_broadcast, columns_of
from provena.session import cut_lineage

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
ALPHA, DELTA = 0.01, 0.05


@dataclass(frozen=True)
class Rule:
    """Rejects above a cutoff; ``numerator / denominator`` are statistics, cutoffs go from lenient to strict."""

    name: str
    numerator: str
    denominator: str
    cutoffs: tuple[float, ...]


RULES = (
    Rule("symbols", "n_symbols", "word_chars", (0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.02)),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2)),
    Rule("repeated_words", "n_repeat_words", "n_words", (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2)),
    Rule("capitals", "n_capitals", "word_chars", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2)),
    Rule("exclamations", "n_exclamations", "n_words", (2.0, 1.5, 1.0, 0.8, 0.6, 0.4, 0.2)),
    Rule("long_words", "word_chars", "n_words", (40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0)),
)


def _count_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _repeated_words(grams: str) -> Column:
    """Words inside 3-word windows that occur twice or more: ``grams`` holds (hash, start) pairs in order (null: no window does)."""
    g = F.col(grams)
    starts = F.sort_array(F.transform(
        F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda j: (F.get(g, j)["h"] == F.get(g, j - 1)["h"]) | (F.get(g, j)["h"] == F.get(g, j + 1)["h"])),
        lambda j: F.get(g, j)["i"]))
    walk = F.aggregate(starts, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
                       lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")))
    return F.when(F.size(g) > 1, walk["n"]).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame, keep: list[Column], text_col: str = "text", min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """``keep`` plus the struct ``stats`` of every row.

    Windows of three words are compared by a 64-bit hash of the three words, within one text only; they are
    sorted with their places only where a hash occurs twice, which most texts have none of.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    a = docs.select(*keep, text.alias("__t"), F.regexp_extract_all(text, F.lit(f"({WORD})"), 1).alias("__w"))
    names = [c for c in a.columns if c not in ("__t", "__w")]
    w = F.col("__w")
    hashes = F.when(F.size(w) > 2, F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                                               lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike(WORD))
    b = a.select(*names, "__t", F.size(w).cast("long").alias("n_words"), hashes.alias("__h"), lines.alias("__l"))
    h = F.col("__h")
    grams = F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    b = b.select(*names, "__t", "n_words", "__l", grams.alias("__g"))
    t = F.col("__t")
    c = b.select(
        *names, "n_words", F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        _count_of(t, SYMBOLS).alias("n_symbols"), F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_repeated_words("__g"), F.lit(0)).cast("long").alias("n_repeat_words"),
        _count_of(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"), _count_of(t, "!").alias("n_exclamations"))
    stats = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_exclamations"]
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    return c.select(*names, F.struct(*stats, failed.alias("base_failed")).alias("stats"))


def _value(rule: Rule, stats: str = "stats") -> Column:
    """The rule's statistic; a text without words has 0."""
    d = F.col(f"{stats}.{rule.denominator}")
    return F.when(d > 0, F.col(f"{stats}.{rule.numerator}") / d).otherwise(F.lit(0.0))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), exact up to rounding, summed in logarithms; 1 where k is above the mean."""
    odds = math.log(p / (1 - p))

    def step(acc, i):
        term = acc["term"] + F.log((n - i + 1).cast("double") / i) + F.lit(odds)
        top = F.greatest(acc["sum"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(acc["sum"] - top) + F.exp(term - top))).alias("sum"))

    zero = n.cast("double") * math.log(1 - p)
    total = F.aggregate(F.sequence(F.lit(1).cast("long"), k), F.struct(zero.alias("term"), zero.alias("sum")), step)["sum"]
    return F.when(k > n * p, F.lit(1.0)).when(k == 0, F.exp(zero)).otherwise(F.exp(total))


def calibrate(measured: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, alpha: float = ALPHA, delta: float = DELTA,
              *, label: str = "quality", id_col: str = "doc_id") -> DataFrame:
    """``(stratum, cutoffs)``: a struct with each rule's cutoff, null where the rule is off.

    ``measured`` has ``doc_id, stratum, stats`` and should be a written table; the labelled good rows
    (label 1 in every label row of the id) that pass the base rule are the holdout.
    """
    good = (labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id"))
            .agg(F.min(label).alias("label")).filter("label = 1").select("doc_id"))
    strata = measured.select(F.count_distinct("stratum")).first()[0]
    level = [F.struct(F.lit(i).alias("rule"), F.coalesce(*[F.when(_value(r) > c, F.lit(j)) for j, c in enumerate(r.cutoffs)],
                                                         F.lit(len(r.cutoffs))).alias("level")) for i, r in enumerate(rules)]
    # A good row's level is the first cutoff that it exceeds, so the j-th cutoff rejects the rows of level j and below.
    seen = (measured.join(good, "doc_id").filter(~F.col("stats.base_failed"))
            .select("stratum", F.explode(F.array(*level)).alias("e")).groupBy("stratum", "e.rule", "e.level").agg(F.count("*").alias("c")))
    grid = measured.sparkSession.createDataFrame([(i, j, c) for i, r in enumerate(rules) for j, c in enumerate(r.cutoffs)], "rule int, j int, cutoff double")
    tested = seen.join(grid, "rule").groupBy("stratum", "rule", "cutoff").agg(
        F.sum("c").alias("n"), F.sum(F.when(F.col("level") <= F.col("j"), F.col("c")).otherwise(0)).alias("k"))
    passed = binomial_tail(F.col("n"), F.col("k"), alpha / len(rules)) <= delta / (len(rules) * max(strata, 1))
    picked = [F.min(F.when(F.col("rule") == i, F.col("cutoff"))).alias(r.name) for i, r in enumerate(rules)]
    return tested.filter(passed).groupBy("stratum").agg(*picked).select("stratum", F.struct(*[r.name for r in rules]).alias("cutoffs"))


def judge(measured: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, alpha: float = ALPHA, delta: float = DELTA,
          *, id_col: str = "doc_id") -> DataFrame:
    """``measured`` (a written table) plus ``cutoffs``, ``failed_rule`` (first rule that rejects, else null) and ``kept``."""
    cuts = cut_lineage(calibrate(measured, labels, rules, alpha, delta, id_col=id_col))
    joined = measured.join(bounded_broadcast(cuts, 10_000), "stratum", "left")
    hit = F.coalesce(*[F.when(_value(r) > F.col(f"cutoffs.{r.name}"), F.lit(r.name)) for r in rules])
    return joined.withColumn("failed_rule", hit).withColumn("kept", ~F.col("stats.base_failed") & F.col("failed_rule").isNull())


def quality_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """A row per input row: id, the statistics, ``base_failed``, ``kept``, ``failed_rule``.

    Null texts have no words (and fail the base rule), null strata are the stratum ``''``, repeated rows
    keep a row each, an empty table gives an empty result; without labels only the base rule rejects.
    """
    keep = [F.col(id_col).alias("doc_id"), F.coalesce(F.col(stratum_col), F.lit("")).alias("stratum")]
    judged = judge(cut_lineage(measure(docs, keep, text_col)), labels)
    return judged.select("doc_id", *[f"stats.{s}" for s in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")],
                         "kept", "failed_rule")


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The input's rows and columns without those that the base rule or a calibrated rule rejects."""
    keep = [F.struct(*columns_of(docs)).alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(stratum_col), F.lit("")).alias("stratum")]
    judged = judge(cut_lineage(measure(docs, keep, text_col)), labels)
    return judged.filter("kept").select(*columns_of(docs, "row"))
