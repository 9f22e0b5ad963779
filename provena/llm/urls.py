"""URL filter: block and allow rules, and gradient-boosted trees on lexical features for what no rule decides.

The trees learn from the URLs that the rules decide, and, at a smaller weight, from the other URLs of
the same domains as not blocked: rules that decide part of a domain leave the rest of it alone on
purpose.  Suffix statistics come from other folds than the row's own and are smoothed, so a row's label
isn't among its features.  Features are binned by fixed cut points and rows with equal bins are added
up first, so a boosting round is one small aggregation over (node, feature, bin); only these histograms,
of a fixed size, come to the driver, and every labelled URL takes part.
The fitted trees are one SQL expression.  All of it is DataFrame functions.

A few rules are an expression too.  Longer lists are a table: a URL's host suffixes are joined with the hosts
of rules by equality, then each suffix with the URL's path cut to the lengths that this host's rules have, by
equality with the rules.  So a URL meets a rule only where it fits, however many rules a host has.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm.common import bounded_broadcast, lower_ascii
from provena.session import cut_lineage

#: Rules beyond this number are joined instead of being part of the plan; both ways give the same rule.
MAX_PLANNED_RULES = 50


@dataclass(frozen=True)
class Rule:
    verdict: str  # "allow" or "block"
    rule: str  # host, then a path that starts with "/"

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return self.rule[len(self.host):]


def _steps(first: float, last: float, step: float) -> tuple[float, ...]:
    return tuple(round(first + i * step, 6) for i in range(int(round((last - first) / step)) + 1))


#: Cut points of every feature; a value's bin is the number of cuts below it.
CUTS: dict[str, tuple[float, ...]] = {
    "url_length": _steps(16, 240, 8), "host_length": _steps(6, 60, 3), "path_length": _steps(2, 120, 4),
    "depth": _steps(1, 12, 1), "host_labels": _steps(1, 8, 1), "digit_ratio": _steps(0.02, 0.6, 0.02), "entropy": _steps(1.0, 4.6, 0.1),
    "parameters": _steps(0, 10, 1), "hyphens": _steps(0, 8, 1),
    "suffix1_blocked": _steps(0.05, 0.95, 0.05), "suffix1_allowed": _steps(0.05, 0.95, 0.05), "suffix1_log_count": _steps(1, 20, 1),
}
#: Folds of the suffix statistics, and how many rows of the overall share they are smoothed with.
FOLDS, PRIOR_ROWS = 5, 5.0


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path; both empty for a null and without ``://``."""
    u = F.coalesce(url, F.lit(""))
    return (lower_ascii(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1)), F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule of the URL's host or a parent domain whose path the URL's path starts with (equal length: the first by text)."""
    fits = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(r.rule))
            for r in sorted(rules, key=lambda r: (-len(r.rule), r.rule))]
    return F.coalesce(F.lit(None).cast("string"), *fits)


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.verdict, r.rule) for r in rules], "verdict string, rule string")


def joined_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (a written table with ``host`` and ``path``) plus ``rule`` as ``matching_rule`` has it, and ``blocked``:
    whether that rule (null: none) blocks; a rule given with both verdicts does.  ``rules`` has ``verdict`` and ``rule``."""
    table = cut_lineage(rules.filter(F.col("rule").isNotNull()).groupBy("rule").agg(F.max(F.col("verdict") == "block").alias("blocked"))
                        .select("rule", F.coalesce("blocked", F.lit(False)).alias("blocked"), F.substring_index("rule", "/", 1).alias("suffix")))
    length = F.length("rule") - F.length("suffix")
    # Per host the lengths of its rules' paths: at most as many as the longest path has characters.
    hosts = cut_lineage(table.groupBy("suffix").agg(F.collect_set(length).alias("lengths")))
    labels = hosts.agg(F.max(F.size(F.split("suffix", r"\."))).alias("n")).first().n or 0
    if not labels:
        return urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("boolean").alias("blocked"))
    distinct = urls.select("host", "path").distinct()
    own = F.split("host", r"\.")
    suffixes = distinct.select("host", "path", own.alias("own"), F.explode(F.sequence(F.lit(1), F.least(F.size(own), F.lit(labels)))).alias("k")).select(
        "host", "path", F.array_join(F.slice("own", -F.col("k"), F.col("k")), ".").alias("suffix"))
    cuts = suffixes.join(bounded_broadcast(hosts), "suffix").select("host", "path", "suffix", F.explode("lengths").alias("l")).filter(
        F.col("l") <= F.length("path")).select("host", "path", F.concat("suffix", F.substring("path", F.lit(1), F.col("l"))).alias("rule"))
    found = cuts.join(bounded_broadcast(table.select("rule", "blocked")), "rule")
    best = found.groupBy("host", "path").agg(F.min(F.struct((-F.length("rule")).alias("l"), "rule", "blocked")).alias("best"))
    return urls.join(cut_lineage(best), ["host", "path"], "left").select(*[f"`{c}`" for c in urls.columns], "best.rule", "best.blocked")


def _entropy(text: Column) -> Column:
    """Entropy of the characters, from the run lengths of the sorted characters."""
    def close(a):
        return a["sum"] + F.when(a["run"] > 0, a["run"] * F.log(a["run"])).otherwise(0.0)

    start = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    walk = F.aggregate(F.sort_array(F.split(text, "")), start, lambda a, x: F.struct(
        x.alias("last"), F.when(x == a["last"], a["run"] + 1).otherwise(1.0).alias("run"),
        F.when(x == a["last"], a["sum"]).otherwise(close(a)).alias("sum")), close)
    n = F.length(text)
    return F.when(n > 0, F.log(n.cast("double")) - walk / n).otherwise(0.0)


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    u = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    out = {
        "url_length": F.length(u), "host_length": F.length(host), "path_length": F.length(path), "depth": _count(path, "/"),
        "host_labels": F.when(host == "", 0).otherwise(_count(host, ".") + 1), "digit_ratio": F.when(F.length(u) > 0, _count(u, "0123456789") / F.length(u)).otherwise(0.0),
        "entropy": _entropy(u), "parameters": F.when(query == "", 0).otherwise(_count(query, "&") + 1), "hyphens": _count(u, "-"),
    }
    return {k: v.cast("double").alias(k) for k, v in out.items()}


def _bin(feature: str) -> Column:
    return F.size(F.filter(F.array(*[F.lit(c) for c in CUTS[feature]]), lambda c: c < F.col(feature))).cast("int")


def _tree_value(tree: list, leaves: list[float], node: int = 0) -> Column:
    """A tree as nested CASE expressions over the bin columns."""
    if node >= len(tree):
        return F.lit(leaves[node - len(tree)])
    f, b = tree[node]
    if f is None:
        return _tree_value(tree, leaves, 2 * node + 1)
    return F.when(F.col(f"b_{f}") <= b, _tree_value(tree, leaves, 2 * node + 1)).otherwise(_tree_value(tree, leaves, 2 * node + 2))


def _node(tree: list, level: int, node: int = 0, depth: int = 0) -> Column:
    if depth == level:
        return F.lit(node)
    f, b = tree[node]
    if f is None:
        return _node(tree, level, 2 * node + 1, depth + 1)
    return F.when(F.col(f"b_{f}") <= b, _node(tree, level, 2 * node + 1, depth + 1)).otherwise(_node(tree, level, 2 * node + 2, depth + 1))


def _histogram(rows: DataFrame, node: Column, margin: Column, features: list[str]) -> dict:
    p = 1 / (1 + F.exp(-margin))
    cells = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"b_{f}").alias("b")) for f in features])
    return {(r.node, r.f, r.b): (r.g, r.h) for r in rows.select(node.alias("node"), (F.col("n") * p - F.col("ones")).alias("g"), (F.col("n") * p * (1 - p)).alias("h"),
            F.explode(cells).alias("c")).groupBy("node", "c.f", "c.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()}


def fit(binned: DataFrame, *, trees: int = 8, depth: int = 3, rate: float = 0.4, l2: float = 1.0, min_hessian: float = 1.0) -> Column:
    """The margin of "blocked" as an expression over the ``b_`` columns; ``binned`` is a written table of bins, ``n`` and ``ones``.

    Without labelled rows the margin is -1 (allow).  Gains are compared to nine digits, ties go to the
    first feature and the lowest cut, so reruns agree.
    """
    features = [f for f in CUTS if f"b_{f}" in binned.columns]
    n, ones = binned.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("ones"), F.lit(0))).first()
    if not n:
        return F.lit(-1.0)
    margin = F.lit(math.log((ones + 0.5) / (n - ones + 0.5)))
    for _ in range(trees if 0 < ones < n else 0):
        tree: list = []
        for level in range(depth):
            hist = _histogram(binned, _node(tree, level), margin, features)
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                best = (1e-6, None, 0)
                for f in features:
                    cells = sorted((b, g, h) for (nd, ff, b), (g, h) in hist.items() if nd == node and ff == f)
                    ga, ha = sum(c[1] for c in cells), sum(c[2] for c in cells)
                    gl = hl = 0.0
                    for b, g, h in cells[:-1]:
                        gl, hl = gl + g, hl + h
                        if min(hl, ha - hl) < min_hessian:
                            continue
                        gain = float(f"{gl**2 / (hl + l2) + (ga - gl)**2 / (ha - hl + l2) - ga**2 / (ha + l2):.9g}")
                        if gain > best[0]:
                            best = (gain, f, b)
                tree.append(best[1:])
        hist = _histogram(binned, _node(tree, depth), margin, features[:1])
        sums = [[sum(v[i] for (nd, _, _), v in hist.items() if nd == len(tree) + leaf) for i in (0, 1)] for leaf in range(2**depth)]
        margin = margin + _tree_value(tree, [-rate * g / (h + l2) for g, h in sums])
    return margin


def _suffix_statistics(rows: DataFrame, k: int, shares: tuple[float, float]) -> DataFrame:
    """Per last ``k`` labels and fold: the shares of rule-blocked and rule-allowed rows among the rows of all other folds."""
    cells = cut_lineage(rows.groupBy(f"suffix{k}", "fold").agg(
        F.count("*").alias("n"), F.count_if(F.col("blocked")).alias("b"), F.count_if(~F.col("blocked")).alias("a")))
    sums = cells.groupBy(f"suffix{k}").agg(*[F.sum(c).alias(f"all_{c}") for c in "nba"])
    other = {c: F.col(f"all_{c}") - F.col(c) for c in "nba"}
    smooth = lambda c, share: (other[c] + F.lit(PRIOR_ROWS * share)) / (other["n"] + F.lit(PRIOR_ROWS))
    return cells.join(sums, f"suffix{k}").select(
        f"suffix{k}", "fold", smooth("b", shares[0]).alias(f"suffix{k}_blocked"), smooth("a", shares[1]).alias(f"suffix{k}_allowed"),
        *([F.log2(F.col("all_n").cast("double")).alias("suffix1_log_count")] if k == 1 else []))


def filter_urls(pages: DataFrame, rules: list[Rule] | DataFrame, *, threshold: float = 0.5, undecided_weight: float = 0.5,
                id_col: str = "page_id", url_col: str = "url", **fit_options) -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)``: a row per input row.

    ``rules`` is a list, or a table with ``verdict`` and ``rule`` (as ``rule_table`` makes it) of any size.
    ``score`` is the trees' probability of "block"; it gives the verdict where no rule does.  A row that no rule decides,
    of a domain (last two labels of the host) of which a rule decides others, counts as ``undecided_weight`` of an
    allowed one in the training.  Null,
    empty and malformed URLs have empty parts and zero features, repeated rows keep a row each, without
    rule-decided URLs everything else is allowed, an empty table gives an empty result; other columns are not read.
    """
    url = F.col("url")
    read = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = url_parts(url)
    a = read.select("page_id", "url", host.alias("host"), path.alias("path"))
    if isinstance(rules, list) and len(rules) <= MAX_PLANNED_RULES:
        a = a.select("*", matching_rule(F.col("host"), F.col("path"), rules).alias("rule"))
        blocked = F.when(F.col("rule").isNotNull(), F.col("rule").isin([r.rule for r in rules if r.verdict == "block"]))
    else:
        a = joined_rules(cut_lineage(a), rule_table(pages.sparkSession, rules) if isinstance(rules, list) else rules)
        blocked = F.col("blocked")
    a = cut_lineage(a.select("page_id", "host", "path", "rule", blocked.alias("blocked"),
                             *[F.substring_index("host", ".", -k).alias(f"suffix{k}") for k in (1, 2)],
                             F.pmod(F.xxhash64(F.coalesce(url, F.lit(""))), F.lit(FOLDS)).alias("fold"),
                             *lexical(url, F.col("host"), F.col("path")).values()))
    rows, ones, zeros = a.agg(F.count("*"), F.count_if("blocked"), F.count_if(~F.col("blocked"))).first()
    stats = cut_lineage(_suffix_statistics(a, 1, (ones / max(1, rows), zeros / max(1, rows))))
    domains = cut_lineage(a.filter("blocked IS NOT NULL").select("suffix2").distinct().withColumn("ruled", F.lit(True)))
    full = a.join(bounded_broadcast(stats, 20_000), ["suffix1", "fold"]).join(bounded_broadcast(domains, 20_000), "suffix2", "left")
    bins = [_bin(f).alias(f"b_{f}") for f in CUTS]
    weight = F.when(F.col("blocked").isNull(), F.lit(float(undecided_weight))).otherwise(1.0)
    binned = cut_lineage(full.filter("ruled").select("blocked", weight.alias("w"), *bins).groupBy(*[f"b_{f}" for f in CUTS]).agg(
        F.sum("w").alias("n"), F.count_if("blocked").alias("ones")))
    margin = fit(binned, **fit_options)
    scored = full.select("page_id", "host", "path", "rule", "blocked", *bins).withColumn("score", 1 / (1 + F.exp(-margin)))
    block = F.coalesce(F.col("blocked"), F.col("score") >= threshold)
    return scored.select("page_id", "host", "path", "rule", F.when(block, "block").otherwise("allow").alias("verdict"), "score")
