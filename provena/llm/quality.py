"""Quality classifier: histogram gradient-boosted trees over document statistics.

Fitting takes a bounded sample of the labelled rows (``max_train_rows``): their texts are filtered where
they are read and turned into a few dozen numbers on the executors; only those numbers reach the driver.
Scoring is one pass over the texts; the trees are a few kilobytes of arrays inside the task.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.llm import boosting
from provena.llm.common import fold, labelled_sample, text_batches, valid_text

MAX_TRAIN_ROWS = 20_000
THRESHOLD = 0.3

FEATURES = ("words", "word_length", "word_length_spread", "longest_word", "distinct_words", "top_word", "next_equal", "distinct_triples",
            "word_entropy", "lines", "distinct_lines", "line_words", "stopped_lines", "capitals", "digits", "symbols", "exclamations",
            "stops", "commas", "bars", "blanks", "high_bytes", "byte_entropy", "worst_line_symbols", "worst_line_capitals", "worst_line_repeats",
            "run")

_SYMBOLS = b"#*$%&|<>{}[]\\^~=_@+"
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Characters and words added to a line's size in its shares, so that a short line's few marks weigh little.
LINE_CHARS, LINE_WORDS = 20, 4


def _entropy(counts: np.ndarray) -> float:
    p = counts[counts > 0] / counts.sum()
    return float(-(p * np.log(p)).sum())


def statistics(text: str | None) -> list[float]:
    """The statistics named in ``FEATURES``; all zero for a null text and one without words."""
    data = text.encode() if text else b""
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    size = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lens = np.fromiter(map(len, words), np.int64, n)
    freq = Counter(words)
    lines = [ln for ln in data.split(b"\n") if ln.strip()]
    same = sum(map(operator.eq, words, words[1:]))
    triples = len(set(zip(words, words[1:], words[2:])))
    longest = run = 1
    if same:
        for a, b in zip(words, words[1:]):
            run = run + 1 if a == b else 1
            longest = max(longest, run)
    worst_symbols = worst_capitals = worst_repeats = 0.0
    for ln in set(lines):
        parts = ln.split()
        chars = len(ln) - len(parts) + 1 + LINE_CHARS
        worst_symbols = max(worst_symbols, (len(ln) - len(ln.translate(None, _SYMBOLS + b"!"))) / chars)
        worst_capitals = max(worst_capitals, (len(ln) - len(ln.translate(None, _CAPITALS))) / chars)
        repeated = len(parts) - 2 - len(set(zip(parts, parts[1:], parts[2:])))
        worst_repeats = max(worst_repeats, repeated / (len(parts) + LINE_WORDS))
    chars = int(lens.sum())
    count = lambda s: float(size[list(s)].sum())
    return [
        float(np.log1p(n)), chars / n, float(lens.std()), float(lens.max()), len(freq) / n, freq.most_common(1)[0][1] / n, same / n,
        triples / max(n - 2, 1), _entropy(np.fromiter(freq.values(), np.int64, len(freq))), float(np.log1p(len(lines))),
        len(set(lines)) / max(len(lines), 1), n / max(len(lines), 1), sum(ln.rstrip().endswith((b".", b"!", b"?")) for ln in lines) / max(len(lines), 1),
        float(size[65:91].sum()) / chars, float(size[48:58].sum()) / chars, count(_SYMBOLS) / chars, float(size[33]) / n, float(size[46]) / n,
        float(size[44]) / n, float(size[124]) / n, count(b" \t\r") / len(data), float(size[128:].sum()) / chars, _entropy(size),
        worst_symbols, worst_capitals, worst_repeats, float(longest),
    ]


def features(texts: pd.Series) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(-1, len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
          max_train_rows: int = MAX_TRAIN_ROWS, **fit_options) -> boosting.Trees:
    """Trees for label 1, from at most ``max_train_rows`` labelled rows outside the held-out fold.

    Without labels the model is a constant half.  Inputs are statistics of the text alone.
    """
    text_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, max_train_rows, id_col=id_col, text_col=text_col)

    @F.pandas_udf("array<double>")
    def stats(texts: pd.Series) -> pd.Series:
        return pd.Series(list(features(texts)))

    # Repeated document rows of an id can exceed the bound, hence the second limit, on rows of numbers.
    rows = (sample.select("id", "label", stats("text").alias("x")).orderBy(F.xxhash64("id"), "id", "x").limit(max_train_rows).collect())
    x = np.array([r.x for r in rows], np.float64).reshape(-1, len(FEATURES))
    return boosting.fit(x, np.array([r.label for r in rows], np.float64), **fit_options)


def scorer(model: boosting.Trees) -> Callable[[Column], Column]:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.probability(features(texts)))

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
                   **options) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``: a row per input row.

    Null and empty texts are scored like any text (by all-zero statistics), malformed UTF-8 as U+FFFD, a null id counts as held out,
    repeated rows keep a row each, an empty table gives an empty result, further columns are not read.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col, **options)
    return docs.select(F.col(id_col).alias("doc_id"), (fold(F.col(id_col)) == 0).alias("held_out"),
                       scorer(model)(valid_text(F.col(text_col))).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: boosting.Trees, *, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The input's rows and columns without the documents that score below ``threshold``."""
    text_batches(docs.sparkSession)
    return docs.filter(scorer(model)(valid_text(F.col(text_col))) >= threshold)
