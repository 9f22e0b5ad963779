"""Small tables with the awkward cases: nulls, empty and long texts, repeats, clashing columns."""

import numbers

import duckdb
import pandas as pd
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet " * 8000

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog again and again", "en", "b"),
    (2, "The quick brown fox jumps over the lazy dog again and again", "en", "b"),
    (3, None, None, None),
    (4, "", "", ""),
    (5, " \t\n ", "de", "a"),
    (None, "no id here at all", "en", None),
    (None, None, "en", "b"),
    (6, LONG, "en", "a"),
    (7, "one", "fr", "c"),
    (7, "another text of the same id", "fr", "c"),
    (8, "ÄÖÜ straße 中文 ünïcode \U0001f600 words", "de", "ü"),
]


def malformed(df, text="text"):
    """``df`` and its rows once more, their texts with bytes that are no UTF-8 before, in and after them."""
    broken = "concat(cast(X'C3' AS string), {0}, cast(X'20ff4120' AS string), {0}, cast(X'20ED' AS string))".format(f"coalesce(`{text}`, '')")
    return df.unionByName(df.withColumn(text, F.expr(broken)))


def docs(spark, rows=ROWS, extra=False):
    df = spark.createDataFrame([(i, t, l, s, len(t or "")) for i, t, l, s in rows], SCHEMA)
    if extra:
        for c in ("fp", "row", "stats", "size", "score", "label", "id", "sections", "kept", "repetition", "at", "__t"):
            df = df.selectExpr("*", f"'x' AS `{c}`")
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def sql(statement, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(f"_{name}", df.toArrow())
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM _{name}")
    return con.execute(statement).df()


def same(a: pd.DataFrame, b: pd.DataFrame) -> bool:
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)

    def one(v):
        if pd.isna(v):
            return ""
        return repr(round(float(v), 9)) if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)

    def canon(df):
        return sorted(tuple(map(one, r)) for r in df[cols].itertuples(index=False))
    return canon(a) == canon(b)
