"""Shared pieces of the corpus operators: table reading, word splitting, label folds, bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.session import cut_lineage

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of one batch of texts.
TEXT_BATCH_BYTES = 64 << 20
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_batches(spark: SparkSession, rows: int = 256) -> None:
    """Hand texts to Python in batches of at most ``rows`` (the default of 10,000 whole texts can outgrow a
    worker), and of about ``TEXT_BATCH_BYTES`` however long the texts are; one longer text is a batch of its own.
    Session settings, as plans read them when they run; smaller ones already set stay."""
    for name, bound in (("Records", rows), ("Bytes", TEXT_BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.max{name}PerBatch"
        if not 0 < int(spark.conf.get(key).rstrip("bB")) <= bound:
            spark.conf.set(key, str(bound))


def valid_text(c: Column) -> Column:
    """The text with malformed UTF-8 as U+FFFD, which Python can decode; null as an empty text."""
    return F.coalesce(F.make_valid_utf8(c), F.lit(""))


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would also change other alphabets)."""
    return F.translate(c, ASCII_UPPER, ASCII_UPPER.lower())


def fold(id_col: Column, folds: int = 5) -> Column:
    """The row's fold: crc32 of the id's decimal text modulo ``folds`` (null id: fold 0, so never learnt from)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds, F.lit(0))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, *, id_col: str = "doc_id",
                    text_col: str = "text", held_out_fold: int = 0, folds: int = 5) -> DataFrame:
    """At most ``max_rows`` labelled documents ``(id, text, label)`` outside the held-out fold, for fitting.

    The ids are the first ``max_rows`` by a hash of the id, so reruns agree.  That list has a proven
    bound, so it is broadcast and the documents are filtered where they are read, without moving texts.
    Null labels are ignored, repeated labels of an id count as their largest; null texts come as empty ones.
    """
    ids = (labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull())
           .filter(fold(F.col(id_col), folds) != held_out_fold)
           .groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("label"))
           .orderBy(F.xxhash64("id"), "id").limit(max_rows))
    texts = docs.select(F.col(id_col).alias("id"), valid_text(F.col(text_col)).alias("text"))
    return texts.join(F.broadcast(ids), "id")


def tasks_for(rows: int, per_task: int = 250_000) -> int:
    return max(1, -(-rows // per_task))


def settled(df: DataFrame, rows: int, per_task: int = 250_000) -> DataFrame:
    """``df`` written as a table by no more tasks (and files) than its number of small rows asks for; grows with ``rows``."""
    return cut_lineage(df.coalesce(tasks_for(rows, per_task)))


def bounded_broadcast(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows (counted; ``df`` should be a written
    table of small rows), else with one for a merge join with skew handling: left to Spark, the other side could be
    broadcast, which after an explode is taken for as few bytes as it had before."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df.hint("merge")


def columns_of(df: DataFrame, struct: str | None = None) -> list[Column]:
    """The frame's columns by exact name, or the fields ``struct`` has of them."""
    return [F.col(f"{struct}.`{c}`" if struct else f"`{c}`").alias(c) for c in df.columns]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bounded_texts(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, max_chars: int, *, id_col: str = "doc_id",
                  text_col: str = "text", extra: tuple[str, ...] = ()) -> list:
    """Rows ``(id, text, label, *extra)`` on the driver: labelled documents outside the held-out fold, in the order
    of a hash of their id, as far as ``max_rows`` rows and ``max_chars`` characters of whole texts go.  A text that
    doesn't fit into the characters left is passed over; shorter ones after it are still taken."""
    spark = docs.sparkSession
    sample = labelled_sample(docs, labels, label, max_rows, id_col=id_col, text_col=text_col)
    sizes = (sample.groupBy("id").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("n"))
             .orderBy(F.xxhash64("id"), "id").limit(max_rows).collect())
    ids, room = [], max_chars
    for r in sizes:
        if r.n <= room:
            room -= r.n
            ids.append(r.id)
    if not ids:
        return []
    chosen = labels.filter(F.col(label).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("label"))
    wanted = spark.createDataFrame([(i,) for i in ids], docs.select(F.col(id_col).alias("id")).schema)
    texts = docs.select(F.col(id_col).alias("id"), valid_text(F.col(text_col)).alias("text"), *extra).join(F.broadcast(wanted), "id")
    one = texts.groupBy("id").agg(F.min(F.struct("text", *extra)).alias("r"))
    return one.join(chosen, "id").select("id", "label", "r.*").orderBy(F.xxhash64("id"), "id").collect()
