"""Ranked lexical search by NRA ("no random access") over impact-sorted lists.

The corpus is scanned once: every document's length and the occurrences of the items' terms are written as a
table, from which Spark adds up the statistics all scores need.  The index is divided by documents.  A shard
holds, for each term, its documents sorted by falling impact, and answers every item by itself: lists are read
from the top, every document met has an interval (what its lists gave so far, plus what the lists that haven't
shown it can still give), and reading goes on until no unread document can enter or tie, no document outside can
reach the last place, and the intervals of those left have closed.  A shard's answers have at most ``k`` rows an
item, with exact scores, so the best ``k`` of all shards are the corpus's best ``k``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provena.llm.common import lower_ascii, text_batches, valid_text
from provena.session import cut_lineage

#: A term: a run of ASCII letters, digits and anything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same on UTF-8 bytes: capitals to small letters, other ASCII to a space.
_BYTES = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))
#: Pairs (item, term) that are answered in one pass over the corpus.
BLOCK_TERMS = 1_000_000
#: A shard ends at so many documents or postings: it bounds a task's memory, not the result.
SHARD_DOCS, SHARD_POSTINGS = 1 << 16, 1 << 21


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct ``(id, term)``; rows that share an id are one item with the terms of all."""
    terms = F.array_distinct(F.regexp_extract_all(lower_ascii(valid_text(F.col(text_col))), F.lit(TERM), F.lit(0)))
    return items.select(F.col(id_col).alias("id"), F.explode(terms).alias("term")).distinct()


def _counts(docs: DataFrame, wanted: dict[bytes, int], id_type: T.DataType) -> DataFrame:
    """``(doc, n, terms, counts)`` of every document with a term; ``terms`` are the wanted ones it holds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes, ends, terms, counts = [], [], [0], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                words = text.translate(_BYTES).split()
                if words:
                    held = Counter(wanted[w] for w in words if w in wanted)
                    rows.append(row)
                    sizes.append(len(words))
                    terms += held.keys()
                    counts += held.values()
                    ends.append(len(terms))
            at = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc").take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(at, pa.array(counts, pa.int64()))],
                names=["doc", "n", "terms", "counts"])

    schema = T.StructType([T.StructField("doc", id_type), T.StructField("n", T.LongType()),
                           T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.LongType()))])
    return docs.mapInArrow(count, schema)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norms(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """``100 - 90 + (90 * n * N) div L``."""
    if 90 * int(n.max(initial=0)) * n_docs < 2**63:
        return 10 + 90 * n * n_docs // n_terms
    return np.array([10 + 90 * int(x) * n_docs // n_terms for x in n], dtype=np.int64)


def nra(lists: list[tuple[np.ndarray, np.ndarray]], size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents ``0 .. size - 1`` that may be among the best ``k`` of an item, ties of the last place included, and
    their exact scores.

    ``lists``: per term the documents that hold it and what they gain by it, falling and positive.  A round reads
    every list down to a level, a quarter of the last one.  ``rest`` is the most that a document can gain from
    all unread parts.
    """
    low = np.zeros(size, np.int64)
    alive, closed = np.zeros(0, np.int64), False
    read = [0] * len(lists)
    falling = [-gains for _, gains in lists]
    level = max((int(gains[0]) for _, gains in lists), default=0)
    while lists:
        level //= 4
        ceilings = []
        for i, (docs, gains) in enumerate(lists):
            end = int(np.searchsorted(falling[i], -level, "right"))
            if end > read[i]:
                low[docs[read[i]:end]] += gains[read[i]:end]
                read[i] = end
            ceilings.append(int(gains[end]) if end < len(gains) else 0)
        rest = sum(ceilings)
        if not closed:
            alive = np.flatnonzero(low)
        last = int(np.partition(low[alive], -k)[-k]) if len(alive) >= k else 0
        if not closed and rest and rest >= last:
            continue  # an unread document could enter or tie
        closed = True  # from here on only documents already met matter
        met = np.zeros(size, np.int64)
        for (docs, _), end, ceiling in zip(lists, read, ceilings):
            if ceiling:
                met[docs[:end]] += ceiling
        open_by = rest - met[alive]
        stays = low[alive] + open_by >= last
        alive, open_by = alive[stays], open_by[stays]
        if not open_by.any():
            break
    return alive, low[alive]


def _shard(docs: pa.Array, n: np.ndarray, term: np.ndarray, count: np.ndarray, sizes: np.ndarray, weights: np.ndarray,
           items: list[np.ndarray], totals: tuple[int, int], k: int) -> tuple[list[int], list[int], list[int]]:
    """Item numbers, places of documents and scores of the shard's best ``k`` of every item."""
    place = np.repeat(np.arange(len(n)), sizes)
    gain = weights[term] * (1_000_000_000 * count // (1000 * count + 8 * length_norms(n, *totals)[place]))
    some = gain > 0
    term, place, gain = term[some], place[some], gain[some]
    order = np.lexsort((-gain, term))
    term, place, gain = term[order], place[order], gain[order]
    starts = np.searchsorted(term, np.arange(len(weights) + 1))
    by_id = np.empty(len(n), np.int64)
    by_id[pc.sort_indices(docs, sort_keys=[("", "ascending")], null_placement="at_end").to_numpy()] = np.arange(len(n))
    which, where, scores = [], [], []
    for number, terms in enumerate(items):
        lists = [(place[a:b], gain[a:b]) for a, b in zip(starts[terms], starts[terms + 1]) if b > a]
        found, score = nra(lists, len(n), k)
        first = np.lexsort((by_id[found], -score))[:k]
        which += [number] * len(first)
        where += found[first].tolist()
        scores += score[first].tolist()
    return which, where, scores


def _answers(table: DataFrame, id_type: T.DataType, weights: np.ndarray, items: list[np.ndarray], totals: tuple[int, int], k: int) -> DataFrame:
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            column = lambda c: t.column(c).chunk(0) if t.column(c).num_chunks else t.column(c).combine_chunks()
            terms = column("terms")
            docs = column("doc")
            which, where, scores = _shard(
                docs, column("n").to_numpy(), terms.flatten().to_numpy().astype(np.int64), column("counts").flatten().to_numpy(),
                pc.list_value_length(terms).to_numpy(), weights, items, totals, k)
            return pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), docs.take(pa.array(where, pa.int64())), pa.array(scores, pa.int64())],
                                              names=["number", "doc_id", "score"])

        rows = postings = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows, postings = rows + batch.num_rows, postings + len(batch.column("terms").flatten())
            if rows >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                yield flush()
                rows = postings = 0
        if held:
            yield flush()

    schema = T.StructType([T.StructField("number", T.IntegerType()), T.StructField("doc_id", id_type), T.StructField("score", T.LongType())])
    return table.mapInArrow(answer, schema)


def _ranked(answers: DataFrame, k: int, by: str) -> DataFrame:
    best: list[Column] = [F.desc("score"), F.asc_nulls_last("doc_id")]
    return answers.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*best))).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, *, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_id_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of every item with a score above 0.

    Null and term-less texts are no documents and no items; an item without a document that holds one of its
    terms has no row.  Rows that share an item id (null ids too) are one item with the terms of all of them.
    Every document row is a document of its own, so repeated rows and ids are ranked each; equal scores go by
    ascending id, a null id last.  Malformed UTF-8 counts as U+FFFD, a letter.  Empty tables give an empty result;
    other columns are not read.

    Items are answered in blocks of about ``block_terms`` (item, term) pairs, an item never split; a block costs one
    scan of the corpus, and only its terms and their document counts are on the driver.
    """
    spark = docs.sparkSession
    text_batches(spark)
    doc_type = docs.select(id_col).schema[0].dataType
    item_field = items.select(F.col(item_id_col).alias("item_id")).schema[0]
    pairs = cut_lineage(item_terms(items, item_id_col, item_text_col))
    blocks = -(-pairs.count() // block_terms)
    texts = docs.select(F.col(id_col).alias("doc"), valid_text(F.col(text_col)).cast("binary").alias("text"))
    out = None
    for block in range(blocks):
        rows = pairs.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).collect()
        wanted = {t: i for i, t in enumerate(sorted({r.term for r in rows}))}
        of_item: dict = {}
        for r in rows:
            of_item.setdefault(r.id, []).append(wanted[r.term])
        names, terms = list(of_item), [np.array(sorted(t), np.int64) for t in of_item.values()]
        table = cut_lineage(_counts(texts, {t.encode(): i for t, i in wanted.items()}, doc_type))
        total = table.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        weights = np.zeros(len(wanted), np.int64)
        for r in table.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():
            weights[r.term] = weight(total.docs, r.df)
        found = _ranked(_answers(table, doc_type, weights, terms, (total.docs, total.terms or 1), k), k, "number")
        named = spark.createDataFrame([*enumerate(names)], T.StructType([T.StructField("number", T.IntegerType()),
                                                                       T.StructField("item_id", item_field.dataType)]))
        part = found.join(F.broadcast(named), "number").select("item_id", "rank", "doc_id", "score")
        part = part if blocks == 1 else cut_lineage(part)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], T.StructType([T.StructField("item_id", item_field.dataType), T.StructField("rank", T.IntegerType()),
                                                       T.StructField("doc_id", doc_type), T.StructField("score", T.LongType())]))
    return out
