"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of ``k`` edits is cut into ``k + 1`` pieces: wherever it occurs with at
most ``k`` edits, one piece is intact.  All pieces of a block of items are searched in one pass over a
text (Aho-Corasick); around a hit a count of shared three-letter runs, which ``k`` edits can only lower
by ``3 k``, discards most chance hits, and Myers' bit-parallel distance decides the rest exactly.

Texts and items are compared in lower case with white space runs as one blank.  Items come to the tasks in
blocks of bounded size, each of which passes over the texts once; nothing is shuffled.  The driver holds one
block at a time: with several, what a block found (or left) is written before the next is read.

Items under ``MIN_CHARS`` characters have no error budget and count as whole words only: one edit in a few
letters, or a few letters inside a word, are found in clean texts all over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from provena.llm.common import text_batches, valid_text
from provena.session import cut_lineage

ERROR_RATE = 0.10
MIN_CHARS = 20
BLOCK_CHARS = 4_000_000


def normalise(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def myers(pattern: str, text: str, peq: dict[str, int] | None = None) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any stretch of ``text``, and the first place after such a stretch."""
    m = len(pattern)
    peq = letters(pattern) if peq is None else peq
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = mask, 0, m, m, 0
    get = peq.get
    for i, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (mask & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best, end = score, i + 1
        ph = (ph << 1) & mask
        pv = ((mh << 1) & mask) | (mask & ~(xv | ph))
        mv = ph & xv
    return best, end


def letters(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def _triples(s: str) -> set[str]:
    return {s[i:i + 3] for i in range(len(s) - 2)}


@dataclass
class _Item:
    id: object
    text: str
    budget: int
    peq: dict[str, int]
    back: dict[str, int]
    triples: list[str]


class Matcher:
    """Finds a block of items in texts.  Items shorter than ``min_chars`` are matched without errors, as whole words;
    empty ones never."""

    def __init__(self, items: list[tuple[object, str | None]], rate: float = ERROR_RATE, min_chars: int = MIN_CHARS) -> None:
        self.items: list[_Item] = []
        self.pieces = ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int, int]]] = {}
        for item_id, raw in items:
            t = normalise(raw)
            if not t:
                continue
            k = int(rate * len(t)) if len(t) >= min_chars else 0
            n = len(self.items)
            self.items.append(_Item(item_id, t, k, letters(t), letters(t[::-1]), [t[i:i + 3] for i in range(len(t) - 2)]))
            for j in range(k + 1):
                a, b = len(t) * j // (k + 1), len(t) * (j + 1) // (k + 1)
                at.setdefault(t[a:b], []).append((n, a, b))
        for piece, where in at.items():
            self.pieces.add_word(piece, where)
        self.pieces.make_automaton()
        self.min_chars = min_chars

    def _verify(self, it: _Item, text: str, lo: int, hi: int) -> tuple[int, int, int] | None:
        window = text[lo:hi]
        if it.budget == 0:
            p = window.find(it.text)
            while p >= 0 and len(it.text) < self.min_chars:
                a, b = lo + p, lo + p + len(it.text)
                if (a == 0 or text[a - 1] == " ") and (b == len(text) or text[b] == " "):
                    break
                p = window.find(it.text, p + 1)
            return (0, lo + p, lo + p + len(it.text)) if p >= 0 else None
        need = len(it.triples) - 3 * it.budget
        if need > 0:
            here = _triples(window)
            if sum(map(here.__contains__, it.triples)) < need:
                return None
        errors, end = myers(it.text, window, it.peq)
        if errors > it.budget:
            return None
        back, start = myers(it.text[::-1], window[max(0, end - len(it.text) - errors):end][::-1], it.back)
        return errors, lo + end - start, lo + end

    def find(self, raw: str | None) -> list[tuple[object, int, int, int, int]]:
        """``(item id, item length, edits, from, to)`` of every item that occurs, at its best place (the first of equals)."""
        text = normalise(raw)
        if not text or not self.items:
            return []
        near: dict[int, list[tuple[int, int]]] = {}
        for end, where in self.pieces.iter(text):
            for n, a, b in where:
                it = self.items[n]
                lo = end + 1 - b - it.budget
                near.setdefault(n, []).append((max(lo, 0), min(lo + len(it.text) + 2 * it.budget, len(text))))
        out = []
        for n, windows in sorted(near.items()):
            it, best = self.items[n], None
            windows.sort()
            lo, hi = windows[0]
            for a, b in [*windows[1:], (len(text) + 1, 0)]:
                if a <= hi and b - lo <= 4 * len(it.text) + 64:  # near windows are checked as one
                    hi = max(hi, b)
                    continue
                got = self._verify(it, text, lo, hi)
                best = got if got and (best is None or got < best) else best
                lo, hi = a, b
            if best:
                out.append((it.id, len(it.text), *best))
        return out


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text",
                block_chars: int = BLOCK_CHARS) -> Iterator[tuple[list[tuple[object, str]], bool]]:
    """The items in blocks of about ``block_chars`` characters, dealt by a hash, and whether a block is the last.  Each is
    one small list on the driver; a caller that keeps none (in plans neither) has one there at a time."""
    rows = items.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), valid_text(F.col(text_col)).alias("text")).distinct()
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_chars))
    for k in range(blocks if total else 0):
        yield [(r.id, r.text) for r in rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).collect()], k == blocks - 1


def benchmark_hits(docs: DataFrame, items: DataFrame, *, rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, id_col: str = "doc_id",
                   text_col: str = "text", item_col: str = "item_id", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(doc_id, item_id, item_chars, edits, from_char, to_char)``: a row for every document row and item that occurs in it.

    Places count in the compared form of the text.  Null and empty texts and items match nothing, repeated
    rows repeat their hits, items of equal text are each found, an empty table on either side gives an empty result.
    """
    text_batches(docs.sparkSession)
    read = docs.select(F.col(id_col).alias("doc_id"), valid_text(F.col(text_col)).alias("text"))
    item_kind = items.select(item_col).schema[0].dataType
    schema = (f"doc_id {read.schema['doc_id'].dataType.simpleString()}, item_id {item_kind.simpleString()}, item_chars int, edits int, "
              "from_char long, to_char long")
    item_type = to_arrow_type(item_kind)
    names = ["doc_id", "item_id", "item_chars", "edits", "from_char", "to_char"]

    def scan_for(block: list[tuple[object, str]]):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = Matcher(block, rate, min_chars)
            for b in batches:
                rows = [(d, *h) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for h in found.find(t)]
                if rows:
                    ids, things, *rest = map(list, zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, b.column("doc_id").type), pa.array(things, item_type), *[pa.array(r, t) for r, t in zip(
                            rest, (pa.int32(), pa.int32(), pa.int64(), pa.int64()))]], names=names)
        return scan

    out = docs.sparkSession.createDataFrame([], schema)
    for block, last in item_blocks(items, item_col, block_chars=block_chars):
        found = read.mapInArrow(scan_for(block), schema)
        out = out.unionByName(found if last else cut_lineage(found))
    return out


def without_benchmarks(docs: DataFrame, items: DataFrame, *, rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, text_col: str = "text",
                       item_col: str = "item_id", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The input's rows and columns without the documents in which an item occurs.

    Items in several blocks write what is left of the input once for each block but the last.
    """
    text_batches(docs.sparkSession)

    def holds(block: list[tuple[object, str]]) -> Column:
        kept: list[Matcher] = []  # one per Python process

        @F.pandas_udf("boolean")
        def any_item(texts: pd.Series) -> pd.Series:
            if not kept:
                kept.append(Matcher(block, rate, min_chars))
            return pd.Series([bool(kept[0].find(t)) for t in texts], dtype=bool)

        return any_item(valid_text(F.col(text_col)))

    out = docs
    for block, last in item_blocks(items, item_col, block_chars=block_chars):
        out = out.filter(~holds(block))
        if not last:
            out = cut_lineage(out)
    return out
