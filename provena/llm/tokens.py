"""Token counts by offset-mapped attribution.

Every document is encoded once, as a whole (encoding sections on their own would cut tokens at their
borders).  The byte spans of its tokens, mapped to characters, are joined with the sections' spans by
binary search over the section borders; a token that crosses a border is allocated by a rule:

* ``most``: to the section that holds most of its bytes, the earlier one of equals;
* ``start``: to the section of its first byte;
* ``share``: to every section by its share of the bytes.

One pass over the texts, no shuffle; only ids and spans of one text are held at a time.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.llm.common import text_batches, valid_text

RULES = ("most", "start", "share")

#: The encoder's pattern overflows its stack on far longer runs of white space than this.
_LONG_RUN = 4096


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


class Encoder:
    """A byte-level BPE from a rank file; a special token's string in a text is ordinary text."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.width[i] = len(token)
        self.runs = re.compile(r"\s{%d,}" % _LONG_RUN)

    def encode(self, text: str) -> np.ndarray:
        """Token ids.  A very long run of white space is one piece but for its last character (all of it at the
        text's end), as the pattern has it; it is encoded directly."""
        out, at = [], 0
        for m in self.runs.finditer(text):
            end = m.end() if m.end() == len(text) else m.end() - 1
            out.append(self.bpe.encode_ordinary(text[at:m.start()]))
            out.append(self.bpe._encode_single_piece(text[m.start():end]))
            at = end
        out.append(self.bpe.encode_ordinary(text[at:]))
        return np.concatenate([np.array(x, np.int64) for x in out])


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def char_starts(text: str) -> np.ndarray:
    """Byte offset of every character, and of the end."""
    data = np.frombuffer(text.encode(), np.uint8)
    return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


def line_sections(text: str) -> list[tuple[int, int]]:
    """The lines, each with its line break."""
    ends = [m.end() for m in re.finditer("\n", text)]
    cuts = [0, *ends] if ends and ends[-1] == len(text) else [0, *ends, len(text)]
    return list(zip(cuts, cuts[1:])) or [(0, 0)]


def attribute(widths: np.ndarray, sections: list[tuple[int, int]], starts: np.ndarray, rule: str = "most") -> tuple[np.ndarray, float, np.ndarray]:
    """Tokens of every section, tokens outside all of them, and how many tokens that touch a section cross its border.

    ``sections`` are (from, to) in characters, in any order; out-of-range ends are moved inside, of
    overlapping sections the one that starts (then ends, then stands) earlier has the common part.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    n = len(starts) - 1
    order = sorted(range(len(sections)), key=lambda i: (*sections[i], i))
    borders, owner, at = [0], [], 0  # stretches of bytes and their sections (-1: none)
    for i in order:
        a, b = (min(max(x, 0), n) for x in sections[i])
        a, b = int(starts[a]), int(starts[b])
        a = max(a, at)
        if b <= a:
            continue
        if a > at:
            borders.append(a)
            owner.append(-1)
        borders.append(b)
        owner.append(i)
        at = b
    if at < starts[-1]:
        borders.append(int(starts[-1]))
        owner.append(-1)
    counts, crossing, outside = np.zeros(len(sections)), np.zeros(len(sections), np.int64), 0.0
    if not len(widths) or not owner:
        return counts, outside, crossing
    ends = np.cumsum(widths)
    begins = ends - widths
    cut, own = np.array(borders), np.array(owner)
    first, last = np.searchsorted(cut, begins, "right") - 1, np.searchsorted(cut, ends, "left") - 1
    whole = first == last
    per = np.bincount(first[whole], minlength=len(own)).astype(float)
    cross = np.zeros(len(own), np.int64)
    for t in np.flatnonzero(~whole):
        span = np.arange(first[t], last[t] + 1)
        part = np.minimum(cut[span + 1], ends[t]) - np.maximum(cut[span], begins[t])
        cross[span] += 1
        if rule == "share":
            per[span] += part / part.sum()
        elif rule == "start":
            per[span[0]] += 1
        else:
            _, at, which = np.unique(own[span], return_index=True, return_inverse=True)
            size = np.bincount(which, part)
            per[span[min(at[size == size.max()])]] += 1
    np.add.at(counts, own[own >= 0], per[own >= 0])
    np.add.at(crossing, own[own >= 0], cross[own >= 0])
    return counts, float(per[own < 0].sum()), crossing


def field_sections(fields: list[str], separator: str = "\n") -> tuple[Column, Column]:
    """One text of several string columns, and where each of them stands in it (a null one is empty).

    For ``token_counts``: the columns are encoded as one document, as they are trained on, and its tokens
    attributed to them in the order given; what the separators hold is outside.
    """
    parts = [valid_text(F.col(f"`{f}`")) for f in fields]
    spans, at = [], F.lit(0).cast("long")
    for p in parts:
        end = at + F.length(p)
        spans.append(F.struct(at.alias("a"), end.alias("b")))
        at = end + len(separator)
    return F.concat(*[x for p in parts for x in (F.lit(separator), p)][1:]), F.array(*spans)


def token_counts(docs: DataFrame, sections: Column | None = None, *, rule: str = "most", vocabulary: str | None = None, pattern: str | None = None,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, section, from_char, to_char, n_tokens, n_crossing, doc_tokens)``: a row per section of every document row.

    ``sections``: an array of structs (from, to) in characters, by default the lines.  Section -1 has the
    tokens outside all sections, if any.  ``n_tokens`` is fractional under the rule ``share`` only; a
    document's ``n_tokens`` add up to its ``doc_tokens``.  A null or empty text has no tokens (by default
    one empty line; with null or empty sections one row of section -1), malformed UTF-8 counts as U+FFFD,
    repeated rows repeat, an empty table gives an empty result.
    """
    text_batches(docs.sparkSession)
    path, pat = vocabulary or default_vocabulary(), pattern or default_pattern()
    given = sections is not None
    cols = [F.col(id_col).alias("doc_id"), valid_text(F.col(text_col)).alias("text")]
    read = docs.select(*cols, sections.cast("array<struct<a: long, b: long>>").alias("sections")) if given else docs.select(*cols)
    kind = read.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "section", "from_char", "to_char", "n_tokens", "n_crossing", "doc_tokens"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pat)
        for b in batches:
            spans_of = b.column("sections").to_pylist() if given else None
            rows: list[tuple] = []
            at: list[int] = []
            for k, text in enumerate(b.column("text").to_pylist()):
                text = text or ""
                spans = [(s["a"] or 0, s["b"] or 0) for s in spans_of[k] or [] if s] if given else line_sections(text)
                widths = enc.width[enc.encode(text)] if text else np.zeros(0, np.int64)
                counts, outside, crossing = attribute(widths, spans, char_starts(text), rule)
                rows += [(i, a, z, c, x, len(widths)) for i, ((a, z), c, x) in enumerate(zip(spans, counts.tolist(), crossing.tolist()))]
                at += [k] * len(spans)
                if outside or not spans:
                    rows.append((-1, 0, len(text), outside, 0, len(widths)))
                    at.append(k)
            if not rows:
                continue
            types = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at)), *[pa.array(c, t) for c, t in zip(zip(*rows), types)]], names=names)

    return read.mapInArrow(count, f"doc_id {kind}, section int, from_char long, to_char long, n_tokens double, n_crossing long, doc_tokens long")
