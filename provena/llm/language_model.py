"""Language-model scores by deleted interpolation.

``P(w | context)`` is a mixture of the uniform distribution and the maximum-likelihood estimates of all orders.
The mixture weights depend on how often the longest known context was seen (a bucket per power of two), and are
learned by expectation-maximisation: a part of the training documents is deleted from the counts and its tokens
are the events.  Scores use the counts of all training documents.

An n-gram count is a lookup in a table that grows with the corpus, so it is never broadcast, nor joined token by
token.  Documents are packed into chunks of about half a million tokens.  A chunk asks for each distinct n-gram once:
its keys, sorted, go by key range to *buckets*, with its own counts of them.  A bucket adds up the counts of all
chunks and answers each chunk with the totals, in the order asked.  The same exchange thus counts and looks up,
an n-gram that half of all documents hold is one key per chunk, and a bucket's size is that of a key range.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm.common import fold, text_batches, valid_text
from provena.session import cut_lineage

#: Tokens of a chunk and keys of a bucket, about: bounds of a task's memory.
CHUNK_TOKENS, BUCKET_KEYS = 1 << 19, 1 << 20
#: What a document's tokens do: count, tune the weights (deleted from the counts then), or only get a score.
COUNTED, TUNING, HELD_OUT = 0, 1, 2
#: Places of the two marks in a chunk's vocabulary, and their hashes.
START, END = 0, 1
_MARKS = np.array([0x5354415254, 0x454E44], np.uint64)
#: Buckets of context frequency are powers of two; a level is (order, power).
POWERS = 64
#: EM gathers its events in cells of a quarter of an octave of each estimate.
CELLS_PER_OCTAVE = 4
MAX_ORDER = 5


class _Vocabulary(dict):
    """Numbers words as they come."""

    def __missing__(self, word):
        self[word] = number = len(self)
        return number


def _pack(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, by byte planes, compressed."""
    return zlib.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


class _Open:
    """A chunk that is being filled."""

    def __init__(self):
        self.words = _Vocabulary({"start": START, "end": END})  # text words are bytes, so marks can't clash with them
        self.tokens: list[np.ndarray] = []
        self.size = 0
        self.pieces: list[tuple] = []  # (row number, id, tokens, whether the document starts here)


def _encode(order: int, chunk_tokens: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task = TaskContext.get().partitionId() << 32
        made = 0
        opened: dict[int, _Open] = {}

        def close(part: int) -> pa.RecordBatch:
            nonlocal made
            c = opened.pop(part)
            rows, ids, sizes, starts = zip(*c.pieces)
            words = [*c.words][2:]
            hashes = np.concatenate([_MARKS, np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))])
            made += 1
            return pa.RecordBatch.from_arrays([
                pa.array([task + made], pa.int64()), pa.array([part], pa.int32()), pa.array([list(rows)], pa.list_(pa.int64())),
                pa.array([list(ids)], pa.list_(id_type)), pa.array([list(sizes)], pa.list_(pa.int64())), pa.array([list(starts)], pa.list_(pa.bool_())),
                pa.array([sum(sizes)], pa.int64()), pa.array([hashes.tobytes()], pa.binary()),
                pa.array([_pack(np.concatenate(c.tokens))], pa.binary())], names=["chunk", "part", "row", "ids", "size", "starts", "n", "words", "tokens"])

        id_type = None
        for batch in batches:
            id_type = batch.column("doc_id").type
            for row, doc_id, part, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "part", "text"))):
                words = text.lower().split()
                total, at = len(words) + 1, 0
                while at < total:
                    c = opened.setdefault(part, _Open())
                    end = min(total, at + chunk_tokens - c.size)
                    number = c.words.__getitem__
                    before = [number(w) for w in words[max(0, at - order + 1):at]]
                    c.tokens.append(np.array([START] * (order - 1 - len(before)) + before, np.int32))
                    piece = np.fromiter(map(number, words[at:end]), np.int32, min(end, len(words)) - at)
                    c.tokens.append(piece)
                    if end == total:
                        c.tokens.append(np.array([END], np.int32))
                    c.pieces.append((row, doc_id, end - at, at == 0))
                    c.size += end - at
                    at = end
                    if c.size >= chunk_tokens:
                        yield close(part)
        for part in [*opened]:
            yield close(part)

    return encode


def _chunk_schema(id_type: str) -> str:
    return (f"chunk long, part int, row array<long>, ids array<{id_type}>, size array<long>, starts array<boolean>, n long, "
            "words binary, tokens binary")


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Chunk:
    """A chunk's tokens with, per order, its distinct n-grams (sorted keys) and each place's number among them.

    A piece is laid out as ``order - 1`` tokens of context, then its tokens.  ``real`` marks the latter.  The last
    context place of a document's start is counted as well, so that the start mark has the frequency of a context.
    """

    def __init__(self, row: dict, order: int):
        words = np.frombuffer(row["words"], np.uint64)
        tokens = _unpack(row["tokens"])
        sizes = np.array(row["size"], np.int64)
        first = np.concatenate(([0], np.cumsum(sizes + order - 1)[:-1]))
        self.real = np.ones(len(tokens), bool)
        counted = np.ones(len(tokens), bool)
        for i in range(order - 1):
            self.real[first + i] = False
            counted[first + i] = np.array(row["starts"], bool) if i == order - 2 else False
        self.rows, self.sizes = np.array(row["row"], np.int64), sizes
        self.keys, self.place, self.counts = [], [], []
        key = words[tokens]
        for k in range(1, order + 1):
            if k > 1:
                key = np.concatenate((key[:1], _mixed(key[:-1], words[tokens[1:]])))
            # Places with fewer than k tokens of their own piece hold keys that run over a border: never counted, never used.
            unique, place = np.unique(key, return_inverse=True)
            whole = counted.copy()
            for i in range(min(k - 1, order - 1)):
                whole[first + i] = False
            self.keys.append(unique)
            self.place.append(place)
            self.counts.append(np.bincount(place[whole], minlength=len(unique)))


def _width(order: int) -> int:
    """Bytes of a key inside its bucket: words whole, longer n-grams 48 bits (buckets, and with them bits, grow with the corpus)."""
    return 8 if order == 1 else 6


def _bounds(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where the key ranges of ``2**bits`` buckets begin and end in sorted keys."""
    if not bits:
        return np.array([0, len(keys)])
    starts = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.append(np.searchsorted(keys, starts), len(keys))


def _asked(order: int, bits: list[int]):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = _Chunk(row, order)
                rows = []
                for k, (keys, counts, b) in enumerate(zip(c.keys, c.counts, bits), 1):
                    cut = _bounds(keys, b)
                    inner = (keys << np.uint64(b)) >> np.uint64(64 - 8 * _width(k))
                    raw = np.ascontiguousarray(inner.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_width(k)])
                    rows += [(k, i, row["chunk"], row["part"], raw[a:z].tobytes(), _pack(counts[a:z]))
                             for i, (a, z) in enumerate(zip(cut[:-1], cut[1:])) if z > a]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (
                    pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["ord", "bucket", "chunk", "part", "keys", "counts"])

    return ask


def _answered(start_key: int, start_bucket: int):
    def answer(table: pa.Table) -> pa.Table:
        k, bucket = table.column("ord")[0].as_py(), table.column("bucket")[0].as_py()
        width = _width(k)
        parts, keys, counts = table.column("part").to_pylist(), [], []
        for packed, c in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist()):
            raw = np.zeros((len(packed) // width, 8), np.uint8)
            raw[:, :width] = np.frombuffer(packed, np.uint8).reshape(-1, width)
            keys.append(raw.view("<u8").ravel())
            counts.append(_unpack(c))
        sizes = [len(x) for x in keys]
        unique, place = np.unique(np.concatenate(keys), return_inverse=True)
        role, count = np.repeat(parts, sizes), np.concatenate(counts)
        total = lambda *roles: np.bincount(place, np.where(np.isin(role, roles), count, 0), len(unique)).astype(np.int64)
        kept = total(COUNTED)
        full = kept + total(TUNING)
        cut = np.cumsum([0, *sizes])
        answers = [(_pack(full[place[a:z]]), _pack(kept[place[a:z]]) if part == TUNING else None) for part, a, z in zip(parts, cut[:-1], cut[1:])]
        types = full > 0
        if k == 1 and bucket == start_bucket:
            types &= unique != start_key  # the start mark is a context, not a token
        stats = [int(full[types].sum()), int(kept[types].sum()), int(types.sum())] if k == 1 else [0, 0, 0]
        first = [[x] + [0] * (len(sizes) - 1) for x in stats]  # the bucket's own sums, on its first row
        return pa.table({"chunk": table.column("chunk"), "ord": table.column("ord"), "bucket": table.column("bucket"), "part": table.column("part"),
                         "full": pa.array([a for a, _ in answers], pa.binary()), "kept": pa.array([b for _, b in answers], pa.binary()),
                         "tokens": pa.array(first[0], pa.int64()), "kept_tokens": pa.array(first[1], pa.int64()), "types": pa.array(first[2], pa.int64())})

    return answer


_ANSWERS = "chunk long, ord int, bucket long, part int, full binary, kept binary, tokens long, kept_tokens long, types long"


def _looked_up(c: _Chunk, answers: pa.Table, column: str, order: int) -> list[np.ndarray]:
    """Per order the count of the n-gram that ends at each place."""
    rows = sorted(zip(answers.column("ord").to_pylist(), answers.column("bucket").to_pylist(), answers.column(column).to_pylist()))
    return [np.concatenate([_unpack(x) for o, _, x in rows if o == k])[c.place[k - 1]] for k in range(1, order + 1)]


def _estimates(c: _Chunk, counts: list[np.ndarray], tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """For every real place the maximum-likelihood estimates of all orders (0 where the context is unknown), and the level."""
    at = np.flatnonzero(c.real)
    out = np.zeros((len(counts), len(at)))
    level = np.zeros(len(at), np.int64)
    for k, count in enumerate(counts, 1):
        seen = np.full(len(at), tokens) if k == 1 else counts[k - 2][at - 1]
        some = seen > 0
        out[k - 1, some] = count[at][some] / seen[some]
        level[some] = k * POWERS + np.floor(np.log2(seen[some])).astype(np.int64)
    return out, level


def _events(order: int, tokens: int):
    """Events of the tuning chunks by cell: ``(level, cell, n, sum of each estimate)``."""

    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        code, sums = [], []
        for row in left.to_pylist():
            c = _Chunk(row, order)
            f, level = _estimates(c, _looked_up(c, right, "kept", order), tokens)
            cell = level
            for x in f:
                octave = np.full(len(x), 255)
                octave[x > 0] = np.minimum(254, np.floor(-CELLS_PER_OCTAVE * np.log2(x[x > 0]))).astype(np.int64)
                cell = cell * 256 + octave
            unique, place = np.unique(cell, return_inverse=True)
            code.append(unique)
            sums.append([np.bincount(place, minlength=len(unique)).astype(float), *(np.bincount(place, x, len(unique)) for x in f)])
        code = np.concatenate(code) if code else np.zeros(0, np.int64)
        parts = [np.concatenate(x) for x in zip(*sums)] if sums else [np.zeros(0)] * (order + 1)
        return pa.table({"level": pa.array(code >> (8 * order)), "cell": pa.array(code)} | {f"s{i}": pa.array(x) for i, x in enumerate(parts)})

    return gather


def expectation_maximisation(n: np.ndarray, parts: np.ndarray, rounds: int = 100, prior: float = 1.0) -> np.ndarray:
    """Mixture weights of the components ``parts`` (a row each) for events of weight ``n``, with ``prior`` added to
    each component's expected count, so that none is ever zero."""
    weights = np.full(len(parts), 1 / len(parts))
    for _ in range(rounds):
        joint = weights[:, None] * parts
        expected = (joint / joint.sum(axis=0) * n).sum(axis=1) + prior
        new = expected / expected.sum()
        moved, weights = np.abs(new - weights).max(), new
        if moved < 1e-9:
            break
    return weights


def _learned(order: int, uniform: float):
    def learn(table: pa.Table) -> pa.Table:
        level = table.column("level")[0].as_py()
        n = table.column("s0").to_numpy()
        active = level // POWERS  # longer contexts than the longest known one say nothing
        parts = np.vstack([np.full(len(n), uniform), *(table.column(f"s{k}").to_numpy() / n for k in range(1, active + 1))])
        weights = expectation_maximisation(n, parts).tolist() + [0.0] * (order - active)
        return pa.table({"level": pa.array([level], pa.int64()), "weights": pa.array([weights], pa.list_(pa.float64()))})

    return learn


def _scored(order: int, tokens: int, types: int, weights: np.ndarray):
    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        found, ids, parts = [], [], []
        for row in left.to_pylist():
            c = _Chunk(row, order)
            counts = _looked_up(c, right, "full", order)
            f, level = _estimates(c, counts, tokens)
            w = weights[level]
            p = w[:, 0] / (types + 1)
            for k in range(order):
                p = p + w[:, k + 1] * f[k]
            word = counts[0][c.real]
            base = np.log10((word + 1) / (tokens + types + 1))
            starts = np.concatenate(([0], np.cumsum(c.sizes)[:-1]))
            parts += [row["part"] == HELD_OUT] * len(c.rows)
            ids += row["ids"]
            found.append((c.rows, c.sizes, np.add.reduceat((word > 0).astype(np.int64), starts), np.add.reduceat(base, starts),
                          np.add.reduceat(np.log10(p), starts)))
        rows, sizes, known, base, model = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 5
        return pa.table({"row": pa.array(rows, pa.int64()), "doc_id": pa.array(ids, left.schema.field("ids").type.value_type),
                         "held_out": pa.array(parts, pa.bool_()), "n_tokens": pa.array(sizes, pa.int64()), "n_known": pa.array(known, pa.int64()),
                         "base_score": pa.array(base, pa.float64()), "score": pa.array(model, pa.float64())})

    return score


def _default_weights(order: int) -> np.ndarray:
    """For levels without events: the components that its context can have, alike."""
    out = np.zeros(((order + 1) * POWERS, order + 1))
    for level in range(len(out)):
        out[level, :level // POWERS + 1] = 1 / (level // POWERS + 1)
    return out


def lm_scores(docs: DataFrame, *, order: int = 2, held_out_fold: int = 2, folds: int = 7, tuning_share: int = 10,
              chunk_tokens: int = CHUNK_TOKENS, bucket_keys: int = BUCKET_KEYS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``: a row per input row.

    Learns from the rows outside the held-out fold of their id; a null id is never learnt from and counts as held
    out.  One in ``tuning_share`` training ids (by hash) tunes the weights: its tokens are left out of the counts
    while the weights are learned, and belong to them afterwards.  Words are lower-cased (A-Z only) runs between
    ASCII white space; a null or word-less text is one token, the end.  Repeated rows and ids count and are
    returned each.  Malformed UTF-8 counts as U+FFFD.  An empty table gives an empty result; with no training row
    every token has probability 1.  Other columns are not read.

    Words are told apart by 64-bit hashes, longer n-grams by 48 bits inside their bucket, of which there are more
    the more text there is (under 0.002 expected pairs of equal keys a bucket).
    """
    if not 1 <= order <= MAX_ORDER:
        raise ValueError(f"order must be between 1 and {MAX_ORDER}")
    spark = docs.sparkSession
    text_batches(spark)
    remainder = F.when(F.col(id_col).isNull(), held_out_fold).otherwise(fold(F.col(id_col), folds))
    tuning = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(tuning_share)) == 0
    part = F.when(remainder == held_out_fold, HELD_OUT).when(tuning, TUNING).otherwise(COUNTED)
    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), part.alias("part"),
                           valid_text(F.col(text_col)).cast("binary").alias("text"))
    chunks = cut_lineage(numbered.mapInArrow(_encode(order, chunk_tokens), _chunk_schema(id_type)))
    size = chunks.agg(F.sum("n")).first()[0] or 0
    keys = [size // 8, *[size] * (order - 1)]  # words repeat, so there are fewer
    bits = [max(0, int(x // bucket_keys).bit_length()) for x in keys]
    ask = chunks.mapInArrow(_asked(order, bits), "ord int, bucket long, chunk long, part int, keys binary, counts binary")
    start = int(_MARKS[START])
    answers = cut_lineage(ask.groupBy("ord", "bucket").applyInArrow(
        _answered(start << bits[0] & (2**64 - 1), start >> (64 - bits[0])), _ANSWERS))
    stats = answers.agg(F.sum("tokens"), F.sum("kept_tokens"), F.sum("types")).first()
    tokens, kept, types = (int(x or 0) for x in stats)
    tuned = F.col("part") == TUNING
    cells = ", ".join(["level long", "cell long", *(f"s{i} double" for i in range(order + 1))])
    events = (chunks.filter(tuned).groupBy("chunk").cogroup(answers.filter(tuned).groupBy("chunk")).applyInArrow(_events(order, kept), cells)
              .groupBy("level", "cell").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(order + 1)]))
    weights = _default_weights(order)
    for r in events.groupBy("level").applyInArrow(_learned(order, 1 / (types + 1)), "level long, weights array<double>").collect():
        weights[r.level] = r.weights
    pieces = chunks.groupBy("chunk").cogroup(answers.select("chunk", "ord", "bucket", "full").groupBy("chunk")).applyInArrow(
        _scored(order, tokens, types, weights),
        f"row long, doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    # A document that was cut over several chunks comes in as many pieces.
    return pieces.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *[
        F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
