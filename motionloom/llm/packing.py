"""Best-fit-decreasing packing of token sequences.

Pieces are told apart by length only, and there are no more lengths than a sequence has tokens. So the packing
itself works on the histogram of lengths: classes go down in length, and a segment tree over remaining
capacities finds the tightest open bin for a length in logarithmic time. All bins of a group share one history,
so what best fit would do piece by piece is done for whole groups at once, with the same outcome. The tables
that result depend on the number of lengths, not on the number of documents; each piece finds its place from
its rank within its length.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motionloom.llm.common import freed, materialise

#: Bytes that a worker's cache of encoded units may take; characters in a block of texts and in a call of the tokenizer.
CACHE_BYTES = 64 << 20
BLOCK_CHARS, CALL_CHARS = 8_000_000, 100_000
#: Texts with other characters than Latin-1, or with what may be a special token, keep their case until they are encoded.
KEEPS_CASE = r"[^\x{00}-\x{ff}]|<\|"
STOP = r"([a-z0-9\x{df}-\x{f6}\x{f8}-\x{ff}])([.,])(\s|$)"
#: The normaliser and pre-tokenizer under which no token spans white space and case is dropped.
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
MARK = "\x01"


class CapacityTree:
    """Numbers of open bins by remaining capacity; :meth:`tightest` is the least capacity that has one and suffices."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.sums = [0] * (2 * self.size)

    def add(self, remaining: int, n: int) -> None:
        at = self.size + remaining
        while at:
            self.sums[at] += n
            at >>= 1

    def tightest(self, least: int) -> int | None:
        at = self.size + least
        if self.sums[at]:
            return least
        while at > 1 and not (at % 2 == 0 and self.sums[at + 1]):
            at >>= 1
        if at <= 1:
            return None
        at += 1
        while at < self.size:
            at *= 2
            if not self.sums[at]:
                at += 1
        return at - self.size


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Placements of all pieces and the number of bins.

    A placement row is (length, first rank, end rank, first bin, pieces a bin, offset): the piece of this length
    with rank first + i goes to bin first bin + i // pieces a bin, at offset + (i % pieces a bin) * length.
    """
    tree, stacks, bins, out = CapacityTree(capacity), {}, 0, []

    def put(remaining: int, start: int, n: int) -> None:
        if n and remaining:
            stacks.setdefault(remaining, []).append((start, n))
            tree.add(remaining, n)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            r = tree.tightest(length)
            if r is None:
                n = -(-left // (capacity // length))
                put(capacity, bins, n)
                bins += n
                continue
            start, n = stacks[r].pop()
            tree.add(r, -n)
            each = r // length
            full = min(n, left // each)
            if full:
                out.append((length, rank, rank + full * each, start, each, capacity - r))
                put(r - each * length, start, full)
                rank, left, start, n = rank + full * each, left - full * each, start + full, n - full
            if n and left and left < each:
                out.append((length, rank, rank + left, start, each, capacity - r))
                put(r - left * length, start, 1)
                rank, left, start, n = rank + left, 0, start + 1, n - 1
            put(r, start, n)
    return np.array(out, dtype=np.int64).reshape(-1, 6), bins


class WordTokens:
    """Ids of whole texts; where the tokenizer drops white space and never joins what it separates, units are encoded once.

    That a tokenizer file does so is read from the file: any other than BY_WORDS encodes whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = {k: part and json.loads(part.__getstate__()) for k, part in (("normalizer", self.tokenizer.normalizer), ("pre_tokenizer", self.tokenizer.pre_tokenizer))}
        self.by_words = rules == BY_WORDS and not self.tokenizer.truncation and not self.tokenizer.padding
        mark = self._direct([MARK])[0]
        self.mark = int(mark[0]) if len(mark) == 1 else None
        self.clear()

    def clear(self) -> None:
        self.words, self.held = {}, 0
        self.pool, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _direct(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, words: list[str]) -> None:
        """Encode new units; many go into one call, with a mark between them whose id tells them apart."""
        apart = [w for w in words if self.mark is None or MARK in w]
        plain = words if not apart else [w for w in words if self.mark is not None and MARK not in w]
        block = np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)) + 3) // CALL_CHARS
        edge = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(plain)]
        calls = [plain[i:j] for i, j in zip(edge, edge[1:]) if j > i]
        order, sizes, pools = [], [self.size], [self.pool]
        for some, ids in zip(calls, self._direct([f" {MARK} ".join(c) for c in calls]), strict=True):
            marks = ids == self.mark
            at = np.flatnonzero(marks)
            if len(at) != len(some) - 1:
                apart += some
                continue
            order += some
            sizes.append(np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1)
            pools.append(ids[~marks])
        for ids in self._direct(apart):
            sizes.append(np.array([len(ids)]))
            pools.append(ids)
        order += apart
        self.words.update(zip(order, range(len(self.words), len(self.words) + len(order)), strict=True))
        self.pool, self.size = np.concatenate(pools), np.concatenate(sizes)
        self.start = np.cumsum(self.size) - self.size
        self.held += sum(map(len, order)) * 2 + 150 * len(order) + 4 * sum(map(len, pools[1:]))

    def _block(self, texts: pa.Array) -> Iterator[np.ndarray]:
        apart = pc.replace_substring_regex(pc.utf8_lower(texts), STOP, r"\1 \2\3")
        units = pc.ascii_split_whitespace(pc.if_else(pc.match_substring_regex(texts, KEEPS_CASE), texts, apart))
        coded = units.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if self.held > CACHE_BYTES:
            self.clear()
        if new := [w for w in words if w not in self.words]:
            self._add(new)
        at = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        unit = at[coded.indices.to_numpy(zero_copy_only=False)]
        size, start = self.size[unit], self.start[unit]
        end = np.cumsum(size)
        ids = self.pool[np.repeat(start - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)]
        edge = np.concatenate([[0], end])[units.offsets.to_numpy() - units.offsets[0].as_py()]
        for i, j in zip(edge, edge[1:]):
            yield ids[i:j]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """32-bit ids of each text; null is empty. Blocks bound what is held besides the texts."""
        texts = pc.fill_null(texts, "")
        if not self.by_words:
            for text in texts:
                yield self._direct([text.as_py()])[0]
            return
        block = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // BLOCK_CHARS
        edge = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(texts)]
        for i, j in zip(edge, edge[1:]):
            if j > i:
                yield from self._block(texts.slice(i, j - i))


_TOKENIZERS: dict[str, WordTokens] = {}


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenised documents, cut into pieces of ``capacity`` tokens: ``id_col, piece, start, length, ids_crc32``.

    Every document ends with ``end_id``. Also ``part`` and ``rank``: the task and the piece's rank there among those
    of its length. With ``with_ids`` the ids follow as little-endian 32-bit binary. Null text counts as empty.
    """
    fields = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("part", T.IntegerType()), ("rank", T.LongType())]
    schema = T.StructType([docs.schema[id_col], *(T.StructField(n, t) for n, t in fields), *([T.StructField("ids", T.BinaryType())] if with_ids else [])])
    end = np.array([end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _TOKENIZERS:
            _TOKENIZERS[tokenizer_path] = WordTokens(tokenizer_path)
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for b in batches:
            rows, take = [], []
            texts = b.column(1).cast(pa.string())
            for k, ids in enumerate(_TOKENIZERS[tokenizer_path].encode(texts)):
                ids = np.concatenate([ids, end]).astype("<u4", copy=False)
                for p, at in enumerate(range(0, len(ids), capacity)):
                    own = ids[at : at + capacity]
                    n = len(own)
                    take.append(k)
                    rows.append((p, at, n, zlib.crc32(own), part, seen[n], *([own.tobytes()] if with_ids else [])))
                    seen[n] += 1
            if rows:
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take)), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types))], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(freed(run), schema)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a written table of pieces with ``length, part, rank`` (see :func:`token_pieces`).

    The driver sees one number for each length (``capacity`` at most). Ranks over all tasks are the rank within
    the task plus what earlier tasks have of the length, from a table of counts, so a frequent length is no hot spot.
    """
    counts = pieces.groupBy("part", "length").agg((F.max("rank") + 1).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placed, _ = best_fit_decreasing(histogram, capacity)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    joined = pieces.join(before, ["part", "length"])
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = pieces.columns
    order = np.lexsort((placed[:, 1], placed[:, 0])) if len(placed) else np.zeros(0, np.int64)
    placed = placed[order]
    span = int(max(histogram.values(), default=0)) + 1
    keys = placed[:, 0] * span + placed[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy()
            rank = b.column(b.schema.get_field_index("rank")).to_numpy() + b.column(b.schema.get_field_index("before")).to_numpy()
            row = placed[np.searchsorted(keys, length * span + rank, side="right") - 1]
            i = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), pa.array(row[:, 3] + i // row[:, 4]), pa.array(row[:, 5] + (i % row[:, 4]) * length)], names=schema.names)

    return joined.mapInArrow(freed(place), schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenise and pack: ``id_col, piece int, start, length, ids_crc32, sequence_id, offset`` longs, and the ids if asked for.

    One row per piece; a document longer than ``capacity`` is cut, no other is. Null or empty text is a document of
    its end id alone; null ids pass through; repeated rows are packed as often as they stand; an empty table gives
    an empty result. Only the two named columns are read.
    """
    pieces = materialise(token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, with_ids), "pieces")
    return pack(pieces, capacity).drop("part", "rank")
