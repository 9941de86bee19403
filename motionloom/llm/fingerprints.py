"""Canonical exact fingerprints, of texts and of edited texts.

The canonical form is the NFKC-normalised, case-folded text with runs of white space as single spaces; the
fingerprint is its 128-bit xxhash. Documents with the same hash are compared byte by byte after copies within a
task have been combined; should two canonical forms share a hash, their fingerprints get a number behind it. The
likeness of two fingerprints is 1 where they are equal and 0 elsewhere: an exact digest knows no degrees.

The neighbour in order of id comes without a global sort in one task: ids are dealt to ranges whose borders
are ids that occur, and the document at a border also goes to the range before, as its last row's neighbour.
Texts travel in compressed blocks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motionloom.llm.common import input_bytes, materialise
from motionloom.llm.grace import ContentTable, groups

#: Bytes of the input for each range of ids; a task holds one range at a time. Ranges at most: the driver holds one id for
#: each, and more would be finer than RANK_ERROR; beyond, ranges grow.
RANGE_BYTES, MAX_RANGES = 16 << 20, 16_384
#: Bytes of text in a compressed block, about.
BLOCK_BYTES = 256 << 10
RANK_ERROR = 20_000


def canonical(text: str) -> str:
    """NFKC, case folding, NFKC again (folding can undo it), white space to single spaces, none at the ends."""
    if text.isascii():
        return " ".join(text.lower().split())
    t = unicodedata.normalize("NFKC", text).casefold()
    return " ".join((t if unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t)).split())


def digest(content: bytes) -> bytes:
    return xxhash.xxh3_128_digest(content)


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many (or all) of the text that follows."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _frame(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _parts(frame: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(frame):
        n = int.from_bytes(frame[at : at + 4], "little")
        yield frame[at + 4 : at + 4 + n]
        at += 4 + n


def _neighbours(docs: DataFrame, ranges: int) -> DataFrame:
    """Blocks of texts by range of ids: ``range int, ids array<long>, last array<boolean>, block binary``.

    ``last`` marks the copies that a range gets of the first document behind it. ``docs`` has ``id, text``.
    """
    marks = [k / ranges for k in range(1, ranges)]
    got = docs.agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"), F.count("id").alias("known"), F.percentile_approx("id", marks or [0.5], RANK_ERROR).alias("marks")).first()
    some_null = got["n"] > got["known"]
    borders = np.array(sorted({got["low"], *((got["marks"] or []) if marks else [])} - {None}), np.int64)
    top = max(len(borders) - 1, 0)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, list]] = {}
        size: dict[int, int] = {}

        def block(r):
            ids, last, texts = held.pop(r)
            size.pop(r)
            return pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([last], pa.list_(pa.bool_())), pa.array([zstandard.compress(_frame(texts), 3)], pa.binary())], names=["range", "ids", "last", "block"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                t = t or b""
                r = 0 if i is None else max(int(np.searchsorted(borders, i, side="right")) - 1, 0)
                to = [(r, False)]
                if i is None or (not some_null and len(borders) and i == borders[0]):
                    to.append((top, True))
                if i is not None and r > 0 and i == borders[r]:
                    to.append((r - 1, True))
                for k, flag in to:
                    ids, last, texts = held.setdefault(k, ([], [], []))
                    ids.append(i)
                    last.append(flag)
                    texts.append(t)
                    size[k] = size.get(k, 0) + len(t)
                    if size[k] > BLOCK_BYTES:
                        yield block(k)
        for r in list(held):
            yield block(r)

    return docs.select("id", "text").mapInArrow(deal, "range int, ids array<long>, last array<boolean>, block binary").repartition("range").sortWithinPartitions("range")


def _in_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
    """(id, text, next text) of all rows of a task's ranges, which come one after the other; ties of ids are in order of their texts."""
    here, blocks, rows = None, [], []
    for b in batches:
        for r, ids, last, block in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if r != here:
                yield from _in_order(blocks, rows)
                here, blocks, rows = r, [], []
            for k, (i, flag, t) in enumerate(zip(ids, last, _parts(zstandard.decompress(block)), strict=True)):
                rows.append((flag, i is not None, i or 0, xxhash.xxh3_128_digest(t), len(blocks), k))
            blocks.append(block)
    yield from _in_order(blocks, rows)


def _in_order(blocks: list[bytes], rows: list[tuple]) -> Iterator[tuple[int | None, str, str]]:
    """Rows of one range. Blocks stay compressed; what is sorted is (id, hash of the text) with a block's number and place."""
    open_blocks: dict[int, list[bytes]] = {}

    def text(row) -> str:
        n = row[4]
        if n not in open_blocks:
            if len(open_blocks) > 64:
                open_blocks.clear()
            open_blocks[n] = list(_parts(zstandard.decompress(blocks[n])))
        return open_blocks[n][row[5]].decode("utf-8")

    before = None
    for row in sorted(rows):
        t = text(row)
        if before is not None:
            yield before[2] if before[1] else None, before_text, t
        if row[0]:
            break
        before, before_text = row, t


def shared_hashes(docs: DataFrame, hashed: Callable[[bytes], bytes] = digest, memory: int = 64 << 20) -> DataFrame:
    """Hashes that belong to several canonical forms: ``hash, sha256, number`` (from 0, in order of the SHA-256). ``docs`` has ``text``."""
    buckets = 256

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            parts: dict[int, list[bytes]] = {}
            for c in table.contents:
                parts.setdefault(hashed(c)[0] % buckets, []).append(c)
            keys = list(parts)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([zstandard.compress(_frame(parts[k]), 3) for k in keys], pa.binary())], names=["bucket", "block"])

        table = ContentTable()
        for b in batches:
            for t in b.column(0).to_pylist():
                c = canonical(t or "").encode()
                table.entry(xxhash.xxh3_128_digest(c), c)
            if table.bytes > memory:
                yield flush()
                table = ContentTable()
        yield flush()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contents = (c for b in batches for block in b.column(1).to_pylist() for c in _parts(zstandard.decompress(block)))
        seen: dict[bytes, list[bytes]] = {}
        for _, content, _ in groups(((hashed(c).ljust(16, b"\0"), c, ()) for c in contents), memory):
            seen.setdefault(hashed(content), []).append(sha256(content).digest())
        many = [(h.hex(), s.hex(), k) for h, x in seen.items() if len(x) > 1 for k, s in enumerate(sorted(x))]
        cols = list(zip(*many, strict=True)) if many else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32())], names=["hash", "sha256", "number"])

    return docs.select("text").mapInArrow(own, "bucket int, block binary").repartition("bucket").mapInArrow(compare, "hash string, sha256 string, number int")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: Callable[[bytes], bytes] = digest, ranges: int | None = None) -> DataFrame:
    """Fingerprints of each row's text and of its edited text (see :func:`edited`; after the last row comes the first).

    Columns: ``id_col, n_chars long`` (code points), ``edited_sha256, fingerprint, edited_fingerprint string,
    near_edited, near_next double``. Null text counts as empty. Rows are in order of id, nulls first, rows with the
    same id in order of a hash of their texts; repeated rows are rows of their own. Ids are whole numbers; texts of any
    length are read whole. A single row follows itself. Other
    columns aren't read. An empty table gives no rows.
    """
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = ranges or min(MAX_RANGES, max(4 * tasks, input_bytes(docs, text_col) // RANGE_BYTES))
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "own", "edited_fingerprint", "edited_own", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, own string, edited_fingerprint string, edited_own string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        last: tuple[str, bytes] | None = None  # a row's neighbour is the next row: its canonical form is needed twice
        for i, text, following in _in_ranges(batches):
            a = last[1] if last and last[0] is text else canonical(text).encode()
            c = canonical(following).encode()
            last = (following, c)
            e = edited(text, following)
            b = canonical(e).encode()
            rows.append((i, len(text), sha256(e.encode()).hexdigest(), hashed(a).hex(), sha256(a).hexdigest(), hashed(b).hex(), sha256(b).hexdigest(), float(a == b), float(a == c)))
            if len(rows) >= 5_000:
                yield batch()
                rows = []
        if rows:
            yield batch()

    found = _neighbours(base, n).mapInArrow(run, schema)
    shared = materialise(shared_hashes(base, hashed), "shared")
    if not shared.isEmpty():
        for h, s in (("fingerprint", "own"), ("edited_fingerprint", "edited_own")):
            named = shared.select(F.col("hash").alias(h), F.col("sha256").alias(s), "number")
            found = found.join(named, [h, s], "left").withColumn(h, F.when(F.col("number") > 0, F.concat(h, F.lit("-"), F.col("number"))).otherwise(F.col(h))).drop("number")
    return found.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
