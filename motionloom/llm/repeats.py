"""Removal of repeated passages: every byte covered by a string of LENGTH bytes that also starts earlier.

Winnowing finds where copies can meet: of every string of LENGTH bytes the least hash of its K-byte grams marks an
anchor, and equal strings mark the same anchor. Anchors with equal grams form groups, each task sending one row for
each distinct context (the bytes that strings over the anchor can reach). A context seen before is a repeat as a
whole. Contexts that differ inside a group meet in a suffix array, by the linear grouping construction over
Lyndon-prefix groups: neighbours in it that share enough symbols have found each other (:func:`sharing`). A symbol is
WIDTH bytes, cut in step with the anchor, where equal strings lie alike in all contexts of a group; the strings of what
was found are then grouped by hash and compared byte for byte, and each one equal to an earlier one is removed. Whole
contexts are the same when their grams and their own bytes have equal hashes, of 64 bits each. Everything is judged
on the input. :func:`repeats_by_suffix_array` does the same on single bytes for texts that fit one task.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motionloom.llm.common import freed, input_bytes, materialise
from motionloom.llm.shingles import mix, powers, prefix_hash

LENGTH, K = 100, 40
#: Bytes in a symbol of the suffix array of contexts.
WIDTH = 8
CODE = np.random.default_rng(977).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
CHUNK_BYTES, BLOCK_BYTES = 48 << 20, 1 << 20
#: Bytes of the input for each bucket; a task holds one bucket at a time.
BUCKET_BYTES = 8 << 20
#: Bytes of numbers, and of contexts, that a task gathers over its buckets before it deals them out again as blocks.
HELD_BYTES, SENT_BYTES = 16 << 20, 24 << 20
#: Kinds of blocks: texts, whole contexts that repeat (row, from, to), contexts to compare (row, anchor, from, to).
TEXT, SPAN, ASK = 0, 1, 2


def suffix_array(text) -> list[int]:
    """Suffix array of a sequence of non-negative integers, in linear time without renaming.

    First phase: suffixes start in groups by first symbol. Groups are taken in descending order. Each member points to
    the nearest position before it whose group is lower (positions of the same or higher groups are skipped by their
    own pointers). Positions that are pointed at move into new groups right behind their old one, those with more
    pointers from this group further back: their common prefix grows by the group's prefix as often. At the end equal
    groups have equal Lyndon prefixes, in order. Second phase: from the empty suffix on, each suffix that is placed
    places the one before it, and those that this one's pointers lead to, at the front of their groups.
    """
    n = len(text)
    if not n:
        return []
    order = sorted(range(n), key=text.__getitem__)
    start, members = [0] * n, {}
    for at, i in enumerate(order):
        s = at if not at or text[order[at - 1]] != text[i] else start[order[at - 1]]
        start[i] = s
        members.setdefault(s, set()).add(i)
    before = [-1] * n
    for g in range(n - 1, -1, -1):  # groups made on the way lie in front of the one that makes them
        if g not in members:
            continue
        own = members[g]
        count: dict[int, int] = {}
        for i in sorted(own):
            j = i - 1
            while j >= 0 and start[j] >= g:
                j = before[j]
            before[i] = j
            if j >= 0:
                count[j] = count.get(j, 0) + 1
        split: dict[int, dict[int, list[int]]] = {}
        for j, c in count.items():
            split.setdefault(start[j], {}).setdefault(c, []).append(j)
        for s, by in split.items():
            rest = members[s]
            for js in by.values():
                rest.difference_update(js)
            at = s + len(rest)
            if not rest:
                del members[s]
            for c in sorted(by):
                members[at] = set(by[c])
                for j in by[c]:
                    start[j] = at
                at += len(by[c])
    out, front = [-1] * n, list(range(n))
    placed = [False] * n

    def place(i):
        while i >= 0 and not placed[i]:
            placed[i] = True
            s = start[i]
            out[front[s]] = i
            front[s] += 1
            i = before[i]

    place(n - 1)
    for k in range(n):
        place(out[k] - 1)
    return out


def sharing(text: np.ndarray, begin: np.ndarray, size: np.ndarray, skew: np.ndarray, length: int) -> np.ndarray:
    """Which contexts (``size`` bytes of ``text`` from ``begin``) may share a string of ``length`` bytes with another one.

    ``skew`` is the distance from a context's anchor back to its start. Every such string holds as many whole symbols as
    ``run``, so its suffixes from the first of them are neighbours in the suffix array with that much in common.
    """
    width = WIDTH if length >= 12 * WIDTH else 1
    run = (length - width + 1) // width
    first = skew % width
    many = (size - first) // width
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at = np.repeat(begin + first, many) + width * place
    value = np.zeros(len(at), np.uint64)
    for k in range(width):
        value = value << np.uint64(8) | text[at + k].astype(np.uint64)
    _, symbol = np.unique(value, return_inverse=True)
    n = len(begin)
    who = np.repeat(np.arange(n), many)
    joined = np.insert(symbol + n, np.cumsum(many), np.arange(n))  # each context ends in a symbol of its own
    owner = np.insert(who, np.cumsum(many), np.arange(n))
    found = np.zeros(n, bool)
    if len(joined) <= run:
        return found
    order = np.array(suffix_array(joined.tolist()))
    h = mix(joined.astype(np.uint64))
    hashes = np.zeros(len(joined), np.uint64)
    for k in range(run):
        hashes[: len(h) - run + 1] += h[k : len(h) - run + 1 + k] * (CODE[k % 256] ^ np.uint64(2 * k))
    hashes[len(h) - run + 1 :] = mix(np.arange(run - 1, dtype=np.uint64), 3)  # too short for a string
    order = order[order <= len(h) - run]
    same = hashes[order[1:]] == hashes[order[:-1]]
    found[owner[order[1:][same]]] = True
    found[owner[order[:-1][same]]] = True
    return found


def repeats_by_suffix_array(texts: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Spans (from, to) to remove of each text in order, by neighbours in the suffix array that share ``length`` bytes."""
    joined, at = [], []
    for k, t in enumerate(texts):
        at.append(len(joined))
        joined += [x + len(texts) for x in t] + [k]  # a separator that no other position has
    sa, rank = suffix_array(joined), [0] * len(joined)
    for r, i in enumerate(sa):
        rank[i] = r
    common, h = [0] * len(joined), 0
    for i in range(len(joined)):
        if not rank[i]:
            h = 0
            continue
        j = sa[rank[i] - 1]
        while i + h < len(joined) and j + h < len(joined) and joined[i + h] == joined[j + h]:
            h += 1
        common[rank[i]] = h
        h = max(h - 1, 0)
    gone, r = [False] * len(joined), 0
    while r < len(sa):
        e = r + 1
        while e < len(sa) and common[e] >= length:
            e += 1
        first = min(sa[r:e])
        for i in sa[r:e]:
            if i != first:
                gone[i : i + length] = [True] * length
        r = e
    return [spans_of(np.array(gone[a : a + len(t)], bool)) for a, t in zip(at, texts, strict=True)]


def spans_of(gone: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = op(x[: len(x) - size], x[size:])
        size *= 2
    d = width - size
    return op(x[: len(x) - d], x[d:]) if d else x


def anchors(text: bytes, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(gram hash, context hash, position, context from, context to) of each anchor of a text of ``length`` bytes or more."""
    b = np.frombuffer(text, np.uint8)
    n, w = len(b), length - k + 1
    p, inverse = prefix_hash(b, CODE), powers(len(b) + 1)[1]
    g = mix((p[k:] - p[: n - k + 1]) * inverse[: n - k + 1])
    least = _slide(g, w, np.minimum)
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    at = np.flatnonzero(_slide(padded, w, np.maximum) == g)
    low, high = np.maximum(at - (length - k), 0), np.minimum(at + length, n)
    c = mix(mix((p[high] - p[low]) * inverse[low]) + ((at - low) << 20 | (high - low)).astype(np.uint64))
    return g[at], c, at, low, high


def _blob(*columns: np.ndarray) -> bytes:
    x = np.stack([np.asarray(c).astype(np.int64) if c.dtype != np.uint64 else c.view(np.int64) for c in columns])
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1)).tobytes(), 1)


def _unblob(blob: bytes, n: int) -> np.ndarray:
    x = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(n, 8, -1).transpose(0, 2, 1)
    return np.ascontiguousarray(x).reshape(n, -1).view(np.int64)


def same_bytes(text: np.ndarray, x: np.ndarray, y: np.ndarray, length: int) -> bool:
    """Whether the strings at ``x`` (ascending) equal those at ``y``; where both move on by one, only one byte is new."""
    if not len(x):
        return True
    on = np.concatenate([[False], (np.diff(x) == 1) & (np.diff(y) == 1)])
    if (text[x + length - 1] != text[y + length - 1]).any():
        return False
    x, y = x[~on], y[~on]
    return not any((text[x + k] != text[y + k]).any() for k in range(length - 1))


def _seen_before(text: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Which strings stand earlier in their group, by their bytes: for strings whose hashes lied."""
    plain, seen = text.tobytes(), set()
    out = np.zeros(len(at), bool)
    for k, (i, g) in enumerate(zip(at.tolist(), group.tolist(), strict=True)):
        key = (g, plain[i : i + length])
        out[k] = key in seen
        seen.add(key)
    return out


def _cut(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, int)
    for i, j in zip(edge[:-1], edge[1:], strict=True):
        yield int(bucket[i]), [c[i:j] for c in columns]


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], names=["kind", "bucket", "blob"])


BLOCKS = "kind int, bucket int, blob binary"


class Held:
    """Columns of numbers to deal out, gathered up to ``limit`` bytes, so that blocks are few and not one for each two buckets."""

    def __init__(self, limit: int = HELD_BYTES):
        self.limit, self.size, self.of = limit, 0, {}

    def add(self, kind: int, bucket: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(bucket):
            x = np.stack([np.asarray(c).astype(np.int64, copy=False) for c in (bucket, *columns)])
            self.of.setdefault(kind, []).append(x)
            self.size += x.nbytes
        if self.size > self.limit:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        for kind in list(self.of):
            bucket, *columns = np.concatenate(self.of.pop(kind), axis=1)
            yield _batch([(kind, b, _blob(*x)) for b, x in _cut(bucket, *columns)])
        self.size = 0


def bucketwise(run):
    """``run(parts)`` over a task's blocks; ``parts`` has each bucket in turn with its blocks (kind, blob), which come in order of bucket."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
        here, held = None, []
        for b in batches:
            for kind, bucket, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != here:
                    if held:
                        yield here, held
                    here, held = bucket, []
                held.append((kind, blob))
        if held:
            yield here, held

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(parts(batches))

    return freed(task)


def _dealt(blocks: DataFrame) -> DataFrame:
    return blocks.repartition("bucket").sortWithinPartitions("bucket")


def _row_bucket(rows: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(rows.astype(np.int64).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _find(rows: DataFrame, length: int, k: int, buckets: int) -> DataFrame:
    """SPAN and ASK blocks by bucket of the row. ``rows`` has ``row`` (its place in the order) and ``text``."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush():
            if not held:
                return _batch([])
            row = np.repeat(np.array([r for r, _ in held], np.int64), [len(x[0]) for _, x in held])
            g, c, at, low, high = (np.concatenate([x[j] for _, x in held]) for j in range(5))
            order = np.lexsort((at, row, c, g))
            g, c, at, low, high, row = (x[order] for x in (g, c, at, low, high, row))
            first = np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])])
            out = [(SPAN, -1 - b, _blob(*x)) for b, x in _cut(_row_bucket(row[~first], buckets), row[~first], low[~first], high[~first])]
            # one row stands for all of a context here; the others follow it, whatever comes from elsewhere
            x = (g[first], c[first], row[first], at[first], low[first], high[first])
            return _batch(out + [(ASK, b, _blob(*y)) for b, y in _cut((x[0] % np.uint64(buckets)).astype(np.int64), *x)])

        for b in batches:
            for r, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if t is not None and len(t) >= length:
                    held.append((r, anchors(t, length, k)))
                    size += 2 * len(t)
                if size > CHUNK_BYTES:
                    yield flush()
                    held, size = [], 0
        yield flush()

    def meet(parts) -> Iterator[pa.RecordBatch]:
        held = Held()
        for bucket, blocks in parts:
            if bucket < 0:
                for _, blob in blocks:
                    x = _unblob(blob, 3)
                    yield from held.add(SPAN, np.full(x.shape[1], -1 - bucket), *x)
                continue
            got = [_unblob(blob, 6) for _, blob in blocks]
            blocks.clear()
            g, c, row, at, low, high = np.concatenate(got, axis=1)
            got.clear()
            order = np.lexsort((at, row, c, g))
            g, c, row, at, low, high = (x[order] for x in (g, c, row, at, low, high))
            new_group = np.concatenate([[True], g[1:] != g[:-1]])
            first = new_group | np.concatenate([[True], c[1:] != c[:-1]])
            yield from held.add(SPAN, _row_bucket(row[~first], buckets), row[~first], low[~first], high[~first])
            group = np.cumsum(new_group) - 1
            ask = first & (np.bincount(group[first], minlength=group[-1] + 1) > 1)[group]
            yield from held.add(ASK, _row_bucket(row[ask], buckets), row[ask], g[ask], at[ask], low[ask], high[ask])
        yield from held.rest()

    return materialise(_dealt(rows.mapInArrow(freed(mark), BLOCKS)).mapInArrow(bucketwise(meet), BLOCKS), "anchors")


def _texts(rows: DataFrame, buckets: int) -> DataFrame:
    """TEXT blocks by bucket of the row: row numbers, lengths and texts."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size: dict[int, int] = {}

        def block(b):
            own = held.pop(b)
            size.pop(b)
            head = np.array([len(own), *(r for r, _ in own), *(len(t) for _, t in own)], np.int64).tobytes()
            return TEXT, b, zstandard.compress(head + b"".join(t for _, t in own), 3)

        for x in batches:
            for r, t in zip(x.column(0).to_pylist(), x.column(1).cast(pa.binary()).to_pylist(), strict=True):
                b = int(_row_bucket(np.array([r]), buckets)[0])
                held.setdefault(b, []).append((r, t or b""))
                size[b] = size.get(b, 0) + len(t or b"") + 16
                if size[b] > BLOCK_BYTES:
                    yield _batch([block(b)])
        yield _batch([block(b) for b in list(held)])

    return rows.mapInArrow(freed(pack), BLOCKS)


def _unpack_texts(blob: bytes) -> Iterator[tuple[int, bytes]]:
    x = zstandard.decompress(blob)
    n = int.from_bytes(x[:8], "little")
    head = np.frombuffer(x, np.int64, 2 * n, 8)
    at = 8 + 16 * n
    for r, size in zip(head[:n].tolist(), head[n:].tolist(), strict=True):
        yield r, x[at : at + size]
        at += size


def _gathered(blocks: list[tuple[int, bytes]], kind: int, columns: int) -> tuple[list[bytes], np.ndarray]:
    """Text blocks and the columns of the blocks of ``kind`` in order of row."""
    x = np.concatenate([np.zeros((columns, 0), np.int64), *(_unblob(blob, columns) for k, blob in blocks if k == kind)], axis=1)
    return [blob for k, blob in blocks if k == TEXT], x[:, np.argsort(x[0], kind="stable")]


def _compared(found: DataFrame, texts: DataFrame, length: int, buckets: int) -> DataFrame:
    """SPAN blocks from contexts that differ inside their group: their bytes meet by anchor, string by string."""

    def send(parts) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[array, bytearray]] = {}
        size = 0

        def block(b):
            head, body = held.pop(b)
            return ASK, b, zstandard.compress((len(head) // 5).to_bytes(8, "little") + head.tobytes() + body, 3)

        for _, blocks in parts:
            blobs, x = _gathered(blocks, ASK, 5)
            for blob in blobs:
                for r, t in _unpack_texts(blob):
                    i, j = np.searchsorted(x[0], [r, r + 1])
                    for g, at, low, high in x[1:, i:j].T.tolist():
                        b = g % buckets
                        if b not in held:
                            held[b] = array("q"), bytearray()
                        head, body = held[b]
                        head.extend((g, r, at, low, high))
                        body += t[low:high]
                        size += high - low + 40
                        if len(body) > BLOCK_BYTES:
                            size -= len(body) + 8 * len(head)
                            yield _batch([block(b)])
                if size > SENT_BYTES:
                    yield _batch([block(b) for b in list(held)])
                    size = 0
        yield _batch([block(b) for b in list(held)])

    def compare(parts) -> Iterator[pa.RecordBatch]:
        held = Held()
        for _, blocks in parts:
            for spans in again(blocks):
                yield from held.add(SPAN, *spans)
        yield from held.rest()

    def again(blocks: list[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, ...]]:
        """(bucket, row, from, to) of the runs of strings that repeat in a bucket."""
        heads, bodies = [], []
        for _, blob in blocks:
            x = zstandard.decompress(blob)
            n = int.from_bytes(x[:8], "little")
            heads.append(np.frombuffer(x, np.int64, 5 * n, 8).reshape(n, 5))
            bodies.append(x[8 + 40 * n :])
        blocks.clear()
        g, row, at, low, high = np.concatenate(heads).T
        size = high - low
        begin = np.cumsum(size) - size
        text = np.frombuffer(b"".join(bodies), np.uint8)
        bodies.clear()
        order = np.lexsort((at, row, g))
        edge = np.flatnonzero(np.concatenate([[True], np.diff(g[order]) != 0, [True]]))
        # groups are taken together up to about BLOCK_BYTES of contexts, so that the strings' hashes stay few
        total, take = np.cumsum(size[order]), 0
        while take < len(edge) - 1:
            i = edge[take]
            done = total[i - 1] if i else 0
            stop = max(take + 1, int(np.searchsorted(total[edge[1:] - 1], done + BLOCK_BYTES, side="right")))
            own = order[i : edge[stop]]
            take = stop
            yield from strings(text, g, row, at, low, size, begin, own)

    def strings(text, g, row, at, low, size, begin, own):
        own = own[sharing(text, begin[own], size[own], (at - low)[own], length)]
        if not len(own):
            return
        many = size[own] - length + 1
        who = np.repeat(own, many)
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        inside = np.arange(size[own].sum()) - np.repeat(np.cumsum(size[own]) - size[own], size[own])
        part = text[np.repeat(begin[own], size[own]) + inside]
        p, inverse = prefix_hash(part, CODE), powers(len(part) + 1)[1]
        s = np.repeat(np.cumsum(size[own]) - size[own], many) + step
        offset = low[who] + step - at[who]
        h = mix(mix((p[s + length] - p[s]) * inverse[s]) + mix(g[who].view(np.uint64)) + offset.astype(np.int64).view(np.uint64))
        order = np.argsort(h, kind="stable")  # contexts are in order of row and position already
        twice = np.zeros(len(h), bool)
        twice[order[1:]] = h[order[1:]] == h[order[:-1]]
        before = np.full(len(h), -1)
        before[order[1:]] = s[order[:-1]]
        if not same_bytes(part, s[twice], before[twice], length):
            twice = _seen_before(part, s, g[who], length)
        # runs of strings of one context that repeat are one span
        first = twice & ~np.concatenate([[False], twice[:-1] & (step[1:] > 0)])
        last = twice & ~np.concatenate([twice[1:] & (step[1:] > 0), [False]])
        r, a, b = row[who[first]], (low[who] + step)[first], (low[who] + step)[last] + length
        yield _row_bucket(r, buckets), r, a, b

    asked = found.where(f"kind = {ASK}").union(texts)
    return materialise(_dealt(_dealt(asked).mapInArrow(bucketwise(send), BLOCKS)).mapInArrow(bucketwise(compare), BLOCKS), "compared")


def _ordered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """``row`` (place in the order), ``text`` and the struct ``doc`` of all columns of rows with an id; ids repeat less than the number.

    An id that repeats is numbered through in order of text.
    """
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("row"), F.col(text_col).alias("text"), F.struct(*[F.col(c) for c in docs.columns]).alias("doc"))
    many = materialise(base.groupBy("row").agg(F.count("*").alias("n")).where("n > 1"), "again")
    most = many.agg(F.max("n")).first()[0] or 1
    if most == 1:
        return base, 1
    again = base.join(many.select("row"), "row", "left_semi").withColumn("copy", F.row_number().over(Window.partitionBy("row").orderBy("text")) - 1)
    every = base.join(many, "row", "left_anti").withColumn("copy", F.lit(0)).unionByName(again)
    return every.select((F.col("row") * most + F.col("copy")).alias("row"), "text", "doc"), most


def _buckets(docs: DataFrame, text_col: str) -> int:
    """By the input alone: each two buckets may have a block in common, so they must not be more than it needs."""
    return max(64, input_bytes(docs, text_col) // BUCKET_BYTES)


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = K, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Removed spans of every row: ``id_col, n_bytes, n_removed, n_spans long, kept_sha256 string, spans array<struct<from,to>>``.

    A byte goes if a string of ``length`` bytes over it also starts earlier: in a row with a smaller id, or earlier in
    the same row; matches lie within one row, overlaps count. Null text counts as empty; rows with a null id are
    returned untouched, first; rows that repeat an id take part in order of text, nulls first, each judged against
    the others. Ids are whole numbers. Texts of any length are read whole. An empty table gives no rows. Other
    columns aren't read.
    """
    rows, most = _ordered(docs.select(id_col, text_col), id_col, text_col)
    done = _removed(rows.select("row", "text"), length, k, buckets or _buckets(docs, text_col), False)
    none = docs.where(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias("row"), F.col(text_col).alias("text")).mapInArrow(_untouched, done.schema)
    named = F.floor(F.col("row") / most).cast("long") if most > 1 else F.col("row")
    return done.union(none).select(named.alias(id_col), *done.columns[1:])


def drop_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """``docs`` with the spans of :func:`repeated_spans` gone from ``text_col``; every row stays, with all its columns.

    Bytes of a character that lost a part go too. Rows with a null id or text stay as they are, also where the id repeats.
    """
    rows, _ = _ordered(docs, id_col, text_col)
    left = _removed(rows.select("row", "text"), length, k, buckets or _buckets(docs, text_col), True).select(F.col("row").alias("of"), "kept")
    rest = rows.select("row", F.struct(*[(F.col("text").isNotNull().cast("string") if c == text_col else F.col("doc").getField(c)).alias(c) for c in docs.columns]).alias("doc"))
    joined = rest.join(left, F.col("row") == F.col("of"))
    text = F.when(F.col("doc").getField(text_col) == "true", F.col("kept"))
    new = joined.select(*[text.alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in docs.columns])
    return new.union(docs.where(F.col(id_col).isNull()))


SPANS = T.ArrayType(T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())]))
FIELDS = [("row", T.LongType()), ("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType()), ("spans", SPANS)]
ARROW = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])), pa.string()]


def _result(row: int | None, t: bytes, gone: np.ndarray | None, with_text: bool) -> tuple:
    spans = spans_of(gone) if gone is not None else []
    kept = t if not spans else np.frombuffer(t, np.uint8)[~gone].tobytes()
    own = (row, len(t), len(t) - len(kept), len(spans), sha256(kept).hexdigest(), [{"from": a, "to": b} for a, b in spans])
    return (*own, kept.decode("utf-8", "ignore")) if with_text else own


def _results(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW)], names=[*(n for n, _ in FIELDS), *["kept"] * (len(rows[0]) - len(FIELDS))])


def _untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            yield _results([_result(None, t or b"", None, False) for t in b.column(1).cast(pa.binary()).to_pylist()])


def _removed(plain: DataFrame, length: int, k: int, buckets: int, with_text: bool) -> DataFrame:
    """FIELDS of every row of ``row, text`` (``row`` once each), and the remaining text as ``kept`` if asked for."""
    found = _find(plain, length, k, buckets)
    texts = _texts(plain, buckets)
    compared = _compared(found, texts, length, buckets)
    schema = T.StructType([T.StructField(n, t) for n, t in [*FIELDS, *([("kept", T.StringType())] if with_text else [])]])

    def apply(parts) -> Iterator[pa.RecordBatch]:
        for _, blocks in parts:
            blobs, x = _gathered(blocks, SPAN, 3)
            rows, size = [], 0
            for blob in blobs:
                for r, t in _unpack_texts(blob):
                    i, j = np.searchsorted(x[0], [r, r + 1])
                    gone = None
                    if j > i:
                        edge = np.zeros(len(t) + 1, np.int32)
                        np.add.at(edge, x[1, i:j], 1)
                        np.add.at(edge, x[2, i:j], -1)
                        gone = np.cumsum(edge[:-1]) > 0
                    rows.append(_result(r, t, gone, with_text))
                    size += len(t)
                    if len(rows) >= 5_000 or size > 16 << 20:
                        yield _results(rows)
                        rows, size = [], 0
            if rows:
                yield _results(rows)

    every = found.where(f"kind = {SPAN}").union(compared).union(texts)
    return _dealt(every).mapInArrow(bucketwise(apply), schema)
