"""Exact n-gram Jaccard join by PartEnum signatures, reduced to components.

Sizes fall into bands so narrow that similar sets lie in the same band or in neighbours, and inside a band
similarity bounds the number of elements in which two sets differ, k. The feature domain is partitioned at random
into first-level parts, each again into PARTS second-level parts. With k // (MISS + 1) + 1 first-level parts,
one of them has at most MISS differing second-level parts; so each subset of PARTS - MISS of them, for each
first-level part, is a signature, and similar sets share one. SLACK more first-level parts let sets pass over
signatures of nothing: a similar pair then agrees in SLACK + 1 first-level parts, and a set in which no more than
SLACK are hollow can leave out its empty subsets (sets with more emit them too).

No group of equal signatures is expanded into pairs, and no text moves for a candidate. Every set has a mark, the
parities of its elements' counts in buckets: marks differ in no more bits than sets do in elements, so few bits
of difference are a necessary condition of similarity, and one that hardly any other pair meets. A task walks
through its groups breadth first over the pairs whose marks allow a link and returns a spanning forest, at most one
pair less than documents. These pairs make families. Each family's texts meet once, and the same walk over their
sets, with every intersection counted in full, gives a spanning forest of the links. Groups and families beyond
a task's bound are cut into blocks, and each two blocks are a walk of their own.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motionloom.llm.common import connected_components, freed, input_bytes, materialise
from motionloom.llm.shingles import mix, shingle_set

PARTS, MISS, SLACK = 3, 1, 1
CHUNK_DOCS, CHUNK_ENTRIES = 16_384, 3_000_000
#: Bytes of the input for each bucket of signatures; a task holds one bucket at a time.
BUCKET_BYTES = 16 << 20
#: Members of groups that a task holds to drop groups with the same members.
MEET_ENTRIES = 8_000_000
#: Documents, and elements of their sets, that a walk holds; edges that a task gathers before it returns their forest.
WALK_DOCS, WALK_ELEMENTS, WALK_EDGES = 4096, 4_000_000, 1_000_000
#: Least bits of a mark.
MARK_BITS = 512
WORK = "kind int, g long, s long, t long, id long, n long, mark binary"
SIGNATURE, STAR, INFO = 0, 1, 2


@lru_cache(maxsize=65_536)
def band(n: int, percent: int) -> tuple[int, int]:
    """(number, largest size) of the band that size n falls into: each ends where 100 / percent of its least size does."""
    low, i = 1, 0
    while True:
        high = low * 100 // percent
        if n <= high:
            return i, high
        low, i = high + 1, i + 1


@lru_cache(maxsize=4096)
def band_limits(i: int, percent: int) -> int:
    low = 1
    for _ in range(i):
        low = low * 100 // percent + 1
    return low * 100 // percent


def signatures(s: np.ndarray, percent: int, salt: int = 0) -> np.ndarray:
    """PartEnum signatures of a set of hashes, for its own size band and the next."""
    own, _ = band(len(s), percent)
    element, place = mix(s, 2 * salt + 1), mix(s, 2 * salt + 2)
    out = []
    for i in (own, own + 1):
        k = 2 * (100 - percent) * band_limits(i, percent) // (100 + percent)
        first = k // (MISS + 1) + 1 + SLACK
        part = ((place >> np.uint64(32)) * np.uint64(first * PARTS) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        sums = np.zeros(first * PARTS, np.uint64)
        there, at = np.unique(part[order], return_index=True)
        sums[there] = np.add.reduceat(element[order], at)
        sums, full = sums.reshape(first, PARTS), np.bincount(part, minlength=first * PARTS).reshape(first, PARTS) > 0
        subsets = list(itertools.combinations(range(PARTS), PARTS - MISS))
        sig = np.stack([sums[:, list(c)] @ np.array([3 + 2 * x for x in c], np.uint64) for c in subsets], axis=1)
        some = np.stack([full[:, list(c)].any(1) for c in subsets], axis=1)
        name = np.arange(first * len(subsets), dtype=np.uint64).reshape(first, -1) + np.uint64((i << 40) + (salt << 56))
        sig = mix(sig + mix(name))
        hollow = int((~some).any(1).sum())
        out.append(sig.ravel() if hollow > SLACK else sig[some])
    return np.concatenate(out)


def _pack(sigs: np.ndarray, ids: np.ndarray) -> bytes:
    """Sorted signatures as differences, with ids, byte planes apart so that they compress."""
    d = np.diff(sigs, prepend=np.uint64(0))
    both = np.stack([d, ids.view(np.uint64)])
    return zstandard.compress(np.ascontiguousarray(both.view(np.uint8).reshape(2, -1, 8).transpose(0, 2, 1)).tobytes(), 1)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(2, 8, -1).transpose(0, 2, 1)
    both = np.ascontiguousarray(x).reshape(2, -1).view(np.uint64)
    return np.cumsum(both[0], dtype=np.uint64), both[1].view(np.int64)


def _stars(sigs: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries in order of signature: distinct signatures, their leaders (least id), and rows (signature, leader, other)."""
    start = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1]]))
    leader = np.minimum.reduceat(ids, start)
    size = np.diff(np.append(start, len(sigs)))
    lead = np.repeat(leader, size)
    other = np.flatnonzero((np.repeat(size, size) > 1) & (ids != lead))
    return sigs[start], leader, np.stack([sigs[other].view(np.int64), lead[other], ids[other]])


def _group_rows(sigs: np.ndarray, ids: np.ndarray, partial: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows (group, member) of entries in order of signature, one group for all signatures that have the same members.

    Signatures in ``partial`` (sorted) have members that aren't among the entries, so they stay groups of their own;
    None: any may have. Signatures of one member are no group. Groups are named by 64 bits; two that chance to have
    the same name are compared as one.
    """
    start = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1]]))
    size = np.diff(np.append(start, len(sigs)))
    many = np.repeat(size > 1, size)
    sigs, ids = sigs[many], ids[many]
    if not len(sigs):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((ids, sigs))
    sigs, ids = sigs[order], ids[order]
    once = np.concatenate([[True], (sigs[1:] != sigs[:-1]) | (ids[1:] != ids[:-1])])
    sigs, ids = sigs[once], ids[once]
    start = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1]]))
    size = np.diff(np.append(start, len(sigs)))
    key = ids.view(np.uint64)
    name = mix(np.add.reduceat(mix(key, 5), start) ^ mix(size.astype(np.uint64), 6))
    own = np.ones(len(start), bool) if partial is None else np.isin(sigs[start], partial)
    keep = own.copy()
    keep[np.unique(name, return_index=True)[1]] = True
    name = np.where(own, _own_group(sigs[start]), name)
    keep &= own | (size > 1)
    keep = np.repeat(keep, size)
    return np.repeat(name, size)[keep].view(np.int64), ids[keep]


def _own_group(sigs: np.ndarray) -> np.ndarray:
    return mix(sigs, 7)


def mark(s: np.ndarray, least: int = MARK_BITS) -> np.ndarray:
    """Parities of a set's counts in buckets, two for each element and ``least`` at least, as 64-bit words."""
    bits = max(least, 1 << (2 * len(s) - 1).bit_length()) if len(s) else least
    odd = np.bincount((mix(s, 8) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(m: np.ndarray, words: int) -> np.ndarray:
    """A mark as it would be with fewer buckets."""
    return m if len(m) == words else np.bitwise_xor.reduce(m.reshape(-1, words), axis=0)


def walk(sizes: np.ndarray, marks: list[np.ndarray], percent: int, sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Spanning forest (index pairs) of the graph of pairs whose marks allow 100 * intersection >= percent * union.

    With ``sets`` the pairs that meet it. Each document is compared with those not yet reached, once.
    """
    words = min(len(m) for m in marks)
    marks = np.stack([folded(m, words) for m in marks])
    left, front, out = np.arange(1, len(sizes)), [0], []
    while len(left):
        if not front:
            front, left = [int(left[0])], left[1:]
            continue
        v = front.pop()
        a, b = sizes[v], sizes[left]
        ok = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
        ok[ok] = np.bitwise_count(marks[left[ok]] ^ marks[v]).sum(axis=1, dtype=np.int64) * (100 + percent) <= (a + b[ok]) * (100 - percent)
        if sets is not None and ok.any():
            ok[ok] = _similar(sets[v], [sets[u] for u in left[ok]], percent)
        near = left[ok].tolist()
        out += [(v, u) for u in near]
        front += near
        left = left[~ok]
    return out


def _similar(s: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets ``others`` are similar to ``s``; none of them is empty."""
    out, k = [], 0
    while k < len(others):
        some, held = [], 0
        while k < len(others) and (not some or held < WALK_ELEMENTS // 8):
            some.append(others[k])
            held += len(others[k])
            k += 1
        size = np.array([len(t) for t in some])
        every = np.concatenate(some)
        at = np.minimum(np.searchsorted(s, every), len(s) - 1)
        both = np.add.reduceat((s[at] == every).astype(np.int64), np.cumsum(size) - size)
        out.append(100 * both >= percent * (len(s) + size - both))
    return np.concatenate(out)


def _forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pairs (least id, other) with the same components."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while (up := root.setdefault(i, i)) != i:
            root[i] = i = root[up]
        return i

    for i, j in pairs:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [(a, i) for i in list(root) if (a := find(i)) != i]


def _work_batch(kind: int, rows: int, **columns) -> pa.RecordBatch:
    types = {"g": pa.int64(), "s": pa.int64(), "t": pa.int64(), "id": pa.int64(), "n": pa.int64(), "mark": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(np.full(rows, kind, np.int32)), *(pa.array(columns[c], t) if c in columns else pa.nulls(rows, t) for c, t in types.items())], names=["kind", *types])


def candidates(docs: DataFrame, percent: int, words: int, buckets: int) -> DataFrame:
    """Written table of INFO rows (id, n: set size, s and t: digest of the set, mark) and STAR rows (g: group, id: member)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(64 - buckets.bit_length() + 1)
        seen, sigs, ids, info, marks, entries = set(), [], [], [], [], 0

        def flush():
            kinds, at, blobs = [], [], []

            def out(kind, bucket, blob):
                kinds.append(kind)
                at.append(bucket)
                blobs.append(blob)

            size = np.array([len(m) for m in marks], np.int64)
            plain = b"".join([np.int64(len(info)).tobytes(), np.array(info, np.int64).tobytes(), size.tobytes(), *(m.tobytes() for m in marks)])
            out(INFO, int(mix(np.array([info[0][0]]).view(np.uint64))[0] >> shift), zstandard.compress(plain, 1))
            if sigs:
                s, i = np.concatenate(sigs), np.repeat(np.array(ids, np.int64), [len(x) for x in sigs])
                order = np.argsort(s, kind="stable")
                s, leader, star = _stars(s[order], i[order])
                edge = np.searchsorted(s >> shift, np.arange(buckets + 1, dtype=np.uint64))
                for k in np.flatnonzero(np.diff(edge)):
                    out(SIGNATURE, int(k), _pack(s[edge[k] : edge[k + 1]], leader[edge[k] : edge[k + 1]]))
                edge = np.searchsorted(star[0].view(np.uint64) >> shift, np.arange(buckets + 1, dtype=np.uint64))
                for k in np.flatnonzero(np.diff(edge)):
                    out(STAR, int(k), zstandard.compress(np.ascontiguousarray(star[:, edge[k] : edge[k + 1]]).tobytes(), 1))
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(at, pa.int32()), pa.array(blobs, pa.binary())], names=["kind", "bucket", "blob"])

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                s = shingle_set(text, words)
                digest = [int(x) for x in np.array([mix(s, 101).sum(), mix(s, 102).sum()], np.uint64).view(np.int64)]
                info.append([i, len(s), *digest])
                marks.append(mark(s) if len(s) else s)
                if len(s) and (key := (len(s), *digest)) not in seen:
                    seen.add(key)
                    sigs.append(signatures(s, percent))
                    ids.append(i)
                    entries += len(sigs[-1])
                if len(info) >= CHUNK_DOCS or entries >= CHUNK_ENTRIES:
                    yield flush()
                    seen, sigs, ids, info, marks, entries = set(), [], [], [], [], 0
        if info:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, _Bucket(MEET_ENTRIES)
        for b in batches:
            for kind, bucket, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != here:
                    yield from held.groups()
                    here, held = bucket, _Bucket(MEET_ENTRIES)
                if kind == INFO:
                    yield _info_batch(zstandard.decompress(blob))
                elif (passed := held.add(kind, blob)) is not None:
                    yield passed
        yield from held.groups()

    signed = docs.mapInArrow(freed(sign), "kind int, bucket int, blob binary").repartition("bucket").sortWithinPartitions("bucket")
    return materialise(signed.mapInArrow(freed(meet), WORK), "partenum")


def _info_batch(plain: bytes) -> pa.RecordBatch:
    n = int(np.frombuffer(plain, np.int64, 1)[0])
    x = np.frombuffer(plain, np.int64, 4 * n, 8).reshape(-1, 4)
    edge = np.concatenate([[0], np.cumsum(np.frombuffer(plain, np.int64, n, 8 + 32 * n))]) * 8 + 8 + 40 * n
    marks = [plain[i:j] for i, j in zip(edge, edge[1:])]
    return _work_batch(INFO, n, s=x[:, 2].copy(), t=x[:, 3].copy(), id=x[:, 0].copy(), n=x[:, 1].copy(), mark=marks)


class _Bucket:
    """Entries of one bucket of signatures. Beyond ``bound``, groups of a chunk pass as groups of their signature."""

    def __init__(self, bound: int):
        self.bound = bound
        self.sigs, self.ids, self.held, self.partial, self.passed, self.waiting = [], [], 0, np.zeros(0, np.uint64), [], 0

    def gathered(self) -> np.ndarray | None:
        if self.partial is None:
            return None
        got = np.unique(np.concatenate([self.partial, *self.passed]))
        return got if len(got) <= self.bound else None

    def add(self, kind: int, blob: bytes) -> pa.RecordBatch | None:
        if kind == SIGNATURE:
            s, i = _unpack(blob)
            self.sigs.append(s)
            self.ids.append(i)
            return None
        x = np.frombuffer(zstandard.decompress(blob), np.int64).reshape(3, -1)
        if self.held < self.bound:
            self.sigs.append(x[0].view(np.uint64))
            self.ids.append(x[2])
            self.held += x.shape[1]
            return None
        if self.partial is not None:
            self.passed.append(np.unique(x[0].view(np.uint64)))
            self.waiting += len(self.passed[-1])
            if self.waiting > self.bound:
                self.partial, self.passed, self.waiting = self.gathered(), [], 0
        rows = np.unique(np.concatenate([np.stack([x[0], x[1]], 1), np.stack([x[0], x[2]], 1)]), axis=0)
        return _work_batch(STAR, len(rows), g=_own_group(rows[:, 0].copy().view(np.uint64)).view(np.int64), id=rows[:, 1].copy())

    def groups(self) -> Iterator[pa.RecordBatch]:
        if not self.sigs:
            return
        s, i = np.concatenate(self.sigs), np.concatenate(self.ids)
        self.sigs, self.ids = [], []
        order = np.argsort(s, kind="stable")
        g, member = _group_rows(s[order], i[order], self.gathered())
        for k in range(0, len(g), 200_000):
            yield _work_batch(STAR, len(g[k : k + 200_000]), g=g[k : k + 200_000].copy(), id=member[k : k + 200_000].copy())


def _blocks(rows: DataFrame, key: str) -> DataFrame:
    """Rows ``key, id, n, ...`` of keys that have more than one, in blocks of a bounded number of documents and elements.

    A key within the bounds has blocks low = high = 0; else each two of its blocks are a group ``key, low, high``.
    """
    of = rows.groupBy(key).agg(F.count("*").alias("docs"), F.sum("n").alias("elements")).where("docs > 1")
    blocks = F.greatest(F.ceil(F.col("docs") / WALK_DOCS), F.ceil(F.col("elements") / WALK_ELEMENTS)).cast("int")
    dealt = rows.join(of.select(key, blocks.alias("blocks")), key).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    whole = dealt.where("blocks = 1").select(F.lit(0).alias("low"), F.lit(0).alias("high"), *rows.columns)
    cut = dealt.where("blocks > 1").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("with <> block")
    return whole.union(cut.select(F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), *rows.columns))


def _walks(groups: DataFrame, key: str, value: str, percent: int, words: int | None) -> DataFrame:
    """Pairs ``a, b``: spanning forests of the walks of groups ``key, low, high``; ``value`` is a mark, or with ``words`` a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, held, pairs = None, [], [], []

        def walked() -> list[tuple[int, int]]:
            if len(ids) < 2:
                return []
            if words is None:
                found = walk(np.array([n for n, _ in held]), [np.frombuffer(m, np.uint64) for _, m in held], percent)
            else:
                some = [(i, s) for i, (_, t) in zip(ids, held, strict=True) if len(s := shingle_set(t, words))]
                if len(some) < 2:
                    return []
                names, sets = zip(*some, strict=True)
                return [(names[i], names[j]) for i, j in walk(np.array([len(s) for s in sets]), [mark(s) for s in sets], percent, sets)]
            return [(ids[i], ids[j]) for i, j in found]

        def batch() -> pa.RecordBatch:
            rows = _forest(pairs)
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for b in batches:
            for g, low, high, i, n, v in zip(*(c.to_pylist() for c in [*b.columns[:5], b.column(5).cast(pa.binary())]), strict=True):
                if at != (g, low, high):
                    pairs += walked()
                    at, ids, held = (g, low, high), [], []
                    if len(pairs) > WALK_EDGES:
                        yield batch()
                        pairs = []
                ids.append(i)
                held.append((n, v))
        pairs += walked()
        if pairs:
            yield batch()

    keyed = groups.select(key, "low", "high", "id", "n", value).repartition(key, "low", "high").sortWithinPartitions(key, "low", "high", "id")
    return keyed.mapInArrow(freed(run), "a long, b long")


def similar_components(docs: DataFrame, percent: int = 85, words: int = 4, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_shingles long, component_id`` (least id reachable by links).

    Rows link when 100 * intersection >= ``percent`` * union of their sets of ``words``-word shingles (A-Z lower-cased,
    ASCII white space separates; fewer words are one shingle). Null and empty texts have no shingle and are linked
    with nothing; texts of any length are read whole. Rows with a null id have a null component and link nothing; rows
    that repeat an id are one node, whose links are those of all its texts. Ids are whole numbers, or text that casts
    to them (other text counts as null). Ties (equal sets) are links. Other columns aren't read. An empty table gives no rows.
    """
    if buckets is None:
        buckets = 1 << max(6, math.ceil(math.log2(max(1, input_bytes(docs, text_col) / BUCKET_BYTES))))
    base = docs.select(F.expr(f"try_cast(`{id_col}` AS long)").alias("id"), F.col(text_col).alias("text"))
    work = candidates(base.where("id is not null"), percent, words, buckets)
    info = work.where(f"kind = {INFO}").select("id", "n", "s", "t")
    # written before it is joined: the join's own exchange can then be split where one set has very many copies
    first = materialise(info.where("n > 0").groupBy("n", "s", "t").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("z > a").drop("z"), "first")
    copies = materialise(info.join(first, ["n", "s", "t"]).where("a <> id").select("a", F.col("id").alias("b")).distinct(), "copies")
    marks = work.where(f"kind = {INFO} and n > 0").select("id", "n", "mark")
    # One of equal sets stands for all, but an id with several sets stands for itself and is linked to their copies.
    sets = info.groupBy("id").agg(F.min(F.struct("n", "s", "t")).alias("x"), F.max(F.struct("n", "s", "t")).alias("y"))
    several = materialise(sets.where("x <> y").select("id"), "several")
    stands = copies.select(F.col("b").alias("id"), "a").join(several, "id", "left_anti")
    bound = copies.join(several.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")
    groups = work.where(f"kind = {STAR}").select("g", "id").join(stands, "id", "left").select("g", F.coalesce("a", "id").alias("id")).distinct()
    allowed = materialise(_walks(_blocks(groups.join(marks, "id"), "g"), "g", "mark", percent, None), "allowed")
    families = connected_components(allowed, "families").select(F.col("component").alias("family"), F.col("node").alias("id"))
    of = families.join(marks.drop("mark"), "id")
    members = materialise(_blocks(of, "family"), "members")
    links = _walks(members.join(base, "id"), "family", "text", percent, words)
    found = connected_components(links.union(bound), "components")
    named = info.select("id", "n").join(stands, "id", "left").select("id", "n", F.coalesce("a", "id").alias("rep")).join(found, F.col("rep") == F.col("node"), "left")
    rows = named.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))

    names = rows.columns

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), pa.array([len(shingle_set(t, words)) for t in b.column(1).cast(pa.binary()).to_pylist()], pa.int64()), pa.nulls(b.num_rows, pa.int64())], names=names)

    schema = T.StructType([T.StructField(c, T.LongType()) for c in names])
    return rows.union(base.where("id is null").mapInArrow(sizes, schema))
