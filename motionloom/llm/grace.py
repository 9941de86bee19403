"""Exact deduplication by Grace hashing.

Records are dealt to buckets by a hash of their content. A bucket that fits the memory budget goes through an
open-addressing table that compares complete contents; one that doesn't is dealt again, by other bits of the
hash, to spill files, and so on. Before anything is shuffled each input partition combines its own copies, so a
content that fills a third of the corpus crosses the network once a partition.

Spill files belong to one task: they are unnamed, vanish with it and are made again if the task is retried.
What later stages need is a written table in the shared folder.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motionloom.llm.common import LOWER, UPPER, materialise

FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Bytes of content that a task holds at once, and buckets of one level of dealing (8 bits of the hash each).
MEMORY_BYTES = 64 << 20
FAN_OUT = 16
HASH_BYTES = 16
#: What a record costs a task besides its content, about.
MEMBER_BYTES = 200


class ContentTable:
    """Open addressing with linear probing; a slot holds an entry's number, and entries compare by hash, then bytes."""

    def __init__(self):
        self.slots = [-1] * 64
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def entry(self, h: bytes, content: bytes) -> int:
        """Number of the entry with this content, a new one if there is none."""
        key, slots = int.from_bytes(h[-8:], "little"), self.slots
        mask = len(slots) - 1
        at = key & mask
        while (e := slots[at]) >= 0:
            if self.hashes[e] == key and self.contents[e] == content:
                return e
            at = (at + 1) & mask
        e = slots[at] = len(self.contents)
        self.hashes.append(key)
        self.contents.append(content)
        self.bytes += len(content) + 64
        if 2 * len(self.contents) > len(slots):
            self._grow()
        return e

    def _grow(self) -> None:
        self.slots = [-1] * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for e, key in enumerate(self.hashes):
            at = key & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = e


def groups(records: Iterable[tuple[bytes, bytes, tuple]], memory: int = MEMORY_BYTES, depth: int = 0) -> Iterator[tuple[bytes, bytes, list[tuple]]]:
    """(hash, content, payloads) of each distinct content among (hash, content, payload) records.

    Fills a table until ``memory`` bytes of distinct contents and payloads are held. Then what is held and all that follows
    is dealt to FAN_OUT spill files by the hash's byte ``depth``, each of which is worked through in the same way.
    Copies of a content that is held cost its payload only.
    """
    table, payloads, rows, held = ContentTable(), [], iter(records), 0
    for h, content, payload in rows:
        e = table.entry(h, content)
        if e == len(payloads):
            payloads.append([])
        payloads[e].append((h, payload))
        held += MEMBER_BYTES
        if table.bytes + held > memory and depth < HASH_BYTES and len(payloads) > 1:
            break
    else:
        for e, own in enumerate(payloads):
            yield own[0][0], table.contents[e], [p for _, p in own]
        return
    import pickle

    files = [tempfile.TemporaryFile() for _ in range(FAN_OUT)]
    try:
        for e, own in enumerate(payloads):
            pickle.dump((own[0][0], table.contents[e], [p for _, p in own]), files[own[0][0][depth] % FAN_OUT])
        del table, payloads
        for h, content, payload in rows:
            pickle.dump((h, content, [payload]), files[h[depth] % FAN_OUT])
        for f in files:
            f.seek(0)
            yield from groups(_read(f), memory, depth + 1)
            f.close()
    finally:
        for f in files:
            f.close()


def _read(f) -> Iterator[tuple[bytes, bytes, tuple]]:
    import pickle

    while True:
        try:
            h, content, own = pickle.load(f)
        except EOFError:
            return
        for p in own:
            yield h, content, p


def _id_key(i):
    """Order of ids of any type: a null comes before all others."""
    return (False, 0) if i is None else (True, i)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = MEMORY_BYTES) -> DataFrame:
    """Groups of rows whose texts are the same after lower-casing A-Z only: one row for each row of ``docs``.

    Columns: ``id_col, keep_id`` (largest id of the group), ``group_size long, kept boolean, text_sha256 string``.
    Null texts count as empty and form one group. A null id is smaller than all others (``keep_id`` is null if the
    group has no other). Of repeated rows with the group's largest id exactly one is kept. Other columns of
    ``docs`` are not read. An empty table gives no rows.
    """
    id_field = docs.schema[id_col]
    local = T.StructType([T.StructField("id", id_field.dataType), *(T.StructField(n, t) for n, t in (("part", T.IntegerType()), ("gid", T.IntegerType()), ("stands", T.BooleanType()), ("n", T.LongType()), ("hash", T.BinaryType()), ("content", T.BinaryType())))])
    id_type = pa.int64() if isinstance(id_field.dataType, T.LongType) else None

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Copies within the input partition: the row with the largest id stands for its group and carries the content."""
        part, first = TaskContext.get().partitionId(), 0
        table, members, best, held = ContentTable(), [], [], 0
        out_schema = None

        def flush():
            nonlocal table, members, best, first
            ids, gids, stands, n, hashes, contents = [], [], [], [], [], []
            for e, own in enumerate(members):
                for k, i in enumerate(own):
                    rep = k == best[e]
                    ids.append(i)
                    gids.append(first + e)
                    stands.append(rep)
                    n.append(len(own) if rep else None)
                    hashes.append(xxhash.xxh3_128_digest(table.contents[e]) if rep else None)
                    contents.append(table.contents[e] if rep else None)
            first += len(members)
            table, members, best = ContentTable(), [], []
            arrays = [pa.array(ids, out_schema or id_type), pa.array([part] * len(ids), pa.int32()), pa.array(gids, pa.int32()), pa.array(stands, pa.bool_()), pa.array(n, pa.int64()), pa.array(hashes, pa.binary()), pa.array(contents, pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=local.names)

        for b in batches:
            out_schema = b.schema.field(0).type
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                content = (t or b"").translate(FOLD)
                e = table.entry(xxhash.xxh3_128_digest(content), content)
                if e == len(members):
                    members.append([])
                    best.append(0)
                members[e].append(i)
                if _id_key(i) > _id_key(members[e][best[e]]):
                    best[e] = len(members[e]) - 1
                held += MEMBER_BYTES
                if table.bytes + held > memory:
                    yield flush()
                    held = 0
        if members:
            yield flush()

    combined = materialise(docs.select(F.col(id_col), F.col(text_col)).mapInArrow(combine, local), "grace")
    found = T.StructType([*(T.StructField(n, t) for n, t in (("part", T.IntegerType()), ("gid", T.IntegerType()))), T.StructField("keep_id", id_field.dataType), *(T.StructField(n, t) for n, t in (("group_size", T.LongType()), ("wins", T.BooleanType()), ("text_sha256", T.StringType())))])

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        kind = id_type

        def records():
            nonlocal kind
            for b in batches:
                kind = b.schema.field(0).type
                yield from ((h, c, (i, p, g, n)) for i, p, g, n, h, c in zip(*(x.to_pylist() for x in b.columns), strict=True))

        rows: list[tuple] = []

        def batch():
            cols = list(zip(*rows, strict=True))
            types = [pa.int32(), pa.int32(), kind, pa.int64(), pa.bool_(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=found.names)

        for _, content, own in groups(records(), memory):
            top = max(own, key=lambda x: (_id_key(x[0]), -x[1], -x[2]))
            size, digest = sum(x[3] for x in own), sha256(content).hexdigest()
            rows += [(p, g, top[0], size, (p, g) == top[1:3], digest) for _, p, g, _ in own]
            if len(rows) >= 10_000:
                yield batch()
                rows = []
        if rows:
            yield batch()

    stand = combined.where("stands").select("id", "part", "gid", "n", "hash", "content")
    resolved = stand.repartition("hash").mapInArrow(resolve, found)
    return combined.select("id", "part", "gid", "stands").join(resolved, ["part", "gid"]).select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("stands") & F.col("wins")).alias("kept"), "text_sha256")
