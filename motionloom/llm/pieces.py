"""SentencePiece encoding and decoding with a merge-type prefix table.

A merge-type (BPE) encoding has the property that every prefix of the encoded text ends in exactly one last
token, and that a sequence is the encoding of its text if and only if each adjacent pair of tokens is the
encoding of the pair's own text. So a table with one entry per prefix suffices: an automaton reports the pieces
that end at each position, longest first, and the one whose pair with the last token of the shorter prefix is
compatible is the entry. The ids are recovered backwards from the whole text's entry.

Texts split without loss where no piece can cross: before a space mark that follows anything else, and around
line feeds. The units that result are encoded once per worker and kept in a bounded cache.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
#: Bounds of a worker's caches, in bytes of units and their ids and in pairs; beyond them they are emptied and fill again.
CACHE_BYTES = 160 << 20
UNIT_BYTES = 250
BLOCK_CHARS = 4_000_000
CACHE_PAIRS = 1_500_000


class PieceCodec:
    """Encoder and decoder for a merge-type model with byte fallback, an identity normaliser and a dummy prefix."""

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_of: dict[int, int] = {i: int(self.pieces[i][3:-1], 16) for i in range(n) if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id_of = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: sp.get_score(i) for i in plain}
        self.length = [len(p) for p in self.pieces]
        self.names = [str(i) for i in range(n)]
        self.silent = {i for i in range(n) if sp.is_control(i)}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.id_of):
            raise ValueError("a piece crosses a unit border; this model needs another split")
        self._build_automaton(plain)
        self.whole = {i: self._merge(self.pieces[i]) == [i] for i in plain}
        self.pairs: dict[int, bool] = {}
        self._reset()

    def _build_automaton(self, plain: list[int]) -> None:
        """Matching automaton over the pieces; ``ends[state]`` has (id, length) of the pieces that end there, longest first.

        Built here rather than taken from a library, for its states must be kept and resumed in the middle of a word.
        """
        self.step: dict[int, int] = {}
        self.fail, self.ends = [0], [()]
        order: list[tuple[int, int, int]] = []  # (parent, character, state), parents first within a depth
        by_depth: dict[int, list[tuple[int, int, int]]] = {}
        for i in plain:
            state = 0
            for depth, c in enumerate(map(ord, self.pieces[i])):
                nxt = self.step.get(state << 21 | c)
                if nxt is None:
                    nxt = self.step[state << 21 | c] = len(self.fail)
                    self.fail.append(0)
                    self.ends.append(())
                    by_depth.setdefault(depth, []).append((state, c, nxt))
                state = nxt
            self.ends[state] = ((i, self.length[i]),)
        for depth in sorted(by_depth):
            order += by_depth[depth]
        for parent, c, state in order:
            f = self._next(self.fail[parent], c) if parent else 0
            self.fail[state] = f
            self.ends[state] = self.ends[state] + self.ends[f]

    def _next(self, state: int, c: int) -> int:
        """Follow failure links; what is found is remembered by the caller where it pays."""
        while True:
            nxt = self.step.get(state << 21 | c)
            if nxt is not None:
                return nxt
            if not state:
                return 0
            state = self.fail[state]

    def _reset(self) -> None:
        self.units: dict[str, str] = {"\n\n": f",{self.byte_id[10]}"}
        self.texts: dict[str, str] = {"\n\n": "\n"}
        self.held = 0

    def _merge(self, s: str) -> list[int]:
        """Direct merging of a short string: the definition that the pair test appeals to."""
        parts, score = list(s), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                v = score.get(parts[k] + parts[k + 1])
                if v is not None and (best is None or v > best):
                    best, at = v, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.id_of.get(p, -1) for p in parts]

    def _compatible(self, left: int, right: int) -> bool:
        ok = self._merge(self.pieces[left] + self.pieces[right]) == [left, right]
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        self.pairs[left << 20 | right] = ok
        return ok

    def encode_units(self, sorted_units: list[str]) -> Iterator[list[int]]:
        """Ids of each unit (spaces already marks); a unit's table starts from what it shares with the one before.

        ``last[k]`` is the last token of the prefix of k characters, -1 where a character has no piece.
        """
        ends, pairs, whole, length, step, follow = self.ends, self.pairs, self.whole, self.length, self.step, self._next
        before, last, states = "", [-1], [0]
        for s in sorted_units:
            k, most = 0, min(len(before), len(s))
            while k < most and before[k] == s[k]:
                k += 1
            del last[k + 1 :], states[k + 1 :]
            state = states[k]
            for end in range(k, len(s)):
                c = ord(s[end])
                nxt = step.get(state << 21 | c)
                state = follow(state, c) if nxt is None else nxt
                states.append(state)
                end += 1
                for t, n in ends[state]:
                    p = last[end - n]
                    if p < 0:
                        if whole[t]:
                            last.append(t)
                            break
                    else:
                        ok = pairs.get(p << 20 | t)
                        if self._compatible(p, t) if ok is None else ok:
                            last.append(t)
                            break
                else:
                    last.append(-1)
            before = s
            ids, i = [], len(s)
            while i > 0:
                t = last[i]
                if t < 0:
                    i -= 1
                    ids.extend(self.byte_id[b] for b in reversed(s[i].encode("utf-8")))
                else:
                    ids.append(t)
                    i -= length[t]
            ids.reverse()
            yield ids

    def learn(self, keys) -> None:
        """Put the units of ``keys`` that aren't there yet into the cache, in sorted order; the cache is bounded."""
        new = [k for k in set(keys) if k not in self.units]
        if self.held > CACHE_BYTES:
            self._reset()
            new = [k for k in set(keys) if k not in self.units]
        named = sorted((k[1:] if k[:1] == "\n" else MARK + k, k) for k in new)
        names = self.names
        for (_, k), ids in zip(named, self.encode_units([s for s, _ in named]), strict=True):
            self.units[k] = "," + ",".join([names[i] for i in ids])
            self.texts[k] = self._decode_pieces(ids)
            self.held += UNIT_BYTES + 2 * len(k) + len(self.units[k]) + len(self.texts[k])

    def _decode_pieces(self, ids) -> str:
        out, run = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(_utf8(run))
                run = bytearray()
            if i not in self.silent:
                out.append(self.pieces[i].replace(MARK, " "))
        if run:
            out.append(_utf8(run))
        return "".join(out)

    def keys(self, text: str) -> list[str]:
        """The text as cache keys, in order; joined they are the text behind its dummy prefix."""
        out: list[str] = []
        if not text:
            return out
        plain = MARK not in text and "  " not in text and text[0] != " "
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append("\n\n")
            if plain and line[-1:] != " ":
                words = line.split(" ")
                if k:
                    if words[0]:
                        out.append("\n" + words[0])
                    words = words[1:]
                out += words
            elif line or not k:
                out += self._marked(line, not k)
        return out

    @staticmethod
    def _marked(line: str, first: bool) -> list[str]:
        """Units of a line with runs of spaces or literal marks: each run belongs to what follows it."""
        s, out, i = (MARK + line if first else line).replace(" ", MARK), [], 0
        n = len(s)
        while i < n:
            j = i
            while j < n and s[j] == MARK:
                j += 1
            j2 = s.find(MARK, j)
            j2 = n if j2 < 0 else j2
            unit = s[i:j2]
            out.append(unit[1:] if unit[0] == MARK else "\n" + unit)
            i = j2
        return out

    def encode_texts(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """(comma-joined ids, decoded text) of each whole text; works through about BLOCK_CHARS characters at a time."""
        i = 0
        while i < len(texts):
            keys, chars = [], 0
            while i < len(texts) and (not keys or chars < BLOCK_CHARS):
                keys.append(self.keys(texts[i]))
                chars += len(texts[i])
                i += 1
            self.learn([k for x in keys for k in x])
            ids, text = self.units.__getitem__, self.texts.__getitem__
            for x in keys:
                yield "".join(map(ids, x))[1:], "".join(map(text, x))[1:]

    def encode(self, text: str | None) -> list[int]:
        joined, _ = next(self.encode_texts([text or ""]))
        return [int(x) for x in joined.split(",")] if joined else []

    def decode(self, ids) -> str:
        """Text of ids: marks become spaces, runs of byte pieces are read as UTF-8, the dummy prefix goes."""
        ids = list(ids)
        text = self._decode_pieces(ids)
        first = next((i for i in ids if i not in self.silent), None)
        return text[1:] if text[:1] == " " and first not in self.byte_of else text


def _utf8(run: bytearray) -> str:
    """UTF-8 with one replacement character for each byte that starts no valid sequence."""
    try:
        return run.decode("utf-8")
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(run):
            for k in (1, 2, 3, 4):
                try:
                    out.append(bytes(run[i : i + k]).decode("utf-8"))
                    i += k
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


_CODECS: dict[str, PieceCodec] = {}


def codec(model_path: str) -> PieceCodec:
    """The worker's codec for a model; built once per Python worker."""
    if model_path not in _CODECS:
        _CODECS[model_path] = PieceCodec(model_path)
    return _CODECS[model_path]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode it again: ``id_col, ids array<int>, decoded string``.

    Row by row without a shuffle; only the two columns are read, so extra columns of any name do no harm. Null
    texts count as empty (no ids, empty decoded text); null ids pass through; repeated rows give repeated rows;
    an empty table gives an empty result. ``model_path`` must be readable on the executors.
    """
    schema = T.StructType([docs.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for b in batches:
            ids = [[int(x) for x in j.split(",")] if j else [] for j, _ in c.encode_texts([t or "" for t in b.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(x) for x in ids], pa.string())], names=[id_col, "ids", "decoded"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def encode_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`encode_documents`, but with digests in place of ids and text, so that neither leaves the worker:
    ``id_col, n_tokens long, ids_sha256 string, decoded_sha256 string``. Same cases, same results.
    """
    schema = T.StructType([docs.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        c = codec(model_path)
        for b in batches:
            n, h, d = [], [], []
            for joined, text in c.encode_texts([t or "" for t in b.column(1).to_pylist()]):
                n.append(joined.count(",") + 1 if joined else 0)
                h.append(sha256(joined.encode()).hexdigest())
                d.append(sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(h, pa.string()), pa.array(d, pa.string())], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
