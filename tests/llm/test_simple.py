import hashlib
import random
import zlib
from collections import defaultdict

import public_tokenizers
import pyarrow as pa
import pytest

from motionloom.llm import grace, packing, pieces
from motionloom.llm.common import LOWER, UPPER

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
FOLD = str.maketrans(UPPER, LOWER)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# pieces


def test_pieces_equal_the_library(rng):
    import sentencepiece

    sp, c = sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.PieceCodec(PIECES)
    for _ in range(4000):
        s = "".join(rng.choice("ab e th\n ▁▁  \t's.0é漢\x00<>x中 ñ🙂") for _ in range(rng.randint(0, 14)))
        ids = sp.encode(s)
        assert c.encode(s) == ids
        assert c.decode(ids) == sp.decode(ids)
    for _ in range(500):
        ids = [rng.randrange(3, 300) for _ in range(rng.randint(0, 6))]
        assert c.decode(ids) == sp.decode(ids)


def test_pieces_of_odd_rows(odd_docs, no_docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted((str(r["doc_id"]), tuple(sp.encode(r["text"] or "")), sp.decode(sp.encode(r["text"] or ""))) for r in odd_docs.select("doc_id", "text").collect())
    got = sorted((str(r["doc_id"]), tuple(r["ids"]), r["decoded"]) for r in pieces.encode_documents(odd_docs, PIECES).collect())
    assert got == want
    digests = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in pieces.encode_digests(odd_docs, PIECES).collect())
    assert digests == sorted((i, len(x), sha(",".join(map(str, x))), sha(d)) for i, x, d in want)
    assert pieces.encode_documents(no_docs, PIECES).count() == pieces.encode_digests(no_docs, PIECES).count() == 0


# grace


@pytest.mark.parametrize("memory", [1, 200, 1 << 20])
def test_grace_buckets_find_every_group(memory, rng):
    import xxhash

    rows = [(str(rng.randrange(60)) * rng.randrange(1, 3)).encode() for _ in range(500)]
    want = defaultdict(list)
    for k, c in enumerate(rows):
        want[c].append((k,))
    got = {c: sorted(p) for _, c, p in grace.groups(((xxhash.xxh3_128_digest(c), c, (k,)) for k, c in enumerate(rows)), memory)}
    assert got == want


def test_grace_tells_equal_hashes_apart():
    got = {c: p for _, c, p in grace.groups([(b"\0" * 16, b"a", 1), (b"\0" * 16, b"b", 2), (b"\0" * 16, b"a", 3)], 1)}
    assert got == {b"a": [1, 3], b"b": [2]}


@pytest.mark.parametrize("memory", [1, 1 << 20])
def test_exact_groups_of_odd_rows(odd_docs, no_docs, memory):
    rows = odd_docs.select("doc_id", "text").collect()
    want, of = [], defaultdict(list)
    for r in rows:
        of[(r["text"] or "").translate(FOLD)].append(r["doc_id"])
    for t, ids in of.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(str(i), str(keep), len(ids), sha(t)) for i in ids]
    got = grace.exact_groups(odd_docs, memory=memory).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == sorted(want)
    assert sorted(str(r["doc_id"]) for r in got if r["kept"]) == sorted(str(max((i for i in ids if i is not None), default=None)) for ids in of.values())
    assert grace.exact_groups(no_docs).count() == 0


# packing


def naive_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [(r, k) for k, r in enumerate(bins) if r >= n]
        if fit:
            bins[min(fit)[1]] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


def test_group_packing_is_best_fit_decreasing():
    r = random.Random(3)
    for _ in range(200):
        capacity = r.randint(1, 40)
        lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 60))]
        placed, bins = packing.best_fit_decreasing({n: lengths.count(n) for n in set(lengths)}, capacity)
        used = defaultdict(list)
        for n, a, b, first, each, offset in placed.tolist():
            for i in range(b - a):
                used[first + i // each].append((offset + i % each * n, n))
        assert sorted(n for own in used.values() for _, n in own) == sorted(lengths)
        for own in used.values():
            at = 0
            for offset, n in sorted(own):
                assert offset == at
                at += n
            assert at <= capacity
        assert len(used) == bins
        assert sorted(capacity - sum(n for _, n in own) for own in used.values()) == naive_best_fit(lengths, capacity)


def test_packed_documents(odd_docs, no_docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    want = []
    for r in odd_docs.select("doc_id", "text").collect():
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for p, at in enumerate(range(0, len(ids), 512)):
            own = ids[at : at + 512]
            want.append((str(r["doc_id"]), p, at, len(own), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own))))
    got = packing.pack_documents(odd_docs, WORDS, 512).collect()
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    at = defaultdict(list)
    for r in got:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in at.values():
        end = 0
        for offset, n in sorted(own):
            assert offset == end
            end += n
        assert end <= 512
    assert len(at) == len(naive_best_fit([w[3] for w in want], 512))
    assert packing.pack_documents(no_docs, WORDS).count() == 0


def test_units_of_the_word_tokenizer(rng):
    from tokenizers import Tokenizer

    t, w = Tokenizer.from_file(WORDS), packing.WordTokens(WORDS)
    pool = ["It's", "x.", "DON'T,", "H̱", "İ.", "Σας", "<|endoftext|>", "a,b.", "!.", "9.", "ß,", "é", "\x1c", "\x85", "\xa0", " ", "\n", "İ", ".", "漢字.", "İ"]
    for _ in range(2000):
        s = "".join(rng.choice(pool) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 8)))
        assert next(w.encode(pa.array([s]))).tolist() == t.encode(s, add_special_tokens=False).ids, repr(s)


def test_many_units_in_blocks(rng, monkeypatch):
    from tokenizers import Tokenizer

    for name, few in (("BLOCK_CHARS", 50), ("CALL_CHARS", 20), ("CACHE_BYTES", 2000)):
        monkeypatch.setattr(packing, name, few)
    texts = [None if rng.random() < 0.1 else " ".join(rng.choice(["one", "Two,", "x\x01", "ÀB.", "漢", ""]) + str(rng.randrange(30)) for _ in range(rng.randint(0, 9))) for _ in range(300)]
    want = [e.ids for e in Tokenizer.from_file(WORDS).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in packing.WordTokens(WORDS).encode(pa.array(texts))] == want


def test_other_tokenizers_encode_whole_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    w, texts = packing.WordTokens(path), ["  Two  spaces\n\nand lines ", "", "a b<|endoftext|> c"]
    assert not w.by_words
    assert [x.tolist() for x in w.encode(pa.array(texts))] == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]


def test_groups_of_text_ids_and_small_memory(spark, rng):
    rows = [(rng.choice(["", "a", "b", "cc", None]) if k % 9 == 0 else f"id{k:03}", rng.choice(["x", "X", "yy", None, "", "long " * 30])) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(4)
    for memory in (1, 2000, 1 << 20):
        got = grace.exact_groups(docs, memory=memory).collect()
        groups = defaultdict(list)
        for i, t in rows:
            groups[(t or "").translate(FOLD)].append(i)
        want = sorted((str(i), str(max((x for x in own if x is not None), default=None)), len(own), sha(t)) for t, own in groups.items() for i in own)
        assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == want
        assert sum(r["kept"] for r in got) == len(groups)
