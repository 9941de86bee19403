from motionloom.llm import runs


def brute(rows, min_chars):
    """Lines left of each (id, text), rows in order of id: each two positions' common run, taken as far as it goes both ways."""
    docs = [(i, text, (text or "").split("\n")) for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))]
    every = [(d, k) for d, (_, _, lines) in enumerate(docs) for k in range(len(lines))]
    line = lambda p: docs[p[0]][2][p[1]] if 0 <= p[1] < len(docs[p[0]][2]) else None
    at, gone = {}, [set() for _ in docs]
    for p in every:
        at.setdefault(line(p), []).append(p)
    for p in every:
        for q in at[line(p)]:
            if q >= p:
                break
            low = high = 0
            while line((p[0], p[1] + low - 1)) is not None and line((p[0], p[1] + low - 1)) == line((q[0], q[1] + low - 1)):
                low -= 1
            while line((p[0], p[1] + high + 1)) is not None and line((p[0], p[1] + high + 1)) == line((q[0], q[1] + high + 1)):
                high += 1
            if sum(len(line((p[0], p[1] + k))) + 1 for k in range(low, high + 1)) >= min_chars:
                gone[p[0]].add(p[1])
                break
    out = []
    for (i, text, lines), g in zip(docs, gone, strict=True):
        out.append((str(i), text if not g else "\n".join(x for k, x in enumerate(lines) if k not in g), len(lines), len(g)))
    return sorted(out, key=str)


def result(docs, **more):
    return sorted([(str(r["doc_id"]), r["text"], r["lines_total"], r["lines_removed"]) for r in runs.dedup_lines(docs, **more).collect()], key=str)


def test_lines_equal_brute_force(spark, rng):
    rows = [(k, "\n".join(rng.choice(["", "a", "bb", "ccc", "dddd", "eeeee eeeee", "}"]) for _ in range(rng.randint(1, 9)))) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for least in (1, 7, 16):
        assert result(docs, min_chars=least) == brute(rows, least)


def test_repeats_of_short_lines(spark, rng):
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(2, 4))) for _ in range(60)]
    rows = [(1, "\n".join(words)), (2, "own line here\n" + "\n".join(words[5:17]) + "\nand another"), (3, "\n".join(words[:3])), (4, "x" * 50 + "\nend"), (5, "x" * 50 + "\nend"), (6, "\n" * 100)]
    got = result(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute(rows, runs.MIN_CHARS)
    removed = {i: n for i, _, _, n in got}
    assert removed == {"1": 0, "2": 12, "3": 0, "4": 0, "5": 2, "6": 100}


def test_lines_of_odd_rows(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert runs.dedup_lines(odd_docs).columns == [*odd_docs.columns, "lines_total", "lines_removed"]
    assert result(odd_docs) == brute(rows, runs.MIN_CHARS)
    assert runs.dedup_lines(no_docs).count() == 0
