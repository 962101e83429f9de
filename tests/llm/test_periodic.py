"""Extensions and runs against plain loops."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w):
    """All maximal stretches with smallest period q and length >= max(6, 4q)."""
    n, seen = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                seen.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in seen.items())


def altered(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def plain(doc_id, text):
    w = altered(doc_id, text)
    found = plain_runs(w)
    best = (None,) * 4
    if found:
        from fractions import Fraction

        s, length, q = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
        best = (s, length, q, 1000 * length // q)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{a},{b},{c}\n" for a, b, c in found), " ".join(x for i, x in enumerate(w) if i not in gone))]
    return (doc_id, len(found), *best, *digest)


def strings():
    dice = random.Random(5)
    for k in range(160):
        size, letters = dice.choice([0, 1, 5, 6, 7, 30, 90, 200]), dice.choice([1, 2, 3, 40])
        w = [dice.randrange(letters) for _ in range(size)]
        if k % 3 == 0 and size > 8:  # repetitions inside
            p = dice.randrange(1, size // 4 + 1)
            a = dice.randrange(size // 2)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(size)]
        yield w
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a
    yield b


@pytest.mark.parametrize("forward", [True, False])
def test_extensions_equal_a_loop(forward):
    from tercet.llm.recompression import Grammar

    dice = random.Random(9)
    parts = [w for w in strings()]
    flat = np.array([x for w in parts for x in w])
    first = np.cumsum([0, *map(len, parts)])
    tool = Grammar(flat, first[:-1])
    assert len(tool.levels) > 6
    a, b, wanted = [], [], []
    for k, w in enumerate(parts):
        for _ in range(12 if w else 0):
            i, j = dice.randrange(len(w)), dice.randrange(len(w))
            n = 0
            if forward:
                while max(i, j) + n < len(w) and w[i + n] == w[j + n]:
                    n += 1
            else:
                while min(i, j) - n > 0 and w[i - n - 1] == w[j - n - 1]:
                    n += 1
            if i != j:
                a.append(first[k] + i)
                b.append(first[k] + j)
                wanted.append(n)
    assert tool.extension(np.array(a), np.array(b), forward).tolist() == wanted


def test_runs_equal_a_loop(monkeypatch):
    from tercet.llm import periodic

    parts = list(strings())
    flat, first = np.array([x for w in parts for x in w]), np.cumsum([0, *map(len, parts)])
    for grid in (64, 1 << 21):
        monkeypatch.setattr(periodic, "GRID", grid)
        start, end, q = periodic.runs(flat, first)
        owner = np.searchsorted(first, start, "right") - 1
        got = [sorted(zip((start[owner == k] - first[k]).tolist(), (end - start)[owner == k].tolist(), q[owner == k].tolist(), strict=True)) for k in range(len(parts))]
        assert got == [plain_runs(w) for w in parts]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_periodic_documents(spark, odd_documents, no_documents):
    from tercet.llm.periodic import periodic_runs

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows(periodic_runs(docs)) == sorted((plain(r.doc_id, r.text) for r in docs.collect()), key=str)
    many = " ".join(["to be"] * 40 + ["x"] + [" y"] * 9 + ["averyveryverylongword1", "averyveryverylongword2"] * 6)
    more = spark.createDataFrame([(None, many, "x", "y", 1, 1), (None, None, "x", "y", 1, 1), (21, many, None, None, None, 1), (6, "a", "x", "y", 1, 1)], odd_documents.schema)
    short = odd_documents.filter("doc_id <> 8").unionByName(more)
    got = rows(periodic_runs(short))
    assert got == sorted((plain(r.doc_id, r.text) for r in short.collect()), key=str)
    assert periodic_runs(odd_documents).count() == odd_documents.count()
    assert periodic_runs(no_documents).count() == 0
