"""Ranked search against a plain loop, and on odd tables."""

import math
import re
from collections import Counter

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, best=10):
    held = [(i, Counter(t), len(t)) for i, text in docs if (t := terms_of(text))]
    n, total = len(held), sum(x[2] for x in held)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms_of(text))
    out = {}
    for item, terms in wanted.items():
        scores = []
        for i, counts, size in held:
            m, score = 10 + (90 * size * n) // total, 0
            for t in terms & set(counts):
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in c for _, c, _ in held) + 1)))
                score += w * ((10**9 * counts[t]) // (1000 * counts[t] + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out[item] = [(k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:best])]
    return {k: v for k, v in out.items() if v}


def searched(docs, items):
    from tercet.llm.lexical import ranked

    got = {}
    for r in ranked(docs, items).orderBy("item_id", "rank").collect():
        got.setdefault(r.item_id, []).append((r.rank, r.doc_id, r.score))
    return got


def test_ranked_equals_a_loop(spark, monkeypatch):
    from tercet.llm import lexical

    monkeypatch.setattr(lexical, "BLOCK_DOCS", 16)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(12)
    assert searched(docs, items) == plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    monkeypatch.setattr(lexical, "ITEM_TERMS", 60)  # several blocks of items
    assert searched(docs, items) == plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_ranked_odd_rows(spark, odd_documents, no_documents):
    more = spark.createDataFrame([(None, "long1 LONG2 short", "x", "y", 1, 1), (None, None, "x", "y", 1, 1)], odd_documents.schema)
    docs = odd_documents.unionByName(more)
    items = [(1, "Short text é, 日本"), (1, "long7"), (2, None), (3, ""), (4, "w1x1 W2X2 long1 averyveryverylongterm1234567"), (None, "long1 long2"), (5, "nowhere"), (6, " ".join(f"long{i}" for i in range(200)) + " short w1x1")]
    table = spark.createDataFrame([(*i, "src", 1) for i in items], "item_id long, text string, source string, n long")
    got = searched(docs, table)
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()], items)
    assert set(got) == {1, 4, 6, None} and any(i is None for _, i, _ in got[None])
    assert searched(no_documents, table) == {} and searched(docs, table.limit(0)) == {}


def test_groups_stop_before_all_documents_are_scored():
    import numpy as np

    from tercet.llm.lexical import Searcher

    dice = np.random.default_rng(2)
    docs, terms = 400, 6
    present = dice.random((docs, terms)) < np.array([0.9, 0.8, 0.5, 0.2, 0.1, 0.02])
    held = present.sum(axis=1)
    keep = held > 0
    tool = Searcher([np.arange(terms)], np.array([100, 150, 700, 1500, 2300, 4000]), docs, docs * 20)
    args = np.flatnonzero(keep), np.ones(keep.sum(), np.uint8), np.full(keep.sum(), 20), held[keep], np.nonzero(present[keep])[1], np.ones(held.sum(), np.int64)
    tool.show(*args)
    assert tool.scored < keep.sum() / 4
    score = (present[keep] * (tool.weights * (10**9 // (1000 + 8 * 100)))).sum(axis=1)
    wanted = np.lexsort((args[0], -score))[:10]
    assert tool.best[0][0].tolist() == score[wanted].tolist() and tool.best[0][2].tolist() == args[0][wanted].tolist()
