"""Letter models against a direct Kneser-Ney, held-out accuracy, and odd tables."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id long"


def symbols(text):
    out = [""]
    for c in text:
        c = c.lower() if c.isalpha() else ""
        if c or out[-1]:
            out.append(c)
    return out + [""] * bool(out[-1])


def four(text):
    s = symbols(text)
    return [tuple(([""] * 3 + s)[i : i + 4]) for i in range(1, len(s))]


class Direct:
    def __init__(self, texts, kinds):
        counts = Counter(g for t in texts for g in four(t))
        self.kinds, self.orders = kinds, {}
        for order in (4, 3, 2, 1):
            once, twice = (sum(v == k for v in counts.values()) for k in (1, 2))
            d = once / (once + 2 * twice) if once and twice else 0.5
            total, types = defaultdict(int), defaultdict(int)
            for g, n in counts.items():
                total[g[:-1]] += n
                types[g[:-1]] += 1
            self.orders[order] = (dict(counts), d, total, types)
            counts = Counter(g[1:] for g in counts)

    def p(self, gram):
        if not gram:
            return 1 / self.kinds
        counts, d, total, types = self.orders[len(gram)]
        if gram[:-1] not in total:
            return self.p(gram[1:])
        n = total[gram[:-1]]
        return max(counts.get(gram, 0) - d, 0) / n + d * types[gram[:-1]] / n * self.p(gram[1:])

    def bits(self, text):
        each = four(text)
        return -sum(math.log2(self.p(g)) for g in each) / len(each)


TEXTS = {"de": ["Der Hund und die Katze 12 schlafen.", "Über das Öl, ja"], "en": ["the dog and the cat sleep", "An oil of the THE den"], "xx": ["日本語 𐐀𐐁"]}


def key(gram):
    out = 0
    for c in gram:
        k = ord(c) if c else 0
        out = out << 16 | (k if k <= 0xFFFF else 0xE000 + k % 0x1900)
    return out


def model_of(texts):
    from tercet.llm.charmodel import Languages

    out = {}
    for lang, held in texts.items():
        counts = Counter(key(g) for t in held for g in four(t))
        keys = sorted(counts)
        out[lang] = (np.array(keys, np.uint64), np.array([counts[k] for k in keys]))
    return Languages(out)


def arrays(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_grams_equal_a_loop():
    from tercet.llm.charmodel import grams

    texts = ["", "a", "12 !", " Ab  c-d", "é日", "𐐀x", "", "TheEnd."]
    keys, per_doc = grams(*arrays(texts))
    assert per_doc.tolist() == [len(four(t)) for t in texts]
    assert keys.tolist() == [key(g) for t in texts for g in four(t)]
    broken = np.frombuffer(b"ab\xff\xfec", np.uint8)
    assert grams(broken, np.array([0, 5]))[1].tolist() == [len(four("ab??c"))]


def test_entropies_equal_a_direct_model():
    from tercet.llm.charmodel import grams

    model = model_of(TEXTS)
    kinds = len({g[-1] for t in TEXTS.values() for x in t for g in four(x)}) + 1
    probes = ["the cat", "die Katze schläft", "Ωmega zzz", "日本", "q"]
    got = model.entropies(*grams(*arrays(["", *probes])))
    assert np.isnan(got[0]).all()
    for k, lang in enumerate(model.names):
        direct = Direct(TEXTS[lang], kinds)
        assert got[1:, k].tolist() == pytest.approx([direct.bits(t) for t in probes], rel=1e-5)
        assert sum(direct.p(("", "t", "h", c)) for c in {g[-1] for t in TEXTS.values() for x in t for g in four(x)} | {"?"}) == pytest.approx(1)


def test_held_out_documents_are_told_apart(spark):
    from tercet.llm.languages import identified

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identified(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert len(got) == docs.count()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got[got.held_out]
    right = held.lang_pred == held.lang
    assert right.mean() > 0.97 and got.score.between(0, 1).all()
    accepted = ~held.rejected
    assert accepted.mean() > 0.8 and right[accepted].mean() >= 0.98


def test_labels_of_held_out_documents_change_nothing(spark):
    from pyspark.sql import functions as F

    from tercet.llm.languages import identified

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    other = docs.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("x"))
    a, b = (sorted(map(tuple, identified(d).collect()), key=str) for d in (docs, other))
    assert a == b


def test_odd_documents(spark, odd_documents, no_documents, monkeypatch):
    from tercet.llm import languages
    from tercet.llm.languages import identified

    more = [(None, "nameless words here", "en", "s", 1, 1), (None, "ohne namen", None, "s", 1, 1), (40, "123 456", "en", "s", 1, 1), (41, "words", "", "s", 1, 1)]
    docs = odd_documents.unionByName(spark.createDataFrame(more, COLUMNS))
    for bound in (2_000_000, 50):
        monkeypatch.setattr(languages, "MODEL_GRAMS", bound)
        got = identified(docs).collect()
        assert len(got) == docs.count()
        for r in got:
            assert r.score is not None and 0 <= r.score <= 1
            if r.doc_id in (1, 2, 10, 40):
                assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            else:
                assert r.lang_pred in {"en", "de", "fr", ""}
    assert identified(no_documents).count() == 0
    nameless = docs.withColumn("lang", docs.lang.substr(1, 0)).where("false").unionByName(spark.createDataFrame([(1, "some text", None, None, None, 1)], COLUMNS))
    assert [(r.lang_pred, r.score) for r in identified(nameless).collect()] == [("und", 0.0)]


def test_more_grams_than_a_broadcast_holds(spark, monkeypatch):
    """Beyond MODEL_GRAMS no gram is left to lower orders: tables and joins give what broadcast models give (F9)."""
    from tercet.llm import languages

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "12 !", "de"), (-3, "\u0416\u0416 \U00010410 zq" * 9, None), (None, "the cat", None), (-3, "the cat", None)], "doc_id long, text string, lang string")
    docs = docs.unionByName(odd)
    order = ["doc_id", "lang_pred", "bits"]
    whole = languages.identified(docs).toPandas().sort_values(order).reset_index(drop=True)
    for bound in (300, 0):
        monkeypatch.setattr(languages, "MODEL_GRAMS", bound)
        tables = languages.identified(docs).toPandas().sort_values(order).reset_index(drop=True)
        assert tables[["held_out", "lang_pred", "rejected"]].equals(whole[["held_out", "lang_pred", "rejected"]])
        assert tables["doc_id"].equals(whole["doc_id"])
        np.testing.assert_allclose(tables["bits"], whole["bits"], rtol=1e-6)
        np.testing.assert_allclose(tables["score"], whole["score"], rtol=1e-4, atol=1e-9)
