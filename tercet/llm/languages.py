"""Language identification by Kneser-Ney letter models (see ``charmodel``).

One pass over the labelled training documents counts the four-letter grams of each language, in each of
two halves of the documents, inside tasks; the sums over all of them are one table, of which no gram is
left out. Up to MODEL_GRAMS of them (over all languages) the models are broadcast. Beyond that the models
stay tables (see ``gramtables``): the most frequent grams' probabilities are broadcast, and documents meet
all others by joins, with the same results. A prediction is
the language of lowest cross-entropy a symbol. Its score is a softmax of the entropies whose sharpness
is calibrated out of fold: about CALIBRATION_ROWS labelled training documents, chosen by a hash, are
scored by models of the half that they are not in. The same rows give the score below which a
prediction counts as rejected: above it at most RISK of them are wrong. A rejected document keeps its
best guess beside the flag.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and rejected; a null doc_id
is hashed as an empty string; documents without a lang teach nothing and are predicted; an empty lang is
a language like others; repeated rows teach and are predicted each; very long texts are read whole; without
any labelled document all are ``und``; ties go to the first language by name; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tercet.llm.charmodel import Languages, grams
from tercet.llm.gramtables import Tables, entropies
from tercet.llm.common import release_memory, small_batches, table, written
from tercet.llm.textkernel import blocks

FOLDS, HELD_OUT = 4, 2
#: Grams of models that are broadcast, and of the frequent ones that are where models are tables.
MODEL_GRAMS = 2_000_000
CALIBRATION_ROWS, RISK = 10_000, 0.01
#: Grams that a task holds before it hands them on.
HELD_GRAMS = 2_000_000
UNKNOWN = "und"

_GRAMS = "lang string, half int, gram long, n long"
RESULT = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean, bits double"


def fold(doc_id: int | None) -> int:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode())


def _hash() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))


def labelled(docs: DataFrame) -> DataFrame:
    """The training documents: doc_id, text, lang, half."""
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    own = held.filter((F.pmod(_hash(), F.lit(FOLDS)) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return own.withColumn("half", F.pmod(F.floor(_hash() / FOLDS), F.lit(2)).cast("int"))


class _Counts:
    """Counts of grams by language and half, merged now and then."""

    def __init__(self):
        self.held: dict[tuple[str, int], list] = {}
        self.pending = 0

    def add(self, group: tuple[str, int], keys: np.ndarray) -> None:
        self.held.setdefault(group, []).append(np.unique(keys, return_counts=True))
        self.pending += len(self.held[group][-1][0])

    def merge(self) -> None:
        for group, parts in self.held.items():
            keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            distinct, which = np.unique(keys, return_inverse=True)
            self.held[group] = [(distinct, np.bincount(which, weights=counts).astype(np.int64))]
        self.pending = sum(len(p[0][0]) for p in self.held.values())

    def rows(self):
        self.merge()
        for (lang, half), ((keys, counts),) in self.held.items():
            for at in range(0, len(keys), 200_000):
                k = keys[at : at + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(k), np.int32))), pa.array(np.full(len(k), half, np.int32)), pa.array(k.view(np.int64)), pa.array(counts[at : at + 200_000])], names=["lang", "half", "gram", "n"])
        self.held, self.pending = {}, 0


def counted(docs: DataFrame) -> DataFrame:
    """How often each language's training documents of each half hold each gram: a written table."""

    def count(batches):
        seen = _Counts()
        for batch in batches:
            groups = list(zip(batch.column("lang").to_pylist(), batch.column("half").to_pylist(), strict=True))
            for low, high, data, off in blocks(batch.column("text")):
                keys, per_doc = grams(data, off)
                own = groups[low:high]
                names = sorted(set(own))
                which = np.repeat(np.array([names.index(g) for g in own]), per_doc)
                for k, group in enumerate(names):
                    seen.add(group, keys[which == k])
                if seen.pending > HELD_GRAMS:
                    seen.merge()
                    if seen.pending > HELD_GRAMS // 2:
                        yield from seen.rows()
        yield from seen.rows()
        release_memory()

    found = labelled(docs).select("text", "lang", "half").mapInArrow(count, _GRAMS)
    return written(found.groupBy("lang", "half", "gram").agg(F.sum("n").alias("n")), "grams")


def _fitted(rows: DataFrame) -> Languages:
    """Models of ``rows(lang, gram, n)``, MODEL_GRAMS of them at most."""
    got = rows.select("lang", "gram", "n").toArrow()
    langs = got.column("lang").combine_chunks().dictionary_encode()
    which, keys, counts = langs.indices.to_numpy(), got.column("gram").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.lexsort((keys, which))
    which, keys, counts = which[order], keys[order], counts[order]
    edges = np.searchsorted(which, np.arange(len(langs.dictionary) + 1))
    return Languages({name: (keys[a:b], counts[a:b]) for name, a, b in zip(langs.dictionary.to_pylist(), edges[:-1], edges[1:], strict=True)})


class Calibration:
    """Scores from entropies: softmax of minus sharpness * symbols^power * entropy, and the least accepted score."""

    def __init__(self, sharpness: float = 1.0, power: float = 1.0, least: float = 0.0):
        self.sharpness, self.power, self.least = sharpness, power, least

    def scores(self, bits: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        over = (bits - bits.min(axis=1, keepdims=True)) * (self.sharpness * symbols[:, None] ** self.power)
        return 1 / np.exp(-np.minimum(over, 700)).sum(axis=1)

    @classmethod
    def fitted(cls, bits: np.ndarray, symbols: np.ndarray, truth: np.ndarray) -> Calibration:
        """The sharpness and power of least log loss, and the least score that keeps the share of wrong ones within RISK."""
        best, found = np.inf, cls()
        own = bits[np.arange(len(bits)), truth]
        for power in (0.0, 0.5, 1.0):
            for sharpness in 2.0 ** np.arange(-6, 8, 0.5):
                tool = cls(float(sharpness), power)
                over = (own - bits.min(axis=1)) * (sharpness * symbols**power)
                loss = float((over - np.log(tool.scores(bits, symbols))).mean())
                if loss < best - 1e-12:
                    best, found = loss, tool
        score, right = found.scores(bits, symbols), bits.argmin(axis=1) == truth
        order = np.argsort(-score, kind="stable")
        share = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(share <= RISK)
        found.least = float(score[order][good[-1]]) if len(good) else 1.0
        return found


def _calibrating(docs: DataFrame) -> DataFrame:
    own = labelled(docs)
    share = min(1.0, CALIBRATION_ROWS / max(1, own.count()))
    return own.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30)))


def calibrated(docs: DataFrame, halves: tuple[Languages, Languages], names: list[str]) -> Calibration:
    """From training documents, each scored by the models of the other half."""
    chosen = _calibrating(docs)
    shared = docs.sparkSession.sparkContext.broadcast(halves)

    def score(batches):
        models = shared.value
        for batch in batches:
            lang, half = batch.column("lang").to_pylist(), batch.column("half").to_numpy()
            for low, high, data, off in blocks(batch.column("text")):
                keys, per_doc = grams(data, off)
                both = [m.entropies(keys, per_doc) for m in models]
                rows = [(lang[low + i], float(n), both[1 - half[low + i]][i].tolist()) for i, n in enumerate(per_doc.tolist()) if n]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.float64(), pa.list_(pa.float64())))], names=["lang", "symbols", "bits"])
        release_memory()

    got = chosen.select("text", "lang", "half").mapInArrow(score, "lang string, symbols double, bits array<double>").filter(F.col("lang").isin(names)).toArrow()  # about CALIBRATION_ROWS
    return _scale(got, names)


def _scale(got: pa.Table, names: list[str]) -> Calibration:
    """From ``lang``, ``symbols`` and ``bits`` of documents."""
    if not got.num_rows:
        return Calibration()
    bits = np.array(got.column("bits").to_pylist()).reshape(got.num_rows, len(names))
    place = {k: i for i, k in enumerate(names)}
    return Calibration.fitted(bits, got.column("symbols").to_numpy(), np.array([place[k] for k in got.column("lang").to_pylist()]))


def fitted(found: DataFrame, docs: DataFrame) -> tuple[Languages, Calibration]:
    """The models of all training documents, by their counts, and how to score by them."""
    whole = _fitted(_of_all(found))
    halves = tuple(_fitted(found.filter(F.col("half") == k)) for k in (0, 1))
    if halves[0].names != whole.names or halves[1].names != whole.names:  # a language of one half alone can't be scored by the other
        return whole, Calibration()
    return whole, calibrated(docs, halves, whole.names)


def _of_all(found: DataFrame) -> DataFrame:
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fitted_tables(found: DataFrame, docs: DataFrame) -> tuple[Tables, Calibration]:
    """As :func:`fitted`, the models left as tables."""
    whole = Tables(_of_all(found))
    halves = [Tables(found.filter(F.col("half") == k)) for k in (0, 1)]
    if any(m.names != whole.names for m in halves):
        return whole, Calibration()
    chosen = _calibrating(docs)
    got = [entropies(chosen.filter(F.col("half") == 1 - k).select("text", "lang"), m).filter("symbols > 0").select("lang", F.col("symbols").cast("double").alias("symbols"), "bits").toArrow() for k, m in enumerate(halves)]
    return whole, _scale(pa.concat_tables(got), whole.names)


def _decided(ids: list, bits: np.ndarray, symbols: np.ndarray, names: list[str], scale: Calibration) -> pa.RecordBatch:
    """Result rows from each document's bits a symbol under each language."""
    n, labels = len(bits), np.array([*names, UNKNOWN], object)
    known = (symbols > 0) & bool(names)
    which, score, least = np.full(n, len(names)), np.zeros(n), np.full(n, np.nan)
    if known.any():
        which[known] = bits[known].argmin(axis=1)
        score[known] = scale.scores(bits[known], symbols[known].astype(np.float64))
        least[known] = bits[known].min(axis=1)
    out = [ids, [fold(i) % FOLDS == HELD_OUT for i in ids], labels[which].tolist(), score, ~known | (score < scale.least)]
    return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.bool_(), pa.string(), pa.float64(), pa.bool_()), strict=True)), pa.array(least, mask=~known)], names=["doc_id", "held_out", "lang_pred", "score", "rejected", "bits"])


def predicted(docs: DataFrame, model: Languages, scale: Calibration) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score, rejected and the bits a symbol."""
    shared = docs.sparkSession.sparkContext.broadcast((model, scale))

    def predict(batches):
        model, scale = shared.value
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for low, high, data, off in blocks(batch.column("text")):
                found = grams(data, off)
                yield _decided(ids[low:high], model.entropies(*found), found[1], model.names, scale)
        release_memory()

    return _texts(docs).mapInArrow(predict, RESULT)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def predicted_by_tables(docs: DataFrame, model: Tables, scale: Calibration) -> DataFrame:
    """As :func:`predicted`, by models that are tables."""
    names, shared = model.names, docs.sparkSession.sparkContext.broadcast(scale)

    def decide(batches):
        for batch in batches:
            bits = np.array([b if b is not None else [np.nan] * len(names) for b in batch.column("bits").to_pylist()], np.float64).reshape(batch.num_rows, len(names))
            yield _decided(batch.column("doc_id").to_pylist(), bits, batch.column("symbols").to_numpy(), names, shared.value)

    return entropies(_texts(docs), model, MODEL_GRAMS).select("doc_id", "symbols", "bits").mapInArrow(decide, RESULT)


def identified(docs: DataFrame) -> DataFrame:
    """Fit on the labelled documents outside the held-out fold, then predict all."""
    small_batches(docs.sparkSession)
    found = counted(docs)
    if _of_all(found).count() > MODEL_GRAMS:
        return predicted_by_tables(docs, *fitted_tables(found, docs))
    return predicted(docs, *fitted(found, docs))


def op13_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(table(spark, sf_dir, "documents"))
