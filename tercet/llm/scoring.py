"""Language-model scoring of whole documents by a causal self-attention model, beside a unigram base.

Words are runs of bytes outside white space, A-Z lower-cased. Three passes read the texts. The first
sums the bigrams of subword ids over all training documents, which are the model's offsets (see
``attention``). The attention weights start from gradient steps on windows of SAMPLE_DOCS training
documents chosen by a hash (a bounded start, made by one task). In the second pass they learn from every
window of every training document, in a seeded order inside each block of texts: each task steps through its share from the same start, and the tasks' weights are averaged by their
windows. Steps grow with the input; only sums by weight reach the driver.

The third pass scores every token of every document once and takes the documents in lots of about
LOT_BYTES: each lot writes its distinct words with their training counts and its documents as places
in that list, beside their scores. Counts are summed over all lots, joined back to every lot's own
words, and meet the lot's documents again, so that no table of all words is ever broadcast, and a
document's two scores never part.

Defined cases: null or empty text has the end token alone; a null doc_id is hashed as an empty
string; repeated rows, and rows that share a doc_id but not a text, are scored (and counted) each;
very long texts are scored whole; without training documents all counts are zero and the weights
stay at their start; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import copy
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tercet.llm.attention import BEGIN, END, SPAN, STEP, SUBWORDS, VOCAB, Model, windows
from tercet.llm.common import new_path, release_memory, small_batches, table, written
from tercet.llm.textkernel import Words, blocks

LOT_BYTES = 24 << 20
SAMPLE_DOCS, TRAIN_STEPS = 1000, 1200
#: Windows of the sample that its task keeps, at random, at most (the start alone; nothing else is bounded).
SAMPLE_WINDOWS = 100_000
#: One window in so many of each training document gives gradients: all of them do.
WINDOW_SHARE = 1
#: Windows of a step in the whole pass, and the unit in which weights are summed (whole numbers, in any order).
STEP_WINDOWS, UNIT = 192, 1 << 20
FOLDS, HELD_OUT = 7, 2
REMEMBERED = 1_200_000

LOTS = "kind int, lot string, doc_id long, held_out boolean, n_tokens long, score double, places binary, key long, seen long"
_NAMES = [x.split()[0] for x in LOTS.split(", ")]
_TYPES = [pa.int32(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.float64(), pa.binary(), pa.int64(), pa.int64()]
DOCUMENT, WORD = 0, 1


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class WordPieces:
    """Subword ids of words (each after a space), by the first ranks of a public byte-level vocabulary."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        ranks = {k: v for k, v in ranks.items() if v < SUBWORDS}
        self.encode = tiktoken.Encoding("subwords", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.length = np.zeros(SUBWORDS, np.int64)
        for k, v in ranks.items():
            self.length[v] = len(k)
        self.clear()

    def clear(self) -> None:
        self.keys, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint16), 0

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        plain = np.array([0x20 < w[-1] < 0x7F or w[-2:-1] == b"\xc3" for w in words])
        joined = [b" " + w for w, j in zip(words, plain, strict=True) if j]
        ids = [np.array(self.encode(b"".join(joined).decode("utf-8")), np.int64)]
        reached = np.concatenate(([0], np.cumsum(self.length[ids[0]])))
        upto = np.searchsorted(reached, np.cumsum([len(w) for w in joined]), "left")
        sizes = [np.diff(upto, prepend=0)]
        for w, j in zip(words, plain, strict=True):
            if not j:
                ids.append(np.array(self.encode((b" " + w).decode("utf-8", "replace")), np.int64))
                sizes.append(np.array([len(ids[-1])]))
        keys, size, new = np.concatenate((keys[plain], keys[~plain])), np.concatenate(sizes).astype(np.int64), np.concatenate(ids)
        begin = np.cumsum(size) - size
        order = np.argsort(keys)
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.used : self.used + len(new)] = new
        at = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, at, keys[order])
        self.begin = np.insert(self.begin, at, (begin[order] + self.used).astype(np.int32))
        self.size = np.insert(self.size, at, size[order].astype(np.int32))
        self.used += len(new)

    def pieces(self, words: Words, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a block, each closed by END, and where each begins."""
        distinct, first, which = np.unique(words.hash, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > REMEMBERED and len(self.keys):
            self.clear()
        at = np.searchsorted(self.keys, distinct)
        unknown = np.ones(len(distinct), bool)
        inside = at < len(self.keys)
        unknown[inside] = self.keys[at[inside]] != distinct[inside]
        if unknown.any():
            raw, starts = data.tobytes(), words.starts[first[unknown]]
            limit = np.flatnonzero(words.space)
            stops = np.searchsorted(limit, starts)
            ends = np.where(stops < len(limit), limit[np.minimum(stops, len(limit) - 1)] if len(limit) else len(data), len(data))
            following = np.append(words.starts[1:], len(data))[first[unknown]]
            ends = np.minimum(ends, following)
            self._learn(distinct[unknown], [raw[a:b].lower() if raw[a:b].isascii() else _lowered(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
            at = np.searchsorted(self.keys, distinct)
        slots = at[which]
        sizes, begins = self.size[slots].astype(np.int64), self.begin[slots].astype(np.int64)
        per_doc = np.bincount(words.doc, weights=sizes, minlength=words.n_docs).astype(np.int64)
        place = np.concatenate(([0], np.cumsum(per_doc + 1)))
        total = np.cumsum(sizes)
        source = np.repeat(begins - (total - sizes), sizes) + np.arange(int(total[-1]) if len(total) else 0)
        out = np.full(int(place[-1]), END, np.int32)
        body = np.ones(len(out), bool)
        body[place[1:] - 1] = False
        out[body] = self.flat[source]
        return out, place


def _lowered(word: bytes) -> bytes:
    return bytes(b + 32 if 65 <= b <= 90 else b for b in word)


_PIECES: dict[str, WordPieces] = {}


def word_pieces(path: str) -> WordPieces:
    if path not in _PIECES:
        _PIECES[path] = WordPieces(path)
    return _PIECES[path]


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % FOLDS == HELD_OUT


class _Lot:
    def __init__(self, name: str):
        self.name, self.bytes = name, 0
        self.docs: list[tuple] = []
        self.hashes: list[np.ndarray] = []

    def rows(self):
        """The lot as record batches: its documents and its words."""
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        every = np.concatenate(self.hashes) if self.hashes else np.zeros(0, np.uint64)
        distinct, places = np.unique(every, return_inverse=True)
        train = np.concatenate([np.full(d[2] - 1, not d[1]) for d in self.docs]) if self.docs else np.zeros(0, bool)
        seen = np.bincount(places[train], minlength=len(distinct))
        ends = np.cumsum([d[2] - 1 for d in self.docs])
        packed = [squeeze(places[e - d[2] + 1 : e].astype("<u4").tobytes()) for d, e in zip(self.docs, ends, strict=True)]
        yield self._batch(DOCUMENT, len(self.docs), [*([d[i] for d in self.docs] for i in range(4)), packed, None, None])
        for at in range(0, len(distinct), 200_000):
            part = slice(at, at + 200_000)
            yield self._batch(WORD, len(distinct[part]), [None, None, None, None, None, distinct[part].view(np.int64), seen[part]])

    def _batch(self, kind: int, n: int, columns: list):
        filled = [pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in zip(columns, _TYPES[2:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array([self.name] * n, pa.string()), *filled], names=_NAMES)


def read_through(docs: DataFrame, ranks: str) -> tuple[np.ndarray, DataFrame]:
    """First pass over the training documents: how often each subword id follows each (VOCAB^2 sums at most);
    and those documents, all of which then teach."""
    learned = _learned(docs)

    def read(batches):
        tool, seen = word_pieces(ranks), np.zeros(VOCAB * VOCAB, np.int64)
        for batch in batches:
            for _, _, data, off in blocks(batch.column("text")):
                ids, place = tool.pieces(Words(data, off, lower=True), data)
                prev = np.concatenate(([BEGIN], ids[:-1]))
                prev[place[:-1]] = BEGIN
                seen += np.bincount(prev.astype(np.int64) * VOCAB + ids, minlength=VOCAB * VOCAB)
        met = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(seen[met])], names=["key", "seen"])
        release_memory()

    met = learned.mapInArrow(read, "key long, seen long").groupBy("key").agg(F.sum("seen").alias("seen")).toArrow()
    out = np.zeros(VOCAB * VOCAB)
    out[met.column("key").to_numpy()] = met.column("seen").to_numpy()
    return out.reshape(VOCAB, VOCAB), learned


def lots(docs: DataFrame, model: Model, ranks: str) -> dict[int, DataFrame]:
    """Second pass: scores of all documents, and the documents and words of every lot, as two tables."""
    spark = docs.sparkSession
    held_model = spark.sparkContext.broadcast(model)

    def gather(batches):
        from pyspark import TaskContext

        tool, lm, pid, number = word_pieces(ranks), held_model.value, TaskContext.get().partitionId(), 0
        lot = _Lot(f"{pid}-{number}")
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for low, high, data, off in blocks(batch.column("text")):
                words = Words(data, off, lower=True)
                scores = lm.score(*tool.pieces(words, data))
                lot.hashes.append(words.hash)
                lot.docs += [(k, is_held_out(k), int(n) + 1, float(s)) for k, n, s in zip(keys[low:high], words.per_doc, scores, strict=True)]
                lot.bytes += len(data)
                if lot.bytes >= LOT_BYTES:
                    yield from lot.rows()
                    number += 1
                    lot = _Lot(f"{pid}-{number}")
        if lot.docs:
            yield from lot.rows()
        release_memory()

    path = new_path(spark, "lots")
    docs.mapInArrow(gather, LOTS).write.partitionBy("kind").parquet(path)
    whole = spark.read.schema(LOTS).parquet(path)
    return {kind: whole.filter(F.col("kind") == kind) for kind in (DOCUMENT, WORD)}


def _base_of_lot(key, docs: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
    import zstandard

    unsqueeze = zstandard.ZstdDecompressor().decompress
    order = np.argsort(words["key"].to_numpy().view(np.uint64))
    log, count = words["log"].to_numpy()[order], words["count"].to_numpy()[order]
    base, known = [], []
    for packed in docs["places"]:
        places = np.frombuffer(unsqueeze(packed), "<u4") if len(packed) else np.zeros(0, "<u4")
        base.append(float(log[places].sum()))
        known.append(int((count[places] > 0).sum()))
    return pd.DataFrame({"doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": docs["n_tokens"], "n_known": known, "base": base, "score": docs["score"]})


def with_base(found: dict[int, DataFrame]) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (by add-one counts of training tokens) and score."""
    counts = written(found[WORD].groupBy("key").agg(F.sum("seen").alias("count")), "counts")
    summed = counts.filter("count > 0").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_train = found[DOCUMENT].filter("not held_out").count()
    total, kinds = summed.n + n_train, summed.v + (1 if n_train else 0)
    chance = F.log10((F.col("count") + 1) / F.lit(float(total + kinds + 1)))
    end = float(np.log10((n_train + 1) / (total + kinds + 1)))
    back = found[WORD].select("lot", "key").join(counts, "key").select(F.col("lot").alias("of_lot"), F.col("key").alias("key"), F.col("count").alias("count"), chance.alias("log"))
    docs = found[DOCUMENT].select("lot", "doc_id", "held_out", "n_tokens", "score", "places")
    each = docs.groupBy("lot").cogroup(back.groupBy("of_lot")).applyInPandas(_base_of_lot, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    return each.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.lit(1 if n_train else 0)).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.lit(end)).alias("base_score"),
        "score",
    )


def _learned(docs: DataFrame) -> DataFrame:
    """The training documents: all whose fold is not the held-out one."""
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(FOLDS))
    return docs.filter(fold != HELD_OUT).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _dice(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng((5, seed)).random(n)


def started(docs: DataFrame, model: Model, ranks: str) -> Model:
    """Gradient steps on windows of a bounded sample of the training documents, made by one task; the moments stay with the model."""
    near = min(1.0, 4 * (SAMPLE_DOCS + 10) / max(1, docs.count()))  # so that no task hands on more than it must
    ranked = _learned(docs).withColumn("order", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))).filter(F.col("order") <= int(near * (1 << 30)))
    sample = ranked.orderBy("order", "doc_id").limit(SAMPLE_DOCS).select("text").coalesce(1)
    held, steps, most = docs.sparkSession.sparkContext.broadcast(model), TRAIN_STEPS, SAMPLE_WINDOWS

    def learn(batches):
        tool, lm = word_pieces(ranks), copy.copy(held.value)
        lm.p = {k: v.copy() for k, v in lm.p.items()}
        keep, rank = [], []
        for batch in batches:
            for _, _, data, off in blocks(batch.column("text")):
                i, t, _ = windows(*tool.pieces(Words(data, off, lower=True), data))
                keep.append(np.concatenate((i, t), axis=1))
                rank.append(_dice(len(rank), len(i)))
                if sum(map(len, rank)) > 2 * most:
                    rank, keep = [np.concatenate(rank)], [np.concatenate(keep)]
                    first = np.argpartition(rank[0], most)[:most]
                    rank, keep = [rank[0][first]], [keep[0][first]]
        both = np.concatenate(keep) if keep else np.zeros((0, SPAN + STEP), np.int32)
        if len(both):
            lm.train(both[:, :SPAN], both[:, SPAN:], steps=steps)
            flat = np.concatenate([group[k].ravel() for group in (lm.p, *lm.moments) for k in lm.p])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat.astype(np.float64))], names=["slot", "value"])
        release_memory()

    got = sample.mapInArrow(learn, "slot long, value double").toArrow()
    if got.num_rows:
        flat, at = got.sort_by("slot").column("value").to_numpy().astype(np.float32), 0
        groups = []
        for _ in range(3):
            groups.append({})
            for k, v in model.p.items():
                groups[-1][k] = flat[at : at + v.size].reshape(v.shape)
                at += v.size
        model.p, model.moments = groups[0], (groups[1], groups[2])
    model._ready = None
    return model


def fitted(docs: DataFrame, ranks: str) -> Model:
    """The model: offsets and attention from all training documents."""
    counts, learned = read_through(docs, ranks)
    model = started(docs, Model(counts), ranks)
    learn_from_all(learned, model, ranks)
    model.ready()
    return model


def learn_from_all(learned: DataFrame, model: Model, ranks: str) -> int:
    """Gradient steps over the windows of all ``learned`` texts; sets the model's weights to the tasks' average and returns how many windows taught."""
    held, share = learned.sparkSession.sparkContext.broadcast(model), WINDOW_SHARE

    def learn(batches):
        tool, lm, seen, waiting = word_pieces(ranks), copy.copy(held.value), 0, np.zeros((0, SPAN + STEP), np.int32)
        if hasattr(lm, "moments"):
            lm.p, lm.moments = dict(lm.p), tuple({k: v.copy() for k, v in m.items()} for m in lm.moments)
        for number, batch in enumerate(batches):
            for low, _, data, off in blocks(batch.column("text")):
                i, t, doc = windows(*tool.pieces(Words(data, off, lower=True), data))
                dice = np.random.default_rng((5, number, low)).random(len(i))
                order = np.argsort(dice)
                if share > 1:
                    chosen = dice < 1 / share
                    by_doc = np.lexsort((dice, doc))
                    chosen[by_doc[np.r_[True, np.diff(doc[by_doc]) != 0]]] = True  # every document has one at least
                    order = order[chosen[order]]
                seen += len(order)
                waiting = np.concatenate((waiting, np.concatenate((i, t), axis=1)[order]))
                whole = len(waiting) - len(waiting) % STEP_WINDOWS
                for at in range(0, whole, STEP_WINDOWS):
                    part = waiting[at : at + STEP_WINDOWS]
                    lm.follow(part[:, :SPAN], part[:, SPAN:])
                waiting = waiting[whole:].copy()
        if seen:
            if len(waiting):
                lm.follow(waiting[:, :SPAN], waiting[:, SPAN:])
            weights = np.concatenate([lm.p[k].ravel() for k in lm.p]).astype(np.float64)
            sums = np.concatenate(([seen], np.rint(weights * UNIT).astype(np.int64) * seen))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)) - 1), pa.array(sums)], names=["slot", "total"])
        release_memory()

    tasks = learned.select("text").mapInArrow(learn, "slot long, total long")
    summed = tasks.groupBy("slot").agg(F.sum("total").alias("total")).toArrow().sort_by("slot").column("total").to_numpy()  # one row a weight
    if not len(summed):
        return 0
    weights, at = summed[1:] / float(UNIT) / float(summed[0]), 0
    for k, v in model.p.items():
        model.p[k] = weights[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size
    model._ready = None
    return int(summed[0])


def scored_documents(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """One row per document with its base and model scores."""
    small_batches(docs.sparkSession)
    ranks = ranks or default_ranks()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_base(lots(docs, fitted(docs, ranks), ranks))


def op10_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_documents(table(spark, sf_dir, "documents"))
