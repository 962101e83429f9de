"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Every rule looks at counts of the whole text and votes good (1), bad (-1) or abstains (0). The
pattern of votes is counted over all documents in Spark; there are at most 3^rules patterns, so
expectation-maximisation of each rule's vote probabilities given the hidden class runs on the
counted patterns. A document is kept if its posterior probability of quality reaches a threshold.

Defined cases: null or empty text has no words and fails the base rule; ties and repeated rows get
equal verdicts; an empty table gives an empty result; other columns are ignored. A rule that always
abstains has no effect.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tercet.llm.common import release_memory, small_batches, table, written
from tercet.llm.textkernel import Words, blocks, mix, segment_hash

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
THRESHOLD = 0.5

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long, n_marks long"

#: The symbols that count.
SYMBOLS = "#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[0xC3:] = True


def _by_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[off[1:]] - total[off[:-1]]


def block_counts(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The columns of COUNTS for the documents of one block."""
    n_docs = len(off) - 1
    words = Words(data, off)
    in_word = ~words.space
    values, at = words.windows(3)
    repeated = np.zeros(len(words.hash), bool)
    if len(values):
        keys = (words.doc[at].astype(np.uint64) << np.uint64(52)) | (values >> np.uint64(12))
        order = np.argsort(keys)
        keys = keys[order]
        same = keys[1:] == keys[:-1]
        twice = np.zeros(len(keys), bool)
        twice[1:] |= same
        twice[:-1] |= same
        found = at[order[twice]]
        for j in range(3):
            repeated[found + j] = True
    n_repeat = np.bincount(words.doc, weights=repeated, minlength=n_docs).astype(np.int64)
    lines = np.zeros(n_docs, np.int64)
    dup_lines = np.zeros(n_docs, np.int64)
    if len(data):
        begin = np.zeros(len(data), bool)
        begin[1:] = data[:-1] == 10
        begin[off[:-1][off[:-1] < len(data)]] = True
        starts = np.flatnonzero(begin)
        held = np.add.reduceat(in_word.astype(np.int64), starts) > 0
        plain = data.astype(np.uint64) + np.uint64(1)
        plain[data == 10] = 0
        hashes = mix(segment_hash(plain, starts))[held]
        doc = (np.searchsorted(off, starts, "right") - 1)[held]
        keys = np.sort((doc.astype(np.uint64) << np.uint64(52)) | (hashes >> np.uint64(12)))
        lines = np.bincount(doc, minlength=n_docs)
        again = keys[1:][keys[1:] == keys[:-1]]
        dup_lines = np.bincount((again >> np.uint64(52)).astype(np.int64), minlength=n_docs)
    return [
        words.per_doc,
        _by_doc(in_word & ((data & 0xC0) != 0x80), off),
        _by_doc(_SYMBOL[data], off),
        dup_lines,
        n_repeat,
        lines,
        _by_doc(_UPPER[data], off),
        _by_doc(_LETTER[data], off),
        _by_doc(data == ord("!"), off),
    ]


def text_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the counts of COUNTS for every document."""
    small_batches(docs.sparkSession)
    shape = docs.select(*keep).schema if keep else []
    names = [part.split()[0] for part in COUNTS.split(", ")]
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in shape] + [COUNTS])

    def count(batches):
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            parts = [block_counts(data, off) for _, _, data, off in blocks(column)]
            counted = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(c.astype(np.int64)) for c in counted]], names=[*keep, *names])
        release_memory()

    return docs.select(*keep, F.col("text").cast("string").alias("__text")).mapInArrow(count, out)


def rules() -> dict[str, Column]:
    """Votes by rule: 1 good, -1 bad, 0 abstains. Detectors of one fault only ever vote bad."""

    def vote(bad: Column, good: Column | None = None) -> Column:
        out = F.when(bad, -1)
        return (out.when(good, 1) if good is not None else out).otherwise(0)

    words = F.greatest(F.col("n_words"), F.lit(1))
    letters = F.greatest(F.col("n_letters"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    mean = F.col("word_chars") / words
    return {
        "symbols": vote(F.col("n_symbols") / words > 0.2),
        "symbol_share": vote(F.col("n_symbols") / chars > 0.04),
        "dup_lines": vote(F.col("n_dup_lines") * 5 > F.col("n_lines") * 2),
        "repeats": vote(F.col("n_repeat_words") / words > 0.35),
        "capitals": vote(F.col("n_upper") / letters > 0.5),
        "marks": vote(F.col("n_marks") / words > 0.3),
        "letters": vote(F.col("n_letters") / chars < 0.75, F.col("n_letters") / chars > 0.9),
        "word_length": vote((mean < 2.2) | (mean > 15), mean.between(3.5, 8)),
        "length": vote(F.col("n_words") < 25, F.col("n_words") >= MIN_WORDS),
    }


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """Expectation-maximisation over counted vote patterns (values -1, 0, 1).

    Returns the log prior odds of quality and, by rule and vote, log P(vote|good) - log P(vote|bad).
    Starts from any vote against, and smooths so that a vote never seen in a class stays possible.
    In the end a vote may not speak against its own direction: its log ratio is clipped to its sign.
    """
    n_rules = patterns.shape[1]
    against, balance = (patterns == -1).sum(axis=1), patterns.sum(axis=1)
    good = np.where(against > 0, 0.3 / (1 + against), np.where(balance > 0, 0.95, 0.6))
    weights = np.zeros((n_rules, 3))
    prior = 0.0
    for _ in range(rounds):
        a, b = counts * good, counts * (1 - good)
        prior = math.log((a.sum() + 1) / (b.sum() + 1))
        new = np.zeros_like(weights)
        for k in range(n_rules):
            for v in (-1, 0, 1):
                here = patterns[:, k] == v
                p = (a[here].sum() + 1) / (a.sum() + 3)
                q = (b[here].sum() + 1) / (b.sum() + 3)
                new[k, v + 1] = math.log(p / q)
        odds = prior + sum(new[k, patterns[:, k] + 1] for k in range(n_rules))
        good = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        if np.abs(new - weights).max() < 1e-9:
            break
        weights = new
    weights[:, 0] = np.minimum(weights[:, 0], 0)
    weights[:, 2] = np.maximum(weights[:, 2], 0)
    return prior, weights


def voted(counts: DataFrame) -> DataFrame:
    return counts.withColumns({f"vote_{k}": v.cast("int") for k, v in rules().items()})


def fit(counts: DataFrame) -> tuple[float, np.ndarray]:
    """Prior and weights from a table with the columns of COUNTS; only counted patterns reach the driver."""
    names = [f"vote_{k}" for k in rules()]
    seen = voted(counts).groupBy(*names).count().collect()
    if not seen:
        return 0.0, np.zeros((len(names), 3))
    return fit_votes(np.array([[r[n] for n in names] for r in seen]), np.array([r["count"] for r in seen], float))


def judged(counts: DataFrame, model: tuple[float, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """Add posterior, base_failed and kept to a table with the columns of COUNTS."""
    prior, weights = model
    odds = F.lit(float(prior))
    for k, rule in enumerate(rules()):
        vote = F.col(f"vote_{rule}")
        odds = odds + F.when(vote == -1, float(weights[k, 0])).when(vote == 1, float(weights[k, 2])).otherwise(float(weights[k, 1]))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    with_odds = voted(counts).withColumn("posterior", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed)
    return with_odds.withColumn("kept", ~failed & (F.col("posterior") >= threshold))


def kept_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that pass, with their own columns: one pass to fit the rules, one to apply them."""
    model = fit(text_counts(docs, []))
    prefixed = docs.select(*[F.col(c).alias(f"doc__{c}") for c in docs.columns], "text")
    passed = judged(text_counts(prefixed, [f"doc__{c}" for c in docs.columns]), model, threshold).filter("kept")
    return passed.select(*[F.col(f"doc__{c}").alias(c) for c in docs.columns])


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = written(text_counts(table(spark, sf_dir, "documents"), ["doc_id"]), "quality")
    return judged(counts, fit(counts)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
