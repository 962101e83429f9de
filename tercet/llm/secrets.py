"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are long runs of key characters, values assigned to a secret's name, and private keys from
their first line to their last, each whole, whatever its length. A random forest trained from labelled findings scores each by its length, its character
transitions, how much of it a dictionary covers (the corpus' CORPUS_WORDS most frequent words and some
fixed fragments), whether it looks like a path, and the words around it. Labelled findings are a bounded table (TRAINING_ROWS) that Spark expressions make from
fixed forms of real and false findings. Everything runs in DataFrame functions and Spark's own
forest: no Python on the executors.

Places are exact: the text between the candidates is split off by the same pattern, so a
candidate's start is the length of what stands before it.

Defined cases: null or empty text has no findings; the same secret twice is two findings; repeated
rows are scanned each; an empty table gives an empty result; other columns are not carried; texts
are scanned whole whatever their length.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tercet.llm.common import table, written

TRAINING_ROWS = 6000
TREES, DEPTH, SEED = 24, 8, 5
THRESHOLD = 0.5
CONTEXT = 40
#: Texts with secrets that may be broadcast to redact them; beyond it they are shuffled.
MAX_FLAGGED = 200_000

NAMES = r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|credential)"
ASSIGN = NAMES + r"[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
KEY_LINES = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*+-----END [A-Z ]{0,30}PRIVATE KEY-----)?"
PATTERN = ASSIGN + r"[^\s\"',;<>]{8,}+|" + KEY_LINES + r"|[A-Za-z0-9+/_-]{20,}+"

#: Words of the dictionary that are taken from the texts' own counts, the most frequent first, and their letters.
CORPUS_WORDS, CORPUS_WORD = 300, "[a-z]{4,12}"
#: Words whose presence in a candidate speaks for ordinary text, beside the corpus' own.
DICTIONARY = [
    "the", "and", "ing", "ion", "ent", "for", "ver", "con", "pro", "est", "ation", "ment", "ness", "able", "over", "under", "inter",
    "example", "sample", "dummy", "test", "your", "changeme", "placeholder", "password", "secret", "token", "value", "name", "user",
    "path", "file", "home", "local", "share", "index", "config", "default", "version", "release", "image", "static", "assets", "data",
    "http", "https", "www", "com", "org", "html", "json", "sch", "ein", "ung", "lich", "keit", "eau", "elle", "que", "ado", "mente",
]
#: Neighbouring words for and against.
WORDS_FOR = ["token", "secret", "password", "passwd", "pwd", "key", "credential", "bearer", "auth", "private"]
WORDS_AGAINST = ["commit", "sha1", "sha256", "md5", "checksum", "digest", "hash", "uuid", "example", "sample", "version", "image", "path", "url", "href", "src"]

FEATURES = [f"f_{x}" for x in ("length", "transitions", "distinct", "digits", "uppers", "covered", "vowels", "slashes", "repeats", "words_for", "words_against", "assigned")]


def corpus_words(docs: DataFrame, most: int = CORPUS_WORDS) -> list[str]:
    """The ``most`` frequent words of all texts (a fixed number, whatever the corpus)."""
    each = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(CORPUS_WORD), F.lit(0))).alias("word"))
    return [r.word for r in each.groupBy("word").count().orderBy(F.col("count").desc(), "word").limit(most).collect()]


def features(found: DataFrame, dictionary: list[str]) -> DataFrame:
    """Feature columns of ``found(value, before, after, assigned)``; ``dictionary`` is what covers ordinary text."""
    v, low = F.col("value"), F.lower("value")
    n = F.greatest(F.length(v), F.lit(1)).cast("double")
    around = F.lower(F.concat_ws(" ", "before", "after"))
    words = "|".join(sorted({*DICTIONARY, *dictionary}, key=lambda w: (-len(w), w)))
    lookaround = "(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"

    def count(column: Column, pattern: str) -> Column:
        return F.regexp_count(column, F.lit(pattern)).cast("double")

    return found.withColumns({
        "f_length": n,
        "f_transitions": count(v, lookaround) / n,
        "f_distinct": F.size(F.array_distinct(F.split(v, ""))) / F.least(n, F.lit(40.0)),
        "f_digits": count(v, "[0-9]") / n,
        "f_uppers": count(v, "[A-Z]") / n,
        "f_covered": 1 - F.length(F.regexp_replace(low, words, "")) / n,
        "f_vowels": count(low, "[aeiou]") / n,
        "f_slashes": count(v, "[/_.-]") / n,
        "f_repeats": count(v, r"(.)\1\1") / n,
        "f_words_for": F.least(count(around, r"\b(?:" + "|".join(WORDS_FOR) + r")"), F.lit(2.0)),
        "f_words_against": F.least(count(around, r"\b(?:" + "|".join(WORDS_AGAINST) + r")"), F.lit(2.0)),
        "f_assigned": F.col("assigned").cast("double"),
    })


def labelled_findings(spark: SparkSession, rows: int = TRAINING_ROWS) -> DataFrame:
    """``rows`` findings with a label, made from fixed forms: (value, before, after, assigned, label)."""
    noise = F.concat(F.sha2(F.concat(F.lit("a"), "id"), 256), F.sha2(F.concat(F.lit("b"), "id"), 256))
    mixed = F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit("m"), "id"), 512))), "[=+]", "x")
    long = F.lit(20) + F.pmod(F.xxhash64("id", F.lit(3)), F.lit(44)).cast("int")
    short = F.lit(8) + F.pmod(F.xxhash64("id", F.lit(4)), F.lit(14)).cast("int")

    def pick(words: list[str], salt: int) -> Column:
        return F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(words))) + 1).cast("int"))

    syllables = ["th", "er", "an", "in", "on", "re", "ed", "he", "ou", "es", "tion", "ble", "ing", "sch", "ein", "ung", "eau", "elle", "que", "ado", "mente", "ción"]
    prose = F.concat(*[pick(syllables, 20 + i) for i in range(10)])
    path = F.concat_ws("/", *[pick(["home", "share", "local", "assets", "images", "static", "lib", "data", "v2", "docs"], 40 + i) for i in range(4)], F.substr(noise, F.lit(1), F.lit(6)))
    snake = F.concat_ws("_", *[pick(["max", "value", "index", "default", "config", "user", "name", "total", "count", "path"], 60 + i) for i in range(5)])
    filler = pick(["xxxxxxxxxxxxxxxxxxxxxxxx", "your_token_here_changeme", "EXAMPLEEXAMPLEEXAMPLE00", "aaaaaaaaaaaaaaaaaaaaaaaa", "----------------------", "00000000000000000000000000", "________________________", "replace-with-your-secret"], 80)
    uuid = F.concat_ws("-", *[F.substr(noise, F.lit(a), F.lit(b)) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    for_word, against = pick(WORDS_FOR, 90), pick(WORDS_AGAINST, 91)
    plain = pick(["of", "and then", "la de", "der die", "was", "see", "in"], 92)
    # (value, words before, assigned, label); each form makes the same number of rows
    forms = [
        (F.substr(noise, F.lit(1), long), F.concat(for_word, F.lit(" = ")), True, 1),
        (F.substr(mixed, F.lit(1), long), F.concat(for_word, F.lit(": ")), True, 1),
        (F.substr(noise, F.lit(1), F.lit(40)), plain, True, 1),
        (F.substr(mixed, F.lit(1), F.lit(36)), F.concat(for_word, F.lit(" ")), False, 1),
        (F.concat(pick(["AKIA", "ghp_", "sk-", "xoxb-"], 93), F.substr(mixed, F.lit(1), F.lit(32))), plain, False, 1),
        (F.substr(mixed, F.lit(1), short), plain, True, 1),
        (prose, plain, False, 0),
        (prose, F.concat(for_word, F.lit(" ")), True, 0),
        (path, F.concat(against, F.lit(" ")), False, 0),
        (snake, plain, False, 0),
        (snake, plain, True, 0),
        (filler, F.concat(for_word, F.lit(" = ")), True, 0),
        (filler, plain, False, 0),
        (uuid, F.concat(against, F.lit(" ")), False, 0),
        (F.substr(noise, F.lit(1), F.lit(40)), F.concat(against, F.lit(" ")), False, 0),
        (F.substr(noise, F.lit(1), F.lit(64)), F.concat(against, F.lit(": ")), False, 0),
    ]
    kind = F.pmod(F.col("id"), F.lit(len(forms)))

    def chosen(i: int) -> Column:
        out = F.lit(None)
        for k, form in enumerate(forms):
            out = F.when(kind == k, form[i] if isinstance(form[i], Column) else F.lit(form[i])).otherwise(out)
        return out

    return spark.range(rows).select(chosen(0).alias("value"), chosen(1).alias("before"), F.lit("").alias("after"), chosen(2).alias("assigned"), chosen(3).cast("double").alias("label"))


def train(findings: DataFrame, dictionary: list[str]) -> RandomForestClassificationModel:
    """A forest from labelled findings; the table is bounded by who makes it."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(findings, dictionary)).select("features", "label").coalesce(1)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(rows)


def candidates(docs: DataFrame, *keep: str) -> DataFrame:
    """All pattern matches of whole texts: keep..., start, length, value, before, after, assigned."""
    hits = docs.select(*keep, "text", F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("hits")).filter(F.size("hits") > 0)
    cut = hits.select(*keep, "hits", F.split("text", PATTERN, -1).alias("between"))
    starts = F.aggregate(
        F.arrays_zip(F.transform("hits", F.length).alias("h"), F.transform(F.slice("between", F.lit(1), F.size("hits")), F.length).alias("b")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda s, x: F.struct((s["at"] + x["b"] + x["h"]).alias("at"), F.array_append(s["starts"], s["at"] + x["b"]).alias("starts")),
    )["starts"]
    each = cut.withColumn("starts", starts).select(
        *keep,
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size("hits")),
                lambda i: F.struct(
                    F.element_at("starts", i).alias("at"),
                    F.element_at("hits", i).alias("hit"),
                    F.right(F.element_at("between", i), F.lit(CONTEXT)).alias("near"),
                    F.left(F.element_at("between", i + 1), F.lit(CONTEXT)).alias("after"),
                ),
            )
        ).alias("f"),
    )
    value = F.regexp_replace("f.hit", "^" + ASSIGN, "")
    return each.select(
        *keep,
        (F.col("f.at") + F.length("f.hit") - F.length(value)).cast("long").alias("start"),
        F.length(value).cast("long").alias("length"),
        value.alias("value"),
        F.concat("f.near", F.left("f.hit", F.length("f.hit") - F.length(value))).alias("before"),
        F.col("f.after").alias("after"),
        F.col("f.hit").rlike("^" + ASSIGN).alias("assigned"),
    )


def scanned(docs: DataFrame, *keep: str, threshold: float = THRESHOLD) -> DataFrame:
    """Scored findings of ``docs(text, keep...)``: start, length, value, score, is_secret."""
    words = corpus_words(docs)
    model = train(labelled_findings(docs.sparkSession), words)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(features(candidates(docs, *keep), words))
    scored = model.transform(rows).withColumn("forest", vector_to_array("probability")[1])
    certain = F.col("value").startswith("-----BEGIN")
    score = F.when(certain, F.lit(1.0)).otherwise(F.col("forest"))
    return scored.select(*keep, "start", "length", "value", F.round(score, 6).alias("score"), (score >= threshold).alias("is_secret"))


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """Documents with every secret's characters replaced; rows and other columns stay.

    Secrets are gathered by a hash of the text, so that equal texts are scanned as one.
    """
    keyed = docs.withColumn("__key", F.sha2(F.coalesce("text", F.lit("")), 256))
    flagged = written(scanned(keyed, "__key").filter("is_secret").groupBy("__key").agg(F.collect_set("value").alias("__found")), "flagged")
    both = keyed.join(F.broadcast(flagged) if flagged.count() <= MAX_FLAGGED else flagged, "__key", "left")
    longest_first = F.array_sort(F.coalesce("__found", F.array().cast("array<string>")), lambda a, b: F.length(b) - F.length(a))
    clean = F.aggregate(longest_first, F.col("text"), lambda text, secret: F.replace(text, secret, F.lit(mark)))
    return both.withColumn("text", F.when(F.col("__found").isNull(), F.col("text")).otherwise(clean)).select(*docs.columns)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scanned(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id")
    return found.select("doc_id", "start", "length", F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")
