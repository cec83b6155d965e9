"""Reading level of documents from the levels of their sentences.

Two regularised multinomial regressions, one on hashed words and one on hashed
character 4-grams, give each sentence of running prose a distribution over the
levels. A document's distribution is the mean of its sentences' weighted by
words; a third regression, fitted on documents that the sentence models have
not seen, calibrates it into the document's level.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.keys import as_key
from graphloom.llm import languages as L
from graphloom.llm import words as W
from graphloom.session import cut

LEVELS = ("easy", "medium", "hard")
MIN_WORDS = 60
#: The classifiers are fitted on at most so many labelled documents, and so many sentences spread evenly over each.
MAX_LABELLED = 1200
MAX_SENTENCES = 24
BUCKETS = 1 << 13
GRAM = 4
PENALTY = 1e-3
#: The bounded sample is fitted in so many partitions, as each iteration is a job over them.
FIT_PARTITIONS = 4

# what only machines write inside a token, or a number with letters; and what a line of mere words never has
_ODD = re.compile(r"[0-9=_/\\@|<>{}\[\]#~^+*]|\w[:;,]\w|--|\":")
_MACHINE = re.compile(r"[=_/\\@|<>{}~^+*#]|[^\W\d][:;,]\w|\w[:;,][^\W\d]|--|\":|\d[^\s\d]*[^\W\d_]|[^\W\d_][^\s\d]*\d|\d[-:]\d|\d[.,]\d.*[.,:;]\d")
#: No word that a person writes is longer; what is longer is an address, a code or a script without spaces.
LONGEST_WORD = 64
_LEAD = re.compile(r"(?:[>|\s]|[-*•+–](?=\s)|\d{1,3}[.)](?=\s)|\[\d{1,2}:\d{2}(?::\d{2})?\])+")
_SPEAKER = re.compile(r"[^\W\d_]{2,30}:\s+")
_END = re.compile(r"[.!?。！？]+\s+")


def _is_prose(line: str) -> bool:
    """Whether a line is running text, by its tokens.

    More than half of them are without digits and odd characters, and at most a
    fifth are such as machines write (assignments, paths, identifiers, stamps,
    cells). Headings are no running text. ``line`` has single spaces.
    """
    if line[0] == "#":
        return False
    odd = machine = end = 0
    for found in _ODD.finditer(line):
        at = found.start()
        if at >= end:
            start, end = line.rfind(" ", 0, at) + 1, line.find(" ", at)
            end = len(line) if end < 0 else end
            odd += 1
            machine += end - start > LONGEST_WORD or _MACHINE.search(line, start, end) is not None
    tokens = line.count(" ") + 1
    return 5 * machine <= tokens and 2 * (tokens - odd) > tokens


def prose_sentences(text: str) -> list[str]:
    """The sentences of running prose, folded; speakers and list marks are cut off."""
    out: list[str] = []
    for line in W.fold(W.plain(text)).split("\n"):
        line = " ".join(line.split())
        if not line:
            continue
        # a row of a table keeps its bars, by which it is known
        if not line[0].isalpha() and not (line[0] == line[-1] == "|") and (lead := _LEAD.match(line)):
            line = line[lead.end() :]
        if ":" in line[:32] and (speaker := _SPEAKER.match(line)):
            line = line[speaker.end() :]
        if line and _is_prose(line):
            out += _END.split(line)
    return out


@dataclass
class _Sentences:
    """Sentences of a block as arrays."""

    english: np.ndarray
    words: np.ndarray
    word_bucket: np.ndarray
    word_owner: np.ndarray
    gram_bucket: np.ndarray
    gram_owner: np.ndarray
    foreign: np.ndarray


def _analyse(sentences: list[str], texts: np.ndarray) -> _Sentences:
    """``texts`` is the number of each sentence's text."""
    codes = W.code_points(sentences)
    hashes, owner = W.words(sentences, codes)
    n = len(sentences)
    counts = np.bincount(owner, minlength=n)
    kinds = W._kinds()[np.minimum(codes, 0x31FFF)]
    line = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(codes == 10, out=line[1:])
    spaceless = np.bincount(line[:-1][kinds == 2], minlength=n + 1)[:n]
    english = L.english(codes, hashes, owner, spaceless, texts)
    foreign = ~english & (counts > 0)
    # characters other than letters and digits are alike to the character model
    flat = np.where(kinds > 0, codes, np.where(codes == 10, 10, 32)).astype(np.uint64)
    m = max(0, len(flat) - GRAM + 1)
    gram = flat[:m].copy()
    whole = np.ones(m, bool)
    with np.errstate(over="ignore"):
        for i in range(1, GRAM):
            gram = gram * np.uint64(0x9E3779B97F4A7C15) + flat[i : m + i]
    ends = np.flatnonzero(codes == 10)
    for i in range(GRAM):
        spot = ends - i
        whole[spot[(spot >= 0) & (spot < m)]] = False
    keep = np.flatnonzero(whole)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    return _Sentences(english, counts, (hashes >> shift).astype(np.int64), owner, (W.mixed(gram[keep]) >> shift).astype(np.int64), line[:-1][keep], foreign)


def _scores(bucket: np.ndarray, owner: np.ndarray, n: int, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Sum of the weights of each sentence's features, by the root of how many there are."""
    count = np.bincount(owner, minlength=n)
    root = np.sqrt(np.maximum(count, 1))
    return np.stack([np.bincount(owner, weights[k][bucket], n) / root + bias[k] for k in range(len(bias))], 1)


def labelled(ratings: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """``(doc_id, level, fold)``: the level most raters chose, as a number; at most ``limit`` documents, chosen by hash.

    Repeated ratings count once; documents with a tie are left out, as are ratings of other levels.
    """
    number = F.coalesce(*[F.when(as_key("level") == name, F.lit(i)) for i, name in enumerate(LEVELS)])
    votes = ratings.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "rater_id", number.alias("level")).where("level is not null").distinct()
    votes = votes.groupBy("doc_id").agg(*[F.sum((F.col("level") == i).cast("int")).alias(f"_v{i}") for i in range(len(LEVELS))])
    most = F.greatest(*[F.col(f"_v{i}") for i in range(len(LEVELS))])
    ties = sum((F.col(f"_v{i}") == most).cast("int") for i in range(len(LEVELS)))
    level = F.coalesce(*[F.when(F.col(f"_v{i}") == most, F.lit(i)) for i in range(len(LEVELS))])
    spot = F.xxhash64("doc_id")
    return votes.where(ties == 1).select("doc_id", level.alias("level"), F.pmod(spot, F.lit(2)).cast("int").alias("fold")).orderBy(spot, "doc_id").limit(limit)


def _training_sentences(documents: DataFrame, chosen: DataFrame, limit: int) -> DataFrame:
    """Features of English sentences of the chosen documents: ``(level, word_index, word_value, gram_index, gram_value)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for level, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sentences = prose_sentences(text)
                if not sentences:
                    continue
                spread = np.unique(np.linspace(0, len(sentences) - 1, min(limit, len(sentences))).astype(int))
                sentences = [sentences[i] for i in spread]
                found = _analyse(sentences, np.zeros(len(sentences), np.int64))
                for i in np.flatnonzero(found.english & (found.words >= 4)).tolist():
                    parts = []
                    for bucket, owner in ((found.word_bucket, found.word_owner), (found.gram_bucket, found.gram_owner)):
                        index, count = np.unique(bucket[owner == i], return_counts=True)
                        parts += [index.tolist(), (count / np.sqrt(max(1, count.sum()))).tolist()]
                    rows.append((level, *parts))
            kinds = [pa.int32(), *[pa.list_(pa.int32()), pa.list_(pa.float64())] * 2]
            names = ["level", "word_index", "word_value", "gram_index", "gram_value"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null").join(F.broadcast(chosen), "doc_id").select("level", "text")
    return rows.mapInArrow(run, "level int, word_index array<int>, word_value array<double>, gram_index array<int>, gram_value array<double>")


def _given(rows: DataFrame) -> list[int]:
    """The levels that occur, at most as many as there are."""
    return sorted(int(row[0]) for row in rows.select("level").distinct().collect())


def _fit(rows: DataFrame, index: str, value: str) -> tuple[np.ndarray, np.ndarray]:
    """Weights by level and bucket, and biases, of a multinomial regression with an L2 penalty."""
    weights, bias = np.zeros((len(LEVELS), BUCKETS)), np.full(len(LEVELS), -30.0)
    given = _given(rows)
    if len(given) == 1:
        bias[given[0]] = 0.0
        return weights, bias
    vector = F.udf(lambda i, v: SparseVector(BUCKETS, i, v), VectorUDT())  # on the bounded sample only
    model = LogisticRegression(family="multinomial", regParam=PENALTY, maxIter=30, standardization=False, labelCol="level").fit(rows.coalesce(FIT_PARTITIONS).select(F.col("level").cast("double"), vector(index, value).alias("features")))
    found = model.coefficientMatrix.toArray()
    weights[: len(found)], bias[: len(found)] = found, model.interceptVector.toArray()
    return weights, bias


def score_documents(documents: DataFrame, weights: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``(doc_id, prose_words, other_words, *LEVELS)``: words of English prose and of others, and the share of each level."""
    shared = documents.sparkSession.sparkContext.broadcast(weights)
    names = ["doc_id", "prose_words", "other_words", *LEVELS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_model, gram_model = shared.value
        for batch in batches:
            all_ids = batch.column(0)
            for block in W.blocks((i, t or "") for i, t in enumerate(batch.column(1).to_pylist())):
                split = [prose_sentences(t) for _, t in block]
                doc = np.repeat(np.arange(len(block)), [len(s) for s in split])
                sums = np.zeros((len(LEVELS), len(block)))
                prose = other = np.zeros(len(block))
                if len(doc):
                    found = _analyse([s for ss in split for s in ss], doc)
                    n = len(doc)
                    logits = _scores(found.word_bucket, found.word_owner, n, *word_model) + _scores(found.gram_bucket, found.gram_owner, n, *gram_model)
                    share = np.exp(logits - logits.max(1, keepdims=True))
                    share /= share.sum(1, keepdims=True)
                    size = np.where(found.english, found.words, 0)
                    prose = np.bincount(doc, size, len(block))
                    other = np.bincount(doc, np.where(found.foreign, found.words, 0), len(block))
                    sums = np.stack([np.bincount(doc, size * share[:, k], len(block)) for k in range(len(LEVELS))]) / np.maximum(1, prose)
                columns = [all_ids.take(pa.array([i for i, _ in block])), pa.array(prose.astype(np.int64)), pa.array(other.astype(np.int64)), *map(pa.array, sums)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, prose_words long, other_words long, " + ", ".join(f"{name} double" for name in LEVELS))


def reading_levels(documents: DataFrame, ratings: DataFrame, min_words: int = MIN_WORDS, max_labelled: int = MAX_LABELLED, max_sentences: int = MAX_SENTENCES) -> DataFrame:
    """``(doc_id, level, prose_words, *LEVELS)`` for documents mainly in English with ``min_words`` words of prose.

    ``LEVELS`` are the calibrated shares, of which the greatest is the level.

    ``documents(doc_id, text)``, ``ratings(doc_id, rater_id, level)``; further
    columns are ignored. Every document is scored over its whole text; only the
    fitting uses a sample (``max_labelled`` documents, ``max_sentences`` of
    each). Null and blank texts have no prose and no level. Without any usable
    rating there is no model, and the result is empty; if only one level was
    ever given, that is every document's level.
    """
    spark = documents.sparkSession
    empty = spark.createDataFrame([], "doc_id long, level string, prose_words long, " + ", ".join(f"{name} double" for name in LEVELS))
    chosen = cut(labelled(ratings, max_labelled), "labelled")
    sample = cut(_training_sentences(documents, chosen.where("fold = 0"), max_sentences), "sentences")
    if sample.isEmpty():
        sample = cut(_training_sentences(documents, chosen, max_sentences), "sentences")
    if sample.isEmpty():
        return empty
    weights = [_fit(sample, "word_index", "word_value"), _fit(sample, "gram_index", "gram_value")]
    scored = cut(score_documents(documents, weights), "levels")
    scored = scored.where((F.col("prose_words") >= min_words) & (F.col("prose_words") > F.col("other_words")))
    seen = scored.join(F.broadcast(chosen.where("fold = 1")), "doc_id").select(F.col("level").cast("double").alias("level"), *LEVELS)
    seen = cut(seen, "calibration")
    best = F.array(*LEVELS)
    if len(_given(seen)) > 1:
        fitted = LogisticRegression(family="multinomial", regParam=PENALTY, maxIter=50, labelCol="level").fit(seen.coalesce(1).select("level", array_to_vector(F.array(*LEVELS)).alias("features")))
        matrix, bias = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
        logits = [sum((F.col(name) * float(w) for name, w in zip(LEVELS, row)), F.lit(float(b))) for row, b in zip(matrix, bias)]
        # a level that no seen document has gets none of the calibrated share
        logits += [F.lit(-1e9)] * (len(LEVELS) - len(logits))
        raised = [F.exp(x - F.greatest(*logits)) for x in logits]
        whole = sum(raised[1:], raised[0])
        scored = scored.select("doc_id", "prose_words", *[(x / whole).alias(name) for x, name in zip(raised, LEVELS)])
    names = F.array(*map(F.lit, LEVELS))
    level = names[F.array_position(best, F.array_max(best)).cast("int") - 1]
    return scored.select("doc_id", level.alias("level"), "prose_words", *LEVELS)
