"""Operator 5, quality classifier by importance resampling.

Two generative models of hashed n-grams (byte trigrams, words and word pairs, each in BUCKETS
buckets): one of the labelled target documents, one of all raw text. A document's score is the log of
the ratio of its likelihoods per n-gram (SHRINK of ratio 0 added), so that long texts do not weigh
more; score / TEMPERATURE is the log of its importance weight. Gumbel noise seeded by doc_id is added, and the k documents with the
highest sums are a sample without replacement in proportion to the weights. k is a parameter, or it
follows from the labelled documents. A mean over a whole text lets ordinary words outweigh a few bad
ones, so a document must also pass by its worst passage: the least sum, over WINDOW words in a row, of
log ratios between labelled targets and labelled toxic documents (other non-targets if none is toxic),
with a floor from both. What is counted there is how many documents hold the beginning of a word (FIRST
bytes, in lower case, without marks and digits), and how many hold it a second or a third time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._state import fresh, table, written
from ._text import buffers, mix, slices, word_hashes

BUCKETS = 1 << 14
KINDS = 3
#: At most so many labelled documents are read, the first by hash of doc_id.
LABELLED_ROWS = 20_000
SMOOTHING = 1.0
SEED = 5
#: Score that makes a document e times as likely to be drawn.
TEMPERATURE = 0.005
#: N-grams of ratio 0 that every document has besides its own: a few odd words do not condemn a short text.
SHRINK = 400
#: Bins of a pass of the search for the k-th highest value.
BINS = 4096
#: Passages: buckets, bytes of a word, times it may come again, words in a window, documents that the prior counts for.
PASSAGE_BITS = 20
FIRST, AGAIN = 6, 2
WINDOW = 2
PRIOR = 4.0
#: A labelled target below the floor of passages weighs as much as so many other labelled documents above it.
TARGET_COST = 10


def _grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) of every n-gram, by kind."""
    lo = int(offsets[0])
    part = data[lo : int(offsets[-1])].astype(np.uint32)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    n = max(0, len(part) - 2)
    code = part[:n] | part[1 : n + 1] << np.uint32(8) | part[2 : n + 2] << np.uint32(16)
    whole = row[:n] == row[2 : n + 2]
    yield ((code * np.uint32(2654435761)) >> np.uint32(18))[whole], row[:n][whole]
    words, at = word_hashes(data, offsets, fold=False)
    yield (words >> np.uint64(50)).astype(np.int64) + BUCKETS, at
    m = max(0, len(words) - 1)
    pair = mix(words[:m] * np.uint64(3) + words[1 : m + 1])
    same = at[:m] == at[1 : m + 1]
    yield (pair >> np.uint64(50)).astype(np.int64)[same] + 2 * BUCKETS, at[:m][same]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(KINDS * BUCKETS, np.int64), np.zeros(KINDS * BUCKETS, np.int64)
    for b in (part for batch in batches for part in slices(batch, "text")):
        wanted = np.array(b.column("target").fill_null(False).to_pylist(), bool)
        for bucket, row in _grams(*buffers(b.column("text"))):
            raw += np.bincount(bucket, minlength=len(raw))
            target += np.bincount(bucket[wanted[row]], minlength=len(raw))
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])


def labelled(labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """(doc_id, target, toxic) of a bounded sample of labels: target if all rows of a doc_id say good quality and none toxic, toxic if one does."""
    some = labels.select("doc_id", "quality", "toxic").where("doc_id IS NOT NULL AND quality IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "toxic").limit(rows)
    toxic = F.coalesce("toxic", F.lit(0)) == 1
    return some.groupBy(F.col("doc_id").alias("_labelled")).agg(F.every((F.col("quality") == 1) & ~toxic).alias("target"), F.some(toxic).alias("toxic"))


def log_ratios(docs: DataFrame, sample: DataFrame) -> np.ndarray:
    """log(target / raw) by bucket, from counts over all documents; zeros if no target document has text."""
    marked = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_labelled"), "left").select("text", "target")
    counts = marked.mapInArrow(_count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    raw, target = np.full(KINDS * BUCKETS, SMOOTHING), np.full(KINDS * BUCKETS, SMOOTHING)
    for bucket, r, t in counts:  # at most KINDS * BUCKETS rows
        raw[bucket] += r
        target[bucket] += t
    if target.sum() == SMOOTHING * len(target):
        return np.zeros(len(raw), np.float32)
    share = lambda x: (x.reshape(KINDS, -1) / x.reshape(KINDS, -1).sum(1, keepdims=True)).ravel()
    return np.log(share(target) / share(raw)).astype(np.float32)


def with_scores(docs: DataFrame, weights: np.ndarray, passages: np.ndarray | None = None, names: tuple[str, str] = ("_score", "_passage")) -> DataFrame:
    """docs with a column for the document's log ratio per n-gram (0 without n-grams), and one for the worst passage if there are ratios for passages.

    Both in one pass: a second one would be a second Python worker on each core.
    """
    names = names if passages is not None else names[:1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, "text")):
            score, grams = np.zeros(len(b)), np.zeros(len(b))
            for bucket, row in _grams(*buffers(b.column("text"))):
                score += np.bincount(row, weights[bucket], minlength=len(b))
                grams += np.bincount(row, minlength=len(b))
            new = [pa.array(np.round(score / (grams + SHRINK), 9))]
            if passages is not None:
                bucket, at = _words(b.column("text"))
                new.append(pa.array(_worst(passages[bucket], at, len(b))))
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]]))


def _words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every word for the passage scores: of its beginning and how often that came before, AGAIN times at most."""
    words, at = word_hashes(*buffers(col), fold=True, letters=True, head=FIRST)
    order = np.lexsort((words, at))
    w, r = words[order], at[order]
    start = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (r[1:] != r[:-1])])) if len(w) else np.empty(0, np.int64)
    before = np.empty(len(w), np.uint64)
    before[order] = np.minimum(np.arange(len(w)) - np.repeat(start, np.diff(start, append=len(w))), AGAIN).astype(np.uint64)
    return (mix(words * np.uint64(31) + before) >> np.uint64(64 - PASSAGE_BITS)).astype(np.int64), at


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (part for batch in batches for part in slices(batch, "text")):
        wanted = np.array(b.column("target").to_pylist(), bool)
        bucket, at = _words(b.column("text"))
        held = np.unique(at << PASSAGE_BITS | bucket)
        some, where = np.unique(held & ((1 << PASSAGE_BITS) - 1), return_inverse=True)
        target = np.bincount(where, wanted[held >> PASSAGE_BITS], len(some)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(target), pa.array(np.bincount(where, minlength=len(some)) - target)], ["bucket", "target", "other"])


def passage_ratios(marked: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """log(target / other) by bucket from labelled documents (text, target): for other documents, and for a labelled target
    and a labelled other, each of which then does not count for itself. None unless both classes have documents."""
    size = {r.target: r.n for r in marked.groupBy("target").agg(F.count(F.lit(1)).alias("n")).collect()}
    n, m = size.get(True, 0), size.get(False, 0)
    if not n or not m:
        return None
    counts = marked.mapInArrow(_holders, "bucket int, target long, other long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("other").alias("other")).toArrow()  # at most 1 << PASSAGE_BITS rows
    target, other = np.zeros(1 << PASSAGE_BITS), np.zeros(1 << PASSAGE_BITS)
    target[counts.column("bucket").to_numpy()] = counts.column("target").to_numpy()
    other[counts.column("bucket").to_numpy()] = counts.column("other").to_numpy()
    a, b = PRIOR * n / (n + m), PRIOR * m / (n + m)
    ratio = lambda t, o, nt, no: (np.log((t + a) / (nt + a)) - np.log((o + b) / (no + b)) - np.log(a / (nt + a)) + np.log(b / (no + b))).astype(np.float32)
    return ratio(target, other, n, m), ratio(np.maximum(target - 1, 0), other, n - 1, m), ratio(target, np.maximum(other - 1, 0), n, m - 1)


def _worst(values: np.ndarray, at: np.ndarray, rows: int) -> np.ndarray:
    """Per row the least sum of WINDOW values in a row (fewer at its end), 0 at most."""
    out = np.zeros(rows)
    if len(values):
        sums = np.concatenate([[0.0], np.cumsum(values, dtype=float)])
        last = np.searchsorted(at, np.arange(rows), "right")
        window = sums[np.minimum(np.arange(len(values)) + WINDOW, last[at])] - sums[:-1]
        np.minimum.at(out, at, window)
    return np.round(out, 6)


def with_passages(docs: DataFrame, ratios: tuple[np.ndarray, np.ndarray, np.ndarray], labelled_rows: bool = False) -> DataFrame:
    """docs with the column _passage, the score of the worst passage; labelled_rows have their class in the column target."""
    general, of_target, of_other = ratios if labelled_rows else (ratios[0], None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, "text")):
            bucket, at = _words(b.column("text"))
            if labelled_rows:
                wanted = np.array(b.column("target").to_pylist(), bool)
                values = np.where(wanted[at], of_target[bucket], of_other[bucket])
            else:
                values = general[bucket]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_worst(values, at, len(b)))], [*b.schema.names, "_passage"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_passage", T.DoubleType())]))


def passage_floor(targets: np.ndarray, others: np.ndarray) -> float | None:
    """The floor that misjudges least (a target below counts TARGET_COST times), half way to the next lower score; None if none rejects."""
    at = np.unique(np.concatenate([targets, others]))
    wrong = TARGET_COST * np.searchsorted(np.sort(targets), at) + len(others) - np.searchsorted(np.sort(others), at)
    best = int(wrong.argmin())
    return float(at[best - 1] + at[best]) / 2 if best else None


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise, the same for a doc_id in every run."""
    u = (F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_highest(values: DataFrame, k: int) -> float | None:
    """The k-th highest of one column of doubles (its lowest if it has fewer, None if it has none), without sorting it.

    Each pass counts BINS equal bins between two bounds and goes on inside the bin that holds the
    k-th; no more than BINS rows come to the driver.
    """
    name = values.columns[0]
    low, high, n = values.agg(F.min(name), F.max(name), F.count(name)).first()
    if not n:
        return None
    left = min(max(k, 1), n)
    while low < high:
        step = (high - low) / BINS
        bin_ = F.least(F.floor((F.col(name) - low) / step), F.lit(BINS - 1)) if step > 0 else (F.col(name) > low).cast("long")
        seen = values.where(F.col(name).between(low, high)).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("low"), F.max(name).alias("high"))
        for r in sorted(seen.collect(), key=lambda r: -r.bin):
            if left <= r.n:
                low, high = r.low, r.high
                break
            left -= r.n
    return low


def resample(
    docs: DataFrame, labels: DataFrame, k: int | None = None, keep_targets: float = 0.9999, seed: int = SEED, labelled_rows: int = LABELLED_ROWS, names: tuple[str, str, str, str] = ("_score", "_noisy", "_passage", "_kept")
) -> DataFrame:
    """docs with four columns (names; they replace columns so named): the score, score / TEMPERATURE plus Gumbel noise, the worst
    passage, and whether the noisy score is among the top k and no passage is bad.

    Without k, it is the number of documents that are not below a floor: half way between the noisy
    score that the share keep_targets of the labelled target documents reach and the best of the other
    labelled documents below that (no floor if there is none). Rows that tie with the k-th are all
    among the top; a k below 1 takes none. The score of the worst passage has a floor of its own (see passage_floor), for which
    no labelled document is judged by its own words; without labels of both classes it is 0 and has
    none. Every row is scored over its whole text. Null or empty text scores 0. Noise depends on doc_id
    alone, so repeated rows get one verdict; rows with a null doc_id share one noise. Without labelled
    targets all scores are 0. Other columns pass through; an empty table gives an empty table. A doc_id
    with several labels is a target if all say so, and one with several rows counts by its worst.
    """
    sample = labelled(labels, labelled_rows)
    weights = log_ratios(docs, sample)
    marked = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_labelled")).select("doc_id", "text", "target", "toxic")
    toxic = marked.where("target OR toxic")
    judged = (marked if toxic.where("toxic").isEmpty() else toxic).drop("toxic")

    def noisy(score: str) -> Column:
        return F.col(score) / TEMPERATURE + gumbel(F.col("doc_id"), seed)

    def least(scored: DataFrame, value: Column) -> tuple[np.ndarray, np.ndarray]:
        seen = scored.groupBy("doc_id", "target").agg(F.min(value).alias("v")).toArrow()  # at most labelled_rows
        target, v = np.array(seen.column("target").to_pylist(), bool), np.array(seen.column("v").to_pylist(), float)
        return v[target], v[~target]

    ratios, floor, lowest = passage_ratios(judged), None, None
    if k is None:
        targets, others = least(with_scores(marked.drop("toxic"), weights), noisy("_score"))
        if len(targets):
            edge = np.quantile(targets, 1 - keep_targets)
            below = others[others < edge]
            floor = float(edge + below.max()) / 2 if len(below) else None
    elif k < 1:
        floor = np.inf
    else:
        floor = kth_highest(written(with_scores(docs.select("doc_id", "text"), weights).select(noisy("_score").alias("v")), "noisy"), k)
    if ratios:
        lowest = passage_floor(*least(with_passages(judged, ratios, labelled_rows=True), F.col("_passage")))
    score, passage, total, kept = fresh(docs, "score", "passage", "noisy", "kept")
    scored = with_scores(docs, weights, ratios[0] if ratios else None, (score, passage)).withColumn(total, noisy(score))
    scored = scored if ratios else scored.withColumn(passage, F.lit(0.0))
    top = F.lit(True) if floor is None else F.col(total) >= F.lit(float(floor))
    scored = scored.withColumn(kept, top if lowest is None else top & (F.col(passage) >= F.lit(lowest)))
    own = [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]
    return scored.select(*[F.col(f"`{c}`") for c in own], *[F.col(c).alias(n) for c, n in zip((score, total, passage, kept), names, strict=True)])


def op5_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, log_ratio (per n-gram), noisy, kept of every document."""
    out = resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.col("_score").alias("log_ratio"), F.col("_noisy").alias("noisy"), F.col("_kept").alias("kept"))
