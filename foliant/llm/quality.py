"""Quality classifier (operator 8).

Statistics of each text (lengths, kinds of characters, word shapes, repetition) are computed
once and written. Random Fourier features of the standardised statistics approximate a
Gaussian kernel; the normal equations of ridge regression are sums over partitions, added up
by Spark in two steps, so that the driver receives one matrix; its solution scores texts. An
isotonic fit over score bins of labelled rows kept out of the ridge fit turns scores into
probabilities of label 1.

Neither labels nor lang, source or doc_id are inputs of a score: doc_id only chooses the fold.

Defined cases: null and empty texts share one vector of statistics and get that vector's
score; very long texts count whole; a document with several label rows takes part with each;
rows without a label only get scores; with no labelled training rows every score is 0.5, with
labels of one kind the score is that share; repeated rows give repeated rows; other columns
are not read; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.packed import chunks, mix, partition_sum, words
from foliant.session import settle, ship

#: crc32(doc_id) % FOLDS: TEST is never learned from, CALIBRATE fits the isotonic curve, others the ridge.
FOLDS, TEST, CALIBRATE = 4, 2, 1
#: Random features, width of the kernel, ridge, and bins of the isotonic fit.
FEATURES, WIDTH, RIDGE, BINS = 256, 3.0, 1e-3, 1000
#: Bytes of text whose statistics are computed at a time (their arrays take about thirty times as much).
STATISTICS_BYTES = 1 << 20
#: Scores from here on are predicted 1.
ACCEPT = 0.7


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of statistics per text."""
    codes, vocabulary, first = words(texts)
    n_words = np.diff(first).astype(np.float64)
    m = len(n_words)
    doc = np.repeat(np.arange(m), np.diff(first))
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + m + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    cuts = offsets - offsets[0]

    def per_text(flags: np.ndarray) -> np.ndarray:
        running = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (running[cuts[1:]] - running[cuts[:-1]]).astype(np.float64)

    kind = _KINDS[raw]
    n_bytes = np.diff(cuts).astype(np.float64)
    by_kind = {k: per_text(kind == k) for k in range(1, 9)}
    n_chars = np.maximum(1, n_bytes - per_text((raw & 0xC0) == 0x80))
    word_length = np.asarray(pc.utf8_length(vocabulary)).astype(np.float64) if len(vocabulary) else np.zeros(0)
    common = np.asarray(pc.less_equal(pc.utf8_length(vocabulary), 3)).astype(np.float64) if len(vocabulary) else np.zeros(0)
    odd = np.asarray(pc.match_substring_regex(vocabulary, r"[^\pL'’.,;:!?\-]")).astype(np.float64) if len(vocabulary) else np.zeros(0)
    lengths = word_length[codes]
    some = np.maximum(1, n_words)
    mean = np.bincount(doc, lengths, minlength=m) / some
    spread = np.sqrt(np.maximum(0, np.bincount(doc, lengths**2, minlength=m) / some - mean**2))
    pairs = np.unique(doc * max(1, len(vocabulary)) + codes)
    distinct = np.bincount(pairs // max(1, len(vocabulary)), minlength=m)
    follow = np.flatnonzero(np.diff(doc) == 0)
    same = np.bincount(doc[follow], codes[follow] == codes[follow + 1], minlength=m)
    bigram = mix(mix((codes[follow] * max(1, len(vocabulary)) + codes[follow + 1]).astype(np.uint64)) + doc[follow].astype(np.uint64))
    two = doc[follow][np.unique(bigram, return_index=True)[1]]
    lines = by_kind[8] + 1
    columns = [
        np.log1p(n_words), np.log1p(n_chars), mean, spread, distinct / some, same / some, np.bincount(two, minlength=m) / some,
        np.bincount(doc, common[codes], minlength=m) / some, np.bincount(doc, odd[codes], minlength=m) / some, np.bincount(doc, lengths > 20, minlength=m) / some,
        by_kind[1] / n_chars, by_kind[2] / n_chars, by_kind[3] / n_chars, by_kind[4] / n_chars, by_kind[5] / n_chars, by_kind[6] / n_chars, by_kind[7] / n_chars,
        by_kind[2] / np.maximum(1, by_kind[1] + by_kind[2]), by_kind[4] / some, by_kind[5] / some, by_kind[7] / some, np.log1p(n_words / lines), np.log1p(lines),
    ]
    return np.stack(columns, axis=1).astype(np.float32)


def _kinds() -> np.ndarray:
    """Classes of UTF-8 bytes: lower, upper, digit, sentence marks, other marks, blank, brackets and bars, line feed."""
    out = np.zeros(256, np.uint8)
    for k, said in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:!?'\"-", "#$%&*+/=@^_~`\\", " \t\r", "()[]{}<>|", "\n"), 1):
        out[[ord(c) for c in said]] = k
    return out


_KINDS = _kinds()
DIMENSIONS = 23
#: Ids of labelled documents that are broadcast, at most (8 bytes each).
BROADCAST_IDS = 500_000


def fourier(x: np.ndarray, centre: np.ndarray, scale: np.ndarray, features: int = FEATURES) -> np.ndarray:
    """Random Fourier features of standardised statistics, with a constant and the statistics themselves."""
    random = np.random.default_rng(20_011)
    direction = random.normal(0, 1 / WIDTH, (x.shape[1], features))
    shift = random.uniform(0, 2 * np.pi, features)
    z = np.clip((x.astype(np.float64) - centre) / scale, -6, 6)
    return np.concatenate([np.sqrt(2 / features) * np.cos(z @ direction + shift), z / 10, np.ones((len(x), 1))], axis=1)


def pool(score: np.ndarray, good: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Isotonic means: pools adjacent violators of bins in order of score."""
    means, sizes, spans = [], [], []
    for g, w in zip(good.tolist(), weight.tolist()):
        means.append(g / w)
        sizes.append(w)
        spans.append(1)
        while len(means) > 1 and means[-2] >= means[-1]:
            w2, m2, s2 = sizes.pop(), means.pop(), spans.pop()
            means[-1] = (means[-1] * sizes[-1] + m2 * w2) / (sizes[-1] + w2)
            sizes[-1] += w2
            spans[-1] += s2
    return np.repeat(means, spans)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(-1, DIMENSIONS)
    return np.nan_to_num(x)


def featurise(docs: DataFrame) -> DataFrame:
    """doc_id, fold, x (packed statistics) of every row, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in chunks(batches, most=STATISTICS_BYTES):
            x = statistics(part.column("text"))
            others = [part.column(c).combine_chunks() for c in ("doc_id", "fold")]
            yield pa.RecordBatch.from_arrays([*others, pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "fold", "x"])

    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold.cast("int").alias("fold"), "text")
    return settle(docs.mapInArrow(run, "doc_id long, fold int, x binary"), "statistics")


class Model:
    """What scoring needs: centre and scale of the statistics, ridge weights, isotonic curve."""

    def __init__(self, centre, scale, ridge, knots, heights, learned=True):
        self.learned = learned
        self.centre, self.scale, self.ridge, self.knots, self.heights = centre, scale, ridge, knots, heights

    def raw(self, x: np.ndarray) -> np.ndarray:
        return fourier(x, self.centre, self.scale) @ self.ridge

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.heights), 0.0, 1.0)


def fit(rows: DataFrame, labels: DataFrame) -> Model:
    """The model from featurised documents and labels (doc_id, quality)."""
    labels = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    known = settle(rows.where(F.col("fold") != TEST).join(labels, "doc_id").select("fold", "x", "y"), "labelled")
    d = DIMENSIONS
    ridge_rows, curve_rows = known.where(F.col("fold") != CALIBRATE), known.where(F.col("fold") == CALIBRATE)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x, y = _matrix(batch).astype(np.float64), np.asarray(batch.column("y"))
        return np.concatenate([[len(x), y.sum()], x.sum(0), (x**2).sum(0)])

    total = partition_sum(ridge_rows, moments, 2 + 2 * d)
    n, good = total[0], total[1]
    if not n:
        return Model(np.zeros(d), np.ones(d), np.zeros(FEATURES + d + 1), [0.0], [0.5], learned=False)
    centre = total[2 : 2 + d] / n
    scale = np.sqrt(np.maximum(total[2 + d :] / n - centre**2, 0))
    scale[scale < 1e-6] = 1.0
    k = FEATURES + d + 1
    # Either label weighs the same in all.
    weight = {1.0: 0.5 * n / max(1.0, good), 0.0: 0.5 * n / max(1.0, n - good)}

    def normal(batch: pa.RecordBatch) -> np.ndarray:
        z, y = fourier(_matrix(batch), centre, scale), np.asarray(batch.column("y"))
        w = np.where(y > 0, weight[1.0], weight[0.0])[:, None]
        return np.concatenate([(z.T @ (w * z)).ravel(), z.T @ (w[:, 0] * y)])

    sums = partition_sum(ridge_rows, normal, k * k + k)
    model = Model(centre, scale, np.linalg.solve(sums[: k * k].reshape(k, k) + RIDGE * n * np.eye(k), sums[k * k :]), [0.0], [good / n])

    def curve(batch: pa.RecordBatch) -> np.ndarray:
        place = np.clip((model.raw(_matrix(batch)) + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int64)
        y = np.asarray(batch.column("y"))
        return np.concatenate([np.bincount(place, minlength=BINS), np.bincount(place, y, minlength=BINS)])

    bins = partition_sum(curve_rows, curve, 2 * BINS)
    seen = np.flatnonzero(bins[:BINS])
    if len(seen):
        model.knots = (seen + 0.5) / BINS * 2 - 0.5
        model.heights = pool(model.knots, bins[BINS:][seen], bins[:BINS][seen])
    return model


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    ship(docs.sparkSession)
    rows = featurise(docs)
    model = fit(rows, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch)) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.equal(batch.column("fold"), TEST), pa.array(score), pa.array((score >= ACCEPT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted 1, all columns, scored where they stand.

    Without any label to learn from nothing is known against a row, and all stay.
    """
    ship(docs.sparkSession)
    # Only labelled documents teach: where their ids are few enough to be broadcast, no others need statistics here.
    ids = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("labelled")).distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    taught = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("labelled"), "left_semi") if few else docs
    model = fit(featurise(taught), labels)
    if not model.learned:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in chunks(batches, most=STATISTICS_BYTES):
            yield from part.filter(pa.array(model.score(statistics(part.column("text"))) >= ACCEPT)).to_batches()

    return docs.mapInArrow(run, docs.schema)
