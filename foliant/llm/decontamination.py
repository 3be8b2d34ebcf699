"""Benchmark decontamination by latent semantic retrieval (operator 5).

1. The benchmark's words are the vocabulary; the document frequency of each is counted over
   all documents, a sum over partitions of the vocabulary's size. A word weighs by the share
   of documents that hold it; words outside the benchmark have no weight anywhere, so an
   item's verdict does not change as the corpus grows.
2. The items' passages (windows of their words) become TF-IDF vectors. A randomised SVD finds
   their latent space: a random block is multiplied by the transposed passages as a sum over
   partitions and made orthogonal, and the Gram matrix of the passages in that basis, another
   sum over partitions, gives the singular vectors. ``DIMENSIONS`` passages at most share a
   space of as many dimensions, so the space holds each of them whole however large the
   benchmark is.
3. Every window of every document is compared with the items by cosine in these spaces. An
   index leads from an item's rarest words to the item, so that only windows near enough of
   its words are projected. The words left out of the index weigh less than what a confirmed
   pair must have in common, so it drops only pairs that step 4 would drop.
4. A candidate, of cosine ``COSINE`` at least, is confirmed by the weighted longest common
   subsequence of the item and the region around the window (paraphrases keep most rare words
   in order), or by a lower one together with the answer check: the item's last sentence is
   found among the region's words.

Defined cases: null and empty texts contain nothing; null or empty items are passed over; an
empty benchmark contaminates nothing; very long texts are searched whole; repeated rows give
repeated rows; equal items each give a row; of equally good windows of a pair the one of
highest cosine is told; other columns are not read; an empty table gives an empty one.

The benchmark (its words, items, spaces and index) goes to the tasks. Its size is checked:
beyond ``BLOCK_ITEMS`` items the work is done block by block, one block at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.packed import chunks, partition_sum, words
from foliant.session import forget, settle, ship

#: Words of a window and between windows; a span of WINDOW - STRIDE + 1 words stands whole in one.
WINDOW, STRIDE = 32, 16
#: Least share of an item's weight in common; the same with the answer; least share of the answer.
COMMON, COMMON_ANSWERED, ANSWERED = 0.6, 0.45, 0.8
#: Most weight of an item in the words that are not indexed (the most frequent ones); it must be below COMMON_ANSWERED.
REST = 0.2
#: Numbers that a step of the candidate search adds up at most (one stretch and its items at least).
BATCH = 2 << 20
#: Least cosine of a candidate.
COSINE = 0.2
#: Passages that share a latent space, and its dimensions at most.
DIMENSIONS = 256
#: Items of a block.
BLOCK_ITEMS = 1024


class Items:
    """The benchmark's items as numbers of its own vocabulary."""

    def __init__(self, rows: list[tuple[int, str]]):
        rows = [(i, t) for i, t in rows if t and t.strip(" \t\n\x0b\x0c\r")]
        codes, vocabulary, first = words(pa.array([t for _, t in rows], pa.string()))
        self.ids = [i for i, _ in rows]
        self.vocabulary = vocabulary
        self.words = [codes[a:b] for a, b in zip(first, first[1:])]
        # the last sentence's words
        last = [[s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s][-1] for _, text in rows]
        codes, vocabulary, first = words(pa.array(last, pa.string()))
        codes = self.look_up(vocabulary)[codes]
        self.answers = [np.unique(codes[a:b]) for a, b in zip(first, first[1:])]

    def look_up(self, vocabulary: pa.Array) -> np.ndarray:
        """Numbers of words here, -1 for others."""
        return np.asarray(pc.fill_null(pc.index_in(vocabulary, self.vocabulary), -1)).astype(np.int64)


def _numbered(items: Items, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' words as numbers of the benchmark's vocabulary, and the first of each text."""
    codes, vocabulary, first = words(texts)
    return items.look_up(vocabulary)[codes] if len(codes) else codes, first


def _windows(first: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and document of every window; the last of a document ends with it."""
    lengths = np.diff(first)
    n = np.where(lengths > 0, np.maximum(1, -(-(lengths - (WINDOW - stride)) // stride)), 0)
    doc = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    begin = first[:-1][doc] + k * stride
    return begin, np.minimum(begin + WINDOW, first[1:][doc]), doc


def document_frequencies(docs: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """How many documents hold each word of the benchmark, and how many there are."""
    size = len(items.vocabulary)

    def run(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros(size + 1)
        for _, part in chunks(iter([batch])):
            codes, first = _numbered(items, part.column("text"))
            doc = np.repeat(np.arange(len(part)), np.diff(first))
            known = codes >= 0
            pairs = np.unique(doc[known] * size + codes[known])
            total[:size] += np.bincount(pairs % size, minlength=size) if len(pairs) else 0
            total[size] += len(part)
        return total

    sums = partition_sum(docs.select("text"), run, size + 1)
    return sums[:size], int(sums[size])


class Space:
    """A latent space of some passages: ``code`` tells a word's row in the basis, the last one for other words."""

    def __init__(self, code: np.ndarray, basis: np.ndarray, item: np.ndarray, passages: np.ndarray):
        self.code, self.basis = code, basis.astype(np.float32)
        self.item, self.passages = item, passages.astype(np.float32)

    def project(self, columns: np.ndarray, idf: np.ndarray) -> np.ndarray:
        """Unit latent vectors of windows, each a column of word numbers (-1 for other words)."""
        out = np.zeros((columns.shape[1], self.basis.shape[1]), np.float32)
        for w in columns:
            out += idf[w, None].astype(np.float32) * self.basis[self.code[w]]
        return out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))


def latent_spaces(spark: SparkSession, items: Items, idf: np.ndarray) -> list[Space]:
    """Spaces of the items' passages, ``DIMENSIONS`` passages at most in each."""
    first = np.concatenate([[0], np.cumsum([len(w) for w in items.words])]).astype(np.int64)
    codes = np.concatenate(items.words)
    begin, end, item = _windows(first)
    # An item's passages stand together in one space, unless it alone has more than a space holds.
    counts = np.bincount(item, minlength=len(items.words))
    number, size, groups = -1, DIMENSIONS, []
    for n in counts.tolist():
        if size + min(n, DIMENSIONS) > DIMENSIONS:
            number, size = number + 1, 0
        groups += [number + k // DIMENSIONS for k in range(n)]
        number, size = groups[-1], size + n if n <= DIMENSIONS else n % DIMENSIONS or DIMENSIONS
    group, out = np.array(groups), []
    for g in np.unique(group).tolist():
        members = np.flatnonzero(group == g)
        known = np.unique(np.concatenate([codes[begin[k] : end[k]] for k in members]))
        code = np.full(len(idf) + 1, len(known))
        code[known] = np.arange(len(known))
        weight, v, m = idf[known], len(known), len(members)
        rows = pa.table({"row": pa.array(np.arange(m)), "words": pa.array([code[codes[begin[k] : end[k]]] for k in members], pa.list_(pa.int64()))})
        passages = spark.createDataFrame(rows).coalesce(max(1, m // 64))  # each sends a sum of the basis's size

        def matrix(batch: pa.RecordBatch, weight: np.ndarray = weight) -> np.ndarray:
            a = np.zeros((len(batch), len(weight)))
            words = batch.column("words")
            np.add.at(a, (np.repeat(np.arange(len(batch)), np.diff(words.offsets)), np.asarray(words.flatten())), weight[np.asarray(words.flatten())])
            return a / np.maximum(1e-12, np.linalg.norm(a, axis=1, keepdims=True))

        k = min(v, m)
        mixer = np.random.default_rng(7).normal(size=(m, k))
        sketch = partition_sum(passages, lambda b: (matrix(b).T @ mixer[np.asarray(b.column("row"))]).ravel(), v * k)
        basis = np.linalg.qr(sketch.reshape(v, k))[0]

        def gram(batch: pa.RecordBatch, basis: np.ndarray = basis) -> np.ndarray:
            y = matrix(batch) @ basis
            return (y.T @ y).ravel()

        values, vectors = np.linalg.eigh(partition_sum(passages, gram, k * k).reshape(k, k))
        basis = basis @ vectors[:, values > 1e-9 * max(values[-1], 1e-12)]
        space = Space(code, np.vstack([basis, np.zeros((1, basis.shape[1]))]), item[members], np.zeros((0, 0)))
        space.passages = space.project(padded([codes[begin[k] : end[k]] for k in members], -1), np.append(idf, 0.0))
        out.append(space)
    return out


def bag_shares(own: np.ndarray, regions: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weight of the items' words that their regions hold, in any order, as shares; a column of each is a pair (see ``padded``)."""
    there = np.zeros(own.shape[1])
    for w in own:
        there += idf[w] * (regions == w).any(0)
    return there / idf[own].sum(0)


def common_shares(own: np.ndarray, regions: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weight of the longest common subsequences of words, as shares of the items' weights."""
    best = np.zeros((len(regions) + 1, own.shape[1]))
    for w in own:
        best[1:] = np.maximum(best[1:], best[:-1] + idf[w] * (regions == w))
        np.maximum.accumulate(best, axis=0, out=best)
    return best[-1] / idf[own].sum(0)


def padded(parts: list[np.ndarray], fill: int) -> np.ndarray:
    """Word lists as the columns of one array."""
    out = np.full((max(map(len, parts)), len(parts)), fill)
    for i, part in enumerate(parts):
        out[: len(part), i] = part
    return out


class Index:
    """The items of up to ``most`` words (and over half of it), by the rarest words of each."""

    def __init__(self, items: Items, idf: np.ndarray, members: np.ndarray, most: int):
        self.members, self.most = members, most
        word, item, share, self.need = [], [], [], np.zeros(len(members))
        for i, k in enumerate(members.tolist()):
            own, times = np.unique(items.words[k], return_counts=True)
            part = idf[own] * times
            order = np.argsort(-idf[own], kind="stable")
            whole = np.cumsum(part[order]) / part.sum()
            n = int(np.searchsorted(whole, 1 - REST)) + 1
            # What the words left out could add; a region with COMMON_ANSWERED of the item has the difference from the others.
            self.need[i] = COMMON_ANSWERED - (1 - whole[min(n, len(own)) - 1]) - 1e-9
            word.append(own[order[:n]])
            item.append(np.full(len(word[-1]), i))
            share.append(part[order[:n]] / part.sum())
        word = np.concatenate(word)
        order = np.argsort(word, kind="stable")
        self.item, self.share = np.concatenate(item)[order], np.concatenate(share)[order]
        # Postings of a word; the last entry is that of words outside the vocabulary.
        self.count = np.append(np.bincount(word, minlength=len(idf)), 0)
        self.start = np.cumsum(self.count) - self.count

    def near(self, codes: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(stretch, item) of every pair that can share COMMON_ANSWERED of the item's weight; a stretch is codes[low:high]."""
        at = np.flatnonzero(self.count[codes])
        a, b = np.searchsorted(at, low), np.searchsorted(at, high)
        cost = np.concatenate([[0], np.cumsum(self.count[codes[at]])])
        reach = np.cumsum(cost[b] - cost[a] + len(self.members))
        i = 0
        while i < len(low):
            j = max(i + 1, int(np.searchsorted(reach, (reach[i - 1] if i else 0) + BATCH, side="right")))
            n = b[i:j] - a[i:j]
            stretch = np.repeat(np.arange(j - i), n)
            word = codes[at[np.arange(n.sum()) + np.repeat(a[i:j] - (np.cumsum(n) - n), n)]]
            pairs = np.unique(stretch * len(self.count) + word)
            stretch, word = pairs // len(self.count), pairs % len(self.count)
            n = self.count[word]
            post = np.arange(n.sum()) + np.repeat(self.start[word] - (np.cumsum(n) - n), n)
            key = np.repeat(stretch, n) * len(self.members) + self.item[post]
            sums = np.bincount(key, self.share[post], (j - i) * len(self.members)).reshape(j - i, -1)
            s, k = np.nonzero(sums >= self.need)
            yield s + i, self.members[k]
            i = j


class Searcher:
    """Finds items in batches of texts."""

    def __init__(self, items: Items, idf: np.ndarray, spaces: list[Space]):
        self.items, self.idf, self.spaces = items, idf, spaces
        self.length = np.array([len(w) for w in items.words])
        most = np.array([max(STRIDE, 1 << (len(w) - 1).bit_length()) for w in items.words])
        self.indexes = [Index(items, idf, np.flatnonzero(most == m), int(m)) for m in np.unique(most)]

    def cosines(self, members: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Cosine in the latent spaces of each item with its window (a column): that of its nearest passage."""
        best = np.zeros(len(members))
        idf = np.append(self.idf, 0.0)
        for space in self.spaces:
            pairs = np.flatnonzero(np.isin(members, space.item))
            for i in range(0, len(pairs), 4096):
                some = pairs[i : i + 4096]
                near = space.project(columns[:, some], idf) @ space.passages.T
                own = space.item[None, :] == members[some, None]
                best[some] = np.maximum(best[some], np.where(own, near, 0.0).max(1))
        return best

    def find(self, texts: pa.Array) -> list[tuple[int, int, float, float, float]]:
        """(text, item, cosine, common share, answer share) of each confirmed pair, by its best window."""
        codes, first = _numbered(self.items, texts)
        if not len(codes):
            return []
        begin, end, doc = _windows(first)
        found: dict[tuple[int, int], tuple[float, float, float]] = {}
        for index in self.indexes:
            # A stretch holds the regions of some windows in a row.
            row = (begin - first[doc]) // max(STRIDE, index.most)
            fresh = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])))
            last = np.append(fresh[1:], len(doc)) - 1
            low = np.maximum(first[doc[fresh]], begin[fresh] - index.most)
            high = np.minimum(first[doc[fresh] + 1], end[last] + index.most)
            for stretches, members in index.near(codes, low, high):
                n = last[stretches] + 1 - fresh[stretches]
                window = np.repeat(fresh[stretches] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                item = np.repeat(members, n)
                step = max(1, BATCH // (4 * (WINDOW + 2 * index.most)))
                for i in range(0, len(window), step):
                    self.confirm(codes, first, begin, end, doc, window[i : i + step], item[i : i + step], found)
        return [(d, i, round(c, 4), round(s, 4), round(a, 4)) for (d, i), (s, c, a) in sorted(found.items())]

    def confirm(self, codes: np.ndarray, first: np.ndarray, begin: np.ndarray, end: np.ndarray, doc: np.ndarray, windows: np.ndarray, members: np.ndarray, found: dict) -> None:
        """Adds to ``found`` the pairs of window and item where the region around the window holds the item."""
        # The vocabulary's size stands for no word in items, -1 for other words and none in regions.
        idf = np.append(self.idf, 0.0)
        long = self.length[members]
        low, high = np.maximum(first[doc[windows]], begin[windows] - long), np.minimum(first[doc[windows] + 1], end[windows] + long)
        own = padded([self.items.words[i] for i in members], len(self.idf))
        regions = padded([codes[a:b] for a, b in zip(low, high)], -1)
        # words in common, in any order, bound the subsequence from above
        able = np.flatnonzero(bag_shares(own, regions, idf) >= COMMON_ANSWERED - 1e-9)
        # and the windows that remain must be near the item in its latent space
        if not len(able):
            return
        cosine = self.cosines(members[able], padded([codes[a:b] for a, b in zip(begin[windows[able]], end[windows[able]])], -1))
        able, cosine = able[cosine >= COSINE], cosine[cosine >= COSINE]
        if not len(able):
            return
        common = common_shares(own[:, able], regions[:, able], idf)
        for i in np.flatnonzero(common >= COMMON_ANSWERED):
            k, item, region = windows[able[i]], int(members[able[i]]), regions[:, able[i]]
            answer = self.items.answers[item]
            answered = float(self.idf[answer[np.isin(answer, region)]].sum() / max(1e-12, self.idf[answer].sum()))
            if common[i] >= COMMON or answered >= ANSWERED:
                pair = int(doc[k]), item
                found[pair] = max(found.get(pair, (0.0, 0.0, 0.0)), (float(common[i]), float(cosine[i]), answered))


def searchers(docs: DataFrame, benchmark: DataFrame) -> Iterator[Searcher]:
    """A searcher for each block of items, one after the other, with statistics over all documents."""
    spark = docs.sparkSession
    ship(spark)
    clean = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    blocks = max(1, -(-clean.count() // BLOCK_ITEMS))
    for block in range(blocks):
        items = Items([tuple(r) for r in clean.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()])
        if items.ids:
            df, n = document_frequencies(docs, items)
            idf = np.log((n + 1.0) / (df + 1.0)) + 1e-3
            yield Searcher(items, idf, latent_spaces(spark, items, idf))


_FOUND = "doc_id long, item_id long, cosine double, common double, answered double"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, common and answered of every document that holds an item."""

    def found(one: Searcher) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, part in chunks(batches):
                ids = part.column("doc_id").to_pylist()
                rows = [(ids[d], one.items.ids[i], c, s, a) for d, i, c, s, a in one.find(part.column("text"))]
                columns = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [pa.int64()] * 2 + [pa.float64()] * 3)], names=["doc_id", "item_id", "cosine", "common", "answered"])

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _FOUND)

    out = last = None
    for one in searchers(docs, benchmark):
        if last is not None:  # another block: the one before is done and written, and its searcher can go
            done = settle(found(last), "found")
            out = done if out is None else out.unionByName(done)
        last = one
    if last is None:
        return docs.sparkSession.createDataFrame([], _FOUND)
    return found(last) if out is None else out.unionByName(settle(found(last), "found"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns, judged where they stand."""

    def clean(rows: DataFrame, one: Searcher) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, part in chunks(batches):
                bad = {d for d, *_ in one.find(part.column("text"))}
                yield from part.filter(pa.array([i not in bad for i in range(len(part))])).to_batches()

        return rows.mapInArrow(run, rows.schema)

    out, last = docs, None
    for one in searchers(docs, benchmark):
        if last is not None:
            before, out = out, settle(clean(out, last), "clean")
            if before is not docs:
                forget(before)
        last = one
    return out if last is None else clean(out, last)
