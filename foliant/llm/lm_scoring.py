"""Language-model scoring by deleted interpolation (operator 1).

1. Texts become chunks of token numbers, written once to the shared folder. Training documents
   are dealt by the hash of their id: most give counts, every ``HELD``th group is held out
   for the weights. Chunks hold documents of one kind.
2. Chunks send their distinct n-grams' hashes with counts to buckets (:mod:`packed`); a bucket
   sums them over the corpus and answers each chunk with the sums of its own n-grams.
3. P(w | v) = l2[b] c(v w)/c(v) + l1[b] c(w)/N + l0[b]/(V+1), where b is the bucket of the
   context's frequency, floor(log2(c(v) + 1)). The weights l[b] are learned by expectation
   maximisation on the held-out documents, whose n-grams are scored with the counts of the
   others: each round is a sum over them. What EM reads is a table of held-out events by
   (b, component probabilities to 1/8 of a binary order), of bounded size.
4. All documents are scored with those weights and the counts of all training documents.

Tokens: words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end, which is also the
context of the first word. Words and bigrams are told apart by 64-bit hashes.

Defined cases: a null or empty text is one end token; very long texts count whole; without
training documents, or without held-out ones, the weights are equal; repeated rows give
repeated rows and count each time; a null doc_id counts as the empty string for the fold;
other columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.packed import bucket_cuts, buckets_for, chunks, hashes, mix, pack, pack_sorted, unpack, unpack_sorted, words
from foliant.session import settle, ship

#: crc32(doc_id) % FOLDS is not TEST for training documents.
FOLDS, TEST = 7, 2
#: Of the training documents, one in HELD gives no counts to the EM, only events.
HELD = 6
#: Buckets of context frequency, rounds of EM, steps of a binary order in its table.
BUCKETS, ROUNDS, FINE = 24, 25, 8

_CHUNK = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("ids", pa.list_(pa.int64())), ("test", pa.list_(pa.bool_())), ("first", pa.binary()), ("codes", pa.binary()), ("hashes", pa.binary())])
_CHUNK_DDL = "chunk long, kind int, ids array<long>, test array<boolean>, first binary, codes binary, hashes binary"
_TEST, _COUNTED, _HELD = 0, 1, 2


def _n_grams(first: np.ndarray, codes: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens' keys in order (each document's words, then an end), the keys of bigrams that
    end at them, and every token's document."""
    lengths = np.diff(first)
    n = len(codes) + len(lengths)
    ends = np.cumsum(lengths + 1) - 1
    token = np.empty(n, np.uint64)
    is_end = np.zeros(n, bool)
    is_end[ends] = True
    token[~is_end] = own[codes]
    token[is_end] = _END
    before = np.empty(n, np.uint64)
    before[1:] = token[:-1]
    before[:1] = _END
    pair = mix(before * np.uint64(0x9E3779B97F4A7C15) + token)
    return token, pair, np.repeat(np.arange(len(lengths)), lengths + 1)


_END = np.uint64(0x5851F42D4C957F2D)


def _read(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _n_grams(unpack(row["first"]).astype(np.int64), unpack(row["codes"]).astype(np.int64), unpack(row["hashes"]))


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of one kind each from batches of (doc_id, text, kind)."""

    def row(number: int, kind: int, part: pa.Table) -> pa.RecordBatch:
        codes, vocabulary, first = words(part.column("text"))
        return pa.RecordBatch.from_pylist(
            [{"chunk": number, "kind": kind, "ids": part.column("doc_id").to_pylist(), "test": [kind == _TEST] * len(part), "first": pack(first), "codes": pack(codes), "hashes": pack(hashes(vocabulary))}], _CHUNK
        )

    for number, part in chunks(batches):
        kinds = np.asarray(part.column("kind"))
        for kind in np.unique(kinds).tolist():
            yield row(number * 4 + kind, kind, part.filter(pa.array(kinds == kind)))


def _parts(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """A chunk's distinct tokens and bigrams by bucket: keys, counts, and how many are tokens."""
    for batch in batches:
        for r in batch.to_pylist():
            token, pair, _ = _read(r)
            for order, keys in ((1, token), (2, pair)):
                distinct, n = np.unique(keys, return_counts=True)
                cuts = bucket_cuts(distinct, buckets)
                rows = [
                    {"bucket": b, "part": order, "chunk": r["chunk"], "kind": r["kind"], "keys": pack_sorted(distinct[i:j]), "n": pack(n[i:j])}
                    for b, (i, j) in enumerate(zip(cuts, cuts[1:]))
                    if j > i
                ]
                yield pa.RecordBatch.from_pylist(rows, _PART)


_PART = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())])
_PART_DDL = "bucket int, part int, chunk long, kind int, keys binary, n binary"
_BACK = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("kept", pa.binary()), ("all", pa.binary()), ("kinds", pa.int64()), ("kinds_kept", pa.int64())])
_BACK_DDL = "bucket int, part int, chunk long, kind int, kept binary, all binary, kinds long, kinds_kept long"


def _sum(bucket: pa.Table) -> pa.Table:
    """Counts over the corpus for the keys of one bucket, in each chunk's own order.

    ``kept``: over the documents that give counts; ``all``: over the held-out ones too. The
    first row also carries how many distinct keys each has.
    """
    rows = bucket.to_pylist()
    keys = [unpack_sorted(r["keys"]) for r in rows]
    n = np.concatenate([unpack(r["n"]).astype(np.int64) for r in rows])
    kind = np.repeat([r["kind"] for r in rows], [len(k) for k in keys])
    joined = np.concatenate(keys)
    order = np.argsort(joined, kind="stable")
    ordered = joined[order]
    group = np.cumsum(np.append(False, ordered[1:] != ordered[:-1]))
    sums = []
    for weight in (n * (kind == _COUNTED), n * (kind != _TEST)):
        total = np.bincount(group, weight[order]).astype(np.int64)
        back = np.empty(len(group), np.int64)
        back[order] = total[group]
        sums.append((back, int((total > 0).sum())))
    out, begin = [], 0
    for r, k in zip(rows, keys):
        part = slice(begin, begin + len(k))
        out.append({"bucket": r["bucket"], "part": r["part"], "chunk": r["chunk"], "kind": r["kind"], "kept": pack(sums[0][0][part]) if r["kind"] == _HELD else None, "all": pack(sums[1][0][part]), "kinds": sums[1][1] if not begin else 0, "kinds_kept": sums[0][1] if not begin else 0})
        begin += len(k)
    return pa.Table.from_pylist(out, _BACK)


def _counts(row: dict, which: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every token of a chunk: its count, its context's, the bigram's, and its document."""
    token, pair, doc = _read(row)
    found = []
    for order, keys in ((1, token), (2, pair)):
        sums = [unpack(x[which]).astype(np.int64) for x in sorted((x for x in row["sums"] if x["part"] == order), key=lambda x: x["bucket"])]
        distinct, inverse = np.unique(keys, return_inverse=True)
        found.append(np.concatenate(sums)[inverse])
    c, both = found
    ends = np.append(doc[1:] != doc[:-1], True)
    context = np.empty_like(c)
    context[1:] = c[:-1]
    first = np.append(True, ends[:-1])
    context[first] = c[np.flatnonzero(ends)[0]]  # the end's count: every chunk holds an end
    return c, context, both, doc


def frequency_bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(context + 1.0).astype(np.int64), BUCKETS - 1)


def _components(c: np.ndarray, context: np.ndarray, both: np.ndarray, n: int, v: int) -> np.ndarray:
    """The three probabilities that are mixed: of the bigram, of the word, of any word."""
    return np.stack([both / np.maximum(1, context), c / max(1, n), np.full(len(c), 1.0 / (v + 1))])


def learn_weights(events: pa.Table, v: int) -> np.ndarray:
    """EM over held-out events (bucket, step of the bigram's log-probability, of the word's, number).

    Steps are of 1/FINE of a binary order; -1 stands for probability 0. Returns (BUCKETS, 3).
    """
    weight = np.full((BUCKETS, 3), 1.0 / 3)
    if not len(events):
        return weight
    b, s2, s1, n = (events[c].to_numpy() for c in ("b", "s2", "s1", "n"))
    p = np.stack([np.where(s2 < 0, 0.0, 2.0 ** (-s2 / FINE)), np.where(s1 < 0, 0.0, 2.0 ** (-s1 / FINE)), np.full(len(b), 1.0 / (v + 1))])
    for _ in range(ROUNDS):
        share = weight[b].T * p
        share *= n / share.sum(0)
        total = np.stack([np.bincount(b, x, minlength=BUCKETS) for x in share], axis=1)
        # One event of each component keeps every weight above 0 and fills buckets without events.
        weight = (total + 1.0) / (total.sum(1, keepdims=True) + 3.0)
    return weight


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    ship(spark)
    said = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    fold = F.crc32(said.cast("binary")) % FOLDS
    # The part held out for EM is chosen by another hash than the test's.
    kind = F.when(fold == TEST, _TEST).when(F.pmod(F.xxhash64(said), F.lit(HELD)) == 0, _HELD).otherwise(_COUNTED)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", kind.cast("int").alias("kind"))
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = buckets_for(n_bytes)
    written = settle(docs.mapInArrow(_tokenise, _CHUNK_DDL), "chunks")
    parts = written.mapInArrow(lambda batches: _parts(batches, buckets), _PART_DDL)
    back = settle(parts.groupBy("bucket", "part").applyInArrow(_sum, _BACK_DDL), "sums")

    sized = written.where(F.col("kind") != _TEST).select("kind", F.size("ids").alias("d"), "first")
    v_all, v_kept = back.where("part = 1").agg(F.coalesce(F.sum("kinds"), F.lit(0)), F.coalesce(F.sum("kinds_kept"), F.lit(0))).first()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [int(unpack(x)[-1]) + d for x, d in zip(batch.column("first").to_pylist(), batch.column("d").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(n, pa.int64())], names=["kind", "n"])

    n_of = {r["kind"]: r["n"] for r in sized.mapInArrow(total, "kind int, n long").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    n_kept, n_all = n_of.get(_COUNTED, 0), sum(n_of.values())

    def joined(only_held: bool) -> DataFrame:
        own, sums = (x.where(F.col("kind") == _HELD) if only_held else x for x in (written, back))
        sums = sums.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "part", "kept" if only_held else "all")).alias("sums"))
        return own.join(sums, "chunk")

    def events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = 1 << 14
        for batch in batches:
            for r in batch.to_pylist():
                c, context, both, _ = _counts(r, "kept")
                p = _components(c, context, both, n_kept, v_kept)
                with np.errstate(divide="ignore"):
                    s = [np.where(x > 0, np.minimum(np.rint(-np.log2(x) * FINE), step - 2), -1).astype(np.int64) + 1 for x in p[:2]]
                keys, n = np.unique((frequency_bucket(context) * step + s[0]) * step + s[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys // step // step, keys // step % step - 1, keys % step - 1, n)], names=["b", "s2", "s1", "n"])

    grouped = joined(True).mapInArrow(events, "b long, s2 long, s1 long, n long").groupBy("b", "s2", "s1").agg(F.sum("n").alias("n"))
    weight = learn_weights(grouped.toArrow(), v_kept)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                c, context, both, doc = _counts(r, "all")
                mixed = (weight[frequency_bucket(context)].T * _components(c, context, both, n_all, v_all)).sum(0)
                m = len(r["ids"])
                base = np.log10((c + 1) / (n_all + 1.0 * (v_all + 1)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(r["ids"], pa.int64()), pa.array(r["test"], pa.bool_()), pa.array(np.bincount(doc, minlength=m)), pa.array(np.bincount(doc[c > 0], minlength=m)),
                        pa.array([n_all] * m, pa.int64()), pa.array(np.bincount(doc, base, minlength=m)), pa.array(np.bincount(doc, np.log10(mixed), minlength=m)),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return joined(False).mapInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
