"""Token counts (operator 6).

Pieces are counted once per distinct pre-token of the corpus, joined to the per-document
frequencies of pre-tokens, and summed; ids are never made. A chunk of documents sends, for
each bucket of the pre-tokens' hashes, its distinct pre-tokens with their documents and
frequencies. The bucket counts the pieces of each distinct pre-token once, and answers every
chunk with sums by document, which add up over buckets.

Defined cases: a null or empty text has 0 bytes and 0 tokens; special tokens' strings inside
texts count as the library's default does (one token each, the text around them split);
very long texts count whole; repeated rows give repeated rows; other columns are not read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.packed import bucket_cuts, buckets_for, chunks, hashes, pack, unpack
from foliant.llm.pretokens import pieces
from foliant.session import ship

_SENT = pa.schema(
    [("bucket", pa.int32()), ("chunk", pa.int64()), ("texts", pa.int32()), ("pieces", pa.list_(pa.string())), ("at", pa.binary()), ("docs", pa.binary()), ("n", pa.binary())]
    + [(k, pa.list_(pa.int64())) for k in ("ids", "sizes", "special")]
)
_SENT_DDL = "bucket int, chunk long, texts int, pieces array<string>, at binary, docs binary, n binary, ids array<long>, sizes array<long>, special array<long>"
_SUMMED = pa.schema([("chunk", pa.int64()), ("sums", pa.binary())] + [(k, pa.list_(pa.int64())) for k in ("ids", "sizes", "special")])
_SUMMED_DDL = "chunk long, sums binary, ids array<long>, sizes array<long>, special array<long>"


@lru_cache(maxsize=2)
def library(path: str):
    """The tokenizer of a ``.json`` file, on one thread, and its special strings."""
    os.environ |= {"TOKENIZERS_PARALLELISM": "false", "RAYON_NUM_THREADS": "1"}
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    return own, [t.content for t in own.get_added_tokens_decoder().values() if t.special]


def _split_specials(texts: list[str], specials: list[str]) -> tuple[list[str], np.ndarray, list[int]]:
    """Parts between special strings, each part's text, and special tokens per text."""
    special = [0] * len(texts)
    if not any(s in t for t in texts for s in specials):
        return texts, np.arange(len(texts)), special
    joined = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True))))
    parts, owner = [], []
    for i, text in enumerate(texts):
        own = joined.split(text)
        special[i] = len(own) - 1
        parts += own
        owner += [i] * len(own)
    return parts, np.array(owner), special


def _send(number: int, part: pa.Table, buckets: int, specials: list[str]) -> pa.RecordBatch:
    """What a chunk sends: a row per bucket; one of them carries the documents' own columns."""
    texts = [x or "" for x in part.column("text").to_pylist()]
    split, owner, special = _split_specials(texts, specials)
    found, first = pieces(split)
    coded = pa.array(found, pa.string()).dictionary_encode()
    keys = hashes(coded.dictionary)
    order = np.argsort(keys, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    doc_of = np.repeat(owner, np.diff(first))
    pairs, n = np.unique(place[np.asarray(coded.indices)] * len(texts) + doc_of, return_counts=True)
    piece, doc = pairs // len(texts), pairs % len(texts)
    vocabulary = coded.dictionary.take(pa.array(order))
    cuts = bucket_cuts(keys[order], buckets)
    begin = np.searchsorted(piece, cuts)
    rows = []
    for b in range(buckets):
        i, j, lo, hi = cuts[b], cuts[b + 1], begin[b], begin[b + 1]
        own = b == number % buckets
        if i < j or own:
            rows.append({
                "bucket": b, "chunk": number, "texts": len(texts), "pieces": vocabulary.slice(i, j - i).to_pylist(),
                "at": pack(np.searchsorted(piece[lo:hi], np.arange(i, j + 1))), "docs": pack(doc[lo:hi]), "n": pack(n[lo:hi]),
                "ids": part.column("doc_id").to_pylist() if own else None,
                "sizes": [len(x.encode()) for x in texts] if own else None, "special": special if own else None,
            })
    return pa.RecordBatch.from_pylist(rows, _SENT)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of ``docs``."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = buckets_for(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part in chunks(batches):
            yield _send(number, part, buckets, library(vocabulary)[1])

    def answer(bucket: pa.Table) -> pa.Table:
        own, _ = library(vocabulary)
        rows = bucket.to_pylist()
        known: dict[str, int] = dict.fromkeys(p for r in rows for p in r["pieces"])
        asked = list(known)
        for i in range(0, len(asked), 20_000):
            for piece, said in zip(asked[i : i + 20_000], own.encode_batch(asked[i : i + 20_000], add_special_tokens=False)):
                known[piece] = len(said.ids)
        out = []
        for r in rows:
            each = np.fromiter(map(known.__getitem__, r["pieces"]), np.int64, len(r["pieces"]))
            worth = np.repeat(each, np.diff(unpack(r["at"]).astype(np.int64))) * unpack(r["n"])
            sums = np.bincount(unpack(r["docs"]), worth, minlength=r["texts"]).astype(np.int64)
            out.append({"chunk": r["chunk"], "sums": pack(sums), "ids": r["ids"], "sizes": r["sizes"], "special": r["special"]})
        return pa.Table.from_pylist(out, _SUMMED)

    def finish(chunk: pa.Table) -> pa.Table:
        total = sum(unpack(x).astype(np.int64) for x in chunk.column("sums").to_pylist())
        own = next(r for r in chunk.select(["ids", "sizes", "special"]).to_pylist() if r["ids"] is not None)
        tokens = total + np.array(own["special"], np.int64)
        return pa.table({"doc_id": pa.array(own["ids"], pa.int64()), "n_bytes": pa.array(own["sizes"], pa.int64()), "n_tokens": tokens, "over_limit": tokens > limit})

    sent = docs.mapInArrow(send, _SENT_DDL)
    summed = sent.groupBy("bucket").applyInArrow(answer, _SUMMED_DDL)
    return summed.groupBy("chunk").applyInArrow(finish, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
