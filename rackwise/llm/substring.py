"""Substring dedup: words covered by a window of WINDOW words whose sequence also starts anywhere else are removed.

Sharding: each window names an anchor, the 8-word gram in it with the least hash (leftmost among equals). Equal windows have
equal anchors, so all places of a repeated window meet under one anchor; neighbouring windows with one anchor make a
context of at most 62 words. Contexts are first counted by hash: those found twice or more are repeated as they stand. Where an anchor has several
different contexts, one of each goes to the anchor's shard; a compressed FM-index of the shard's contexts then answers backward
searches from every window end of the contexts that were found once; neighbouring windows that occur twice or more are reported as one
interval. The contexts of an anchor with more than HOT of them are cut into their windows, which go to shards by their own hash: equal windows
still meet, and no anchor, however common, fills one shard. The number of shards follows from the words of all contexts that are sent (about SHARD to an index).

Hashes of words, grams and contexts have 64 bits. Documents are dealt into blocks once and stored with their block and place: where Arrow
batches end depends on the columns sent, so dealing them anew could give other blocks. Nulls: a null text has no words; a null doc_id and repeated rows are kept, one result row for each.
A long text is one block of its own; other columns are left behind unless named; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackwise.llm.common import blocks, partitions, stored, table
from rackwise.llm.fm_index import FmIndex

WINDOW = 35
GRAM = 8
BLOCK = 2 << 20
#: Different contexts of an anchor beyond which they are dealt out window by window.
HOT = 1024
#: Words in an index: there are as many shards as the contexts that are sent need.
SHARD = 4 << 20
#: Hashes of words that a worker remembers; when there are more, it starts anew.
WORDS_KEPT = 100_000
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


class _Hashes(dict):
    """64-bit hashes of words, kept while they come again."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word, 7)
        return h


_WORDS = _Hashes()


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, first word of each text and one past the last)."""
    if len(_WORDS) > WORDS_KEPT:
        _WORDS.clear()
    parts = [np.fromiter(map(_WORDS.__getitem__, ws), np.uint64, len(ws)) for ws in (t.split() for t in texts)]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def anchored(words: np.ndarray, edges: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(anchor hash, context hash, first window, windows) of each run of windows with one anchor."""
    n = len(words)
    starts = np.concatenate([np.arange(a, b - window + 1) for a, b in zip(edges[:-1], edges[1:])]) if len(edges) > 1 else np.empty(0, np.int64)
    if not len(starts):
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 2
    powers = _powers(_MULTIPLIER, n + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * powers[:n], dtype=np.uint64)))
    back = _powers(_INVERSE, n + 1)
    gram = _mixed((sums[GRAM:] - sums[:-GRAM]) * back[: n - GRAM + 1])
    least, at, span = gram, np.arange(len(gram)), 1
    reach = window - GRAM + 1  # grams in a window
    while span < reach:
        by = min(span, reach - span)
        a, b = least[:-by], least[by:]
        right = b < a
        least, at, span = np.where(right, b, a), np.where(right, at[by:], at[:-by]), span + by
    anchor = at[starts]
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1))))
    count = np.diff(np.append(first, len(starts)))
    begin, p = starts[first], anchor[first]
    content = (sums[begin + count + window - 1] - sums[begin]) * back[begin]
    context = _mixed(content + (p - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + count.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return gram[p], context, begin, count


def in_blocks(docs: DataFrame, others: tuple[str, ...] = ()) -> DataFrame:
    """(block, place, first, doc_id, text binary, others): documents in numbered blocks; first: words of the block before the
    document. To be stored, not read twice."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, (part, texts) in enumerate(blocks(batches, most=BLOCK)):
            size = np.fromiter((len(t.split()) for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(texts), task << 32 | k)), pa.array(np.arange(len(texts), dtype=np.int32)), pa.array((np.cumsum(size) - size).astype(np.int32)), part.column("doc_id"), pa.array(texts, pa.binary()), *map(part.column, others)],
                ["block", "place", "first", "doc_id", "text", *others],
            )

    return rows.mapInArrow(run, "block long, place int, first int, doc_id long, text binary" + "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in others))


def contexts(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(anchor, context, block, at, n): runs of n windows from word `at` of the block; texts: in_blocks, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, most=BLOCK):
            words, edges = word_hashes(texts)
            anchor, context, at, n = anchored(words, edges, window)
            doc = np.searchsorted(edges, at, "right") - 1
            block, first = part.column("block").to_numpy()[doc], part.column("first").to_numpy()[doc]
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64)), pa.array(block), pa.array((at - edges[doc] + first).astype(np.int32)), pa.array(n.astype(np.int16))], ["anchor", "context", "block", "at", "n"])
        _WORDS.clear()

    return texts.select("block", "first", "text").mapInArrow(run, "anchor long, context long, block long, at int, n short")


def _ordered(t: pa.Table) -> list[bytes]:
    return t.sort_by("place").column("text").to_pylist()


def repeated_runs(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(block, at, n): runs of windows that occur again in texts (in_blocks, stored)."""
    found = stored(contexts(texts, window))
    each = found.groupBy("anchor", "context").agg(F.count("*").alias("m"), F.min(F.struct("block", "at", "n")).alias("one"))
    shared = each.groupBy("anchor").agg(F.count("*").alias("k"), F.sum("m").alias("t")).filter("t > 1")
    each = stored(each.join(shared, "anchor").select("anchor", "context", "m", "k", "one"))
    plain = found.join(each.filter("m > 1").select("anchor", "context"), ["anchor", "context"]).select("block", "at", "n")
    asked = each.filter("k > 1").select("anchor", (F.col("m") == 1).alias("asks"), (F.col("k") > HOT).alias("hot"), "one.block", "one.at", "one.n")

    def words_of(texts: pa.Table, wanted: pa.Table) -> pa.Table:
        words, _ = word_hashes(_ordered(texts)) if wanted.num_rows else (None, None)
        out = []
        for r in wanted.to_pylist():
            if not r["hot"]:
                out.append((r["anchor"], r["asks"], r["block"], r["at"], words[r["at"] : r["at"] + r["n"] + window - 1].tobytes()))
                continue
            for at in range(r["at"], r["at"] + r["n"]):
                own = words[at : at + window].tobytes()
                out.append((xxhash.xxh64_intdigest(own) - (1 << 63), r["asks"], r["block"], at, own))
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.binary())
        return pa.table({c: pa.array([r[k] for r in out], t) for k, (c, t) in enumerate(zip(("shard_key", "asks", "block", "at", "words"), kinds))})

    sent = texts.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(words_of, "shard_key long, asks boolean, block long, at int, words binary")
    words = asked.agg(F.sum(F.when(F.col("hot"), F.col("n").cast("long") * window).otherwise(F.col("n") + (window - 1)).cast("long")).alias("words")).first().words or 0
    shards = max(partitions(texts.sparkSession), -(-words // SHARD))

    def search(t: pa.Table) -> pa.Table:
        parts = [np.frombuffer(w, np.uint64) for w in t.column("words").to_pylist()]
        size = np.array([len(p) for p in parts])
        symbols, flat = np.unique(np.concatenate(parts), return_inverse=True)
        first = np.cumsum(size + 1) - size  # a zero before each context keeps them apart
        text = np.zeros(int(size.sum()) + len(parts) + 1, np.int64)
        text[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(len(flat))] = flat + 1
        asks = np.flatnonzero(t.column("asks").to_numpy(zero_copy_only=False))
        n = size[asks] - window + 1
        owner = np.repeat(asks, n)
        begin = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        index = FmIndex(text, window)
        hit = index.matching(text, begin + window - 1, window) == window if len(begin) else np.zeros(0, bool)
        owner, begin = owner[hit], begin[hit]
        head = np.flatnonzero(np.concatenate((np.ones(min(1, len(owner)), bool), (owner[1:] != owner[:-1]) | (begin[1:] != begin[:-1] + 1))))
        n = np.diff(np.append(head, len(owner)))
        owner, begin = owner[head], begin[head]
        at = t.column("at").to_numpy()[owner] + begin - first[owner]
        return pa.table({"block": pa.array(t.column("block").to_numpy()[owner]), "at": pa.array(at.astype(np.int32)), "n": pa.array(n.astype(np.int16))})

    searched = sent.withColumn("shard", F.pmod("shard_key", F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(search, "block long, at int, n short")
    return plain.unionByName(searched)


def substring_dedup(docs: DataFrame, window: int = WINDOW, others: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, text, others) for each row of docs; kept: the kept words joined by one space.
    `others` names further columns to pass on."""

    def finish(texts: pa.Table, runs: pa.Table) -> pa.Table:
        texts = texts.sort_by("place")
        words = [t.split() for t in texts.column("text").to_pylist()]
        size = np.array([len(w) for w in words], np.int64)
        edge = np.concatenate(([0], np.cumsum(size)))
        change = np.zeros(int(edge[-1]) + 1, np.int64)
        at, n = runs.column("at").to_numpy().astype(np.int64), runs.column("n").to_numpy().astype(np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + n + window - 1, -1)
        gone = np.cumsum(change)[:-1] > 0
        removed = np.add.reduceat(np.append(gone, False).astype(np.int64), edge[:-1]) * (size > 0) if len(words) else size
        kept = [b" ".join(w if not r else [x for x, g in zip(w, gone[a:b].tolist()) if not g]) for w, r, a, b in zip(words, removed.tolist(), edge[:-1].tolist(), edge[1:].tolist())]
        return pa.table({"doc_id": texts.column("doc_id"), "n_words": pa.array(size), "n_removed": pa.array(removed), "kept": pa.array(kept, pa.binary()).cast(pa.string()), "text": texts.column("text").cast(pa.string()), **{c: texts.column(c) for c in others}})

    dealt = stored(in_blocks(docs, others))
    runs = repeated_runs(dealt, window)
    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in others)
    return dealt.groupBy("block").cogroup(runs.groupBy("block")).applyInArrow(finish, "doc_id long, n_words long, n_removed long, kept string, text string" + kinds)


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
