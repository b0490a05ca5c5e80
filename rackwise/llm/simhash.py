"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked within a Hamming distance by pigeonring filtering.

Pigeonring: cut the 64 bits into m segments on a ring, d_i the differences in segment i. If all d_i sum to at most t, some
start i has, for each chain length l, d_i + ... + d_(i+l-1) <= l*t/m. With t = 4 and m = 5 the budgets are 0, 1, 2, 3, 4: a
segment that agrees, followed by one with at most one difference. Each distinct fingerprint is keyed, for each start, by the
agreeing segment and the next one with one bit masked (64 keys in all): two fingerprints whose chain fits
share a key. Longer chains are checked before the full Hamming distance.

Nulls: a null text is empty; an empty text has fingerprint zero and links like any other. A null doc_id is kept, and is
never the smallest id unless its component has no other. Repeated rows are kept, one result row for each.
Long texts are read whole; a bit that exactly half of the shingles set is 0; columns with other names are never read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackwise.llm.common import blocks, components, id_text, stored, table

SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
DISTANCE = 4
SHINGLE = 4
SEED = 42
#: Fingerprints under one key beyond which the key is refined by the other segments, in another shuffle.
LONG_RUN = 4096


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist())]
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        part = np.array(hashes[at : at + 65536], np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(row, doc_id, fp long) for each row; row: a number for each row, the same whenever the same table is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches):
            fps = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), pa.array(fps)], ["row", "doc_id", "fp"])

    return id_text(docs).withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, "row long, doc_id long, fp long")


def keys_of(fps: np.ndarray) -> Iterator[np.ndarray]:
    """For each start and masked bit, the key of each fingerprint."""
    for i, (at, size) in enumerate(SEGMENTS):
        to, width = SEGMENTS[(i + 1) % len(SEGMENTS)]
        same = (fps >> np.uint64(at)) & np.uint64((1 << size) - 1)
        near = (fps >> np.uint64(to)) & np.uint64((1 << width) - 1)
        for bit in range(width):
            yield np.uint64(i << 40 | bit << 32) | same << np.uint64(13) | near & np.uint64(~(1 << bit) & (1 << width) - 1)


def refined(key: int, fps: np.ndarray) -> Iterator[np.ndarray]:
    """Finer keys for fingerprints that share `key`: one of the other three segments has at most one difference."""
    start = key >> 40 & 7
    for k in range(2, len(SEGMENTS)):
        at, width = SEGMENTS[(start + k) % len(SEGMENTS)]
        part = (fps >> np.uint64(at)) & np.uint64((1 << width) - 1)
        for bit in range(width):
            masked = part & np.uint64(~(1 << bit) & (1 << width) - 1)
            mixed = (masked | np.uint64(k << 20 | bit << 16)) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1)
            yield mixed


def near(one, many: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    return np.bitwise_count(many ^ one) <= distance


def forest(fps: np.ndarray) -> tuple[list, list]:
    """Links that connect whatever is connected among fps: breadth first, each fingerprint against those not yet reached."""
    a, b = [], []
    left = np.unique(fps)
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = near(x, left)
            if hit.any():
                found = left[hit]
                a += [x] * len(found)
                b += found.tolist()
                queue += list(found)
                left = left[~hit]
    return a, b


OUT = "kind int, a long, b long"


def _out(kind: int, a, b) -> pa.RecordBatch:
    a, b = np.asarray(a, np.uint64).view(np.int64), np.asarray(b, np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], ["kind", "a", "b"])


def link_runs(longest: int | None):
    """A task over (key, fp) sorted by key: links (kind 0); rows of runs over `longest` go on with finer keys (kind 1)."""

    def chain(key: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Budgets of the chains of 3 and 4 segments, from the start in the key."""
        start, ok, sofar = key >> np.uint64(40) & np.uint64(7), np.ones(len(x), bool), np.zeros(len(x), np.int64)
        for i in range(len(SEGMENTS)):
            mine, sofar[:] = start == i, 0
            for k in range(4):
                at, width = SEGMENTS[(i + k) % len(SEGMENTS)]
                sofar += np.bitwise_count(x >> np.uint64(at) & np.uint64((1 << width) - 1))
                ok &= ~mine | (sofar <= max(k, 1))
        return ok

    def spent(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        size = np.diff(edge)
        for n in range(1, min(8, int(size.max()))):
            i = np.flatnonzero(size <= 8)
            i = np.concatenate([edge[i] + k for k in range(8 - n)]) if len(i) else i
            i = i[i + n < len(keys)]
            i = i[keys[i] == keys[i + n]]
            if longest is not None:
                i = i[chain(keys[i], fps[i] ^ fps[i + n])]
            i = i[near(fps[i], fps[i + n])]
            if len(i):
                yield _out(0, fps[i], fps[i + n])
        for k in np.flatnonzero(size > 8):
            run = fps[edge[k] : edge[k + 1]]
            yield _out(0, *forest(run))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, np.uint64), np.empty(0, np.uint64)
        passing = None
        for batch in batches:
            k, f = (batch.column(c).to_numpy().view(np.uint64) for c in ("key", "fp"))
            if passing is not None:
                on = k == passing
                for finer in refined(int(passing), f[on]):
                    yield _out(1, finer, f[on])
                k, f = k[~on], f[~on]
                if not len(k):
                    continue
                passing = None
            keys, fps = np.concatenate((keys, k)), np.concatenate((fps, f))
            if not len(keys):
                continue
            tail = int(np.searchsorted(keys.view(np.int64), keys.view(np.int64)[-1]))
            if tail:
                yield from spent(keys[:tail], fps[:tail])
            keys, fps = keys[tail:], fps[tail:]
            if longest is not None and len(keys) > longest:
                passing = keys[0]
                for finer in refined(int(passing), fps):
                    yield _out(1, finer, fps)
                keys, fps = keys[:0], fps[:0]
        if len(keys):
            yield from spent(keys, fps)

    return run


def links(nodes: DataFrame, longest: int = LONG_RUN) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of nodes(fp): at most DISTANCE differing bits. Not every pair of a
    large group is given, but every two fingerprints that links join are joined by a path of these."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for key in keys_of(fps):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fps.view(np.int64))], ["key", "fp"])

    first = nodes.select("fp").mapInArrow(keyed, "key long, fp long")
    first = stored(first.repartition("key").sortWithinPartitions("key").mapInArrow(link_runs(longest), OUT))
    again = first.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    again = again.repartition("key").sortWithinPartitions("key").mapInArrow(link_runs(None), OUT)
    return first.filter("kind = 0").unionByName(again).select("a", "b").filter("a <> b").distinct()


def _grouped(docs: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprint of each row, and (fp, first) of each fingerprint: the row of its component with the least doc_id, nulls last."""
    each = stored(fingerprints(docs, shingle))
    nodes = each.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")).alias("rep"))
    roots = components(links(nodes))
    labelled = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("rep").alias("first"))
    return each, labelled.join(least, "root").select("fp", "first")


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long, component_id) for each row of docs(doc_id, text)."""
    each, groups = _grouped(docs, shingle)
    return each.join(groups.select("fp", F.col("first.doc_id").alias("component_id")), "fp").select("doc_id", "fp", "component_id")


def one_of_each_group(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The row with the least doc_id (nulls last) of each group of near copies, with all columns. Rows are told apart by where they are
    read, not by doc_id: docs must be a stored table."""
    _, groups = _grouped(docs, shingle)
    kept = groups.select(F.col("first.row").alias("_kept_row")).distinct()
    return docs.withColumn("_row", F.monotonically_increasing_id()).join(kept, F.col("_row") == F.col("_kept_row"), "left_semi").select(*docs.columns)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
