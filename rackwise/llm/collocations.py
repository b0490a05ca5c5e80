"""Phrase collocation mining: n-grams of words counted by FM-indexes of shards, and scored by their weakest cut.

A shard is a block of about BLOCK bytes of pieces of texts, cut only between pieces, with its own numbers for the words of each
language. Three rounds go through the shards, each time with what has proved frequent over all of them:

1. words: each shard's distinct words are summed over all shards by buckets; the frequent ones get a number.
2. pairs: words that aren't frequent part the shard's text, as the ends of pieces do. A bidirectional FM-index extends the
   intervals of all its words by one symbol to the right; the pairs' local counts are summed over shards.
3. three words and more, up to the depth: from the intervals of the frequent pairs, patterns are extended at both ends. What is
   found from the left and from the right has a known first and last part, so only chains of frequent pairs go on; their local
   counts are summed over shards.

A phrase that occurs often enough holds only words and pairs that do, so nothing is lost. What moves between shards and buckets are
packed columns, one row for each shard and bucket; a phrase has one entry a shard, however common it is. The numbers of buckets follow
the measured numbers of entries, so that a bucket's size does not grow with the corpus.

Results: every phrase of two words up to the depth with its count, its largest count with one more word to the left and to the
right, and its scores. Nulls: a null text is empty, a null language is `und`; doc_id is not read, repeated rows count again. Very
long texts are cut at ends of pieces into several shards. Empty tables give empty results; other columns are left behind. Ties are
decided as the query's contract has it: equal scores by count, then by the phrase's bytes; equal cuts by the first.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rackwise.llm.common import blocks, partitions, stored, table
from rackwise.llm.fm_index import Patterns, TwoWayIndex

BLOCK = 8 << 20
DEPTH = 5
LEAST = 100
TOP = 2000
#: Entries that one bucket may expect, of phrases and of words; a bucket is held in one task.
ENTRIES = 4_000_000
WORDS = 500_000
#: Lower-case A-Z; the ends of pieces are line feeds, a tab is a space.
PIECES = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Numbers(dict):
    """Numbers by order of appearance; a full stop, which is in no word, stands for the end of a piece."""

    def __init__(self) -> None:
        self[b"."] = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def packed(values: np.ndarray, rising: bool = False) -> bytes:
    """An array as bytes, compressed; of rising values the steps."""
    raw = (np.diff(values, prepend=values.dtype.type(0)) if rising else values).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpacked(data: bytes, kind: str, rising: bool = False) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    values = np.frombuffer(pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b"", kind)
    return np.cumsum(values, dtype=values.dtype) if rising else values


def cut_pieces(text: bytes, most: int) -> Iterator[bytes]:
    """text in parts of about `most` bytes, cut at line feeds only."""
    start = 0
    while len(text) - start > most:
        end = text.rfind(b"\n", start, start + most)
        if end < 0:
            end = text.find(b"\n", start + most)
        if end < 0:
            break
        yield text[start:end]
        start = end + 1
    yield text[start:]


def shard_of(texts: dict[str, list[bytes]]) -> dict:
    """One shard: its words, those of each language together, with their counts, and the text as numbers; 0 between pieces."""
    words, ids, edges = [], [np.zeros(1, np.int64)], [0]
    for pieces in texts.values():
        number = _Numbers()
        found = b" . ".join(pieces).replace(b"\n", b" . ").split()
        own = np.fromiter(map(number.__getitem__, found), np.int64, len(found))
        own[own > 0] += edges[-1]
        ids += [own, np.zeros(1, np.int64)]
        words += list(number)[1:]
        edges.append(len(words))
    ids = np.concatenate(ids)
    counts = np.bincount(ids, minlength=len(words) + 1)[1:]
    totals = [int(counts[a:b].sum()) for a, b in zip(edges[:-1], edges[1:])]
    return {"langs": list(texts), "edges": edges, "totals": totals, "n_distinct": len(words), "words": packed(np.frombuffer(b"\n".join(words), np.uint8)), "counts": packed(counts.astype("<u4")), "ids": packed(ids.astype("<u4"))}


SHARD = pa.schema([("block", pa.int64()), ("langs", pa.list_(pa.string())), ("edges", pa.list_(pa.int64())), ("totals", pa.list_(pa.int64())), ("n_distinct", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary())])


def shards(docs: DataFrame, most: int = BLOCK) -> DataFrame:
    """One row a shard; to be stored, as its numbers belong to this reading."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k, held, size = TaskContext.get().partitionId(), 0, {}, 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"block": task << 32 | k} | shard_of(held)], SHARD)

        for part, texts in blocks(batches, most=most):
            for lang, text in zip(part.column("lang").to_pylist(), texts):
                for piece in cut_pieces(text.translate(PIECES), most):
                    held.setdefault(lang, []).append(piece)
                    size += len(piece)
                    if size >= most:
                        yield out()
                        k, held, size = k + 1, {}, 0
        if held:
            yield out()

    return rows.mapInArrow(run, "block long, langs array<string>, edges array<long>, totals array<long>, n_distinct long, words binary, counts binary, ids binary")


def _cut(order_by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last + 1) of each run of equal values."""
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(order_by)), bool), order_by[1:] != order_by[:-1])))
    return first, np.append(first[1:], len(order_by))


def vocabulary(parts: DataFrame, least: int, buckets: int) -> DataFrame:
    """Two kinds of rows: (gid, lang, word, f) for each word that occurs `least` times or more over all shards; and (block, locals,
    gids), the numbers in a shard of such words."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if not row["n_distinct"]:
                    continue
                words = unpacked(row["words"], "u1").tobytes().split(b"\n")
                counts = unpacked(row["counts"], "<u4")
                lang = np.repeat(np.arange(len(row["langs"])), np.diff(row["edges"])).astype("<u4")
                bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
                order = np.argsort(bucket, kind="stable")
                out = []
                for a, b in zip(*_cut(bucket[order])):
                    own = order[a:b]
                    text = b"\n".join([words[i] for i in own.tolist()])
                    out.append((int(bucket[own[0]]), row["block"], row["langs"], packed(lang[own], True), packed(own.astype("<u4"), True), packed(counts[own]), packed(np.frombuffer(text, np.uint8))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.list_(pa.string()), *[pa.binary()] * 4))], ["bucket", "block", "langs", "lang", "own", "n", "words"])

    def summed(t: pa.Table) -> pa.Table:
        bucket, numbers, seen, names = t.column("bucket")[0].as_py(), {}, [], []
        rows = t.select(["block", "langs", "lang", "own", "n", "words"]).to_pylist()
        for row in rows:
            words = unpacked(row["words"], "u1").tobytes().split(b"\n")
            ids = np.empty(len(words), np.int64)
            lang = unpacked(row["lang"], "<u4", True)
            for a, b in zip(*_cut(lang)):
                name = row["langs"][lang[a]]
                for i in range(a, b):
                    ids[i] = n = numbers.setdefault((name, words[i]), len(names))
                    if n == len(names):
                        names.append((name, words[i]))
            seen.append(ids)
        total = np.zeros(len(names), np.int64)
        for row, ids in zip(rows, seen):
            np.add.at(total, ids, unpacked(row["n"], "<u4").astype(np.int64))
        often = total >= least
        gid = np.where(often, (np.cumsum(often) - 1) * buckets + bucket + 1, 0)
        if len(gid) and int(gid.max()) >> 32:
            raise ValueError("more than 2**32 frequent words")
        out = [{"block": row["block"], "locals": packed(unpacked(row["own"], "<u4", True)[on] + np.uint32(1), True), "gids": packed(gid[ids[on]].astype("<u4"))} for row, ids in zip(rows, seen) if (on := often[ids]).any()]
        out += [{"gid": int(gid[i]), "lang": names[i][0], "word": names[i][1].decode(), "f": int(total[i])} for i in np.flatnonzero(often).tolist()]
        return pa.Table.from_pylist(out, pa.schema([("block", pa.int64()), ("locals", pa.binary()), ("gids", pa.binary()), ("gid", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("f", pa.int64())]))

    sent = parts.select("block", "langs", "edges", "n_distinct", "words", "counts").mapInArrow(dealt, "bucket int, block long, langs array<string>, lang binary, own binary, n binary, words binary")
    return sent.groupBy("bucket").applyInArrow(summed, "block long, locals binary, gids binary, gid long, lang string, word string, f long")


def _index(part: pa.Table, known: pa.Table, depth: int) -> tuple[TwoWayIndex, np.ndarray] | None:
    """The shard's index over its frequent words, and their numbers by symbol."""
    if not part.num_rows or not known.num_rows:
        return None
    rows = [r for r in known.select(["locals", "gids"]).to_pylist() if r["locals"] is not None]
    locals_, gids = (np.concatenate([unpacked(r[c], "<u4", c == "locals") for r in rows]) for c in ("locals", "gids"))
    order = np.argsort(gids)
    symbol = np.zeros(part.column("n_distinct")[0].as_py() + 1, np.int64)
    symbol[locals_[order]] = np.arange(1, len(gids) + 1)
    text = symbol[unpacked(part.column("ids")[0].as_py(), "<u4")]
    return TwoWayIndex(text[np.concatenate(([True], (text[1:] > 0) | (text[:-1] > 0)))], depth), np.concatenate(([0], gids[order])).astype(np.uint64)


class _Keys(NamedTuple):
    """Phrases of up to five words as three columns, two numbers of words to each; 0 where there is none."""

    high: np.ndarray
    middle: np.ndarray
    low: np.ndarray

    @classmethod
    def of(cls, symbols: list[np.ndarray], gids: np.ndarray) -> _Keys:
        g = [gids[s] for s in symbols] + [np.zeros(len(symbols[0]), np.uint64)] * (6 - len(symbols))
        return cls(*(g[i] << np.uint64(32) | g[i + 1] for i in (0, 2, 4)))

    def words(self) -> list[list[int]]:
        both = np.stack([x >> np.uint64(s) & np.uint64((1 << 32) - 1) for x in self for s in (32, 0)], axis=1).tolist()
        return [[w for w in row if w] for row in both]


SENT = "bucket int, block long, high binary, middle binary, low binary, n binary"
_SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), *((c, pa.binary()) for c in ("high", "middle", "low", "n"))])


def _dealt(block: int, found: list[Patterns], gids: np.ndarray, buckets: int) -> pa.Table:
    """A shard's phrases with their counts, a row for each bucket."""
    out = []
    if found := [p for p in found if len(p)]:
        keys = _Keys(*map(np.concatenate, zip(*(_Keys.of(p.symbols, gids) for p in found))))
        n = np.concatenate([p.n for p in found]).astype("<u4")
        mixed = (keys.high * _MIX ^ keys.middle + keys.low * _MIX) * _MIX
        bucket = (mixed >> np.uint64(33)).astype(np.int64) % buckets
        order = np.lexsort((keys.high, bucket))
        for a, b in zip(*_cut(bucket[order])):
            own = order[a:b]
            out.append({"bucket": int(bucket[own[0]]), "block": block, "high": packed(keys.high[own], True), "middle": packed(keys.middle[own]), "low": packed(keys.low[own]), "n": packed(n[own])})
    return pa.Table.from_pylist(out, _SENT)


def _pairs(part: pa.Table, known: pa.Table, depth: int, buckets: int) -> pa.Table:
    made = _index(part, known, depth)
    if not made:
        return _SENT.empty_table()
    index, gids = made
    return _dealt(part.column("block")[0].as_py(), [index.right(index.symbols())], gids, buckets)


def _longer(part: pa.Table, known: pa.Table, depth: int, buckets: int) -> pa.Table:
    keys = [unpacked(x, "<u8", True) for x in known.column("keys").to_pylist() if x is not None]
    if not part.num_rows or not keys:
        return _SENT.empty_table()
    index, gids = _index(part, known, depth)
    pair = np.concatenate(keys)
    first, second = (np.searchsorted(gids, x) for x in (pair >> np.uint64(32), pair & np.uint64((1 << 32) - 1)))
    before = index.ahead.before
    live, found = index.right_by(Patterns([first], before[first], before[first], before[first + 1] - before[first]), second), []
    for _ in range(2, depth):
        right = index.right(live)
        live = right[np.isin(right.low, index.left(live).low)]
        found.append(live)
    return _dealt(part.column("block")[0].as_py(), found, gids, buckets)


def _frequent(t: pa.Table, least: int, back: bool) -> pa.Table:
    """A bucket's phrases summed over shards: (words, f) of the frequent ones, and, if `back`, (block, keys): which of a shard's pairs they are."""
    rows = t.to_pylist()
    columns = [[unpacked(r[c], k, c == "high") for r in rows] for c, k in (("high", "<u8"), ("middle", "<u8"), ("low", "<u8"), ("n", "<u4"))]
    high, middle, low, n = map(np.concatenate, columns)
    order = np.argsort(high, kind="stable") if back else np.lexsort((low, middle, high))
    same = [x[order][1:] == x[order][:-1] for x in (high, middle, low)]
    first = np.flatnonzero(np.concatenate(([True], ~(same[0] & same[1] & same[2]))))
    total = np.add.reduceat(n[order].astype(np.int64), first)
    often = total >= least
    at = order[first[often]]
    out = [{"words": w, "f": f} for w, f in zip(_Keys(high[at], middle[at], low[at]).words(), total[often].tolist())]
    if back:
        kept = np.empty(len(order), bool)
        kept[order] = np.repeat(often, np.diff(np.append(first, len(order))))
        edges = np.cumsum([0, *map(len, columns[0])]).tolist()
        out += [{"block": r["block"], "keys": packed(keys[on], True)} for r, keys, a, b in zip(rows, columns[0], edges[:-1], edges[1:]) if (on := kept[a:b]).any()]
    return pa.Table.from_pylist(out, pa.schema([("block", pa.int64()), ("keys", pa.binary()), ("words", pa.list_(pa.int64())), ("f", pa.int64())]))


FOUND = "block long, keys binary, words array<long>, f long"


class Counts(NamedTuple):
    """words: (gid, lang, word, f); totals: (lang, n), all words; phrases: (words array of gids, f), two words and more."""

    words: DataFrame
    totals: DataFrame
    phrases: DataFrame


def phrase_counts(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, most: int = BLOCK, entries: int = ENTRIES) -> Counts:
    """All words and phrases of up to `depth` (5 at most) words that occur `least` times or more in one language."""
    if not 2 <= depth <= 5:
        raise ValueError("depth is 2 to 5")
    spark = docs.sparkSession
    parts = stored(shards(docs, most))
    sizes = parts.agg(F.coalesce(F.sum("n_distinct"), F.lit(0)).alias("distinct"), F.coalesce(F.sum(F.aggregate("totals", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)).alias("words")).first()
    some = lambda n, each: max(partitions(spark), math.ceil(n / each))
    totals = parts.select(F.inline(F.arrays_zip("langs", "totals"))).groupBy(F.col("langs").alias("lang")).agg(F.sum("totals").alias("n"))
    vocab = stored(vocabulary(parts, least, some(sizes.distinct, WORDS)))
    text = parts.select("block", "n_distinct", "ids").groupBy("block")
    known = vocab.filter("block IS NOT NULL").select("block", "locals", "gids")
    buckets = some(sizes.words, entries)
    sent = text.cogroup(known.groupBy("block")).applyInArrow(lambda a, b: _pairs(a, b, depth, buckets), SENT)
    pairs = stored(sent.groupBy("bucket").applyInArrow(lambda t: _frequent(t, least, True), FOUND))
    phrases = pairs.filter("block IS NULL").select("words", "f")
    if depth > 2:
        more = known.withColumn("keys", F.lit(None).cast("binary")).unionByName(pairs.filter("block IS NOT NULL").select("block", "keys"), allowMissingColumns=True)
        sent = text.cogroup(more.groupBy("block")).applyInArrow(lambda a, b: _longer(a, b, depth, buckets), SENT)
        longer = stored(sent.groupBy("bucket").applyInArrow(lambda t: _frequent(t, least, False), FOUND))
        phrases = phrases.unionByName(longer.filter("block IS NULL").select("words", "f"))
    return Counts(vocab.filter("block IS NULL").select("gid", "lang", "word", "f"), totals, phrases)


def collocations(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, **sizes: int) -> tuple[DataFrame, DataFrame]:
    """(phrases, words). phrases: (lang, words, a, most_left, most_right, cut, l, r, n, score) of every phrase; most_left and most_right
    are the largest counts of a phrase with one more word, null where none is frequent. words: (gid, word)."""
    found = phrase_counts(docs, depth, least, **sizes)
    phrases, c = found.phrases, F.col
    every = phrases.unionByName(found.words.select(F.array("gid").alias("words"), "f"))
    size = F.size("words")
    parts = phrases.filter(size > 2).select(F.inline(F.array(F.struct(F.slice("words", 1, size - 1).alias("words"), F.lit(None).cast("long").alias("left"), c("f").alias("right")), F.struct(F.slice("words", 2, size - 1).alias("words"), c("f").alias("left"), F.lit(None).cast("long").alias("right")))))
    longest = parts.groupBy("words").agg(F.max("left").alias("most_left"), F.max("right").alias("most_right"))
    named = phrases.withColumn("gid", c("words")[0]).join(found.words.select("gid", "lang"), "gid").join(found.totals, "lang")
    cuts = named.select("lang", "n", "words", c("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"))
    cuts = cuts.withColumn("first", F.slice("words", F.lit(1), c("cut"))).withColumn("rest", F.slice("words", c("cut") + 1, size - c("cut")))
    cuts = cuts.join(every.select(c("words").alias("first"), c("f").alias("l")), "first").join(every.select(c("words").alias("rest"), c("f").alias("r")), "rest")
    # Products of four counts: whole numbers of 38 digits.
    score = F.expr("CAST((CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0))) AS BIGINT)")
    least_cut = cuts.withColumn("score", score).groupBy("lang", "n", "words", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("by"))
    scored = least_cut.select("lang", "words", "a", "n", "by.*").join(longest, "words", "left")
    return scored.select("lang", "words", "a", "most_left", "most_right", "cut", "l", "r", "n", "score"), found.words.select("gid", "word")


def top_phrases(phrases: DataFrame, words: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first of each language, without phrases that occur only inside a longer one."""
    c = F.col
    own = phrases.filter((F.coalesce("most_left", F.lit(0)) < c("a")) & (F.coalesce("most_right", F.lit(0)) < c("a")))
    # Ties at the end stay until the phrases' texts decide.
    first = own.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).filter(c("place") <= top).drop("place")
    each = first.select("words", F.posexplode("words").alias("at", "gid")).join(words, "gid")
    text = each.groupBy("words").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("all")).select("words", F.array_join(c("all.word"), " ").alias("phrase"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return first.join(text, "words").withColumn("rank", rank.cast("long")).filter(c("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases, words = collocations(table(spark, sf_dir, "documents"))
    return top_phrases(stored(phrases), words)
