"""Katz backoff n-grams of any order: Good-Turing discounted counts with exactly normalised backoff weights, over a whole corpus.

    P(w | h) = d(c) c / (c(h) + 1)          where c = c(h w) > 0
             = alpha(h) P(w | h')            otherwise; h' is h without its first word
    P(w)     = d1(c) c / (N + 1)             where c = c(w) > 0, and what these leave for all unknown words together

alpha(h) = (1 - sum of the first line over the words seen after h) / (1 - sum of P(w | h') over the same words), so that each
history's probabilities sum to one; a history never seen has alpha 1. The one added to each total is a back-off event: it leaves some mass where no count is low
enough to be discounted. A text starts with a start mark, so its first token's history is that mark, whatever the order; the end is a token. Good-Turing ratios, of
each order its own, hold for counts to 5; where counts of counts give a ratio outside (0, 1), absolute discounting by one half stands in.

Blocks of documents are the unit that moves. (1) Each block's distinct n-grams of each length, as 64-bit hashes with training
counts, go to buckets by hash, where they are summed; the count tables are stored by bucket, with each block's share of them. (2) Blocks meet
their shares and evaluate each token: the count of its longest n-gram, else the next shorter's, down to the word's. Of every n-gram one block is in charge and
hands its share in the history's backoff weight on, together with the block's documents that backed off from each history. (3) Histories' weights are
summed, normalised, stored by bucket and sent back as sums by document. Very common n-grams have one entry a block throughout.

Counts and weights by bucket are the model (`Model`): it can be saved, loaded and asked for the scores of any other texts. Their
blocks send their distinct n-grams to the buckets, where counts and weights are looked up, and evaluate each token from the answers.

Blocks of documents are read three times: rows that come from a shuffle are to be stored first. Nulls: a null text is empty (only the end); a null
doc_id is not held out. Repeated rows are kept and counted. Without training tokens every score is 0.
A long text is one block of its own; columns with other names are never read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackwise.llm.common import blocks, id_text, partitions, stored, table

BLOCK = 24 << 20
K = 5
END_HASH, START_HASH = 0x0123456789ABCDEF, 0xFEDCBA9876543210
#: n-grams are told apart by their length less one.
WORDS = 0
#: Longest n-grams of the registered query.
ORDER = 2


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def encode_block(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the block's distinct tokens in order, all texts' tokens as places among them, tokens of each text)."""
    number = _Numbers({b"\n": 0, b"\t": 1})  # the end and the start: no word has these bytes
    get = number.__getitem__
    parts = []
    for t in texts:
        ws = t.lower().split()
        ids = np.zeros(len(ws) + 1, np.int64)
        ids[:-1] = np.fromiter(map(get, ws), np.int64, len(ws))
        parts.append(ids)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, 3) for w in number), np.uint64, len(number))
    hashes[:2] = END_HASH, START_HASH
    order = np.argsort(hashes)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return hashes[order], place[np.concatenate(parts)] if parts else np.empty(0, np.int64), np.array([len(p) for p in parts], np.int64)


def histories(hashes: np.ndarray, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[np.cumsum(lengths) - lengths] = np.searchsorted(hashes, np.uint64(START_HASH))
    return out


def longer_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of n-grams from those of all but the last word, and of the last word."""
    x = left * np.uint64(0x9E3779B97F4A7C15) + right * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(30)


@dataclass(frozen=True)
class Grams:
    """A block's n-grams of one length. keys: distinct hashes, rising; place: of the n-gram that ends at each token, -1 where the text's start is
    too near; first: a token that ends each of the keys; history: place of each token's history among the n-grams one shorter."""

    keys: np.ndarray
    place: np.ndarray
    first: np.ndarray
    history: np.ndarray


def grams(hashes: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, order: int) -> list[Grams]:
    """The block's words, pairs, ... to n-grams of `order` words. The start mark may be the first word of any of them."""
    none = np.empty(0, np.int64)
    out, history, own = [Grams(hashes, tokens, none, none)], histories(hashes, tokens, lengths), hashes[tokens]
    left, at = hashes[history], np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    for k in range(1, order):
        some = np.flatnonzero(at >= k - 1)
        own_keys = longer_keys(left[some], own[some])
        keys, first, inverse = np.unique(own_keys, return_index=True, return_inverse=True)
        place = np.full(len(tokens), -1)
        place[some] = inverse
        out.append(Grams(keys, place, some[first], history))
        if k + 1 < order:
            history = np.concatenate(([-1], place[:-1]))
            left = np.zeros(len(tokens), np.uint64)
            left[some] = own_keys
            left = np.concatenate((left[:1], left[:-1]))
    return out


def bucket_edges(sorted_keys: np.ndarray, buckets: int) -> np.ndarray:
    """First key of each bucket; buckets are equal ranges of hashes."""
    limits = np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)
    return np.append(np.searchsorted(sorted_keys, limits), len(sorted_keys))


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as the first and the differences, of 6 bytes where all fit."""
    gaps = np.diff(keys)
    head = keys[:1].astype("<u8").tobytes()
    if len(gaps) and int(gaps.max()) >> 48:
        return head + b"\x08" + gaps.astype("<u8").tobytes()
    return head + b"\x06" + np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack_keys(raw: bytes) -> np.ndarray:
    width = raw[8]
    body = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, width)
    gaps = np.zeros((len(body), 8), np.uint8)
    gaps[:, :width] = body
    return np.cumsum(np.concatenate((np.frombuffer(raw, "<u8", 1), gaps.reshape(-1).view("<u8"))), dtype=np.uint64)


def pack_counts(n: np.ndarray) -> bytes:
    """A byte each; 255 and more follow as 64 bits."""
    big = n >= 255
    return len(n).to_bytes(8, "little") + np.where(big, 255, n).astype(np.uint8).tobytes() + n[big].astype("<i8").tobytes()


def unpack_counts(raw: bytes) -> np.ndarray:
    size = int.from_bytes(raw[:8], "little")
    out = np.frombuffer(raw, np.uint8, size, 8).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<i8", offset=8 + size)
    return out


def discounts(n: list[int]) -> np.ndarray:
    """d(c) for c up to K (1 beyond), from the counts of counts n[1..K+1]."""
    d = np.ones(K + 1)
    tail = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        ratio = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail < 1 else 0.0
        d[r] = ratio if 0 < ratio < 1 else (r - 0.5) / r
    return d


def _zipped(x: np.ndarray, kind: str) -> bytes:
    return len(x).to_bytes(8, "little") + pa.compress(x.astype(kind).tobytes(), codec="zstd", asbytes=True)


def _unzipped(raw: bytes, kind: str) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    return np.frombuffer(pa.decompress(raw[8:], n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    task = TaskContext.get().partitionId()
    for k, (part, texts) in enumerate(blocks(batches, most=BLOCK)):
        yield task << 32 | k, part, *encode_block(texts)


def corpus(docs: DataFrame, held_out) -> DataFrame:
    return id_text(docs).withColumn("held_out", F.coalesce(held_out, F.lit(False)))


SENT = "bucket int, block long, kind int, keys binary, counts binary"


def block_counts(docs: DataFrame, buckets: int, order: int = ORDER) -> DataFrame:
    """Each block's distinct n-grams with training counts, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, part, hashes, tokens, lengths in _rows(batches):
            train = ~part.column("held_out").to_numpy(zero_copy_only=False)
            weight = np.repeat(train, lengths)
            words = np.bincount(tokens[weight], minlength=len(hashes))
            words[np.searchsorted(hashes, np.uint64(START_HASH))] = int(train.sum())
            rows = []
            for kind, g in enumerate(grams(hashes, tokens, lengths, order)):
                held, n = g.keys, words if kind == WORDS else np.bincount(g.place[weight & (g.place >= 0)], minlength=len(g.keys))
                edge = bucket_edges(held, buckets).tolist()
                rows += [(b, block, kind, pack_keys(held[i:j]), pack_counts(n[i:j])) for b, (i, j) in enumerate(zip(edge, edge[1:])) if j > i]
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], [c.split()[0] for c in SENT.split(", ")])

    return docs.mapInArrow(run, SENT)


STATS = ["total", "types", *(f"n{r}" for r in range(1, K + 2))]
SHARE = "block long, kind int, bucket int, keys binary, counts binary, charge binary, " + ", ".join(f"{c} long" for c in STATS)
MODEL = -1  # in place of a block: the row is the bucket's part of the model


def _counted(t: pa.Table) -> pa.Table:
    """A bucket's sums: one row of keys and counts for the model, and each block's share: total counts in the block's order,
    and of which the block is in charge."""
    rows = t.sort_by("block").to_pylist()
    keys, counts = [unpack_keys(r["keys"]) for r in rows], [unpack_counts(r["counts"]) for r in rows]
    size = np.array([len(k) for k in keys])
    flat, own = np.concatenate(keys), np.concatenate(counts)
    distinct, inverse = np.unique(flat, return_inverse=True)
    total = np.bincount(inverse, weights=own, minlength=len(distinct)).astype(np.int64)
    trained = np.flatnonzero(own)
    _, first = np.unique(inverse[trained], return_index=True)
    charge = np.zeros(len(flat), bool)
    charge[trained[first]] = True
    out, at = [], 0
    for r, n in zip(rows, size.tolist()):
        mine, lead = total[inverse[at : at + n]], charge[at : at + n]
        counted = mine[lead & (flat[at : at + n] != np.uint64(START_HASH)) if r["kind"] == WORDS else lead]
        stats = [int(counted.sum()), len(counted), *np.bincount(np.minimum(counted, K + 2), minlength=K + 3)[1 : K + 2].tolist()]
        out.append((r["block"], r["kind"], r["bucket"], b"", pack_counts(mine), np.packbits(lead).tobytes(), *stats))
        at += n
    known = total > 0
    if known.any():
        out.append((MODEL, rows[0]["kind"], rows[0]["bucket"], pack_keys(distinct[known]), pack_counts(total[known]), b"", *[0] * len(STATS)))
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()] + [pa.int64()] * len(STATS)
    return pa.table({c.split()[0]: pa.array(v, k) for c, v, k in zip(SHARE.split(", "), zip(*out), kinds)})


class Level:
    """Totals and discounts of one order."""

    def __init__(self, row) -> None:
        n = [0, *((row[f"n{r}"] if row else 0) or 0 for r in range(1, K + 2))]
        self.total, self.types = ((row["total"], row["types"]) if row else (0, 0))
        self.d = discounts(n)
        self.left = sum(n[r] * r * (1 - self.d[r]) for r in range(1, K + 1))

    def discounted(self, c: np.ndarray) -> np.ndarray:
        return self.d[np.where(c > K, 0, c)] * c  # d[0] is 1


TEXTS = "block long, doc_ids binary, null_ids binary, held binary, lengths binary, hashes binary, tokens binary"
NEXT = "bucket int, kind int, block long, hashes binary, low binary, seen binary, mass binary, pairs binary, at binary, times binary, docs binary"


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, part, hashes, tokens, lengths in _rows(batches):
        ids = part.column("doc_id")
        row = [block, _zipped(ids.fill_null(0).to_numpy(), "<i8"), np.packbits(ids.is_null().to_numpy(zero_copy_only=False)).tobytes(), np.packbits(part.column("held_out").to_numpy(zero_copy_only=False)).tobytes(), _zipped(lengths, "<u4"), _zipped(hashes, "<u8"), _zipped(tokens, "<u4")]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int64()] + [pa.binary()] * 6)], [c.split()[0] for c in TEXTS.split(", ")])


def _flags(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


ASKED = "block long, kind int, bucket int, counts binary, alpha binary"


@dataclass(frozen=True)
class Model:
    """A trained model. counts(kind, bucket, keys, counts): a row for each kind of n-gram and bucket, with the sorted hashes and
    their counts; weights(kind, bucket, keys, alpha): histories' hashes and log10 backoff weights; levels(kind, buckets and STATS):
    totals and counts of counts. Buckets are equal ranges of hashes."""

    counts: DataFrame
    weights: DataFrame
    levels: DataFrame

    def save(self, path: str) -> None:
        self.counts.write.partitionBy("kind").parquet(f"{path}/counts")
        self.weights.write.partitionBy("kind").parquet(f"{path}/weights")
        self.levels.write.parquet(f"{path}/levels")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        # Tables of no rows are folders without files.
        counts = spark.read.schema("bucket int, keys binary, counts binary, kind int").parquet(f"{path}/counts")
        weights = spark.read.schema("bucket int, keys binary, alpha binary, kind int").parquet(f"{path}/weights")
        return cls(counts, weights, spark.read.parquet(f"{path}/levels"))

    def scores(self, docs: DataFrame) -> DataFrame:
        """The columns of `scores` for the texts of any docs(doc_id, text), none of which is learned from: held_out is true."""
        sums = {r.kind: r for r in self.levels.collect()}
        order = 1 + max(sums, default=WORDS)
        levels = [Level(sums.get(kind)) for kind in range(order)]
        buckets = sums[WORDS].buckets if WORDS in sums else 1
        docs = corpus(docs, F.lit(True))

        def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, _, hashes, tokens, lengths in _rows(batches):
                rows = []
                for kind, g in enumerate(grams(hashes, tokens, lengths, order)):
                    edge = bucket_edges(g.keys, buckets).tolist()
                    rows += [(block, kind, b, pack_keys(g.keys[i:j])) for b, (i, j) in enumerate(zip(edge, edge[1:])) if j > i]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["block", "kind", "bucket", "keys"])

        def answer(questions: pa.Table, known: pa.Table) -> pa.Table:
            counts, alphas = ([r for r in known.to_pylist() if r["counts"] and not r["alpha"]], [r for r in known.to_pylist() if r["alpha"]])

            def look_up(keys: np.ndarray, rows: list[dict], values, kind: type) -> np.ndarray:
                found = np.zeros(len(keys), kind)
                for r in rows:
                    have = unpack_keys(r["keys"])
                    at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                    same = have[at] == keys
                    found[same] = values(r)[at[same]]
                return found

            out = []
            for r in questions.to_pylist():
                keys = unpack_keys(r["keys"])
                alpha = look_up(keys, alphas, lambda x: np.frombuffer(x["alpha"], np.float64), np.float64) if r["kind"] < order - 1 else np.zeros(0)
                out.append((r["block"], r["kind"], r["bucket"], pack_counts(look_up(keys, counts, lambda x: unpack_counts(x["counts"]), np.int64)), alpha.tobytes()))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            return pa.table({c.split()[0]: pa.array([r[k] for r in out], t) for k, (c, t) in enumerate(zip(ASKED.split(", "), kinds))})

        def evaluate(blocks_: pa.Table, answers: pa.Table) -> pa.Table:
            replies = answers.sort_by("bucket").to_pylist()
            counts = [_joined([unpack_counts(r["counts"]) for r in replies if r["kind"] == kind], np.int64) for kind in range(order)]
            alpha = [_joined([np.frombuffer(r["alpha"], np.float64) for r in replies if r["kind"] == kind], np.float64) for kind in range(order - 1)]
            (row,) = blocks_.to_pylist()
            lengths, hashes, tokens = _unzipped(row["lengths"], "<u4").astype(np.int64), _unzipped(row["hashes"], "<u8"), _unzipped(row["tokens"], "<u4").astype(np.int64)
            held = grams(hashes, tokens, lengths, order)
            _, value, known, base, off = token_values(levels, held, counts)
            for k in range(1, order):
                value[off[k]] += alpha[k - 1][held[k].history[off[k]]]
            doc, n = np.repeat(np.arange(len(lengths)), lengths), len(lengths)
            total = lambda x: np.bincount(doc, weights=x, minlength=n)
            return pa.table(
                {
                    "doc_id": pa.array(_unzipped(row["doc_ids"], "<i8"), mask=_flags(row["null_ids"], n)), "held_out": pa.array(_flags(row["held"], n)), "n_tokens": pa.array(lengths), "n_known": pa.array(total(known).astype(np.int64)),
                    "train_tokens": pa.array(np.full(n, levels[WORDS].total, np.int64)), "base_score": pa.array(total(base)), "score": pa.array(total(value)),
                }
            )

        tables = self.counts.select(F.col("kind").cast("int").alias("kind"), "bucket", "keys", "counts", F.lit(b"").alias("alpha"))
        tables = tables.unionByName(self.weights.select(F.col("kind").cast("int").alias("kind"), "bucket", "keys", F.lit(b"").alias("counts"), "alpha"))
        answers = docs.mapInArrow(asked, "block long, kind int, bucket int, keys binary").groupBy("kind", "bucket").cogroup(tables.groupBy("kind", "bucket")).applyInArrow(answer, ASKED)
        return docs.mapInArrow(_texts, TEXTS).groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(evaluate, SCORED)


def _joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, kind)


def token_values(levels: list[Level], held: list[Grams], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(probability of each distinct word; of each token: log10 probability without its backoff weights, known, base; for each length, the tokens
    whose n-gram was never seen, which back off from its history). counts: of the keys of each of `held`."""
    words, c_word, tokens = levels[WORDS], counts[WORDS], held[WORDS].place
    p_word = np.where(c_word > 0, words.discounted(c_word), words.left + 1) / (words.total + 1)
    value, off = np.log10(p_word)[tokens], [np.empty(0, np.int64)]
    for k in range(1, len(held)):
        some = np.flatnonzero(held[k].place >= 0)
        c = counts[k][held[k].place[some]]
        seen = some[c > 0]
        # An n-gram that was seen has parts that were: the longest count that isn't zero stands.
        value[seen] = np.log10(levels[k].discounted(c[c > 0])) - np.log10(counts[k - 1] + 1)[held[k].history[seen]]
        off.append(some[c == 0])
    return p_word, value, c_word[tokens] > 0, np.log10((c_word + 0.5) / (words.total + 0.5 * (words.types + 1)))[tokens], off


WEIGHED = "block long, docs binary, at binary, value binary, kind int, bucket int, keys binary, alpha binary"


def scores(docs: DataFrame, held_out, order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs(doc_id, text); rows for
    which the column `held_out` holds are scored but not learned from."""
    return fit(docs, held_out, order)[1]


def fit(docs: DataFrame, held_out, order: int = ORDER) -> tuple[Model, DataFrame]:
    """The model of the rows of docs(doc_id, text) for which the column `held_out` doesn't hold, and all rows' `scores`. order: words of the
    longest n-grams, 1 or more."""
    if order < 1:
        raise ValueError("order must be 1 or more")
    spark = docs.sparkSession
    buckets = partitions(spark)
    docs = corpus(docs, held_out)
    share = stored(block_counts(docs, buckets, order).groupBy("bucket", "kind").applyInArrow(_counted, SHARE))
    levels = share.groupBy("kind").agg(F.lit(buckets).alias("buckets"), *[F.sum(c).alias(c) for c in STATS])
    sums = {r.kind: r for r in levels.collect()}
    grades = [Level(sums.get(kind)) for kind in range(order)]
    n_train = grades[WORDS].total

    def evaluate(blocks_: pa.Table, shares: pa.Table) -> pa.Table:
        out = []
        for row in blocks_.to_pylist():
            lengths, hashes, tokens = _unzipped(row["lengths"], "<u4").astype(np.int64), _unzipped(row["hashes"], "<u8"), _unzipped(row["tokens"], "<u4").astype(np.int64)
            by = [[] for _ in range(order)]
            for s in shares.sort_by("bucket").to_pylist():
                n = unpack_counts(s["counts"])
                by[s["kind"]].append((n, np.unpackbits(np.frombuffer(s["charge"], np.uint8), count=len(n)).astype(bool)))
            counts, charge = ([_joined([x[k] for x in kind], (np.int64, bool)[k]) for kind in by] for k in range(2))
            grams_ = grams(hashes, tokens, lengths, order)
            p_word, value, known, base, off = token_values(grades, grams_, counts)
            doc = np.repeat(np.arange(len(lengths)), lengths)
            total = lambda x: np.bincount(doc, weights=x, minlength=len(lengths))
            held = np.unpackbits(np.frombuffer(row["held"], np.uint8), count=len(lengths))
            columns = [_unzipped(row["doc_ids"], "<i8"), np.unpackbits(np.frombuffer(row["null_ids"], np.uint8), count=len(lengths)), held, lengths, total(known), total(base), total(value)]
            own = np.concatenate([np.asarray(x, np.float64) for x in columns[1:]])
            out.append((int(row["block"] % buckets), WORDS, row["block"], *[b""] * 7, columns[0].astype("<i8").tobytes() + own.tobytes()))
            # What the n-grams in this block's charge add to their histories, and who backed off.
            for kind in range(1, order):
                history, keys = grams_[kind].history, grams_[kind - 1].keys
                lead = np.flatnonzero(charge[kind])
                r, end = counts[kind][lead], grams_[kind].first[lead]
                h = history[end]
                if kind - 1 == WORDS:
                    shorter = p_word[tokens[end]]
                else:
                    below = grams_[kind - 1]
                    shorter = grades[kind - 1].discounted(counts[kind - 1][below.place[end]]) / (counts[kind - 2][below.history[end]] + 1)
                low = np.stack([np.bincount(h[r == k], minlength=len(keys)) for k in range(1, K + 1)], axis=1)
                count = np.bincount(h, weights=r, minlength=len(keys)).astype(np.int64)
                mass = np.bincount(h, weights=shorter, minlength=len(keys))
                pair, times = np.unique(history[off[kind]] * len(lengths) + doc[off[kind]], return_counts=True)
                h, at = np.divmod(pair, len(lengths))
                per = np.bincount(h, minlength=len(keys))
                edge, pair_edge = bucket_edges(keys, buckets).tolist(), np.concatenate(([0], np.cumsum(per)))
                for b, (i, j) in enumerate(zip(edge, edge[1:])):
                    use = i + np.flatnonzero((count[i:j] > 0) | (per[i:j] > 0))
                    if len(use):
                        x, y = pair_edge[i], pair_edge[j]
                        out.append((b, kind - 1, row["block"], pack_keys(keys[use]), pack_counts(low[use].ravel()), pack_counts(count[use]), mass[use].tobytes(), pack_counts(per[use]), at[x:y].astype("<u4").tobytes(), pack_counts(times[x:y]), b""))
        kinds = [pa.int32(), pa.int32(), pa.int64()] + [pa.binary()] * 8
        return pa.table({c.split()[0]: pa.array([r[k] for r in out], t) for k, (c, t) in enumerate(zip(NEXT.split(", "), kinds))})

    def weigh(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        asked = [r for r in rows if not r["docs"]]
        out = [(r["block"], r["docs"], b"", b"", r["kind"], r["bucket"], b"", b"") for r in rows if r["docs"]]
        if asked:
            keys = [unpack_keys(r["hashes"]) for r in asked]
            distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            add = lambda x: np.bincount(inverse, weights=x)
            d = grades[rows[0]["kind"] + 1].d
            low = np.concatenate([unpack_counts(r["low"]).reshape(-1, K) for r in asked])
            count, mass = add(np.concatenate([unpack_counts(r["seen"]) for r in asked])), add(np.concatenate([np.frombuffer(r["mass"], np.float64) for r in asked]))
            kept = count - sum(add(low[:, k - 1]) * k * (1 - d[k]) for k in range(1, K + 1))
            weight, first = np.log10((1 - kept / (count + 1)) / (1 - mass)), 0
            alpha, known = weight[inverse], count > 0
            if known.any():
                out.append((MODEL, b"", b"", b"", rows[0]["kind"], rows[0]["bucket"], pack_keys(distinct[known]), weight[known].tobytes()))
            for r, k in zip(asked, keys):
                per, times = unpack_counts(r["pairs"]), unpack_counts(r["times"])
                if len(times):
                    at = np.frombuffer(r["at"], "<u4")
                    value = np.bincount(at, weights=times * np.repeat(alpha[first : first + len(k)], per))
                    some = np.unique(at)
                    out.append((r["block"], b"", some.astype("<u4").tobytes(), value[some].tobytes(), r["kind"], r["bucket"], b"", b""))
                first += len(k)
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table({c.split()[0]: pa.array([r[k] for r in out], t) for k, (c, t) in enumerate(zip(WEIGHED.split(", "), kinds))})

    def finish(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        raw = next(r["docs"] for r in rows if r["docs"])
        n = len(raw) // 56
        ids = np.frombuffer(raw, "<i8", n)
        null, held, lengths, known, base, score = np.frombuffer(raw, np.float64, offset=8 * n).reshape(6, n).copy()
        for r in sorted((r for r in rows if not r["docs"]), key=lambda r: (r["at"], r["value"])):
            score[np.frombuffer(r["at"], "<u4")] += np.frombuffer(r["value"], np.float64)
        return pa.table(
            {
                "doc_id": pa.array(ids, mask=null.astype(bool)), "held_out": pa.array(held.astype(bool)), "n_tokens": pa.array(lengths.astype(np.int64)), "n_known": pa.array(known.astype(np.int64)),
                "train_tokens": pa.array(np.full(n, n_train, np.int64)), "base_score": pa.array(base), "score": pa.array(score),
            }
        )

    own = share.filter(F.col("block") != MODEL).select("block", "kind", "bucket", "counts", "charge")
    whole = docs.mapInArrow(_texts, TEXTS).groupBy("block").cogroup(own.groupBy("block")).applyInArrow(evaluate, NEXT)
    summed = stored(whole.groupBy("bucket", "kind").applyInArrow(weigh, WEIGHED))
    counts = share.filter(F.col("block") == MODEL).select("kind", "bucket", "keys", "counts")
    weights = summed.filter(F.col("block") == MODEL).select("kind", "bucket", "keys", "alpha")
    parts = summed.filter(F.col("block") != MODEL).select("block", "docs", "at", "value")
    return Model(counts, weights, levels), parts.groupBy("block").applyInArrow(finish, SCORED)


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5 == 1)
