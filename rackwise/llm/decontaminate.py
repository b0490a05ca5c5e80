"""Benchmark decontamination: latent semantic retrieval of document passages, checked by common subsequences.

Documents are read once into the numbers of benchmark words (0: any other). TF-IDF weights come from the document frequencies of
those words over all documents; words in over COMMON of the documents carry no latent weight unless they are among an item's
RAREST. Passages are windows of 16, 32 and 64 words, each a quarter further on; a passage's vector holds each word's weight times its count, and
words outside the benchmark count once each. Items have benchmark words only, so a window whose part of latent words has less than NEAR
squared of its squared norm can't have a cosine of NEAR with any item: such windows aren't embedded. Norms by counts are worked out for the
windows that a bound from running sums leaves: the part is at most its sum by occurrence where no latent word repeats, at most the square of
its summed weights where one does, and the rest is at least its sum by occurrence.

A randomised SVD of the TF-IDF passages (all remaining windows and the items) is found in two distributed passes: the range of
A'A over a random start, and the small Gram matrix in that range. Partial sums are added in two shuffles, a batch at a time; what reaches the
driver is bounded by the words of one chunk of items. Windows and items with a cosine of NEAR or more in the latent space are candidates, without a limit
on their number. Weights grow with the number of documents and a cosine may miss what the last check would accept, so candidates also come from
exact counts: for items of LEAST words or more, each stretch of twice the item's length, half a length further on, that holds PARAPHRASE of the
item's words. As a common subsequence is no longer than the words in common, every passage of up to one and a half times the item's
length that the last check accepts is found. Stretches of five times the length are looked through likewise if they hold RARE of the item's latent
words too, so passages of up to four and a half lengths with that many of them, in the item's order, are found as well.

A candidate is reported if the longest common subsequence of the item and the words around the window (or in the stretch) holds SAME of the
item's words (SAME_SHORT for items under SHORT words), or PARAPHRASE of them and the item's answer (its last sentence) with SAME_SHORT of its
words. Below SAME_SHORT a subsequence of RARE of the item's latent words is asked for besides: common words alone are no evidence.

Items are taken in chunks of about CHUNK, one after the other, so what the driver holds and broadcasts is bounded; windows of a text are embedded AT_ONCE at a time, so memory doesn't grow
with the text. Nulls: null texts and items are empty and match nothing; a null doc_id is reported as null. Repeated rows give repeated
results; items with the same text are reported each. An empty benchmark or empty documents give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackwise.llm.common import FOLD, blocks, id_text, stored, table

RANK = 128
MORE = 16
SIZES = (16, 32, 64)
COMMON = 0.05
RAREST = 8
NEAR = 0.5
SAME = 0.65
SAME_SHORT = 0.8
SHORT = 12
PARAPHRASE = 0.6
RARE = 0.5
#: Words of the shortest items that are looked for by counts: shorter ones are anywhere by chance.
LEAST = 4
#: Half lengths of an item that a stretch has.
NARROW, WIDE = 4, 10
CHUNK = 5_000
#: Windows that are embedded at once, bytes of a partial sum's rows that move together, and partial sums that are added first.
AT_ONCE = 1024
SUM_BYTES = 256 << 10
FAN = 64
SEED = 5


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def answer_of(text: str) -> str:
    """The last sentence; the last five words where there is only one."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if p]
    return parts[-1] if len(parts) > 1 else " ".join(text.split()[-5:])


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of a and b, a bit for each place of a."""
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        m = where.get(x, 0)
        if m:
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def numbered(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, ids binary): each word's number in the vocabulary as 32 bits, 0 for others."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        kind = "<u2" if len(known) < 1 << 16 else "<u4"
        for part, texts in blocks(batches):
            ids = [np.array([known.get(w, 0) for w in words_of(t)], kind).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return id_text(docs).mapInArrow(run, "doc_id long, ids binary")


def document_frequencies(found: DataFrame, n_terms: int, kind: str) -> tuple[np.ndarray, int]:
    """Documents that hold each term, and documents in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(n_terms + 1, np.int64)
        for batch in batches:
            n[0] += batch.num_rows
            for ids in batch.column("ids").to_pylist():
                own = np.unique(np.frombuffer(ids, kind))
                n[own[own > 0]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], ["term", "n"])

    rows = found.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # at most the benchmark's words
    out = np.zeros(n_terms + 1, np.int64)
    for r in rows:
        out[r.term] = r.n
    return out, int(out[0])


def count_norms(terms: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared norms, squared norms of the terms with a sign) of windows, a row of terms each: term t has weight[|t|] times its count, term 0
    counts once for each occurrence, and terms below 0 are those of the part. terms are sorted in place."""
    terms.sort(axis=1)
    new = np.ones(terms.shape, bool)
    new[:, 1:] = terms[:, 1:] != terms[:, :-1]
    new |= terms == 0
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, terms.size))
    t = terms.ravel()[first]
    square = (weight[np.abs(t)] * count) ** 2
    row = first // terms.shape[1]
    return np.bincount(row, square, len(terms)), np.bincount(row, np.where(t < 0, square, 0.0), len(terms))


class Passages:
    """Windows of a document, with the weights of its words."""

    def __init__(self, weight: np.ndarray, latent: np.ndarray, kind: str) -> None:
        self.weight, self.latent, self.kind = weight.astype(np.float64), latent, kind
        self.signed = np.where(latent, -1, 1) * np.arange(len(weight))

    def repeats(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Neighbouring places of the same latent word, SIZES[-1] words apart at most."""
        at = np.flatnonzero(self.latent[ids])
        order = at[np.argsort(ids[at], kind="stable")]
        a, b = order[:-1], order[1:]
        same = (ids[a] == ids[b]) & (b - a < SIZES[-1])
        return a[same], b[same]

    def windows(self, raw: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
        """(ids, starts, size, norms) of the windows with enough benchmark weight, at most AT_ONCE at a time."""
        ids = np.frombuffer(raw, self.kind)
        on = self.latent[ids]
        if not on.any():
            return
        own = self.weight[ids]
        square = own * own
        sums = lambda x: np.concatenate(([0.0], np.cumsum(x)))
        parts, squares = sums(square * on), sums(square)
        first, again = self.repeats(ids)
        plain = sums(own * on) if len(first) else None
        for size in SIZES:
            if size > SIZES[0] and len(ids) <= SIZES[SIZES.index(size) - 1]:
                return
            last = max(0, len(ids) - size)
            starts = np.arange(0, last + 1, size // 4)
            if starts[-1] != last:
                starts = np.append(starts, last)
            ends = np.minimum(starts + size, len(ids))
            part = parts[ends] - parts[starts]
            rest = squares[ends] - squares[starts] - part
            if plain is not None:
                # A window from low to high holds both places.
                low, high = np.searchsorted(starts, again - size, "right"), np.searchsorted(starts, first, "right")
                held = high > low
                change = np.bincount(low[held], minlength=len(starts) + 1) - np.bincount(high[held], minlength=len(starts) + 1)
                part = np.where(np.cumsum(change)[:-1] > 0, (plain[ends] - plain[starts]) ** 2, part)
            keep = np.flatnonzero((part * (1 - NEAR**2) >= NEAR**2 * rest * (1 - 1e-9)) & (part > 1e-9))
            for k in range(0, len(keep), AT_ONCE):
                some = keep[k : k + AT_ONCE]
                whole, part_of = count_norms(self.signed[_terms(ids, starts[some], size)], self.weight)
                # Places beyond a short document's end count for nothing.
                whole -= (starts[some] + size - ends[some]) * self.weight[0] ** 2
                near = part_of >= NEAR**2 * whole * (1 - 1e-9)
                if near.any():
                    yield ids, starts[some[near]], size, np.sqrt(whole[near])

    def listed(self, raw: bytes) -> tuple[bytes, bytes, bytes]:
        """The windows as bytes: starts, sizes, norms; for stored()."""
        found = [(at, np.full(len(at), size, np.int32), norm) for _, at, size, norm in self.windows(raw)]
        return tuple(np.concatenate(x).astype(t).tobytes() if found else b"" for x, t in zip(zip(*found) if found else [()] * 3, ("<i4", "<i4", "<f8")))

    def stored(self, row: dict) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
        """The windows of a row (ids, at, size, norm) that listed() made, as windows() gives them."""
        at, size, norm = np.frombuffer(row["at"], "<i4"), np.frombuffer(row["size"], "<i4"), np.frombuffer(row["norm"], "<f8")
        if len(at):
            ids = np.frombuffer(row["ids"], self.kind)
            for n in SIZES:
                own = np.flatnonzero(size == n)
                for k in range(0, len(own), AT_ONCE):
                    some = own[k : k + AT_ONCE]
                    yield ids, at[some].astype(np.int64), n, norm[some]


def windowed(found: DataFrame, passages: Passages) -> DataFrame:
    """found(doc_id, ids) with the windows that are near enough to be embedded: worked out once, read by every later pass."""
    sent = found.sparkSession.sparkContext.broadcast(passages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sent.value.listed(raw or b"") for raw in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), *(pa.array([m[k] for m in made], pa.binary()) for k in range(3))], ["doc_id", "ids", "at", "size", "norm"])

    return found.mapInArrow(run, "doc_id long, ids binary, at binary, size binary, norm binary")


class Stretches:
    """Items by their words, to find the stretches of a document that hold PARAPHRASE of an item's words: those of twice the item's length, and those of
    five times, which must hold RARE of its latent words besides."""

    def __init__(self, items: list[np.ndarray], terms: int, latent: np.ndarray) -> None:
        self.latent = latent
        self.own = [np.unique(i, return_counts=True) for i in items]
        self.length = np.array([len(i) for i in items], np.int64)
        self.need = np.where(self.length >= LEAST, np.ceil(PARAPHRASE * self.length - 1e-9), np.inf)
        term = np.concatenate([t for t, _ in self.own])
        order = np.argsort(term, kind="stable")
        self.item = np.repeat(np.arange(len(items)), [len(t) for t, _ in self.own])[order]
        self.times = np.concatenate([n for _, n in self.own])[order]
        self.rare_times = np.where(latent[term[order]], self.times, 0)
        self.rare_need = RARE * np.bincount(self.item, self.rare_times, minlength=len(items))
        self.edge = np.searchsorted(term[order], np.arange(terms + 1))
        self.place = np.full(terms, -1, np.int64)

    def within(self, ids: np.ndarray) -> Iterator[tuple[int, int, int, bool]]:
        """(item, low, high, wide): all stretches with enough of an item's words, the short ones of an item first."""
        own = np.unique(ids).astype(np.int64)
        own = own[own > 0]
        begin, n = self.edge[own], self.edge[own + 1] - self.edge[own]
        at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        held = np.bincount(self.item[at], self.times[at], minlength=len(self.need))
        rare_held = np.bincount(self.item[at], self.rare_times[at], minlength=len(self.need))
        for i in np.flatnonzero(held >= self.need).tolist():
            terms, times = self.own[i]
            step = -(-int(self.length[i]) // 2)
            self.place[terms] = np.arange(len(terms))
            place = self.place[ids]
            self.place[terms] = -1
            at = np.flatnonzero(place >= 0)
            cells = len(ids) // step + 1
            count = np.bincount(at // step * len(terms) + place[at], minlength=(cells + WIDE) * len(terms)).reshape(cells + WIDE, len(terms))
            sums = np.concatenate((np.zeros((1, len(terms)), np.int64), np.cumsum(count, axis=0)))
            rare = self.latent[terms]
            for n, wide in ((NARROW, False), (WIDE, True))[: 1 + (rare_held[i] >= self.rare_need[i])]:
                both = np.minimum(sums[n : n + cells] - sums[:cells], times)
                good = both.sum(axis=1) >= self.need[i]
                if wide:
                    good &= both[:, rare].sum(axis=1) >= RARE * times[rare].sum()
                for k in np.flatnonzero(good).tolist():
                    yield i, k * step, (k + n) * step, wide


def _terms(ids: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The windows' terms, a row each, 0 beyond the document."""
    at = starts[:, None] + np.arange(size)
    return np.where(at < len(ids), ids[np.minimum(at, len(ids) - 1)], 0)


def _summed(found: DataFrame, part, rows: int, columns: int) -> np.ndarray:
    """The sum over all tasks of matrices (rows x columns) that `part` makes. The rows that a task has are sent as they are, in blocks, and
    added for FAN groups of tasks first, then in all; a group is read batch by batch."""
    step = max(1, SUM_BYTES // (4 * columns))
    names = ["k", "fan", "rows", "m"]

    def sent(k: int, fan: int, at: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([fan], pa.int32()), pa.array([at.astype("<i4").tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, columns), np.float32)
        for batch in batches:
            part(total, batch.to_pylist())
        fan = TaskContext.get().partitionId() % FAN
        for k in range(0, rows, step):
            at = np.flatnonzero(total[k : k + step].any(axis=1))
            if len(at):
                yield sent(k, fan, at, total[k : k + step][at])

    def added(kind: type) -> Callable:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, k, fan = np.zeros((step, columns)), None, None
            for batch in batches:
                for r in batch.to_pylist():
                    at = np.frombuffer(r["rows"], "<i4")
                    total[at] += np.frombuffer(r["m"], kind).reshape(len(at), columns)
                    k, fan = r["k"], r["fan"]
            at = np.flatnonzero(total.any(axis=1))
            yield sent(k, fan, at, total[at])

        return add

    kind = "k long, fan int, rows binary, m binary"
    sums = found.select("ids", "at", "size", "norm").filter(F.length("at") > 0).mapInArrow(run, kind).groupBy("k", "fan").applyInArrow(added(np.float32), kind).groupBy("k").applyInArrow(added(np.float64), kind)
    out = np.zeros((rows, columns))
    for r in sums.collect():
        at = np.frombuffer(r.rows, "<i4")
        out[r.k + at] = np.frombuffer(r.m, np.float64).reshape(len(at), columns)
    return out


def latent_basis(found: DataFrame, passages: Passages, weight: np.ndarray, items: list[np.ndarray], rank: int = RANK) -> np.ndarray:
    """(terms x rank) right singular vectors of the unit TF-IDF passages, from a randomised SVD in two passes."""
    terms = len(weight)
    latent = np.where(passages.latent, weight, 0.0)
    width = min(rank + MORE, int(passages.latent.sum()))
    start = np.random.default_rng(SEED).standard_normal((terms, width)).astype(np.float32) * passages.latent[:, None]
    sc = found.sparkSession.sparkContext
    sent = sc.broadcast((passages, latent.astype(np.float32), start))

    def ranged(total: np.ndarray, rows: list) -> None:
        passages, latent, start = sent.value
        weighted = start * latent[:, None]
        for row in rows:
            for ids, at, size, norm in passages.stored(row):
                held = _terms(ids, at, size)
                y = weighted[held].sum(axis=1) / norm[:, None]
                row, column = np.nonzero(passages.latent[held])
                t = held[row, column]
                order = np.argsort(t, kind="stable")
                row, t = row[order], t[order]
                first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
                total[t[first]] += np.add.reduceat(y[row] * (latent[t] / norm[row])[:, None], first, axis=0)

    z = _summed(found, ranged, terms, width)
    norm = [max(float(np.sqrt(((c * latent[t]) ** 2).sum())), 1e-12) for t, c in (np.unique(ids, return_counts=True) for ids in items)]
    for ids, n in zip(items, norm):
        np.add.at(z, ids, (latent[ids] / n)[:, None] * (start[ids] * latent[ids][:, None]).sum(axis=0) / n)
    q, _ = np.linalg.qr(z)
    sent_q = sc.broadcast((passages, (q * latent[:, None]).astype(np.float32)))

    def gram(total: np.ndarray, rows: list) -> None:
        passages, q = sent_q.value
        for row in rows:
            for ids, at, size, norm in passages.stored(row):
                y = q[_terms(ids, at, size)].sum(axis=1) / norm[:, None]
                total += y.T @ y

    own = np.array([(q[ids] * latent[ids][:, None]).sum(axis=0) / n for ids, n in zip(items, norm)])
    g = _summed(found, gram, width, width) + own.T @ own
    values, vectors = np.linalg.eigh(g)
    best = np.argsort(-values)[: min(rank, width)]
    return q @ vectors[:, best]


PAIRS = "doc_id long, item_id long, cosine double, lcs_share double, answer boolean"


def item_chunks(benchmark: DataFrame) -> Iterator[tuple[list, bool]]:
    """(about CHUNK items, whether they are the last), one chunk at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    items = stored(items.withColumn("row", F.monotonically_increasing_id()))
    chunks = -(-items.count() // CHUNK)
    for k in range(chunks):
        yield items.filter(F.pmod(F.xxhash64("row"), F.lit(chunks)) == k).orderBy("item_id", "text").collect(), k == chunks - 1  # about CHUNK items


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer): each document and benchmark item that it holds, once for each row."""
    out = docs.sparkSession.createDataFrame([], PAIRS)
    for rows, last in item_chunks(benchmark):
        found, judged = _judge(docs, rows, rank)
        if judged is not None:
            pairs = found.mapInArrow(_pairs(judged), PAIRS)
            out = out.unionByName(pairs if last else _told(pairs, judged))
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> DataFrame:
    """The rows of docs, with all columns, that hold no benchmark item. Rows are judged where they are read, whatever their doc_id."""
    for rows, last in item_chunks(benchmark):
        _, judged = _judge(docs, rows, rank)
        if judged is not None:
            kept = docs.mapInArrow(_kept(judged), docs.schema)
            docs = kept if last else _told(kept, judged)
    return docs


def _told(result: DataFrame, judged: Broadcast) -> DataFrame:
    """A chunk's result as a table, after which its judge is given up."""
    result = stored(result)
    judged.destroy()
    return result


def _pairs(judged: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = judged.value
        for batch in batches:
            hits = [(row["doc_id"], *hit) for row in batch.to_pylist() for hit in judge.hits(row["ids"] or b"", judge.passages.stored(row))]
            names = [c.split()[0] for c in PAIRS.split(", ")]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in hits], t) for k, t in enumerate(kinds)], names)

    return run


def _kept(judged: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = judged.value
        for part, texts in blocks(batches):
            yield part.filter(pa.array([not judge.hits(raw, judge.passages.windows(raw)) for raw in (judge.numbers(t or b"") for t in texts)], pa.bool_()))

    return run


class Judge:
    """What is broadcast: the latent space, the items in it, and their words."""

    def __init__(self, vocabulary: dict, passages: Passages, embed: np.ndarray, items: list, answers: list, item_ids: list, terms: int) -> None:
        self.vocabulary, self.passages, self.embed, self.items, self.answers, self.item_ids = vocabulary, passages, embed, items, answers, item_ids
        self.where = np.array([i for i, own in enumerate(items) if len(own)])
        points = np.array([embed[items[i]].sum(axis=0) for i in self.where])
        self.points = points / np.maximum(np.linalg.norm(points, axis=1), 1e-12)[:, None]
        self.point_of = {int(i): p for p, i in enumerate(self.where)}
        self.rare = [own[passages.latent[own]] for own in items]
        self.stretches = Stretches(items, terms, passages.latent)

    def numbers(self, text: bytes) -> bytes:
        return np.array([self.vocabulary.get(w, 0) for w in words_of(text)], self.passages.kind).tobytes()

    def check(self, best: dict, i: int, around: np.ndarray, cosine: float, wide: bool = False) -> None:
        share = common_subsequence(self.items[i], around) / len(self.items[i])
        if share < PARAPHRASE:
            return
        answer = common_subsequence(self.answers[i], around) >= SAME_SHORT * len(self.answers[i])
        if share < SAME_SHORT:
            if not answer and (share < SAME or len(self.items[i]) < SHORT):
                return
        if share < SAME_SHORT or wide:
            rare, latent = self.rare[i], self.passages.latent
            if common_subsequence(rare, around[latent[around]]) < RARE * len(rare):
                return
        best[i] = max(best.get(i, (0.0, 0.0, False)), (share, cosine, bool(answer)))

    def hits(self, raw: bytes, windows: Iterator) -> list[tuple]:
        """(item_id, cosine, lcs_share, answer) of each item that a document's numbers hold; windows: its passages."""
        best: dict[int, tuple[float, float, bool]] = {}
        for ids, at, size, norm in windows:
            z = self.embed[_terms(ids, at, size)].sum(axis=1) / norm[:, None]
            cosine = z @ self.points.T
            for w, p in zip(*np.nonzero(cosine >= NEAR)):
                i = int(self.where[p])
                n = len(self.items[i])
                # The item, laid anywhere over the window's middle, lies in these words.
                low, high = max(0, int(at[w]) - n), int(at[w]) + size + n
                if best.get(i, (0.0,))[0] < 1:
                    self.check(best, i, ids[low:high], float(cosine[w, p]))
        ids = np.frombuffer(raw, self.passages.kind)
        for i, low, high, wide in self.stretches.within(ids):
            if best.get(i, (0.0,))[0] < (SAME_SHORT if wide else 1):
                z = self.embed[ids[low:high]].sum(axis=0)
                self.check(best, i, ids[low:high], float(z @ self.points[self.point_of[i]] / max(float(np.linalg.norm(z)), 1e-12)), wide)
        return [(self.item_ids[i], c, s, a) for i, (s, c, a) in sorted(best.items())]


def _judge(docs: DataFrame, rows: list, rank: int) -> tuple[DataFrame | None, Broadcast | None]:
    """The documents' numbers, stored, and the judge; nothing where no item has a word."""
    split = [words_of(r.text.encode()) for r in rows]
    vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for ws in split for w in ws}))}
    if not vocabulary:
        return None, None
    kind = "<u2" if len(vocabulary) < 1 << 16 else "<u4"
    ids = [np.array([vocabulary[w] for w in ws], np.int64) for ws in split]
    answers = [np.array([vocabulary[w] for w in words_of(answer_of(r.text).encode())], np.int64) for r in rows]
    found = stored(numbered(docs, vocabulary))
    df, n = document_frequencies(found, len(vocabulary), kind)
    weight = np.log((1 + n) / (1 + df)) + 1
    weight[0] = np.log(1 + n) + 1  # any other word: as rare as a word can be
    latent = df <= COMMON * n
    for own in ids:
        latent[sorted(set(own.tolist()), key=lambda t: (df[t], t))[:RAREST]] = True
    latent[0] = False
    passages = Passages(weight, latent, kind)
    found = stored(windowed(found, passages))
    basis = latent_basis(found, passages, weight, ids, rank)
    embed = (basis * np.where(latent, weight, 0.0)[:, None]).astype(np.float32)
    return found, docs.sparkSession.sparkContext.broadcast(Judge(vocabulary, passages, embed, ids, answers, [r.item_id for r in rows], len(weight)))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
