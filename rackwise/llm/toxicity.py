"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes.

Terms are all words (runs of letters and digits, A-Z as a-z) of a sample of at most SAMPLE labelled rows (the smallest hashes of
doc_id); the sample's rows are the examples. A term weighs (1 + ln count) * idf * relevance; document frequencies cover all documents, and
relevance is 1, or more where even the lower confidence bound of a term's share of toxic examples is above the overall share. No term is
left out, so a text that shares any word with an example has neighbours.

Index: examples lie in blocks; each term's list has, per block, its largest weight. Words that many examples hold are kept as columns of a
matrix, where a batch of texts is multiplied at once. A block is opened only if the sum of its bounds can still beat the K-th
best cosine, so the K nearest are exact (cosines to six decimals; ties in the order of the index). A vote is the share of toxic
among the squared cosines, with one more neighbour at the usual best cosine whose share is the overall one, so that neighbours more distant than usual decide little. Votes are
calibrated by isotonic regression on the examples, each left out of its own vote and of the relevance of its words in it (a Spark job; only the lengths
of the other examples' vectors stay as they are); texts without any known word get the share of toxic examples among those without neighbours.

What is broadcast (vocabulary, examples) is bounded by SAMPLE texts. Nulls: a null text is empty and has no term; null labels are left
out; a null doc_id is never held out and never an example. Of several texts with a labelled doc_id the least is the example; several labels of a doc_id count as
their largest; equal texts are one example, toxic if half or more of their labels are. Without labels or examples every score is 0.1. Texts of any
length are taken whole. Repeated rows are kept, one result row for each; columns with other names are never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackwise.llm.common import FOLD, blocks, id_text, partitions, stored, table

SAMPLE = 12_000
K = 15
#: Weight of the log odds above the overall share in a term's relevance, and standard errors of the lower bound.
RELEVANCE = 3.0
ERRORS = 2.0
#: Examples to a block of the index; terms of at least this share of the examples are columns of the matrix.
BLOCK = 128
COMMON = 0.06
#: Texts that are multiplied at once, bytes of text cut into words at once, and results a worker remembers for copies.
QUERIES = 64
AT_A_TIME = 2 << 20
SCORES_KEPT = 20_000
THRESHOLD = 0.7


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def examples(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic): distinct texts of at most `sample` labelled rows that are not held out; the same each time."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = id_text(docs).join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return chosen.groupBy("text").agg(F.min("doc_id").alias("doc_id"), (F.avg("toxic") >= 0.5).cast("int").alias("toxic"))


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def word_vectors(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes of the words, rising; how often each occurs) of each text."""
    number = _Numbers()
    get, parts = number.__getitem__, []
    for t in texts:
        words = t.translate(FOLD).split()
        parts.append(np.unique(np.fromiter(map(get, words), np.int64, len(words)), return_counts=True))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, 11) for w in number), np.uint64, len(number))
    out = []
    for own, n in parts:
        h = hashes[own]
        order = np.argsort(h)
        out.append((h[order], n[order]))
    return out


def known_words(vocabulary: np.ndarray, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """known_terms(vocabulary, word_vectors(texts)), with each distinct word looked up once for all texts."""
    if not texts or not len(vocabulary):
        return [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(texts)
    number = _Numbers()
    get, parts = number.__getitem__, []
    for t in texts:
        words = t.translate(FOLD).split()
        parts.append(np.fromiter(map(get, words), np.int64, len(words)))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, 11) for w in number), np.uint64, len(number))
    at = np.searchsorted(vocabulary, hashes)
    at[at == len(vocabulary)] = 0
    place = np.where(vocabulary[at] == hashes, at, -1)[np.concatenate(parts)]
    use = place >= 0
    key = np.repeat(np.arange(len(texts)), [len(x) for x in parts])[use] * len(vocabulary) + place[use]
    key, n = np.unique(key, return_counts=True)
    text, place = np.divmod(key, len(vocabulary))
    edge = np.searchsorted(text, np.arange(1, len(texts)))
    return list(zip(np.split(place, edge), np.split(n, edge)))


def known_terms(vocabulary: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The vectors with places in the vocabulary in place of hashes, without other words."""
    out = []
    for h, n in found:
        at = np.searchsorted(vocabulary, h)
        at[at == len(vocabulary)] = 0
        mine = vocabulary[at] == h if len(vocabulary) else np.zeros(len(h), bool)
        out.append((at[mine], n[mine]))
    return out


def example_vectors(chosen: DataFrame) -> DataFrame:
    """(doc_id, toxic, hashes binary, counts binary) of examples(doc_id, text, toxic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, most=AT_A_TIME):
            found = word_vectors(texts)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array([h.tobytes() for h, _ in found], pa.binary()), pa.array([n.astype("<u4").tobytes() for _, n in found], pa.binary())], ["doc_id", "toxic", "hashes", "counts"])

    return chosen.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, hashes binary, counts binary")


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """Documents that hold each term, and documents in all. Each task sends its own terms once; at most the vocabulary comes back."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(sent.value) + 1, np.int64)  # the last counts documents
        for _, texts in blocks(batches, most=AT_A_TIME):
            n[-1] += len(texts)
            for at, _ in known_words(sent.value, texts):
                n[at] += 1
        some = np.flatnonzero(n)
        for k in range(0, len(some), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(some[k : k + 50_000].astype(np.int32)), pa.array(n[some[k : k + 50_000]])], ["term", "n"])

    got = id_text(docs).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(vocabulary) + 1, np.int64)
    out[got.column("term").to_numpy()] = got.column("n").to_numpy()
    return out[:-1], int(out[-1])


def relevance(n: np.ndarray, toxic: np.ndarray, share: float) -> np.ndarray:
    """1, and more for terms that toxic examples hold more often; n and toxic: how many examples, and toxic ones, hold each term."""
    if not 0 < share < 1:
        return np.ones(len(n))
    p = (toxic + share) / (n + 1)
    low = np.clip(p - ERRORS * np.sqrt(p * (1 - p) / (n + 1)), 1e-9, 1 - 1e-9)
    return 1 + RELEVANCE * np.maximum(0, np.log(low / (1 - low)) - np.log(share / (1 - share)))


def _spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... n[0] numbers, then those of first[1], ..."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Index:
    """Block-max inverted index over unit vectors of the examples."""

    def __init__(self, ids: list[int], labels: list[int], found: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray) -> None:
        n, size = len(found), np.array([len(t) for t, _ in found])
        t = np.concatenate([t for t, _ in found]).astype(np.int32)
        row = np.repeat(np.arange(n, dtype=np.int32), size)
        w = ((1 + np.log(np.concatenate([c for _, c in found]))) * weight[t]).astype(np.float32)
        w /= np.sqrt(np.bincount(row, w * w, minlength=n)).astype(np.float32)[row]
        # Examples with the same heaviest word, of those that several have, lie together: few blocks have large bounds for a text.
        df = np.bincount(t, minlength=len(weight))
        heaviest, last = np.full(n, -1), np.cumsum(size) - 1
        heaviest[size > 0] = t[np.lexsort((np.where(df[t] >= max(2, n // 100), w, 0), row))[last[size > 0]]]
        order = np.lexsort((ids, heaviest))
        self.ids, self.labels = np.array(ids, np.int64)[order], np.array(labels, float)[order]
        self.n, self.n_blocks, self.weight = n, -(-n // BLOCK), weight
        place = np.empty(n, np.int32)
        place[order] = np.arange(n, dtype=np.int32)
        p = place[row]
        dense = np.flatnonzero(df >= max(2, COMMON * n))
        self.column = np.full(len(weight), -1, np.int32)
        self.column[dense] = np.arange(len(dense))
        self.matrix = np.zeros((self.n_blocks * BLOCK, len(dense)), np.float32)
        own = self.column[t] >= 0
        self.matrix[p[own], self.column[t[own]]] = w[own]
        t, p, w = t[~own], p[~own], w[~own]
        order = np.lexsort((p, t))
        #: Lists: places and weights by term; for each term and block with any, the block, its largest weight and its slice of the lists.
        t, self.place, self.value = t[order], p[order], w[order]
        block = self.place // BLOCK
        head = np.flatnonzero(np.concatenate((np.ones(min(1, len(t)), bool), (t[1:] != t[:-1]) | (block[1:] != block[:-1]))))
        self.block, self.most = block[head], np.maximum.reduceat(self.value, head) if len(head) else self.value
        self.slice = np.append(head, len(t)).astype(np.int32)
        self.start = np.searchsorted(t[head], np.arange(len(weight) + 1)).astype(np.int32)
        self.list = self.slice[self.start]

    def unit(self, terms: np.ndarray, counts: np.ndarray, times: np.ndarray | float = 1.0) -> np.ndarray:
        w = (1 + np.log(counts)) * self.weight[terms] * times
        return w / (np.sqrt((w * w).sum()) or 1)

    def nearest(self, texts: list[tuple[np.ndarray, np.ndarray]], k: int = K, times: list[np.ndarray] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text (places, cosines) of the k nearest examples with a positive cosine. times: factors of the weights of each text's terms, in the
        text and in the examples."""
        query, rest = np.zeros((len(texts), self.matrix.shape[1]), np.float32), []
        for i, (t, c) in enumerate(texts):
            q, column = self.unit(t, c) if times is None else self.unit(t, c, times[i]) * times[i], self.column[t]
            query[i, column[column >= 0]] = q[column >= 0]
            rest.append((t[column < 0], q[column < 0]))
        return [self._best(s, t, q, k) for s, (t, q) in zip(query @ self.matrix.T, rest)]

    def _best(self, sums: np.ndarray, t: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        n, whole = self.start[t + 1] - self.start[t], q
        at, q = _spans(self.start[t], n), np.repeat(q, n)
        block = self.block[at]
        upper = sums.reshape(-1, BLOCK).max(axis=1) + np.bincount(block, q * self.most[at], minlength=self.n_blocks)
        cosine = sums.reshape(-1, BLOCK).astype(np.float64)

        def open_blocks(which: np.ndarray) -> None:
            use = which[block]
            opened, weight = at[use], q[use]
            first = self.slice[opened]
            m = self.slice[opened + 1] - first
            post = _spans(first, m)
            if len(post):
                np.add(cosine, np.bincount(self.place[post], np.repeat(weight, m) * self.value[post], minlength=cosine.size).reshape(-1, BLOCK), out=cosine)

        def kth(which: np.ndarray) -> float:
            own = cosine[which].ravel()
            return np.partition(own, len(own) - k)[len(own) - k] if len(own) >= k else 0.0

        some = min(max(8, -(-k // BLOCK)), self.n_blocks)
        opened = np.zeros(self.n_blocks, bool)
        opened[np.argpartition(-upper, some - 1)[:some]] = True
        open_blocks(opened)
        worst = kth(opened)
        more = ~opened & (upper >= worst - 1e-6) & (upper > 0)
        if 4 * int(more.sum()) > self.n_blocks:
            # Over a quarter of the blocks are to be opened: the terms' lists are read from end to end, which leaves out the work of taking them apart by block.
            first = self.list[t]
            m = self.list[t + 1] - first
            post = _spans(first, m)
            cosine = (sums + np.bincount(self.place[post], np.repeat(whole, m) * self.value[post], minlength=cosine.size)).reshape(-1, BLOCK)
            opened[:] = True
            worst = kth(opened)
        elif more.any():
            open_blocks(more)
            opened |= more
            worst = kth(opened)
        blocks_, own = np.flatnonzero(opened), cosine[opened]
        hit = np.flatnonzero((own >= worst - 1e-6) & (own > 1e-9))
        place, value = blocks_[hit // BLOCK] * BLOCK + hit % BLOCK, own.ravel()[hit]
        best = np.lexsort((place, -np.round(value, 6)))[:k]
        return place[best], value[best]

    def sums(self, places: np.ndarray, cosines: np.ndarray) -> tuple[float, float]:
        """Squared cosines of the toxic ones, and of all."""
        weight = cosines * cosines
        return float((weight * self.labels[places]).sum()), float(weight.sum())


def _planes(x: np.ndarray) -> bytes:
    """Numbers of 32 bits, their first bytes first: small ones compress well."""
    return pa.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _of_planes(raw: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(pa.decompress(raw, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, -1).T).view("<u4").ravel()


class Learned:
    """What is broadcast: the examples' vectors, packed, and the terms with their weights. Each worker builds the index from them once."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]], vocabulary: np.ndarray, weight: np.ndarray, held: np.ndarray, toxic: np.ndarray) -> None:
        #: How many examples, and toxic ones, hold each term.
        self.held, self.toxic = held.astype(np.int32), toxic.astype(np.int32)
        self.name, self.ids, self.labels, self.vocabulary, self.weight = uuid.uuid4().hex, ids, labels, vocabulary, weight.astype(np.float32)
        self.size = np.array([len(t) for t, _ in found])
        self.gaps = _planes(np.concatenate([np.diff(t, prepend=0) for t, _ in found]))
        self.counts = _planes(np.concatenate([c for _, c in found]))

    def without(self, terms: np.ndarray, label: int) -> np.ndarray:
        """Factors of the terms' weights if one example that holds them, with this label, weren't among the examples."""
        n, a = self.held[terms].astype(np.int64), self.toxic[terms].astype(np.int64)
        total, toxic = len(self.labels), float(self.labels.sum())
        return relevance(n - 1, a - label, (toxic - label) / max(1, total - 1)) / relevance(n, a, toxic / total)

    def index(self) -> Index:
        if self.name not in _BUILT:
            _BUILT.clear()
            n, edge = int(self.size.sum()), np.cumsum(self.size)[:-1]
            terms, counts = (np.split(_of_planes(x, n), edge) for x in (self.gaps, self.counts))
            _BUILT[self.name] = Index(self.ids, self.labels, [(np.cumsum(t, dtype=np.int64), c) for t, c in zip(terms, counts)], self.weight)
        return _BUILT[self.name]


_BUILT: dict[str, Index] = {}


def left_out_votes(chosen: DataFrame, learned) -> DataFrame:
    """(toxic, hit, near, best) of each of the examples' vectors without its own example: sums of the nearest, and the best cosine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, ix = learned.value.vocabulary, learned.value.index()
        place = {int(i): n for n, i in enumerate(ix.ids)}
        for batch in batches:
            rows = batch.to_pylist()
            votes = []
            for a in range(0, len(rows), QUERIES):
                part = rows[a : a + QUERIES]
                found = known_terms(vocabulary, [_vector(r) for r in part])
                times = [learned.value.without(t, r["toxic"]) for (t, _), r in zip(found, part)]
                for r, (at, cosine) in zip(part, ix.nearest(found, K + 1, times)):
                    other = at != place[r["doc_id"]]
                    at, cosine = at[other][:K], cosine[other][:K]
                    votes.append((*ix.sums(at, cosine), float(cosine.max(initial=0.0))))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array([v[k] for v in votes], pa.float64()) for k in range(3))], ["toxic", "hit", "near", "best"])

    return chosen.mapInArrow(run, "toxic int, hit double, near double, best double")


def _vector(row) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["counts"], "<u4")


def isotonic(votes: list[tuple[float, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Steps (largest vote, share of toxic) by pooling neighbours out of order."""
    pools: list[list[float]] = []  # sum, count, largest vote
    for v, y in sorted(votes):
        pools.append([y, 1, v])
        while len(pools) > 1 and (pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1] or pools[-2][2] == pools[-1][2]):
            s, n, v2 = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, v2]
    return np.array([p[2] for p in pools]), np.array([(p[0] + 0.1) / (p[1] + 0.2) for p in pools])


class Scorer:
    """The broadcast examples and the calibration."""

    def __init__(self, learned, steps: np.ndarray, shares: np.ndarray, none: float, usual: float, share: float) -> None:
        self.learned, self.steps, self.shares, self.none, self.usual, self.share = learned, steps, shares, none, usual, share

    def scores(self, texts: list[bytes], known: dict) -> list[tuple[float, list[int]]]:
        """(calibrated score, ids of the nearest examples) of each text; `known` keeps those of texts seen before."""
        if self.learned is None:
            return [(self.none, [])] * len(texts)
        keys = [xxhash.xxh3_128_digest(t) for t in texts]
        if len(known) > SCORES_KEPT:
            known.clear()
        new = {k: t for k, t in zip(keys, texts) if k not in known}
        found = known_words(self.learned.value.vocabulary, list(new.values()))
        names, index = list(new), self.learned.value.index()
        for a in range(0, len(names), QUERIES):
            for k, (at, cosine) in zip(names[a : a + QUERIES], index.nearest(found[a : a + QUERIES])):
                if len(at):
                    hit, near = index.sums(at, cosine)
                    step = int(np.searchsorted(self.steps, (hit + self.usual * self.share) / (near + self.usual)))
                    known[k] = float(self.shares[min(step, len(self.shares) - 1)]), index.ids[at].tolist()
                else:
                    known[k] = self.none, []
        return [known[k] for k in keys]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    """The scorer of docs(doc_id, text), learned from labels(doc_id, toxic)."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    chosen = stored(example_vectors(examples(docs, labels, sample).repartition(partitions(spark), "doc_id")))
    rows = chosen.orderBy("doc_id").collect()  # at most SAMPLE rows
    if not rows:
        return Scorer(None, np.zeros(0), np.zeros(0), 0.1, 1.0, 0.0)
    vectors = [_vector(r) for r in rows]
    ids, toxic = np.array([r.doc_id for r in rows], np.int64), np.array([r.toxic for r in rows], float)
    vocabulary = np.unique(np.concatenate([h for h, _ in vectors]))
    found = known_terms(vocabulary, vectors)
    del rows, vectors
    df, n = document_frequencies(docs, vocabulary)
    terms, own = np.concatenate([t for t, _ in found]), np.repeat(toxic > 0, [len(t) for t, _ in found])
    held, bad = np.bincount(terms, minlength=len(vocabulary)), np.bincount(terms[own], minlength=len(vocabulary))
    weight = (np.log((1 + n) / (1 + df)) + 1) * relevance(held, bad, float(toxic.mean()))
    learned = sc.broadcast(Learned(ids, toxic, found, vocabulary, weight, held, bad))
    del found, own, terms, weight
    votes = left_out_votes(chosen, learned).collect()  # at most SAMPLE rows of numbers
    near = [r for r in votes if r.near > 0]
    none = [r.toxic for r in votes if not r.near > 0]
    usual, share = float(np.median([r.best for r in near])) ** 2 if near else 1.0, float(toxic.mean())
    steps, shares = isotonic([((r.hit + usual * share) / (r.near + usual), r.toxic) for r in near] or [(1.0, share)])
    return Scorer(learned, steps, shares, (sum(none) + 0.1) / (len(none) + 1), usual, share)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence array of nearest examples' ids) for each row of docs(doc_id, text)."""
    scorer = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for part, texts in blocks(batches, most=AT_A_TIME):
            got = scorer.scores(texts, known)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s for s, _ in got], pa.float64()), pa.array([e for _, e in got], pa.list_(pa.int64()))], ["doc_id", "score", "evidence"])

    scored = id_text(docs).mapInArrow(run, "doc_id long, score double, evidence array<long>")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, whose score is below THRESHOLD. Nothing is shuffled."""
    scorer = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for part, texts in blocks(batches, most=AT_A_TIME):
            yield part.filter(pa.array([s < THRESHOLD for s, _ in scorer.scores([t or b"" for t in texts], known)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Departs from plain TF-IDF: weights are multiplied by the terms' relevance, learned from the labels (see the module). With plain
    TF-IDF fewer than half of the held-out toxic texts of sf0.1 are found."""
    found = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")
