"""Token ids as files: documents in order of doc_id, ids packed with Simple-8b.

A file is one partition of a range partitioning by doc_id. Its rows are segments of at most SEGMENT ids (a longer
document is cut), each with the documents' ids and lengths, a table that ranks the segment's token ids by frequency (frequent
ids get few bits), the first word of each block of 4,096 ids, and the words. Files are written and read by Spark, so they lie wherever Spark can write;
a file's number and a segment's number give the order.

Nulls: a null text is empty (only the end id). Null doc_ids come first. Rows with the same doc_id are in order of
their text's hash and kept, one result row for each. A text of any length is cut over segments; empty tables give empty files.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rackwise.llm import simple8b
from rackwise.llm.bpe import byte_alphabet
from rackwise.llm.common import blocks, id_text, partitions, scratch_dir, table
from rackwise.llm.pretokens import USUAL, WORD_LEVEL, file_of, finders

TOKENIZER = "word_bpe_49k.json"
END = 2
SEGMENT = 1 << 22
#: Distinct runs of text between white space that a worker remembers; when there are more, it starts anew.
CHUNKS_KEPT = 800_000
FILE = "file int, segment int, n_ids long, n_docs long, doc_ids binary, null_ids binary, lengths binary, ranked binary, starts binary, words binary"


class _Chunks(dict):
    """Numbers of the runs of text between white space, kept while they come again; `fresh` are those not encoded yet."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        self.fresh.append(chunk)
        return n


class WordEncoder:
    """The library's ids of whole texts. Each distinct run between white space is cut into pre-tokens once, and each distinct
    pre-token of these goes once to the library's model. Texts with special strings or uncommon characters go to the library whole."""

    def __init__(self, name: str) -> None:
        self.library = Tokenizer.from_file(file_of(name))
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.find, _ = finders(WORD_LEVEL)
        self.stand = {b: s for s, b in byte_alphabet().items()}
        self.specials = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        self.forget()

    def forget(self) -> None:
        self.chunks = _Chunks()
        self.ids, self.sizes = array("I"), array("I")

    def learn(self) -> None:
        fresh, self.chunks.fresh = self.chunks.fresh, []
        parts = [self.find(c) for c in fresh]
        known: dict[str, list[int]] = {}
        for pre in {p for ps in parts for p in ps}:
            known[pre] = [t.id for t in self.model.tokenize(pre if pre.isascii() and pre.isprintable() else pre.encode().decode("latin-1").translate(self.stand))]
        for ps in parts:
            before = len(self.ids)
            for p in ps:
                self.ids.extend(known[p])
            self.sizes.append(len(self.ids) - before)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.chunks) > CHUNKS_KEPT:
            self.forget()
        number, plain = self.chunks.__getitem__, []
        for t in texts:
            low = t.lower()
            if USUAL.search(low) or any(s in t for s in self.specials):
                plain.append(None)
            else:
                chunks = low.split()
                plain.append(np.fromiter(map(number, chunks), np.int64, len(chunks)))
        self.learn()
        pool, sizes = np.array(self.ids, "<u4"), np.array(self.sizes, np.int64)
        first, out = np.cumsum(sizes) - sizes, []
        for t, chunks in zip(texts, plain):
            if chunks is None:
                out.append(np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4"))
                continue
            n = sizes[chunks]
            out.append(pool[np.repeat(first[chunks] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
        return out


_LOADED: dict[str, WordEncoder] = {}


def encoder(name: str) -> WordEncoder:
    if name not in _LOADED:
        _LOADED[name] = WordEncoder(name)
    return _LOADED[name]


def pack(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(ranked, starts, words) of a segment's ids."""
    count = np.bincount(ids)
    ranked = np.argsort(-count, kind="stable")[: np.count_nonzero(count)]
    rank = np.zeros(len(count), np.uint64)
    rank[ranked] = np.arange(len(ranked), dtype=np.uint64)
    words, starts = simple8b.encode(rank[ids])
    return ranked.astype("<u4").tobytes(), starts.astype("<u4").tobytes(), words.astype("<u8").tobytes()


def unpack(ranked: bytes, starts: bytes, words: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ranked, "<u4")[simple8b.decode(np.frombuffer(words, "<u8"), np.frombuffer(starts, "<u4"), n).astype(np.int64)]


def write_token_files(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end: int = END, segment_ids: int = SEGMENT) -> DataFrame:
    """Writes the files of docs(doc_id, text) under `path`; returns them as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, file = encoder(tokenizer), TaskContext.get().partitionId()
        tail, held, size, segment = np.array([end], "<u4"), [], 0, 0

        def out() -> pa.RecordBatch:
            ids = np.concatenate([x for _, x, _ in held])
            doc_ids = np.array([i or 0 for i, _, _ in held], "<i8").tobytes()
            # The length's top bit says that the document goes on in the next segment.
            lengths = np.array([len(x) | on << 31 for _, x, on in held], "<u4").tobytes()
            nulls = np.packbits([i is None for i, _, _ in held]).tobytes()
            row = [file, segment, len(ids), len(held), doc_ids, nulls, lengths, *pack(ids)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * 6
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], [c.split()[0] for c in FILE.split(", ")])

        for part, texts in blocks(batches, as_bytes=False):
            for doc, ids in zip(part.column("doc_id").to_pylist(), encode.encode(texts)):
                ids = np.concatenate((ids, tail))
                at = 0
                while True:
                    take = min(len(ids) - at, segment_ids - size)
                    if take or at == len(ids):
                        held.append((doc, ids[at : at + take], at + take < len(ids)))
                    at, size = at + take, size + take
                    if size == segment_ids:
                        yield out()
                        held, size, segment = [], 0, segment + 1
                    if at == len(ids):
                        break
        if held:
            yield out()

    spark = docs.sparkSession
    # Rows without an id or with the same one are dealt out by their text's hash, and equal ones by where they were read.
    keyed = id_text(docs).withColumn("hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    ranged = keyed.repartitionByRange(partitions(spark), "doc_id", "hash", "row").sortWithinPartitions("doc_id", "hash", "row").select("doc_id", "text")
    ranged.mapInArrow(run, FILE).write.option("compression", "none").parquet(path)
    return spark.read.schema(FILE).parquet(path)


def _read(batches: Iterator[pa.RecordBatch], want) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack(row["ranked"], row["starts"], row["words"], row["n_ids"])
            doc_ids = np.frombuffer(row["doc_ids"], "<i8")
            null = np.unpackbits(np.frombuffer(row["null_ids"], np.uint8), count=row["n_docs"]).astype(bool)
            lengths = np.frombuffer(row["lengths"], "<u4")
            on, lengths = lengths >> 31, (lengths & (1 << 31) - 1).astype(np.int64)
            at = np.cumsum(lengths) - lengths
            raw = ids.astype("<u4").tobytes()
            cut = [raw[4 * a : 4 * (a + n)] for a, n in zip(at.tolist(), lengths.tolist())]
            yield want(row, pa.array(doc_ids, mask=null), at, lengths, on, cut)


def token_digests(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files' ids.

    A document's start is the ids of all files before, of the file's segments before, and of the documents before it in
    the segment: running sums over one row a file, and over a file's segments.
    """

    def parts(row, doc_ids, at, lengths, on, cut) -> pa.RecordBatch:
        n = len(cut)
        last = np.zeros(n, bool)
        last[-1] = True
        # A cut document's pieces meet again by the segment in which it began.
        first = np.zeros(n, bool)
        first[0] = True
        crc = [zlib.crc32(x) for x in cut]
        edge = [x if (k == 0 or o) else None for k, (x, o) in enumerate(zip(cut, on))]
        return pa.RecordBatch.from_arrays(
            [pa.array([row["file"]] * n, pa.int32()), pa.array([row["segment"]] * n, pa.int32()), pa.array(np.arange(n)), doc_ids, pa.array(at), pa.array(lengths), pa.array(on.astype(bool)), pa.array(crc, pa.int64()), pa.array(edge, pa.binary())],
            ["file", "segment", "k", "doc_id", "at", "n_tokens", "on", "ids_crc32", "piece"],
        )

    found = files.mapInArrow(lambda b: _read(b, parts), "file int, segment int, k long, doc_id long, at long, n_tokens long, on boolean, ids_crc32 long, piece binary")
    per_segment = files.select("file", "segment", "n_ids")
    per_file = per_segment.groupBy("file").agg(F.sum("n_ids").alias("n_ids"))
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    file_base = per_file.select("file", before(Window.orderBy("file")).alias("file_base"))
    base = per_segment.withColumn("base", before(Window.partitionBy("file").orderBy("segment"))).join(file_base, "file").select("file", "segment", (F.col("base") + F.col("file_base")).alias("base"))
    rows = found.join(base, ["file", "segment"]).withColumn("start", F.col("base") + F.col("at"))
    # Documents cut between segments: a piece that goes on, and the first of the next segment, are put together by file.
    w = Window.partitionBy("file").orderBy("segment", "k")
    edges = rows.filter("on OR k = 0").withColumn("went_on", F.lag("on").over(w))
    edges = edges.withColumn("doc_no", F.sum(F.when(F.coalesce("went_on", F.lit(False)), 0).otherwise(1)).over(w))

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = []
            for pieces in batch.column("pieces").to_pylist():
                v = 0
                for p in pieces:
                    v = zlib.crc32(p["piece"], v)
                c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(c, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    whole = edges.groupBy("file", "doc_no").agg(F.min("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("segment", "k", "piece"))).alias("pieces"))
    whole = whole.select("doc_id", "start", "n_tokens", "pieces").mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.filter("NOT on AND k > 0").select("doc_id", "start", "n_tokens", "ids_crc32").unionByName(whole)


def read_token_ids(files: DataFrame) -> DataFrame:
    """(doc_id, at, ids array) of each stored piece, in the file's order within a segment."""

    def parts(row, doc_ids, at, lengths, on, cut) -> pa.RecordBatch:
        n = len(cut)
        ids = pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in cut], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([row["file"]] * n, pa.int32()), pa.array([row["segment"]] * n, pa.int32()), doc_ids, pa.array(at), ids], ["file", "segment", "doc_id", "at", "ids"])

    return files.mapInArrow(lambda b: _read(b, parts), "file int, segment int, doc_id long, at long, ids array<long>")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    files = write_token_files(table(spark, sf_dir, "documents"), f"{scratch_dir(spark)}/{uuid.uuid4().hex}")
    return token_digests(files).select("doc_id", "start", "n_tokens", "ids_crc32")
