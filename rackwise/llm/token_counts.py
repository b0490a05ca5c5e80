"""Token counts without token ids: pieces are counted once per distinct pre-token and joined to the pre-tokens' frequencies.

No piece of the vocabulary has a space sign after another character, and none holds a line break; so no merge crosses the
start of a run of space signs or a line break, and a text's count is the sum over the pre-tokens cut there. (Checked when the
model is loaded; a vocabulary without that property is refused.)

Frequencies are gathered per block of documents before they move: a shuffle brings together each bucket of pre-tokens, packed. There each
distinct pre-token is counted once and joined to its frequencies; sums by document go back to their block.

Nulls: a null text is empty (0 bytes, 0 tokens); a null doc_id and repeated rows are kept, one result row for each.
Texts may be as long as memory for one text allows; columns with other names are never read; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackwise.llm.common import blocks, id_text, partitions, table
from rackwise.llm.pretokens import file_of

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
SPACE = "▁"
FIND = re.compile("▁+[^▁\n]*|\n[^▁\n]*|[^▁\n]+").findall
BLOCK = 24 << 20
#: A pre-token in more than one of so many documents of a block is dealt out by block.
HOT = 8

_LOADED: dict[str, sentencepiece.SentencePieceProcessor] = {}


def pretokens(text: str) -> list[str]:
    """Cut before each run of space signs and each line break; the model puts one space sign before any text."""
    return FIND((SPACE + text).replace(" ", SPACE)) if text else []


def model_of(name: str) -> sentencepiece.SentencePieceProcessor:
    if name not in _LOADED:
        model = sentencepiece.SentencePieceProcessor(model_file=file_of(name))
        if any(re.search(f"[^{SPACE}]{SPACE}|.\n|\n.", model.id_to_piece(i)) for i in range(model.vocab_size())):
            raise ValueError(f"{name}: pieces cross pre-tokens")
        _LOADED[name] = model
    return _LOADED[name]


def piece_counts(words: list[str], model: sentencepiece.SentencePieceProcessor) -> np.ndarray:
    """Pieces of each pre-token. The model adds a space sign in front: it stands for the first of the word's own, or, before a line break, counts apart."""
    own = np.fromiter((w[0] != SPACE for w in words), np.int64, len(words))
    ids = model.encode([w if o else w[1:].replace(SPACE, " ") for w, o in zip(words, own)], num_threads=1)
    n = np.fromiter(map(len, ids), np.int64, len(words)) - own
    alone = np.fromiter((w == SPACE for w in words), bool, len(words))
    return np.where(alone, 1, n)  # an empty text has no space sign put before it


FREQUENCIES = "bucket int, block long, words binary, each binary, at binary, freq binary, many binary"


def frequencies(docs: DataFrame, buckets: int) -> DataFrame:
    """One row for each block of documents and bucket of pre-tokens: the block's distinct pre-tokens in that bucket, how many
    documents hold each, those documents by place in the block, and how often each does (0: over 255, next in `many`).

    A pre-token that a large share of a block's documents hold goes to another bucket for each block, so no bucket gets
    all postings of a very common word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, (_, texts) in enumerate(blocks(batches, as_bytes=False, most=BLOCK)):
            block = task << 32 | k
            number = _Numbers()
            flat = [np.fromiter(map(number.__getitem__, ws), np.int64, len(ws)) for ws in map(pretokens, texts)]
            if not number:
                continue
            lengths = np.fromiter(map(len, flat), np.int64, len(flat))
            key = np.concatenate(flat) * len(texts) + np.repeat(np.arange(len(texts)), lengths)
            key, freq = np.unique(key, return_counts=True)
            word, at = np.divmod(key, len(texts))
            each = np.bincount(word, minlength=len(number))
            names = list(number)
            bucket = np.fromiter((zlib.crc32(w.encode()) for w in names), np.int64, len(names))
            bucket = (bucket + np.where(each * HOT > len(texts), block % 1009, 0)) % buckets
            order = np.argsort(bucket, kind="stable")
            first = np.cumsum(each) - each
            pick = np.repeat(first[order] - np.concatenate(([0], np.cumsum(each[order])[:-1])), each[order]) + np.arange(len(key))
            at, freq, each, bucket = at[pick], freq[pick], each[order], bucket[order]
            edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
            pair_edge = np.concatenate(([0], np.cumsum(each)))[edge]
            small = "<u2" if len(texts) <= 1 << 16 else "<u4"
            rows = []
            for i, j, x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), pair_edge[:-1].tolist(), pair_edge[1:].tolist()):
                f = freq[x:y]
                rows.append((int(bucket[i]), block, " ".join([names[o] for o in order[i:j].tolist()]).encode(), each[i:j].astype(small).tobytes() if each[i:j].max() < 1 << 16 else each[i:j].astype("<u4").tobytes(), at[x:y].astype(small).tobytes(), np.where(f > 255, 0, f).astype(np.uint8).tobytes(), f[f > 255].astype("<u4").tobytes()))
            kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], [c.split()[0] for c in FREQUENCIES.split(", ")])

    return id_text(docs).mapInArrow(run, FREQUENCIES)


def _read(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.int64)


class _Numbers(dict):
    """Numbers words as they first come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _counted(rows: pa.Table, model: str) -> pa.Table:
    """A bucket's distinct pre-tokens, their pieces counted once each, joined to the frequencies of every block."""
    number, out = _Numbers(), []
    rows = rows.to_pylist()
    words = [row["words"].decode().split(" ") for row in rows]
    ids = [np.fromiter(map(number.__getitem__, ws), np.int64, len(ws)) for ws in words]
    pieces = piece_counts(list(number), model_of(model))
    for row, own in zip(rows, ids):
        freq = np.frombuffer(row["freq"], np.uint8).astype(np.int64)
        freq[freq == 0] = np.frombuffer(row["many"], "<u4")
        each = _read(row["each"], len(own))
        at = _read(row["at"], len(freq))
        n = np.bincount(at, weights=freq * np.repeat(pieces[own], each)).astype(np.int64)
        at = np.flatnonzero(n)
        out.append((row["block"], at.astype("<u4").tobytes(), n[at].astype("<u8" if n.max() >> 32 else "<u4").tobytes()))
    return pa.table({c: pa.array(v, t) for c, v, t in zip(("block", "at", "n"), zip(*out), (pa.int64(), pa.binary(), pa.binary()))})


def _summed(places: pa.Table, parts: pa.Table) -> pa.Table:
    """A block's documents with the sums of what its buckets found."""
    doc_id, n_bytes = (pa.concat_arrays([v.values for v in places.column(c)[0:1]]) if places.num_rows else pa.array([], pa.int64()) for c in ("doc_ids", "bytes"))
    total = np.zeros(len(doc_id), np.int64)
    for part in parts.to_pylist():
        at = np.frombuffer(part["at"], "<u4")
        total[at] += np.frombuffer(part["n"], "<u4" if len(part["n"]) == 4 * len(at) else "<u8").astype(np.int64)
    return pa.table({"doc_id": doc_id, "n_bytes": n_bytes, "n_tokens": pa.array(total)})


def token_counts(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each row of docs(doc_id, text), which is read twice: rows that come from a shuffle
    are to be stored first, so that both readings see the same blocks."""
    buckets = partitions(docs.sparkSession)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, (part, _) in enumerate(blocks(batches, as_bytes=False, most=BLOCK)):
            n_bytes = pa.compute.binary_length(part.column("text")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([task << 32 | k])] + [pa.array([x.to_pylist()], pa.list_(pa.int64())) for x in (part.column("doc_id"), n_bytes)], ["block", "doc_ids", "bytes"])

    sums = frequencies(docs, buckets).groupBy("bucket").applyInArrow(lambda t: _counted(t, model), "block long, at binary, n binary")
    places = id_text(docs).mapInArrow(placed, "block long, doc_ids array<long>, bytes array<long>")
    return places.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(_summed, "doc_id long, n_bytes long, n_tokens long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
