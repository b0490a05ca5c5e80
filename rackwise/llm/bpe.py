"""Byte-pair encoding and decoding by a traversal of the trie of distinct pre-tokens.

For each prefix of a word, the last token of the prefix's encoding is its state: the token t that ends there and may follow
the state before t. Sorted words visit the trie depth first: a word starts from the states of the prefix it shares with the
word before, so a prefix is encoded once however many words begin with it. A word's ids are read back along the states.

Whether token b may follow token a is found by undoing merges at the seam: no pair that meets there may have a merge that
comes before the merges that built its two sides.

Nulls: a null text is empty, with no tokens; a null doc_id and repeated rows are kept, one result row for each.
Long texts are encoded whole, a text at a time; columns with other names are never read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackwise.llm.common import blocks, id_text, table
from rackwise.llm.pretokens import BYTE_LEVEL, USUAL, file_of, finders

TOKENIZER = "byte_bpe_50k.json"
#: Words and pairs of tokens that a worker remembers; when there are more, it starts anew.
WORDS_KEPT = 200_000
PAIRS_KEPT = 200_000
#: Bytes of text that are cut into pre-tokens at a time: a pre-token takes many times its own length.
AT_A_TIME = 2 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class TrieBpe:
    """Encodes distinct words; keeps what it has encoded, up to a bound."""

    def __init__(self, file: str) -> None:
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        stand = byte_alphabet()
        raw = lambda s: bytes(stand[c] for c in s)
        model = spec["model"]
        self.ids = {raw(s): i for s, i in model["vocab"].items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes: list[bytes] = [b""] * (1 + max([*self.ids.values(), *self.specials.values()]))
        for s, i in self.ids.items():
            self.bytes[i] = s
        for s, i in self.specials.items():
            self.bytes[i] = s.encode()
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.bytes))]
        self.longest = max(map(len, self.ids))
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for k, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            a, b = raw(a), raw(b)
            pair = (self.ids[a], self.ids[b])
            self.rank.setdefault(pair, k)
            self.parts.setdefault(self.ids[a + b], (*pair, k))
        self.find, self.find_any = finders(BYTE_LEVEL)
        self.follows: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    def may_follow(self, a: int, b: int) -> bool:
        rank, parts = self.rank, self.parts
        before = len(rank) + 1  # merges at the seam must come before this one to have happened first
        while True:
            k = rank.get((a, b))
            if k is not None and k < before:
                return False
            left, right = parts.get(a), parts.get(b)
            ka, kb = left[2] if left else -1, right[2] if right else -1
            if ka < 0 and kb < 0:
                return True
            # The later of the two merges is undone. On its left a merge of the same rank at the seam would come after
            # it, from left to right; on its right it would come before.
            if ka > kb:
                before, a = ka, left[1]
            else:
                before, b = kb + 1, right[0]

    def encode_words(self, words: Iterable[str]) -> None:
        """Puts the packed ids of each word into `known`."""
        ids, follows, longest, packed, known = self.ids, self.follows, self.longest, self.packed, self.known
        if len(follows) > PAIRS_KEPT:
            follows.clear()
        last, before = [0], b""
        for word, name in sorted((w.encode(), w) for w in words):
            n, most = 0, min(len(word), len(before))
            while n < most and word[n] == before[n]:
                n += 1
            del last[n + 1 :]
            for end in range(n + 1, len(word) + 1):
                for start in range(max(0, end - longest), end):
                    t = ids.get(word[start:end])
                    if t is None:
                        continue
                    if start:
                        pair = last[start] << 32 | t
                        ok = follows.get(pair)
                        if ok is None:
                            ok = follows[pair] = self.may_follow(last[start], t)
                        if not ok:
                            continue
                    last.append(t)
                    break
            before, out, at = word, [], len(word)
            while at:
                t = last[at]
                out.append(packed[t])
                at -= len(self.bytes[t])
            known[name] = b"".join(out[::-1])

    def pieces(self, text: str) -> list[str]:
        return (self.find_any if USUAL.search(text) else self.find)(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers; special strings in a text get their own id."""
        split: list[list] = []
        for text in texts:
            parts = [text]
            for s in self.specials:
                if s in text:
                    parts = [p for x in parts for p in ([x] if isinstance(x, int) else [y for z in x.split(s) for y in (z, self.specials[s])][:-1])]
            split.append([x if isinstance(x, int) else self.pieces(x) for x in parts])
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        fresh = {w for parts in split for x in parts if not isinstance(x, int) for w in x} - self.known.keys()
        self.encode_words(fresh)
        of = self.known.__getitem__
        return [b"".join(self.packed[x] if isinstance(x, int) else b"".join(map(of, x)) for x in parts) for parts in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[str, TrieBpe] = {}


def coder(name: str) -> TrieBpe:
    if name not in _LOADED:
        _LOADED[name] = TrieBpe(file_of(name))
    return _LOADED[name]


def encode_documents(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, text, ids binary): ids as little-endian unsigned 32-bit integers. One narrow pass; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(tokenizer)
        for part, texts in blocks(batches, most=AT_A_TIME, as_bytes=False):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(bpe.encode(texts), pa.binary())], ["doc_id", "text", "ids"])

    return id_text(docs).mapInArrow(run, "doc_id long, text string, ids binary")


def decode_documents(encoded: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, text string) from (doc_id, ids binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(tokenizer)
        for part, ids in blocks(batches, "ids"):
            texts = [bpe.decode(x or b"").decode("utf-8", "replace") for x in ids]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each text, encoded and decoded again in one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(tokenizer)
        for part, texts in blocks(batches, most=AT_A_TIME, as_bytes=False):
            encoded = bpe.encode(texts)
            decoded = [bpe.decode(x).decode("utf-8", "replace").encode() for x in encoded]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(x) // 4 for x in encoded], pa.int64())] + [pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string()) for xs in (encoded, decoded)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return id_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
