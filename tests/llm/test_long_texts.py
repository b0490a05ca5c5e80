"""Very long texts among short ones, beside repeated rows with null ids, through each operator."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rackwise.llm import bpe, html_text, katz, simhash, substring, token_counts, toxicity
from rackwise.llm.html_pages import labelled_pages
from pyspark.sql import functions as F

R = random.Random(41)
WORDS = [f"w{k}" for k in range(3000)] + ["größe", "don't", "…"]
LONG = [R.choice(WORDS) for _ in range(250_000)]
SHORT = [" ".join(R.choice(WORDS) for _ in range(60)) for _ in range(20)]
#: The long text, a part of it, the same row twice without an id, an empty one.
ROWS = [(0, " ".join(LONG)), (1, " ".join(LONG[1000:1120])), (None, SHORT[0]), (None, SHORT[0]), (2, ""), *((k + 10, t) for k, t in enumerate(SHORT))]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("long") / "d")
    spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


def same(got, want):
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_tokens(docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = [t.encode(x, add_special_tokens=False).ids for _, x in ROWS]
    same([(r.doc_id, r.n_tokens, r.ids_sha256) for r in bpe.round_trip(docs).collect()], [(i, len(v), hashlib.sha256(np.array(v, "<u4").tobytes()).hexdigest()) for (i, _), v in zip(ROWS, ids)])
    same([(r.doc_id, r.n_tokens) for r in token_counts.token_counts(docs).collect()], [(i, len(m.encode(x))) for i, x in ROWS])


def test_encoding_and_decoding_apart(docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoded = bpe.encode_documents(docs)
    same([(r.doc_id, r.text, np.frombuffer(r.ids, "<u4").tolist()) for r in encoded.filter("length(text) < 1000").collect()], [(i, x, t.encode(x, add_special_tokens=False).ids) for i, x in ROWS if len(x) < 1000])
    same([tuple(r) for r in bpe.decode_documents(encoded).collect()], ROWS)


def test_simhash_and_substring(docs):
    groups = {(r.doc_id, r.component_id) for r in simhash.simhash_groups(docs).collect()}
    assert {(i, i) for i in (0, 1, 2, *range(10, 30))} <= groups
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.substring_dedup(docs).collect() if r.doc_id is not None}
    assert got[0] == (250_000, 120) and got[1] == (120, 120) and got[10] == (60, 60) and got[11] == (60, 0) and got[2] == (0, 0)


def test_katz_and_toxicity(spark, docs):
    rows = {r.doc_id: r for r in katz.scores(docs, F.col("doc_id") == 11).collect()}
    assert rows[0].n_tokens == 250_001 and np.isfinite(rows[0].score) and rows[0].score < rows[10].score < 0 and rows[2].n_tokens == 1
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(30)], "doc_id long, toxic int")
    scores = toxicity.toxicity(docs, labels).collect()
    assert len(scores) == len(ROWS) and all(0 <= r.score <= 1 for r in scores) and len({r.score for r in scores if r.doc_id is None}) == 1


def test_pages(spark):
    model = html_text.train(spark.createDataFrame([(p,) for p in labelled_pages(100)], "html string"))
    page = "<html><body><nav><a href=/>Home</a></nav><article>" + "".join(f"<p>{t}.</p>" for t in SHORT * 500) + "</article></body></html>"
    rows = [(0, "u", page), (None, None, page), (None, None, page), (1, "u", None), (2, "u", "")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()
    want = "\n".join(f"{t}." for t in SHORT * 500)
    same([(r.page_id, r.text) for r in got], [(0, want), (None, want), (None, want), (1, ""), (2, "")])
