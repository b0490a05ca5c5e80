"""Katz models of one to four words by plain counts and plain recursion."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rackwise.llm import katz

START, END = b"<start>", b"<end>"


def rows():
    """Texts over few words, so that longer n-grams repeat; empty, null, short and repeated ones; null and repeated ids."""
    r = random.Random(77)
    some = [(i, " ".join(r.choice("Aa b c d e f g".split()) for _ in range(r.randint(0, 40)))) for i in range(120)]
    return some + [(200, None), (201, ""), (202, "a"), (203, "a b"), (None, "b a b a"), (5, some[5][1]), (5, some[5][1]), (206, "c " * 3000), (207, "held out words only")]


def split(text):
    return (text or "").encode().lower().split() + [END]


class Plain:
    """The same model from dictionaries, one probability at a time."""

    def __init__(self, texts, order):
        self.n = [Counter() for _ in range(order)]
        for t in texts:
            own = [START, *split(t)]
            for i in range(1, len(own)):
                for k in range(order):
                    if i >= k:
                        self.n[k][tuple(own[i - k : i + 1])] += 1
        self.d = [self.discount(c) for c in self.n]
        self.total, self.types = sum(self.n[0].values()), len(self.n[0])
        self.left = sum(c - self.d[0](c) for c in self.n[0].values())
        self.after: dict = {}
        for k in range(1, order):
            for g in self.n[k]:
                self.after.setdefault(g[:-1], []).append(g[-1])
        self.follow = {h: sum(self.n[len(h)][(*h, w)] for w in ws) for h, ws in self.after.items()}
        self.alphas: dict = {}

    @staticmethod
    def discount(counts):
        n = Counter(counts.values())
        tail = 6 * n[6] / n[1] if n[1] else 1.0
        ratio = lambda c: ((c + 1) * n[c + 1] / (c * n[c]) - tail) / (1 - tail) if n[c] and tail < 1 else 0.0
        return lambda c: c if c > 5 else c * (ratio(c) if 0 < ratio(c) < 1 else (c - 0.5) / c)

    def p(self, h, w):
        if not h:
            return (self.d[0](self.n[0][w,]) if self.n[0][w,] else self.left + 1) / (self.total + 1)
        c = self.n[len(h)][(*h, w)]
        return self.d[len(h)](c) / (self.follow[h] + 1) if c else self.alpha(h) * self.p(h[1:], w)

    def alpha(self, h):
        if h not in self.alphas:
            ws = self.after.get(h, [])
            self.alphas[h] = (1 - sum(self.p(h, w) for w in ws)) / (1 - sum(self.p(h[1:], w) for w in ws))
        return self.alphas[h]

    def score(self, text, order):
        own = [START, *split(text)]
        return sum(np.log10(self.p(tuple(own[max(0, i - order + 1) : i]), own[i])) for i in range(1, len(own)))


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_katz_of_any_order(spark, tmp_path, monkeypatch, order):
    monkeypatch.setattr(katz, "BLOCK", 500)  # many blocks
    all_rows = rows()
    held = lambda i: i is not None and i % 3 == 0
    plain = Plain([t for i, t in all_rows if not held(i)], order)
    for h in [h for h in plain.after if len(h) == order - 1][:60]:
        assert abs(sum(plain.p(h, *w) for w in plain.n[0]) + plain.p(h, b"<unknown>") - 1) < 1e-9
    docs = spark.createDataFrame([(i, t, "clash") for i, t in all_rows], "doc_id long, text string, kind string").repartition(3)
    model, scored = katz.fit(docs, F.col("doc_id") % 3 == 0, order)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    base = lambda t: sum(np.log10((plain.n[0][w,] + 0.5) / (plain.total + 0.5 * (plain.types + 1))) for w in split(t))
    compare = lambda got, texts: [
        np.testing.assert_allclose([np.nan if v is None else v for v in a], [np.nan if v is None else v for v in b], rtol=1e-8, atol=1e-8)
        for a, b in zip(sorted(got, key=key), sorted([(i, len(split(t)), base(t), plain.score(t, order)) for i, t in texts], key=key), strict=True)
    ]
    compare([(r.doc_id, r.n_tokens, r.base_score, r.score) for r in scored.collect()], all_rows)
    model.save(f"{tmp_path}/model")
    loaded = katz.Model.load(spark, f"{tmp_path}/model")
    others = [(1, None), (2, "never seen words"), (None, "a b c d"), (3, "b a never a b c"), (3, "A A A a"), (4, "g " * 50)]
    compare([(r.doc_id, r.n_tokens, r.base_score, r.score) for r in loaded.scores(spark.createDataFrame(others, "doc_id long, text string")).collect()], others)


def test_katz_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    with pytest.raises(ValueError):
        katz.fit(none, F.lit(False), 0)
    model, scored = katz.fit(none, F.lit(False), 3)
    assert scored.count() == 0
    model.save(f"{tmp_path}/model")
    loaded = katz.Model.load(spark, f"{tmp_path}/model")
    assert [r.score for r in loaded.scores(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")).collect()] == [0.0, 0.0]
    empties, scored = katz.fit(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), F.lit(False), 3)
    assert sorted(r.n_tokens for r in scored.collect()) == [1, 1]
