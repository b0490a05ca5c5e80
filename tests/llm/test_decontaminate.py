"""Decontamination: norms by counts, no cosine above 1, long passages, and all pairs recounted by plain common subsequences."""

import random
from collections import Counter

import numpy as np
import pytest

from rackwise.llm import decontaminate as dc


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_windows_have_the_norms_of_their_counts():
    r = np.random.default_rng(2)
    terms = 30
    weight = r.uniform(0.5, 3, terms)
    latent = r.random(terms) < 0.4
    latent[0] = False
    passages = dc.Passages(weight, latent, "<u2")
    seen = 0
    for n in (3, 15, 16, 40, 700):
        for rare in (0.05, 0.3, 0.9):
            ids = np.where(r.random(n) < rare, r.integers(1, terms, n), 0).astype("<u2")
            got = {(int(s), size): norm for _, starts, size, norms in passages.windows(ids.tobytes()) for s, norm in zip(starts, norms)}
            for size in dc.SIZES:
                if size > 16 and n <= size // 2:
                    continue
                for s in {*range(0, max(0, n - size) + 1, size // 4), max(0, n - size)}:
                    count = Counter(ids[s : s + size].tolist())
                    whole = sum((c * weight[t]) ** 2 for t, c in count.items() if t) + count[0] * weight[0] ** 2
                    part = sum((c * weight[t]) ** 2 for t, c in count.items() if latent[t])
                    assert ((s, size) in got) == (part > 0 and part >= dc.NEAR**2 * whole)
                    if (s, size) in got:
                        seen += 1
                        assert got[s, size] == pytest.approx(whole**0.5)
    assert seen > 100


def draws(seed):
    r = random.Random(seed)
    words = [f"q{k}" for k in range(2000)]
    return r, lambda n: r.choices(words, [1 / (k + 5) for k in range(2000)], k=n)


def pairs(spark, rows, items):
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    return dc.contaminated_pairs(spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string").repartition(2), bench).collect()


def test_repeated_words_and_items(spark):
    """Items with a word or the whole repeated: found, with cosines of 1 at most."""
    r, draw = draws(31)
    items = [draw(16) for _ in range(20)]
    rows = [(i, [f"o{k}" for k in range(200)] + ([item[3]] * 4 + item if i % 2 else item * 3) + [f"p{k}" for k in range(200)]) for i, item in enumerate(items)]
    got = pairs(spark, rows, items)
    assert {(i, i) for i in range(20)} <= {(x.doc_id, x.item_id) for x in got} and max(x.cosine for x in got) <= 1 + 1e-6
    assert all(x.lcs_share == 1 for x in got if x.doc_id == x.item_id)


@pytest.mark.parametrize("times", [2, 3, 4])
def test_passages_of_several_item_lengths(spark, times):
    """Items spread over passages of two to four times their length by foreign words: 9 of 10 are found, and no clean text."""
    r, draw = draws(32)
    items, rows = [draw(n) for n in [15, 20, 30, 40] * 10], []
    for i, item in enumerate(items):
        passage = [f"f{r.randrange(10**6)}" for _ in range(times * len(item))]
        for at, w in zip(sorted(r.sample(range(len(passage)), len(item))), item):
            passage[at] = w
        rows.append((i, [f"o{k}" for k in range(150)] + passage + [f"p{k}" for k in range(150)]))
    rows += [(1000 + k, draw(300)) for k in range(100)]
    got = {(x.doc_id, x.item_id) for x in pairs(spark, rows, items)}
    right = {(i, i) for i in range(40)}
    assert len(got & right) >= 36 and len(got - right) <= 2, (len(got & right), got - right)


def test_all_pairs_by_plain_subsequences(spark):
    """Every pair of a document and an item: what a passage of one and a half item lengths shows is found; what is found shows in the whole document."""
    r, draw = draws(33)
    items = [draw(n) for n in [6, 10, 14, 20, 30] * 3]
    rows = []
    for k in range(60):
        item = items[k % len(items)]
        own = [w for w in item if r.random() > r.choice([0, 0.1, 0.25, 0.4, 0.7])]
        rows.append((k, draw(r.randrange(60)) + own + draw(r.randrange(60))))
    got = {(x.doc_id, x.item_id): x for x in pairs(spark, rows, items)}
    held = Counter(w for _, t in rows for w in set(t))
    latent = {w for item in items for w in item if held[w] <= dc.COMMON * len(rows)} | {w for item in items for w in sorted(set(item), key=lambda w: (held[w], w))[: dc.RAREST]}

    def accepted(item, text):
        share = subsequence(item, text) / len(item)
        answer = item[-5:]
        told = subsequence(answer, text) >= dc.SAME_SHORT * len(answer)
        if share >= dc.SAME_SHORT:
            return True
        if share < dc.PARAPHRASE or not told and (share < dc.SAME or len(item) < dc.SHORT):
            return False
        rare = [w for w in item if w in latent]
        return subsequence(rare, [w for w in text if w in latent]) >= dc.RARE * len(rare)

    must = 0
    for k, text in rows:
        for i, item in enumerate(items):
            n = len(item) * 3 // 2
            if any(accepted(item, text[a : a + n]) for a in range(max(1, len(text) - n + 1))):
                must += 1
                assert (k, i) in got, (k, i)
            elif (k, i) in got:
                assert got[k, i].lcs_share <= subsequence(item, text) / len(item) + 1e-9 and subsequence(item, text) >= dc.PARAPHRASE * len(item)
    assert must > 30
