"""The native estimate against a minimum-covariance-determinant search in numpy with many starts."""

import numpy as np

from rackwise.llm import quality as q


def fast_mcd(x, starts=60, steps=15, seed=1):
    """(mean, covariance) of the reweighted estimate, with the operator's floors, share and factors, by whole sorts and many random starts."""
    r, n = np.random.default_rng(seed), len(x)
    floor = np.diag([f**2 for _, f in q.FEATURES])
    h = int(np.ceil(q.H * n))
    scale = q.H / q.chi2_cdf(q.chi2_quantile(q.H, q.P), q.P + 2)
    d2 = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    best = None
    for k in range(starts):
        rows = x if not k else x[r.choice(n, min(n, q.SUBSET), replace=False)]
        m, c = rows.mean(0), np.cov(rows.T, bias=True) + floor
        for _ in range(steps):
            rows = x[np.argsort(d2(m, c), kind="stable")[:h]]
            m, c = rows.mean(0), scale * np.cov(rows.T, bias=True) + floor
        det = np.linalg.slogdet(c)[1]
        if best is None or det < best[0]:
            best = det, m, c
    near = x[d2(*best[1:]) <= q.chi2_quantile(0.975, q.P)]
    m, c = near.mean(0), np.cov(near.T, bias=True) / (q.chi2_cdf(q.chi2_quantile(0.975, q.P), q.P + 2) / 0.975) + floor
    return d2(m, c)


def test_kept_is_that_of_a_long_search(spark):
    """All rows of sf0.01 that pass the base rules: the verdicts are those of numpy's search, but for a row in a thousand."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = q._grouped(q.stored(q.vectors(q.statistics(docs)))).filter("NOT base_failed AND grp IS NOT NULL").select("doc_id", "grp", *q.NAMES).toPandas()
    kept = {r.doc_id: r.kept for r in q.quality_rules(docs).collect()}
    differ = n = rejected = 0
    for _, g in rows.groupby("grp"):
        out = fast_mcd(g[q.NAMES].to_numpy()) > q.chi2_quantile(1 - q.CHANCE, q.P)
        differ += sum(bool(o) == kept[i] for i, o in zip(g["doc_id"], out))
        rejected += int(out.sum())
        n += len(g)
    assert n > 500 and rejected > 20 and differ <= n // 1000, (differ, n, rejected)


def test_ties_repeats_and_null_columns(spark):
    """Rows that agree exactly, repeated rows and null ids have one verdict each; odd ones among them are rejected."""
    like = " ".join(f"word{k}" for k in range(80))
    odd = " ".join(["#$%&*|<>" * 4 + str(k) for k in range(80)])
    docs = spark.createDataFrame([(None if k % 3 else 7, like, None, None, "clash") for k in range(120)] + [(8, odd, None, None, "c")] * 2 + [(9, None, "en", None, "c"), (10, like * 400, None, None, "c")], "doc_id long, text string, lang string, source string, d2 string")
    got = q.quality_rules(docs).collect()
    assert len(got) == 124 and all(r.kept for r in got if r.doc_id in (7, None)) and not any(r.kept for r in got if r.doc_id in (8, 9))
    assert [r.n_words for r in got if r.doc_id == 10] == [80 * 400 - 399]
