"""Phrase counts and collocations against plain counting; the two-way index against plain counting."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from rackwise.llm import collocations as co
from rackwise.llm import queries
from rackwise.llm.fm_index import TwoWayIndex

R = random.Random(5)
SCHEMA = "doc_id long, text string, lang string, word string, f long, block long, bucket int"


def test_two_way_index():
    text = np.random.default_rng(1).integers(0, 7, 2000)
    text[[0, -1]] = 0
    index = TwoWayIndex(text, 5)
    right = left = index.symbols()
    for k in range(2, 6):
        right, left = index.right(right), index.left(left)
        want = Counter(w for i in range(len(text) - k + 1) if 0 not in (w := tuple(text[i : i + k].tolist())))
        for p in (right, left):
            assert {tuple(w): n for *w, n in zip(*(s.tolist() for s in p.symbols), p.n.tolist())} == want
        assert sorted(zip(right.low.tolist(), right.back.tolist(), right.n.tolist())) == sorted(zip(left.low.tolist(), left.back.tolist(), left.n.tolist()))
        by = index.right_by(right[right.n > 1], right.symbols[-1][right.n > 1])
        longer = Counter(w for i in range(len(text) - k) if 0 not in (w := tuple(text[i : i + k + 1].tolist())))
        assert all(longer[tuple(w)] == n for *w, n in zip(*(s.tolist() for s in by.symbols), by.n.tolist()))


def test_parts_end_between_pieces():
    text = b"a b\ncc d\n\neeeeeeeeeeee ffffffffff\ng"
    for most in (1, 3, 8, 100):
        parts = list(co.cut_pieces(text, most))
        assert b"\n".join(parts) == text
        assert all(len(p) <= most or b"\n" not in p.strip(b"\n") for p in parts)
    assert (co.unpacked(co.packed(np.array([], "<u8"), True), "<u8", True) == []).all()


def plainly(rows, least, top):
    """The contract, counted phrase by phrase."""
    f, total = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = {p[i:j] for p, a in found.items() for i in range(len(p)) for j in range(i + 1, len(p) + 1) if j - i < len(p) and counts[p[i:j]] == a}
        scored = []
        for p, a in found.items():
            if p not in inside:
                score, _, l, r = min((1000 * a * total[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def some_rows():
    words = ["the", "of", "New", "York", "city", "Größe", "a\x00b", "-", "x"] + [f"w{i}" for i in range(12)]
    phrases = ["new york city hall", "In the NEW york", "one two three four five six", "a a a a a a"]
    text = lambda n: "".join(R.choice(phrases if R.random() < 0.3 else words) + R.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "\r\n", ",", "!"]) for _ in range(n))
    rows = [(i, text(R.randrange(60)), R.choice(["en", "en", "de", None, "und", "a b"]), "clash", 7, 3, 1) for i in range(150)]
    rows += [(None, None, "en", None, None, None, None), (1, "", None, None, None, None, None), (2, " .,\n", "xx", "", 0, 0, 0), (3, text(3000), "en", "", 0, 0, 0)]
    return rows + [rows[5]] * 4


@pytest.mark.parametrize("least, top, most", [(3, 2000, 700), (6, 15, 1 << 20)])
def test_against_plain_counting(spark, tmp_path, least, top, most):
    rows = some_rows()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    phrases, words = co.collocations(docs, least=least, most=most, entries=1000)
    got = sorted(map(tuple, co.top_phrases(phrases, words, top).collect()))
    assert got == plainly(rows, least, top) and len(got) > 30


def test_depth_and_extensions(spark):
    docs = spark.createDataFrame([(1, "a b c d. a b c. b c", "en"), (2, "a b c", "de")], "doc_id long, text string, lang string")
    phrases, words = co.collocations(docs, depth=3, least=2)
    name = {r.gid: r.word for r in words.collect()}
    got = {" ".join(name[w] for w in r.words): (r.a, r.most_left, r.most_right, r.l, r.r, r.n, r.score) for r in phrases.collect()}
    assert got == {"a b": (2, None, 2, 2, 3, 9, 3000), "b c": (3, 2, None, 3, 3, 9, 3000), "a b c": (2, None, None, 2, 3, 9, 3000)}
    assert [r.phrase for r in co.top_phrases(phrases, words).collect()] == ["b c", "a b c"]


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert co.top_phrases(*co.collocations(none)).collect() == []
    nulls = spark.createDataFrame([(None,) * 7], SCHEMA)
    assert co.top_phrases(*co.collocations(nulls, least=1)).collect() == []


def test_products_beyond_64_bits(spark):
    row = spark.createDataFrame([(10**12, 10**13, 2 * 10**12, 3 * 10**12)], "a long, n long, l long, r long")
    assert row.selectExpr("CAST((CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0))) AS BIGINT) AS s").first().s == 1000 * 10**25 // (6 * 10**24)


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(queries.oracle_sql()["op13_collocations"])
    got = queries.queries()["op13_collocations"](spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(want.select(", ".join(got.columns)).fetchall())
