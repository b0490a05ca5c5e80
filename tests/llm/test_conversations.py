"""Chat formatting and the prefix trie against plain Python, and against SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from rackwise.llm import chat_format as chat
from rackwise.llm import conversation_trie as trie
from rackwise.llm import queries

R = random.Random(11)
SCHEMA = "conv_id long, turn long, role string, text string, key string, depth int, at long"
TEXTS = ["", None, "ok", "<s>a</s>", "[INST]x[/INST]", "<<SYS>>s<</SYS>>", "<|turn|>user<|text|>b<|end|>", "\\", "\\\\n\\[INST]", "[\\INST]", "<\\|end|>", "<|image|>", "a\nb  c\td", "größe 你好 😀", "<<s>", "[[INST]INST]", "x" * 5000, "<", "$0 $1"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def conversations():
    rows = [(i, t, R.choice(["user", "assistant", "system", None, "</s>"]), R.choice(TEXTS), "k", 1, 2) for i in range(90) for t in range(R.randrange(9))]
    rows += [(3, None, "assistant", "null turn", None, None, None), (3, 1, None, None, None, None, None), (7, 2, "user", "same", "", 0, 0), (7, 2, "user", "same", "", 0, 0)]
    rows += [(100 + i, t, "user", "hot" if t < 3 else f"own {i % 7}", "", 0, 0) for i in range(60) for t in range(2 + i % 4)]
    rows += [(200, t, "user", f"turn {t % 3}", "", 0, 0) for t in range(80)] + [(201, t, "user", f"turn {t % 3}", "", 0, 0) for t in range(80)]
    rows += [(c, 0, "user", "alone", "", 0, 0) for c in range(301, 309)]  # some lose their only turn
    return R.sample(rows, len(rows))


def ordered(rows):
    """Turns of each conversation; equal turn numbers and roles in the order that the trie's digest gives."""
    out = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        role, text = role or "", text or ""
        out[conv].append(((turn is not None, turn or 0), role, sha(f"{len(role)}:{role}:{text}"), text))
    return {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in out.items()}


def test_chat_formats_and_reads_back(spark):
    rows = conversations()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = chat.formatted(chat.text_messages(chat.with_probe(docs)))
    got = {r.conv_id: r for r in chat.read_back(out).collect()}
    want = defaultdict(list)
    for conv, turn, role, text, *_ in [*rows, (-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)]:
        want[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert got.keys() == want.keys()
    for conv, turns in want.items():
        # Ties of turn and role may stand in any order.
        have = [(r.role, r.text) for r in got[conv].turns]
        assert sorted(have) == sorted((r, t) for *_, r, t in turns) and [r for r, _ in have] == [r for *_, r, _ in sorted(turns)]
        assert got[conv].learned == "".join(t for r, t in have if r == "assistant")
        text = got[conv].formatted
        for control in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"):
            assert control not in text
        assert text.count("<|") == 3 * len(turns)


def test_typed_parts(spark):
    part = lambda kind, **f: {"kind": kind, **{n: f.get(n) for n in ("text", "ref", "width", "height", "seconds", "pages")}}
    parts = [part("text", text="see <|image|> "), part("image", ref="a.png", width=57, height=28), part("audio", ref="b.wav", seconds=1.5), part("document", ref="c.pdf", pages=3), None, part("video", ref="d"), part(None), part("text")]
    answer = [part("text", text="one"), part("image", ref="e.png"), part("text", text="two </s>")]
    rows = [(1, 0, "user", parts), (1, 1, "assistant", answer), (2, 0, "user", None), (3, 0, None, [])]
    out = chat.formatted(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>"))
    got = {r.conv_id: r for r in out.collect()}
    text = got[1].formatted
    assert text == "<|turn|>user<|text|>see <\\|image|> <|image|><|audio|><|document|><|attachment|><|attachment|><|end|><|turn|>assistant<|text|>one<|image|>two <\\/s><|end|>"
    assert [(a.turn_no, a.kind, a.ref, a.n_tokens) for a in got[1].attachments] == [(1, "image", "a.png", 3), (1, "audio", "b.wav", 38), (1, "document", "c.pdf", 1536), (1, "video", "d", 1), (1, "attachment", None, 1), (2, "image", "e.png", 1)]
    for a in got[1].attachments:
        name = a.kind if a.kind in chat.KINDS else "attachment"
        assert text[a.at :].startswith(f"<|{name}|>")
    assert got[1].n_attached == 3 + 38 + 1536 + 3
    back = {r.conv_id: r for r in chat.read_back(out).collect()}
    assert back[1].learned == "onetwo </s>" and [(r.role, r.text) for r in back[1].turns] == [("user", "see <|image|> "), ("assistant", "onetwo </s>")]
    assert got[2].formatted == "<|turn|>user<|text|><|end|>" and got[3].formatted == "<|turn|><|text|><|end|>" and got[2].attachments == [] and got[2].n_attached == 0


def test_chat_runs_without_python(spark):
    plan = chat.read_back(chat.formatted(chat.text_messages(spark.createDataFrame([], SCHEMA))))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert chat.formatted(chat.text_messages(spark.createDataFrame([], SCHEMA))).count() == 0
    long = chat.formatted(chat.text_messages(spark.createDataFrame([(1, 0, "assistant", "[INST] <s> \\ " * 200_000, "", 0, 0)], SCHEMA)))
    assert chat.read_back(long).first().learned == "[INST] <s> \\ " * 200_000


def plainly(paths):
    """Nodes of {conversation: turns}, each by walking all prefixes."""
    members = defaultdict(list)
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, own in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(own) - 1) * len(p[-1][1].encode().split()) if p else 0
    out = []
    for p, own in members.items():
        ends = sorted(c for c in own if len(paths[c]) == len(p))
        out.append((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), children[p], leaves[p], saved[p], sha(",".join(map(str, ends)))))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit, held", [(100_000, 200_000), (20, 3)])
def test_trie_against_plain_python(spark, limit, held):
    rows = conversations()
    turns = ordered(rows)
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = turns.get(c - c % 20, [])[:h] + own[h:]
    docs = spark.createDataFrame([*rows, (None, 0, "user", "no id", None, None, None)], SCHEMA).repartition(3)
    got = trie.trie(trie.rebuilt(trie.turns(docs)), limit, held).drop("key", "parent")
    assert sorted(map(tuple, got.collect()), key=str) == plainly(paths)
    assert any(not p for p in paths.values())


def test_hot_roots_hand_their_nodes_on(spark):
    rows = trie.paths(trie.rebuilt(trie.turns(spark.createDataFrame(conversations(), SCHEMA))))
    nodes = rows.groupBy("key").agg(F.any_value("tops").alias("tops"))
    dealt, levels = trie.sharded(nodes, 10)
    assert levels > 2 and dealt.filter("level >= 0").groupBy("level", F.expr("tops[level]")).count().filter("count > 10 AND level < 4").count() <= 4
    assert trie.sharded(nodes, 10**9)[1] == 1


def test_queue_spills():
    queue = trie.SpillingQueue(held=5)
    messages = [(R.randrange(6), bytes([R.randrange(3)]) * 16, 1, R.randrange(9), R.randrange(9)) for _ in range(200)]
    for m in messages:
        queue.push(m)
    assert len(queue.runs) > 20 and len(queue.heap) <= 6
    want = defaultdict(lambda: [0, 0, 0])
    for order, key, *v in messages:
        want[order, key] = [a + b for a, b in zip(want[order, key], v)]
    for order, key in sorted(want):
        assert list(queue.taken(order, key)) == want[order, key]
    assert queue.first() is None


def test_no_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert trie.trie(trie.rebuilt(trie.turns(none))).count() == 0
    assert [r.conv_id for r in chat.formatted(chat.text_messages(chat.with_probe(none))).collect()] == [-1]


@pytest.mark.parametrize("name", ["op11_chat", "op12_prefix_trie"])
def test_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, sf)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.select(", ".join(got.columns)).fetchall(), key=str)
