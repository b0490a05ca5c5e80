"""Conversation prefix trie with subtree totals by time-forward processing.

Every distinct sequence of a conversation's first d turns is a node, known by a digest chained over its turns, so a node's key
needs nothing but its parent's key and one turn; texts leave the table as digests and numbers of words at once. Nodes are
partial sums by key before they move, so a beginning that all conversations share costs one row a task.

Totals of subtrees go from the leaves up. Nodes are dealt to shards by an ancestor, the shard's root, and sorted externally by Spark in
reverse level order (deepest first, then by key). One pass over that order takes a node's messages from a priority queue, adds
them to the node's own, and sends the sum to its parent, which comes later in the order. The queue holds a bounded number of messages
and spills sorted runs to the task's own temporary folder. What reaches the roots of shards is then summed by parent and carried on across shards.

A shard's root has depth 1 at first. A root with more than `limit` nodes below gives its deeper nodes to roots at the next depth of
CUTS, again and again, so that a first turn that a third of all conversations share is no hot shard: messages that go to
one parent from many shards are summed before they move.

Order of a conversation's turns: turn (null first), role, digest of the turn; repeated rows are turns of their own. Null roles and texts
are empty. Rows with a null conv_id belong to no conversation and are left out. Other columns are left behind; an empty table gives no
nodes. The members that end at a node are hashed in one stream sorted by Spark, as their digest asks for; no list of members is held.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rackwise.llm.common import partitions, stored, table

GROUP = 20
SHARED = 4
#: Nodes below one shard root beyond which the deeper ones get roots of their own.
LIMIT = 100_000
#: Messages that a queue holds in memory.
HELD = 200_000
ROOT = b"\0" * 16
TOTALS = ("n_children", "n_leaves", "saved_tokens")


def is_cut(depth: int) -> bool:
    """Depths at which shard roots may lie: 1, 2, 3, 4, then doubled."""
    return 0 < depth <= 4 or depth > 4 and depth & (depth - 1) == 0


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, rank, digest, n_words) of every turn, in order from 1."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # The length in front keeps roles and texts apart.
    digest = F.unhex(F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words"))
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "digest"))
    return rows.filter("conv_id IS NOT NULL").select("conv_id", rank.cast("long").alias("rank"), "digest", "n_words")


def rebuilt(rows: DataFrame, group: int = GROUP, shared: int = SHARED) -> DataFrame:
    """(conv_id, part, rank, digest, n_words): a marker row (part 0) for each conversation c of turns(), the first h turns of
    conversation c - c % group (part 1) and c's own turns after its first h (part 2); h is crc32 of c in decimals, modulo `shared`."""
    c = F.col("conv_id")
    h = F.crc32(c.cast("string")) % shared
    convs = rows.select("conv_id").distinct().select("conv_id", (c - c % group).alias("base"), h.alias("h"))
    lead = rows.filter((c % group == 0) & (F.col("rank") < shared)).select(c.alias("base"), "rank", "digest", "n_words").join(convs, "base").filter("rank <= h")
    own = rows.filter(F.col("rank") > h).select("conv_id", F.lit(2).alias("part"), "rank", "digest", "n_words")
    mark = convs.select("conv_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("rank"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("n_words"))
    return own.unionByName(mark).unionByName(lead.select("conv_id", F.lit(1).alias("part"), "rank", "digest", "n_words"))


def paths(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, key, parent, n_words, tops, ends): the nodes on each conversation's way from the root; tops are the keys of
    its ancestors, itself included, at the depths of is_cut; ends marks the last."""
    ordered = rows.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "rank")
    kinds = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("key", pa.binary()), ("parent", pa.binary()), ("n_words", pa.int64()), ("tops", pa.list_(pa.binary())), ("ends", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out = []
            for conv, part, digest, words in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "digest", "n_words"))):
                if part == 0:
                    key, parent, depth, tops = ROOT, None, 0, []
                else:
                    parent, depth = key, depth + 1
                    key = hashlib.blake2b(parent + digest, digest_size=16).digest()
                    if is_cut(depth):
                        tops = [*tops, key]
                if last:
                    out.append((*last, part == 0))
                last = (conv, depth, key, parent, words, tops)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [[]] * len(kinds), kinds)], schema=kinds)
        if last:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*last, True), kinds)], schema=kinds)

    return ordered.mapInArrow(run, "conv_id long, depth long, key binary, parent binary, n_words long, tops array<binary>, ends boolean")


def ends_digest(found: DataFrame) -> DataFrame:
    """(key, ends_sha256): of the conversations that end at each node, in rising order, as one stream."""
    ordered = found.filter("ends").select("key", "conv_id").repartition(partitions(found.sparkSession), "key").sortWithinPartitions("key", "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        for batch in batches:
            out = []
            for key, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
                if key != last:
                    if digest:
                        out.append((last, digest.hexdigest()))
                    last, digest = key, hashlib.sha256(b"%d" % conv)
                else:
                    digest.update(b",%d" % conv)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.string())], ["key", "ends_sha256"])
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([digest.hexdigest()])], ["key", "ends_sha256"])

    return ordered.mapInArrow(run, "key binary, ends_sha256 string")


class SpillingQueue:
    """Messages (order, key, totals) taken in rising order. More than `held` of them are written as a sorted run to a file of the
    task's temporary folder that goes with the queue; runs are read a record at a time."""

    RECORD = struct.Struct(">q16s3q")

    def __init__(self, held: int = HELD) -> None:
        self.held, self.heap, self.fronts, self.runs = held, [], [], []

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.held:
            self._spill()

    def _spill(self) -> None:
        run = tempfile.TemporaryFile(buffering=1 << 16)
        for message in sorted(self.heap):
            run.write(self.RECORD.pack(*message))
        run.seek(0)
        self.heap = []
        self.runs.append(run)
        self._next(len(self.runs) - 1)

    def _next(self, k: int) -> None:
        record = self.runs[k].read(self.RECORD.size)
        if record:
            heapq.heappush(self.fronts, (self.RECORD.unpack(record), k))
        else:
            self.runs[k].close()

    def first(self) -> tuple | None:
        if self.fronts and (not self.heap or self.fronts[0][0] < self.heap[0]):
            return self.fronts[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.fronts and (not self.heap or self.fronts[0][0] < self.heap[0]):
            message, k = heapq.heappop(self.fronts)
            self._next(k)
            return message
        return heapq.heappop(self.heap)

    def taken(self, order: int, key: bytes) -> tuple[int, int, int]:
        """The sum of the messages to one node, and their number."""
        n = leaves = saved = 0
        while (message := self.first()) and message[0] == order and message[1] == key:
            _, _, k, a, b = self.pop()
            n, leaves, saved = n + k, leaves + a, saved + b
        return n, leaves, saved


def time_forward(nodes: DataFrame, held: int = HELD) -> DataFrame:
    """(key, parent, top, n_children, n_leaves, saved_tokens) of nodes(shard, key, parent, depth, top, own, the totals of other shards
    in n_children, n_leaves, saved_tokens): `own` is what a node adds to its subtree, `top` marks the roots of shards."""
    ordered = nodes.repartition(partitions(nodes.sparkSession), "shard").sortWithinPartitions(F.desc("depth"), "key")
    names = ("key", "parent", "depth", "top", "own", *TOTALS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = SpillingQueue(held)
        for batch in batches:
            out = []
            for key, parent, depth, top, own, n, leaves, saved in zip(*(batch.column(c).to_pylist() for c in names)):
                k, a, b = queue.taken(-depth, key)
                n, leaves, saved = n + k, leaves + a, saved + b + own
                leaves = leaves if n else 1
                out.append((key, parent, top, n, leaves, saved))
                if not top:
                    queue.push((1 - depth, parent, 1, leaves, saved))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 6, (pa.binary(), pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()))], ["key", "parent", "top", *TOTALS])

    return ordered.select("shard", *names).mapInArrow(run, "key binary, parent binary, top boolean, n_children long, n_leaves long, saved_tokens long")


def _to_parents(totals: DataFrame) -> DataFrame:
    """What the roots of shards send: one row for each parent."""
    return totals.filter("top").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))


def sharded(nodes: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, int]:
    """nodes with `level`, the place in tops of the shard root that a node belongs to, and the number of levels; the root has level -1."""
    c = F.col
    dealt, level = nodes.withColumn("level", F.when(F.size("tops") == 0, -1).otherwise(0)), 0
    while True:
        dealt = stored(dealt)
        top = F.get("tops", F.lit(level))
        hot = dealt.filter(c("level") == level).groupBy(top.alias("hot")).agg(F.count("*").alias("n"), F.max(F.size("tops")).alias("most")).filter((c("n") > limit) & (c("most") > level + 1)).select("hot")
        if hot.isEmpty():
            return dealt, level + 1
        marked = dealt.withColumn("at", F.when((c("level") == level) & (F.size("tops") > level + 1), top)).join(hot, c("at") == c("hot"), "left")
        dealt = marked.withColumn("level", F.when(c("hot").isNotNull(), level + 1).otherwise(c("level"))).drop("at", "hot")
        level += 1


def subtree_totals(nodes: DataFrame, limit: int = LIMIT, held: int = HELD) -> DataFrame:
    """(key, n_children, n_leaves, saved_tokens) of every node of nodes(key, parent, depth, own, tops)."""
    c = F.col
    dealt, levels = sharded(nodes, limit)
    done, sent = [], None

    def joined(part: DataFrame) -> DataFrame:
        zero = [F.lit(0).cast("long").alias(n) for n in TOTALS]
        return part.select("*", *zero) if sent is None else part.join(sent, "key", "left").fillna(0, list(TOTALS))

    for level in range(levels - 1, -1, -1):
        part = joined(dealt.filter(c("level") == level).withColumn("shard", F.get("tops", F.lit(level))))
        # A shard's root is the ancestor itself.
        found = stored(time_forward(part.withColumn("top", c("key") == c("shard")), held))
        done.append(found.select("key", *TOTALS))
        sent = _to_parents(found)
    root = joined(dealt.filter("level = -1"))
    out = root.select("key", "n_children", F.when(c("n_children") > 0, c("n_leaves")).otherwise(1).cast("long").alias("n_leaves"), (c("saved_tokens") + c("own")).alias("saved_tokens"))
    for part in done:
        out = out.unionByName(part)
    return out


def trie(rows: DataFrame, limit: int = LIMIT, held: int = HELD) -> DataFrame:
    """One row a node of conversations given as marker and turn rows (see rebuilt): key, parent, conv_id (its smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    c = F.col
    found = stored(paths(rows))
    same = ("depth", "parent", "n_words", "tops")
    nodes = stored(found.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.any_value(n).alias(n) for n in same]))
    totals = subtree_totals(nodes.select("key", "parent", "depth", "tops", ((c("n_convs") - 1) * c("n_words")).alias("own")), limit, held)
    parents = nodes.select(c("key").alias("parent"), c("conv_id").alias("parent_conv_id"))
    out = nodes.drop("tops", "n_words").join(totals, "key").join(ends_digest(found), "key", "left").join(parents, "parent", "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("key", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", *TOTALS, F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trie(rebuilt(stored(turns(table(spark, sf_dir, "conversations")))))
    return found.drop("key", "parent")
