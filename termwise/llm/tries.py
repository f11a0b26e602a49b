"""Conversation prefix trie from ternary search trees over shards of sorted sequences.

A turn is its (role, text), nulls as empty; a dictionary, keyed by SHA-256, gives each
distinct turn a number, so texts leave the scan only as digests. A sequence is the
numbers of a conversation's turns. Equal sequences are one, with a count.

1. Distinct sequences are dealt to shards by range, so a prefix that a third of all
   conversations share is spread over as many shards as it needs.
2. Each shard inserts its sequences into a ternary search tree, the median first and
   then the medians of both halves, and walks it without recursion: members, children,
   leaves and savings are summed from the last node in order to the first.
3. A shard knows the last sequence before it and the first after it. That tells which
   of its nodes another shard holds as well, and which of those it meets first. What a
   shard reports of such boundary nodes adds up, so one grouping by prefix merges them.

A node's savings are its (members - 1) times the words of its last text. Turns run by
``turn``, nulls first; rows of one turn run by their digest, repeated rows count as
turns. Rows without conv_id belong to no conversation and are left out. An empty table
has no nodes, not even a root. A sequence is one row (8 bytes a turn), a shard about
``SHARD`` turns; the texts are never gathered. Other columns, of any name, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termwise.llm.texts import WORD, written

SHARD, CHUNK = 200_000, 1 << 16


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, ids, words): the turns of each conversation, in order, as dictionary numbers and their words."""
    role, text = (F.coalesce(x, F.lit("")) for x in ("role", "text"))
    keyed = turns.filter("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("key"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    numbers = written(keyed.groupBy("key").agg(F.first("words").alias("words"))
                      .withColumn("id", F.monotonically_increasing_id()), "turns")
    rows = F.sort_array(F.collect_list(F.struct("turn", "key", "id", "words")))
    return (keyed.select("conv_id", "turn", "key").join(numbers, "key").groupBy("conv_id").agg(rows.alias("rows"))
            .select("conv_id", F.col("rows.id").alias("ids"), F.col("rows.words").alias("words")))


def with_shared_openings(found: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Sequences whose first h turns are those of conversation ``c - c % group``; h is crc32 of c's decimals mod ``most``."""
    opening = found.filter(f"conv_id % {group} = 0").select(
        F.col("conv_id").alias("base"), *(F.slice(x, 1, most - 1).alias(f"first_{x}") for x in ("ids", "words")))
    based = found.withColumns({
        "base": F.expr(f"conv_id - conv_id % {group}"),
        "h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")})

    def spliced(name: str):
        first = F.slice(F.coalesce(f"first_{name}", F.array().cast("array<long>")), F.lit(1), F.col("h"))
        rest = F.slice(name, F.col("h") + 1, F.size(name))
        return F.concat(first, rest).alias(name)

    return based.join(opening, "base", "left").select("conv_id", spliced("ids"), spliced("words"))


class Tree:
    """A ternary search tree over sequences of numbers; node 0 is the root of the trie."""

    def __init__(self):
        self.key, self.low, self.equal, self.high = [-1], [0], [0], [0]
        self.parent, self.depth, self.words = [-1], [0], [0]

    def insert(self, ids: list[int], words: list[int]) -> int:
        """The node at which the sequence ends."""
        above = 0
        for x, n in zip(ids, words):
            above = self._child(above, x, n)
        return above

    def _child(self, above: int, x: int, words: int) -> int:
        at, links = above, self.equal
        while links[at]:
            at = links[at]
            if x == self.key[at]:
                return at
            links = self.low if x < self.key[at] else self.high
        links[at] = new = len(self.key)
        for column, value in ((self.key, x), (self.low, 0), (self.equal, 0), (self.high, 0), (self.parent, above),
                              (self.depth, self.depth[above] + 1), (self.words, words)):
            column.append(value)
        return new

    def in_order(self) -> Iterator[int]:
        """Every node after its parent, siblings by number."""
        yield 0
        waiting = [self.equal[0]] if self.equal[0] else []
        while waiting:
            at = waiting.pop()
            if at < 0:
                yield -at
                at = -at
                waiting += [self.equal[at]] if self.equal[at] else []
            else:
                # Lesser siblings, the node and what is below it, greater siblings.
                waiting += [x for x in (self.high[at], -at, self.low[at]) if x]

    def path(self, node: int) -> list[int]:
        out = [node]
        while self.parent[out[-1]] >= 0:
            out.append(self.parent[out[-1]])
        return out[::-1]


def medians(n: int) -> Iterator[int]:
    """0 to n - 1, the middle first, then the middles of both halves, and so on."""
    level = [(0, n)]
    while level:
        spans = []
        for lo, hi in level:
            if lo < hi:
                mid = (lo + hi) // 2
                yield mid
                spans += [(lo, mid), (mid + 1, hi)]
        level = spans


def _common(a, b) -> int:
    """Length of the common start; -1 where there is no other sequence."""
    if a is None or b is None:
        return -1
    n = min(len(a), len(b))
    differ = np.nonzero(np.asarray(a[:n], np.int64) != np.asarray(b[:n], np.int64))[0]
    return int(differ[0]) if len(differ) else n


_ARROW = pa.schema([
    ("key", pa.binary()), ("parent_key", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()),
    ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("saved_tokens", pa.int64()), ("seq", pa.binary())])
_NODE = ", ".join(f"{x.name} {'binary' if pa.types.is_binary(x.type) else 'long'}" for x in _ARROW)


def _shard(rows: pa.Table, beside: pa.Table) -> pa.Table:
    """The nodes of one shard. Those that other shards hold too have a key, and their children have it as parent's."""
    rows = rows.to_pydict()
    place = sorted(range(len(rows["ids"])), key=rows["ids"].__getitem__)
    tree, ends = Tree(), {}
    for i in medians(len(place)):
        ends[tree.insert(rows["ids"][place[i]], rows["words"][place[i]])] = place[i]
    at = {row: node for node, row in ends.items()}
    keys, seen, continued = {}, set(), set()
    for row, other, earlier in ((place[0], beside.column("before")[0].as_py(), True), (place[-1], beside.column("after")[0].as_py(), False)):
        digest = hashlib.sha256()
        for node in tree.path(at[row])[:_common(rows["ids"][row], other) + 1]:
            if node:
                digest.update(tree.key[node].to_bytes(8, "little", signed=True))
            keys[node] = digest.digest()
            (seen if earlier else continued).add(node)
    n = len(tree.key)
    conv, members, children, leaves, saved = [None] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for node, row in ends.items():
        conv[node], members[node] = rows["conv_id"][row], rows["n"][row]
    order = list(tree.in_order())
    for node in reversed(order):
        new = node not in seen
        leaves[node] += not tree.equal[node] and node not in continued
        saved[node] += tree.words[node] * (members[node] - new)
        above = tree.parent[node]
        if above >= 0:
            members[above] += members[node]
            children[above] += new
            leaves[above] += leaves[node]
            saved[above] += saved[node]
            conv[above] = conv[node] if conv[above] is None else min(conv[above], conv[node])
    out = [(keys.get(x), keys.get(tree.parent[x]), conv[x], tree.depth[x], conv[tree.parent[x]] if x else None, members[x],
            children[x], leaves[x], saved[x], rows["seq"][ends[x]] if x in ends else None) for x in order]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ARROW.types)], schema=_ARROW)


def _shards(distinct: DataFrame, turns: int) -> tuple[DataFrame, DataFrame]:
    """The distinct sequences with their shard, and each shard's last sequence before it and first after it."""
    total = distinct.agg(F.sum(F.size("ids") + 1)).first()[0] or 0
    dealt = written(distinct.repartitionByRange(total // turns + 1, "ids").withColumn("shard", F.spark_partition_id()),
                    "shards")
    # Two sequences a shard: the shards in order are few rows.
    edges = dealt.groupBy("shard").agg(F.min("ids").alias("lo"), F.max("ids").alias("hi"))
    return dealt, edges.select("shard", F.expr("lag(hi) OVER (ORDER BY shard)").alias("before"),
                               F.expr("lead(lo) OVER (ORDER BY shard)").alias("after"))


def _joined(ids: list[int]) -> bytes:
    return ",".join(map(str, ids)).encode()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one sequence's conversations, in order, as decimals joined by commas."""
    held, seq, size = [], None, 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([seq], pa.binary()), pa.array([held[0]], pa.int64()), pa.array([_joined(held)], pa.binary())],
            ["seq", "at", "ids"])

    for batch in batches:
        for key, conv in zip(batch.column("seq").to_pylist(), batch.column("conv_id").to_pylist()):
            if held and (key != seq or len(held) >= CHUNK):
                yield out()
                held = []
            seq = key
            held.append(conv)
    if held:
        yield out()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the runs of each sequence, which follow each other in order."""
    seq, digest = None, None

    def out(found: list[tuple[bytes, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in found], pa.binary()), pa.array([x for _, x in found], pa.string())], ["seq", "ends_sha256"])

    for batch in batches:
        found = []
        for key, ids in zip(batch.column("seq").to_pylist(), batch.column("ids").to_pylist()):
            if key != seq:
                if seq is not None:
                    found.append((seq, digest.hexdigest()))
                seq, digest = key, hashlib.sha256(ids)
            else:
                digest.update(b"," + ids)
        yield out(found)
    if seq is not None:
        yield out([(seq, digest.hexdigest())])


def ends(members: DataFrame) -> DataFrame:
    """(seq, ends_sha256) over the conv_ids of each sequence of ``members`` (seq, conv_id).

    The ids are sorted by range, so those of one sequence may lie in many tasks; only text runs
    of them meet in one, in order, and stream through the digest.
    """
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = (members.repartitionByRange(parts, "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
            .mapInArrow(_runs, "seq binary, at long, ids binary"))
    return (runs.repartition("seq").sortWithinPartitions("seq", "at")
            .mapInArrow(_digests, "seq binary, ends_sha256 string"))


def trie(found: DataFrame, shard_turns: int = SHARD) -> DataFrame:
    """The nodes of the trie of ``found`` (conv_id, ids, words); each with its least member.

    Columns: conv_id, depth, parent_conv_id (the parent's), n_convs, n_children, n_leaves, saved_tokens, and
    ends_sha256 over the ids of the conversations that end there."""
    keyed = written(found.withColumn("seq", F.unhex(F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256))),
                    "sequences")
    distinct = keyed.groupBy("seq").agg(F.first("ids").alias("ids"), F.first("words").alias("words"),
                                        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"))
    dealt, beside = _shards(distinct, shard_turns)
    nodes = written(dealt.groupBy("shard").cogroup(beside.groupBy("shard")).applyInArrow(_shard, _NODE), "nodes")
    own = [x for x in nodes.columns if x not in ("key", "parent_key")]
    merged = written(nodes.filter("key IS NOT NULL").groupBy("key").agg(
        F.first("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"),
        F.lit(None).cast("long").alias("parent_conv_id"),
        *(F.sum(x).alias(x) for x in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("seq").alias("seq")), "merged")
    below = nodes.filter("key IS NULL AND parent_key IS NOT NULL").select(*own, "parent_key").unionByName(
        merged.select(*own, "parent_key"))
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_above"))
    placed = nodes.filter("key IS NULL AND parent_key IS NULL").select(*own).unionByName(
        below.join(parents, "parent_key", "left").withColumn("parent_conv_id", F.col("_above")).select(*own))
    ended = placed.filter("seq IS NOT NULL").join(ends(keyed.select("seq", "conv_id")), "seq", "left")
    return ended.drop("seq").unionByName(
        placed.filter("seq IS NULL").drop("seq").withColumn("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
