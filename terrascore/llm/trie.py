"""Prefix trie of conversations by vertical bitmaps.

Each conversation is a path of turn digests.  Paths are dealt by ranges of
conv_id to shards of bounded size; a shard indexes (position, turn) to the
bitset of its conversations.  A depth-first walk intersects a node's bitset
with the postings of its members' next turns, which gives the children, their
popcounts and, with the bitset of conversations of that length, the members
that end there.  A node is named by a hash chain over its turns, so the
shards' nodes meet by a partially aggregated ``groupBy``: a node that all
conversations share is one row per shard.

Sums over subtrees take no walk up the tree.  The nodes whose smallest member
is c are the lower end of c's path (its own stretch).  A subtree is made of the own
stretches of its members, cut at the node for its smallest member, so the
leaves and texts of a subtree are sums over members of what belongs to each
conversation; a second walk over the shards adds these up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascore.llm.shared import CRC_TABLE_SQL
from terrascore.session import materialize

#: conversations and turns after which a shard is closed
SHARD_CONVS, SHARD_TURNS = 2048, 1 << 16
DIGEST = 16
ROOT = bytes(DIGEST)


def turn_paths(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, digests (16 bytes a turn),
    chars (code points of each text): a row per conversation.

    Turns go by ``turn``, NULL first, equal ones by their digest; NULL role or
    text is empty; rows without conv_id are left out.  Only digests are
    shuffled.  A conversation's digests must fit a task."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST))
    turns = (rows.where("conv_id IS NOT NULL")
             .select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"),
                     F.length(text).alias("chars"))
             .repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "digest"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digests, chars = None, [], []

        def batch(ids: list, blobs: list, sizes: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary()), pa.array(sizes, pa.list_(pa.int32()))],
                                              names=["conv_id", "digests", "chars"])

        for part in batches:
            done: tuple[list, list, list] = ([], [], [])
            for c, d, n in zip(*(part.column(i).to_pylist() for i in (0, 2, 3))):
                if c != conv:
                    if digests:
                        for a, b in zip(done, (conv, b"".join(digests), chars)):
                            a.append(b)
                    conv, digests, chars = c, [], []
                digests.append(d)
                chars.append(n)
            if done[0]:
                yield batch(*done)
        if digests:
            yield batch([conv], [b"".join(digests)], [chars])

    return turns.mapInArrow(pack, "conv_id long, digests binary, chars array<int>")


def with_shared_heads(paths: DataFrame, base: Column, head: Column, longest: int) -> DataFrame:
    """Each path with its first ``head`` turns replaced by those of
    conversation ``base`` (all if it has fewer, none if there is no such)."""
    own = paths.withColumn("_base", base).withColumn("_h", head)
    # at most ``longest`` turns of each conversation that is a base
    heads = (paths.join(own.select(F.col("_base").alias("conv_id")).distinct(), "conv_id", "left_semi")
             .select(F.col("conv_id").alias("_base"), F.expr(f"substring(digests, 1, {DIGEST * longest})").alias("_hd"),
                     F.slice("chars", 1, longest).alias("_hc")))
    taken = F.coalesce(F.substring(F.col("_hd"), F.lit(1), F.col("_h") * DIGEST), F.unhex(F.lit("")))
    rest = F.substring(F.col("digests"), F.col("_h") * DIGEST + 1, F.length("digests"))
    none = F.array().cast("array<int>")
    return own.join(heads, "_base", "left").select(
        "conv_id", F.concat(taken, rest).alias("digests"),
        F.concat(F.coalesce(F.slice("_hc", F.lit(1), F.col("_h")), none), F.slice("chars", F.col("_h") + 1, F.size("chars") + 1)).alias("chars"))


class Shard:
    """Vertical bitmaps of some conversations, in ascending conv_id."""

    def __init__(self, digests: list[bytes], chars: list):
        self.digests, self.chars = digests, chars
        self.postings: dict[tuple[int, bytes], int] = {}
        self.ending: dict[int, int] = {}
        for i, path in enumerate(digests):
            bit, n = 1 << i, len(path) // DIGEST
            for k in range(n):
                key = (k, path[k * DIGEST:(k + 1) * DIGEST])
                self.postings[key] = self.postings.get(key, 0) | bit
            self.ending[n] = self.ending.get(n, 0) | bit

    def nodes(self) -> Iterator[tuple[bytes, bytes | None, int, int, int, int, int]]:
        """Depth first: name, parent, depth, code points of its last text and
        of all before it, bitset of members, bitset of members that end."""
        stack = [(ROOT, None, 0, 0, 0, (1 << len(self.digests)) - 1)] if self.digests else []
        while stack:
            name, parent, depth, chars, before, members = stack.pop()
            ends = members & self.ending.get(depth, 0)
            yield name, parent, depth, chars, before, members, ends
            rest = members & ~ends
            while rest:
                first = (rest & -rest).bit_length() - 1
                turn = self.digests[first][depth * DIGEST:(depth + 1) * DIGEST]
                child = members & self.postings[depth, turn]
                stack.append((hashlib.blake2b(name + turn, digest_size=DIGEST).digest(), name, depth + 1, int(self.chars[first][depth]), before + chars, child))
                rest &= ~child


def places(bits: int) -> np.ndarray:
    """Numbers of the set bits, ascending."""
    if bits & (bits - 1) == 0:
        return np.array([bits.bit_length() - 1] if bits else [], np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes(-(-bits.bit_length() // 8), "little"), np.uint8), bitorder="little"))


def _shards(batches: Iterator[pa.RecordBatch], convs: int, turns: int) -> Iterator[list[list]]:
    """Columns of consecutive rows (conv_id, digests, chars, ...), a shard's
    worth at a time."""
    rows: list[tuple] = []
    size = 0
    for batch in batches:
        columns = [batch.column(i).to_pylist() if i != 2 else [x.values.to_numpy() for x in batch.column(2)] for i in range(batch.num_columns)]
        for row in zip(*columns):
            rows.append(row)
            size += len(row[2])
            if len(rows) >= convs or size >= turns:
                yield [list(c) for c in zip(*rows)]
                rows, size = [], 0
    if rows:
        yield [list(c) for c in zip(*rows)]


def _dealt(paths: DataFrame) -> DataFrame:
    return paths.repartitionByRange("conv_id").sortWithinPartitions("conv_id")


def _shard_nodes(paths: DataFrame, convs: int, turns: int) -> DataFrame:
    """A row per node of each shard; ``total`` adds the code points of its
    members' whole paths, ``ended`` lists the members that end there."""
    schema = "node binary, parent binary, depth long, chars long, before long, n long, total long, n_ends long, conv long, ended array<long>"
    kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.list_(pa.int64())]
    names = [c.strip().split()[0] for c in schema.split(",")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, digests, chars in _shards(batches, convs, turns):
            ids, whole = np.array(ids, np.int64), np.array([int(c.sum()) for c in chars], np.int64)
            out = []
            for name, parent, depth, last, before, members, ends in Shard(digests, chars).nodes():
                at = places(members)
                out.append((name, parent, depth, last, before, len(at), int(whole[at].sum()), ends.bit_count(), int(ids[at[0]]), ids[places(ends)] if ends else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return _dealt(paths).mapInArrow(walk, schema)


def _shard_sums(weighted: DataFrame, convs: int, turns: int) -> DataFrame:
    """(conv_id, digests, chars, own, top, leaf) -> for each node of each
    shard the sums of ``own`` and ``leaf`` over its members, and ``top`` of the
    smallest."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, digests, chars, own, top, leaf in _shards(batches, convs, turns):
            own, leaf = np.array(own, np.int64), np.array(leaf, np.int64)
            out = []
            for name, *_, members, _ends in Shard(digests, chars).nodes():
                at = places(members)
                out.append((name, int(own[at].sum()), int(leaf[at].sum()), ids[at[0]], top[at[0]]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [pa.binary(), *[pa.int64()] * 4])],
                                             names=["node", "own", "leaves", "conv", "top"])

    return _dealt(weighted).mapInArrow(walk, "node binary, own long, leaves long, conv long, top long")


def _end_hashes(parts: DataFrame) -> DataFrame:
    """node, SHA-256 of its ending members' decimal ids, ascending and joined
    by commas.  A node's lists (one per shard) come in order of their smallest
    id to a task that hashes them as a stream, as the chained hash demands."""
    lists = (parts.where("n_ends > 0").select("node", F.col("ended")[0].alias("first"), "ended")
             .repartition("node").sortWithinPartitions("node", "first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for n, ids in zip(batch.column(0).to_pylist(), (x.values for x in batch.column(2))):
                more = ",".join(map(str, ids.to_pylist()))
                if n == node:
                    state.update(f",{more}".encode())
                    continue
                if state:
                    out.append((node, state.hexdigest()))
                node, state = n, hashlib.sha256(more.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["node", "ends"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], names=["node", "ends"])

    return lists.mapInArrow(run, "node binary, ends string")


def trie(paths: DataFrame, shard_convs: int = SHARD_CONVS, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """(conv_id, digests, chars), conv_id unique -> a row per node: conv_id
    (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.  The root has depth 0 and every conversation,
    also one without turns; no conversations give no nodes."""
    paths = materialize(paths, "trie-paths")
    parts = materialize(_shard_nodes(paths, shard_convs, shard_turns), "trie-parts")
    nodes = materialize(parts.groupBy("node").agg(
        F.first("parent").alias("parent"), *[F.first(c).alias(c) for c in ("depth", "chars", "before")],
        *[F.sum(c).alias(c) for c in ("n", "total", "n_ends")], F.min("conv").alias("conv")), "trie-nodes")
    # the nodes that a conversation is the smallest member of: the lower end of its path
    own = nodes.groupBy(F.col("conv").alias("conv_id")).agg(
        F.sum("chars").alias("own"), F.min("before").alias("top"), F.max((F.col("n") == F.col("n_ends")).cast("long")).alias("leaf"))
    sums = _shard_sums(paths.join(own, "conv_id").select("conv_id", "digests", "chars", "own", "top", "leaf"), shard_convs, shard_turns)

    # all that belongs to a node meets in one aggregation
    shape = {"parent": "binary", "depth": "long", "chars": "long", "before": "long", "n": "long", "total": "long", "conv": "long",
             "own": "long", "leaves": "long", "first": "struct<conv:long,top:long>", "kids": "long", "ends": "string"}

    def like(df: DataFrame) -> DataFrame:
        return df.select("node", *[F.col(c) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in shape.items()])

    kids = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("kids"))
    each = like(nodes.drop("n_ends"))
    for more in (sums.withColumn("first", F.struct("conv", "top")).drop("conv", "top"), kids, _end_hashes(parts)):
        each = each.unionByName(like(more))
    added = {"own", "leaves", "kids", "n", "total"}
    full = materialize(each.groupBy("node").agg(*[(F.sum if c in added else F.min if c == "first" else F.max)(c).alias(c) for c in shape]), "trie-full")
    # texts of the subtree: its members' own stretches, less what the smallest member's has above the node
    texts = F.col("own") - (F.col("before") - F.col("first.top"))
    saved = F.col("total") - F.col("n") * F.col("before") - texts
    above = full.select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv_id"))
    return full.join(above, "parent", "left").select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.coalesce("kids", F.lit(0)).alias("n_children"),
        F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"), F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def op12_trie(spark, sf_dir: str) -> DataFrame:
    paths = materialize(turn_paths(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "trie-own-paths")
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    return trie(with_shared_heads(paths, F.col("conv_id") - F.col("conv_id") % 100, head, 5))


OP12_SQL = f"""
WITH {CRC_TABLE_SQL},
own AS (SELECT conv_id, digest, chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos
        FROM (SELECT conv_id, turn, length(coalesce(text, '')) AS chars,
                     substr(sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS digest
              FROM conversations WHERE conv_id IS NOT NULL)),
conv AS (SELECT conv_id AS c, conv_id - conv_id % 100 AS base,
                xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
                                lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h
         FROM (SELECT DISTINCT conv_id FROM own), tbl),
head AS (SELECT c, pos, digest, chars FROM conv JOIN own ON own.conv_id = base WHERE pos <= h),
had AS (SELECT c, h, (SELECT count(*) FROM head WHERE head.c = conv.c) AS k FROM conv),
turn AS (SELECT c, pos AS d, digest, chars FROM head
         UNION ALL SELECT c, k + pos - h, digest, chars FROM had JOIN own ON own.conv_id = c WHERE pos > h),
-- each conversation on each node of its path
i AS (SELECT c, d, chars, md5(string_agg(digest, '/') OVER (PARTITION BY c ORDER BY d)) AS node FROM turn
      UNION ALL SELECT c, 0, 0, 'root' FROM conv),
j AS (SELECT *, lag(node) OVER (PARTITION BY c ORDER BY d) AS parent, max(d) OVER (PARTITION BY c) = d AS ends FROM i),
n AS (SELECT node, any_value(parent) AS parent, any_value(d) AS depth, any_value(chars) AS chars, min(c) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256 FROM j GROUP BY node),
kids AS (SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
below AS (SELECT DISTINCT a.node AS top, b.node FROM i a JOIN i b ON a.c = b.c AND a.d <= b.d),
sums AS (SELECT top, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves, sum((n_convs - 1) * chars)::BIGINT AS saved_tokens
         FROM below JOIN n USING (node) LEFT JOIN kids USING (node) GROUP BY top)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM n LEFT JOIN n p ON p.node = n.parent LEFT JOIN kids ON kids.node = n.node JOIN sums ON sums.top = n.node
"""
