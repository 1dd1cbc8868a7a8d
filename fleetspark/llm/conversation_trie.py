"""The prefix trie of conversations: what serving or training could share, by ternary search trees per range shard.

Turns (role, text) are dictionary-encoded: one long id for each distinct turn. A conversation is its sequence of ids.
Equal sequences are counted first, so a conversation that a third of all rows repeat is one row. The distinct sequences
are sorted and dealt to range shards; a shard inserts its sequences into a ternary search tree, the median first, so the
tree is balanced, and one iterative pass from the last node to the first accumulates members, leaves and savings.

A node's sequences are neighbours in the order, so a node that is no prefix of its shard's first or last sequence is
whole in its shard. The others (at most two paths a shard) are boundary nodes: their parts are summed by node, and what
boundary nodes add to their ancestors runs along the path of the one shard that owns them, so neither their number nor
the work on them grows with more than shards times depth.

Defined results. Rows without a conversation id belong to no conversation. Turns go by turn (null first), then role,
then the text's first 64 signs and its hash, so ties have one order; null role or text is empty. A conversation without turns is a member of the root.
An empty table has no node, not even a root. Texts of any length count with all their bytes. Turns are told apart by
128-bit keys (two 64-bit hashes), as are boundary nodes. A conversation's ids are one array of 8 bytes a turn; all other
groups are bounded. Only the four named columns are read, so no other column can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.llm.common import cut

#: Ids of conversations whose decimal numbers are joined in one row on the way to a digest.
BLOCK = 1 << 16
NOBODY = hashlib.sha256(b"").hexdigest()
ROOT = bytes(16)


def encoded(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, id, size): each turn's place in its conversation, dictionary id and bytes of text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    keyed = whole.select("conv_id", "turn", "role", F.xxhash64("role", "text").alias("k1"), F.xxhash64("text", F.lit(1), "role").alias("k2"), F.octet_length("text").cast("long").alias("size"), F.substring("text", 1, 64).alias("head"))
    # equal turns of one conversation need an order only where role or text differ
    order = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "head", "k1", "k2")) - 1
    placed = cut(keyed.withColumn("pos", order).select("conv_id", "pos", "k1", "k2", "size"))
    words = cut(placed.groupBy("k1", "k2").agg(F.max("size").alias("size")).withColumn("id", F.monotonically_increasing_id()))
    return placed.drop("size").join(words, ["k1", "k2"]).select("conv_id", "pos", "id", "size")


def sequences(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv_id, ids, sizes) of every conversation of ``conversations`` (conv_id); ``turns`` has (conv_id, place, id,
    size), in the order of ``place``."""
    rows = turns.select("conv_id", F.struct("place", "id", "size").alias("t")).unionByName(conversations.select("conv_id"), allowMissingColumns=True)
    held = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return held.select("conv_id", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes"))


def digests(members: DataFrame) -> DataFrame:
    """(name, sha256) of each name's conversation ids (name, conv_id): decimal, ascending, joined by commas. Ids are
    joined in blocks of ``BLOCK`` numbers; a name's blocks stream through one digest in order."""
    blocks = members.withColumn("block", F.floor(F.col("conv_id") / BLOCK)).groupBy("name", "block").agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sha, out = None, None, ([], [])
        for batch in batches:
            for name, part in zip(batch.column("name").to_pylist(), batch.column("part").to_pylist(), strict=True):
                if sha is None or name != current:
                    if sha is not None:
                        out[0].append(current)
                        out[1].append(sha.hexdigest())
                    current, sha = name, hashlib.sha256(part.encode())
                else:
                    sha.update(b"," + part.encode())
            yield pa.record_batch({"name": pa.array(out[0], pa.int64()), "sha256": pa.array(out[1], pa.string())})
            out = ([], [])
        if sha is not None:
            yield pa.record_batch({"name": pa.array([current], pa.int64()), "sha256": pa.array([sha.hexdigest()], pa.string())})

    return blocks.repartition("name").sortWithinPartitions("name", "block").mapInArrow(run, "name long, sha256 string")


class Tree:
    """A ternary search tree of id sequences; node 0 is the root, a node's parent has a smaller number."""

    def __init__(self) -> None:
        self.id, self.low, self.same, self.high = [None], [0], [0], [0]  # 0: none, as the root is nobody's child
        self.parent, self.depth, self.size = [0], [0], [0]
        self.n, self.first, self.end = [0], [None], [None]

    def _new(self, id_: int, parent: int, size: int) -> int:
        for column, value in ((self.id, id_), (self.low, 0), (self.same, 0), (self.high, 0), (self.parent, parent), (self.depth, self.depth[parent] + 1), (self.size, size), (self.n, 0), (self.first, None), (self.end, None)):
            column.append(value)
        return len(self.id) - 1

    def insert(self, ids: list[int], sizes: list[int], n: int, name: int) -> list[int]:
        """The nodes of the path, the root first; ``n`` conversations of which ``name`` is the smallest end there."""
        path, node = [0], 0
        for id_, size in zip(ids, sizes, strict=True):
            at = self.same[node]
            if not at:
                at = self.same[node] = self._new(id_, node, size)
            while self.id[at] != id_:
                side = self.low if id_ < self.id[at] else self.high
                if not side[at]:
                    side[at] = self._new(id_, node, size)
                at = side[at]
            node = at
            path.append(node)
        for node in path:
            self.n[node] += n
            self.first[node] = name if self.first[node] is None else min(self.first[node], name)
        self.end[path[-1]] = name
        return path


def medians(n: int) -> Iterator[int]:
    """The numbers below n, the middle of each range before those at its sides."""
    ranges = [(0, n)]
    while ranges:
        a, b = ranges.pop()
        if a < b:
            middle = (a + b) // 2
            yield middle
            ranges += [(middle + 1, b), (a, middle)]


NODE = "key binary, parent_key binary, shard int, side int, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, size long, name long"


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of a shard of sorted distinct sequences; boundary nodes have a key and carry parts only."""
    from pyspark import TaskContext

    table = [b for b in batches if b.num_rows]
    if not table:
        return
    ids, sizes, n, names = (sum((b.column(c).to_pylist() for b in table), []) for c in ("ids", "sizes", "n", "name"))
    tree, paths = Tree(), {}
    for i in medians(len(ids)):
        path = tree.insert(ids[i], sizes[i], n[i], names[i])
        if i in (0, len(ids) - 1):
            paths[i] = path
    sides = [paths[0], paths[len(ids) - 1]]
    keys = {0: ROOT}
    for path in sides:
        for node in path[1:]:
            if node not in keys:
                keys[node] = hashlib.blake2b(keys[tree.parent[node]] + tree.id[node].to_bytes(8, "little", signed=True), digest_size=16).digest()
    count = len(tree.id)
    children, leaves, saved = [0] * count, [0] * count, [0] * count
    for node in range(count - 1, 0, -1):
        up, inner = tree.parent[node], node not in keys
        if inner:
            saved[node] += (tree.n[node] - 1) * tree.size[node]
            leaves[node] += not children[node]
            children[up] += 1
        leaves[up] += leaves[node]
        saved[up] += saved[node]
    shard, rows = TaskContext.get().partitionId(), []
    for node in range(count):
        if node not in keys:
            up = tree.parent[node]
            known = up not in keys
            rows.append((None, None if known else keys[up], None, None, tree.depth[node], tree.first[node], tree.first[up] if known else None, tree.n[node], children[node], leaves[node], saved[node], tree.size[node], tree.end[node]))
    shown = set()
    for side, path in enumerate(sides):
        for node in path:
            part = node not in shown
            shown.add(node)
            own = (tree.first[node], None, tree.n[node], children[node], leaves[node], saved[node], tree.size[node], tree.end[node]) if part else (None, None, 0, 0, 0, 0, tree.size[node], None)
            rows.append((keys[node], keys[tree.parent[node]] if node else None, shard, side, tree.depth[node], *own))
    kinds = {"binary": pa.binary(), "int": pa.int32(), "long": pa.int64()}
    columns = [c.split() for c in NODE.split(", ")]
    for a in range(0, len(rows), 10_000):
        part = list(zip(*rows[a : a + 10_000], strict=True))
        yield pa.record_batch({name: pa.array(values, kinds[kind]) for (name, kind), values in zip(columns, part, strict=True)})


def _merged(boundary: DataFrame) -> DataFrame:
    """The boundary nodes of all shards, each with its whole counts."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    nodes = boundary.groupBy("key", "parent_key", "depth").agg(F.min("conv_id").alias("conv_id"), *sums, F.max("size").alias("size"), F.max("name").alias("name"), F.min(F.struct("shard", "side")).alias("owner"))
    below = nodes.filter("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("below"))
    nodes = cut(nodes.join(below, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("below", F.lit(0))).drop("below"))
    own = nodes.select("key", F.col("owner.shard").alias("shard"), F.col("owner.side").alias("side"), (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("size")).alias("gain"))
    # along the path of the shard that owns a node, its share reaches all its ancestors
    deeper = Window.partitionBy("shard", "side").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    paths = boundary.select("key", "shard", "side", "depth").join(own, ["key", "shard", "side"], "left")
    shares = paths.select("key", F.sum(F.coalesce("leaf", F.lit(0))).over(deeper).alias("leaf"), F.sum(F.coalesce("gain", F.lit(0))).over(deeper).alias("gain"))
    shares = shares.groupBy("key").agg(F.sum("leaf").alias("leaf"), F.sum("gain").alias("gain"))
    whole = nodes.join(shares, "key").withColumn("n_leaves", F.col("n_leaves") + F.col("leaf")).withColumn("saved_tokens", F.col("saved_tokens") + F.col("gain"))
    up = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return whole.join(up, "parent_key", "left").select("key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "name")


def trie(held: DataFrame, ids_per_shard: int = 1_000_000) -> DataFrame:
    """The nodes of the trie of ``held`` (conv_id, ids, sizes): conv_id (the smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256; see the module's text. A shard's tree has about
    ``ids_per_shard`` ids at most, so shards grow with the input and their trees do not."""
    held = cut(held)
    distinct = cut(held.groupBy("ids", "sizes").agg(F.count("*").alias("n"), F.min("conv_id").alias("name")))
    total = distinct.agg(F.sum(F.size("ids") + 1)).first()[0] or 0
    default = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, default, -(-total // ids_per_shard))
    rows = cut(distinct.repartitionByRange(shards, "ids").sortWithinPartitions("ids").mapInArrow(_shard, NODE))
    whole = cut(_merged(rows.filter("key is not null")))
    inner = rows.filter("key is null")
    parents = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_up"))
    inner = inner.join(parents, "parent_key", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_up"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "name"]
    nodes = inner.select(columns).unionByName(whole.select(columns))
    named = held.join(distinct.select("ids", "name"), "ids").select("name", "conv_id")
    out = nodes.join(digests(named), "name", "left").withColumn("ends_sha256", F.coalesce("sha256", F.lit(NOBODY)))
    return out.select(*columns[:-1], "ends_sha256")


def prefix_trie(conversations: DataFrame, ids_per_shard: int = 1_000_000) -> DataFrame:
    """The trie of a table (conv_id, turn, role, text) as it is."""
    turns = encoded(conversations)
    all_of = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    return trie(sequences(turns.withColumn("place", F.struct(F.lit(0), "pos")), all_of), ids_per_shard)


def kept_turns(conv_id: str) -> Column:
    """How many turns the rebuilt conversation takes from its base: the crc32 of its decimal id, modulo 9."""
    return F.expr(f"crc32(CAST({conv_id} AS string)) % 9")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, ids, sizes): the first h turns of conversation c - c % 5, then c's own turns after its first h."""
    turns = cut(encoded(conversations))
    all_of = cut(conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")).distinct())
    own = turns.filter(F.col("pos") >= kept_turns("conv_id")).select("conv_id", F.struct(F.lit(1).alias("part"), "pos").alias("place"), "id", "size")
    # at most eight turns of a base go to the five conversations that begin with it; % has the sign of the id
    begin = turns.filter("pos < 8 AND conv_id % 5 = 0")
    nexts = F.explode(F.expr("filter(transform(sequence(-4, 4), k -> conv_id + k), c -> c - c % 5 = conv_id)"))
    lent = begin.select(nexts.alias("to"), "pos", "id", "size").filter(F.col("pos") < kept_turns("to"))
    lent = lent.select(F.col("to").alias("conv_id"), F.struct(F.lit(0).alias("part"), "pos").alias("place"), "id", "size").join(all_of, "conv_id", "left_semi")
    return sequences(own.unionByName(lent), all_of)


def op13_conversation_trie(spark, sf_dir: str) -> DataFrame:
    """Whole ``conversations``, rebuilt over shared beginnings: every node of their prefix trie."""
    return trie(rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")))


#: One step of a crc32 over a byte {b}, as DuckDB has no function for it.
_CRC_BYTE = "list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor({c}, {b}))"
CRC_OF = "xor(list_reduce({bytes}, lambda s, b: " + _CRC_BYTE.format(c="s", b="b") + ", 4294967295::BIGINT), 4294967295)"
_DIGITS = "list_transform(string_split(CAST(conv_id AS varchar), ''), lambda x: ascii(x)::BIGINT)"
OP13_SQL = f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
d AS (SELECT role, text, row_number() OVER () AS id FROM (SELECT DISTINCT role, text FROM t)),
e AS (SELECT t.conv_id, t.pos, d.id, strlen(t.text) AS size FROM t JOIN d ON t.role = d.role AND t.text = d.text),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {CRC_OF.format(bytes=_DIGITS)} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS part, e.pos, e.id, e.size FROM c JOIN e ON e.conv_id = c.base AND e.pos < c.h UNION ALL SELECT c.conv_id, 1, e.pos, e.id, e.size FROM c JOIN e ON e.conv_id = c.conv_id AND e.pos >= c.h),
s AS (SELECT c.conv_id, coalesce(list(r.id ORDER BY part, pos) FILTER (r.id IS NOT NULL), []) AS ids, coalesce(list(r.size ORDER BY part, pos) FILTER (r.id IS NOT NULL), []) AS sizes FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
p AS (SELECT conv_id, k AS depth, list_slice(ids, 1, k) AS pre, CASE WHEN k = 0 THEN 0 ELSE sizes[k] END AS size, k = len(ids) AS ends FROM (SELECT *, unnest(range(0, len(ids) + 1)) AS k FROM s)),
n AS (SELECT pre, any_value(depth) AS depth, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS varchar), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY pre),
k AS (SELECT list_slice(pre, 1, depth - 1) AS pre, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.pre = n.pre),
u AS (SELECT list_slice(pre, 1, j) AS pre, CASE WHEN n_children = 0 THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * size AS gain FROM (SELECT *, unnest(range(0, depth + 1)) AS j FROM m)),
v AS (SELECT pre, sum(leaf)::BIGINT AS n_leaves, sum(gain)::BIGINT AS saved_tokens FROM u GROUP BY pre)
SELECT m.conv_id, m.depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, v.n_leaves, v.saved_tokens, m.ends_sha256
FROM m JOIN v ON v.pre = m.pre LEFT JOIN n q ON m.depth > 0 AND q.pre = list_slice(m.pre, 1, m.depth - 1)"""
