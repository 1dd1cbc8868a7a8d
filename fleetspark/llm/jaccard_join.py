"""Exact similarity join of documents on their word n-grams: size-banded tiles, bitmap signatures, sorted arrays.

A document is the set of its distinct k-word shingles (words as in ``words``, A-Z lower-cased); documents with the same
set are one node. Shingles that only one node has can't be shared; ordered from rare to common, two linked sets have a
shingle in common among the first n - ceil(0.8 n) + 1 of each. So most nodes are out at once (too many shingles of their
own), and the others meet in the lists of their first shared shingles. Nothing can be missed.

A list is first held against one hub of it (the member with most company), a few times; members that end in one
component need no further look. What is left of a list is laid out in tiles: by size band (linked sizes differ by a
factor of 1.25 at most, so a band meets itself and the next one), and where many nodes remain, by blocks of them, so that
a tile is bounded. In a tile the nodes' bitmaps of 512 bits are compared: two sets differ in at least as many shingles
as their bitmaps in bits, which bounds the overlap from above. Pairs of different components that pass the bound are
verified by intersecting the sorted arrays, as are those with the hubs.

Defined results. Null or empty texts, and those without a word, have an empty set: no links, own component.
Fewer than k words: the whole sequence is the one shingle. Rows that repeat an id are linked with each other if both
have a set, so each text of the id keeps its links; ties need no order, as a component's name is its smallest id. A null
id is kept with null component and links nothing. An empty table gives an empty table. Texts of any length are read
whole. Only the id and text columns are read, so no other column can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.llm.common import chunks, cut, release, tidy
from fleetspark.llm.graph import components, few
from fleetspark.llm.minhash import SLOT_SEED, shingles
from fleetspark.llm.substring_dedup import _by_bucket, _from_planes, _pack_keys, _packed, _planes, _unpacked
from fleetspark.llm.tiles import WIDTH, bitmaps, bounded, tiles
from fleetspark.llm.words import mix, words_of
from fleetspark.sources.storage import shuffled, written

KEYED = "bucket long, chunk long, keys binary"


def _digests(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Of each row, the size of its set and two sums that stand for it."""
    for table in chunks(batches, "text", 1 << 20, 2_000):
        doc, hashed = shingles(words_of(table.column("text"), lower=True), k)
        n = table.num_rows
        one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        np.add.at(one, doc, mix(hashed + np.uint64(1)))
        np.add.at(two, doc, mix(hashed ^ SLOT_SEED))
        ids = [table.column(c).combine_chunks() for c in ("doc_id", "text_hash")]
        yield pa.record_batch([*ids, pa.array(np.bincount(doc, minlength=n), pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], names=["doc_id", "text_hash", "n_shingles", "set_a", "set_b"])
    tidy()


def _texts(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    for table in chunks(batches, "text", chunk_bytes):
        yield pa.record_batch({"rows": pa.array([_packed(table)], pa.binary())})
    tidy()


def _entries(batches: Iterator[pa.RecordBatch], k: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Of each chunk and bucket: the distinct keys (32 bits within the bucket) and in how many nodes of it they are."""
    for batch in batches:
        for chunk, payload in zip(batch.column("chunk").to_pylist(), batch.column("rows"), strict=True):
            _, hashed = shingles(words_of(_unpacked(payload.as_py()).column("text"), lower=True), k)
            keys, count = np.unique(hashed >> np.uint64(32 - bits), return_counts=True)
            low, count = keys.astype(np.uint32), np.minimum(count, 255).astype(np.uint8)
            yield _by_bucket(chunk, (keys >> np.uint64(32)).astype(np.int64), lambda a, b, low=low, count=count: _pack_keys(low[a:b]) + count[a:b].tobytes())
    tidy()


def _counted(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Keys and the byte that stands with each."""
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    return np.cumsum(_from_planes(blob, "<u4", n, 4), dtype=np.uint32), np.frombuffer(blob, np.uint8, n, 4 + 4 * n)


def _shared(table: pa.Table) -> pa.Table:
    """Of one bucket, for each chunk: its keys that two nodes or more have, and a grade of how many have them."""
    parts = [_counted(x.as_py()) for x in table.column("keys")]
    keys = np.concatenate([p[0] for p in parts])
    found, place = np.unique(keys, return_inverse=True)
    total = np.bincount(place, np.concatenate([p[1] for p in parts]), minlength=len(found))
    grade = np.minimum(255, np.floor(8 * np.log2(np.maximum(total, 1)))).astype(np.uint8)[place]
    out, at = ([], []), 0
    for (own, _), chunk in zip(parts, table.column("chunk").to_pylist(), strict=True):
        mine = grade[at : at + len(own)]
        at += len(own)
        if mine.any():
            out[0].append(chunk)
            out[1].append(_pack_keys(own[mine > 0]) + mine[mine > 0].tobytes())
    return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()] * len(out[0]), pa.int64()), "chunk": pa.array(out[0], pa.int64()), "keys": pa.array(out[1], pa.binary())})


def _least(n: np.ndarray, percent: int) -> np.ndarray:
    """The smallest overlap that a set of n shingles can be linked with."""
    return -(-n * percent // 100)


SURVIVOR = "node long, n int, held int, bits binary, first array<long>, shingles array<long>"


def _survivors(texts: pa.Table, answers: pa.Table, k: int, bits: int, percent: int) -> pa.Table:
    """The nodes of a chunk with enough shared shingles for a link: those shingles, sorted, and the rarest of them."""
    out = []
    for payload in texts.column("rows"):
        table = _unpacked(payload.as_py())
        doc, hashed = shingles(words_of(table.column("text"), lower=True), k)
        n = np.bincount(doc, minlength=table.num_rows)
        parts = [_counted(x.as_py()) for x in answers.column("keys")]
        if not parts:
            continue
        keys = np.concatenate([(np.uint64(b) << np.uint64(32)) | p[0].astype(np.uint64) for b, p in zip(answers.column("bucket").to_pylist(), parts, strict=True)])
        grades = np.concatenate([p[1] for p in parts])
        order = np.argsort(keys)
        keys, grades = keys[order], grades[order]
        own = hashed >> np.uint64(32 - bits)
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        both = keys[at] == own
        doc, hashed, grade = doc[both], hashed[both], grades[at[both]]
        held = np.bincount(doc, minlength=table.num_rows)
        many = (n > 0) & (held >= _least(n, percent))
        stay = many[doc]
        doc, hashed, grade = doc[stay], hashed[stay], grade[stay]
        if not len(doc):
            continue
        rows = np.flatnonzero(many)
        ends = np.searchsorted(doc, np.append(rows, table.num_rows))
        packed = bitmaps(doc, hashed, table.num_rows).take(pa.array(rows))
        rare = np.lexsort((hashed, grade, doc))
        size = held[rows] - _least(n, percent)[rows] + 1
        place = np.arange(len(doc)) - np.repeat(ends[:-1], held[rows])
        first = hashed[rare][place < np.repeat(size, held[rows])]
        lists = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(v.view(np.int64))) for o, v in ((np.concatenate(([0], np.cumsum(size))), first), (ends, hashed))]
        out.append(pa.table([table.column("node").take(pa.array(rows)), pa.array(n[rows], pa.int32()), pa.array(held[rows], pa.int32()), packed, *lists], names=["node", "n", "held", "bits", "first", "shingles"]))
    kinds = pa.schema([("node", pa.int64()), ("n", pa.int32()), ("held", pa.int32()), ("bits", pa.binary()), ("first", pa.list_(pa.int64())), ("shingles", pa.list_(pa.int64()))])
    return pa.concat_tables([t.cast(kinds) for t in out]) if out else kinds.empty_table()


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs whose sorted arrays have enough in common."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sides = []
        for side in ("sa", "sb"):
            lists = batch.column(side)
            size = np.diff(lists.offsets.to_numpy())
            sides.append((np.repeat(np.arange(len(size)), size), lists.flatten().to_numpy()))
        pair, value = (np.concatenate(x) for x in zip(*sides, strict=True))
        order = np.lexsort((value, pair))
        pair, value = pair[order], value[order]
        same = (pair[1:] == pair[:-1]) & (value[1:] == value[:-1])
        common = np.bincount(pair[1:][same], minlength=batch.num_rows)
        total = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
        good = pa.array(100 * common >= percent * (total - common))
        yield pa.record_batch([batch.column("a").filter(good), batch.column("b").filter(good)], names=["a", "b"])
    tidy()


def _linked(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The links among ``pairs`` (a, b): by bitmaps first, then by the arrays of those that pass."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bits = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, WIDTH) for c in ("ba", "bb")]
                n, held = (tuple(batch.column(c).to_numpy().astype(np.int64) for c in names) for names in (("na", "nb"), ("ha", "hb")))
                good = pa.array(bounded(*bits, n, held, percent))
                yield pa.record_batch([batch.column(c).filter(good) for c in ("a", "b", "na", "nb")], names=["a", "b", "na", "nb"])

    slim = nodes.select("node", "n", "held", "bits")
    of = lambda df, side, names: df.select(F.col("node").alias(side), *(F.col(c).alias(n) for c, n in names.items()))
    sent = F.broadcast if few(pairs) else shuffled
    met = of(slim, "a", {"n": "na", "held": "ha", "bits": "ba"}).join(sent(pairs), "a")
    met = of(slim, "b", {"n": "nb", "held": "hb", "bits": "bb"}).join(sent(met), "b")
    close = met.mapInArrow(bound, "a long, b long, na int, nb int")
    full = close.join(of(nodes, "a", {"shingles": "sa"}), "a").join(of(nodes, "b", {"shingles": "sb"}), "b")
    return full.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(lambda it: _verify(it, percent), "a long, b long")


def _undecided(members: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The components that the links make, and the members (token, node, company, component, main) of lists that hold
    several of them; main is the component with most members there. These are written, so that the next round starts from
    their real size and not from the product of all estimates before it."""
    labels = components(links)
    labelled = members.join(F.broadcast(labels) if few(labels) else shuffled(labels), "node", "left").select("token", "node", "company", F.coalesce("component", "node").alias("component"))
    counts = labelled.groupBy("token", "component").agg(F.count("*").alias("n"))
    mains = counts.groupBy("token").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts")).filter("parts > 1")
    return labels, written(labelled.join(shuffled(mains.drop("parts")), "token").select("token", "node", "company", "component", "main"))[0]


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, hub_rounds: int = 3, bucket_bytes: int = 8 << 20, chunk_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; see the module's text.

    ``percent``: the least similarity of a link, intersection over union in hundredths. ``hub_rounds``: rounds of hubs
    before the tiles; any number gives the same result. ``bucket_bytes`` of text go to a bucket of shingle counts,
    ``chunk_bytes`` are worked on at a time.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(30, max(4, int(np.ceil(np.log2(max(1, total / bucket_bytes))))))
    rows = cut(slim.mapInArrow(lambda it: _digests(it, k), "doc_id long, text_hash long, n_shingles long, set_a long, set_b long").withColumn("row", F.monotonically_increasing_id()))
    full = rows.filter("n_shingles > 0 and doc_id is not null")
    # a node is a set; it goes by the row that holds it with the smallest id
    named = cut(full.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "row", "text_hash")).alias("least")).select("set_a", "set_b", F.col("least.row").alias("node"), "least.doc_id", "least.text_hash"))
    # rows with the same id and hash hold the same text
    wanted = named.groupBy("doc_id", "text_hash").agg(F.min("node").alias("node"))
    texts = slim.join(wanted, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"]).select("node", "text")
    texts = cut(texts.mapInArrow(lambda it: _texts(it, chunk_bytes), "rows binary").withColumn("chunk", F.monotonically_increasing_id()))
    release(spark)
    answers = cut(texts.mapInArrow(lambda it: _entries(it, k, bits), KEYED).groupBy("bucket").applyInArrow(_shared, KEYED))
    release(spark)
    found = texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda t, h: _survivors(t, h, k, bits, percent), SURVIVOR)
    nodes = cut(found)
    release(spark)

    lists = nodes.select("node", F.explode("first").alias("token"))
    sizes = lists.groupBy("token").agg(F.count("*").alias("size")).filter("size > 1")
    members = cut(lists.join(sizes, "token").select("token", "node", "size"))
    company = members.groupBy("node").agg(F.sum("size").alias("company"))
    members = cut(members.join(company, "node").select("token", "node", "company"))
    release(spark)
    undecided = members.withColumn("component", F.col("node")).withColumn("main", F.lit(None).cast("long"))
    tried = links = labels = None
    for turn in range(hub_rounds):
        # all members meet a hub of their list; later, those outside its main component meet one of that
        order = F.struct("company", "node") if turn == 0 else F.struct(F.xxhash64(F.lit(turn), "node"), "node")
        within = undecided if turn == 0 else undecided.filter("component = main")
        hubs = within.groupBy("token").agg(F.max_by("node", order).alias("hub"))
        asking = undecided if turn == 0 else undecided.filter("component <> main")
        fresh = asking.join(shuffled(hubs), "token").filter("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
        fresh = cut(fresh if tried is None else fresh.join(tried, ["a", "b"], "left_anti"))
        more = cut(_linked(fresh, nodes, percent))
        tried, links = (fresh, more) if tried is None else (cut(tried.union(fresh)), cut(links.union(more)))
        if turn and more.isEmpty():
            break
        labels, undecided = _undecided(members, links)
        release(spark)
    left = cut(tiles(shuffled(undecided.select("token", "node", "component", "main")), nodes, percent).join(tried, ["a", "b"], "left_anti"))
    more = cut(_linked(left, nodes, percent))
    # the sets of one id belong together
    several = full.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id")
    repeated = full.join(several, "doc_id").select("doc_id", "set_a", "set_b").distinct().join(named.select("set_a", "set_b", "node"), ["set_a", "set_b"])
    least = repeated.groupBy("doc_id").agg(F.min("node").alias("a"))
    tied = cut(repeated.join(least, "doc_id").filter("a <> node").select("a", F.col("node").alias("b")).distinct())
    if not (more.isEmpty() and tied.isEmpty()):
        labels = components(cut(links.union(more).union(tied)))
    grouped = named.select("set_a", "set_b", "node", "doc_id").join(F.broadcast(labels) if few(labels) else shuffled(labels), "node", "left").withColumn("component", F.coalesce("component", "node"))
    # a table of its own, so that the join with it can split the rows of a large component
    names = cut(grouped.groupBy("component").agg(F.min("doc_id").alias("name")))
    called = grouped.join(names, "component").select("set_a", "set_b", "name")
    out = rows.select("doc_id", "n_shingles", "set_a", "set_b").join(called, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("name")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))


def op11_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents``, five-word shingles, similarity 0.8 or more."""
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP11_SQL = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE list_slice(w, i, i + 4) END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id"""
