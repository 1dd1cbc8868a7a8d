"""Near-duplicate documents by SuperMinHash signatures, banding, verification and union-find grouping.

A document is the set of its distinct k-word shingles (words as in ``words``, A-Z lower-cased). Each
shingle walks through a permutation of its own over the signature's slots; its rank there, with a random
fraction, competes for the slot's minimum. Ranks of one shingle are correlated (no slot twice), which gives
lower variance than independent hashes, and a document stops as soon as all its slots hold a lower rank
than the next one to come.

``bands`` bands of ``rows`` slots make bucket keys. A pair at the threshold 0.8 shares none of 64 bands of
8 with probability (1 - 0.8^8)^64 < 1e-5; that is the only way a link can be missed. Candidates are
verified on full shingle sets. Documents with the same set are one node. A bucket is compared with one
hub first (the member with most company in its buckets) and, when links have made components, a few times with a
hub of its main component. The members that are still in another component then meet all others of their bucket in
tiles of bounded size, by bitmaps of 512 bits that bound the overlap from above (see ``tiles``): only pairs that may be links
leave a tile, and no link between components is lost.

Defined results. Null or empty texts, and those without a word, have an empty set: no links, own component.
Fewer than k words: the whole sequence is the one shingle. Rows that repeat an id are linked with each other if
both have a set, so each text of the id keeps its links; ties need no order, as a component's name is its smallest
id. A null id is kept with null component and links nothing. An empty table gives an empty table. Texts of any
length are read whole. Only the id and text columns are read, so no other column can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.llm.common import chunks, cut, release, tidy
from fleetspark.llm.graph import components
from fleetspark.llm.tiles import bitmaps, tiles
from fleetspark.llm.words import Words, mix, words_of

SLOT_STEP = 0x9E3779B97F4A7C15
SLOT_SEED = np.uint64(SLOT_STEP)
#: Documents with no more shingles than this keep their permutations as a table, of so many shingles at a time.
SMALL = 64
TABLE = 8_192


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles, by document and hash."""
    h = words.hashes()
    at = np.flatnonzero(words.whole(k))
    doc, hashed = words.doc[at], words.grams(h, k, at)
    for size in range(1, k):
        own = np.flatnonzero(words.counts == size)
        if len(own):
            doc = np.append(doc, own)
            hashed = np.append(hashed, mix(words.grams(h, size, words.first[own]) + np.uint64(size)))
    order = np.lexsort((hashed, doc))
    doc, hashed = doc[order], hashed[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashed[1:] != hashed[:-1])
    return doc[new].astype(np.int64), hashed[new]


def _draw(hashed: np.ndarray, j: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each shingle in round j: the 32-bit fraction and the position that is exchanged with j."""
    u = mix(hashed + np.uint64(SLOT_STEP * (j + 1) & 0xFFFFFFFFFFFFFFFF))
    low = u & np.uint64(0xFFFFFFFF)
    return (u >> np.uint64(32)) | (np.uint64(j) << np.uint64(32)), (low * np.uint64(m - j) >> np.uint64(32)).astype(np.int64) + j


def _rounds(sig: np.ndarray, doc: np.ndarray, hashed: np.ndarray, m: int, table: bool) -> None:
    flat = sig.reshape(-1)
    swaps: list[np.ndarray] = []
    perm = np.tile(np.arange(m, dtype=np.int16), (len(doc), 1)) if table else None
    for j in range(m):
        if not len(doc):
            return
        value, k = _draw(hashed, j, m)
        if table:
            row = np.arange(len(doc))
            slot = perm[row, k].astype(np.int64)
            perm[row, k] = perm[:, j]
        else:
            slot = k.copy()
            for i in range(j - 1, -1, -1):  # before round i, position swaps[i] held what stood at i
                slot[slot == swaps[i]] = i
            swaps.append(k.astype(np.int16))
        np.minimum.at(flat, doc * m + slot, value)
        live = np.unique(doc)
        on = np.zeros(len(sig), bool)
        on[live[(sig[live].max(axis=1) >> np.uint64(32)) > j]] = True
        stay = on[doc]
        if not stay.all():
            doc, hashed = doc[stay], hashed[stay]
            perm = perm[stay] if table else None
            swaps = [s[stay] for s in swaps]


def signatures(doc: np.ndarray, hashed: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """SuperMinHash: (n_docs, m) of rank << 32 | fraction; rows of documents without shingles stay at the maximum."""
    sig = np.full((n_docs, m), np.iinfo(np.uint64).max, np.uint64)
    small = (np.bincount(doc, minlength=n_docs) <= SMALL)[doc]
    of, given = doc[small], hashed[small]
    edges = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of))  # a document's shingles stay together
    a = 0
    while a < len(of):
        b = int(edges[np.searchsorted(edges, a + TABLE, side="right") - 1])
        _rounds(sig, of[a:b], given[a:b], m, True)
        a = b
    _rounds(sig, doc[~small], hashed[~small], m, False)
    return sig


def _signed(batches, k: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for table in chunks(batches, "text", 1 << 20, 2_000):
        words = words_of(table.column("text"), lower=True)
        doc, hashed = shingles(words, k)
        n = table.num_rows
        sig = signatures(doc, hashed, n, bands * rows).reshape(n, bands, rows)
        key = np.full((n, bands), 0x51, np.uint64) + np.arange(bands, dtype=np.uint64)
        for r in range(rows):
            key = mix(key * SLOT_SEED + sig[:, :, r])
        size = np.bincount(doc, minlength=n)
        one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        np.add.at(one, doc, mix(hashed + np.uint64(1)))
        np.add.at(two, doc, mix(hashed ^ SLOT_SEED))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bands, pa.int32()), pa.array(key.reshape(-1).view(np.int64)))
        yield pa.record_batch(
            {"doc_id": table.column("doc_id").combine_chunks(), "text_hash": table.column("text_hash").combine_chunks(), "n_shingles": pa.array(size, pa.int64()), "set_a": pa.array(one.view(np.int64)), "set_b": pa.array(two.view(np.int64)), "bands": lists}
        )
    tidy()


def _sets(batches, k: int) -> Iterator[pa.RecordBatch]:
    for table in chunks(batches, "text", 1 << 20, 2_000):
        doc, hashed = shingles(words_of(table.column("text"), lower=True), k)
        ends = np.searchsorted(doc, np.arange(table.num_rows + 1))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashed.view(np.int64)))
        size = pa.array(np.diff(ends), pa.int32())
        yield pa.record_batch({"node": table.column("node").combine_chunks(), "n": size, "held": size, "bits": bitmaps(doc, hashed, table.num_rows), "shingles": lists})
    tidy()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    with_b = with_a.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    total = F.size("sa") + F.size("sb")
    # a pair whose sizes differ too much can't pass, whatever it shares
    close = with_b.filter(100 * F.least(F.size("sa"), F.size("sb")) >= percent * F.greatest(F.size("sa"), F.size("sb")))
    shared = close.select("a", "b", total.alias("total"), F.size(F.array_intersect("sa", "sb")).alias("shared"))
    return shared.filter(100 * F.col("shared") >= percent * (F.col("total") - F.col("shared"))).select("a", "b")


def _undecided(members: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The components that the links make, and the members (bucket, node, company, component, main) of
    buckets that hold several of them; main is the component with most members there."""
    labels = components(links)
    labelled = members.join(labels, "node", "left").select("bucket", "node", "company", F.coalesce("component", "node").alias("component"))
    counts = labelled.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    mains = counts.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts")).filter("parts > 1")
    return labels, cut(labelled.join(mains, "bucket").select("bucket", "node", "company", "component", "main"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, bands: int = 64, rows: int = 8, star_rounds: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; see the module's text.

    ``percent``: the least similarity of a link, intersection over union in hundredths. ``star_rounds``:
    rounds of further hubs before the exact rest; any number gives the same result.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    kinds = "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, bands array<long>"
    signed = cut(slim.mapInArrow(lambda it: _signed(it, k, bands, rows), kinds).withColumn("row", F.monotonically_increasing_id()))
    full = signed.filter("n_shingles > 0 and doc_id is not null")
    # a node is a set; it goes by the row that holds it with the smallest id
    nodes = full.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "row")).alias("least")).select("set_a", "set_b", F.col("least.row").alias("node"), F.col("least.doc_id").alias("doc_id"))
    first = full.join(nodes.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node")
    banded = first.select("node", F.explode("bands").alias("bucket"))
    # without the buckets of one member, which hold most rows and are found by map-side counts of the keys alone
    shared = banded.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members = cut(banded.join(shared, "bucket").select("bucket", "node", "size"))
    release(spark)
    company = members.groupBy("node").agg(F.sum("size").alias("company"))
    members = cut(members.join(company, "node").select("bucket", "node", "company", "size"))
    wanted = first.join(company.select("node"), "node", "left_semi").select("node", "doc_id", "text_hash")
    # rows with the same id and hash hold the same text
    sets = cut(slim.join(wanted, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"]).select("node", "text").mapInArrow(lambda it: _sets(it, k), "node long, n int, held int, bits binary, shingles array<long>"))
    release(spark)

    hubs = members.groupBy("bucket").agg(F.max_by("node", F.struct("company", "node")).alias("hub"))
    tried = members.join(hubs, "bucket").filter("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    tried = cut(tried)
    links = cut(_verified(tried, sets, percent))
    # a bucket of two has met its only pair
    larger = members.filter("size > 2").select("bucket", "node", "company")
    labels, undecided = _undecided(larger, links)
    for turn in range(star_rounds):
        # the loose members meet one more hub of the bucket's main component, another one each time
        ranked = undecided.filter("component = main").groupBy("bucket").agg(F.max_by("node", F.xxhash64(F.lit(turn), "node")).alias("hub"))
        again = undecided.filter("component <> main").join(ranked, "bucket").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
        fresh = cut(again.distinct().join(tried, ["a", "b"], "left_anti"))
        found = cut(_verified(fresh, sets, percent))
        if found.isEmpty():
            break
        tried, links = cut(tried.union(fresh)), cut(links.union(found))
        labels, undecided = _undecided(larger, links)
        release(spark)
    # the exact rest: what is loose meets all others of its buckets
    rest = undecided.select(F.col("bucket").alias("token"), "node", "component", "main")
    more = cut(_verified(tiles(rest, sets, percent).join(tried, ["a", "b"], "left_anti"), sets, percent))
    # the sets of one id belong together
    several = full.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id")
    repeated = full.join(several, "doc_id").select("doc_id", "set_a", "set_b").distinct().join(nodes.select("set_a", "set_b", "node"), ["set_a", "set_b"])
    least = repeated.groupBy("doc_id").agg(F.min("node").alias("a"))
    tied = cut(repeated.join(least, "doc_id").filter("a <> node").select("a", F.col("node").alias("b")).distinct())
    if not (more.isEmpty() and tied.isEmpty()):
        labels = components(cut(links.union(more).union(tied)))
    grouped = nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # a table of its own, so that the join with it can split the rows of a large component
    names = cut(grouped.groupBy("component").agg(F.min("doc_id").alias("name")))
    named = grouped.join(names, "component").select("set_a", "set_b", "name")
    out = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(named, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("name")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op7_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents``, four-word shingles, similarity 0.8 or more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, k=4)
