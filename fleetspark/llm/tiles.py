"""Pairs of sets in crowded lists: size bands, tiles of bounded size, and bitmaps that bound an overlap from above."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.llm.common import tidy
from fleetspark.llm.words import mix

#: 64-bit words of a bitmap.
WIDTH = 8
#: Nodes of a tile; a list with more in a size band is cut in blocks.
TILE = 1_024


def bitmaps(doc: np.ndarray, hashed: np.ndarray, n_docs: int) -> pa.Array:
    """The bitmap of each document's distinct shingles: whether the number of them with each hash value is odd. What two
    documents share leaves no trace in the bits that differ, so these are no more than the shingles that differ."""
    size = WIDTH * 64
    slot = (mix(hashed + np.uint64(7)) & np.uint64(size - 1)).astype(np.int64)
    odd = (np.bincount(doc * size + slot, minlength=n_docs * size) & 1).astype(np.uint8).reshape(n_docs, size)
    return pa.array([r.tobytes() for r in np.packbits(odd, axis=1)], pa.binary())


def bounded(a: np.ndarray, b: np.ndarray, n: tuple, held: tuple, percent: int) -> np.ndarray:
    """Whether pairs of bitmaps (rows of words of 64 bits) leave room for enough overlap."""
    apart = np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)
    most = np.minimum((held[0] + held[1] - apart) // 2, np.minimum(held[0], held[1]))
    return 100 * most >= percent * (n[0] + n[1] - most)


def _tile_pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of each tile (rows sorted by its key): pairs of different components that their bitmaps allow."""
    key, rows, out = None, [], []

    def compare(tile: tuple, rows: list[tuple]) -> None:
        node, n, held, component, loose, own, block = (np.array(c) for c in list(zip(*rows, strict=True))[:7])
        bits = np.frombuffer(b"".join(r[7] for r in rows), np.uint64).reshape(-1, WIDTH)
        left = np.flatnonzero(loose & (block == tile[2]))
        right = np.flatnonzero(block == tile[3])
        for one, two in ((left, right),) if tile[2] == tile[3] else ((left, right), (np.flatnonzero(loose & (block == tile[3])), np.flatnonzero(block == tile[2]))):
            for a in range(0, len(one), 256):
                x, y = one[a : a + 256, None], two[None, :]
                if not x.size or not y.size:
                    continue
                ok = (component[x] != component[y]) & (own[x] | own[y]) & ((node[x] < node[y]) | ~loose[y])
                ok &= bounded(bits[x], bits[y], (n[x], n[y]), (held[x], held[y]), percent)
                i, j = np.nonzero(ok)
                i, j = node[one[a + i]], node[two[j]]
                out.append((np.minimum(i, j), np.maximum(i, j)))

    def made() -> pa.RecordBatch:
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else ((), ())))
        out.clear()
        return pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    for batch in batches:
        tiles = zip(*(batch.column(c).to_pylist() for c in ("token", "band", "i", "j")), strict=True)
        for tile, *row in zip(tiles, *(batch.column(c).to_pylist() for c in ("node", "n", "held", "component", "loose", "own", "block", "bits")), strict=True):
            if tile != key:
                if len(rows) > 1:
                    compare(key, rows)
                key, rows = tile, []
            rows.append(tuple(row))
        yield made()
    if len(rows) > 1:
        compare(key, rows)
    yield made()
    tidy()


def tiles(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of ``members`` (token, node, component, main) that are in one list, of different components and
    allowed by their bitmaps. Members outside their list's main component are loose; the others meet only these."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.01 / percent))).cast("int")
    held = members.withColumn("loose", F.col("component") != F.col("main")).join(nodes.select("node", "n", "held", "bits"), "node").withColumn("of", band)
    # a band's tile holds its own nodes and those of the band below
    placed = held.select("*", F.explode(F.array(F.col("of"), F.col("of") + 1)).alias("band")).withColumn("own", F.col("of") == F.col("band"))
    size = placed.groupBy("token", "band").agg(F.count("*").alias("size"), F.sum(F.col("loose").cast("int")).alias("open"), F.max("own").alias("some")).filter("size > 1 AND open > 0 AND some")
    blocks = F.ceil(F.col("size") / TILE).cast("int")
    cutting = placed.join(size.select("token", "band", blocks.alias("blocks")), ["token", "band"]).withColumn("block", F.expr("CAST(pmod(xxhash64(node), blocks) AS int)"))
    spread = cutting.select("*", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other")).select("token", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "n", "held", "component", "loose", "own", "block", "bits")
    key = ["token", "band", "i", "j"]
    return spread.repartition(*key).sortWithinPartitions(*key).mapInArrow(lambda it: _tile_pairs(it, percent), "a long, b long").distinct()
