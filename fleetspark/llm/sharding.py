"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

A hash of the row deals rows into partitions. The number that each partition sends to each shard is drawn
from the multivariate hypergeometric law with the exact shard sizes as margins, so every assignment of rows
to places is equally likely. A partition orders its rows by a second hash (the local permutation) and sends
consecutive runs of the drawn lengths; a shard orders what it gets by a third hash (permuting again), block
by block, so that no task ever holds a whole shard.

Partitions, hashes and draws depend on the rows and the seed alone: a task that runs again after an executor
was lost makes the same rows. The matrix has ``partitions`` x ``shards`` numbers (bounded by parameters) and
is all that passes through the driver.

Defined results. The sizes of shards differ by one at most, the first ones are the longer ones; slots are
gapless from 0. The key columns should name a row: rows equal in all of them (nulls included) are interchangeable, get
different slots, and are dealt to one partition, so many such rows need a further key. A null text counts as empty. Empty input: empty
output. Fewer rows than shards: the last shards are empty. All columns are carried along; a clash with the added or
inner names (``_part``, ``_rank``, ``_block``, ``ends``, ``before``) is an error.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.llm.common import cut

#: Standard deviations from the mode within which a draw is looked for; what lies beyond is less than a double resolves.
_REACH = 12


def hypergeometric(good: int, rest: int, want: int, rng: np.random.Generator) -> int:
    """How many of ``want`` rows drawn from ``good + rest`` are good, for numbers of any size: inversion of the exact
    probabilities, built from the mode outwards by their ratios."""
    low, high = max(0, want - rest), min(good, want)
    if low == high:
        return low
    total = good + rest
    mode = min(high, max(low, (good + 1) * (want + 1) // (total + 2)))
    spread = (want * (good / total) * (rest / total) * ((total - want) / max(1, total - 1))) ** 0.5
    reach = int(_REACH * spread) + 60
    up = np.arange(mode, min(high, mode + reach), dtype=np.float64)  # ratio of k + 1 to k
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)  # ratio of k - 1 to k
    above = np.cumprod((good - up) * (want - up) / ((up + 1) * (rest - want + up + 1)))
    below = np.cumprod(down * (rest - want + down) / ((good - down + 1) * (want - down + 1)))
    weights = np.cumsum(np.concatenate((below[::-1], [1.0], above)))
    return mode - len(below) + int(np.searchsorted(weights, rng.random() * weights[-1], side="right"))


def communication_matrix(partition_sizes: list[int], shards: int, seed: int) -> np.ndarray:
    """(partitions, shards) numbers of rows; the row sums are the partition sizes, the column sums the shard sizes."""
    total = sum(partition_sizes)
    left = [total // shards + (s < total % shards) for s in range(shards)]
    rng, out = np.random.default_rng(seed), np.zeros((len(partition_sizes), shards), np.int64)
    for p, want in enumerate(partition_sizes):
        pool = sum(left)
        for s in range(shards):
            pool -= left[s]
            out[p, s] = hypergeometric(left[s], pool, want, rng)
            want -= int(out[p, s])
            left[s] -= int(out[p, s])
    return out


def shuffle_into_shards(rows: DataFrame, keys: list[str], shards: int = 24, seed: int = 20_240_101, rows_per_partition: int = 20_000, most_partitions: int = 8192, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """``rows`` with the shard and slot of each; ``keys`` name a row (ties: rows equal in them)."""
    if clash := {shard_col, slot_col, "_part", "_rank", "_block", "ends", "before"} & set(rows.columns):
        raise ValueError(f"columns {sorted(clash)} are there already; choose other names")
    spark, total = rows.sparkSession, rows.count()
    n = max(1, min(most_partitions, -(-total // rows_per_partition)))

    def drawn(turn: int):
        return F.xxhash64(F.lit(seed + turn), *keys)

    parts = rows.withColumn("_part", F.pmod(drawn(0), F.lit(n)))
    sizes = {r["_part"]: r["n"] for r in parts.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    matrix = communication_matrix([sizes.get(p, 0) for p in range(n)], shards, seed)
    ends = spark.createDataFrame([(p, row) for p, row in enumerate(np.cumsum(matrix, axis=1).tolist())], "_part long, ends array<long>")
    within = Window.partitionBy("_part").orderBy(drawn(1), *keys)
    sent = (
        parts.withColumn("_rank", F.row_number().over(within) - 1)
        .join(F.broadcast(ends), "_part")  # most_partitions x shards numbers at most
        .withColumn(shard_col, F.size(F.filter("ends", lambda e: e <= F.col("_rank"))).cast("int"))
        .withColumn("_block", F.pmod(drawn(2), F.lit(-(-n // shards))))
        .drop("_part", "_rank", "ends")
    )
    sent = cut(sent)
    counts = sent.groupBy(shard_col, "_block").agg(F.count("*").alias("n"))  # about n rows
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy(shard_col).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)))
    again = Window.partitionBy(shard_col, "_block").orderBy(drawn(3), *keys)
    return (
        sent.withColumn(slot_col, F.row_number().over(again) - 1)
        .join(F.broadcast(before.select(shard_col, "_block", F.coalesce("before", F.lit(0)).alias("before"))), [shard_col, "_block"])
        .withColumn(slot_col, (F.col(slot_col) + F.col("before")).cast("long"))
        .drop("_block", "before")
    )


def write_shards(assigned: DataFrame, path: str, shard_col: str = "shard", slot_col: str = "slot", rows_per_file: int = 1_000_000) -> None:
    """One folder a shard, its files in slot order."""
    assigned.repartition(shard_col, F.floor(F.col(slot_col) / rows_per_file)).sortWithinPartitions(shard_col, slot_col).write.partitionBy(shard_col).parquet(path)


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents`` in 24 shards; a null text has no bytes and the checksum of none (0)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    out = shuffle_into_shards(rows, ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
