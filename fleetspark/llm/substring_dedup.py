"""Exact substring deduplication by fixed-block anchors.

A window of ``window`` words that repeats across documents holds at least one whole block of
``(window + 1) // 2`` words that starts at a multiple of that length in the document it repeats.
So the non-overlapping blocks of every document are indexed, and every rolling window of block length
probes the index (step A). Around the hits, and only there, windows of full length are compared on
128-bit keys (two independent hashes of 64 bits; among 10^12 windows, two unequal ones share both with probability
10^-15), and the smallest document of each key is found (step B). Step C extends the hits to
maximal exact repeats: the union of all windows that also start in a smaller document.

What crosses the network is packed per chunk of text and hash bucket, one entry for each distinct key of
a chunk. A passage that a third of all documents share is therefore one entry a chunk, not one a document,
and no step holds more than a bucket or a chunk of bounded size. The texts travel compressed, as chunks.

Defined results. Null and empty texts have no words: nothing is removed and the kept text is empty. A
document with fewer than ``window`` words loses nothing. Repeats inside one document stay. Rows with the
same id do not remove from each other (neither id is smaller). Rows with a null id keep all their words and
take none. The input's rows must come in the same order when a task runs again (a scan does; else the step
that would mix two orders raises an error). All columns of the input are carried along; the names of the
added ones can be chosen, and a clash is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.llm.common import chunks, cut, plain_strings, release, tidy
from fleetspark.llm.words import Words, mix, words_of

NO_ID = np.iinfo(np.int64).max
_BITMAP = 1 << 24


def _ids(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _chunk_id(table: pa.Table, id_col: str, text_col: str, words: Words) -> int:
    """A number that the chunk's rows and their order decide."""
    parts = np.concatenate((_ids(table, id_col).view(np.uint64), words.first.astype(np.uint64), np.array([len(words.data)], np.uint64)))
    place = np.arange(1, len(parts) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return int(mix(np.array([mix(parts + place).sum(dtype=np.uint64)]))[0].view(np.int64))


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


class _KeySet:
    """Membership of many 64-bit keys; a bitmap of their low bits settles most absent ones."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        self.bits = np.zeros(_BITMAP, bool)
        self.bits[(mix(self.keys.copy()) & np.uint64(_BITMAP - 1)).astype(np.int64)] = True

    def rows(self, probes: np.ndarray) -> np.ndarray:
        """Positions in ``probes`` whose key is in the set."""
        maybe = np.flatnonzero(self.bits[(mix(probes.copy()) & np.uint64(_BITMAP - 1)).astype(np.int64)])
        at = np.searchsorted(self.keys, probes[maybe])
        at[at == len(self.keys)] = 0
        return maybe[self.keys[at] == probes[maybe]] if len(self.keys) else maybe[:0]


def _block_keys(words: Words, hashes: np.ndarray, block: int, window: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, keys) of the rolling windows of block length in documents that can hold a window."""
    at = np.flatnonzero(words.whole(block) & (words.counts >= window)[words.doc[: max(0, len(words.doc) - block + 1)]])
    return at, words.grams(hashes, block, at) >> np.uint64(32 - bits)


# Entries of step A: the lower 32 bits of a key within its bucket, as sorted differences in byte planes, and
# two bits each: is it an aligned block of a document here; is it in several documents here.


def _planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones ...: sorted or small values then compress well."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _from_planes(blob: bytes, kind: str, n: int, at: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8, size * n, at).reshape(size, n).T).view(kind).ravel()


# Entries of step B and its answers: two 64-bit keys and the smallest document.


def _pack_windows(a: np.ndarray, b: np.ndarray, ids: np.ndarray, *flags: np.ndarray) -> bytes:
    return b"".join([np.uint32(len(a)).tobytes(), _planes(a), _planes(b), _planes(ids), *(np.packbits(f).tobytes() for f in flags)])


def _unpack_windows(blob: bytes, flag: bool = False) -> tuple[np.ndarray, ...]:
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    out = tuple(_from_planes(blob, kind, n, 4 + 8 * i * n) for i, kind in enumerate(("<u8", "<u8", "<i8")))
    return (*out, np.unpackbits(np.frombuffer(blob, np.uint8, (n + 7) // 8, 4 + 24 * n), count=n).astype(bool)) if flag else out


def _pack_keys(keys: np.ndarray, *flags: np.ndarray) -> bytes:
    step = np.diff(keys, prepend=np.uint32(0)).astype("<u4")
    return np.uint32(len(keys)).tobytes() + b"".join(np.packbits(f).tobytes() for f in flags) + _planes(step)


def _unpack_keys(blob: bytes, n_flags: int = 0) -> tuple[np.ndarray, ...]:
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    at, flags = 4, []
    for _ in range(n_flags):
        flags.append(np.unpackbits(np.frombuffer(blob, np.uint8, (n + 7) // 8, at), count=n).astype(bool))
        at += (n + 7) // 8
    return (np.cumsum(_from_planes(blob, "<u4", n, at), dtype=np.uint32), *flags)


def _by_bucket(chunk: int, buckets: np.ndarray, pack) -> pa.RecordBatch:
    """One row for each run of equal values of the sorted ``buckets``; pack(a, b) makes its payload."""
    edges = np.flatnonzero(np.diff(buckets, prepend=-1, append=-2)) if len(buckets) else np.zeros(0, np.int64)
    spans = list(zip(edges[:-1], edges[1:], strict=True))
    return pa.record_batch(
        {
            "bucket": pa.array([int(buckets[a]) for a, _ in spans], pa.int64()),
            "chunk": pa.array([chunk] * len(spans), pa.int64()),
            "keys": pa.array([pack(a, b) for a, b in spans], pa.binary()),
        }
    )


def _anchor_entries(batches, id_col, text_col, block, window, bits, chunk_bytes) -> Iterator[pa.RecordBatch]:
    for table in chunks(batches, text_col, chunk_bytes):
        words = words_of(table.column(text_col))
        at, keys = _block_keys(words, words.hashes(), block, window, bits)
        has_id = _ids(table, id_col) != NO_ID
        keep = has_id[words.doc[at]]
        at, keys = at[keep], keys[keep]
        if not len(at):
            continue
        order = np.argsort(keys, kind="stable")
        at, keys = at[order], keys[order]
        begin = np.flatnonzero(np.diff(keys, prepend=keys[:1] + np.uint64(1)))
        doc = words.doc[at]
        aligned = np.logical_or.reduceat((at - words.first[doc]) % block == 0, begin)
        last = np.append(begin[1:], len(keys)) - 1
        several = doc[begin] != doc[last]
        keys = keys[begin]
        low = keys.astype(np.uint32)
        yield _by_bucket(
            _chunk_id(table, id_col, text_col, words),
            (keys >> np.uint64(32)).astype(np.int64),
            lambda a, b, low=low, aligned=aligned, several=several: _pack_keys(low[a:b], aligned[a:b], several[a:b]),
        )
    tidy()


def _anchor_hits(table: pa.Table) -> pa.Table:
    """Of one bucket, for each chunk: its keys that are an indexed block and in two documents or more."""
    parts = [_unpack_keys(x.as_py(), 2) for x in table.column("keys")]
    keys = np.concatenate([p[0] for p in parts])
    aligned = np.concatenate([p[1] for p in parts])
    several = np.concatenate([p[2] for p in parts])
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    begin = np.flatnonzero(np.diff(ranked.astype(np.int64), prepend=-1))
    count = np.diff(np.append(begin, len(ranked)))
    good = np.logical_or.reduceat(aligned[order], begin) & ((count > 1) | np.logical_or.reduceat(several[order], begin))
    hit = np.zeros(len(keys), bool)
    hit[order] = np.repeat(good, count)
    out, at = ([], [], []), 0
    for (own, *_), chunk in zip(parts, table.column("chunk").to_pylist(), strict=True):
        mine = own[hit[at : at + len(own)]]
        at += len(own)
        if len(mine):
            out[0].append(table.column("bucket")[0].as_py())
            out[1].append(chunk)
            out[2].append(_pack_keys(mine))
    return pa.table({"bucket": pa.array(out[0], pa.int64()), "chunk": pa.array(out[1], pa.int64()), "keys": pa.array(out[2], pa.binary())})


def _texts(batches, id_col, text_col, chunk_bytes) -> Iterator[pa.RecordBatch]:
    for table in chunks(batches, text_col, chunk_bytes):
        chunk = _chunk_id(table, id_col, text_col, words_of(table.column(text_col)))
        yield pa.record_batch({"chunk": pa.array([chunk], pa.int64()), "rows": pa.array([_packed(table)], pa.binary())})
    tidy()


def _window_keys(words: Words, first: np.ndarray, second: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent keys of 64 bits of the windows from ``at``."""
    return words.grams(first, window, at), words.grams(second, window, at, family=1)


def _window_entries(texts: pa.Table, hits: pa.Table, id_col, text_col, block, window, bits, shift) -> pa.Table:
    """Of one chunk: the distinct keys of windows around its hits, each with the smallest document here."""
    if texts.num_rows == 0:
        raise RuntimeError("the input's rows came in another order when they were read again; checkpoint it first")
    empty = pa.table({"bucket": pa.array([], pa.int64()), "chunk": pa.array([], pa.int64()), "keys": pa.array([], pa.binary())})
    out = []
    for chunk, payload in zip(texts.column("chunk").to_pylist(), texts.column("rows"), strict=True):
        if hits.num_rows == 0:
            continue
        wanted = np.concatenate([(np.uint64(b) << np.uint64(32)) | _unpack_keys(k.as_py())[0].astype(np.uint64) for b, k in zip(hits.column("bucket").to_pylist(), hits.column("keys"), strict=True)])
        table = _unpacked(payload.as_py())
        words = words_of(table.column(text_col))
        first = words.hashes()
        at, keys = _block_keys(words, first, block, window, bits)
        found = at[_KeySet(wanted).rows(keys)]
        n = max(0, len(words.doc) - window + 1)
        marks = np.zeros(len(words.doc) + 2, np.int64)
        marks[found + 1] = 1
        total = np.cumsum(marks)
        reach = np.minimum(np.arange(n) + (window - block + 1), len(words.doc))
        ids = _ids(table, id_col)
        at = np.flatnonzero((total[reach] > total[:n]) & words.whole(window) & (ids != NO_ID)[words.doc[:n]])
        if not len(at):
            continue
        a, b = _window_keys(words, first, words.hashes(1), at, window)
        own = ids[words.doc[at]]
        order = np.lexsort((b, a))
        a, b, own = a[order], b[order], own[order]
        begin = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        low, high = np.minimum.reduceat(own, begin), np.maximum.reduceat(own, begin)
        a, b = a[begin], b[begin]
        out.append(
            pa.Table.from_batches(
                [_by_bucket(chunk, (a >> np.uint64(shift)).astype(np.int64), lambda x, y, p=(a, b, low, low != high): _pack_windows(*(v[x:y] for v in p)))]
            )
        )
    return pa.concat_tables(out) if out else empty


def _window_answers(table: pa.Table) -> pa.Table:
    """Of one bucket, for each chunk: its keys that also start in a document smaller than one that has them here."""
    parts = [_unpack_windows(x.as_py(), True) for x in table.column("keys")]
    a, b, low, several = (np.concatenate([p[i] for p in parts]) for i in range(4))
    order = np.lexsort((b, a))
    ra, rb = a[order], b[order]
    begin = np.flatnonzero(np.concatenate(([True], (ra[1:] != ra[:-1]) | (rb[1:] != rb[:-1]))))
    least = np.empty_like(low)
    least[order] = np.repeat(np.minimum.reduceat(low[order], begin), np.diff(np.append(begin, len(ra))))
    tell = several | (least < low)
    out, at = ([], []), 0
    for part, chunk in zip(parts, table.column("chunk").to_pylist(), strict=True):
        mine = slice(at, at + len(part[0]))
        at += len(part[0])
        yes = tell[mine]
        if yes.any():
            out[0].append(chunk)
            out[1].append(_pack_windows(part[0][yes], part[1][yes], least[mine][yes]))
    return pa.table({"chunk": pa.array(out[0], pa.int64()), "keys": pa.array(out[1], pa.binary())})


def _removed(words: Words, ids: np.ndarray, answers: pa.Table, window: int) -> np.ndarray:
    """Whether each word of the chunk is in a window that also starts in a smaller document."""
    gone = np.zeros(len(words.doc) + 1, np.int64)
    if answers.num_rows:
        parts = [_unpack_windows(k.as_py()) for k in answers.column("keys")]
        a, b, least = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.lexsort((b, a))
        a, b, least = a[order], b[order], least[order]
        first = words.hashes()
        at = np.flatnonzero(words.whole(window) & (ids != NO_ID)[words.doc[: max(0, len(words.doc) - window + 1)]])
        keys = words.grams(first, window, at)
        rows = _KeySet(a).rows(keys)
        at, keys = at[rows], keys[rows]
        other = _window_keys(words, first, words.hashes(1), at, window)[1]
        place = np.searchsorted(a, keys)
        while len(at):  # more than one turn only where two windows share the first key
            same = b[place] == other
            cover = at[same][least[place[same]] < ids[words.doc[at[same]]]]
            np.add.at(gone, cover, 1)
            np.add.at(gone, cover + window, -1)
            on = np.flatnonzero(~same & (place + 1 < len(a)))
            on = on[a[place[on] + 1] == keys[on]]
            at, keys, other, place = at[on], keys[on], other[on], place[on] + 1
    return np.cumsum(gone[:-1]) > 0


def _spans(removed: np.ndarray, words: Words) -> pa.Array:
    """Of each text, the maximal runs of removed words as {start, length}."""
    edge = np.zeros(len(removed) + 1, bool)
    edge[words.first] = True
    begin = np.flatnonzero(removed & (edge[:-1] | np.concatenate(([True], ~removed[:-1])))) if len(removed) else np.zeros(0, np.int64)
    stop = np.flatnonzero(removed & (edge[1:] | np.concatenate((~removed[1:], [True])))) + 1 if len(removed) else begin
    flat = pa.StructArray.from_arrays([pa.array(begin - words.first[words.doc[begin]], pa.int64()), pa.array(stop - begin, pa.int64())], ["start", "length"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(begin, words.first), pa.int32()), flat)


def _applied(texts: pa.Table, answers: pa.Table, id_col, text_col, window, added) -> pa.Table:
    if texts.num_rows == 0:
        raise RuntimeError("the input's rows came in another order when they were read again; checkpoint it first")
    out = []
    for payload in texts.column("rows"):
        table = _unpacked(payload.as_py())
        words = words_of(table.column(text_col))
        removed = _removed(words, _ids(table, id_col), answers, window)
        sums = np.concatenate(([0], np.cumsum(removed)))
        n_removed = sums[words.first[1:]] - sums[words.first[:-1]]
        kept = []
        for i, text in enumerate(plain_strings(table.column(text_col)).to_pylist()):
            own = text.encode().split()
            kept.append(b" ".join(compress(own, ~removed[words.first[i] : words.first[i + 1]]) if n_removed[i] else own))
        new = {"n_words": pa.array(words.counts, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string()), "removed_spans": _spans(removed, words)}
        for key, name in added.items():
            table = table.append_column(name, new[key])
        out.append(table)
    return pa.concat_tables(out)


ADDED = {"n_words": "n_words", "n_removed": "n_removed", "kept_text": "kept_text", "removed_spans": "removed_spans"}


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, bucket_bytes: int = 8 << 20, chunk_bytes: int = 4 << 20, added: dict[str, str] = ADDED) -> DataFrame:
    """``docs`` with, for each row, the words left when each word is dropped that a window covers which also
    starts in a document with a smaller id. Added: the number of words, of removed words, the kept words
    joined by one space, and the maximal removed runs. See the module's text for the method and edge cases.

    ``bucket_bytes`` of text go to each hash bucket, so their number grows with the input and their size
    does not; ``chunk_bytes`` of text are worked on at a time.
    """
    if clash := set(added.values()) & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are there already; choose other names in `added`")
    if window < 2:
        raise ValueError("a window has two words at least")
    spark, block = docs.sparkSession, (window + 1) // 2
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = min(30, max(6, int(np.ceil(np.log2(max(1, total / bucket_bytes))))))
    slim = docs.select(id_col, text_col)
    added = ADDED | added

    keyed = "bucket long, chunk long, keys binary"
    entries = slim.mapInArrow(lambda it: _anchor_entries(it, id_col, text_col, block, window, bits, chunk_bytes), keyed)
    hits = cut(entries.groupBy("bucket").applyInArrow(_anchor_hits, keyed))
    release(spark)
    slim_texts = slim.mapInArrow(lambda it: _texts(it, id_col, text_col, chunk_bytes), "chunk long, rows binary")
    windows = slim_texts.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(lambda t, h: _window_entries(t, h, id_col, text_col, block, window, bits, 64 - bits), keyed)
    answers = cut(windows.groupBy("bucket").applyInArrow(_window_answers, "chunk long, keys binary"))
    release(spark)
    texts = docs.mapInArrow(lambda it: _texts(it, id_col, text_col, chunk_bytes), "chunk long, rows binary")
    kinds = {"n_words": "long", "n_removed": "long", "kept_text": "string", "removed_spans": "array<struct<start:long,length:long>>"}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"`{name}` {kinds[k]}" for k, name in added.items())])
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda t, h: _applied(t, h, id_col, text_col, window, added), schema)


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents``: words, removed words and the digest of the kept ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
