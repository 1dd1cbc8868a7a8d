"""Spelling variants: words one edit apart, by dynamic programming over sorted lists.

Words are counted over all texts. A near pair has lengths (m, m) or (m, m + 1), and its edit stands at one position of
the smaller word, from 0 to m. The positions are cut in two segments; words with the same letters outside a segment
make one list, so every near pair meets in exactly one list (an inserted letter stands as far right as it can). A list
of more than ``most`` words has its segment halved again, down to one position, so no list grows with the vocabulary and
no list is sent twice.

Each list holds what its words have inside the segment, sorted. A query scans it from the start with a band of three
cells of the edit matrix a letter; the rows of the letters that two neighbours share are computed once. When a row has no
cell below two, all words with these first letters are skipped.

Defined results. Null and empty texts have no words. A null id counts as empty in the deletion rule. Repeated rows count
as often as they stand there. Ties of a form go to the smaller word. An empty table gives an empty table. Texts and runs
of any length are read whole. Only the id and text columns are read, so no other column can clash.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.llm.common import chunks, cut, release, tidy
from fleetspark.llm.conversation_trie import CRC_OF
from fleetspark.llm.words import Words, letter_runs

#: Runs of more bytes have their checksum computed one by one.
LONG = 64
#: Distinct words that a task holds before it hands its counts on.
HELD = 400_000
#: What one byte does to the state of a crc32: from the checksum of that byte alone.
_CRC = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)


def checksums(runs: Words, begun: np.ndarray) -> np.ndarray:
    """The crc32 of each run, going on from ``begun`` of its text."""
    size = runs.ends - runs.starts
    state = begun[runs.doc] ^ np.uint32(0xFFFFFFFF)
    at = np.flatnonzero(size <= LONG)
    step = 0
    while len(at):
        byte = runs.data[runs.starts[at] + step]
        state[at] = _CRC[(state[at] ^ byte) & np.uint32(0xFF)] ^ (state[at] >> np.uint32(8))
        step += 1
        at = at[size[at] > step]
    out = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = zlib.crc32(runs.data[runs.starts[i] : runs.ends[i]].tobytes(), int(begun[runs.doc[i]]))
    return out


def _counts(batches: Iterator[pa.RecordBatch], least: int, damage: int) -> Iterator[pa.RecordBatch]:
    held, n_held = [], 0
    for table in chunks(batches, "text", 4 << 20):
        runs = letter_runs(table.column("text"))
        points = np.concatenate(([0], np.cumsum((runs.data & 0xC0) != 0x80)))
        length = points[runs.ends] - points[runs.starts]
        some = length >= least
        runs = Words(runs.data, runs.starts[some], runs.ends[some], runs.doc[some], runs.first)
        length = length[some]
        begun = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in table.column("doc_id").to_pylist()], np.uint32)
        hit = np.zeros(len(length), bool)
        changed = []
        if damage:
            crc = checksums(runs, begun)
            hit = crc % np.uint32(damage) == 0
            for i in np.flatnonzero(hit & (length > least)).tolist():
                word = runs.data[runs.starts[i] : runs.ends[i]].tobytes().decode()
                at = int(crc[i]) % len(word)
                changed.append(word[:at] + word[at + 1 :])
        size = (runs.ends - runs.starts)[~hit]
        mark = np.zeros(len(runs.data) + 1, np.int8)
        mark[runs.starts[~hit]] += 1
        mark[runs.ends[~hit]] -= 1
        offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
        letters = runs.data[np.cumsum(mark[:-1], dtype=np.int8) > 0]
        words = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
        met = pa.concat_arrays([words, pa.array(changed, pa.large_string())])
        found = pc.value_counts(met)
        held.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
        n_held += len(found)
        if n_held > HELD:
            held = [pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])]
            n_held = held[0].num_rows
            if n_held > HELD // 2:
                yield from held[0].cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).to_batches()
                held, n_held = [], 0
    if held:
        yield from pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]).cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).to_batches()
    tidy()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, often: int = 5, damage: int = 0) -> DataFrame:
    """(word, n): the runs of letters of at least ``least`` code points that occur ``often`` times or more. ``damage``: where
    it divides the crc32 of ``<id>:<run>``, the run loses one code point first."""
    slim = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = slim.mapInArrow(lambda it: _counts(it, least, damage), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= often)


def near(queries: list[str], words: list[str], last: bool) -> Iterator[tuple[int, int]]:
    """(query, word) of all pairs one edit apart, numbers in both lists. ``words`` is sorted; a word is as long as the
    query or one letter longer. A letter at the end, after the whole query, counts only in the ``last`` segment: in
    another one the letters behind the segment go on, and the pair meets where its letter stands as far right as it can."""
    shared = [0] * len(words)
    for i in range(1, len(words)):
        a, b = words[i - 1], words[i]
        n = 0
        for x, y in zip(a, b, strict=False):
            if x != y:
                break
            n += 1
        shared[i] = n
    for number, query in enumerate(queries):
        size = len(query)
        # row j: the edits from j letters of the word to j - 1, j and j + 1 letters of the query; 2 stands for more than one
        rows = [(2, 0, 1 if size else 2)]
        i = 0
        while i < len(words):
            word = words[i]
            j = min(len(rows) - 1, shared[i])
            del rows[j + 1 :]
            left, mid, right = rows[j]
            skip = 0
            for j in range(j + 1, len(word) + 1):
                letter = word[j - 1]
                x = mid + 1
                if j >= 2 and left + (letter != query[j - 2]) < x:
                    x = left + (letter != query[j - 2])
                y = z = 2
                if j <= size:
                    y = min(mid + (letter != query[j - 1]), right + 1, x + 1)
                    if j < size:
                        z = min(right + (letter != query[j]), y + 1)
                left, mid, right = x, y, z
                rows.append((x, y, z))
                if x > 1 and y > 1 and z > 1:
                    skip = j
                    break
            if skip:
                # on to the first word without these letters
                i = bisect_left(words, word[:skip] + "\U0010ffff", i + 1)
                if i < len(words):
                    del rows[shared_prefix(word, words[i], skip) + 1 :]
                continue
            edits = rows[len(word)][1 if len(word) == size else 0]
            if edits == 1 and (last or not word.startswith(query)):
                yield number, i
            i += 1


def shared_prefix(a: str, b: str, most: int) -> int:
    n = 0
    while n < most and n < len(b) and a[n] == b[n]:
        n += 1
    return n


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each list (rows sorted by its key, then by ``rest``): the near words of each of its words, counted."""

    def done(key: tuple, rows: list[tuple], out: list[tuple]) -> None:
        rest = [r[0] for r in rows]
        asking = [k for k, r in enumerate(rows) if r[3]]
        met: dict[int, list] = {}
        for number, i in near([rest[k] for k in asking], rest, key[2] == key[0] + 1):
            k = asking[number]
            # of two words of one length each asks for the other; a longer word is only found
            for own, other in ((k, i),) if rows[i][3] else ((k, i), (i, k)):
                best = (-rows[other][2], rows[other][1])
                if own in met:
                    met[own][0] += 1
                    met[own][1] = min(met[own][1], best)
                else:
                    met[own] = [1, best]
        out += [(rows[k][1], count, -best[0], best[1]) for k, (count, best) in met.items()]

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        word, count, n, form = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.record_batch({"word": pa.array(word, pa.string()), "n_near": pa.array(count, pa.int64()), "form_n": pa.array(n, pa.int64()), "form": pa.array(form, pa.string())})

    key, rows, out = None, [], []
    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in ("m", "a", "b", "before", "after")), strict=True)
        for own, *row in zip(keys, *(batch.column(c).to_pylist() for c in ("rest", "word", "n", "small")), strict=True):
            if own != key:
                if len(rows) > 1:
                    done(key, rows, out)
                key, rows = own, []
            rows.append(tuple(row))
        if len(out) > 10_000:
            yield batch_of(out)
            out = []
    if len(rows) > 1:
        done(key, rows, out)
    yield batch_of(out)


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` (word, n, small, m, a, b) with what each word has before, in and after the segment [a, b)."""
    longer = "CASE WHEN small THEN 0 ELSE 1 END"
    return rows.withColumns({"before": F.expr("substr(word, 1, a)"), "rest": F.expr(f"substr(word, a + 1, b - a + {longer})"), "after": F.expr(f"substr(word, b + 1 + {longer})")})


KEY = ["m", "a", "b", "before", "after"]


def lists(words: DataFrame, most: int = 2_000) -> DataFrame:
    """The words (word, n) in all their lists; lists of more than ``most`` words are split."""
    size = F.length("word")
    roles = words.select("word", "n", F.explode(F.array(F.struct(F.lit(True).alias("small"), size.alias("m")), F.struct(F.lit(False).alias("small"), (size - 1).alias("m")))).alias("r")).select("word", "n", "r.*")
    half = "CAST(floor(m / 2) AS int)"
    open_ = roles.select("*", F.expr(f"explode(array(named_struct('a', 0, 'b', {half}), named_struct('a', {half}, 'b', m + 1)))").alias("s")).select("word", "n", "small", "m", "s.*")
    done = None
    while True:
        placed = cut(_placed(open_))
        crowded = cut(placed.groupBy(*KEY).agg(F.count("*").alias("size")).filter((F.col("size") > most) & (F.col("b") - F.col("a") > 1)).drop("size"))
        none = crowded.isEmpty()
        rest = placed if none else placed.join(crowded, KEY, "left_anti")
        done = rest if done is None else done.unionByName(rest)
        if none:
            return done
        middle = "CAST(floor((a + b) / 2) AS int)"
        again = placed.join(crowded, KEY, "left_semi").select("word", "n", "small", "m", F.expr(f"explode(array(named_struct('a', a, 'b', {middle}), named_struct('a', {middle}, 'b', b)))").alias("s"))
        open_ = again.select("word", "n", "small", "m", "s.*")


def variants(words: DataFrame, times: int = 5, most: int = 2_000) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words (word, n): n_near words are one edit away; the form is the one
    of them with the largest n, if that is ``times`` the word's or more; root is where forms lead to from the word."""
    words = cut(words)
    found = lists(words, most).repartition(*KEY).sortWithinPartitions(*KEY, "rest").mapInArrow(_lists, "word string, n_near long, form_n long, form string")
    none = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<less:long,form:string>").alias("best"))
    both = none.unionByName(found.select("word", F.lit(None).cast("long").alias("n"), "n_near", F.struct((-F.col("form_n")).alias("less"), "form").alias("best")))
    near_of = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    enough = -F.col("best.less") >= times * F.col("n")
    formed = cut(near_of.select("word", "n", "n_near", F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")))
    release(words.sparkSession)
    # a form is several times as frequent as its word, so chains are short; each round doubles what is followed
    roots = cut(formed.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("top"))
        after = cut(roots.join(further, "root", "left").select("word", F.coalesce("top", "root").alias("root"), "top"))
        roots = after.drop("top")
        if after.filter("top is not null").isEmpty():
            break
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents``: words of six letters or more, five times or more, one run in 199 damaged."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return variants(vocabulary(docs, damage=199))


_POINTS = "flatten(list_transform(string_split(CAST(doc_id AS varchar) || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END))"
OP12_SQL = f"""WITH RECURSIVE a AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
b AS (SELECT doc_id, run, count(*) AS c FROM a WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT *, {CRC_OF.format(bytes=_POINTS)} AS h FROM b),
d AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM h),
w AS (SELECT word, sum(c)::BIGINT AS n FROM d WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
x AS (SELECT word, n, p, substr(word, 1, p) || substr(word, p + 2) AS cut FROM (SELECT *, unnest(range(0, length(word)))::INT AS p FROM w)),
e AS (SELECT DISTINCT * FROM (SELECT x.word, y.word AS other, y.n AS other_n FROM x JOIN x y ON x.p = y.p AND x.cut = y.cut AND x.word <> y.word
  UNION ALL SELECT x.word, w.word, w.n FROM x JOIN w ON w.word = x.cut UNION ALL SELECT w.word, x.word, x.n FROM x JOIN w ON w.word = x.cut)),
g AS (SELECT word, count(*) AS n_near, max(other_n) AS best FROM e GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(g.n_near, 0) AS n_near, CASE WHEN g.best >= 5 * w.n THEN g.best END AS form_n, CASE WHEN g.best >= 5 * w.n THEN (SELECT min(e.other) FROM e WHERE e.word = w.word AND e.other_n = g.best) END AS form FROM w LEFT JOIN g ON g.word = w.word),
r AS (SELECT word, word AS root FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word JOIN f z ON z.word = r.root AND z.form IS NULL"""
