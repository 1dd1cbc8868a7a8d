"""Benchmark decontamination with built-in expressions only.

A window of a document is as long as a benchmark item (or the whole document where that is shorter). Windows and
items are bags of five-word shingles over lower-cased letters and digits; their similarity is the weighted one,
the sum of smaller counts over the sum of larger counts. Steps:

1. Anchors: a window can only reach the threshold if enough of its positions hold a shingle of some item of its
   length. Document shingles are joined with the items' shingles; a window that begins at a matched position
   (or at the last place where it fits) and holds enough matches stays. Moving a window to its next match never
   lowers a similarity, so this loses none.
2. SimHash: each such window and each item gets a 64-bit fingerprint of its shingles.
3. Multi-index Hamming: fingerprints are cut into radius + 1 blocks; two within the radius agree in a block, so an
   equi-join on (length, block, value) finds all of them. At similarity 0.8 bits differ with probability 0.15, and
   a radius of 23 is passed once in a million pairs. That holds for bags of mostly different shingles; windows that
   repeat a fifth of theirs or more meet the items that share a shingle instead.
4. The exact weighted similarity decides.

A radius that loses no pair at 0.8 leaves blocks of two or three bits, which tell few windows from an item. So the
anchors choose the windows, and the blocks choose among the items for these.

Rows that hold no text, the anchors (hash, length) and the items' blocks, are broadcast only if there are
``most_broadcast`` of them or fewer; a larger benchmark is joined by a shuffle. Windows and items go by numbers until
the pairs are chosen.

Defined results. Null and empty texts, and items with fewer than five words, match nothing. Items equal to each other
are all reported. Windows are found by a hash of the text, so null and repeated ids are judged each by their own text;
the best similarity of a pair of ids is reported (a null id is one id). Texts of any length are read whole. Empty
tables: no rows. Other columns are not read, so none can clash.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspark.llm.common import cut

K = 5
_LANES, _ONES = 32, 0x0000000100000001


def _words(text: str) -> Column:
    plain = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.array_remove(F.split(plain, " "), "")


def _shingled(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """``keep``, the number of words and the hashed shingles. The words are bound to a lambda's variable: a plan
    may repeat an expression that stands in a column, but not evaluate it again for each shingle."""

    def made(w: Column) -> Column:
        hashed = F.transform(F.slice(w, 1, F.greatest(F.size(w) - (K - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(w[i + j] for j in range(1, K))))
        return F.struct(F.size(w).alias("n"), hashed.alias("sh"))

    bound = F.transform(F.array(_words(text)), made)
    return df.select(*keep, bound[0].alias("_q")).select(*keep, "_q.n", "_q.sh")


def simhash(shingles: str) -> Column:
    """The 64-bit SimHash of an array of 64-bit hashes: each bit is the majority of that bit. Two counters of 32 bits
    share a long, more than an array can have entries."""
    zero = ", ".join(f"'c{i}', 0L" for i in range(_LANES))
    step = ", ".join(f"'c{i}', s.c{i} + (shiftrightunsigned(h, {i}) & {_ONES}L)" for i in range(_LANES))
    bits = " | ".join(
        f"IF(2 * (shiftrightunsigned(s.c{i}, {32 * lane}) & 4294967295L) > size({shingles}), shiftleft(1L, {32 * lane + i}), 0L)" for i in range(_LANES) for lane in range(2)
    )
    return F.expr(f"aggregate({shingles}, named_struct({zero}), (s, h) -> named_struct({step}), s -> {bits})")


def blocks(fingerprint: str, radius: int) -> Column:
    """The radius + 1 blocks of a fingerprint, each with its number."""
    edges = [round(64 * i / (radius + 1)) for i in range(radius + 2)]
    return F.array(*(F.struct(F.lit(i).alias("block"), F.expr(f"shiftrightunsigned({fingerprint}, {a}) & {(1 << (b - a)) - 1}L").alias("value")) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))))


def _common() -> Column:
    """Sum of the smaller counts of the arrays sh and item_sh."""
    plain = "size(array_distinct(sh)) = size(sh) AND size(array_distinct(item_sh)) = size(item_sh)"
    bag = "aggregate(array_intersect(sh, item_sh), 0, (s, h) -> s + least(size(filter(sh, x -> x = h)), size(filter(item_sh, x -> x = h))))"
    return F.expr(f"IF({plain}, size(array_intersect(sh, item_sh)), {bag})")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", percent: int = 80, radius: int = 23, most_broadcast: int = 1_000_000) -> DataFrame:
    """(id, item, similarity, start_word, n_words) of every pair that reaches ``percent`` hundredths: the best
    window, the last one of equal ones."""
    docs = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key")).filter("text is not null")
    known = _shingled(items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")), "text", "item").withColumnRenamed("n", "m").withColumnRenamed("sh", "item_sh").filter("size(item_sh) > 0")
    known = cut(known.withColumn("item_print", simhash("item_sh")).withColumn("i", F.monotonically_increasing_id()))
    anchors = known.select("m", F.explode("item_sh").alias("h")).distinct()
    by_hash = anchors.groupBy("h").agg(F.collect_set("m").alias("sizes"))
    few_anchors = anchors.limit(most_broadcast + 1).count() <= most_broadcast
    few_blocks = known.limit(most_broadcast + 1).count() * (radius + 1) <= most_broadcast

    places = _shingled(docs, "text", "key").select("key", "n", F.posexplode("sh").alias("pos", "h"))
    hits = places.join(F.broadcast(by_hash) if few_anchors else by_hash, "h").select("key", "n", F.explode("sizes").alias("m"), "pos")
    found = hits.groupBy("key", "n", "m").agg(F.sort_array(F.collect_set("pos")).alias("p"))
    # least matches for the threshold: common * (100 + percent) >= percent * (both sizes)
    sized = found.withColumn("len", F.least("n", "m")).withColumn("need", F.expr(f"cast(ceil({percent} * (m + len - {2 * (K - 1)}) / {100 + percent}D) AS int)"))
    starts = F.expr(f"array_distinct(concat(filter(p, (x, i) -> x <= n - len AND get(p, i + need - 1) <= x + len - {K}), IF(get(p, size(p) - need) >= n - len, array(n - len), array())))")
    windows = sized.filter("need <= size(p)").select("key", "n", "m", "len", F.explode(starts).alias("start"))
    per_text = cut(windows.groupBy("key").agg(F.collect_list(F.struct("n", "m", "len", "start")).alias("windows")))

    texts = docs.join(per_text.select("key"), "key", "left_semi")
    cut_out = cut(
        _shingled(texts, "text", "doc", "key")
        .join(per_text, "key")
        .select("doc", "n", "sh", F.explode("windows").alias("v"))
        .filter("n = v.n")
        .select("doc", "v.m", "v.len", "v.start", F.expr(f"slice(sh, v.start + 1, v.len - {K - 1})").alias("sh"))
        .withColumn("print", simhash("sh"))
        .withColumn("w", F.monotonically_increasing_id())
    )
    repetitive = F.expr("5 * size(array_distinct(sh)) <= 4 * size(sh)")
    marked = cut_out.filter(~repetitive).select("w", "m", "print", F.explode(blocks("print", radius)).alias("b")).select("w", "m", "print", "b.block", "b.value")
    targets = known.select("i", "m", "item_print", F.explode(blocks("item_print", radius)).alias("b")).select("i", "m", "item_print", "b.block", "b.value")
    near = marked.join(F.broadcast(targets) if few_blocks else targets, ["m", "block", "value"]).filter(F.expr(f"bit_count(print ^ item_print) <= {radius}"))
    # a pair agrees in several blocks: it is taken at the first one
    edges = [round(64 * i / (radius + 1)) for i in range(radius + 2)]
    earlier = [F.when(F.col("block") > i, F.expr(f"shiftrightunsigned(print ^ item_print, {a}) & {(1 << (b - a)) - 1}L") != 0).otherwise(True) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    once = near.filter(reduce(and_, earlier)).select("w", "i")
    sharing = cut_out.filter(repetitive).select("w", "m", F.explode(F.array_distinct("sh")).alias("h")).join(known.select("i", "m", F.explode(F.array_distinct("item_sh")).alias("h")), ["m", "h"]).select("w", "i").distinct()
    pairs = once.union(sharing).join(cut_out.select("w", "doc", "start", "len", "sh"), "w").join(known.select("i", "item", "item_sh"), "i")
    exact = pairs.select("doc", "item", "start", "len", _common().alias("common"), (F.size("sh") + F.size("item_sh")).alias("total")).filter(F.col("common") * (100 + percent) >= percent * F.col("total"))
    scored = exact.withColumn("similarity", F.expr("common / cast(total - common AS double)"))
    best = scored.groupBy("doc", "item").agg(F.max(F.struct("similarity", "start", "len")).alias("top"))
    return best.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), F.col("top.similarity").alias("similarity"), F.col("top.start").cast("long").alias("start_word"), F.col("top.len").cast("long").alias("n_words"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` against whole ``benchmark``; the rows are the contaminated documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
ds AS (SELECT doc_id, len(w) AS n, i - 1 AS pos, array_to_string(w[i:i + 4], ' ') AS sh FROM d, unnest(range(1, len(w) - 3)) AS t(i)),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
bs AS (SELECT item_id, len(w) AS m, array_to_string(w[i:i + 4], ' ') AS sh FROM b, unnest(range(1, len(w) - 3)) AS t(i)),
bc AS (SELECT item_id, m, sh, count(*) AS c FROM bs GROUP BY item_id, m, sh),
starts AS (SELECT DISTINCT ds.doc_id, ds.n, bc.item_id, bc.m, least(ds.n, bc.m) AS len, least(ds.pos, ds.n - least(ds.n, bc.m)) AS s
  FROM ds JOIN bc ON ds.sh = bc.sh),
win AS (SELECT st.doc_id, st.item_id, st.m, st.len, st.s, ds.sh, count(*) AS c
  FROM starts st JOIN ds ON ds.doc_id = st.doc_id AND ds.pos BETWEEN st.s AND st.s + st.len - 5
  GROUP BY st.doc_id, st.item_id, st.m, st.len, st.s, ds.sh),
common AS (SELECT win.doc_id, win.item_id, win.m, win.len, win.s, sum(least(win.c, bc.c)) AS common
  FROM win JOIN bc ON bc.item_id = win.item_id AND bc.sh = win.sh GROUP BY ALL),
scored AS (SELECT *, common / CAST(m + len - 8 - common AS DOUBLE) AS similarity FROM common WHERE 180 * common >= 80 * (m + len - 8))
SELECT doc_id, item_id, similarity, s AS start_word, len AS n_words FROM scored
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, s DESC) = 1
"""
