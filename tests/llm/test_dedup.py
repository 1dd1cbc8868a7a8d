"""Edge cases of near and substring deduplication."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetspark.llm import minhash, substring_dedup, tiles, words
from tests.llm import brute

TURNS = "a"
for _ in range(10):
    TURNS += TURNS.translate({97: "b", 98: "a"})
OTHER = TURNS.translate({97: "b", 98: "a"})
SCHEMA = "doc_id long, text string"


def spread(seed, n):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(10_000)}" for _ in range(n))


def test_word_hashes_are_not_polynomials():
    texts = [f"{TURNS} {OTHER} {TURNS[:8]} {OTHER[:8]} {TURNS[:16]} {OTHER[:16]}", "x" * 64, "x" * 65, "x" * 100_000 + "y", "x" * 100_000 + "z"]
    w = words.words_of(pa.array(texts))
    for family in (0, 1):
        assert len(set(w.hashes(family).tolist())) == len(w.starts)
    assert not set(w.hashes(0).tolist()) & set(w.hashes(1).tolist())
    # equal words have equal hashes wherever they stand
    again = words.words_of(pa.array(["q " + t for t in texts]))
    assert set(w.hashes().tolist()) <= set(again.hashes().tolist())


def test_hashes_of_look_alike_words(spark):
    rows = [(1, " ".join([TURNS] * 13)), (2, " ".join([OTHER] * 13)), (3, " ".join([TURNS] * 13))]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs).collect()} == {1: 0, 2: 0, 3: 13}
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1}


def test_each_text_of_a_repeated_id_keeps_its_links(spark):
    a, b = spread(1, 30), spread(2, 30)
    rows = [(1, a), (1, b), (2, a), (3, b.rsplit(" ", 1)[0]), (4, spread(3, 30)), (None, a), (None, None), (4, None), (1, a)]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), k=4).collect())
    assert got == sorted([(1, 27, 1), (1, 27, 1), (1, 27, 1), (2, 27, 1), (3, 26, 1), (4, 27, 4), (4, 0, 4), (0, 27, None), (0, 0, None)], key=lambda r: (r[0], r[1]))


def test_near_duplicates_of_nothing_and_other_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert minhash.near_duplicates(empty).isEmpty()
    docs = spark.createDataFrame([(1, spread(1, 20), 5), (2, spread(1, 20), 6)], SCHEMA + ", component_id long")
    assert {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()} == {(1, 1, True), (2, 1, False)}


def test_signatures_in_blocks_of_shingles():
    r = np.random.default_rng(1)
    doc = np.repeat(np.arange(400), r.integers(1, minhash.SMALL, 400))
    hashed = r.integers(0, 1 << 63, len(doc)).astype(np.uint64)
    whole = minhash.signatures(doc, hashed, 400, 128)
    one = np.concatenate([minhash.signatures(np.zeros((doc == d).sum(), np.int64), hashed[doc == d], 1, 128) for d in range(400)])
    assert (whole == one).all() and len(doc) > minhash.TABLE


def test_substring_dedup_of_odd_tables(spark):
    text = spread(5, 40)
    assert substring_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).isEmpty()
    rows = [(7, text), (7, text), (None, text), (9, "q " + text), (3, None), (3, "")]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 40, 0), (3, 0, 0), (3, 0, 0), (7, 40, 0), (7, 40, 0), (9, 41, 40)]


def test_substring_dedup_names_a_changed_order(spark):
    texts = substring_dedup.pa.table({"chunk": pa.array([], pa.int64()), "rows": pa.array([], pa.binary())})
    with pytest.raises(RuntimeError, match="another order"):
        substring_dedup._applied(texts, texts, "doc_id", "text", 13, {})


def test_query_against_brute_force_with_long_words(spark):
    rows = [(i, f"{'x' * 300}{i % 3} " + spread(i % 4, 60)) for i in range(12)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(docs).collect()} == brute.kept_words(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs.withColumn("z", F.lit(1)), k=4).collect()} == brute.components(rows, 4)


def test_crowded_buckets_lose_no_link(spark):
    r = random.Random(11)
    stem = [f"s{j}" for j in range(60)]
    rows = []
    for i in range(120):  # most are a little less alike than a link asks
        w = list(stem)
        at = r.randrange(60)
        w[at : at + r.choice([1, 2, 6, 9, 12])] = [f"v{r.randrange(40)}" for _ in range(r.randrange(1, 9))]
        rows.append((i, " ".join(w)))
    want = brute.components(rows, 4)
    assert 5 < len({c for _, c in want.values()}) < 115
    # few bands of one slot put nearly all in the same buckets
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), k=4, bands=16, rows=1, star_rounds=1)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got.collect()} == want


def nodes_of(spark, sets):
    rows = []
    for n, held in sets.items():
        hashed = np.array(sorted(held), np.int64).view(np.uint64)
        rows.append((n, len(held), len(held), bytearray(tiles.bitmaps(np.zeros(len(held), np.int64), hashed, 1)[0].as_py())))
    return spark.createDataFrame(rows, "node long, n int, held int, bits binary")


@pytest.mark.parametrize("percent", [80, 60])
@pytest.mark.parametrize("tile", [7, 1_024])
def test_tiles_lose_no_link(spark, percent, tile, monkeypatch):
    monkeypatch.setattr(tiles, "TILE", tile)
    draw = random.Random(percent)
    hub = set(range(60))
    sets = {0: hub}
    for node in range(1, 150):
        mine = sets[draw.randrange(node)]
        kept = draw.sample(sorted(mine), len(mine) - draw.randint(0, 7))
        sets[node] = set(kept) | {draw.randint(100, 160) for _ in range(draw.randint(0, 7))}
    linked = lambda a, b: 100 * len(a & b) >= percent * len(a | b)
    component = {n: 0 if linked(s, hub) else n for n, s in sets.items()}
    members = spark.createDataFrame([(5, n, component[n], 0) for n in sets], "token long, node long, component long, main long")
    got = {tuple(r) for r in tiles.tiles(members, nodes_of(spark, sets), percent).collect()}
    links = {(a, b) for a in sets for b in range(a + 1, 150) if component[a] != component[b] and linked(sets[a], sets[b])}
    assert links and links <= got


def test_a_crowd_around_a_hub_makes_few_pairs(spark):
    hub = list(range(147))
    sets = {0: hub} | {n: hub[n % 7 + 20 :] + list(range(1000 * n, 1000 * n + 20 + n % 7)) for n in range(1, 400)}
    members = spark.createDataFrame([(1, n, n, 0) for n in sets], "token long, node long, component long, main long")
    found = tiles.tiles(members, nodes_of(spark, sets), 80).count()
    assert found < 400  # of 79,800


def test_templates_make_few_pairs(spark, monkeypatch):
    r = random.Random(1)
    rows = []
    for i in range(600):
        w = [f"f{j}" for j in range(100)]
        for slot in range(5):
            w[10 + 18 * slot] = f"v{slot}x{r.randrange(60)}"
        rows.append((i, " ".join(w)))
    met, verified = [], minhash._verified
    monkeypatch.setattr(minhash, "_verified", lambda pairs, *a: (met.append(pairs.count()), verified(pairs, *a))[1])
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute.components(rows, 5)
    assert met[-1] < 300  # of 179,700
