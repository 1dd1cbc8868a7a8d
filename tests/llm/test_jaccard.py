"""The similarity join against a plain one, crowded lists and edge cases."""

import random

import numpy as np
import pytest

from fleetspark.llm import jaccard_join as jj
from fleetspark.llm import tiles
from tests.compare import connection, same
from tests.llm import brute

SCHEMA = "doc_id long, text string"


def table(seed, n=160):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(400)}"
    bases = [[word() for _ in range(r.choice([4, 12, 40, 150]))] for _ in range(12)]
    passage = [word() for _ in range(30)]
    rows = []
    for i in range(n):
        text = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
            if text:
                at = r.randrange(len(text))
                text[at : at + r.choice([0, 1])] = [word()] * r.choice([0, 1])
        if r.random() < 0.2:
            text += passage
        rows.append((i, " ".join(text) if r.random() > 0.05 else r.choice([None, "", " \n", "One two", "one TWO", "x"])))
    r.shuffle(rows)
    return rows


def components(df):
    return {x.doc_id: (x.n_shingles, x.component_id) for x in df.collect()}


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("hub_rounds", [1, 3])
def test_equals_the_plain_join(spark, seed, hub_rounds):
    rows = table(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert components(jj.jaccard_join(df, hub_rounds=hub_rounds, chunk_bytes=4_000, bucket_bytes=8_000)) == brute.components(rows, 5)


def templates(n, seed=1):
    r = random.Random(seed)
    frame = [f"f{i}" for i in range(100)]
    rows = []
    for i in range(n):
        text = list(frame)
        for slot in range(5):
            text[10 + 18 * slot] = f"v{slot}x{r.randrange(60)}"
        rows.append((i, " ".join(text)))
    return rows


def test_templates_in_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(tiles, "TILE", 7)
    rows = templates(300)
    assert components(jj.jaccard_join(spark.createDataFrame(rows, SCHEMA), hub_rounds=1)) == brute.components(rows, 5)


def test_bitmaps_leave_few_pairs_of_templates(spark):
    rows = templates(1_000)
    counted = []
    linked = jj._linked

    def spy(pairs, nodes, percent):
        counted.append(pairs.count())
        return linked(pairs, nodes, percent)

    jj._linked = spy
    try:
        got = components(jj.jaccard_join(spark.createDataFrame(rows, SCHEMA)))
    finally:
        jj._linked = linked
    assert got == brute.components(rows, 5)
    assert counted[-1] < 500  # of 499,500


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    text = " ".join(f"t{i}" for i in range(30))
    rows = [(1, long), (2, long + " end"), (3, text), (3, "b c d e f g"), (4, text.upper()), (5, "b c d e f g"), (None, text), (None, None), (6, None), (7, ""), (8, "b c"), (9, "B  c"), (9, "B  c")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], SCHEMA + ", node int, component_id int")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jj.jaccard_join(df).collect())
    assert got == sorted([(1, 59_996, 1), (2, 59_997, 1), (3, 26, 3), (3, 2, 3), (4, 26, 3), (5, 2, 3), (0, 26, 0), (0, 0, 0), (6, 0, 6), (7, 0, 7), (8, 1, 8), (9, 1, 8), (9, 1, 8)])
    assert jj.jaccard_join(spark.createDataFrame([], SCHEMA)).isEmpty()


def test_bitmaps_bound_from_above():
    r = np.random.default_rng(1)
    for most in (60, 3_000):
        for _ in range(200):
            a = set(r.integers(0, most, r.integers(1, most)).tolist())
            b = set(list(a)[: r.integers(0, len(a) + 1)]) | set(r.integers(0, most, r.integers(1, 20)).tolist())
            bits = [np.frombuffer(tiles.bitmaps(np.zeros(len(s), np.int64), np.array(sorted(s), np.uint64), 1)[0].as_py(), np.uint64) for s in (a, b)]
            shared = len(a & b)
            if 100 * shared >= 80 * (len(a) + len(b) - shared):
                assert tiles.bounded(*bits, (len(a), len(b)), (len(a), len(b)), 80)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    same(jj.op11_jaccard_join(spark, sf), connection(sf), jj.OP11_SQL)
