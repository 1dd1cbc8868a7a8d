"""Edge cases of benchmark decontamination, and its recall against every window."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fleetspark.llm import decontamination

SCHEMA = "doc_id long, text string"
ITEMS = "item_id long, text string"


def shingles(words):
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(docs, items, percent=80):
    """{(doc, item): best similarity} over all windows."""
    out = {}
    for d, text in docs:
        w = (text or "").split()
        for i, item in items:
            v = (item or "").split()
            bag, n = shingles(v), min(len(v), len(w))
            for a in range(len(w) - n + 1):
                own = shingles(w[a : a + n])
                both, all_ = sum((own & bag).values()), sum((own | bag).values())
                if all_ and 100 * both >= percent * all_:
                    out[d, i] = max(out.get((d, i), 0), both / all_)
    return out


def test_recall_against_all_windows(spark):
    r = random.Random(3)
    noise = lambda n: [f"n{r.randrange(400)}" for _ in range(n)]
    items = [(i, " ".join(noise(r.randint(20, 60)))) for i in range(12)]
    docs = []
    for d in range(80):
        words = items[d % 12][1].split()
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            words[r.randrange(len(words))] = "changed"
        if r.random() < 0.3:
            words.insert(r.randrange(len(words)), "more")
        docs.append((d, " ".join(noise(r.randint(0, 40)) + words + noise(r.randint(0, 40)))))
    got = decontamination.contaminated(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEMS)).collect()
    expected = brute(docs, items)
    assert len(expected) > 40
    assert {(g.doc_id, g.item_id): pytest.approx(g.similarity) for g in got} == expected


def test_repetitive_bags(spark):
    a, b = "p q r s t".split(), "u v w x y".split()
    items = [(1, " ".join(a * 5 + b * 4)), (2, " ".join(["z"] * 30))]
    docs = [(1, " ".join(a * 4 + b * 5)), (2, " ".join(["z"] * 31)), (3, " ".join(["z"] * 26)), (4, " ".join(a * 2))]
    got = decontamination.contaminated(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEMS), percent=70).collect()
    assert {(g.doc_id, g.item_id): pytest.approx(g.similarity) for g in got} == brute(docs, items, 70)


def test_null_and_repeated_ids(spark):
    item = " ".join(f"w{i}" for i in range(30))
    rows = [(None, "a " + item, 1), (None, "nothing here to be found", 2), (5, item, 3), (5, "x", 4), (6, None, 5), (7, "", 6)]
    docs = spark.createDataFrame(rows, SCHEMA + ", item_id long").withColumns({"key": F.lit(1), "m": F.lit(2)})
    items = spark.createDataFrame([(1, item), (1, item), (None, item)], ITEMS)
    got = decontamination.contaminated(docs, items).collect()
    assert sorted((g.doc_id or 0, g.item_id or 0, g.similarity, g.start_word) for g in got) == [(0, 0, 1.0, 1), (0, 1, 1.0, 1), (5, 0, 1.0, 0), (5, 1, 1.0, 0)]
    assert decontamination.contaminated(docs.limit(0), items).isEmpty()


def test_fingerprints_of_very_long_windows(spark):
    # 70,000 shingles of one hash: every bit is that of the hash
    got = spark.range(1).select(F.array_repeat(F.lit(0x5A5A5A5A5A5A5A5A), 70_000).alias("sh")).select(decontamination.simhash("sh").alias("p")).first().p
    assert got == 0x5A5A5A5A5A5A5A5A
