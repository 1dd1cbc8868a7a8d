"""Edge cases of sharding, licences, toxicity and quality rules, and their queries against plain versions."""

import math
import random
import textwrap
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetspark.llm import license_scan, quality_rules, sharding, toxicity
from fleetspark.llm.common import cut
from tests.llm import brute
from tests.llm.test_operators import ODD, documents

SMALL = "/root/testdata/sf0.001"


# --- sharding


def test_draws_follow_the_exact_law():
    good, rest, want = 30, 50, 20
    rng = np.random.default_rng(1)
    drawn = np.bincount([sharding.hypergeometric(good, rest, want, rng) for _ in range(20_000)], minlength=want + 1) / 20_000
    law = [math.comb(good, k) * math.comb(rest, want - k) / math.comb(good + rest, want) for k in range(want + 1)]
    assert np.abs(drawn - law).max() < 0.012
    assert [sharding.hypergeometric(5, 0, 3, rng), sharding.hypergeometric(0, 5, 3, rng), sharding.hypergeometric(4, 4, 8, rng), sharding.hypergeometric(4, 4, 0, rng)] == [3, 0, 4, 0]


def test_draws_of_any_size():
    rng = np.random.default_rng(2)
    good, rest, want = 10**13, 23 * 10**13, 6 * 10**9
    drawn = np.array([sharding.hypergeometric(good, rest, want, rng) for _ in range(300)], float)
    mean, sd = want / 24, math.sqrt(want / 24 * 23 / 24)
    assert abs(drawn.mean() - mean) < 4 * sd / math.sqrt(300) and 0.8 < drawn.std() / sd < 1.2
    matrix = sharding.communication_matrix([10**12, 3 * 10**11, 7], 5, 1)
    assert matrix.sum(axis=1).tolist() == [10**12, 3 * 10**11, 7] and np.ptp(matrix.sum(axis=0)) <= 1 and (matrix >= 0).all()


def test_sharding_query_is_gapless_and_even(spark):
    got = sharding.op2_sharding(spark, SMALL).collect()
    n = len(got)
    sizes = np.bincount([r.shard for r in got], minlength=24)
    assert sizes.tolist() == [n // 24 + (s < n % 24) for s in range(24)]
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    assert {r.grown_shard for r in got} == {None} and sorted(r.doc_id for r in got) == [r.doc_id for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id").orderBy("doc_id").collect()]


def test_sharding_of_odd_tables(spark):
    rows = documents(spark, [*ODD, *ODD, (None, None)])
    got = sharding.shuffle_into_shards(rows, ["doc_id", "text"], 4).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(s, i) for s in range(4) for i in range(5 if s < 3 else 4)]
    for name in ("shard", "_part", "ends", "before"):
        with pytest.raises(ValueError):
            sharding.shuffle_into_shards(rows.withColumn(name, F.lit(1)), ["doc_id"])


# --- licences


def test_licences_in_comments(spark):
    texts = {i: (name, known) for i, (name, known) in enumerate(license_scan.LICENSES) if name in ("MIT", "ISC") and "\n" in known}
    rows = []
    for i, (_, known) in texts.items():
        lines = ["Copyright (c) 2004 A. Holder", "All rights reserved.", "", *(x for part in known.split("\n") for x in textwrap.wrap(part, 70))]
        for j, (begin, mark, end) in enumerate((("/*\n", " * ", "\n */"), ("", "// ", ""), ("", "# ", ""), ("", ";; ", ""), ("<!--\n", "  ", "\n-->"))):
            rows.append((10 * i + j, begin + "\n".join(mark + x for x in lines) + end))
    got = {r.doc_id: r.license for r in license_scan.scan(documents(spark, rows), license_scan.catalogue(spark)).collect()}
    assert got == {i: texts[i // 10][0] for i, _ in rows}


def test_licences_of_odd_tables(spark):
    known, line = license_scan.catalogue(spark), "Released under the MIT License."
    docs = documents(spark, [(None, "a\n" + line), (1, line), (1, "b\n" + line), (2, "x " * 100_000)])
    got = license_scan.scan(docs.withColumn("known", F.lit(3)), known).collect()
    assert sorted((r.doc_id or 0, r.license or "", r.n_license_lines, r.known) for r in got) == [(0, "", 1, 3), (1, "", 2, 3), (1, "MIT", 2, 3), (2, "", 0, 3)]
    assert license_scan.scan(docs.limit(0), known).isEmpty()
    for name in ("license", "_id", "_key", "_line", "digest"):
        with pytest.raises(ValueError):
            license_scan.scan(docs.withColumn(name, F.lit(1)), known)


# --- toxicity


def plain_score(field, text):
    """A score by the recursions, token by token."""
    sentences, words = [], 0
    for line in (text or "").split("\n"):
        now = []
        for w in brute.words("".join(c.lower() if "A" <= c <= "Z" else c for c in line)):
            now.append(w)
            words += 1
            if w[-1] in ".!?" or len(now) == toxicity.LONGEST:
                sentences.append(now)
                now = []
        sentences.append(now)
    t, all_ = np.exp(field.moves), [0.0]
    for s in sentences:
        e = [math.exp(min(25, max(-25, float(field.weights[toxicity.features(w)].sum())))) for w in s]
        f = [[1.0, e[0]]] if s else []
        for x in e[1:]:
            f.append([f[-1][0] * t[0, 0] + f[-1][1] * t[1, 0], (f[-1][0] * t[0, 1] + f[-1][1] * t[1, 1]) * x])
            f[-1] = [v / sum(f[-1]) for v in f[-1]]
        b = [1.0, 1.0]
        for i in range(len(s) - 1, -1, -1):
            all_.append(f[i][1] * b[1] / (f[i][0] * b[0] + f[i][1] * b[1]))
            b = [t[0, 0] * b[0] + t[0, 1] * e[i] * b[1], t[1, 0] * b[0] + t[1, 1] * e[i] * b[1]]
            b = [v / sum(b) for v in b]
    top, mass = min(max(1e-4, *all_, 1e-4), 1 - 1e-4), sum(p for p in all_ if p > 0.3)
    x = [1.0, math.log(top / (1 - top)), math.log1p(mass), math.log1p(200 * mass / (words + 20))]
    return 1 / (1 + math.exp(-float(np.dot(x, field.blend))))


def test_toxicity_query_against_a_plain_version(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    field = toxicity.fit(docs.filter(~held), labels.filter(~held))
    got = {r.doc_id: r for r in toxicity.op4_toxicity(spark, SMALL).collect()}
    for r in docs.collect():
        score = plain_score(field, r.text) if field else 0.0
        assert got[r.doc_id].score == pytest.approx(score, abs=1e-6) and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.7)


def test_toxicity_of_odd_tables(spark):
    assert toxicity.train([" ", ""], [True, False]) is None and toxicity.train([], []) is None
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 1), (None, 1)], "doc_id long, toxic int")
    assert toxicity.fit(documents(spark, ODD[:3]), labels) is None
    field = toxicity.Field(np.zeros(1 << toxicity.FEATURE_BITS), np.zeros((2, 2)))
    docs = documents(spark, [*ODD, (None, "x"), (1, "x")]).withColumns({"score": F.lit(1), "toxic": F.lit(1)})
    assert toxicity.score(docs, field).count() == len(ODD) + 2 and toxicity.score(docs.limit(0), field).isEmpty()
    began = time.process_time()
    toxicity.Reader(field).read(pa.chunked_array([["word " * 300_000]]))
    assert time.process_time() - began < 5


def test_rare_markers_enter_the_lexicon():
    r = random.Random(3)
    plain = [f"wort{i}" for i in range(400)]
    words = [[r.choice(plain) for _ in range(40)] for _ in range(3000)]
    toxic = [i % 3 == 0 for i in range(3000)]
    for i in range(0, 3000, 3):
        words[i][r.randrange(40)] = "rarely" if i % 99 == 0 else "vile"
    field = toxicity.train([" ".join(w) for w in words], toxic)
    read = toxicity.Reader(field).read(pa.chunked_array([["wort1 rarely wort2", "wort1 wort3 wort2"]]))
    assert read[1][1] > 0.5 > read[1][[0, 2, 3, 4, 5]].max()


# --- quality rules


def test_quality_query_against_a_plain_version(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    rules = quality_rules.rules_from(cut(quality_rules.statistics(docs.select("doc_id", "text"), keep=["doc_id"])), labels)
    ratio = lambda a, b: a / b if b else 0.0
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = quality_rules.op9_quality_rules(spark, SMALL).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        n, chars, symbols, dup, again = brute.statistics(texts[r.doc_id])
        x = {"words": n, "word_length": ratio(chars, n), "symbols_per_char": ratio(symbols, chars), "symbols_per_word": ratio(symbols, n), "dup_lines_per_word": ratio(dup, n), "dup_lines": dup, "repeated": ratio(again, n)}
        failed = n < 50 or 100 * again > 50 * n
        hit = any(all(x[c] >= v if sign == ">=" else x[c] <= v for c, sign, v in rule.conditions) for rule in rules)
        assert (r.n_words, r.base_failed, r.kept) == (n, failed, not failed and not hit)


def test_quality_of_odd_tables(spark):
    docs = documents(spark, [*ODD, *ODD, (None, "a b")])
    assert quality_rules.statistics(docs.limit(0)).isEmpty()
    with pytest.raises(ValueError):
        quality_rules.statistics(docs.withColumn("n_words", F.lit(1)))
    more = quality_rules.good_only(docs.withColumns({"words": F.lit(1), "quality": F.lit(0)}), [])
    assert more.columns == ["doc_id", "text", "words", "quality"] and {r.doc_id for r in more.collect()} == set()


def test_a_list_is_applied_in_order(spark):
    rules = [quality_rules.Rule([("words", ">=", 70.0), ("dup_lines", "<=", 0.0)]), quality_rules.Rule([("words", ">=", 60.0)])]
    rows = [(i, " ".join(f"w{j}" for j in range(n))) for i, n in enumerate((55, 60, 65, 70, 90))]
    stats = cut(quality_rules.statistics(documents(spark, rows))).select("doc_id", quality_rules.decision(rules).alias("first"), quality_rules.verdict(rules).alias("kept"))
    assert [(r.first, r.kept) for r in stats.orderBy("doc_id").collect()] == [(None, True), (1, False), (1, False), (0, False), (0, False)]
