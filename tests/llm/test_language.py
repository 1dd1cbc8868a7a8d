"""The language network: gradients, stretches, edge cases, held-out accuracy, the query against a plain reading."""

import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetspark.llm import language_id
from tests.llm.test_operators import ODD, documents

SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def plain(net, text):
    """The mean label of all bytes, stretch by stretch, by the recurrence that training uses."""
    data = np.frombuffer(text.lower().encode() if text.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode(), np.uint8)
    total = np.zeros(len(net.languages))
    for a in range(0, len(data), language_id.CORE):
        b = min(a + language_id.CORE, len(data))
        low, high = max(0, a - language_id.AROUND), min(len(data), b + language_id.AROUND)
        x, alive = data[low:high, None], np.ones(high - low, int)
        score = np.concatenate([net.states(x, alive, 0), net.states(x, alive, 1)], axis=2)[:, 0] @ net.out + net.bias
        p = np.exp(score - score.max(axis=1, keepdims=True))
        total += (p / p.sum(axis=1, keepdims=True))[a - low : b - low].sum(axis=0)
    return total / max(1, len(data))


def test_held_out_accuracy(spark):
    got = language_id.op6_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97


def test_query_equals_a_plain_reading(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    net = language_id.fit(docs.filter(~held))
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = language_id.op6_language_id(spark, SMALL).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        p = plain(net, texts[r.doc_id] or "")
        if r.lang_pred != "und":
            assert r.score == pytest.approx(p.max(), abs=1e-4) and p[net.languages.index(r.lang_pred)] > p.max() - 1e-4


def test_odd_texts(spark):
    net = language_id.train(["la casa de la ñ", "the house of the"] * 5, ["es", "en"] * 5, epochs=1)
    odd = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(documents(spark, [*ODD, (10, "12 34 !!")]), net).collect()}
    assert all(odd[i] == ("und", 0.0) for i in (1, 2, 3, 10)) and 0 < odd[8][1] <= 1 and odd[5] == odd[6]
    docs = documents(spark).withColumns({"lang_pred": F.lit(1), "r": F.lit(2), "piece": F.lit("x"), "lang": F.lit("en")})
    assert language_id.identify(docs.limit(0), net).isEmpty() and language_id.identify(docs, net).count() == len(ODD)
    assert language_id.fit(docs).languages == ["en"]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_id.fit(empty) is None
    assert {r.lang_pred for r in language_id.identify(documents(spark), None).collect()} == {"und"}


def test_the_sample_is_bounded(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 200).alias("text"), F.when(F.col("id") % 100 == 0, "rare").otherwise("much").alias("lang"))
    got = language_id.sample(docs, "doc_id", "text", "lang", 40, 90).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in got} == {"much": 90, "rare": 90}
    same = docs.withColumn("doc_id", F.lit(7))  # one id for all rows
    assert language_id.sample(same, "doc_id", "text", "lang", 40, 90).count() <= 180


def test_scripts_without_spaces():
    r = random.Random(4)
    letters = {"ja": (0x3041, 0x3096), "th": (0x0E01, 0x0E2E), "zh": (0x4E00, 0x6E00), "en": (97, 122)}
    text = lambda k: "".join(chr(r.randint(*letters[k])) + (" " if k == "en" and r.random() < 0.2 else "") for _ in range(300))
    known, asked = [k for k in letters for _ in range(30)], [k for k in letters for _ in range(10)]
    net = language_id.train([text(k) for k in known], known)
    names, score = language_id.predict(net, pa.array([text(k) for k in asked]))
    assert names == asked and score.min() > 0.9
    began = time.process_time()
    language_id.predict(net, pa.array(["x" * 400_000]))
    assert time.process_time() - began < 4


def test_context_crosses_spaces():
    # "a" is told only by the word before it
    r = random.Random(1)
    texts = [" ".join(r.choice(["kk a", "kk a a"]) for _ in range(40)) for _ in range(20)] + [" ".join(r.choice(["zz a", "zz a a"]) for _ in range(40)) for _ in range(20)]
    net = language_id.train(texts, ["k"] * 20 + ["z"] * 20, epochs=20)
    data = np.frombuffer(b"zz a a zz a a zz a a", np.uint8)
    p = net.labels(data[:, None].astype(np.intp), np.ones(len(data), int))[net.languages.index("z"), :, 0]
    assert p[data == ord("a")].min() > 0.8


def test_stretches_cover_every_byte_once():
    offsets = np.array([0, 0, 5, 505, 508])
    cut = language_id.Stretches.of(offsets, 40, 8)
    own = np.zeros(508, int)
    for d, a, b, lead, n in zip(cut.doc, cut.start, cut.stop, cut.lead, cut.own, strict=True):
        assert offsets[d] <= a <= a + lead and a + lead + n <= b <= offsets[d + 1]
        own[a + lead : a + lead + n] += 1
    assert (own == 1).all() and (np.diff(cut.stop - cut.start) <= 0).all()


def test_network_gradients():
    net = language_id.Network.fresh(["a", "b"], 3, 1)
    net.tables, net.loops, net.out = [t.astype(float) for t in net.tables], [t.astype(float) for t in net.loops], net.out.astype(float)
    cut = language_id.Stretches.of(np.array([0, 5, 9, 11]), 64, 0)
    x, alive = cut.matrix(np.frombuffer(b" abc  de  f", np.uint8), slice(None))
    target = np.array([0, 1, 0])
    _, grads = net.gradients(x, alive, target)
    for k, at in ((0, (97, 1)), (2, (0, 4)), (3, (1, 7)), (4, (2, 1))):
        w, old = net.weights()[k], net.weights()[k][at]
        sides = []
        for d in (1e-4, -1e-4):
            w[at] = old + d
            sides.append(net.gradients(x, alive, target)[0])
        w[at] = old
        assert (sides[0] - sides[1]) / 2e-4 == pytest.approx(grads[k][at], abs=2e-5)
