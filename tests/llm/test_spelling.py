"""Spelling variants against plain versions, and edge cases."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fleetspark.llm import spelling, words
from tests.compare import connection, same

SCHEMA = "doc_id long, text string"


def one_edit(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def plain(counts, times=5):
    form, out = {}, {}
    for w, n in counts.items():
        close = [x for x in counts if x != w and one_edit(w, x)]
        best = min(close, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= times * n else None
        out[w] = len(close)
    rows = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n, out[w], counts[form[w]] if form[w] else None))
    return rows


def plain_counts(rows, least=6, often=5, damage=0):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least and n >= often}


@pytest.mark.parametrize("last", [True, False])
def test_scan_finds_all_and_only_near_words(last):
    for seed in range(300):
        r = random.Random(seed)
        m = r.choice([1, 2, 3, 5])
        listed = sorted({"".join(r.choice("abc") for _ in range(r.choice([m, m + 1]))) for _ in range(r.choice([3, 30, 80]))})
        asked = [w for w in listed if len(w) == m]
        want = {(i, j) for i, q in enumerate(asked) for j, w in enumerate(listed) if q != w and one_edit(q, w) and (last or not w.startswith(q))}
        got = list(spelling.near(asked, listed, last))
        assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("most", [2, 10, 2_000])
def test_variants_equal_the_plain_ones(spark, most):
    r = random.Random(most)
    counts = {"".join(r.choice("abé") for _ in range(r.randrange(1, 8))): r.randrange(1, 2_000) for _ in range(250)}
    counts |= {w: 10 for w in ("aaaaaa", "aaaaa", "aaaaaaa", "aaaabaa")}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = [tuple(row) for row in spelling.variants(df, most=most).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got)) and set(got) == plain(counts)


def test_words_of_texts_and_edges(spark):
    r = random.Random(3)
    base = ["Étions", "mention", "Mentions", "façade", "x" * 200, "naïveté×", "short", "entions"]
    rows = [(r.choice([None, *range(400)]), " ".join(r.choice(base) for _ in range(r.randrange(12)))) for _ in range(400)]
    rows += [(1, None), (1, ""), (2, "1,2;3"), (7, "longest " * 50_000), *rows[:5]]
    df = spark.createDataFrame([(i, t, "n", 0) for i, t in rows], SCHEMA + ", word string, n int")
    for damage in (0, 7):
        want = plain_counts(rows, damage=damage)
        assert {row.word: row.n for row in spelling.vocabulary(df.repartition(3), damage=damage).collect()} == want
        got = {tuple(row) for row in spelling.variants(spelling.vocabulary(df, damage=damage)).select("word", "form", "root", "n", "n_near", "form_n").collect()}
        assert got == plain(want)
    assert spelling.variants(spelling.vocabulary(spark.createDataFrame([], SCHEMA))).isEmpty()


def test_counts_are_handed_on_in_parts(spark, monkeypatch):
    rows = [(i, " ".join(f"word{chr(97 + i % 26)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(300))) for i in range(26)]
    monkeypatch.setattr(spelling, "HELD", 100)
    out = Counter()
    batch = pa.record_batch({"doc_id": pa.array([str(i) for i, _ in rows]), "text": pa.array([t for _, t in rows])})
    for part in spelling._counts(iter([batch.slice(k, 1) for k in range(26)]), 6, 0):
        for w, n in zip(part.column("word").to_pylist(), part.column("n").to_pylist(), strict=True):
            out[w] += n
    assert out == Counter(plain_counts(rows, often=1))


def test_checksums():
    runs = words.letter_runs(pa.array(["Hello wörld", None, "", "a" * 65 + " " + "b" * 64]))
    begun = np.array([zlib.crc32(f"{i}:".encode()) for i in range(4)], np.uint32)
    for i, c in enumerate(spelling.checksums(runs, begun).tolist()):
        assert c == zlib.crc32(runs.data[runs.starts[i] : runs.ends[i]].tobytes(), int(begun[runs.doc[i]]))


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    same(spelling.op12_spelling_variants(spark, sf), connection(sf), spelling.OP12_SQL)
