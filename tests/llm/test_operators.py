import random
import re
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetspark.llm import bpe, decontamination, known_licenses, license_scan, minhash, quality_rules, queries, sharding, substring_dedup, toxicity, url_filters
from fleetspark.llm.graph import components
from tests.compare import connection, same
from tests.llm import brute

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "x"), (5, "a b c d e f g h i j k l m n o p"), (6, "a b c d e f g h i j k l m n o p"), (7, "Ünï ☃ " * 400), (8, "word " * 30_000), (9, "q a b c d e f g h i j k l m z a b c d e")]


def documents(spark, rows=ODD):
    return spark.createDataFrame(rows, "doc_id long, text string")


def corpus(seed, n=60):
    """Texts with copies, near copies and shared passages."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [r.choice(vocabulary) for _ in range(40)]
    texts = [[r.choice(vocabulary) for _ in range(r.randint(0, 120))] for _ in range(n)]
    for i in range(10, n):
        kind = r.random()
        if kind < 0.2:
            texts[i] = list(texts[r.randrange(10)])
        elif kind < 0.5:
            texts[i] = [x if r.random() > 0.03 else r.choice(vocabulary) for x in texts[r.randrange(10)]]
        elif kind < 0.7:
            texts[i] = texts[i][:30] + passage + texts[i][30:]
    return [(i * 3, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(queries.queries()[name](spark, SF), connection(SF), queries.oracle_sql()[name])


@pytest.mark.parametrize("rows", [ODD, corpus(1), corpus(2, 90)])
def test_near_duplicates(spark, rows):
    expected = brute.components(rows, 4)
    for k, plan in ((4, expected), (5, brute.components(rows, 5))):
        got = minhash.near_duplicates(documents(spark, rows), k=k).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plan
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_a_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = minhash.op7_minhash_dedup(spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.components(rows, 4)


def test_signatures_estimate_similarity():
    a, b = np.arange(1000, dtype=np.uint64), np.arange(200, 1200, dtype=np.uint64)
    doc, hashed = np.repeat([0, 1], 1000), minhash.mix(np.concatenate([a, b]))
    sig = minhash.signatures(doc, hashed, 2, 512)
    assert abs((sig[0] == sig[1]).mean() - 800 / 1200) < 0.08
    # each shingle of a small document takes every slot once
    one = minhash.signatures(np.zeros(1, np.int64), np.array([7], np.uint64), 1, 64)
    assert sorted((one[0] >> np.uint64(32)).tolist()) == list(range(64))


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


@pytest.mark.parametrize("rows", [ODD, corpus(3), corpus(4, 90)])
def test_substring_dedup(spark, rows):
    got = substring_dedup.remove_repeats(documents(spark, rows), chunk_bytes=2000, bucket_bytes=500).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == brute.kept_words(rows)
    for r in got:
        assert sum(s.length for s in r.removed_spans) == r.n_removed


def test_substring_dedup_of_a_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = substring_dedup.op10_substring_dedup(spark, SF).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == {i: (n, m, brute.sha(t)) for i, (n, m, t) in brute.kept_words(rows).items()}


def test_substring_dedup_keeps_columns_and_names_clashes(spark):
    docs = documents(spark).withColumn("kept_text", F.lit(1))
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(docs)
    assert "kept_text" in substring_dedup.remove_repeats(docs, added=substring_dedup.ADDED | {"kept_text": "left"}).columns


def test_bpe_equals_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    r = random.Random(5)
    vocabulary = bpe.Vocabulary.read(path)
    odd = ["Don't STOP 123 ###'s", "<|startoftext|>a <|endoftext|>", "ΑΣ İstanbul é é", "a\x1cb\u0085c d", "ﬁ ①② Ⅷ"]
    made = ["".join(r.choice(vocabulary.tokens[512:49000]).replace("</w>", "") for _ in range(4)) for _ in range(300)]
    letters = ["".join(r.choice("abcdeéstinorlghßç' .,1#") for _ in range(r.randint(1, 40))) for _ in range(300)]
    rows = list(enumerate([None, "", " \n", "ha" * 20_000, *odd, *made, *letters]))
    got = bpe.decode(bpe.encode(documents(spark, rows), path), path).collect()
    for x in got:
        ids = library.encode(x.text or "", add_special_tokens=False).ids
        assert np.frombuffer(x.ids, "<u4").tolist() == ids
        assert x.decoded == library.decode(ids, skip_special_tokens=False)


def test_statistics(spark):
    rows = ODD + corpus(6, 20) + [(500, "a b c a b c\n\nline|x\nline|x\n#"), (501, "\n\n")]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    got = quality_rules.statistics(documents(spark, rows)).collect()
    assert {r.doc_id: tuple(r[c] for c in quality_rules.STATISTICS) for r in got} == {i: brute.statistics(t) for i, t in rows}


def test_rules_are_learned(spark):
    got = quality_rules.op9_quality_rules(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    rows = got.filter("not base_failed and quality is not null").select("kept", "quality").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in rows]) > 0.95
    none = quality_rules.rules_from(quality_rules.statistics(documents(spark)), spark.createDataFrame([], "doc_id long, quality int"))
    assert none == []


def test_sharding(spark):
    rows = spark.range(1000).select(F.col("id").alias("k"))
    got = sharding.shuffle_into_shards(rows, ["k"], 24, rows_per_partition=100).collect()
    sizes = np.bincount([r.shard for r in got], minlength=24)
    assert sizes.max() - sizes.min() <= 1 and sorted(r.k for r in got) == list(range(1000))
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    again = sharding.shuffle_into_shards(rows.repartition(7), ["k"], 24, rows_per_partition=100).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert sharding.shuffle_into_shards(rows.limit(0), ["k"]).isEmpty()


def test_sharding_is_uniform():
    total = sum(sharding.communication_matrix([30, 50, 20], 5, seed) for seed in range(400)) / 400
    assert np.abs(total - np.array([[6.0], [10.0], [4.0]])).max() < 0.4
    big = sharding.communication_matrix([2_000_000_000, 1_000_000_000], 7, 1)
    assert big.sum(axis=1).tolist() == [2_000_000_000, 1_000_000_000] and np.ptp(big.sum(axis=0)) <= 1 and (big >= 0).all()


def test_sharding_of_a_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in sharding.op2_sharding(spark, SF).collect():
        assert (r.size, r.text_crc32, r.law) == (len(texts[r.doc_id].encode()) + 8, zlib.crc32(texts[r.doc_id].encode()), "rows")


def test_url_filters_over_time(spark):
    log = spark.createDataFrame(
        [("l", "host", "a.b.c", "add", 10), ("l", "host", "a.b.c", "remove", 20), ("l", "host", "a.b.c", "add", 20), ("m", "domain", "b.c", "add", 15), ("m", "domain", "b.c", "remove", 30), ("m", "url", None, "add", 1)],
        "list string, kind string, rule string, action string, published int",
    )
    captures = spark.createDataFrame([(1, "http://A.b.c/x", 5), (2, "http://a.b.c/x", 12), (3, "https://a.b.c:8/#f", 25), (4, "https://z.b.c", 30), (5, None, 12), (6, "nothing", 12), (7, "http://a.b.c", None)], "id int, url string, fetched_at int")
    got = {r.id: (r.n_entries, r.lists, r.blocked) for r in url_filters.filter_urls(captures, log, "id").collect()}
    assert got == {1: (0, "", False), 2: (1, "l", True), 3: (2, "l,m", True), 4: (0, "", False), 5: (0, "", False), 6: (0, "", False), 7: (0, "", False)}


def test_licences(spark):
    mit = license_scan.LICENSES[1][1]
    rows = [(1, mit), (2, "Copyright (c) 1999 Me\n" + mit.upper().replace(",", " ;")), (3, mit + " extra"), (4, None), (5, "???"), (6, "a\nreleased under the mit licence!\nb"), (7, "(c) me\ncopyright you")]
    got = {r.doc_id: (r.license, r.n_license_lines) for r in license_scan.scan(documents(spark, rows), license_scan.catalogue(spark)).collect()}
    assert got == {1: ("MIT", 0), 2: ("MIT", 0), 3: (None, 0), 4: (None, 0), 5: (None, 0), 6: (None, 1), 7: (None, 0)}


def test_licences_as_published(spark):
    texts = {i: known for i, (name, known) in enumerate(license_scan.LICENSES) if name in ("MIT", "ISC", "0BSD") and "\n" in known}
    rows = [(1000 * i + width, "Copyright (c) 2004-2010 by A. Holder\nAll rights reserved.\n\n" + "\n".join(textwrap.fill(part, width) for part in known.split("\n"))) for i, known in texts.items() for width in range(20, 100)]
    got = {r.doc_id: r.license for r in license_scan.scan(documents(spark, rows), license_scan.catalogue(spark)).collect()}
    assert got == {i: license_scan.LICENSES[i // 1000][0] for i, _ in rows}
    lines = ["Copyright 2020 Me", "copyright (c) Me", "(C) 1999", "© Me", "Copyright © Me", "Copyright The Authors", "(c) me"]
    kept = ["copyright notice and this", "copyright holders be liable", "copyright", "copyright, patent", "copyright the software", "copyrighted works", "(c) You must retain"]
    rows = [(i, t) for i, t in enumerate(lines + kept)]
    assert [r.digest is None for r in license_scan.scan(documents(spark, rows), license_scan.catalogue(spark)).orderBy("doc_id").collect()] == [True] * len(lines) + [False] * len(kept)


def test_licences_in_usual_layouts(spark):
    mit = license_scan.LICENSES[0][1]
    heads = ["The MIT License\n\n", "(The MIT License)\r\n\r\n", "Portions Copyright (c) 2001 Some One\n", "Copyright (C) 2020 by\n Foo Bar\n", "Copyright (c) 2010, 2011,\n 2012 Foo\n", " * Copyright 2020 by \r\n * Foo Bar\r\n * ", "Copyright (c) 2020 A and\nB and\nC\n", "Copyright (c) Ruby\n"]
    rows = list(enumerate(head + mit for head in heads))
    rows += [(100, "Copyright 2020 by\n\n" + mit), (101, "Portions of this\n" + mit), (102, "Copyright 2020 Foo,\n" + mit)]
    got = {r.doc_id: r.license for r in license_scan.scan(documents(spark, rows), license_scan.catalogue(spark)).collect()}
    assert got == {i: "MIT" for i in range(len(heads))} | {100: "MIT", 101: None, 102: "MIT"}


def test_spdx_expressions(spark):
    lines = {
        "SPDX-License-Identifier: MIT OR Apache-2.0": (2, "Apache-2.0,MIT"),
        "// SPDX-License-Identifier: GPL-2.0-or-later WITH Linux-syscall-note": (1, "GPL-2.0"),
        "/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR BSD-3-Clause */": (2, "BSD-3-Clause,GPL-2.0"),
        "# SPDX-License-Identifier: (MIT AND (ISC OR MIT))": (2, "ISC,MIT"),
        "SPDX-License-Identifier: MIT\r": (1, "MIT"),
        "SPDX-License-Identifier: No-Such OR MIT": (1, "MIT"),
        "SPDX-License-Identifier: ()": (0, ""),
        "see SPDX-License-Identifier: MIT OR ISC": (0, ""),
        "SPDX-License-Identifier: MIT OR " + "ISC " * 20_000: (2, "ISC,MIT"),
    }
    rows = [(i, "text\n" + line) for i, line in enumerate(lines)]
    got = license_scan.scan(documents(spark, rows), license_scan.catalogue(spark)).orderBy("doc_id").collect()
    assert [(r.n_license_lines, r.line_licenses) for r in got] == list(lines.values())


def test_licences_of_the_catalogue(spark):
    def wrap(text, width):
        return "\n\n".join(p if "(c)" in p.lower() or "copyright [" in p.lower() or "©" in p else textwrap.fill(" ".join(p.split()), width, break_on_hyphens=False, break_long_words=False) for p in re.split(r"\n[ \t]*\n", text))

    known = known_licenses.texts()
    rows = [(1000 * i + width, wrap(text, width)) for i, (_, text) in enumerate(known) for width in (40, 66, 75, 400)]
    got = {r.doc_id: r.license for r in license_scan.scan(documents(spark, rows), license_scan.catalogue(spark)).collect()}
    assert {i: (known[i // 1000][0], v) for i, v in got.items() if v != known[i // 1000][0]} == {}
    assert {name for name, _ in known} >= {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense", "BSL-1.0", "Zlib"}
    lines = {"# SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause", "Licensed under CC BY 4.0.": "CC-BY-4.0", "SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0", "This software is released under the BSD 3-Clause License.": "BSD-3-Clause"}
    rows = [(i, "text\n" + line) for i, line in enumerate(lines)]
    got = license_scan.scan(documents(spark, rows), license_scan.catalogue(spark)).orderBy("doc_id").collect()
    assert [r.line_licenses for r in got] == list(lines.values())


def test_contamination(spark):
    r = random.Random(8)
    item = [r.choice("abcdefghij") * r.randint(1, 4) + str(i) for i in range(40)]
    noise = [f"n{i}" for i in range(200)]
    edited = [w if i != 20 else "changed" for i, w in enumerate(item)]
    rows = [(1, " ".join(noise[:50] + item + noise[50:])), (2, ", ".join(item).upper()), (3, " ".join(noise + edited)), (4, " ".join(item[:20] + noise)), (5, None), (6, ""), (7, " ".join(item[:38]))]
    items = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "too short")], "item_id long, text string")
    for most in (1_000_000, 1):
        got = {r.doc_id: (r.similarity, r.start_word) for r in decontamination.contaminated(documents(spark, rows), items, percent=70, most_broadcast=most).collect()}
        assert got == {1: (1.0, 50), 2: (1.0, 0), 3: (31 / 41, 200), 7: (34 / 36, 0)}
    assert decontamination.contaminated(documents(spark, rows), items.limit(0)).isEmpty()


def test_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    got = toxicity.op4_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    bad, clean = [r.score for r in got if r.toxic == 1], [r.score for r in got if r.toxic == 0]
    assert np.mean([b > c for b in bad for c in clean]) > 0.9
    assert np.mean([c >= 0.7 for c in clean]) < 0.03
    assert toxicity.train(["a b"], [False]) is None


def test_marginals_by_enumeration():
    field = toxicity.Field(np.zeros(1), np.array([[0.3, -0.2], [0.1, 0.7]]))
    odds = np.array([0.5, 2.0, 1.5, 0.2, 3.0])
    got = field.marginals(odds, np.array([0, 3]), np.array([3, 2]))
    for first, size in ((0, 3), (3, 2)):
        weight = np.zeros(size)
        total = 0.0
        for code in range(1 << size):
            y = [code >> i & 1 for i in range(size)]
            w = np.prod([odds[first + i] ** y[i] for i in range(size)]) * np.exp(sum(field.moves[y[i], y[i + 1]] for i in range(size - 1)))
            total += w
            weight += w * np.array(y)
        assert got[first : first + size] == pytest.approx(weight / total)


def test_toxic_spans(spark):
    r = random.Random(2)
    plain = [f"wort{i}" for i in range(100)] + ["é", "so", "really", "word", "ünï", "☃"] * 10
    words = [[r.choice(plain) for _ in range(30)] for _ in range(300)]
    toxic = [i % 3 == 0 for i in range(300)]
    for w, bad in zip(words, toxic, strict=True):
        if bad:
            w[r.randrange(30)] = "vile"
    texts = [" ".join(w) for w in words]
    field = toxicity.train(texts, toxic)
    got = {r.doc_id: r for r in toxicity.score(documents(spark, [*ODD, (20, "é so VILE, really")]), field).collect()}
    assert [(s.start, s.stop) for s in got[20].spans] == [(5, 10)] and got[20].score > 0.5
    assert got[1].score == got[2].score == got[3].score < 0.5 and got[8].spans == []
