import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.compare import connection
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages_on_their_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    inputs = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        inputs[name] = docs.collect()
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert i == 4 or docs.columns == corpus_pipeline.COLUMNS
    inputs["end"] = docs.collect()

    kept = {r.doc_id for r in inputs["near-dedup"]}
    for r in inputs["quality rules"]:
        n, _, _, _, repeated = brute.statistics(r.text)
        if n < 50 or 100 * repeated > 50 * n:
            assert r.doc_id not in kept
    groups = brute.components([(r.doc_id, r.text) for r in inputs["near-dedup"]], 5)
    assert {r.doc_id for r in inputs["substring dedup"]} == {i for i, (_, c) in groups.items() if c == i}
    left = brute.kept_words([(r.doc_id, r.text) for r in inputs["substring dedup"]])
    before = {r.doc_id: r.text for r in inputs["substring dedup"]}
    assert {r.doc_id: r.text for r in inputs["decontamination"]} == {i: (t if m else before[i]) for i, (_, m, t) in left.items()}

    from fleetspark.llm.decontamination import OP5_SQL

    con = connection(SF)
    con.execute("DROP VIEW documents")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/2/*.parquet'")
    leaked = {r[0] for r in con.execute(f"SELECT doc_id FROM ({OP5_SQL}) x").fetchall()}
    assert {r.doc_id for r in inputs["BPE"]} == {r.doc_id for r in inputs["decontamination"]} - leaked

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in inputs["end"]:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(r.text, add_special_tokens=False).ids


def test_run_equals_the_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
    expected = sorted(docs.collect(), key=lambda r: r.doc_id)
    got = sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: r.doc_id)
    assert len(got) == len({r.doc_id for r in got}) > 0
    assert got == expected


def test_stages_of_empty_tables_and_of_null_and_repeated_ids(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = next(r.text for r in docs.orderBy("doc_id").collect() if brute.statistics(r.text)[0] > 200)
    odd = [(None, words, "en", "s", 1), (7, words + " one", "en", "s", 2), (7, words + " two", None, None, None), (8, None, None, None, None), (None, "", "en", "s", 0)]
    for rows in ([], odd):
        held = spark.createDataFrame(rows, docs.schema)
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, held, SF)
            assert i == 4 or out.columns == corpus_pipeline.COLUMNS
            out.write.parquet(f"{tmp_path}/{len(rows)}-{i}")
            held = spark.read.parquet(f"{tmp_path}/{len(rows)}-{i}")
            assert {(r.doc_id, r.lang) for r in held.collect()} <= {(number, lang) for number, _, lang, _, _ in rows}


def test_decontamination_of_documents_without_an_id(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(None, "before " + item + " after", "en", "s", 1), (None, "a clean text that is kept", "en", "s", 2), (7, item, "en", "s", 3), (7, "clean", None, None, None), (8, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.decontaminate(spark, docs, SF).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, "a clean text that is kept"), (7, "clean"), (8, "")]
