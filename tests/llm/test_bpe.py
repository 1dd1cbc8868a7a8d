"""The BPE query and encoder against the tokenizers library."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fleetspark.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    out = Tokenizer.from_file(PATH)
    out.no_truncation()
    out.no_padding()
    return out


def test_query_equals_the_library(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = bpe.op8_bpe(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest())


def test_signs_of_all_planes(library):
    encoder = bpe.Encoder(bpe.Vocabulary.read(PATH))
    rare = [0x558, 0x58B, 0x208F, 0x209D, 0xA7CB, 0x1C89, 0x1DF6, 0x1E4EC, 0x898, 0x10D50, 0x2FA1D]
    for code in [*range(0x80, 0x3000, 5), *range(0x3000, 0x110000, 997), *rare]:
        if not 0xD800 <= code <= 0xDFFF:
            text = f"a{chr(code)}b ạ{chr(code)}́ {chr(code)}1"
            assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, hex(code)


def test_forgotten_words_are_encoded_again(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 2_000)
    encoder, fresh = bpe.Encoder(bpe.Vocabulary.read(PATH)), bpe.Encoder(bpe.Vocabulary.read(PATH))
    text = " ".join(f"word{i % 40}x" for i in range(400)) + " " + "y" * 1000
    assert encoder.encode(text) == b"".join(fresh.encode(w) for w in text.split())
    assert len(encoder) + len(encoder.older) < 20 and "y" * 1000 not in encoder


def test_odd_tables(spark):
    schema = "doc_id long, text string, ids string"
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, None)], schema)
    with pytest.raises(ValueError):
        bpe.encode(docs, PATH)
    got = bpe.encode(docs, PATH, ids_col="packed", decoded_col="said").collect()
    assert sorted((r.doc_id or 0, r.ids or "", len(r.packed), r.said) for r in got) == [(0, "", 0, ""), (1, "x", 8, "a</w> b</w>"), (1, "x", 8, "a</w> b</w>")]
    assert bpe.encode(docs.limit(0), PATH, ids_col="packed").isEmpty()
    assert bpe.encode(docs, PATH, ids_col="packed", keep=["doc_id"]).columns == ["doc_id", "packed"]
