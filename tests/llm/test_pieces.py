import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from quadrat.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def check(spark, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.id: r for r in pieces.encode(df, MODEL).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = library.encode(text or "")
        assert list(got[i].ids) == ids and got[i].n_tokens == len(ids), repr(text)[:200]
        assert got[i].decoded == library.decode(ids)
        assert got[i].ids_sha256 == sha(",".join(map(str, ids))) and got[i].decoded_sha256 == sha(library.decode(ids))
    back = {r.id: r.text for r in pieces.decode(spark.createDataFrame([(i, list(r.ids)) for i, r in got.items()], "doc_id long, ids array<int>"), MODEL).collect()}
    assert back == {i: r.decoded for i, r in got.items()}


def test_separable():
    assert pieces.Codec(MODEL).separable


@pytest.mark.parametrize("separable", [True, False])
def test_either_way_is_the_librarys(separable):
    codec = pieces.Codec(MODEL)
    codec.separable = separable
    texts = ["a b", " a  ", None, "▁", "x" * 300, "\n\t é"]
    for text, (n, line, decoded) in zip(texts, codec(texts)):
        ids = codec.library.encode(text or "")
        assert (n, line, decoded) == (len(ids), ",".join(map(str, ids)), codec.library.decode(ids))


def test_edges(spark):
    rnd = random.Random(5)
    letters = " ▁\n\tab1é́ÅｆÄ😀\x00<s></s> 　​漢ß"
    texts = [None, "", " ", "  ", "▁", "a", "a" * 20_000, " " * 500, "word " * 20_000, "<s>", "﻿x"]
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(500)]
    check(spark, texts + texts[:3])


def test_small_table(spark, monkeypatch):
    codec = pieces.Codec(MODEL)
    monkeypatch.setattr(pieces, "CACHE", 3)
    texts = [f"w{i} w{i + 1} a b c d" for i in range(600)]
    for text, (n, line, _) in zip(texts, codec(texts)):
        assert line == ",".join(map(str, codec.library.encode(text)))


def test_empty(spark):
    assert pieces.encode(spark.createDataFrame([], "doc_id long, text string"), MODEL).collect() == []


def test_documents(spark, sf):
    check(spark, [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
