import os
import random
import re
import zlib

import numpy as np
import pytest
from quadrat.llm import toxicity


def tables(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, label string, score int")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int")


def accuracy(model, texts, y):
    return ((toxicity.scores(model, texts) >= 0.5) == (np.array(y) == 1)).mean()


def test_machine_learns_what_only_pairs_tell():
    """Insult or group, but not both, is toxic: neither tells anything alone, among 33,000 words of noise."""
    rnd = random.Random(4)
    texts, y = [], []
    for _ in range(4000):
        a, b = rnd.random() < 0.5, rnd.random() < 0.5
        texts.append(" ".join([f"w{rnd.randint(0, 33_000)}" for _ in range(30)] + ["insult"] * a + ["group"] * b))
        y.append(float(a != b))
    terms = toxicity.Terms()
    model = toxicity.fit([terms(t) for t in texts[:3200]], np.array(y[:3200]))
    linear = {**model, "v": np.zeros_like(model["v"])}
    assert {int(t) for word in ("insult", "group") for t in terms.of(word)} <= set(model["terms"].tolist())
    assert accuracy(model, texts[3200:], y[3200:]) > 0.95 and accuracy(linear, texts[3200:], y[3200:]) < 0.7


def test_scores_are_the_sum_over_all_pairs():
    rnd = np.random.default_rng(1)
    vocabulary = [f"{'abcdefghij'[i % 10]}word{i}" for i in range(60)] + ["x", "Überlänge"]
    terms = toxicity.Terms()
    hashed = np.unique(np.concatenate([terms(w) for w in vocabulary[:40] + vocabulary[-1:]]))
    model = {"terms": hashed, "w": rnd.normal(0, 1, len(hashed)), "v": rnd.normal(0, 0.3, (len(hashed), toxicity.FACTORS)), "bias": -0.4}
    texts = [" ".join(rnd.choice(vocabulary, rnd.integers(0, 30))) for _ in range(50)] + [None, "", "12 _ !", "x"]
    for text, got in zip(texts, toxicity.scores(model, texts)):
        words = {w for w in re.findall(r"[^\W_]+", (text or "").lower())}
        held = {zlib.crc32(x.encode()) >> 1 for w in words for x in (w, *(f"{w[:n]}*" for n in toxicity.PREFIXES if len(w) > n))}
        at = [i for i, t in enumerate(hashed.tolist()) if t in held]
        margin = model["bias"] + sum(model["w"][i] for i in at) + sum(float(model["v"][i] @ model["v"][j]) for n, i in enumerate(at) for j in at[:n])
        assert abs(got - 1 / (1 + np.exp(-margin))) < 1e-12


def test_terms_are_chosen_without_labels(monkeypatch):
    monkeypatch.setattr(toxicity, "PASSES", ((1, 1, 1), (1, 1, 1)))
    terms = toxicity.Terms()
    rows = [terms(" ".join(["all", *["half"] * (i % 2), *["rare"] * (i < 2)])) for i in range(600)]
    for y in (np.arange(600) % 2.0, np.arange(600) < 300):
        assert set(toxicity.fit(rows, y.astype(float))["terms"].tolist()) == set(terms("all half").tolist())


def test_edges(spark):
    rows = [(i, f"fine words here {i % 7}" if i % 4 else f"fine vile{i % 3} words", ) for i in range(200)]
    rows += [(1000, None), (1001, ""), (1002, "vile1 " * 40_000), (None, "vile2"), (1003, "12 _ !"), (3, "fine words here 3")]
    docs, labels = tables(spark, rows, [(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (1000, None), (7, 0), (7, 0)])
    got = toxicity.toxicity(docs, labels).collect()
    by = {r.id: r for r in got}
    assert len(got) == len(rows)
    assert by[1000].score == by[1001].score == by[1003].score and 0 <= by[1000].score < 0.5
    assert by[1002].predicted == 1 and by[None].predicted == 1 and by[1].predicted == 0 and not by[None].held_out
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.id) for r in got if not r.predicted)


def test_without_labels(spark):
    docs, labels = tables(spark, [(1, "a"), (2, None)], [])
    assert all(r.predicted == 0 for r in toxicity.toxicity(docs, labels).collect())
    docs, labels = tables(spark, [], [(1, 1)])
    assert toxicity.toxicity(docs, labels).collect() == []


def test_scores_do_not_depend_on_batches(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    a = {r.id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    b = {r.id: r.score for r in toxicity.toxicity(docs.repartition(7), labels).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_ties_and_ids_that_are_no_numbers(spark):
    docs = spark.createDataFrame([(f"k{i}", "vile one" if i % 2 else "fine one") for i in range(60)] * 2, "doc_id string, text string")
    labels = spark.createDataFrame([(f"k{i}", i % 2) for i in range(60)], "doc_id string, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 120 and all(r.predicted == int(r.id[1:]) % 2 and r.held_out == (zlib.crc32(r.id.encode()) % 5 == 0) for r in got)
    assert len({r.score for r in got}) == 2


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the larger tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    want = {r.doc_id: r.toxic for r in labels.collect()}
    model = toxicity.train(docs, labels)
    sample = docs.join(labels.select("doc_id"), "doc_id").filter(toxicity.held_out(docs["doc_id"]))
    scored = toxicity.score(sample, model).collect()
    caught = [r.score >= 0.5 for r in scored if want[r.id] == 1]
    clean = [r.score < 0.5 for r in scored if want[r.id] == 0]
    assert np.mean(caught) > 0.8 and np.mean(clean) > 0.99
