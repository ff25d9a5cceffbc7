import corpus_pipeline
import test_linededup
import test_mixing
import test_simhash
from pyspark.sql import functions as F
from quadrat.llm import pieces, toxicity


def stage(name, spark, docs, sf):
    return dict(corpus_pipeline.STAGES)[name](spark, docs, sf)


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_stages_one_after_another(spark, sf, tmp_path):
    """Each stage over what the one before wrote, held to a brute-force version of it."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns

    def written(name, df):
        df.write.parquet(f"file://{tmp_path}/{name}")
        return spark.read.parquet(f"file://{tmp_path}/{name}")

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    clean = written("toxicity", stage("toxicity", spark, docs, sf))
    bad = {r.id for r in toxicity.toxicity(docs, labels).collect() if r.predicted}
    assert clean.columns == columns and sorted(r.doc_id for r in clean.collect()) == sorted(set(i for i, in rows_of(docs, "doc_id")) - bad)

    lines = written("line_dedup", stage("line_dedup", spark, clean, sf))
    want = test_linededup.brute(rows_of(clean, "doc_id", "text"))
    assert lines.columns == columns and lines.dtypes == docs.dtypes
    assert {r.doc_id: r.text for r in lines.collect()} == {i: t for i, (t, _) in want.items()}
    assert lines.filter(F.col("n_chars") != F.char_length("text")).isEmpty()

    single = written("near_dedup", stage("near_dedup", spark, lines, sf))
    left, pairs = test_simhash.brute_kept(rows_of(lines, "doc_id", "text"))
    assert single.columns == columns and sorted((r.doc_id for r in single.collect()), key=str) == left and pairs

    mixed = written("mixing", stage("mixing", spark, single, sf))
    plan = test_mixing.brute(rows_of(single, "doc_id", "text", "source"))
    counts = {}
    for i, t, s in rows_of(mixed, "doc_id", "text", "source"):
        k = (i, s, len((t or "").encode().split()))
        counts[k] = counts.get(k, 0) + 1
    assert mixed.columns == columns and counts == {k: v[2] for k, v in plan.items() if v[2]}

    encoded = written("encoding", stage("encoding", spark, mixed, sf))
    library = pieces.codec(corpus_pipeline.public_tokenizers.path(corpus_pipeline.PIECES)).library
    text = dict(rows_of(single, "doc_id", "text"))
    got = encoded.collect()
    assert len(got) == mixed.count()
    for r in got:
        assert list(r.ids) == library.encode(text[r.doc_id] or "") and r.decoded == library.decode(list(r.ids))


def test_run_is_the_stages(spark, sf):
    """run() is the stages one after another, each over the table that the one before wrote: the last alone is still to be done."""
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan and not any(x in plan for x in ("ArrowEvalPython", "Join", "Exchange"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, _ in corpus_pipeline.STAGES:
        docs = stage(name, spark, docs, sf)
    rows = lambda df: sorted(rows_of(df, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))
    assert rows(got) == rows(docs) and got.count() > 0


def test_run_on_null_and_repeated_rows(spark, sf, tmp_path):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    some = documents.filter("doc_id < 20")
    blank = some.select(*(F.lit(None).cast(t).alias(c) for c, t in some.dtypes)).limit(3)
    for name, docs in (("some", some.union(some).union(blank)), ("none", some.limit(0))):
        docs.write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"file://{tmp_path}/{name}/labels.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}/some").collect()
    assert got and {r.doc_id for r in got} <= {None, *range(20)}
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/none").collect() == []
