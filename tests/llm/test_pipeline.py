"""The pipeline against its stages done plainly one after the other."""

import hashlib

import duckdb
import pyarrow as pa
import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from test_text_operators import CLASH, ODD, VOCAB, frame, jaccard_components, plain_contamination, plain_spans  # noqa: E402

from axonloom.llm import language, pii  # noqa: E402


def test_pipeline_equals_plain_stages(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCAB)
    rows = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    told = {r.doc_id for r in language.predicted(docs, language.train(docs)).where("lang_pred <> 'und' and score >= 0.5").collect()}
    rows = [(i, x) for i, x in rows if i in told]
    comp = jaccard_components([x for _, x in rows])
    rows = [r for n, r in enumerate(rows) if comp[n] == n]
    bad = plain_contamination(rows, [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()])
    rows = [r for r in rows if not bad[r[0]][1]]
    # the spans by SQL: base spans, secrets and disclosing terms of what is left
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [i for i, _ in rows], "text": [x for _, x in rows]}))
    spans = {r[0]: r[1] for r in con.execute(f"select doc_id, spans from ({pii.found_sql()})").fetchall()}
    assert spans.keys() == {i for i, _ in rows}
    want = {}
    for i, x in rows:
        out, at = "", 0
        assert set(filter(None, plain_spans(x).split(","))) <= set(spans[i].split(","))
        for s in filter(None, spans[i].split(",")):
            kind, a, b = s.split(":")
            out += x[at : max(at, int(a))] + (f"<{kind}>" if int(b) > at and kind != "removed" else "")
            at = max(at, int(b))
        want[i] = hashlib.sha256(",".join(map(str, t.encode(out + x[at:], add_special_tokens=False).ids)).encode()).hexdigest()
    got = {r.doc_id: r.ids_sha256 for r in pipeline.run(spark, sf).collect()}
    assert got == want
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "pii", "bpe"]


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).dtypes == docs.dtypes


def test_stages_over_odd_rows(spark, sf):
    """Nulls, empty and very long texts, repeated rows, clashing columns, and no row at all, stage after stage."""
    from pyspark.sql import functions as F

    docs = frame(spark, ODD).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    docs = docs.withColumns({c: F.lit("clash") for c in CLASH if c not in docs.columns})
    model = spark.read.parquet(f"{sf}/documents.parquet")
    now = language.with_language(docs, language.train(model))
    assert now.columns == docs.columns
    for name, stage in pipeline.STAGES[1:]:
        before, now = now.count(), stage(spark, now, sf)
        assert now.count() <= before, name
    rows = {r.doc_id: r for r in now.collect()}
    assert len(rows) == now.count() and 6 not in rows  # the third copy went, and of the repeated rows one stays
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf).collect() == [], name
