"""The pipeline, stage by stage, against the operators' own brute force."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from test_llm_operators import EDGES, EXTRA, brute_components, brute_exact, brute_fingerprint

SF = "/root/testdata/sf0.001"


def test_registered():
    assert corpus_pipeline.STAGES and "pipeline" in E.queries()
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in E.queries())] == []


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        after = docs.collect()
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
        if name == "language_id":
            assert {r["doc_id"] for r in after} <= {d for d, _ in before} and len(after) > 0.95 * len(before)
        if name == "exact_dedup":
            assert sorted(r["doc_id"] for r in after) == sorted({int(k) for _, k, *_ in brute_exact(before)})
        if name == "simhash_dedup":
            comp = brute_components([(d, brute_fingerprint(t)) for d, t in before])
            assert sorted(r["doc_id"] for r in after) == sorted({int(c) for *_, c in comp})
        if name == "mixing":
            assert {r["doc_id"] for r in after} <= {d for d, _ in before}
        if name == "bpe":
            assert sorted(r["doc_id"] for r in after) == sorted(d for d, _ in before)


@pytest.mark.parametrize("rows", [len(EDGES), 0])
def test_edge_rows(spark, tmp_path, rows):
    table = spark.createDataFrame([(*r, len(r[1] or ""), *["x"] * len(EXTRA)) for r in EDGES[:rows]], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA))
    table.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert (out.count() > 0) == (rows > 0)
    assert out.where(F.col("n_tokens").isNull()).count() == 0
