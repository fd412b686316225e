"""Whole texts travel to Python in small Arrow batches."""

from __future__ import annotations

import hashlib
import random
import uuid

import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import bpe_tree, common, queries

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_bpe_batches_are_small(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    words = ["".join(rng.choice("theingabn") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=2_500)) for _ in range(800)] + [" ".join(rng.choices(words, k=9_000)), "", None]
    texts = [t and t[:16_000] if i < 800 else t for i, t in enumerate(texts)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    seen = tmp_path / "seen"
    seen.mkdir()

    def noting(run):
        def noted(batches):
            def each():
                for b in batches:
                    (seen / uuid.uuid4().hex).write_text(f"{b.nbytes}")
                    yield b

            yield from run(each())

        return common.lean(noted)

    monkeypatch.setattr(bpe_tree, "lean", noting)
    try:
        got = {r["doc_id"]: r for r in queries.op8_bpe(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset(KEY)
    sizes = [int(p.read_text()) for p in seen.iterdir()]
    assert sum(sizes) > 10_000_000 and max(sizes) <= 2 * common.BATCH_BYTES
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    assert sorted(got) == list(range(len(texts)))
    for i in (0, 1, 399, 799, 800, 801, 802):
        ids = t.encode(texts[i] or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_own_batch_limit_stays(spark):
    try:
        spark.conf.set(KEY, "1m")
        common.small_batches(spark)
        assert spark.conf.get(KEY) == "1m"
    finally:
        spark.conf.unset(KEY)
