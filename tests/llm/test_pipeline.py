"""The pipeline against plain versions of its stages, and its stages on odd tables."""

import hashlib

import pytest

import corpus_pipeline as P
from tablelens.llm.registry import vocabulary_path

from .conftest import SF, remainder
from .test_text_operators import brute_contaminated, brute_lines, brute_near


def test_run_against_plain_stages(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary_path())
    lib.no_truncation()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # the toxicity model has no plain version: its stage's own decisions, the rest from them
    rows = [(r.doc_id, r.text) for r in P.toxicity(spark, docs, SF).collect()]
    assert 0 < len(rows) <= docs.count()
    rows = [(i, t) for i, t, *_ in brute_lines(rows)]
    rows = _near(rows)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {x[0] for x in brute_contaminated(rows, items) if x[4]}
    want = sorted((i, t, tuple(lib.encode(t, add_special_tokens=False).ids)) for i, t in rows if i not in bad)
    got = P.run(spark, SF)
    assert got.columns == [*docs.columns, "ids", "n_tokens", "decoded_sha256"]
    import numpy as np

    out = got.collect()
    assert sorted((r.doc_id, r.text, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in out) == want
    assert all(r.n_chars == len(r.text) for r in out)
    assert all(r.decoded_sha256 == hashlib.sha256(lib.decode(np.frombuffer(r.ids, "<u4").tolist(), skip_special_tokens=False).encode()).hexdigest() for r in out)


def _near(rows):
    kept = {x[0] for x in brute_near(rows, 5) if x[3]}
    return [r for r in rows if r[0] in kept]


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stages_on_odd_tables(spark, odd, clash, none, name):
    stage = dict(P.STAGES)[name]
    for df in (odd, clash):
        out = stage(spark, df, SF)
        if name != "bpe":
            assert out.columns == df.columns
        n = out.count()
        assert 0 < n <= df.count()
        assert out.filter("doc_id = 4").count() == (1 if name == "minhash_dedup" else 2)
        assert out.filter("text is null").count() == (2 if name != "minhash_dedup" else out.filter("text is null").count())
    assert stage(spark, none, SF).count() == 0


def test_stage_decisions(spark, odd):
    # toxic documents go and clean ones stay, judged by the labels that the model doesn't see
    large = SF.replace("sf0.001", "sf0.1")
    docs = spark.read.parquet(f"{large}/documents.parquet")
    stay = {r.doc_id for r in P.toxicity(spark, docs, large).select("doc_id").collect()}
    held = [r for r in spark.read.parquet(f"{large}/labels.parquet").collect() if remainder(r.doc_id, 4) == 2]
    toxic, clean = ([r.doc_id for r in held if r.toxic == y] for y in (1, 0))
    assert sum(i in stay for i in toxic) < 0.15 * len(toxic) and sum(i in stay for i in clean) > 0.97 * len(clean)
    # six labelled ids teach nothing: the stage keeps every document but those, if any, above the threshold
    assert P.toxicity(spark, odd, large).filter("doc_id = 5").count() == 1
    kept = {r.doc_id for r in P.minhash_dedup(spark, odd, SF).collect()}
    assert -3 in kept and not kept & {10, 11, 12}
    assert P.line_dedup(spark, odd, SF).filter("doc_id = 8").first().text == ""
    assert P.line_dedup(spark, odd, SF).filter("n_chars <> length(text)").count() == 0
