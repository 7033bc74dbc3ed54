import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from terrane.llm import bpe, mixing
from tests.llm.test_operators import ODD, brute_lines, word_sets


def test_stages_and_run(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
        assert name == "encoding" or docs.columns == before.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = {r.doc_id for r in kept["quality"]}
    assert sum(labels[i] == 1 for i in labels if i in good) > 0.95 * sum(labels.values()) and sum(labels[i] == 0 for i in labels if i in good) < 0.1 * len(labels)
    assert sorted((repr(r.doc_id), r.text) for r in kept["lines"]) == brute_lines([(r.doc_id, r.text) for r in kept["quality"]])
    assert all(r.n_chars == len(r.text) for r in kept["lines"])
    sets = {r.doc_id: word_sets(r.text) for r in kept["lines"]}
    stay = {r.doc_id for r in kept["simhash"]}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert all(any(near(i, j) for j in sets if j != i) for i in sets if i not in stay) and not any(near(a, b) for a in stay for b in stay if a < b)
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix_sources(spark.read.parquet(str(tmp_path / "simhash"))).filter("size > 0").collect()}
    assert {i: sum(r.doc_id == i for r in kept["mixing"]) for i in taken} == taken
    mix = {r.doc_id for r in kept["mixing"]}
    assert mix <= stay and max(sum(r.doc_id == i for r in kept["mixing"]) for i in mix) <= 3
    path = public_tokenizers.path(corpus_pipeline.VOCABULARY)
    tik = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(None, path), special_tokens={})
    text = {r.doc_id: r.text for r in kept["mixing"]}
    assert all(r.ids == tik.encode_ordinary(text[r.doc_id]) for r in kept["encoding"])
    rows = lambda df: sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, sf)) == rows(docs)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, name):
    """Nulls in every column, blank and long texts, repeated rows, columns whose names the operators use, and no rows at all."""
    sf, stage = "/root/testdata/sf0.001", dict(corpus_pipeline.STAGES)[name]
    good = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(30).collect()]
    odd = [(i, t, None, None, None) for i, t in ODD] + good + good[:3] + [(9100, "word " * 30_000, "en", "web", 150_000), (9101, "line\n" * 3_000, "en", "web", 15_000)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    docs = docs.withColumns({c: F.lit("x") for c in ("rk", "rk__", "times__", "copy__", "score__", "text__", "score", "body", "size", "removed", "bands", "fp")})
    out = stage(spark, docs, sf)
    rows = out.collect()
    assert rows and stage(spark, docs.limit(0), sf).isEmpty()
    if name != "encoding":
        assert out.columns == docs.columns and {r.rk for r in rows} == {"x"}
    count = {i: sum(r.doc_id == i for r in rows) for i in (good[0][0], 9003)}
    if name in ("lines", "encoding"):
        assert len(rows) == len(odd)
    if name == "simhash":
        assert all(n <= 1 for n in count.values()) and sum(not (r.text or "").split() for r in rows) == 1
    if name == "quality":
        assert count[9003] in (0, 2) and count[good[0][0]] in (0, 2)
    if name == "mixing":
        assert all((r.text or "").split() for r in rows)
