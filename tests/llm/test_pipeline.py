"""The pipeline stage by stage on the smallest tables."""

import collections

import pytest
from pyspark.sql import functions as F

from shelfspark.llm import ngram_join, packing, queries, secrets, stages
from shelfspark.llm.common import table, written
from shelfspark.llm.shingles import shingle_set

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    base = table(spark, SMALL, "documents")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0)], base.schema)
    return written(base.unionByName(odd).unionByName(base.limit(1)), "test")  # a repeated row too


def test_stages_in_order(spark, docs):
    from corpus_pipeline import ORACLE_SQL, STAGES, run

    assert [name for name, _ in STAGES] == ["quality rules", "n-gram Jaccard join", "secret scans", "mixing sources", "packing"]
    assert ORACLE_SQL is None
    step, columns = docs, docs.columns
    for _, stage in STAGES[:-1]:
        step = written(stage(spark, step, SMALL), "test")
        assert step.columns == columns and step.count() > 0
    pieces = STAGES[-1][1](spark, step, SMALL)
    assert run(spark, SMALL).columns == pieces.columns
    tokens = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("one"))
    copies = {r.doc_id: r["count"] for r in step.groupBy("doc_id").count().collect()}
    assert {r.doc_id: r.n // r.one for r in tokens.collect()} == copies


def test_clean_documents_pass_quality(spark, docs):
    kept = stages.keep_good(spark, docs, SMALL).select("doc_id")
    labels = table(spark, SMALL, "labels")
    good = labels.where("quality = 1").join(docs, "doc_id").where(F.size(F.split(F.trim("text"), r"\s+")) > 40).select("doc_id").distinct()
    assert good.join(kept, "doc_id", "left_anti").count() <= 0.06 * good.count()  # those that fail the base rules


def test_one_document_of_each_group_stays(spark, docs):
    kept = stages.one_of_each(spark, docs, SMALL).collect()
    ids = [r.doc_id for r in kept]
    classes = ngram_join.find_classes(docs).collect()
    assert sorted(map(str, ids)) == sorted({str(r.component_id) for r in classes})
    sets = [set(shingle_set(r.text).tolist()) for r in kept]
    assert not any(100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i] if a and b)


def test_null_ids_are_linked_too(spark):
    def prose(seed, edits=()):
        return " ".join("changed" if i in edits else f"w{seed}x{i * 7919 % 1000}" for i in range(200))

    bridge = [(1, prose(1)), (None, prose(1, (30, 60, 90))), (2, prose(1, (30, 60, 90, 120, 150, 180)))]  # 1 and 2 are linked by the null id only
    bridge = [(i, t, "b") for i, t in bridge]
    near = [(5, prose(2), "n"), (None, prose(2, (50,)), "n")]
    unnamed = [(None, prose(3), "u"), (None, prose(3, (50,)), "u"), (None, prose(3), "u")]
    alone = [(None, prose(4), "a"), (9, prose(5), "c"), (None, None, "e"), (None, "", "f")]
    rows = spark.createDataFrame([(i, t, "en", k, 0) for i, t, k in bridge + near + unnamed + alone],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    sets = [set(shingle_set(t).tolist()) for _, t, _ in bridge]
    like = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    assert like(sets[0], sets[1]) and like(sets[1], sets[2]) and not like(sets[0], sets[2])
    found = ngram_join.find_classes(rows)
    assert {r.doc_id: r.component_id for r in found.where("doc_id IS NOT NULL").collect()} == {1: 1, 2: 1, 5: 5, 9: 9}
    assert sorted(str(r.component_id) for r in found.where("doc_id IS NULL AND n_shingles > 0").collect()) == ["1", "5", "None", "None", "None", "None"]
    kept = stages.one_of_each(spark, rows, SMALL).collect()
    assert sorted((str(r.doc_id), r.source) for r in kept) == [("1", "b"), ("5", "n"), ("9", "c"), ("None", "a"), ("None", "e"), ("None", "f"), ("None", "u")]


def test_secrets_go_and_nothing_else(spark, docs):
    found = {r.doc_id: r for r in secrets.find_secrets(docs).collect()}
    clean = stages.redact_secrets(spark, docs, SMALL)
    assert clean.count() == docs.count()
    for r in clean.collect():
        old = found[r.doc_id]
        if old.all_spans:
            assert "[SECRET]" in r.text and r.n_chars == len(r.text)
        else:
            assert r.text == old.text and r.n_chars == old.n_chars


def test_every_document_is_mixed_and_packed(spark, docs):
    mixed = stages.mix_sources(spark, docs, SMALL)
    before = collections.Counter(r.doc_id for r in docs.collect())
    after = collections.Counter(r.doc_id for r in mixed.collect())
    assert set(after) == set(before) and all(n <= after[k] <= n * (stages.MAX_REPEATS + 1) for k, n in before.items())
    pieces = stages.pack_sequences(spark, docs, SMALL)
    assert pieces.columns == [c.split()[0] for c in packing.PIECE.split(", ")]


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(queries.QUERIES) <= set(names) and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
