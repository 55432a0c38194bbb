import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_exact_sharding_mixing import water
from tests.llm.test_ngram_join import brute
from tests.llm.test_text_operators import brute_leaks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(table):
    return [(r.doc_id, r.text) for r in table.collect()]


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "benchmark", "mixture", "shards"]


def test_language_stage_rejects_what_has_none(spark, table, texts):
    odd = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "12 34 !!", "en", "s", 8)], table.schema)
    kept = corpus_pipeline.keep_languages(spark, table.unionByName(odd), SF)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in texts}


def test_near_copy_stage(spark, table, texts):
    again = table.unionByName(table.limit(3))
    kept = corpus_pipeline.keep_one_of_near_copies(spark, again, SF)
    classes = brute(texts)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c[0] for c in classes.values()})


def test_benchmark_stage(spark, table, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {i for i, _ in brute_leaks(texts, items)}
    kept = corpus_pipeline.drop_benchmark_leaks(spark, table, SF)
    assert leaks and kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in texts} - leaks


def test_mixture_stage(spark, table):
    queues, sizes = defaultdict(list), Counter()
    for r in table.collect():
        n = len(r.text.split())
        sizes[r.source] += n
        queues[r.source].append((hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest(), r.doc_id, n))
    times = Counter()
    for source, target in water(sizes).items():
        left = round(target)
        while left > 0:
            for _, i, n in sorted(queues[source]):
                if left > 0:
                    times[i] += 1
                    left -= n
    got = corpus_pipeline.mix_sources(spark, table, SF)
    assert got.columns == table.columns and Counter(r.doc_id for r in got.collect()) == times


def test_shard_stage(spark, table, texts):
    got = corpus_pipeline.cut_shards(spark, table, SF).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == len(texts) and max(sizes.values()) - min(sizes.values()) <= 1


def test_whole_run_takes_clean_rows_through(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "lang", "source", "n_chars", "size", "shard", "slot"} == set(out.columns)
    assert out.count() > 100 and out.select(F.countDistinct("shard")).first()[0] == 24


def test_empty_table(spark, table):
    docs = table.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


NAMES = ("again", "score", "lang_pred", "times", "row", "curve", "held", "column0", "n", "class_id", "item_id", "taken")


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_pass_columns_of_any_name_and_odd_rows(spark, table, stage):
    odd = spark.createDataFrame([(None, None, None, None, None), (9001, "", "en", None, 0), (9002, "words of a small text that stands here twice", None, "s", 8), (9002, "words of a small text that stands here twice", None, "s", 8)], table.schema)
    docs = table.limit(60).unionByName(odd)
    for k, c in enumerate(NAMES):
        docs = docs.withColumn(c, F.concat(F.lit(f"{c}-{k}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    out = stage(spark, docs, SF)
    added = ["size", "shard", "slot"] if stage is corpus_pipeline.cut_shards else []
    assert out.columns == docs.columns + added
    rows = out.collect()
    assert rows and all(r[c] == f"{c}-{k}-{'none' if r.doc_id is None else r.doc_id}" for r in rows for k, c in enumerate(NAMES))
    assert stage(spark, docs.limit(0), SF).count() == 0
