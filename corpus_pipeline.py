"""From raw documents to training shards: the stages of a corpus, each over all that its predecessor kept.

Every stage is a function of (spark, docs, sf_dir); ``run`` writes its result to the shared folder and reads it
back as the next one's input. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import decontaminate, language, mixing, ngram_join, sharding
from quarryline.runtime import made, release, written

#: A document whose language is less certain than this is rejected: little more than chance among four. Short texts
#: and texts in two languages score between this and a half.
LEAST_SCORE = 0.3
N_SHARDS = 24
#: Ids up to which they are broadcast (8 bytes each); beyond, documents are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def _plain(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns renamed by their places, but for those that stages read: no name of a user's column
    can meet one of a stage's own. ``toDF(*docs.columns)`` turns back."""
    return docs.toDF(*[c if c in ("doc_id", "text", "lang", "source") else f"column{i}" for i, c in enumerate(docs.columns)])


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a determinable language: null and empty texts, those without a letter or of low score.

    Repeated rows stay or go together; columns of any name pass through; an empty table stays empty.
    """
    rows = _plain(docs)
    found = language.predict(rows, language.fit(rows))
    return found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*rows.columns).toDF(*docs.columns)


def _sized(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the smallest doc_id stays, once; rows without doc_id stay.

    Rows of one id and text count as one; only rows whose id occurs several times are moved to find them. Null and
    empty texts are linked to nothing and stay. Columns of any name pass through; an empty table stays empty.
    """
    rows = _plain(docs)
    classes = ngram_join.jaccard_classes(rows, exact_counts=False)  # only the classes are read
    surplus = written(classes.where(F.col("doc_id") != F.col("class_id")).select("doc_id").distinct(), "surplus-ids")
    again = written(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("again")), "repeated-ids")
    left, again = rows.join(_sized(surplus), "doc_id", "left_anti"), _sized(again)
    same = F.col("doc_id").eqNullSafe(F.col("again"))
    once = left.join(again, same, "left_anti").select(*rows.columns)
    return once.unionByName(left.join(again, same, "left_semi").select(*rows.columns).dropDuplicates(["doc_id", "text"])).toDF(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a test item; rows without doc_id, null and empty texts stay.

    Repeated rows stay or go together; columns of any name pass through; an empty table stays empty.
    """
    pairs = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontaminate.without_contaminated(docs, pairs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that the sources meet their shares; a null source is one of its own.

    Documents without words go. Of repeated rows, each is taken by its own place in the order. Columns of any name pass
    through; an empty table stays empty.
    """
    return mixing.mixed_documents(docs, size=mixing.word_count(F.col("text")))


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with size, shard and slot; columns of these names are replaced, all others kept, whatever theirs.

    Null texts have size 8; repeated rows get neighbouring slots; an empty table gives no rows.
    """
    body = F.coalesce("text", F.lit(""))
    rows = docs.withColumn("size", (F.octet_length(body) + 8).cast("long"))
    return sharding.hilbert_shards(rows, N_SHARDS, tie=(F.xxhash64(body), "doc_id"), outputs=("shard", "slot"))


STAGES = [
    ("language", keep_languages),
    ("near_copies", keep_one_of_near_copies),
    ("benchmark", drop_benchmark_leaks),
    ("mixture", mix_sources),
    ("shards", cut_shards),
]

#: The first stage is a trained model, which SQL cannot express; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = made()
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        # Nothing reads a stage's working tables once its result is written.
        release(spark, made()[len(before) :], but=docs)
    return docs
