"""From raw documents to packed training sequences, in five stages; each reads what the one before it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import language_id, ngram_join, packing, quality_rules, source_mix
from ridgeline.llm.shared import Workspace

#: Ids up to which a checked table is broadcast.
SMALL = 2_000_000


def _keyed(docs: DataFrame) -> DataFrame:
    """The docs with _k: the id and the text's hash, which tell rows apart but for exact repeats."""
    return docs.withColumn("_k", F.struct("doc_id", F.xxhash64("text").alias("h")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and aren't depleted by lines that their host repeats, without those lines."""
    return quality_rules.clean(docs).filter("kept").withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, mixed ones too, which is their `lang` from here on: only those without a letter have none (and all have none where no label could be learned)."""
    net = language_id.fit(docs, language_id.fold_of(docs["doc_id"], 4) != 2)
    found = language_id.predict(docs, net, pred_col="_lang", score_col="_score")
    return found.filter(F.col("_lang") != language_id.UNKNOWN).withColumn("lang", F.col("_lang").cast(docs.schema["lang"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group linked by shingles of five words at a similarity of 0.8.

    The others are few next to all documents; their keys are counted, and broadcast up to SMALL, else joined by a
    shuffle. Exact repeats of a row have one key: those keys' rows are then cut to one.
    """
    work, inner = Workspace(spark, "near"), Workspace(spark, "ngrams")
    joined = work.put("joined", ngram_join.join(_keyed(docs), id_col="_k", width=5, num=80, den=100, work=inner))
    inner.drop()
    gone = joined.filter("_k <> component_id").select("_k").distinct()
    twice = joined.filter("_k = component_id").groupBy("_k").count().filter("count > 1").select("_k")
    gone, twice = (F.broadcast(x) if x.count() <= SMALL else x for x in (work.put("gone", gone), work.put("twice", twice)))
    key = lambda x: F.expr("d._k.h = x._k.h and d._k.doc_id <=> x._k.doc_id")
    left = _keyed(docs).alias("d").join(gone.alias("x"), key("x"), "left_anti")
    single = left.alias("d").join(twice.alias("x"), key("x"), "left_anti")
    repeated = left.alias("d").join(twice.alias("x"), key("x"), "left_semi").dropDuplicates(["_k"])
    return single.unionByName(repeated).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: its taken words by its size, rounded, so 0, 1 or 2 times.

    Sources meet their targets, and in each source the languages that were found share its target evenly, as far as two copies of each document allow.
    """
    return source_mix.copies(_keyed(docs), id_col="_k", part_col="lang").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixed),
    ("packing", packed),
]
#: A trained network decides in the second stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir; what a stage gives is written to the shared folder and read by the next."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = work.put(str(k), docs)
            work.drop(str(k - 1))
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
