"""A stored inverted index: written once, after which a query reads the postings of its own terms and nothing else."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.index import sorted_posting_rows
from quarry.operators.lexical import Corpus, TermQuery
from quarry.session import settle

SCHEMA = "term string, doc_id long, tf long, dl int, positions array<int>, bucket long"
#: The term of the row that every document has; no token is empty.
MARK = ""


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets))


#: Tokens whose postings a task sorts at a time, and bytes of a row group, of which a task holds one for each bucket.
RUN, GROUP = 1 << 20, 4 << 20


def build(docs: DataFrame, path: str, analyzer: str = "main", buckets: int = 32, spread: int = 0) -> StoredIndex:
    """Writes the index of ``docs(doc_id, text)`` to ``path`` and opens it. Documents have distinct ids (see ``index.latest``);
    a null text has no postings but counts as a document.

    Terms are hashed to ``buckets`` folders, so that a lookup opens a folder a term. Nothing is shuffled or spilled: each task sorts the
    postings of its own documents in runs of ``RUN`` tokens by term and writes a file in each folder, so a lookup skips
    the row groups and pages of other terms, and a term that every document has is no hot task. A table in fewer than ``spread``
    partitions is dealt so many ways by document first.
    """
    spark = docs.sparkSession
    if docs.rdd.getNumPartitions() < spread:
        docs = docs.repartition(spread, "doc_id")
    rows = sorted_posting_rows(docs, analyzer, RUN).withColumn("bucket", _bucket(F.col("term"), buckets))
    name, before = "spark.sql.maxConcurrentOutputFileWriters", spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    spark.conf.set(name, str(buckets + 1))  # a task has a writer for each bucket; with one at a time, Spark would sort all rows
    try:
        rows.write.partitionBy("bucket").option("parquet.block.size", str(GROUP)).parquet(f"{path}/postings")
    finally:
        spark.conf.set(name, before)
    marks = spark.read.schema(SCHEMA).parquet(f"{path}/postings").where((F.col("bucket") == _bucket(F.lit(MARK), buckets)) & (F.col("term") == MARK))
    figures = marks.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).first()
    about = {**figures.asDict(), "analyzer": analyzer, "buckets": buckets}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/about")
    return StoredIndex(spark, path)


class StoredIndex:
    """An index that ``build`` wrote, in this session or another."""

    def __init__(self, spark: SparkSession, path: str):
        about = json.loads(spark.read.text(f"{path}/about").first()["value"])
        self.n, self.total, self.analyzer, self.buckets = about["n"], about["total"], about["analyzer"], about["buckets"]
        self.postings = spark.read.schema(SCHEMA).parquet(f"{path}/postings")

    def lookup(self, terms: list[str]) -> DataFrame:
        """The postings of ``terms``: folders are pruned by the hash, row groups by the term."""
        own = F.col("bucket").isin(*[_bucket(F.lit(t), self.buckets) for t in terms])
        return self.postings.where(own & F.col("term").isin(*terms))

    def none_of(self, terms: list[str]) -> DataFrame:
        """(doc_id) of documents without any of the terms."""
        return self.lookup([MARK]).select("doc_id").join(self.lookup([t.lower() for t in terms]).select("doc_id"), "doc_id", "left_anti")

    def ask(self, terms: list[str], analyzer: str = "main") -> StoredQuery:
        if analyzer != self.analyzer:
            raise ValueError(f"the index was built with the analyzer {self.analyzer!r}, not {analyzer!r}")
        return StoredQuery(self, terms)


class StoredQuery(TermQuery):
    """A term query whose table of places is put together from postings: only those of its terms are read and shuffled."""

    def __init__(self, index: StoredIndex, terms: list[str]):
        self.terms = [t.lower() for t in terms]
        self.distinct = list(dict.fromkeys(self.terms))
        at = lambda t: F.coalesce(F.max(F.when(F.col("term") == t, F.col("positions"))), F.array().cast("array<int>"))
        places = index.lookup(self.distinct).groupBy("doc_id").agg(F.max("dl").alias("dl"), *[at(t).alias(f"p{k}") for k, t in enumerate(self.distinct)])
        self.places = settle(places, "places")
        df = self.places.agg(*[F.count_if(self.has(t)).alias(f"df{k}") for k, t in enumerate(self.distinct)]).first()
        self.corpus = Corpus(index.n, index.total, {t: df[f"df{k}"] for k, t in enumerate(self.distinct)})
