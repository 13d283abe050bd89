"""Queries over a dictionary ``(term, frequency)``: completion, fuzzy matches, the prefix tree as rows, sorted lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact(terms: DataFrame, word: str) -> DataFrame:
    return terms.where(F.col("term") == word.lower()).select("term", "frequency")


def complete(terms: DataFrame, prefix: str, k: int = 10) -> DataFrame:
    """The ``k`` most frequent words with a prefix, ties by name; the prefix is a filter that reaches the scan."""
    return terms.where(F.col("term").startswith(prefix.lower())).select("term", "frequency").orderBy(F.desc("frequency"), "term").limit(k)


def expand(terms: DataFrame, query_terms: list[str], k: int = 3) -> DataFrame:
    """(term, origin): a single short term is followed by its best completions; other queries stay as they are."""
    spark = terms.sparkSession
    own = spark.createDataFrame([(t, "query") for t in query_terms], "term string, origin string")
    if len(query_terms) != 1 or len(query_terms[0]) > 4:
        return own
    return own.unionByName(complete(terms, query_terms[0], k).select("term", F.lit("completion").alias("origin")))


def fuzzy(terms: DataFrame, word: str, distance: int = 2, k: int = 10, by_frequency: bool = False) -> DataFrame:
    """(term, distance, frequency): words within an edit distance; words of other lengths are never compared."""
    word = word.lower()
    near = terms.where(F.length("term").between(len(word) - distance, len(word) + distance))
    near = near.select("term", F.levenshtein("term", F.lit(word), distance).cast("long").alias("distance"), "frequency").where("distance >= 0")
    order = [F.desc("frequency"), F.col("term")] if by_frequency else [F.col("distance"), F.desc("frequency"), F.col("term")]
    return near.orderBy(*order).limit(k)


def prefixes(terms: DataFrame) -> DataFrame:
    """(prefix): distinct prefixes of all terms, which are the nodes of their tree."""
    lengths = F.sequence(F.lit(1), F.length("term"))
    return terms.where(F.length("term") > 0).select(F.explode(F.transform(lengths, lambda n: F.substring(F.col("term"), F.lit(1), n))).alias("prefix")).distinct()


def tree(terms: DataFrame) -> DataFrame:
    """(prefix, parent, depth, is_word, frequency) of each node."""
    lengths = F.sequence(F.lit(1), F.length("term"))
    each = terms.where(F.length("term") > 0).select("term", "frequency", F.explode(lengths).alias("depth"))
    last = F.col("depth") == F.length("term")
    rows = each.select(F.substring(F.col("term"), F.lit(1), F.col("depth")).alias("prefix"), "depth", F.when(last, F.col("frequency")).alias("f"))
    nodes = rows.groupBy("prefix", "depth").agg(F.sum("f").alias("f"))
    return nodes.select("prefix", F.substring(F.col("prefix"), F.lit(1), F.col("depth") - 1).alias("parent"), F.col("depth").cast("long").alias("depth"), F.col("f").isNotNull().alias("is_word"), F.coalesce("f", F.lit(0)).alias("frequency"))


def lookup(rows: DataFrame, key: Column, target) -> DataFrame:
    """(found, idx): whether a value is in a sorted sequence, and how many values lie before it. One aggregation, no sort."""
    goal = F.lit(target)
    found = F.coalesce(F.max(key == goal), F.lit(False))
    return rows.agg(found.alias("found"), F.when(found, F.count_if(key < goal)).otherwise(F.lit(-1)).cast("long").alias("idx"))
