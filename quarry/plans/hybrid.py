"""Hybrid search: lexical and vector ranks fused, with the authority of the link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import is_phrase, query_terms
from quarry.operators import graph, lexical, ranking, stored, vector
from quarry.plans.base import query
from quarry.plans.graphs import _ranks, links, vertices
from quarry.plans.lexical import indexed, query_cte
from quarry.plans.vectors import similarity_cte
from quarry.session import once
from quarry.sources.tables import table

QUERY = "tion rewh"
TITLE = "(?s)<title>(.*?)</title>"


def authorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, rank) of all pages: computed by the first query of a session that needs it, and again when ``pages`` has changed."""

    def make(path: str) -> None:
        ranks, _ = graph.pagerank(vertices(spark, sf_dir), links(spark, sf_dir))
        ranks.select("id", "rank").write.parquet(path)

    return spark.read.schema("id long, rank double").parquet(once(table(spark, sf_dir, "pages"), "pagerank", make))


def lexical_rows(index: stored.StoredIndex, text: str) -> DataFrame:
    """(doc_id, score): phrases for quoted queries; else all terms or, where no document has them all, any."""
    terms = query_terms(text)
    if not terms:
        return index.postings.sparkSession.createDataFrame([], "doc_id long, score double")
    if is_phrase(text):
        return lexical.phrase(index, terms).select("doc_id", "score")
    return lexical.and_or_fallback(index, terms).select("doc_id", "score")


def search(spark: SparkSession, sf_dir: str, text: str, k: int = 20, candidates: int = 50) -> DataFrame:
    """One row a hit: scores of both sides, their fusion, the page's rank and title, best first.

    The lexical list is ranked whole, in slices of its scores; the vector list has ``candidates`` entries.
    """
    docs = table(spark, sf_dir, "documents")
    lex = ranking.ranked_all(lexical_rows(indexed(spark, sf_dir), text), "score", "doc_id")
    sem = vector.text_similarity(docs, text).select("doc_id", F.round("similarity", 6).alias("score"))
    sem = ranking.ranked(sem, "score", "doc_id", candidates)
    fused = ranking.reciprocal_ranks(lex, sem, "doc_id")
    ranks = authorities(spark, sf_dir)
    title = F.regexp_extract("html", TITLE, 1)
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.when(title != "", title).alias("title"), "url")
    rows = fused.join(lex.select("doc_id", F.col("score").alias("bm25_score")), "doc_id", "left").join(sem.select("doc_id", F.col("score").alias("semantic_score")), "doc_id", "left")
    rows = rows.join(pages, "doc_id", "left").join(ranks.select(F.col("id").alias("doc_id"), "rank"), "doc_id", "left")
    authority = F.coalesce("rank", F.lit(0.0))
    out = rows.select(
        "doc_id",
        F.coalesce("title", F.lit("Unknown")).alias("title"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("bm25_score", F.lit(0.0)).alias("bm25_score"),
        F.coalesce("semantic_score", F.lit(0.0)).alias("semantic_score"),
        F.round("rrf", 9).alias("rrf_score"),
        F.round(authority, 9).alias("page_rank"),
        F.round(100 * F.col("rrf") + 5 * authority, 6).alias("score"),
    )
    return out.orderBy(F.desc("score"), "doc_id").limit(k)


_TERMS = query_terms(QUERY)
_LEX = f"""{query_cte(_TERMS, by_df=True)}, lex0 as (select doc_id, round(bm25 + coalesce(p, 0), 6) as score from bm left join prox using (doc_id) where n_terms = {len(_TERMS)} or not exists (select 1 from bm where n_terms = {len(_TERMS)})),
    lex as (select *, row_number() over (order by score desc, doc_id) as rank from lex0),
    {similarity_cte(QUERY)}, sem1 as (select doc_id, round(sim, 6) as score from sem), semr as (select *, row_number() over (order by score desc, doc_id) as rank from sem1 order by rank limit 50),
    fused as (select coalesce(a.doc_id, b.doc_id) as doc_id, a.rank as rank_a, b.rank as rank_b, a.score as bm25_score, b.score as semantic_score,
        coalesce(1::double / (60 + a.rank), 0) + coalesce(1::double / (60 + b.rank), 0) as rrf from lex a full join semr b on a.doc_id = b.doc_id)"""


@query(f"with {_LEX} select doc_id, rank_a, rank_b, round(rrf, 9) as rrf from fused")
def rrf_fusion(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lex = ranking.ranked_all(lexical_rows(indexed(spark, sf_dir), QUERY), "score", "doc_id")
    sem = ranking.ranked(vector.text_similarity(docs, QUERY).select("doc_id", F.round("similarity", 6).alias("score")), "score", "doc_id", 50)
    return ranking.reciprocal_ranks(lex, sem, "doc_id").withColumn("rrf", F.round("rrf", 9))


@query(f"""{_ranks(', ' + _LEX)} select doc_id, coalesce(nullif(regexp_extract(html, '{TITLE}', 1), ''), 'Unknown') as title, coalesce(url, '') as url, coalesce(bm25_score, 0) as bm25_score, coalesce(semantic_score, 0) as semantic_score,
    round(rrf, 9) as rrf_score, round(coalesce(ranks.rank, 0), 9) as page_rank, round(100 * rrf + 5 * coalesce(ranks.rank, 0), 6) as score
    from fused left join pages on page_id = doc_id left join ranks on ranks.id = doc_id order by score desc, doc_id limit 20""")
def hybrid_search(spark, sf_dir):
    return search(spark, sf_dir, QUERY)


@query(f"""{_ranks(', ' + query_cte(_TERMS, 'nostop'))}, best as (select doc_id, round(bm25, 6) as bm25 from bm order by round(bm25, 6) desc, doc_id limit 20)
    select doc_id, bm25, round(coalesce(rank, 0), 9) as page_rank, round(bm25 + 10 * coalesce(rank, 0), 6) as score from best left join ranks on id = doc_id""")
def bm25_pagerank(spark, sf_dir):
    """Cut to the best by BM25 before ranks are added, and not sorted again."""
    q = indexed(spark, sf_dir, "nostop").ask(_TERMS, "nostop")
    best = q.any_of().select("doc_id", F.round(q.bm25(), 6).alias("bm25")).orderBy(F.desc("bm25"), "doc_id").limit(20)
    ranks = authorities(spark, sf_dir)
    authority = F.coalesce("rank", F.lit(0.0))
    return best.join(ranks.select(F.col("id").alias("doc_id"), "rank"), "doc_id", "left").select("doc_id", "bm25", F.round(authority, 9).alias("page_rank"), F.round(F.col("bm25") + 10 * authority, 6).alias("score"))
