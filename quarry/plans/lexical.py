"""Index, boolean, phrase and scoring queries over ``documents``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.functions.text import tokens_sql, vbyte_length_sql
from quarry.operators import index, lexical, stored
from quarry.plans.base import query
from quarry.session import once, shared_dir
from quarry.sources.tables import table

#: Terms of the example queries.
TWO, THREE, PHRASE, MISSING = ["tion", "re"], ["tion", "re", "ou"], ["re", "tion"], ["tion", "zzzz"]


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def indexed(spark, sf_dir, analyzer: str = "main") -> stored.StoredIndex:
    """The stored index of ``documents``, built by the first query of a session that needs it and again when the table has changed."""
    documents = docs(spark, sf_dir)
    where = once(documents, f"index-{analyzer}", lambda path: stored.build(documents, path, analyzer))
    return stored.StoredIndex(spark, where)


def tokens_cte(analyzer: str = "main") -> str:
    return f"""t as materialized (select doc_id, {tokens_sql("text", analyzer)} as ts from documents),
    tok as materialized (select doc_id, unnest(ts) as term, generate_subscripts(ts, 1) - 1 as pos from t),
    tf as materialized (select term, doc_id, count(*) as tf, list(pos order by pos) as positions from tok group by term, doc_id),
    df as materialized (select term, count(*) as df from tf group by term),
    st as (select count(*) as n, coalesce(sum(len(ts)), 0)::double / count(*) as avgdl from t)"""


def query_cte(terms: list[str], analyzer: str = "main", by_df: bool = False) -> str:
    """q: the query's terms; m: matches in order; prox: proximity; bm: BM25 of each matching document, with the number of its terms."""
    order = "coalesce(df.df, 0), q.qi" if by_df else "q.qi"
    return f"""{tokens_cte(analyzer)},
    q as (select unnest({terms!r}) as term, unnest(range({len(terms)})) as qi),
    qt as materialized (select doc_id, term, pos from tok where term in (select term from q)),
    m as materialized (select tf.doc_id, q.term, q.qi, row_number() over (partition by tf.doc_id order by {order}) as k from q join tf using (term) left join df on df.term = q.term),
    sp as (select a.doc_id, a.term as ta, b.term as tb, min(abs(x.pos - y.pos)) as s from m a join m b on a.doc_id = b.doc_id and b.k = a.k + 1
        join qt x on x.doc_id = a.doc_id and x.term = a.term join qt y on y.doc_id = b.doc_id and y.term = b.term group by 1, 2, 3),
    prox as materialized (select doc_id, sum(10::double / greatest(s, 1)) as p from sp group by doc_id),
    bm as materialized (select tf.doc_id, count(distinct q.term) as n_terms, sum(ln((st.n - df.df + 0.5::double) / (df.df + 0.5::double) + 1) * (tf.tf * 2.5::double) / (tf.tf + 1.5::double * (0.25::double + 0.75::double * len(t.ts) / st.avgdl))) as bm25,
        sum(tf.tf) as tfs, sum(tf.tf * ln(st.n::double / df.df)) as tfidf, sum((1 + ln(tf.tf)) * ln(st.n::double / df.df)) as tfidf_log, list(q.term order by q.qi) as terms
        from q join tf using (term) join df using (term) join t using (doc_id) cross join st group by tf.doc_id)"""


@query(f"with {tokens_cte()} select (select count(*) from t) as n_docs, sum(tf)::bigint as n_tokens, count(*) as n_postings, count(distinct term) as n_terms from tf")
def index_build(spark, sf_dir):
    """Writes a stored index, whatever is stored already, and counts what is in it."""
    built = stored.build(docs(spark, sf_dir), f"{shared_dir(spark)}/settled/index-{uuid.uuid4().hex}")
    return built.postings.where(F.col("term") != stored.MARK).agg(F.lit(built.n).cast("long").alias("n_docs"), F.sum("tf").alias("n_tokens"), F.count("*").alias("n_postings"), F.count_distinct("term").alias("n_terms"))


@query(f"with {tokens_cte()} select term, doc_id, tf, array_to_string(positions, ',') as positions from tf")
def inverted_index(spark, sf_dir):
    p = index.postings(docs(spark, sf_dir))
    return p.select("term", "doc_id", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query(f"with {tokens_cte()} select doc_id, pos::int as pos, term from tok")
def token_positions(spark, sf_dir):
    return index.token_rows(docs(spark, sf_dir))


@query(f"with {tokens_cte()} select count(*) as n_docs, sum(len(ts))::bigint as n_tokens, round(sum(len(ts))::double / count(*), 6) as avg_length from t")
def corpus_stats(spark, sf_dir):
    return index.corpus_stats(docs(spark, sf_dir)).select("n_docs", "n_tokens", F.round("avg_length", 6).alias("avg_length"))


@query(f"with {tokens_cte()} select term, df.df as df from df")
def vocabulary(spark, sf_dir):
    return index.document_frequencies(docs(spark, sf_dir))


@query(f"with {tokens_cte()} select doc_id, tf from tf where term = lower('Tion')")
def posting_list(spark, sf_dir):
    q = indexed(spark, sf_dir).ask(["Tion"])
    return q.any_of().select("doc_id", q.tf("tion").cast("long").alias("tf"))


@query(f"""with {tokens_cte()} select doc_id, tf, coalesce(nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), ''), 'Unknown') as title
    from tf left join pages on page_id = doc_id where term = 'tion'""")
def posting_list_titles(spark, sf_dir):
    q = indexed(spark, sf_dir).ask(["tion"])
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    titles = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.when(title != "", title).alias("title"))
    return q.any_of().select("doc_id", q.tf("tion").cast("long").alias("tf")).join(titles, "doc_id", "left").select("doc_id", "tf", F.coalesce("title", F.lit("Unknown")).alias("title"))


@query(f"with {query_cte(THREE, by_df=True)} select doc_id, round(bm25 + coalesce(p, 0), 6) as score, round(coalesce(p, 0), 6) as proximity_bonus from bm left join prox using (doc_id) where n_terms = 3")
def bool_and(spark, sf_dir):
    return lexical.bool_and(indexed(spark, sf_dir), THREE)


@query(f"with {query_cte(MISSING, 'strip')} select doc_id, round(tfidf, 6) as score from bm where n_terms = (select count(distinct term) from q join df using (term))")
def bool_and_lenient(spark, sf_dir):
    return lexical.bool_and_lenient(indexed(spark, sf_dir, "strip"), MISSING)


@query(f"with {tokens_cte('alnum')} select doc_id from tf where term = '{TWO[0]}' intersect select doc_id from tf where term = '{TWO[1]}'")
def bool_and_ids(spark, sf_dir):
    return indexed(spark, sf_dir, "alnum").ask(TWO, "alnum").all_of().select("doc_id")


@query(f"with {query_cte(THREE)} select doc_id, round(bm25 + coalesce(p, 0), 6) as score, round(coalesce(p, 0), 6) as proximity_bonus, array_to_string(terms, ',') as matched_terms from bm left join prox using (doc_id)")
def bool_or(spark, sf_dir):
    return lexical.bool_or(indexed(spark, sf_dir), THREE)


@query(f"with {query_cte(['tion', 'rewh', 'tion'], 'strip')} select doc_id, tfs::bigint as score, array_to_string(list_sort(list_distinct(terms)), ',') as matched_terms from bm")
def bool_or_tf(spark, sf_dir):
    q = indexed(spark, sf_dir, "strip").ask(["tion", "rewh", "tion"], "strip")
    return q.any_of().select("doc_id", q.tf_sum().cast("long").alias("score"), F.array_join(F.array_sort(q.matched()), ",").alias("matched_terms"))


@query(f"with {tokens_cte('strip')} select doc_id, 1::double as score from documents where doc_id not in (select doc_id from tf where term = 'tion')")
def bool_not(spark, sf_dir):
    return indexed(spark, sf_dir, "strip").none_of(["tion"]).select("doc_id", F.lit(1.0).alias("score"))


@query(f"""with {query_cte(PHRASE, by_df=True)}, ph as (select a.doc_id, count(*) as n_phrases from tok a join tok b on a.doc_id = b.doc_id and b.pos = a.pos + 1 where a.term = '{PHRASE[0]}' and b.term = '{PHRASE[1]}' group by 1)
    select doc_id, round(2 * (bm25 + coalesce(p, 0)), 6) as score, n_phrases, true as phrase_match from bm join ph using (doc_id) left join prox using (doc_id) where n_terms = 2""")
def phrase_query(spark, sf_dir):
    return lexical.phrase(indexed(spark, sf_dir), PHRASE)


@query(f"with {query_cte(MISSING)} select doc_id, round(bm25 + coalesce(p, 0), 6) as score, case when n_terms = 2 then 'and' else 'or' end as mode from bm left join prox using (doc_id) where n_terms = 2 or not exists (select 1 from bm where n_terms = 2)")
def bool_and_or_fallback(spark, sf_dir):
    return lexical.and_or_fallback(indexed(spark, sf_dir), MISSING)


def _top(q, score, k=10):
    return q.any_of().select("doc_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


@query(f"with {query_cte(THREE)} select doc_id, round(bm25, 6) as score from bm order by score desc, doc_id limit 10")
def bm25_topk(spark, sf_dir):
    q = indexed(spark, sf_dir).ask(THREE)
    return _top(q, q.bm25())


@query(f"with {query_cte(THREE, 'nostop')} select doc_id, round(bm25, 6) as score from bm order by score desc, doc_id limit 10")
def bm25_nostop(spark, sf_dir):
    q = indexed(spark, sf_dir, "nostop").ask(THREE, "nostop")
    return _top(q, q.bm25())


@query(f"with {query_cte(THREE, 'strip')} select doc_id, round(tfidf, 6) as score from bm")
def tfidf_raw(spark, sf_dir):
    q = indexed(spark, sf_dir, "strip").ask(THREE, "strip")
    return q.any_of().select("doc_id", F.round(q.tfidf(), 6).alias("score"))


@query(f"with {query_cte(THREE, 'alnum')} select doc_id, round(tfidf_log, 6) as score from bm order by score desc, doc_id limit 10")
def tfidf_log(spark, sf_dir):
    q = indexed(spark, sf_dir, "alnum").ask(THREE, "alnum")
    return _top(q, q.tfidf(log_tf=True))


@query(f"with {query_cte(THREE)} select doc_id, round(p, 6) as bonus from prox")
def proximity_bonus(spark, sf_dir):
    q = indexed(spark, sf_dir).ask(THREE)
    return q.any_of().select("doc_id", F.round(q.proximity(q.distinct), 6).alias("bonus")).where("bonus > 0")


@query(f"""with {tokens_cte()}, g as (select term, doc_id - coalesce(lag(doc_id) over (partition by term order by doc_id), 0) as gap from tf)
    select term, count(*) as n_postings, count(*) * 8 as raw_bytes, sum({vbyte_length_sql("gap")})::bigint as gap_bytes from g group by term""")
def postings_vbyte_size(spark, sf_dir):
    rows = index.analyzed(docs(spark, sf_dir)).select(F.explode(F.array_distinct("ts")).alias("term"), "doc_id")
    return index.posting_sizes(rows)


@query(f"""with {tokens_cte()}, r as (select term, doc_id, row_number() over (partition by term order by doc_id) - 1 as idx, count(*) over (partition by term) as n from tf)
    select term, idx, doc_id from r where idx % floor(sqrt(n))::bigint = 0""")
def skip_pointers(spark, sf_dir):
    return index.skip_pointers(index.analyzed(docs(spark, sf_dir)).select(F.explode(F.array_distinct("ts")).alias("term"), "doc_id"))


@query(f"""with {tokens_cte()}, pre as (select distinct substr(term, 1, unnest(range(1, len(term) + 1))) as p from df)
    select (select count(*) + 1 from pre) as trie_nodes, (select count(*) from df) as n_terms, st.n as n_docs, round(st.avgdl, 6) as avg_length from st""")
def engine_stats(spark, sf_dir):
    from quarry.operators.words import prefixes

    terms = index.frequencies(docs(spark, sf_dir))
    nodes = prefixes(terms).agg((F.count("*") + 1).alias("trie_nodes")).select("trie_nodes").scalar()
    n = terms.agg(F.count("*").alias("n")).select("n").scalar()
    return index.corpus_stats(docs(spark, sf_dir)).select(nodes.alias("trie_nodes"), n.alias("n_terms"), "n_docs", F.round("avg_length", 6).alias("avg_length"))
