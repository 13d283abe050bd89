"""Vector queries over ``embeddings`` and over texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import vector
from quarry.plans.base import query
from quarry.sources.tables import table

BIGRAMS = """ch as (select doc_id, string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]', ' ', 'g'), '') as c from documents),
    bp as (select doc_id, unnest(c[:-2]) as a, unnest(c[2:]) as b from ch),
    bg as (select doc_id, (31 * ascii(a) + ascii(b)) % 64 as bucket, count(*) as n from bp where not (a = ' ' and b = ' ') and a <> '' and b <> '' group by 1, 2)"""
_VEC = "ev as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings)"


def similarity_cte(text: str) -> str:
    weights = vector.query_weights(text)
    rows = ", ".join(f"({k}, {w!r}::double)" for k, w in sorted(weights.items()))
    return f"{BIGRAMS}, qw(bucket, w) as (values {rows}), sem as (select doc_id, sum(n * coalesce(w, 0)) / sqrt(sum(n * n)) as sim from bg left join qw using (bucket) group by doc_id)"


@query(f"with {BIGRAMS} select doc_id, bucket::int as bucket, round(n / sqrt(sum(n * n) over (partition by doc_id)), 6) as weight from bg")
def ngram_embedding(spark, sf_dir):
    return vector.embedded(table(spark, sf_dir, "documents")).select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


@query(f"with {similarity_cte('tion rewh')} select doc_id, round(sim, 6) as similarity from sem order by similarity desc, doc_id limit 50")
def semantic_search(spark, sf_dir):
    s = vector.text_similarity(table(spark, sf_dir, "documents"), "tion rewh")
    return s.select("doc_id", F.round("similarity", 6).alias("similarity")).orderBy(F.desc("similarity"), "doc_id").limit(50)


@query(f"with {_VEC} select a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) as similarity from ev a, (select v from ev where vec_id = 0) b")
def cosine_similarity(spark, sf_dir):
    """Every vector against that of id 0, which goes into the plan as a literal; no vector of id 0, no rows."""
    e = table(spark, sf_dir, "embeddings")
    one = e.where("vec_id = 0").select("embedding").first()
    literal = F.array(*[F.lit(float(x)) for x in one["embedding"]]) if one else F.lit(None).cast("array<double>")
    return e.where(F.lit(one is not None)).select("vec_id", F.round(vector.cosine(F.col("embedding"), literal), 6).alias("similarity"))


@query(f"with {_VEC} select b.vec_id, round(list_cosine_similarity(a.v, b.v), 6) as similarity from ev a join ev b on a.vec_id = 0 and b.vec_id <> 0 order by similarity desc, b.vec_id limit 10")
def knn_exact(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return vector.nearest(e, e.where("vec_id = 0"), 10).select("vec_id", "similarity")


@query(f"""with {_VEC}, s as (select a.vec_id as query_id, b.vec_id, round(list_cosine_similarity(a.v, b.v), 6) as similarity from ev a join ev b on a.vec_id % 20 = 0 and b.vec_id <> a.vec_id),
    r as (select *, row_number() over (partition by query_id order by similarity desc, vec_id) as rank from s) select query_id, vec_id, similarity, rank from r where rank <= 10""")
def knn_batch(spark, sf_dir):
    """The queries are the rows whose id is divisible by 20, against all rows."""
    e = table(spark, sf_dir, "embeddings")
    return vector.nearest(e, e.where("vec_id % 20 = 0"), 10)


@query()
def knn_lsh(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return vector.nearest_lsh(e, e.where("vec_id % 20 = 0"), 10)


@query()
def ann_bucket_stats(spark, sf_dir):
    sizes = vector.signatures(table(spark, sf_dir, "embeddings")).groupBy("table", "code").agg(F.count("*").alias("n"))
    return sizes.groupBy("table").agg(F.count("*").alias("buckets"), F.max("n").alias("largest"), F.round(F.avg("n"), 6).alias("mean"))
