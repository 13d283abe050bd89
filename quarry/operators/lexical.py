"""Boolean, phrase, BM25 and TF-IDF queries.

A query names a handful of terms. Over a table of documents nothing is exploded and no text is shuffled: one pass writes, for
each document that matches, its length and the positions of the query's terms, and observes the corpus figures meanwhile. A stored
index gives the same small table from the postings of the terms alone. Scores are then column expressions over that table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quarry.operators.index import analyzed
from quarry.session import settle

K1, B, PROXIMITY = 1.5, 0.75, 10.0


@dataclass
class Corpus:
    """Figures that are observed in the pass over the corpus: a row of constant size."""

    n: int
    total: int
    df: dict[str, int]

    @property
    def average(self) -> float:
        return self.total / self.n if self.n else 0.0


class TermQuery:
    """A query over ``docs(doc_id, text)``; documents may have nulls, and a document without tokens matches nothing."""

    def __init__(self, docs: DataFrame, terms: list[str], analyzer: str = "main"):
        self.terms = [t.lower() for t in terms]
        self.distinct = list(dict.fromkeys(self.terms))
        wanted = F.array(*[F.lit(t) for t in self.distinct])
        hits = F.filter(F.transform("ts", lambda x, i: F.when(x.isin(*self.distinct), F.struct(x.alias("x"), i.alias("i")))), lambda h: h.isNotNull())
        some = analyzed(docs, analyzer).select("doc_id", F.size("ts").alias("dl"), F.when(F.arrays_overlap("ts", wanted), hits).alias("hits"))
        at = lambda t: F.coalesce(F.transform(F.filter("hits", lambda h: h["x"] == t), lambda h: h["i"]), F.array().cast("array<int>"))
        places = some.select("doc_id", "dl", *[at(t).alias(f"p{k}") for k, t in enumerate(self.distinct)])
        seen, found = Observation(), F.lit(False)
        for t in self.distinct:
            found = found | self.has(t)
        each = [F.count_if(self.has(t)).alias(f"df{k}") for k, t in enumerate(self.distinct)]
        self.places = settle(places.observe(seen, F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total"), *each).where(found), "places")
        figures = seen.get
        self.corpus = Corpus(figures["n"], figures["total"], {t: figures[f"df{k}"] for k, t in enumerate(self.distinct)})

    def pos(self, term: str) -> Column:
        return F.col(f"p{self.distinct.index(term)}")

    def tf(self, term: str) -> Column:
        return F.size(self.pos(term))

    def has(self, term: str) -> Column:
        return self.tf(term) > 0

    def rarest_first(self) -> list[str]:
        """Terms by document frequency, ties as in the query; so neighbours in this order are asked for, as in conjunctions."""
        return sorted(self.terms, key=lambda t: self.corpus.df[t])

    def any_of(self) -> DataFrame:
        return self.places

    def all_of(self, lenient: bool = False) -> DataFrame:
        """Documents with all terms; ``lenient`` ignores terms that no document has."""
        known = [t for t in self.distinct if self.corpus.df[t] or not lenient]
        out = self.places.where(F.lit(bool(known)))
        for t in known:
            out = out.where(self.has(t))
        return out

    def bm25(self) -> Column:
        """Terms that a query repeats count again."""
        score, c = F.lit(0.0), self.corpus
        for t in self.terms:
            df = c.df[t]
            idf = F.log(F.lit((c.n - df + 0.5) / (df + 0.5) + 1.0))
            tf = self.tf(t).cast("double")
            norm = 1.0 - B + B * F.col("dl") / F.lit(c.average or 1.0)
            score = score + F.when(self.has(t), idf * (tf * (K1 + 1.0)) / (tf + K1 * norm)).otherwise(0.0)
        return score

    def tfidf(self, log_tf: bool = False) -> Column:
        score, c = F.lit(0.0), self.corpus
        for t in self.terms:
            if c.df[t]:
                tf = self.tf(t).cast("double")
                score = score + F.when(self.has(t), (1.0 + F.log(tf) if log_tf else tf) * F.log(F.lit(c.n / c.df[t]))).otherwise(0.0)
        return score

    def tf_sum(self) -> Column:
        out = F.lit(0)
        for t in self.terms:
            out = out + self.tf(t)
        return out

    def matched(self, order: list[str] | None = None) -> Column:
        """The matched terms, in the order of the query."""
        return F.filter(F.array(*[F.when(self.has(t), F.lit(t)) for t in order or self.distinct]), lambda t: t.isNotNull())

    def proximity(self, order: list[str]) -> Column:
        """Ten over the least distance (one at least) of each two matched terms that follow each other in ``order``, summed."""
        lists = F.filter(F.array(*[self.pos(t) for t in order]), lambda p: F.size(p) > 0)
        n = F.size(lists)
        pairs = F.zip_with(F.slice(lists, 1, F.greatest(n - 1, F.lit(0))), F.slice(lists, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.lit(PROXIMITY) / F.greatest(least_distance(a, b), F.lit(1)))
        return F.when(n > 1, F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)

    def phrase(self) -> Column:
        """How often the terms stand side by side: offsets are subtracted and the lists intersected, by hashing."""
        run = self.pos(self.terms[0])
        for i, t in enumerate(self.terms[1:], 1):
            run = F.array_intersect(run, F.transform(self.pos(t), _less(i)))
        return F.size(run)


def ask(source, terms: list[str], analyzer: str = "main") -> TermQuery:
    """``source`` is a table of documents, read whole, or a stored index, which looks the terms up."""
    return TermQuery(source, terms, analyzer) if isinstance(source, DataFrame) else source.ask(terms, analyzer)


def _less(i: int):
    return lambda p: p - i


def none_of(docs: DataFrame, terms: list[str], analyzer: str = "main") -> DataFrame:
    """Documents without any of the terms: a filter."""
    return analyzed(docs, analyzer).where(~F.arrays_overlap("ts", F.array(*[F.lit(t.lower()) for t in terms]))).select("doc_id")


def least_distance(a: Column, b: Column) -> Column:
    """The least distance of two lists of positions: one walk over both, merged."""
    side = lambda p, s: F.transform(p, lambda x: F.struct(x.alias("p"), F.lit(s).alias("s")))
    none = F.lit(-(1 << 30))
    step = lambda acc, x: F.struct(
        F.when(x["s"] == 0, x["p"]).otherwise(acc["a"]).alias("a"),
        F.when(x["s"] == 1, x["p"]).otherwise(acc["b"]).alias("b"),
        F.least(acc["best"], x["p"] - F.when(x["s"] == 0, acc["b"]).otherwise(acc["a"])).alias("best"),
    )
    start = F.struct(none.alias("a"), none.alias("b"), F.lit(1 << 30).alias("best"))
    return F.aggregate(F.sort_array(F.concat(side(a, 0), side(b, 1))), start, step, lambda acc: acc["best"])


def _scored(rows: DataFrame, score: Column, **more: Column) -> DataFrame:
    return rows.select("doc_id", F.round(score, 6).alias("score"), *[c.alias(n) for n, c in more.items()])


def bool_and(source, terms: list[str]) -> DataFrame:
    """(doc_id, score, proximity_bonus): all terms or nothing; BM25 and proximity of terms from the rarest on."""
    q = ask(source, terms)
    near = q.proximity(q.rarest_first())
    return _scored(q.all_of(), q.bm25() + near, proximity_bonus=F.round(near, 6))


def bool_and_lenient(source, terms: list[str]) -> DataFrame:
    """(doc_id, score): terms that no document has are ignored; TF-IDF over the analyzer that deletes punctuation."""
    q = ask(source, terms, "strip")
    return _scored(q.all_of(lenient=True), q.tfidf())


def bool_or(source, terms: list[str]) -> DataFrame:
    """(doc_id, score, proximity_bonus, matched_terms)."""
    q = ask(source, terms)
    near = q.proximity(q.distinct)
    return _scored(q.any_of(), q.bm25() + near, proximity_bonus=F.round(near, 6), matched_terms=F.array_join(q.matched(), ","))


def phrase(source, terms: list[str]) -> DataFrame:
    """(doc_id, score, n_phrases, phrase_match): terms side by side; twice the score of the conjunction."""
    q = ask(source, terms)
    near = q.proximity(q.rarest_first())
    rows = q.all_of().withColumn("n_phrases", q.phrase()).where("n_phrases > 0")
    return _scored(rows, 2 * (q.bm25() + near), n_phrases=F.col("n_phrases").cast("long"), phrase_match=F.lit(True))


def and_or_fallback(source, terms: list[str]) -> DataFrame:
    """(doc_id, score, mode): the conjunction; where it is empty, the disjunction. No action decides, the plan does."""
    q = ask(source, terms)
    everything, some = q.all_of(), q.any_of()
    both = q.bm25() + q.proximity(q.rarest_first())
    first = everything.select("doc_id", F.round(both, 6).alias("score"), F.lit("and").alias("mode"))
    empty = everything.agg((F.count("*") == 0).alias("e")).select("e").scalar()
    second = some.where(empty).select("doc_id", F.round(q.bm25() + q.proximity(q.distinct), 6).alias("score"), F.lit("or").alias("mode"))
    return first.unionByName(second)
