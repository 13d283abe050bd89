"""Secret scans with DataFrame functions only: fixed patterns, and character Markov models of random strings against ordinary
identifiers, compared by their log-likelihood ratio."""

from __future__ import annotations

import math
import random
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kind: (pattern, least length, group whose length counts). Kinds are listed in the order in which ties are put.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    "access": (r"AKIA[A-Z0-9]{12,}", 16, 0),  # a run that is too short holds no long one, so the bound may stand in the pattern
    "hex": (r"[0-9a-f]{32,}", 32, 0),
}
RANDOM = "random"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"
#: Runs of the alphabet that are long enough to be judged by the models.
CANDIDATE = r"[A-Za-z0-9+/_=.-]{20,}"
#: Parts of such runs between separators, judged on their own where the whole run is ordinary.
PIECE = r"[A-Za-z0-9+]{20,}"

_WORDS = """account action address agent amount archive array async backup balance batch binary block bridge buffer build bundle
cache call cancel chain channel check child client close cluster code color column command common compare config connect
content context control convert copy count create current cursor data debug default delete deploy depth detail device
digest directory display document domain download driver edge element email enable encode engine entry error event example
execute export factory field file filter final first flag folder format frame function gateway general global graph group
handle hash header height history host image import index info init input insert instance internal item iterator join
key language last layer layout left length level library limit line link list load local lock login main manager map mark
matrix member memory merge message meta method metric mode model module monitor month move name network next node note number
object offset open option order output owner package page parent parse part path pattern payment pending phone pixel plan
point policy pool port position prefix process product profile program project property protocol provider proxy public query
queue random range rate reader record region register release remote render report request reset resource response result
return right role root route row rule run sample save scale scan schedule schema scope score screen script search second
section select send sequence server service session set setting shape share sheet shift show side sign simple single size
sort source space split stack stage start state station status step stop storage store stream string style submit suffix
support switch symbol sync system table target task team template temp test text theme thread time title tool top total
trace track transfer tree trigger type unit update upload user utils valid value vector vendor version video view visit
volume wait watch weight widget width window word work worker write year zone the and that with for this from was are
une les des que pour dans avec entre mais sont elle ment tion eux ier der die und das nicht mit sich auch auf ein eine schen
lich ung keit los las del por con para como mente cion ado ar ezue""".split()


def samples(seed: int = 11, n: int = 4000) -> list[tuple[str, int]]:
    """Labelled samples: random strings (1) over the alphabets of keys and tokens, and ordinary identifiers (0) made of words."""
    rng, out = random.Random(seed), []
    hexes, alnum = "0123456789abcdef", ALPHABET[:62]
    for k in range(n):
        letters = (hexes, alnum, ALPHABET[:64], hexes.upper(), ALPHABET[:36].replace("abcdefghij", "") + "0123456789", alnum)[k % 6]
        out.append(("".join(rng.choice(letters) for _ in range(rng.randint(20, 48))), 1))
        words = [rng.choice(_WORDS) for _ in range(rng.randint(3, 6))]
        form = k % 8
        if form == 0:
            s = "_".join(words)
        elif form == 1:
            s = words[0] + "".join(w.capitalize() for w in words[1:])
        elif form == 2:
            s = "-".join(words)
        elif form == 3:
            s = ".".join(words)
        elif form == 4:
            s = "/".join(words) + rng.choice([".html", ".py", ".json", ""])
        elif form == 5:
            s = "".join(words)
        elif form == 6:
            s = "_".join(words).upper()
        else:
            s = rng.choice(["----------", "==========", "..........", "20240131-10.15", "2023-11-05", "3.14.15", "0000000000", "1000000"]) + "".join(words[:3]) + str(rng.randint(1, 99))
        out.append((s, 0))
    return out


@lru_cache(maxsize=4)
def train(labelled: tuple[tuple[str, int], ...], smoothing: float = 0.5) -> tuple[float, ...]:
    """First-order log-likelihood ratios, random against ordinary, of each pair of neighbouring characters of ALPHABET."""
    k = len(ALPHABET)
    at = {c: i for i, c in enumerate(ALPHABET)}
    counts = [[[smoothing] * k for _ in range(k)] for _ in range(2)]
    for s, label in labelled:
        for a, b in zip(s, s[1:], strict=False):
            counts[label][at[a]][at[b]] += 1
    out = []
    for i in range(k):
        sums = [sum(counts[c][i]) for c in (0, 1)]
        out += [round(math.log(counts[1][i][j] / sums[1]) - math.log(counts[0][i][j] / sums[0]), 6) for j in range(k)]
    return tuple(out)


def _array(values, kind: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def _matches(text: Column, pattern: str, group: int) -> Column:
    return F.when(text.rlike(pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(F.array().cast("array<string>"))


def _span_rows(text: str, pattern: str, whole: str) -> Column:
    """(start, end, index) of each match, in code points: gaps and matches alternate, so starts are running sums."""
    gaps = F.split(F.col(text), pattern, -1)
    walk = F.aggregate(
        F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), F.col(whole).alias("hit")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(x["gap"])).alias("start"), (acc["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("end")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(F.size(whole) > 0, walk).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def _at_least(n: int):
    return lambda x: F.length(x["m"]) >= n


def _as_span(no: int, kind: str):
    return lambda x: F.struct(x["s"]["start"].alias("start"), F.lit(no).alias("kind_no"), x["s"]["end"].alias("end"), F.lit(kind).alias("kind"))


def _covered(spans: Column) -> Column:
    """``t_`` with every code point inside of ``spans``, which are sorted, replaced by a blank."""
    walk = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.concat(
                acc["out"],
                F.array(
                    F.substring(F.col("t_"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))),
                    F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(s["start"], acc["at"]), F.lit(0))),
                ),
            ).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.array(F.substring(F.col("t_"), acc["at"] + 1, F.length("t_")))),
    )
    return F.array_join(walk, "")


def find(docs: DataFrame, ratios: tuple[float, ...] | None = None, threshold: float = 0.5, base_only: bool = False) -> DataFrame:
    """``docs`` with ``found``: an array of (start, kind_no, end, kind) of all spans by start, end exclusive, in code points.

    Base spans are leftmost non-overlapping matches of each kind. What they leave of a run of the alphabet is judged by its mean
    log-likelihood ratio for each character pair: over ``threshold`` nats the run is added as kind ``random``; where it is not,
    so are its pieces between separators that are over it, so that a key at the end of a path or beside another secret counts.
    No added span overlaps a base span. A null text is empty. No shuffle, no Python; work grows with the text.
    """
    ratios = ratios or train(tuple(samples()))
    out = docs.withColumn("t_", F.coalesce(F.col("text"), F.lit("")))
    spans = []
    for no, (kind, (pattern, least, group)) in enumerate(BASE.items()):
        out = out.withColumn(f"w_{kind}", _matches(F.col("t_"), pattern, 0))
        out = out.withColumn(f"s_{kind}", _span_rows("t_", pattern, f"w_{kind}"))
        measure = F.col(f"w_{kind}")
        if group:
            measure = F.when(F.size(f"w_{kind}") > 0, F.regexp_extract_all(F.col("t_"), F.lit(pattern), F.lit(group))).otherwise(F.col(f"w_{kind}"))
        kept = F.filter(F.arrays_zip(F.col(f"s_{kind}").alias("s"), measure.alias("m")), _at_least(least))
        spans.append(F.transform(kept, _as_span(no, kind)))
    out = out.withColumn("base_", F.concat(*spans))
    if not base_only:
        k = len(ALPHABET)
        index = [0] * 128
        for i, c in enumerate(ALPHABET):
            index[ord(c)] = i
        lut, cls = _array(ratios, "double"), _array(index, "int")
        # base spans are blanked, so runs end at them; places stay as they are
        out = out.withColumn("m_", F.when(F.size("base_") > 0, _covered(F.array_sort("base_"))).otherwise(F.col("t_")))
        out = out.withColumn("w_r", _matches(F.col("m_"), CANDIDATE, 0)).withColumn("s_r", _span_rows("m_", CANDIDATE, "w_r"))
        out = out.withColumn("w_p", _matches(F.col("m_"), PIECE, 0)).withColumn("s_p", _span_rows("m_", PIECE, "w_p"))

        def ratio(s: Column) -> Column:
            codes = F.transform(F.split(s, ""), lambda c: F.element_at(cls, F.ascii(c) + 1))
            pairs = F.zip_with(F.slice(codes, 1, F.length(s) - 1), F.slice(codes, 2, F.length(s) - 1), lambda a, b: F.element_at(lut, a * k + b + 1))
            return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / (F.length(s) - 1)

        telling = lambda s, w: F.filter(F.arrays_zip(F.col(s).alias("s"), F.col(w).alias("m")), lambda x: ratio(x["m"]) > threshold)
        out = out.withColumn("runs_", telling("s_r", "w_r"))
        apart = lambda x: ~F.exists("runs_", lambda r: (r["s"]["start"] <= x["s"]["start"]) & (r["s"]["end"] >= x["s"]["end"]))
        more = F.transform(F.concat("runs_", F.filter(telling("s_p", "w_p"), apart)), _as_span(len(BASE), RANDOM))
        out = out.withColumn("found", F.array_sort(F.concat("base_", more)))
    else:
        out = out.withColumn("found", F.array_sort("base_"))
    return out.drop("base_", "m_", "w_r", "s_r", "w_p", "s_p", "runs_", *[f"{p}_{kind}" for p in "ws" for kind in BASE])


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def scan(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random for every row of ``docs(doc_id, text)``; see ``find``."""
    found = find(docs.select("doc_id", "text"), **options)
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"] != RANDOM)
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"), count(RANDOM))


def redact(docs: DataFrame, mark: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``mark`` (overlapping spans by one mark).

    Other texts, null and empty ones among them, and all further columns, of any name, stay as they are; rows with a null doc_id
    and repeated rows are treated like all others; an empty table gives no rows. No shuffle, no Python.
    """
    found = find(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text"), **options)
    # where text between spans begins and ends; a span that begins before the end of the one before has no text before it
    walk = F.aggregate(
        "found",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), s["start"].alias("end"))))).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), F.length("t_").alias("end")))),
    )
    joined = F.array_join(F.transform(walk, lambda g: F.substring(F.col("t_"), g["start"] + 1, g["end"] - g["start"])), mark)
    text = F.when(F.size("found") > 0, joined).otherwise(F.col("text"))
    return found.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def oracle(threshold: float = 0.5) -> str:
    """The same rows in DuckDB's SQL, the models' ratios as a literal list."""
    quoted = {kind: pattern.replace("'", "''") for kind, (pattern, _, _) in BASE.items()}
    kinds = " union all ".join(
        f"select doc_id, {no} as no, '{kind}' as kind, string_split_regex(t, '{quoted[kind]}') as gaps, regexp_extract_all(t, '{quoted[kind]}') as hits, regexp_extract_all(t, '{quoted[kind]}', {group}) as parts, {least} as least from d"
        for no, (kind, (_, least, group)) in enumerate(BASE.items())
    )
    counts = ", ".join(f"count(*) filter (kind = '{kind}') as n_{kind}" for kind in [*BASE, RANDOM])
    spans = lambda p, k: (
        f"{p}s as (select doc_id, no, kind, least, unnest(gaps[1:len(hits)]) as gap, unnest(hits) as hit, unnest(parts) as part, unnest(range(len(hits))) as i from {k}),"
        f" {p}p as (select *, sum(length(gap) + length(hit)) over (partition by doc_id, no order by i) as stop from {p}s),"
        f" {p}spans_ as (select doc_id, no, kind, hit, part, least, (stop - length(hit))::bigint as start, stop::bigint as stop from {p}p)"
    )
    joined = "string_agg(kind || ':' || start || ':' || stop, ',' order by start, no)"
    return f"""
    with d as (select doc_id, coalesce(text, '') as t from documents),
    lut as (select {list(train(tuple(samples())))!r}::double[] as r),
    k as (select * from ({kinds}) where len(hits) > 0),
    {spans("", "k")},
    base as (select doc_id, no, kind, start, stop from spans_ where length(part) >= least),
    b as (select *, coalesce(max(stop) over (partition by doc_id order by start, no, stop rows between unbounded preceding and 1 preceding), 0) as upto from base),
    cover as (select doc_id, string_agg(substr(t, upto + 1, greatest(start - upto, 0)) || repeat(' ', greatest(stop - greatest(start, upto), 0)), '' order by start, no, stop) || substr(any_value(t), max(stop) + 1) as t from b join d using (doc_id) group by doc_id),
    m as (select doc_id, coalesce(c.t, d.t) as t from d left join cover c using (doc_id)),
    mk as ({" union all ".join(f"select doc_id, {no} as no, '{RANDOM}' as kind, string_split_regex(t, '{p}') as gaps, regexp_extract_all(t, '{p}') as hits, regexp_extract_all(t, '{p}') as parts, 0 as least from m where regexp_matches(t, '{p}')" for no, p in ((len(BASE), CANDIDATE), (len(BASE) + 1, PIECE)))}),
    {spans("m", "mk")},
    telling as (select x.* from mspans_ x, lut where list_sum(list_transform(range(1, length(hit)), lambda j: r[(strpos('{ALPHABET}', hit[j]) - 1) * {len(ALPHABET)} + strpos('{ALPHABET}', hit[j + 1])])) / (length(hit) - 1) > {threshold}),
    more as (select doc_id, {len(BASE)} as no, kind, start, stop from telling x where no = {len(BASE)} or not exists (select 1 from telling y where y.doc_id = x.doc_id and y.no = {len(BASE)} and y.start <= x.start and y.stop >= x.stop)),
    whole as (select doc_id, {joined} as spans, coalesce({joined} filter (no < {len(BASE)}), '') as base, {counts} from (select * from base union all select * from more) group by doc_id)
    select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, coalesce(n_random, 0) as n_random, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
    from d left join whole using (doc_id)"""
