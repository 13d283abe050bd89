"""Column functions over texts: tokenizers, hashes, sizes, highlighting and substring search. All of them run inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words of the main analyzer.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with",
    "by", "from", "up", "about", "into", "through", "during", "is", "are", "was",
    "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will",
    "would", "could", "should", "may", "might", "shall", "can", "need", "dare",
    "ought", "used", "it", "its", "this", "that", "these", "those", "i", "we", "you",
    "he", "she", "they", "me", "us", "him", "her", "them", "my", "our", "your", "his",
    "their", "what", "which", "who", "when", "where", "why", "how", "all", "each",
    "both", "few", "more", "most", "other", "some", "such", "than", "too", "very",
)

#: Analyzer: (what is deleted first, what is a token). Tokens have two characters at least; only ``main`` drops stop words.
ANALYZERS = {
    "main": ("", "[a-z0-9_]{2,}"),
    "nostop": ("", "[a-z0-9_]{2,}"),
    "strip": (r"[^a-z0-9_ \t\n\x0B\f\r]", "[a-z0-9_]{2,}"),
    "alnum": ("", "[a-z0-9]{2,}"),
}


def tokens(text: Column, analyzer: str = "main") -> Column:
    """The tokens of a text as an array; a null text has none."""
    delete, pattern = ANALYZERS[analyzer]
    lowered = F.lower(F.coalesce(text, F.lit("")))
    if delete:
        lowered = F.regexp_replace(lowered, delete, "")
    found = F.regexp_extract_all(lowered, F.lit(pattern), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*STOP_WORDS)) if analyzer == "main" else found


def tokens_sql(text: str = "text", analyzer: str = "main") -> str:
    """The same tokens in DuckDB's SQL."""
    delete, pattern = ANALYZERS[analyzer]
    lowered = f"lower(coalesce({text}, ''))"
    if delete:
        lowered = f"regexp_replace({lowered}, '{delete}', '', 'g')"
    found = f"regexp_extract_all({lowered}, '{pattern}')"
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"list_filter({found}, lambda w: w not in ({stops}))" if analyzer == "main" else found


def query_terms(query: str) -> list[str]:
    """A query's terms: outer quotes go, white space splits, terms have two characters at least; nothing else is removed."""
    return [t for t in query.strip().strip('"').lower().split() if len(t) > 1]


def is_phrase(query: str) -> bool:
    return query.startswith('"') and query.endswith('"')


def index_text(content: Column, title: Column, keywords: Column) -> Column:
    """Content, title and keywords in the order that defines positions."""
    return F.concat_ws(" ", content, title, F.concat_ws(" ", keywords))


def hash32(x: Column, part: int = 0) -> Column:
    """An unsigned 32-bit hash that every engine can compute: eight hex digits of the MD5, from digit ``8 * part``."""
    return F.conv(F.substring(F.md5(x.cast("binary")), 8 * part + 1, 8), 16, 10).cast("long")


def hash32_sql(x: str, part: int = 0) -> str:
    return f"('0x' || substr(md5({x}), {8 * part + 1}, 8))::bigint"


def djb2(x: Column) -> Column:
    """DJB2 over code points, modulo 2**32."""
    start = F.lit(5381).cast("long")
    return F.aggregate(F.split(x, ""), start, lambda h, c: F.when(c == "", h).otherwise((h * 33 + F.ascii(c)) % (1 << 32)))


def vbyte_length(n: Column) -> Column:
    """Bytes of a non-negative integer at seven bits a byte."""
    out = F.lit(9)
    for k in range(8, 0, -1):
        out = F.when(n < (1 << (7 * k)), F.lit(k)).otherwise(out)
    return out


def vbyte_length_sql(n: str) -> str:
    return "case " + " ".join(f"when {n} < {1 << (7 * k)} then {k}" for k in range(1, 9)) + " else 9 end"


def highlight(text: Column, terms: list[str]) -> Column:
    """Marks every occurrence of a term, in any letter case; terms are literal text."""
    if not terms:
        return text
    return F.regexp_replace(text, "(?i)(" + "|".join(re.escape(t) for t in terms) + ")", "<mark>$1</mark>")


def substring_positions(text: Column, pattern: Column) -> Column:
    """All start offsets (from 0, overlaps included) of ``pattern`` in ``text``; an empty pattern is nowhere.

    The text is split before each match, in one pass: the rest behind the last match is read once, and lengths add up to places.
    """
    pieces = F.split(text, F.concat(F.lit("(?=\\Q"), pattern, F.lit("\\E)")), -1)
    # a match at offset 0 begins the first piece, any other one begins a later piece
    walk = F.aggregate(
        F.slice(pieces, 1, F.size(pieces) - 1),
        F.struct(F.lit(0).alias("at"), F.when(F.startswith(text, pattern), F.array(F.lit(0))).otherwise(F.array().cast("array<int>")).alias("out")),
        lambda acc, piece: F.struct((acc["at"] + F.length(piece)).alias("at"), F.concat(acc["out"], F.array(acc["at"] + F.length(piece))).alias("out")),
        lambda acc: acc["out"],
    )
    return F.when((F.length(pattern) == 0) | ~F.contains(text, pattern), F.array().cast("array<int>")).otherwise(walk)


def substring_summary(text: Column, pattern: str) -> Column:
    """(n, first_start, last_start) of the places of ``pattern``, overlaps included, without a list of places; nulls where there is none."""
    size, p = len(pattern), F.lit(pattern)
    if any(pattern.endswith(pattern[:k]) for k in range(1, size)):  # matches can overlap
        n = F.regexp_count(text, F.lit(f"(?=\\Q{pattern}\\E)")).cast("long")
    else:
        n = F.floor((F.length(text) - F.length(F.replace(text, p, F.lit("")))) / size).cast("long")
    first = F.instr(text, pattern) - 1
    last = F.length(text) - F.instr(F.reverse(text), pattern[::-1]) - size + 1
    return F.when(F.contains(text, p) & F.lit(size > 0), F.struct(n.alias("n"), first.alias("first_start"), last.alias("last_start")))
