"""Token search over spans, without a text column in the index."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import _cut, small

TOKEN = r"[\p{L}\p{N}]+"


def _latin() -> tuple[str, str]:
    """Letters whose decomposition is one ASCII letter and combining marks, and that letter."""
    found = {chr(c): unicodedata.normalize("NFD", chr(c)) for c in range(0xC0, 0x1F00)}
    found = {c: d[0] for c, d in found.items() if len(d) > 1 and d[0].isascii() and all(unicodedata.combining(x) for x in d[1:])}
    return "".join(found), "".join(found.values())


_MARKED, _PLAIN = _latin()


def folded(text):
    """Lower case without diacritics: the canonical decomposition's combining marks go."""
    return F.regexp_replace(F.lower(F.translate(text, _MARKED, _PLAIN)), r"[\x{0300}-\x{036F}]", "")


def token_list(text):
    return F.array_distinct(F.regexp_extract_all(folded(text), F.lit(TOKEN), F.lit(0)))


def index_spans(spans: DataFrame) -> DataFrame:
    """``span_id``, ``field``, ``token``, one row per distinct token of a span; a span's locator counts once."""
    once = spans.dropDuplicates(["span_id"])
    return once.select("span_id", "field", F.explode(token_list(F.col("text"))).alias("token"))


def write_index(tokens: DataFrame, table: str, path: str, buckets: int = 64) -> None:
    """Bucketed by token, so that a look-up reads one bucket and joins need no shuffle."""
    tokens.write.mode("overwrite").bucketBy(buckets, "token").sortBy("token").option("path", path).saveAsTable(table)


def match(tokens: DataFrame, terms: list[str], field: str | None = None) -> DataFrame:
    """Spans that hold every term (AND), in one field if asked."""
    wanted = sorted({"".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c)) for t in terms})
    found = tokens.filter(F.col("token").isin(wanted))
    if field:
        found = found.filter(F.col("field") == field)
    return found.groupBy("span_id").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted)).select("span_id")


def match_queries(tokens: DataFrame, queries: DataFrame) -> DataFrame:
    """X2 for a table of queries (query_id, text): the spans that hold all of a query's tokens.

    A query starts from the spans of its rarest token; its other tokens are looked up there, by (span, token),
    so a frequent token never meets all its spans.  A query with a token that no span holds is dropped at once.
    """
    terms = queries.select("query_id", F.explode(token_list(F.col("text"))).alias("token"))
    # texts are read and split once, and only the tokens of queries go on
    tokens = _cut(tokens.select("span_id", "token").join(small(terms.select("token").distinct()), "token", "left_semi"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("n"))
    met = terms.join(small(counts), "token", "left")
    first = met.groupBy("query_id").agg(F.count("*").alias("k"), F.count("n").alias("held"), F.min(F.struct("n", "token")).alias("first")).filter("held = k")
    start = tokens.join(first.select("query_id", "k", F.col("first.token").alias("token")), "token").select("query_id", "span_id", "k", "token")
    rest = start.filter("k > 1").alias("s").join(terms.alias("t"), F.expr("s.query_id = t.query_id and s.token <> t.token")).select("s.query_id", "s.span_id", "s.k", "t.token")
    hits = rest.join(tokens.select("span_id", "token"), ["span_id", "token"]).groupBy("query_id", "span_id", "k").agg(F.count("*").alias("n"))
    return start.filter("k = 1").select("query_id", "span_id").union(hits.filter("n = k - 1").select("query_id", "span_id"))


def orphans(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """C20: indexed spans without a locator row."""
    return tokens.select("span_id").distinct().join(spans.select("span_id"), "span_id", "left_anti")


def self_check(tokens: DataFrame, spans: DataFrame, sample: int = 20) -> DataFrame:
    """Q7: spans found by their own rarest token: checked and found."""
    rare = tokens.groupBy("token").agg(F.count("*").alias("n"))
    own = tokens.join(rare, "token").groupBy("span_id").agg(F.min_by("token", F.struct("n", "token")).alias("token")).orderBy(F.xxhash64("span_id")).limit(sample)
    hit = own.join(tokens.select("token", F.col("span_id").alias("span_")), "token").filter("span_id = span_").select("span_id").distinct()
    return own.join(hit.withColumn("hit", F.lit(1)), "span_id", "left").agg(F.count("*").alias("checked"), F.count("hit").alias("found"))
