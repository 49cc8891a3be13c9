"""Search by the rarest token first, against plain Python."""

import random

from traceloom.operators import search


def test_queries_start_from_their_rarest_token(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    spans = [(f"s{i}", "the " + " ".join(r.choice(words) for _ in range(r.randint(0, 12)))) for i in range(400)] + [("e", ""), ("n", None), ("s1", "twice listed")]
    queries = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 3)))) for i in range(80)] + [(100, "the"), (101, "The the"), (102, "nowhere the"), (103, ""), (104, None), (105, "twice")]
    tokens = search.index_spans(spark.createDataFrame([(s, "f", t) for s, t in spans[:-1]], "span_id string, field string, text string"))
    got = sorted(tuple(x) for x in search.match_queries(tokens, spark.createDataFrame(queries, "query_id int, text string")).collect())
    held = {s: set((t or "").lower().split()) for s, t in spans[:-1]}
    want = sorted((q, s) for q, t in queries for s, ws in held.items() if (t or "").split() and set(t.lower().split()) <= ws)
    assert got == want


def test_diacritics_are_folded(spark):
    spans = spark.createDataFrame([("a", "f", "Café ÀÉÎÕÜ straße"), ("b", "f", "café"), ("c", "f", "cafes")], "span_id string, field string, text string")
    tokens = search.index_spans(spans)
    assert {r["span_id"] for r in search.match(tokens, ["CAFE"]).collect()} == {"a", "b"}
    assert {r["span_id"] for r in search.match(tokens, ["café", "aeiou"]).collect()} == {"a"}
    assert search.self_check(tokens, spans).first()["found"] == 3


def test_frequent_tokens_do_not_meet_all_spans(spark):
    spans = spark.range(2000).selectExpr("id AS span_id", "'f' AS field", "concat('common every rare', id) AS text")
    queries = spark.range(50).selectExpr("id AS query_id", "concat('common every rare', id * 7) AS text")
    got = search.match_queries(search.index_spans(spans), queries).collect()
    assert sorted((r["query_id"], r["span_id"]) for r in got) == [(i, i * 7) for i in range(50)]


def test_a_search_of_queries_reads_the_texts_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    tokens = spark.range(300).selectExpr("id AS span_id", "'text' AS field", "explode(array('a', concat('b', id % 3))) AS token").mapInArrow(count, "span_id long, field string, token string")
    asked = spark.createDataFrame([(1, "a b1"), (2, "a"), (3, "a none")], "query_id long, text string")
    got = search.match_queries(tokens, asked).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in got} == {1: 100, 2: 300} and seen.value == 600
