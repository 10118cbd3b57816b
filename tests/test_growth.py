"""Searches and counts do the work of a chunk once, where its words are made."""

import re

import pytest
from pyspark.sql import functions as F

from marginalia.operators import keywords
from marginalia.plans import checked_code

FIELDS = (("content", 0.4),)
TEXTS = ["one two three one four", "two one two three", "three four three", "one one two", "four", None]


def store(spark, *more):
    rows = [*enumerate(TEXTS, 1), *more]
    return spark.createDataFrame(rows, "id long, content string").repartition(3)


def found(hits):
    rows = [(r["query_id"], r["id"], r["keyword_rank"]) for r in hits.collect()]
    return sorted(rows, key=lambda row: (row[0], row[1] is None, row[1] or 0))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_added_up_per_chunk_where_they_are_made(spark):
    rows = keywords.build_postings(store(spark), False, FIELDS)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert plan_of(rows.groupBy("id", "term").count()).count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_a_term_is_added_up_once_for_all_queries(spark, monkeypatch):
    queries = spark.createDataFrame([(i, f"one or two or w{i}") for i in range(5)], "query_id int, query string")
    seen = []
    plain = keywords.sum_ranks
    monkeypatch.setattr(keywords, "sum_ranks", lambda hits: seen.append(hits.count()) or plain(hits))
    rows = keywords.build_postings(store(spark), False, FIELDS)
    ranks = found(keywords.keyword_search(rows, queries, 9))
    assert seen == [5 * 6] and ranks[:3] == [(0, 1, 1.2), (0, 2, 1.2), (0, 4, 1.2)]


@pytest.mark.parametrize("again", [(), ((1, "z z z z two"), (None, "one two"), (None, "z z z two one"))])
def test_words_that_are_no_part_of_their_phrase_are_not_gathered(spark, monkeypatch, again):
    asked = ['"one two"', '"two three" OR four -one', "four -two", '"one two" OR one -four', "one -one", '"two one two" OR -four']
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    chunks = store(spark, *again)
    gathered = []
    covers = keywords.rank_hits

    def noted(hits, *more):
        gathered.append(hits.filter("query_id < 3 and id is not null and id <> 1").count())
        return covers(hits, *more)

    monkeypatch.setattr(keywords, "rank_hits", noted)
    plain = keywords.build_postings(chunks, False, FIELDS)
    pruned = keywords.build_postings(chunks, False, FIELDS, neighbours=True)
    assert sorted(map(str, plain.collect())) == sorted(map(str, pruned.select(plain.columns).collect()))
    before = found(keywords.keyword_search(plain, queries, 9))
    # Without parts, every word is gathered and ranked by its covers.
    with monkeypatch.context() as whole:
        whole.setattr(keywords, "_one_each", lambda units: F.lit(False))
        assert found(keywords.keyword_search(plain, queries, 9)) == before
    assert found(keywords.keyword_search(pruned, queries, 9)) == before
    # "one two" in chunks 2 and 4, "two three" in chunk 2.
    assert gathered[-1] == 6 < gathered[0] and {r[0] for r in before} == {0, 1, 2, 3, 5}


def test_stems_are_made_of_distinct_terms(spark):
    vocabulary = keywords.build_vocabulary(keywords.build_postings(store(spark), True, FIELDS))
    asked = spark.createDataFrame([(1, "one")], "query_id int, key string")
    plan = plan_of(asked.join(vocabulary, asked["key"] == vocabulary["stem"]))
    assert re.search(r"ArrowEvalPython[\s\S]*HashAggregate", plan) and not re.search(
        r"HashAggregate(?![\s\S]*ArrowEvalPython[\s\S]*HashAggregate)[\s\S]*ArrowEvalPython", plan
    )


@pytest.mark.parametrize("most", [500_000, 0])
def test_stems_are_counted_per_chunk(spark, monkeypatch, most):
    monkeypatch.setattr(keywords, "MOST_BROADCAST", most)
    chunks = spark.createDataFrame(
        [(1, "run runs running"), (2, "runs cat"), (2, "running"), (None, "cats run")], "id long, content string"
    )
    totals = keywords.stem_totals(keywords.build_postings(chunks, True, (("content", 0.5),)))
    rows = {tuple(r) for r in totals.collect()}
    assert rows == {("run", 6, 2, 3, 3.0), ("cat", 2, 1, 2, 1.0)}


def test_files_are_scanned_once(spark, monkeypatch):
    read = spark.sparkContext.accumulator(0)
    files = spark.createDataFrame(
        [(f"c{i}.ts", f"export class C{i} {{\n  m(a: string): string {{\n    return a;\n  }}\n}}\n") for i in range(6)],
        "filepath string, content string",
    )

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(checked_code, "_ts_files", lambda spark, sf_dir: files.mapInArrow(counted, files.schema))
    rows = checked_code.chunk_parents(spark, "").collect()
    # Once for the entities, once for the documents.
    assert read.value == 2 * 6 and len(rows) == 12
    assert {(r["entity_name"], r["parameters"]) for r in rows} == {*((f"C{i}", None) for i in range(6)), ("m", "(a: string)")}
