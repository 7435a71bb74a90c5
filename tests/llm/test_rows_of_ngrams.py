"""Op9's rows are n-grams: as many as its units have distinct ones, whatever the units and ranges."""

import pytest
from pyspark.sql import functions as F
from test_stupid_backoff import _brute

from driftloom.llm import stupid_backoff as sb


def _rows(docs):
    own = [docs.mapInArrow(sb._explode(3, sb.SLICES, k), sb._GRAM) for k in range(sb.SLICES)]
    both = own[0]
    for df in own[1:]:
        both = both.unionByName(df)
    return both.agg(F.count("*").alias("rows"), F.count_distinct("unit", "h").alias("distinct"), F.sum("n").alias("n")).first()


def test_rows_are_the_distinct_ngrams_of_units(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    one, many = _rows(docs.coalesce(1)), _rows(docs.repartition(12, "doc_id"))
    assert one.rows == one.distinct and many.rows == many.distinct and one.n == many.n
    # more units repeat some n-grams, but there are never more rows than occurrences
    assert one.rows < many.rows <= many.n


def test_units_of_several_partitions_have_common_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    whole = {r.doc_id: r.sum_log for r in sb.score(docs.coalesce(1)).collect()}
    dealt = {r.doc_id: r.sum_log for r in sb.score(docs.repartition(12, "doc_id")).collect()}
    assert whole == {k: pytest.approx(v, abs=1e-6) for k, v in dealt.items()}


def test_plan_counts_and_joins_by_hash(spark):
    from pyspark.sql import Window

    grams = spark.createDataFrame([], sb._GRAM)
    total = grams.select("unit", "at", F.sum("n").over(Window.partitionBy("h")).alias("n"))
    physical = total._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange") == 1 and "Window [sum(n" in physical


def _shuffled(spark, run):
    """Rows that ``run`` writes to exchanges, and what it gives."""
    store = spark.sparkContext._jsc.sc().statusStore()
    jvm = spark.sparkContext._jvm
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    before = {stages().apply(k).stageId() for k in range(stages().size())}
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    after = stages()
    own = [after.apply(k) for k in range(after.size())]
    return sum(s.shuffleWriteRecords() for s in own if s.stageId() not in before), out


def test_ngrams_of_rare_parts_are_no_rows(spark):
    # no word pair twice: each trigram backs off, and none needs to be counted
    texts = [(k, " ".join(f"w{k}x{j}" for j in range(500))) for k in range(20)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(texts, 2), "doc_id long, text string")
    rows, scored = _shuffled(spark, lambda: sb.score(docs).collect())
    words, pairs, trigrams = 20 * 500, 20 * 499, 20 * 498
    assert len(scored) == 20
    # single words are dealt and come back, pairs are dealt
    assert 2 * words + pairs <= rows < 2 * words + pairs + trigrams / 10


@pytest.mark.parametrize("order", [2, 3, 4])
def test_longest_ngrams_that_may_be_frequent(spark, order):
    texts = ["a b c d e", "a b c d f", "x b c d e", "b c", "a b", "", "a a a a a a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.sum_log for r in sb.score(docs, order=order).collect()}
    for d, _, s in _brute(list(enumerate(texts)), order):
        assert got[d] == pytest.approx(s, abs=1e-9)
    for least in (1, 3):
        got = {r.doc_id: r.sum_log for r in sb.score(docs, order=order, min_count=least).collect()}
        for d, _, s in _brute(list(enumerate(texts)), order, min_count=least):
            assert got[d] == pytest.approx(s, abs=1e-9)
