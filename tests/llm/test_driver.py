"""What a stage asks of the driver: it keeps every execution with its plan, and a thread and memory for each exchange."""

from pyspark.sql import functions as F

from tessera.functions.shared import materialise, materialise_counted, materialise_seen
from tessera.llm import decontaminate
from tessera.operators.components import components

QUESTION = "we know that Alice buys 12 apples and pays 5 dollars for each one in the market before she sells 3 of them to Bob"


def executions(spark, run):
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return store.executionsCount() - before, out


def test_decontamination_asks_little_of_the_driver(spark):
    docs = spark.createDataFrame([(1, f"Start here. {QUESTION}. End"), (2, "nothing of it"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, f"Then {QUESTION}."), (8, None)], "item_id long, text string")
    n, left = executions(spark, lambda: materialise(decontaminate.remove(docs, bench)))
    assert n <= 10 and sorted(r["doc_id"] for r in left.collect()) == [2, 3]


def test_the_pattern_of_common_words_stands_once_in_a_plan(spark):
    bench = spark.createDataFrame([(7, f"Then {QUESTION}.")], "item_id long, text string")
    plan = decontaminate.items_table(bench, common=["we", "market"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?<=M)") == 1


def test_components_take_one_execution_a_round(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long")
    n, out = executions(spark, lambda: components(edges))
    assert n <= 3 and sorted(map(tuple, out.collect())) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)]


def test_aggregates_of_what_is_written(spark):
    rows = spark.range(10).repartition(3)
    for df, n, total in ((rows, 10, 45), (rows.limit(0), 0, None), (rows.filter("id < 0").distinct(), 0, None)):
        out, seen = materialise_seen(df, n=F.count(F.lit(1)), total=F.sum("id"))
        assert (seen["n"], seen["total"], out.count()) == (n, total, n)
        assert materialise_counted(df)[1] == n
