import pytest

import compare
from traceloom.plans import oracle, queries, source_oracle, source_queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SMALL)


@pytest.mark.parametrize("name", sorted(source_queries.queries()))
def test_sources_equal_sql(spark, con, name):
    compare.same_rows(source_queries.queries()[name](spark, SMALL), con, source_oracle.oracle_sql()[name])


@pytest.mark.parametrize("name", ["best_matches", "triage_counts", "eval_ranks", "fingerprint_drift", "log_effects", "p6_profile", "p6_guess_join"])
def test_reports_equal_sql(spark, con, name):
    compare.same_rows(queries.queries()[name](spark, SMALL), con, oracle.oracle_sql()[name])


def test_every_query_has_sql():
    assert queries.queries().keys() == oracle.oracle_sql().keys() and source_queries.queries().keys() == source_oracle.oracle_sql().keys()


def test_ranks_with_ids_that_are_hashes(spark):
    """Places in B come from ranges, whatever the ids look like."""
    from pyspark.sql import functions as F

    from traceloom.plans import reports

    funcs = spark.read.parquet(f"{SMALL}/funcs.parquet").where("name IS NOT NULL")
    # a mapping that keeps the order and spreads the ids over all numbers
    far = funcs.withColumn("id", F.col("id") * (1 << 40) - (1 << 55))
    ranks = lambda df: sorted((r.name, r.rank, r.top_name) for r in reports.evaluate_ranks(df, df).collect())
    assert ranks(funcs) == ranks(far)
    plan = reports.evaluate_ranks(far, far)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_every_cap_of_the_log_is_reached(spark):
    cut = source_queries.log_effects_tight(spark, SMALL).where("kind = 'capped'").groupBy("limit").count()
    assert {r["limit"] for r in cut.collect()} == set(source_queries.TIGHT) - {"told"}
    told = source_queries.log_effects_tight(spark, SMALL).where("limit = 'told' AND kind IN ('read', 'new_region')")
    most = {r.kind: r.n for r in told.groupBy("run", "kind").count().groupBy("kind").agg({"count": "max"}).toDF("kind", "n").collect()}
    assert most["read"] == 10
