"""Hits meet their scopes by broadcast paths: a query is never multiplied by the nodes of its region."""

from gleanwright.operators import scopes


def test_levels_come_from_paths(spark):
    nodes = spark.createDataFrame([("r", None), ("n1", "r"), ("n2", "r"), ("s1", "n1"), ("s2", "n1"), ("s3", "n2"), ("x", None)], "node string, parent string")
    hits = spark.createDataFrame([(q, f"{q}{k}", float(k), n) for q in (1, 2) for k, n in enumerate(["s1", "s2", "s3", "x", None, "gone"])], "query_id long, knowledge_id string, score double, node string")
    asked = spark.createDataFrame([(1, "s1"), (2, "x")], "query_id long, node string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = scopes.widened(hits, asked, scopes.closure(nodes), 2)
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        got = {(r.query_id, r.knowledge_id, r.level, r.reach, r["rank"]) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == {(1, "11", 1, 1, 1), (1, "10", 0, 1, 2), (2, "25", None, None, 1), (2, "24", None, None, 2)}
