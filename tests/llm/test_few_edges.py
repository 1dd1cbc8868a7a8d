"""Few edges go through few tasks, however many partitions a shuffle has."""

from fleetspark.llm import graph


def test_few_edges_need_few_tasks_and_give_the_same_components(spark, monkeypatch):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        edges = spark.createDataFrame([(i, i + 1) for i in range(1, 12)] + [(30, 20), (20, 30), (7, 7)], "a long, b long")
        got = graph.components(edges)
        assert got.rdd.getNumPartitions() <= graph.SLIM
        rows = sorted(map(tuple, got.collect()))
        assert rows == [(i, 1) for i in range(1, 13)] + [(20, 20), (30, 20)]
        monkeypatch.setattr(graph, "FEW", 3)  # more edges than that: by shuffles
        assert sorted(map(tuple, graph.components(edges).collect())) == rows
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
