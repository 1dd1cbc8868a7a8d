"""Rules do not depend on the order of rows."""

from fleetspark.llm import quality_rules as q


def test_conflicting_labels_in_both_orders(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(60)) + (" ##" * 40 if i % 2 else "")) for i in range(400)], "doc_id long, text string")
    stats = q.statistics(docs, keep=["doc_id"]).cache()
    rows = [(i, 1) for i in range(400)] + [(i, 0) for i in range(400) if i % 2]
    lists = [q.rules_from(stats, spark.createDataFrame(order, "doc_id long, quality int").coalesce(1)) for order in (rows, rows[::-1])]
    assert repr(lists[0]) == repr(lists[1]) and lists[0]
