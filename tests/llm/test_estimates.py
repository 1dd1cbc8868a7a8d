"""Rounds of links start from the real size of their tables: a checkpoint's estimate, the product of all before it, doubles its
digits each round and fills the driver."""

from fleetspark.llm import graph, jaccard_join


def estimate(df):
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def test_estimates_of_components_do_not_grow_with_rounds(spark):
    chain = spark.range(60).selectExpr("pmod(xxhash64(id), 1000003) AS a", "pmod(xxhash64(id + 1), 1000003) AS b")
    labels = graph.components(chain)
    assert estimate(labels) < 1 << 20
    assert labels.count() == 61 and labels.select("component").distinct().count() == 1


def test_a_chain_of_near_copies_leaves_estimates_small(spark, monkeypatch):
    sizes, undecided = [], jaccard_join._undecided

    def watched(members, links):
        out = undecided(members, links)
        sizes.extend(estimate(df) for df in out)
        return out

    monkeypatch.setattr(jaccard_join, "_undecided", watched)
    texts = [(i, " ".join(f"w{j}" for j in range(i, i + 40))) for i in range(40)] + [(500, "alone")]
    rows = jaccard_join.jaccard_join(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sizes and all(s < 1 << 20 for s in sizes)
    assert {r.doc_id: r.component_id for r in rows} == {i: 500 if i == 500 else 0 for i, _ in texts}
