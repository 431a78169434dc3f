"""What the driver sends whole to every task: nothing that a few MB of files hold millions of rows of."""

import os

import pytest
from pyspark.sql import functions as F

from arbograph.operators import retrieval
from arbograph.plans import catalog

SF = "/root/testdata/sf0.001"
#: Queries over names of entities.
NAMED = ["resolve_entity_names", "intent_comparison", "dedupe_related", "intent_lookup", "structured_retrieve"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The smallest tables with 260,000 parts, whose file has less than 10 MB."""
    folder = tmp_path_factory.mktemp("tables")
    for name in os.listdir(SF):
        if name != "part.parquet":
            os.symlink(f"{SF}/{name}", folder / name)
    own = spark.read.parquet(f"{SF}/part.parquet").limit(1).drop("p_partkey").crossJoin(spark.range(260_000).withColumnRenamed("id", "p_partkey"))
    own.coalesce(1).write.parquet(f"{folder}/part.parquet")
    return str(folder)


def sent_whole(plan, sent=False):
    """Scans of parts below an exchange that sends all rows to every task, but for what an aggregate makes of them."""
    name = plan.nodeName()
    if "Broadcast" in name and "Exchange" in name:
        sent = True
    if sent and "Aggregate" in name:
        return 0
    if name.startswith("AdaptiveSparkPlan"):
        return sent_whole(plan.initialPlan(), sent)
    children = plan.children()
    below = sum(sent_whole(children.apply(k), sent) for k in range(children.size()))
    return below + (sent and name.startswith("Scan") and "p_name" in plan.toString())


@pytest.mark.parametrize("name", NAMED)
def test_many_entities_are_not_sent_whole(spark, tables, name):
    frame = catalog.QUERIES[name](spark, tables)
    assert sent_whole(frame._jdf.queryExecution().executedPlan()) == 0


@pytest.mark.parametrize("most", [0, 4_000_000])
def test_keys_that_are_sent_or_not_find_the_same(spark, monkeypatch, most):
    monkeypatch.setattr(retrieval, "SENT_CHARS", most)
    names = spark.range(300).select(F.col("id").alias("entity_id"), F.concat(F.lit("part "), F.col("id").cast("string")).alias("low"))
    keys = spark.createDataFrame([("part 29",), ("t 1",), ("99",), ("part",), ("none",)], "key string")
    found = {(r.key, r.entity_id) for r in retrieval.containing(names, keys).collect()}
    assert found == {(k, i) for k in ("part 29", "t 1", "99", "part", "none") for i in range(300) if k in f"part {i}"}
