"""Session helpers: sizing, the checkpoint folder, shipping the package once."""

import pytest

from tidemark.session import cluster_conf, ensure_checkpoint_dir, ship_package


def test_cluster_conf_sizes_partitions():
    c = cluster_conf(100 * (1 << 40), 8000)
    assert c["spark.sql.shuffle.partitions"] == str(409_600)
    small = cluster_conf(1 << 20, 64)
    assert small["spark.sql.shuffle.partitions"] == "128"  # at least two waves of cores
    assert c["spark.sql.adaptive.skewJoin.enabled"] == "true"


def test_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


@pytest.mark.parametrize("name", [
    "smart_parse", "quick_parse", "parsed_to_task", "feature_dispatch", "task_breakdown", "contextual_suggestions",
    "search_postings", "search_match", "search_rank", "search_tasks", "search_top50"])
def test_plans_are_built_without_jobs(spark, name):
    from tidemark.plans.registry import load_all
    build, sc = load_all()[name].build, spark.sparkContext
    build(spark, "/root/testdata/sf0.001")  # reads the files' schemas once
    sc.setJobGroup(f"plan-{name}", "")
    build(spark, "/root/testdata/sf0.001")
    # reading a parquet schema is Spark's own job, one for each table
    jobs = [j for j in sc.statusTracker().getJobIdsForGroup(f"plan-{name}")]
    stages = [sc.statusTracker().getStageInfo(s) for j in jobs for s in sc.statusTracker().getJobInfo(j).stageIds]
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert all("parquet" in s.name for s in stages)


def test_checkpoint_dir_and_shipping_are_idempotent(spark):
    d1 = ensure_checkpoint_dir(spark)
    assert ensure_checkpoint_dir(spark) == d1
    ship_package(spark)
    ship_package(spark)
    # a pandas step imports the package inside a worker
    import pandas as pd

    def f(batches):
        from tidemark.functions.rules import CACHE_TTL_SECONDS
        for b in batches:
            yield pd.DataFrame({"ttl": [CACHE_TTL_SECONDS] * len(b)})
    assert spark.range(3).mapInPandas(f, "ttl long").first()[0] == 300
