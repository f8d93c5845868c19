"""Folders of one file per document are listed by a few tasks."""

from trialweave.session import LISTING_TASKS
from trialweave.sources import corpus


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    path, before = str(tmp_path / "c"), spark.conf.get(LISTING_TASKS)
    spark.range(150).selectExpr("concat('D', id) AS file", "concat('text ', id) AS text").coalesce(1).write.partitionBy("file").text(path)
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        df = corpus.read_corpus(spark, path)
        tracker = spark.sparkContext.statusTracker()
        stages = [s for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
        tasks = [tracker.getStageInfo(s).numTasks for s in stages]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert tasks and max(tasks) <= 4 * spark.sparkContext.defaultParallelism
    assert spark.conf.get(LISTING_TASKS) == before
    assert sorted((r.file, r.text) for r in df.collect()) == sorted((f"D{i}", f"text {i}\n") for i in range(150))
