"""Small tables of links take few files, however many partitions a shuffle has."""

from limpid.llm import components, simhash
from limpid.session import stage


def test_few_links_are_written_as_few_files(spark, monkeypatch):
    files = []
    monkeypatch.setattr(components, "stage", lambda df, name: files.append(stage(df, name)) or files[-1])
    monkeypatch.setattr(simhash, "stage", components.stage)
    docs = spark.createDataFrame([(i, f"text {i} of some words {i % 50}") for i in range(400)], "doc_id long, text string")
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(held, ("64", "false")):
            spark.conf.set(k, v)
        assert simhash.groups(docs.repartition(4)).count() == 400
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert max(len(f.inputFiles()) for f in files) <= components.FEWEST_TASKS
