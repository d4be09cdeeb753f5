"""Connected components: the files of a session with many shuffle partitions."""

from lumora.llm import common, graph
from lumora.llm.graph import components


def test_components_write_few_files_for_few_edges(spark, monkeypatch):
    partitions, written = spark.conf.get("spark.sql.shuffle.partitions"), []

    def counted(df):
        out = common.checkpointed(df)
        written.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(graph, "checkpointed", counted)
    spark.conf.set("spark.sql.shuffle.partitions", "97")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40) if i % 8 != 7] + [(100, 100)], "a long, b long")
        got = {r["v"]: r["component"] for r in components(edges).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {i: i - i % 8 for i in range(40)} | {100: 100}
    assert written and max(written) <= common.TASKS
    assert components(edges.where("a < 0")).collect() == []
