"""State of the stream of workbooks that change in place."""

import pandas as pd
from pyspark.sql import functions as F

from quillmap.streaming import changes
from quillmap.streaming.changes import changed_files


def test_paths_share_a_call(spark, tmp_path, monkeypatch):
    """Changes of many paths are found by as many calls as there are groups, not paths."""
    monkeypatch.setattr(changes, "GROUPS", 2)
    arrived, checkpoint = str(tmp_path / "a"), str(tmp_path / "c")
    schema = "path string, modificationTime timestamp, length bigint"

    out = str(tmp_path / "o")

    def run(times):
        frame = spark.createDataFrame(pd.DataFrame({"path": [f"p{i}" for i in range(len(times))], "t": times}))
        frame.select("path", F.timestamp_seconds("t").alias("modificationTime"), F.lit(1).cast("bigint").alias("length")).write.mode("append").parquet(arrived)
        stream = changed_files(spark.readStream.schema(schema).parquet(arrived)).writeStream.format("parquet").option("path", out)
        query = stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return query.lastProgress.stateOperators[0].numRowsTotal, spark.read.parquet(out).count()

    assert run([1] * 50) == (2, 50)
    assert run([1] * 40 + [2] * 10) == (2, 60)
    assert run([1] * 40 + [0] * 10) == (2, 70)
