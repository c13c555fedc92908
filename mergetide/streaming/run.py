"""Running a stream to the end of its input, with its result in the shared folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staged import new_path


def run_to_end(stream: DataFrame, mode: str, keys: Sequence[str] = ()) -> DataFrame:
    """What the stream has given out at the end of its input: in ``complete`` mode the last result, in ``update`` mode the last
    row of each of ``keys``, in ``append`` mode all rows.  Batches are written as Parquet; nothing passes the driver.
    """
    spark, path = stream.sparkSession, new_path(stream.sparkSession, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/_batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, _batch long").parquet(f"{path}/rows")
    if mode == "complete":
        last = rows.agg(F.max("_batch")).first()[0]
        return rows.where(F.col("_batch") == F.lit(last)).drop("_batch")
    if mode == "update":
        rest = [c for c in stream.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*keys, "_r.*")
    return rows.drop("_batch")
