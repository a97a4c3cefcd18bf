"""A uniform sample of a stream with bounded state, and the most frequent keys of it."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stratamine.functions.hashing import hash60
from stratamine.functions.settle import folder
from stratamine.functions.ship import ship


def reservoir(stream: DataFrame, id_col: str, key: str, size: int, seed: str = "s", shards: int = 8) -> DataFrame:
    """id, key: the rows whose ids' hashes with the seed are the least, which is a uniform sample without replacement
    of everything seen, whatever the order of arrival. Each shard of the ids holds ``size`` rows of state at most; the
    shards' samples together hold the whole's."""
    spark = stream.sparkSession
    ship(spark)
    path = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = stream.select(F.col(id_col).cast("long").alias("id"), F.col(key).cast("string").alias("key"), hash60(F.concat(F.lit(seed), F.col(id_col).cast("string"))).alias("h"))
    rows = rows.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))

    def update(shard: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(zip(*state.get, strict=True)) if state.exists else []
        for pdf in batches:
            kept = sorted(kept + list(zip(pdf["h"].tolist(), pdf["id"].tolist(), pdf["key"].tolist(), strict=True)))[:size]
        state.update(tuple(list(c) for c in zip(*kept, strict=True)))
        yield pd.DataFrame({"shard": shard[0], "h": [x[0] for x in kept], "id": [x[1] for x in kept], "key": [x[2] for x in kept]})

    made = rows.groupBy("shard").applyInPandasWithState(update, "shard int, h long, id long, key string", "h array<long>, id array<long>, key array<string>", "update", GroupStateTimeout.NoTimeout)

    def keep(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{path}/out")

    query = made.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    if not query.lastProgress and not spark._jvm.org.apache.hadoop.fs.Path(f"{path}/out").getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/out")):
        return spark.createDataFrame([], "id long, key string")
    out = spark.read.parquet(f"{path}/out")
    last = out.groupBy("shard").agg(F.max("batch").alias("batch"))
    return out.join(last, ["shard", "batch"]).orderBy("h", "id").limit(size).select("id", "key")
