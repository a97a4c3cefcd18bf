"""Sketches and streams over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamine.functions.hashing import HASH60_SQL, PRIME, family, family_sql, hash60
from stratamine.operators import sketch
from stratamine.plans.registry import query, table
from stratamine.streaming import reservoir, windows

BITS, BLOOM, FM, GROUPS, EACH, MODULUS, SIZE = 10_000, family(10, 21), family(36, 22), 6, 6, 65_536, 100
X = HASH60_SQL.format("user_id")


def _h(x: str, modulus: int) -> str:
    return f"((h.ha * ({x} % {PRIME}) + h.hb) % {PRIME} % {modulus})"


POSITIONS = f"(SELECT DISTINCT {_h(X, BITS)} AS position FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase') CROSS JOIN {family_sql(BLOOM)})"


def _buyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id")


@query(f"SELECT position FROM {POSITIONS}")
def bloom_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.bloom_positions(_buyers(spark, sf_dir), "user_id", BLOOM, BITS)


@query(f"""WITH p AS {POSITIONS} SELECT user_id, CASE WHEN count(position) = {len(BLOOM)} THEN 1 ELSE 0 END AS seen
FROM (SELECT user_id, {_h(X, BITS)} AS q FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN {family_sql(BLOOM)}) LEFT JOIN p ON position = q GROUP BY user_id""")
def bloom_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.bloom_probe(table(spark, sf_dir, "events"), "user_id", bloom_positions(spark, sf_dir), BLOOM, BITS)


@query(f"SELECT m AS keys, round(m * {len(BLOOM)} / {BITS}, 6) AS fill, round(pow(1 - exp(-{len(BLOOM)} * m / {BITS}), {len(BLOOM)}), 6) AS error FROM (SELECT count(DISTINCT user_id) AS m FROM events WHERE event_type = 'purchase')")
def bloom_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.bloom_estimate(_buyers(spark, sf_dir), "user_id", len(BLOOM), BITS)


def _fm(rows: str, by: str) -> str:
    zeros = f"length(bin({_h(X, MODULUS)})) - length(rtrim(bin({_h(X, MODULUS)}), '0'))"
    comma = f"{by}, " if by else ""
    return f"""SELECT {comma}CAST(floor(median(mean)) AS BIGINT) AS estimate FROM (SELECT {comma}i // {EACH} AS g, avg(pow(2, r)) AS mean
    FROM (SELECT {comma}h.i, max({zeros}) AS r FROM {rows} CROSS JOIN {family_sql(FM)} GROUP BY ALL) GROUP BY ALL) {'GROUP BY ALL' if by else ''}"""


@query(_fm("events", ""))
def flajolet_martin(spark: SparkSession, sf_dir: str) -> DataFrame:
    zeros = sketch.hashed_zeros(table(spark, sf_dir, "events"), hash60("user_id"), FM, MODULUS)
    return sketch.flajolet_martin(zeros, GROUPS, EACH)


@query("SELECT count(DISTINCT user_id) AS n_distinct FROM events")
def distinct_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").agg(F.countDistinct("user_id").alias("n_distinct"))


SAMPLE = f"(SELECT event_id, user_id FROM events ORDER BY {HASH60_SQL.format(chr(39) + 's' + chr(39) + ' || event_id')}, event_id LIMIT {SIZE})"


@query(f"SELECT event_id, user_id FROM {SAMPLE}")
def reservoir_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.sample(table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id", SIZE)


@query("SELECT user_id, n, rank FROM (SELECT user_id, count(*) AS n, dense_rank() OVER (ORDER BY count(*) DESC) AS rank FROM events GROUP BY user_id) WHERE rank <= 3")
def top3_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.top_frequencies(table(spark, sf_dir, "events"), "user_id")


@query("SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS window_start, unnest(string_split(event_type || ' user' || user_id, ' ')) AS word, count(*) AS n FROM events GROUP BY 1, 2")
def stream_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("event_type", F.lit(" user"), F.col("user_id").cast("string"))
    return windows.word_count(windows.events(spark, f"{sf_dir}/events.parquet"), "ts", text)


WINDOWED = "(SELECT user_id, CAST(floor(epoch(ts) / 36000) * 36000 - 36000 * k.range AS BIGINT) AS window_start FROM events CROSS JOIN range(3) k)"


@query(f"SELECT window_start, count(DISTINCT user_id) AS n_distinct FROM {WINDOWED} GROUP BY 1")
def stream_sliding_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sliding_distinct(windows.events(spark, f"{sf_dir}/events.parquet"), "ts", "user_id", "30 hours", "10 hours")


@query(_fm(WINDOWED, "window_start"))
def stream_flajolet_martin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sliding_flajolet_martin(windows.events(spark, f"{sf_dir}/events.parquet"), "ts", hash60("user_id"), FM, MODULUS, GROUPS, EACH, "30 hours", "10 hours")


@query(f"SELECT event_id AS id, CAST(user_id AS VARCHAR) AS key FROM {SAMPLE}")
def stream_reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reservoir.reservoir(windows.events(spark, f"{sf_dir}/events.parquet"), "event_id", "user_id", SIZE)


@query(f"SELECT user_id, n, rank FROM (SELECT user_id, count(*) AS n, dense_rank() OVER (ORDER BY count(*) DESC) AS rank FROM {SAMPLE} GROUP BY user_id) WHERE rank <= 3")
def sample_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.top_frequencies(reservoir_sample(spark, sf_dir), "user_id")
