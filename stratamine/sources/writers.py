"""Writers. Each takes the folder to write to; the files in it are Spark's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_document(df: DataFrame, path: str) -> None:
    """A result of one row as one JSON document."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def csv_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def itemset_lines(itemsets: DataFrame, title: str) -> DataFrame:
    """One line for each size of ``items`` (an array), after a title: singles as ('x'), larger ones as ('x', 'y'), each
    set's members and the sets in order; an empty line ends a size. Columns: place, value."""
    shown = F.concat(F.lit("("), F.array_join(F.transform("items", lambda x: F.concat(F.lit("'"), x.cast("string"), F.lit("'"))), ", "), F.lit(")"))
    lines = itemsets.groupBy(F.size("items").alias("place")).agg(F.array_sort(F.collect_list(F.struct("items", shown.alias("s")))).alias("all"))
    lines = lines.select("place", F.concat(F.array_join(F.transform("all", lambda x: x["s"]), ","), F.lit("\n")).alias("value"))
    return lines.sparkSession.createDataFrame([(0, title)], "place int, value string").unionByName(lines).orderBy("place")


def itemset_report(candidates: DataFrame, frequent: DataFrame, path: str) -> None:
    """Both lists of itemsets as text."""
    first = itemset_lines(candidates, "Candidates:").withColumn("part", F.lit(0))
    second = itemset_lines(frequent, "Frequent Itemsets:").withColumn("part", F.lit(1))
    first.unionByName(second).orderBy("part", "place").select("value").coalesce(1).write.mode("overwrite").text(path)


def community_lines(communities: DataFrame, path: str) -> None:
    """Each community's ``members`` (a sorted array) as a line 'a', 'b', smaller ones first."""
    line = F.array_join(F.transform("members", lambda x: F.concat(F.lit("'"), x.cast("string"), F.lit("'"))), ", ")
    communities.orderBy(F.size("members"), "members").select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def flags_line(df: DataFrame, order: str, flag: str, path: str) -> None:
    """All flags in order on one line, with spaces between."""
    line = df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, flag))), lambda x: x[flag].cast("string")), " ").alias("value"))
    line.write.mode("overwrite").text(path)


def model_tables(profiles: DataFrame, users: DataFrame, path: str) -> None:
    """A content model as two Parquet tables."""
    profiles.write.mode("overwrite").parquet(f"{path}/profiles")
    users.write.mode("overwrite").parquet(f"{path}/users")


def cluster_report(rounds: DataFrame, clusters: DataFrame, path: str) -> None:
    """The numbers of each round as CSV with a header, and each point's cluster as a line of JSON."""
    csv_table(rounds, f"{path}/rounds")
    json_lines(clusters, f"{path}/clusters")
