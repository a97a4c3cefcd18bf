"""Winnowing fingerprints in DataFrame functions only.

A text's tokens are its runs of characters between white space, of at most 16 each, and single characters of scripts
written without spaces. Rolling hashes (cyclic polynomials) of every k tokens are made by doubling: the hash of 2m
tokens is that of the first m, rotated, xor that of the next m. Of each window of w hashes the least is chosen, the
rightmost of equal ones; a hash and its position are one number, so the least of these is right and neighbouring
windows' choices are equal numbers, and the minimum over a window is made by doubling too. Two texts that share
w + k - 1 tokens in a row share a fingerprint there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]|[^\x20\x09-\x0D\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]{1,16}"
PLACE = 2**31 - 1
FEW = 64  # bounds looked through at a time


def _turn(x: Column, by: int) -> Column:
    by %= 64
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by)) if by else x


def _shifted(df: DataFrame, name: str, first: str, second: str, by: int, f) -> DataFrame:
    """name: f of each value of first and the one ``by`` later in second, as far as second goes."""
    n = F.greatest(F.size(second) - by, F.lit(0))
    return df.withColumn(name, F.zip_with(F.slice(first, 1, n), F.slice(second, by + 1, n), f))


def _with(join, size: int):
    return lambda a, b: join(a, b, size)


def _spans(df: DataFrame, name: str, length: int, join) -> DataFrame:
    """Replaces the array ``name`` of n values by the n - length + 1 combinations of each ``length`` neighbours, by
    doubling; join(a, b, size of b) combines two that adjoin."""
    power, done = 1, 0
    df = df.withColumn("_power", F.col(name))
    while power <= length:
        if length & power:
            if done:
                df = _shifted(df, "_done", "_done", "_power", done, _with(join, power))
            else:
                df = df.withColumn("_done", F.col("_power"))
            done += power
        if 2 * power <= length:
            df = _shifted(df, "_power", "_power", "_power", power, _with(join, power))
        power *= 2
    return df.withColumn(name, F.col("_done")).drop("_power", "_done")


def winnow(df: DataFrame, text_col: str, out: str, k: int = 4, w: int = 8) -> DataFrame:
    """Adds the column ``out``: an array of the chosen hash and position pairs, each as one long, in order.

    A text of fewer than k tokens has one hash, of all of them; one of fewer than w hashes has one window. A text
    without tokens, empty or null, has none.
    """
    df = df.withColumn("_t", F.transform(F.regexp_extract_all(F.lower(F.coalesce(text_col, F.lit(""))), F.lit(TOKEN), F.lit(0)), lambda x: F.xxhash64(x)))
    df = df.withColumn("_h", F.col("_t"))
    df = _spans(df, "_h", k, lambda a, b, size: _turn(a, size).bitwiseXOR(b))
    whole = F.array(F.aggregate("_t", F.lit(0).cast("long"), lambda a, x: _turn(a, 1).bitwiseXOR(x)))
    df = df.withColumn("_h", F.when(F.size("_t") >= k, F.col("_h")).when(F.size("_t") > 0, whole).otherwise(F.col("_t")))
    code = F.transform("_h", lambda x, i: F.shiftleft(F.xxhash64(x).bitwiseAND(F.lit(0xFFFFFFFF)), 31).bitwiseOR((F.lit(PLACE) - F.least(i, F.lit(PLACE))).cast("long")))
    df = df.withColumn("_h", code).withColumn("_w", F.col("_h"))
    df = _spans(df, "_w", w, lambda a, b, _: F.least(a, b))
    chosen = F.when(F.size("_h") >= w, F.array_distinct("_w")).when(F.size("_h") > 0, F.array(F.array_min("_h"))).otherwise(F.col("_h"))
    return df.withColumn(out, chosen).drop("_t", "_h", "_w")


def hashes(codes: str | Column) -> Column:
    return F.transform(codes, lambda x: F.shiftright(x, 31))


def positions(codes: str | Column) -> Column:
    return F.transform(codes, lambda x: F.lit(PLACE) - x.bitwiseAND(F.lit(PLACE)))


def as_text(codes: str | Column) -> Column:
    """hash:position, comma-joined; hashes in hexadecimal."""
    return F.array_join(F.transform(codes, lambda x: F.concat(F.lower(F.hex(F.shiftright(x, 31))), F.lit(":"), (F.lit(PLACE) - x.bitwiseAND(F.lit(PLACE))).cast("string"))), ",")


def likeness(a: str | Column, b: str | Column) -> Column:
    """Shared distinct hashes over all distinct ones; 1 if neither has any."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def with_next(df: DataFrame, key: str, buckets: int, carried: list[str], tie: str) -> DataFrame:
    """Adds next_<c> for each carried column: that of the row with the next larger key (a long), of the first row for
    the last. Equal keys go by ``tie``.

    Rows are dealt into ranges of keys whose bounds are keys that occur; the first row of a range also goes to the
    range before (that of the first range to the last), so each range finds its neighbours by itself: one shuffle,
    and no range has more than its share.
    """
    near = df.agg(F.min(key).alias("low"), F.percentile_approx(key, [i / buckets for i in range(1, buckets)] or [0.5], 10 * max(1000, buckets)).alias("p")).first()
    if near["low"] is None:
        return df.withColumns({f"next_{c}": F.col(c) for c in carried})
    bounds = sorted({near["low"], *near["p"]})
    fine = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    coarse = F.split(F.lit(",".join(map(str, bounds[::FEW]))), ",").cast("array<bigint>")
    df = df.withColumn("_c", F.size(F.filter(coarse, lambda b: b <= F.col(key))) - 1)
    df = df.withColumn("_b", F.col("_c") * FEW + F.size(F.filter(F.slice(fine, F.col("_c") * FEW + 1, FEW), lambda b: b <= F.col(key))) - 1).drop("_c")
    ghost = F.struct(F.when(F.col("_b") == 0, len(bounds) - 1).otherwise(F.col("_b") - 1).alias("b"), F.lit(1).alias("g"))
    own = F.struct(F.col("_b").alias("b"), F.lit(0).alias("g"))
    df = df.withColumn("_p", F.explode(F.when(F.element_at(fine, F.col("_b") + 1) == F.col(key), F.array(own, ghost)).otherwise(F.array(own)))).withColumn("_b", F.col("_p.b")).withColumn("_g", F.col("_p.g")).drop("_p")
    order = Window.partitionBy("_b").orderBy("_g", key, tie)
    return df.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried}).where("_g = 0").drop("_b", "_g")


def fingerprints(df: DataFrame, k: int = 4, w: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last quarter of code points is the beginning of the
    next document's, by ascending id; and how alike the fingerprint is to the edited text's and the next document's.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, codes. A null
    text counts as empty; rows without an id come first; rows with one id go by their texts; an only row is its own
    next. An empty table gives no rows.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("_key", F.coalesce("doc_id", F.lit(-(2**63)).cast("long")))
    buckets = min(20_000, 4 * max(8, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))))
    docs = with_next(winnow(docs, "text", "codes", k, w), "_key", buckets, ["text", "codes"], "text")
    take = F.floor(F.length("text") / 4).cast("int")
    docs = docs.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", F.concat(F.left("text", (F.length("text") - take).cast("int")), F.left("next_text", take)))
    docs = docs.drop("text", "next_text", "_key")
    docs = winnow(docs, "edited", "edited_codes", k, w)
    docs = docs.withColumns({"_a": hashes("codes"), "_b": hashes("edited_codes"), "_n": hashes("next_codes")})
    return docs.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text("codes").alias("fingerprint"), as_text("edited_codes").alias("edited_fingerprint"), likeness("_a", "_b").alias("near_edited"), likeness("_a", "_n").alias("near_next"), "codes")
