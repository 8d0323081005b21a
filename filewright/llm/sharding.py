"""Shards by extendible hashing.

A directory is indexed by the first bits of a row's hash. A bucket that holds more
bytes than a shard may is split on one bit more, and only such buckets are; a
row's shard is the bucket at the least depth that fits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filewright.llm.store import fresh, stage

SHARD_BYTES = 1 << 20
KEY_BITS = 60
BITS_A_ROUND = 12


def _hash(*values) -> F.Column:
    """The first 60 bits of an MD5 digest."""
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *values)), 1, KEY_BITS // 4), 16, 10).cast("long")


def _split(rows: DataFrame, key: str, depth: int, limit: int) -> DataFrame:
    """``rows`` with the depth, up to ``BITS_A_ROUND`` bits on, of the bucket that fits; NULL where none does yet.

    Sizes are summed for each prefix of the deepest level first, so a round's table of buckets
    has at most 2**12 rows for each bucket that is split.
    """
    deepest = depth + BITS_A_ROUND
    prefix = lambda bits: F.shiftright(key, KEY_BITS - bits)
    cells = rows.groupBy(prefix(depth).alias("top"), prefix(deepest).alias("cell")).agg(
        F.sum("bytes").alias("bytes"), F.count("*").alias("rows")
    )
    found, size, count = F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit(None).cast("long")
    for bits in range(deepest, depth - 1, -1):
        same = Window.partitionBy("top", F.shiftright("cell", deepest - bits))
        total, many = F.sum("bytes").over(same), F.sum("rows").over(same)
        fits = (total <= limit) | (many == 1)
        found, size, count = (F.when(fits, new).otherwise(old) for new, old in ((F.lit(bits), found), (total, size), (many, count)))
    leaves = cells.select("cell", found.alias("depth"), size.alias("shard_bytes"), count.alias("shard_rows"))
    return rows.withColumn("cell", prefix(deepest)).join(leaves, "cell").drop("cell")


def shards(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = SHARD_BYTES
) -> DataFrame:
    """(id, n_bytes, depth, shard, shard_bytes, shard_rows) of every row of ``docs``.

    ``shard`` names depth and prefix. Bytes are those of the text in UTF-8, none for NULL. A row
    larger than ``limit`` is a shard of its own. The hash is that of the id, as text; a NULL id counts as
    empty. Rows whose ids share all 60 bits, such as repeated rows, are split further on a hash of text
    and row number. An empty table gives no rows.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"),
        _hash(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("key"),
        _hash(F.coalesce(F.md5(text_col), F.lit("")), F.monotonically_increasing_id().cast("string")).alias("rest"),
    )
    rows = stage(rows, "shard-keys")
    done = []
    for part, key in enumerate(("key", "rest")):
        for depth in range(0, KEY_BITS, BITS_A_ROUND):
            whole = rows if part == 0 else rows.withColumn("group", F.col("key"))
            split = stage(_split(whole, key, depth, limit) if part == 0 else _split_group(whole, depth, limit), "shard-round")
            bits = F.col("depth")
            name = (
                F.concat_ws("-", bits.cast("string"), F.expr(f"shiftright(key, {KEY_BITS} - depth)").cast("string"))
                if part == 0
                else F.concat_ws("-", (bits + KEY_BITS).cast("string"), F.col("key").cast("string"), F.expr(f"shiftright(rest, {KEY_BITS} - depth)").cast("string"))
            )
            done.append(
                split.where("depth IS NOT NULL").select(
                    "id", F.col("bytes").alias("n_bytes"), (bits + part * KEY_BITS).alias("depth"), name.alias("shard"), "shard_bytes", "shard_rows"
                )
            )
            rows = split.where("depth IS NULL").select("id", "bytes", "key", "rest")
            if rows.isEmpty():
                break
        else:
            continue
        break
    made = done[0]
    for more in done[1:]:
        made = made.unionByName(more)
    return made


def _split_group(rows: DataFrame, depth: int, limit: int) -> DataFrame:
    """As ``_split``, on the second hash within each value of the first."""
    deepest = depth + BITS_A_ROUND
    prefix = lambda bits: F.shiftright("rest", KEY_BITS - bits)
    cells = rows.groupBy("group", prefix(depth).alias("top"), prefix(deepest).alias("cell")).agg(
        F.sum("bytes").alias("bytes"), F.count("*").alias("rows")
    )
    found, size, count = F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit(None).cast("long")
    for bits in range(deepest, depth - 1, -1):
        same = Window.partitionBy("group", "top", F.shiftright("cell", deepest - bits))
        total, many = F.sum("bytes").over(same), F.sum("rows").over(same)
        fits = (total <= limit) | (many == 1)
        found, size, count = (F.when(fits, new).otherwise(old) for new, old in ((F.lit(bits), found), (total, size), (many, count)))
    leaves = cells.select("group", "cell", found.alias("depth"), size.alias("shard_bytes"), count.alias("shard_rows"))
    return rows.withColumn("cell", prefix(deepest)).join(leaves, ["group", "cell"]).drop("group", "cell")
