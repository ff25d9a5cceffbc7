"""Extendible-hashing shards, in DataFrame operations only.

A directory is indexed by the leading bits of a hash of the id. A bucket that holds more bytes than a
shard may is split on its next bit, and only such a bucket is; what is left has its own shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, remove, written

LIMIT = 64 << 20
HASH_BITS = 40
#: Further bits that tell rows of one id apart; used only in buckets that the id's hash can't split. Rows of
#: one id split up to 2**20 shards, which at the standard limit hold 64 TB.
COPY_BITS = 20
STEP = 8


def id_hash(col: Column) -> Column:
    """40 leading bits of the id's MD5, a function that any SQL engine has; a null id is the text 'null'."""
    return F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit("null"))), 1, HASH_BITS // 4), 16, 10).cast("long")


def _leaves(cells: DataFrame, start: int, depth: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """(leaves, open) from cells (cell, bytes, rows) of depth bits, all in buckets of start bits to be split.

    The sums of all prefixes from start to depth bits come from one pre-aggregated pass over the cells. A
    leaf is a prefix that fits and whose parent doesn't; open cells don't fit with all bits used.
    """
    levels = F.explode(F.sequence(F.lit(start), F.lit(depth))).alias("depth")
    prefixes = cells.select(levels, "cell", "bytes", "rows").withColumn("prefix", F.expr(f"shiftright(cell, {depth} - depth)"))
    sums = cut(prefixes.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).withColumn("fits", (F.col("bytes") <= limit) | (F.col("rows") == 1)))
    over = sums.filter("not fits").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    fit = sums.filter("fits")
    inner = fit.filter(F.col("depth") > start).withColumn("parent", F.shiftright("prefix", 1)).join(over, ["depth", "parent"], "left_semi").drop("parent")
    leaves = inner.unionByName(fit.filter(F.col("depth") == start))
    return leaves.select("depth", "prefix", "bytes", "rows"), sums.filter(F.col("depth") == depth).filter("not fits").select(F.col("prefix").alias("cell"))


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, row_col: str | None = None) -> DataFrame:
    """(id, n_bytes, shard, depth, shard_bytes) for every row of docs; with row_col also ``row``, its value.

    shard is the leading bits of its bucket as text ('' if everything fits one shard), shard_bytes the
    UTF-8 bytes in it. Every shard holds at most limit bytes, unless a single document is longer: that one
    has a shard of its own. A null text has 0 bytes. Rows that repeat an id split on further bits, after the
    40 bits of the id's hash: those of row_col, which tells all rows apart, or else of the text and the
    number of the row among equal ones. Nothing depends on the partitioning. An empty table gives no rows.
    """
    n_bytes = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")
    if row_col:
        rows, carried = docs.select(F.col(id_col).alias("id"), n_bytes, F.col(row_col).alias("row")), ["row"]
        copy = F.xxhash64(F.lit("copy"), "row")
    else:
        equal = docs.groupBy(F.col(id_col).alias("id"), n_bytes, F.xxhash64(text_col).alias("body")).agg(F.count("*").alias("rows"))
        rows, carried = equal.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))), []
        copy = F.xxhash64(F.lit("copy"), "body", "nth")
        rows = rows.select("id", "n_bytes", copy.alias("copy"))
        copy = F.col("copy")
    copy = F.pmod(copy, F.lit(1 << COPY_BITS))
    rows = cut(rows.withColumn("hash", F.shiftleft(id_hash(F.col("id")), COPY_BITS).bitwiseOR(copy)).select("id", "n_bytes", "hash", *carried))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    bits = HASH_BITS + COPY_BITS
    depth, start, left, leaves = min(HASH_BITS, max(4, (total // limit).bit_length() + 4)), 0, rows, None
    while True:
        cells = left.groupBy(F.shiftright("hash", bits - depth).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows"))
        fit, over = _leaves(cells, start, depth, limit)
        leaves = fit if leaves is None else leaves.unionByName(fit)
        over = cut(over)
        if over.isEmpty():
            break
        if depth == bits:
            leaves = leaves.unionByName(cells.join(over, "cell", "left_semi").select(F.lit(depth).alias("depth"), F.col("cell").alias("prefix"), "bytes", "rows"))
            break
        left = left.join(over.select(F.col("cell").alias("__open")), F.shiftright("hash", bits - depth) == F.col("__open"), "left_semi")
        start, depth = depth + 1, min(bits, depth + STEP)
    leaves = cut(leaves)
    # the directory: every leaf is a row; a row of docs finds it by trying the few depths in use
    depths = [r.depth for r in leaves.select("depth").distinct().orderBy("depth").collect()]
    named = leaves.select("depth", "prefix", F.col("bytes").alias("shard_bytes"))
    tried = rows.withColumn("depth", F.explode(F.array(*map(F.lit, depths)))) if depths else rows.withColumn("depth", F.lit(0))
    tried = tried.withColumn("prefix", F.expr(f"shiftright(hash, {bits} - depth)"))
    n = leaves.count()
    side = F.broadcast(named) if n <= 200_000 else named  # 24 bytes a leaf
    shard = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("depth"), F.lit("0")))
    return tried.join(side, ["depth", "prefix"]).select("id", "n_bytes", shard.alias("shard"), "depth", "shard_bytes", *carried)


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> None:
    """docs as Parquet under path, one folder a shard (shard=_ for the empty prefix).

    Every row is written once, whatever ids repeat or are null: rows are numbered in a table of the shared
    folder, which is deleted afterwards. A column ``shard`` of docs gives way to the folder's.
    """
    rows, table = written(docs.drop("shard").withColumn("__shard_row", F.monotonically_increasing_id()))
    where = assign(rows, id_col, text_col, limit, "__shard_row").select(F.col("row").alias("__shard_row"), F.concat(F.lit("_"), "shard").alias("shard"))
    rows.join(where, "__shard_row").drop("__shard_row").repartition("shard").write.partitionBy("shard").parquet(path)
    remove(docs.sparkSession, table)
