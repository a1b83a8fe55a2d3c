"""Extendible hashing into shards of limited bytes, in DataFrame functions alone.

A row's address is 60 bits of its key's MD5. The directory starts with one bucket, and only a
bucket over the byte limit splits, on the next bit, until every shard fits. Bytes are summed by
address cells (prefixes of a fixed depth), and the sums of all buckets above the cells tell which
split: a bucket over the limit passes its rows on to its two halves, so each half meets one parent
and no bucket meets its rows. The directory costs what the number of shards costs, not what the
rows cost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import few_bytes, materialize, numbered, unused

BITS = 60
#: Cells that the first look makes for each shard that the bytes need.
CELLS_PER_SHARD = 16
ADDED = ["n_bytes", "shard", "shard_depth", "shard_part", "shard_bytes"]


def address(key: Column) -> Column:
    """60 hashed bits as a non-negative long."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def prefix(at: Column, depth: int) -> Column:
    return F.shiftrightunsigned(at, BITS - depth)


def _shift(way: str, value: Column, bits: Column) -> Column:
    return F.call_function(f"shift{way}", value, bits.cast("int"))


def leaves(cells: DataFrame, depth: int, limit: int, top: int = 0) -> DataFrame:
    """(level, bucket, bytes): the buckets of `top` to `depth` bits that the cells (prefixes of `depth` bits,
    with bytes) end in: those that fit, or are cells, and whose parent doesn't fit. With a `top` over 0
    the buckets of `top` bits are known not to fit."""
    levels = F.explode(F.sequence(F.lit(top), F.lit(depth))).alias("level")
    each = cells.select("bytes", "cell", levels).select("level", _shift("right", F.col("cell"), F.lit(depth) - F.col("level")).alias("bucket"), "bytes")
    sums = materialize(each.groupBy("level", "bucket").agg(F.sum("bytes").alias("bytes")))
    last = (F.col("bytes") <= limit) | (F.col("level") == depth)
    over = sums.where(F.col("bytes") > limit).select((F.col("level") + 1).alias("level"), F.col("bucket").alias("parent"))
    found = sums.where(last).withColumn("parent", F.shiftright("bucket", 1)).join(over, ["level", "parent"]).select("level", "bucket", "bytes")
    return found if top else found.unionByName(sums.where((F.col("level") == 0) & last))


def by_cell(found: DataFrame, depth: int) -> DataFrame:
    """(cell, level, bytes): each cell of `depth` bits under the leaf it is in."""
    up = F.lit(depth) - F.col("level")
    first = _shift("left", F.col("bucket"), up)
    cells = F.explode(F.sequence(first, first + _shift("left", F.lit(1).cast("long"), up) - 1)).alias("cell")
    return found.select(cells, "level", "bytes")


def shard(docs: DataFrame, limit: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`docs` with n_bytes, shard (bits of the bucket's address; '' is the whole), shard_depth,
    shard_part and shard_bytes (of the bucket).

    A shard has at most `limit` bytes, or one row that is longer. Rows of one key have one address,
    which no bit can split: where they alone pass the limit, their bucket has numbered parts that
    fit, dealt by running sums over the input's partitions. Null and empty texts have 0 bytes, a null
    key the address of ''; repeated rows are kept and share an address; a text over the limit has a
    part of its own; columns of these names are replaced, all others stay as they are; an empty table
    gives an empty table. `docs` is read several times and has to give the same rows each time (a
    table does); rows that are dealt to parts are numbered in a written copy.
    """
    docs = docs.drop(*ADDED)
    own = docs.columns
    at, cell, leaf, open_ = unused(own, "at", "cell", "leaf", "open")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    sized = docs.select(address(F.col(key)).alias("at"), size.alias("bytes")).groupBy("at").agg(F.sum("bytes").alias("bytes"), F.max("bytes").alias("most"))
    sized = materialize(sized)
    total = sized.agg(F.sum("bytes")).first()[0] or 0
    depth = min(BITS, max(1, (max(total, 1) * CELLS_PER_SHARD // limit).bit_length()))
    found = materialize(leaves(sized.groupBy(prefix(F.col("at"), depth).alias("cell")).agg(F.sum("bytes").alias("bytes")), depth, limit))
    cells = materialize(by_cell(found, depth).select(F.col("cell").alias(cell), F.struct("level", "bytes").alias(leaf)))
    rows = docs.withColumn("n_bytes", size).withColumn(at, address(F.col(key)))
    rows = rows.withColumn(cell, prefix(F.col(at), depth)).join(few_bytes(cells, 32), cell, "left")
    deeper = found.where(F.col("bytes") > limit)
    if deeper.isEmpty():
        return _named(rows, own, at, F.col(leaf), F.lit(0))
    # cells that don't fit are opened bit by bit, by the addresses in them
    inside = sized.withColumn("cell", prefix(F.col("at"), depth)).join(deeper.select(F.col("bucket").alias("cell")), "cell", "left_semi")
    inside = materialize(inside.select(F.col("at").alias("cell"), "bytes", "most"))
    low = leaves(inside, BITS, limit, depth) if depth < BITS else found
    each = inside.select("cell", "bytes", "most", F.explode(F.sequence(F.lit(min(depth + 1, BITS)), F.lit(BITS))).alias("level"))
    each = each.withColumn("bucket", _shift("right", F.col("cell"), F.lit(BITS) - F.col("level"))).join(low.withColumnRenamed("bytes", "all"), ["level", "bucket"])
    parted = F.col("bytes") > limit
    opened = materialize(each.select(F.col("cell").alias(at), F.struct("level", F.col("all").alias("bytes"), parted.alias("parted"), "most").alias(open_)))
    rows = rows.join(few_bytes(opened, 64), at, "left")
    bucket = F.when(F.col(open_).isNull(), F.col(leaf)).otherwise(F.struct(F.col(f"{open_}.level").alias("level"), F.col(f"{open_}.bytes").alias("bytes")))
    whole = ~F.coalesce(F.col(f"{open_}.parted"), F.lit(False))
    out = _named(rows.where(whole), own, at, bucket, F.lit(0))
    return out.unionByName(_parts(rows.where(~whole).withColumn(leaf, bucket), own, at, leaf, F.col(f"{open_}.most"), limit))


def _named(rows: DataFrame, own: list[str], at: str, leaf: Column, part: Column) -> DataFrame:
    depth = leaf["level"]
    bits = F.when(depth == 0, "").otherwise(F.lpad(F.bin(_shift("rightunsigned", F.col(at), F.lit(BITS) - depth)), depth, F.lit("0")))
    return rows.select(*(F.col(f"`{c}`") for c in own), "n_bytes", bits.alias("shard"), depth.alias("shard_depth"), part.cast("long").alias("shard_part"), leaf["bytes"].alias("shard_bytes"))


def _parts(rows: DataFrame, own: list[str], at: str, leaf: str, most: Column, limit: int) -> DataFrame:
    """Rows of addresses that alone pass the limit, with the parts that they are dealt to.

    A part is what starts within limit - most + 1 bytes, so that it fits with its last row. Bytes
    are summed by address and input partition, then run over the partitions; the rows of one
    partition alone are run over together.
    """
    uid, task, step, before = unused([*own, *ADDED, at, leaf], "uid", "task", "step", "before")
    rows = numbered(rows.select(*(F.col(f"`{c}`") for c in own), "n_bytes", at, leaf, F.greatest(F.lit(1), limit - most + 1).alias(step)), uid).withColumn(task, F.shiftright(uid, 33))
    tasks = rows.groupBy(at, task).agg(F.sum("n_bytes").alias(before))
    tasks = tasks.select(at, task, (F.sum(before).over(W.partitionBy(at).orderBy(task)) - F.col(before)).alias(before))
    inside = F.sum("n_bytes").over(W.partitionBy(at, task).orderBy(uid)) - F.col("n_bytes")
    placed = rows.withColumn(uid, inside).join(few_bytes(tasks, 24), [at, task])
    return _named(placed, own, at, F.col(leaf), F.floor((F.col(before) + F.col(uid)) / F.col(step)))
