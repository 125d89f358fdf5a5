"""Operator 7 [native]: exact duplicates by an extendible-hash index in the shared folder.

A text's key is a 64-bit hash. The directory starts with one bucket; as long as some bucket is overfull and can still be
split, the directory doubles: one more leading bit of the key tells such a bucket's two halves apart. Each bucket is a key
range. Rows are dealt out by the bucket that the directory names; the task that owns it compares the texts' bytes, keeps one
entry for each distinct one, and chains those that share a key. Rows of very frequent keys are combined before they travel.
A row finds its entry by its bucket and key. Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import fresh, written

#: Bytes of distinct text that a bucket holds: a share of all within these bounds, and more only beyond so many buckets.
LEAST_BYTES, BUCKET_BYTES, SHARE_BITS, MOST_BITS = 1 << 20, 32 << 20, 9, 17
#: Leading bits that the directory tells apart beyond those of even buckets, and at most.
SPARE_BITS, MAX_DEPTH = 4, 20
#: A key is frequent beyond a 2**FREQUENT_BITS-th of all rows; so there are no more of them than that.
FREQUENT_BITS = 12


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def _prefix(key: Column, depth: int) -> Column:
    """The leading bits of a key, as a number."""
    return F.shiftrightunsigned(key, 64 - depth).cast("int") if depth else F.lit(0)


def directory(keyed: DataFrame, bucket_bytes: int, max_depth: int) -> DataFrame:
    """For each value of the leading max_depth bits, the bucket that owns it: prefix, bucket, local_depth.

    keyed has _key and _bytes. The histogram of leading bits has 2**max_depth rows at most, however large the input. A
    bucket splits while it is overfull, so all of one key stay in one bucket: the longest prefix ends its splits.
    """
    counts = keyed.groupBy(_prefix(F.col("_key"), max_depth).alias("prefix")).agg(F.sum("_bytes").alias("b"))
    owner = F.expr(f"shiftright(prefix, {max_depth} - depth)")
    doublings = F.explode(F.sequence(F.lit(0), F.lit(max_depth - 1))).alias("depth")
    # at each depth, the buckets that are overfull; what lies above such a bucket is overfull too
    overfull = counts.select("prefix", "b", doublings).groupBy("depth", owner.alias("owner")).agg(F.sum("b").alias("t")).filter(F.col("t") > bucket_bytes).select("depth", "owner")
    cells = keyed.sparkSession.range(0, 1 << max_depth, 1, 1).select(F.col("id").cast("int").alias("prefix"))
    split = cells.select("prefix", doublings).withColumn("owner", owner).join(F.broadcast(overfull), ["depth", "owner"], "left_semi")
    deep = cells.join(split.groupBy("prefix").count(), "prefix", "left").select("prefix", F.coalesce("count", F.lit(0)).cast("int").alias("local_depth"))
    first = F.expr(f"shiftleft(shiftright(prefix, {max_depth} - local_depth), {max_depth} - local_depth)")
    return deep.select("prefix", first.alias("bucket"), "local_depth")


def _owned(rows: DataFrame, owners: DataFrame, max_depth: int) -> DataFrame:
    """rows, which have _key, with the bucket that the directory names."""
    return rows.join(F.broadcast(owners.select("prefix", "bucket")), _prefix(F.col("_key"), max_depth) == F.col("prefix")).drop("prefix")


def index(docs: DataFrame, id_: str = "doc_id", text: str = "text", key=text_key, bucket_bytes: int | None = None, max_depth: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """The index and its directory as tables in the shared folder, and the directory's depth.

    The index has one row for each distinct text (null counts as empty): bucket, key, chain (numbers the texts of one key from
    1), chains (how many there are), keep_id, group_size, text_sha256, and _text where a key has several. A file holds the
    buckets of one owner, in order. bucket_bytes and max_depth follow the input where they aren't given.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_).alias("_id"), body.alias("_text")).withColumn("_key", key(F.col("_text")))
    # of a key's texts the longest counts: different texts with one key are as good as never found
    sizes = written(rows.groupBy("_key").agg(F.max(F.octet_length("_text")).alias("_bytes"), F.count(F.lit(1)).alias("_n")), "keys")
    total, many = sizes.agg(F.sum("_bytes"), F.sum("_n")).first()
    total, many = total or 0, many or 0
    bucket_bytes = bucket_bytes or max(min(BUCKET_BYTES, max(LEAST_BYTES, total >> SHARE_BITS)), total >> MOST_BITS)
    max_depth = max_depth or min(MAX_DEPTH, (total // bucket_bytes).bit_length() + SPARE_BITS)
    # 2**max_depth rows at most, in one file
    owners = written(directory(sizes, bucket_bytes, max_depth).coalesce(1), "directory")
    frequent = F.broadcast(sizes.filter(F.col("_n") > 16 + (many >> FREQUENT_BITS)).select(F.col("_key").alias("_often")))
    one = F.struct(F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
    often = rows.join(frequent, F.col("_key") == F.col("_often"), "left_semi").groupBy("_key", "_text").agg(F.struct(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("n")).alias("e"))
    seldom = rows.join(frequent, F.col("_key") == F.col("_often"), "left_anti").select("_key", "_text", one.alias("e"))
    tasks = max(1, min(owners.select("bucket").distinct().count(), max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_BYTES)))
    dealt = _owned(seldom.unionByName(often), owners, max_depth).repartition(tasks, "bucket")
    entries = dealt.groupBy("bucket", "_key", "_text").agg(F.max("e.keep_id").alias("keep_id"), F.sum("e.n").alias("group_size"))
    of_key = Window.partitionBy("bucket", "_key")
    chained = entries.withColumns({"chain": F.row_number().over(of_key.orderBy("_text")), "chains": F.count(F.lit(1)).over(of_key)})
    shown = chained.select("bucket", F.col("_key").alias("key"), "chain", "chains", "keep_id", "group_size", F.sha2("_text", 256).alias("text_sha256"), F.when(F.col("chains") > 1, F.col("_text")).alias("_text"))
    return written(shown.sortWithinPartitions("bucket", "key", "chain"), "index"), owners, max_depth


def exact_duplicates(docs: DataFrame, id_: str = "doc_id", text: str = "text", key=text_key, bucket_bytes: int | None = None, max_depth: int | None = None) -> DataFrame:
    """One row for each row of docs: id_, keep_id, group_size, kept, text_sha256.

    Texts are equal when all their bytes are; a null text counts as empty. Of equal texts the row with the largest id stays;
    a null id is smaller than any. Rows repeated with their id are all kept or all dropped together, and each counts in
    group_size. Empty texts form a group like others. An empty table gives an empty result; other columns are not read.
    """
    found, owners, depth = index(docs, id_, text, key, bucket_bytes, max_depth)
    body = F.coalesce(F.col(text), F.lit(""))
    kept = F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept")
    columns = (F.col("_id").alias(id_), "keep_id", "group_size", kept, "text_sha256")
    rows = _owned(docs.select(F.col(id_).alias("_id"), key(body).alias("_key")), owners, depth)
    out = rows.join(found.filter("chains = 1").withColumnRenamed("key", "_key"), ["bucket", "_key"]).select(*columns)
    chained = found.filter("chains > 1").withColumnsRenamed({"key": "_key", "_text": "_entry"})
    if not chained.isEmpty():  # keys that different texts share: there the texts tell which entry is a row's own
        texts = _owned(docs.select(F.col(id_).alias("_id"), key(body).alias("_key"), body.alias("_text")), owners, depth)
        out = out.unionByName(texts.join(chained, ["bucket", "_key"]).filter("_text = _entry").select(*columns))
    return out


def keep_one(docs: DataFrame, id_: str = "doc_id", text: str = "text", key=text_key) -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows repeated with their id and text one stays.

    Nulls, empty texts, ties and empty tables as in exact_duplicates().
    """
    found, owners, depth = index(docs, id_, text, key)
    k, p, b = fresh(docs, "_k"), fresh(docs, "_p"), fresh(docs, "_b")
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.withColumn(k, key(body))
    keyed = keyed.join(F.broadcast(owners.select(F.col("prefix").alias(p), F.col("bucket").alias(b))), _prefix(F.col(k), depth) == F.col(p))
    entries = found.select(F.col("bucket").alias("_entry_bucket"), F.col("key").alias("_entry_key"), F.col("keep_id").alias("_entry_id"), F.col("_text").alias("_entry_text"))
    same = (keyed[b] == entries["_entry_bucket"]) & (keyed[k] == entries["_entry_key"]) & keyed[id_].eqNullSafe(entries["_entry_id"])
    out = keyed.join(entries, same & (entries["_entry_text"].isNull() | (F.coalesce(keyed[text], F.lit("")) == entries["_entry_text"])), "left_semi")
    again = docs.select(F.col(id_).alias("i"), key(body).alias("k")).groupBy("i", "k").count().filter("count > 1")
    if not again.isEmpty():
        t = fresh(docs, "_t")
        out = out.withColumn(t, body).dropDuplicates([id_, k, t]).drop(t)
    return out.drop(k, p, b)
