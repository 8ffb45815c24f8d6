"""Operator 9, mixing sources to target weights: a time-varying curriculum (native).

Each source gets a target number of words. Within a source, documents stand in a
hashed order; whole passes and one partial pass over that order take the target.
A source's demand over training time t in [0, 1] follows its weight schedule
rate(t) = target * (1 + tilt * (2t - 1)), whose integral is
D(t) = target * (t + tilt * (t^2 - t)). A copy of a document that begins at the source's
cumulative word c, words of earlier passes included, stands at t = D^-1(c); sorting the
copies by t gives the training order.

Prefix sums are taken in two levels (hash buckets, then rows inside a bucket), so a
source with a third of all rows is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memloom.llm.common import WORD, cut, table

#: Weights by the sources' order, repeated; words taken per word that there is; most passes over a source.
WEIGHTS, SHARE, PASSES = (3.0, 1.0, 2.0), 1.5, 2.0
#: Slope of the schedules by the sources' order, repeated: early, even, late.
TILTS = (-0.5, 0.0, 0.5)
#: Hash buckets of a source's order. At 2^16 buckets a source of 10^11 documents has about 10^6 in each.
BUCKETS = 1 << 16
#: Shares of the rows that are equal in id, text and all else.
PARTS = 1 << 10


def word_count(text: Column) -> Column:
    """Number of words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target, tilt) of each source, from (source, size) rows.

    Shares follow the weights; what exceeds PASSES times a source's size goes to the
    others by weight until none is above. In closed form: with sources in order of
    cap / weight, those before the first whose share fits are at their cap. Works on
    one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("rank") % len(values) + 1).cast("int"))
    per = per.withColumn("rank", rank).withColumn("weight", pick(WEIGHTS)).withColumn("tilt", pick(TILTS)).withColumn("cap", PASSES * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = SHARE * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left / weight_left)
    fits = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("level")).alias("x"))).over(everything)
    level = F.coalesce(fits["level"], F.lit(float("inf")))
    return per.select("source", "source_size", F.least(F.col("cap"), level * F.col("weight")).alias("target"), "tilt")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None, same_col: str | None = None) -> DataFrame:
    """One row per document, in training order: id, size, source_size, target, taken, position
    (of its first word, 0 to 1; null if nothing is taken), positions (one of each copy, by pass;
    empty if nothing is taken).

    A document is taken whole, `passes` times: the source's whole passes, and once more
    if the partial pass reaches its middle, so a source's taken words are within half a
    document of its target. taken <= 2 * size. A null source is a source of its own, the
    last; a null or wordless text has size 0 and takes nothing. The order is that of a hash of id
    and text alone, so it is the same wherever the rows are stored; rows of equal id and text stand together. With row_col, a key
    of each row, the result has it too; same_col then says which of those rows are equal in all else (a hash of the
    other columns): they follow it, and only which of wholly equal rows has which place is open. An empty table
    gives an empty result. Other columns are ignored, whatever their names. Reruns agree.
    """
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    h = F.xxhash64(F.col(id_col), F.col(text_col), F.lit("order"))
    same = F.col(same_col).cast("long") if same_col else F.lit(0).cast("long")
    rows = docs.select(F.col(id_col).alias("key"), row.alias("row"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), h.alias("h"), F.xxhash64(F.col(text_col)).alias("tie"), same.alias("same"))
    # rows of equal id and text are dealt over parts, which are numbered and then counted like rows
    rows = rows.withColumn("part", F.pmod(F.xxhash64("row", F.lit("part")), F.lit(PARTS)).cast("int"))
    rows = cut(rows.withColumn("bucket", F.shiftrightunsigned("h", 64 - (BUCKETS.bit_length() - 1)).cast("int")), "mix-sizes")
    targets = source_targets(rows)
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    high = F.shiftright("bucket", 8)
    # offsets of buckets: groups of 256 first, so that no window holds more than 256 rows
    tops = sums.groupBy("source", high.alias("top")).agg(F.sum("n").alias("n"))
    upto = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    tops = tops.select(F.col("source").alias("s1"), F.col("top").alias("t1"), zero(F.sum("n").over(upto(W.partitionBy("source").orderBy("top")))).alias("base1"))
    lows = sums.select("source", "bucket", high.alias("top"), zero(F.sum("n").over(upto(W.partitionBy("source", high).orderBy("bucket")))).alias("base2"))
    offsets = lows.join(tops, F.col("source").eqNullSafe(F.col("s1")) & (F.col("top") == F.col("t1"))).join(targets.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2")))
    offsets = offsets.select(F.col("source").alias("s3"), F.col("bucket").alias("b3"), (F.col("base1") + F.col("base2")).alias("base"), "source_size", "target", "tilt")
    alike = F.struct("source", "bucket", "h", "key", "tie", "same", "part").alias("alike")
    parts = rows.groupBy(alike).agg(F.sum("size").alias("n")).select("n", "alike", F.col("alike.source").alias("source"), F.col("alike.bucket").alias("bucket"))
    parts = parts.withColumn("inside", zero(F.sum("n").over(upto(W.partitionBy("source", "bucket").orderBy(*(f"alike.{c}" for c in ("h", "key", "tie", "same", "part")))))))
    parts = parts.join(offsets, F.col("source").eqNullSafe(F.col("s3")) & (F.col("bucket") == F.col("b3")))
    parts = parts.select(F.col("alike").alias("its"), (F.col("base") + F.col("inside")).alias("before"), "source_size", "target", "tilt")
    rows = rows.select("key", "row", "size", alike)
    placed = rows.withColumn("nth", F.row_number().over(W.partitionBy("alike").orderBy("row")) - 1).join(parts, F.col("alike") == F.col("its"))
    start = F.col("before") + F.col("nth") * F.col("size")
    whole = F.floor(F.col("target") / F.col("source_size"))
    part = F.col("target") - whole * F.col("source_size")
    passes = F.when(F.col("size") == 0, 0).otherwise(whole + (start + F.col("size") / 2 <= part).cast("long"))
    placed = placed.withColumn("passes", passes).withColumn("taken", (F.col("passes") * F.col("size")).cast("long"))

    def at(no: Column) -> Column:
        """The share of demand that lies before the first word in pass `no`, and its inverse in time."""
        u, a = F.least((no * F.col("source_size") + start) / F.col("target"), F.lit(1.0)), F.col("tilt")
        root = F.sqrt((1 - a) * (1 - a) + 4 * a * u)
        return F.when(a == 0, u).otherwise(F.abs((a - 1 + root) / (2 * a)))

    positions = F.when(F.col("taken") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1), at)).otherwise(F.array().cast("array<double>"))
    placed = placed.withColumn("positions", positions)
    out = placed.select(F.col("key").alias(id_col), *([F.col("row").alias(row_col)] if row_col else []), "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("position"), "positions")
    return out.repartitionByRange(F.col("position").asc_nulls_last(), F.col(id_col)).sortWithinPartitions(F.col("position").asc_nulls_last(), id_col)


def repeated(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", row_col: str | None = None, position_col: str | None = None) -> DataFrame:
    """The mix itself: rows of docs with each document as often as it is taken, every copy at its
    own position of the training order. Rows are joined by row_col where both have it, else by ids,
    which must then be unique and not null; docs keeps its columns, whatever their names, and gets position_col if one is given."""
    on = row_col or id_col
    plan = mixed.filter("taken > 0").select(F.col(on).alias("key"), F.explode("positions").alias("at"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), F.col(on).alias("its"), F.col(id_col).alias("id"))
    out = rows.join(plan, F.col("its") == F.col("key"))
    if position_col:
        out = out.withColumn("own", F.col("own").withField(f"`{position_col}`", F.col("at")))
    return out.repartitionByRange("at", "id", "key").sortWithinPartitions("at", "id", "key").select("own.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, and where each copy stands."""
    return mix(table(spark, sf_dir, "documents"))
