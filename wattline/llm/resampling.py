"""Importance resampling of documents towards a target's distribution of hashed word n-grams, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.runtime import checkpointed, task_count

#: What stands between words once A-Z are lower case: all of ASCII but digits and a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Copies of one row that are numbered by one row of a range partition before they are expanded.
RUN = 1 << 16


def words(text: Column) -> Column:
    """The words of a whole text; those of null are none."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, BETWEEN), "")


def hashed_features(rows: DataFrame, buckets: int) -> DataFrame:
    """``rows`` (with the array ``words``) once for each run of 1 to 3 words: place, extra (words beyond the first), bucket.

    A row without words comes once, without place and bucket.
    """
    w = F.col("words")
    # Each word beside the two after it; the arrays of n-grams are those of one starting place, so none is longer than three.
    zipped = F.arrays_zip(w.alias("a"), F.slice(w, 2, F.greatest(F.size(w), F.lit(1))).alias("b"), F.slice(w, 3, F.greatest(F.size(w), F.lit(1))).alias("c"))
    at = rows.select(*[c for c in rows.columns if c != "words"], F.posexplode_outer(zipped).alias("place", "met"))
    a, b, c = F.col("met.a"), F.col("met.b"), F.col("met.c")
    grams = F.array(a, F.concat(a, F.lit(" "), b), F.concat(a, F.lit(" "), b, F.lit(" "), c))
    every = at.select(*[x for x in at.columns if x != "met"], F.posexplode(grams).alias("extra", "gram")).where("gram is not null or (place is null and extra = 0)")
    return every.withColumn("bucket", (F.crc32(F.col("gram").cast("binary")) % buckets).cast("int")).drop("gram")


def bucket_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n): how many features of all ``texts`` (column text) fall into each bucket; counted in each task before the shuffle."""
    found = hashed_features(texts.select(words(F.col("text")).alias("words")), buckets)
    return found.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


def gain_table(docs: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) for every bucket: a thousand times the log of how much likelier the target makes it, rounded down."""
    spark = docs.sparkSession
    ours, theirs = (checkpointed(bucket_counts(x, buckets)) for x in (docs, target))
    total, target_total = (int(x.agg(F.sum("n")).first()[0] or 0) for x in (ours, theirs))
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(ours.withColumnRenamed("n", "s"), "bucket", "left").join(theirs.withColumnRenamed("n", "t"), "bucket", "left")
    n = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("double") + 1.0
    ratio = n("t") * F.lit(float(total + buckets)) / (n("s") * F.lit(float(target_total + buckets)))
    return both.select("bucket", F.floor(1000.0 * F.ln(ratio)).cast("long").alias("gain"))


def gumbel(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths that depends on the id alone; a null id counts as an empty text."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    unit = (F.conv(F.substring(digits, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000.0 * F.ln(-F.ln(unit))).cast("long")


def resample_by_importance(docs: DataFrame, target: DataFrame, buckets: int = 10_000, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """A draw of ``docs`` that resembles ``target``: doc_id, n_features, weight, score, rank (null: not drawn), one row a document.

    Features are the runs of 1 to 3 words of whole texts, hashed to ``buckets``
    by crc32. A bucket's gain compares its share of the target's features with
    that of all documents'; a document's weight is the sum over its features, its
    score the weight with Gumbel noise. Of the documents with ``least_words``
    words or more, ``percent`` in a hundred are drawn by the highest score, ties
    to the smaller doc_id, then to the smaller hash of the text.

    Counts meet in each task before they are shuffled, and only the table of
    ``buckets`` gains is broadcast. Ranks come from a range-partitioned sort: the
    place in a partition plus the rows of the partitions before it.

    Null and empty texts have no features and weigh 0; a null id has the noise
    of an empty one and stands last among ties; repeated rows are counted and
    drawn one by one; rows that share an id but not the text are told apart by
    the text's hash; a very long text is one array of words in its task; an empty
    table gives no rows, an empty target gives every bucket no target share;
    other columns are ignored.
    """
    spark = docs.sparkSession
    gains = gain_table(docs, target, buckets)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("tie"), words(F.col("text")).alias("words"))
    weighed = hashed_features(rows.withColumn("enough", F.size("words") >= least_words), buckets).join(F.broadcast(gains), "bucket", "left")  # ``buckets`` rows
    first = (F.col("extra") == 0) & (F.coalesce(F.col("place"), F.lit(0)) == 0)
    summed = weighed.groupBy("doc_id", "tie").agg(F.count_if(first).alias("copies"), F.count("bucket").alias("features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("gains"), F.max("enough").alias("enough"))
    # Exact repeats of a row have met in one group, in equal parts.
    each = summed.select("doc_id", "tie", "copies", "enough", F.expr("features div copies").alias("n_features"), F.expr("gains div copies").alias("weight"))
    scored = checkpointed(each.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    drawn = int(scored.where("enough").agg(F.sum("copies")).first()[0] or 0) * percent // 100

    order = [F.desc("enough"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("tie"), F.asc("run")]
    in_runs = scored.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {RUN}"))))
    dealt = in_runs.repartitionByRange(task_count(spark), *order).sortWithinPartitions(*order)
    single = dealt.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("copies") - F.col("run") * RUN, F.lit(RUN)))))
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = checkpointed(single.select("doc_id", "n_features", "weight", "score", "enough", F.spark_partition_id().alias("part"), at.alias("at")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.col("offset") + F.col("at") + 1
    return placed.join(F.broadcast(offsets), "part").select("doc_id", "n_features", "weight", "score", F.when(F.col("enough") & (rank <= drawn), rank).cast("long").alias("rank"))
