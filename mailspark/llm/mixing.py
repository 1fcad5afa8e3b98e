"""Mixing sources to target weights by systematic sampling.

Sizes are words. Sources are weighed 3, 1, 2, 3, 1, 2 and so on in order of their
names (null last) and share 150 % of all words by weight; no target exceeds twice its
source, and what is over goes to the others by weight. A source's rate, target
over size, is how many copies of each of its documents are expected. The expected
copies are summed up over the source's documents in order of size, one offset per
source is added, and a document is taken once for every whole number its stretch
of the sum crosses. So a document is taken the rate's floor or ceiling times, at most
twice, and large and small documents alike are taken at the source's rate.

The position of a document is a running count within its source, found over ordered
slices, so no source has to fit a task. The offset is a hash of the source's name:
a rerun takes the same documents.

Cases: a null or empty text has size 0 and adds no words. A source without words has
target 0. Rows equal in source, size, doc_id and text are taken for one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailspark.llm.common import own_names, sized
from mailspark.operators.skew import sums_by_range
from mailspark.session import stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2


def word_count(text: Column) -> Column:
    """Maximal runs of anything but space, tab and the line ends of ASCII."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, target`` from ``source, size`` rows.

    Limits bind the sources with the smallest limit per weight. With those before a
    source bound, the open share per weight tells whether it is bound as well.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source: the windows below are over a list of sources.
    name = [F.col("source").isNull(), F.encode("source", "utf-8")]
    place = F.row_number().over(Window.orderBy(*name)) - 1
    weight = F.get(F.array(*[F.lit(w).cast("bigint") for w in WEIGHTS]), place % len(WEIGHTS))
    named = totals.withColumn("weight", weight).withColumn("limit", F.col("source_size") * LIMIT)
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), *name)
    earlier = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    open_words = F.sum("source_size").over(everything) * F.lit(SHARE) - F.coalesce(F.sum("limit").over(earlier), F.lit(0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    ranked = named.withColumn("level", open_words / open_weight)
    # The first source that its share leaves below its limit sets the level for all.
    free = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))
    levelled = ranked.withColumn("final", F.first(free, ignorenulls=True).over(everything))
    target = F.least(F.col("final") * F.col("weight"), F.col("limit").cast("double"))
    return levelled.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def source_offset(source: Column) -> Column:
    """A number in [0, 1) from the source's name."""
    digest = F.md5(F.encode(F.concat(F.lit("mix:"), F.coalesce(source, F.lit("\u0000"))), "utf-8"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def _copies(number: Column, rate: Column, offset: Column) -> Column:
    """Whole numbers crossed between the sums before and with document ``number``."""
    return (F.floor(number * rate + offset) - F.floor((number - 1) * rate + offset)).cast("bigint")


def with_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies``.

    The columns of ``docs`` may include the text or not; ``size`` must be there.
    """
    targets = source_targets(docs)
    targets = targets.select(F.col("source").alias("_source"), "source_size", "target")
    order = ["size", "doc_id", "mark"]
    numbered = sums_by_range(docs, "source", order, {"number": F.lit(1).cast("bigint")})
    joined = numbered.join(sized(targets, 100_000), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = _copies(F.col("number").cast("double"), rate, source_offset(F.col("source")))
    return joined.withColumn("copies", copies).drop("number")


def narrow(docs: DataFrame) -> DataFrame:
    """The rows as the sampling needs them, without their texts."""
    return docs.select(
        F.col("doc_id").cast("bigint"), F.col("source").cast("string"), word_count(F.col("text")).alias("size"),
        F.xxhash64("text").alias("mark"))


def mixed_sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row."""
    found = with_copies(stored(narrow(docs), "sizes"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it is taken.

    A row that repeats doc_id, source and text counts once.
    """
    key = ["doc_id", "source", "mark"]
    sizes = stored(narrow(docs), "sizes")
    doc, source, text, mark, copies, copy = own_names("doc", "source", "text", "mark", "copies", "copy")
    marked = docs.withColumn(mark, F.xxhash64("text"))
    if not sizes.groupBy(*key).count().where("count > 1").isEmpty():
        sizes = sizes.dropDuplicates(key)
        marked = marked.dropDuplicates(["doc_id", "source", mark])
    taken = with_copies(sizes).where("copies > 0").select(
        F.col("doc_id").alias(doc), F.col("source").alias(source), F.col("mark").alias(text), F.col("copies").alias(copies))
    same = (F.col("doc_id").eqNullSafe(F.col(doc)) & F.col("source").eqNullSafe(F.col(source)) & (F.col(mark) == F.col(text)))
    joined = marked.join(sized(stored(taken, "taken"), 1_000_000), same)
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(copies))).alias(copy)).drop(copy)
