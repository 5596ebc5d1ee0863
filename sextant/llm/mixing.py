"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Each source has a target number of words (``targets``). Every document gets
target / source size copies, rounded down, for certain. The rest of the target is
a sample with unequal probabilities: a document is included in proportion to its
words, p = min(1, scale * size), so that the expected words are the rest exactly;
those of p = 1 are certain. The others are ranked by random odds u / (1 - u)
divided by inclusion odds p / (1 - p) (Rosen, 1997) and taken in that order until
the rest is filled.

The sample's fixed size is counted in words. The document that would overrun the
rest is passed over, and the gap is filled from all those behind it that still fit,
``FILLS`` times. Ranks fall into bins of bounded expected size; sums of bins tell
which bin holds the border, bins before it are taken whole, so only the rows of one
bin of each source are sorted together.

u comes from an MD5 of seed, doc_id and size, so reruns agree. Null text has no
words; a null source is a source of its own, the last. A source without words has
target 0. Rows that repeat a doc_id and size share u and are told apart by their
place in the table. An empty table gives none. Other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import WORD_CLASS, fresh, numbered, stored

WEIGHTS = (3.0, 1.0, 2.0)
#: The mix's words over all words, and the most copies of a document.
SHARE = 1.5
MOST = 2
SEED = "mix"
#: Rows that one bin of ranks holds on average.
BIN_ROWS = 2000
#: Times that documents are taken in order until one does not fit: the sample itself, then the gap left.
FILLS = 5


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def uniform(*key: Column) -> Column:
    """A number strictly between 0 and 1 that the key decides."""
    text = F.concat_ws("|", F.lit(SEED), *[F.coalesce(k.cast("string"), F.lit("")) for k in key])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def sized(docs: DataFrame, row: Column) -> DataFrame:
    """doc_id, source, size, u and row (a locator) of each document, stored: texts are read once."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), row.alias("row")
    )
    return stored(rows.withColumn("u", uniform(F.col("doc_id"), F.col("size"))), "mix-sizes")


def targets(rows: DataFrame) -> DataFrame:
    """source, source_size, n_rows, target, by water filling.

    Weights repeat over sources in order of code points, null last. Sorted by cap
    over weight, a source is capped if its share of what the sources before it
    leave reaches its cap; the uncapped ones share the rest by weight. The window
    runs over one row for each source.
    """
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.pmod(F.row_number().over(by_name) - F.lit(1), F.lit(len(WEIGHTS)))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (nth + F.lit(1)).cast("int"))
    every = Window.partitionBy()
    listed = sources.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * F.lit(MOST)).cast("double"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * F.lit(SHARE) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    waiting = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = listed.withColumn("level", left / waiting).withColumn("capped", F.col("weight") * F.col("level") >= F.col("cap"))
    # the first source that is not capped has the level of all that follow
    final = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level").alias("level")))).over(every)["level"]
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * final)
    return level.select("source", "source_size", "n_rows", target.alias("target"))


def planned(totals: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds certain copies, the words left to sample, the scale of probabilities and the number of bins.

    Sizes from ``t`` on are certain if the scale that the others need for the rest of
    the words, (need - words of size t or more) / (squares of words below t), times
    the largest size below is at most 1. This runs over one row for each source and
    distinct size.
    """
    per_row = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = (
        totals.withColumn("certain", F.floor(per_row).cast("long"))
        .withColumn("need", F.col("target") - (F.col("certain") * F.col("source_size")).cast("double"))
        .withColumn("bins", F.ceil(F.col("n_rows") / F.lit(BIN_ROWS)).cast("long"))
    )
    sizes = rows.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("c"))
    by_size = Window.partitionBy("source").orderBy("size")
    exact = lambda x: x.cast("decimal(38,0)")
    words, squares = exact(F.col("size")) * exact(F.col("c")), exact(F.col("size")) * exact(F.col("size")) * exact(F.col("c"))
    above = F.coalesce(F.sum(words.cast("decimal(38,0)")).over(by_size.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)).cast("double")
    below = F.sum(squares.cast("decimal(38,0)")).over(by_size.rowsBetween(Window.unboundedPreceding, 0)).cast("double")
    steps = sizes.select("source", "size", above.alias("above"), below.alias("below"))
    fits = _by_source(steps, plan)
    fits = fits.withColumn("scale", (F.col("need") - F.col("above")) / F.col("below")).where(F.col("scale") * F.col("size") <= 1)
    # of all steps that fit, the one with the largest sizes leaves the fewest certain
    best = fits.groupBy("source").agg(F.max(F.struct("size", "scale"))["scale"].alias("scale"))
    return _by_source(plan, best, "left").withColumn("scale", F.coalesce("scale", F.lit(0.0)))


def _by_source(rows: DataFrame, facts: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the facts of their source, null being one."""
    named = facts.withColumnRenamed("source", "_of")
    return rows.join(named, rows["source"].eqNullSafe(named["_of"]), how).drop("_of")


def filled(rows: DataFrame, gaps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``chosen`` for those taken as well, and the gap that each source has left.

    Of the rows not chosen yet and no larger than their source's gap, those in rank
    order are taken as long as they fit into the gap together.
    """
    asked = _by_source(rows, gaps, "left")
    fits = ~F.col("chosen") & (F.col("size") > 0) & (F.col("size") <= F.col("gap"))
    asked = stored(asked.withColumn("fits", F.coalesce(fits, F.lit(False))), "mix-asked")
    sums = asked.where("fits").groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("gap").alias("gap"))
    up_to = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    over = sums.withColumn("up_to", F.sum("words").over(up_to)).where(F.col("up_to") > F.col("gap"))
    border = over.groupBy("source").agg(F.min(F.struct("bin", (F.col("gap") - (F.col("up_to") - F.col("words"))).alias("room"))).alias("b"))
    border = stored(border.select("source", F.col("b.bin").alias("border"), F.col("b.room").alias("room")), "mix-borders")
    placed = _by_source(asked, border, "left")
    here = F.col("fits") & F.coalesce(F.col("bin") == F.col("border"), F.lit(False))
    so_far = Window.partitionBy("source").orderBy("rank", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    near = placed.where(here).withColumn("now", F.sum("size").over(so_far) <= F.col("room"))
    far = placed.where(~here).withColumn("now", F.col("fits") & (F.col("border").isNull() | (F.col("bin") < F.col("border"))))
    done = far.unionByName(near)
    out = stored(done.withColumn("chosen", F.col("chosen") | F.col("now")).drop("fits", "border", "room"), "mix-chosen")
    left = out.groupBy("source").agg((F.first("gap") - F.sum(F.when(F.col("now"), F.col("size")).otherwise(F.lit(0)))).alias("gap"))
    return out.drop("now", "gap"), stored(left, "mix-gaps")


def taken(docs: DataFrame, row: Column) -> DataFrame:
    """row, doc_id, size, source_size, target and copies of each document."""
    rows = sized(docs, row)
    plan = stored(planned(stored(targets(rows), "mix-sources"), rows), "mix-targets")
    joined = _by_source(rows, plan)
    p = F.col("scale") * F.col("size")
    ratio = (F.col("u") / (F.lit(1.0) - F.col("u"))) / (p / (F.lit(1.0) - p))
    # rank in 0..1 rises with the ratio; the certain come first, those without words last
    rank = F.when(F.col("size") == 0, F.lit(1.0)).when((F.col("scale") <= 0) | (p >= 1), F.lit(0.0)).otherwise(ratio / (F.lit(1.0) + ratio))
    ranked = joined.withColumn("rank", rank).withColumn("bin", F.least(F.floor(F.col("rank") * F.col("bins")), F.col("bins") - F.lit(1)))
    ranked = ranked.withColumn("chosen", F.lit(False)).drop("need", "u", "scale", "bins", "n_rows")
    gaps = plan.select("source", F.col("need").alias("gap"))
    for _ in range(FILLS):
        ranked, gaps = filled(ranked, gaps)
    return ranked.select("row", "doc_id", "size", "source_size", "target", (F.col("certain") + F.col("chosen").cast("long")).alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted)."""
    rows = taken(docs, F.monotonically_increasing_id())
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def repeat(docs: DataFrame, copies: str = "mix_copies", from_files: bool = False) -> DataFrame:
    """``docs`` with each document as often as the mix takes it, none if never.

    Documents without words are never taken. The number of a copy is in the column
    named, which must be new; the other columns are as they came.

    ``from_files`` says that ``docs`` are a Parquet table as read, at most filtered and
    projected. Its rows are then known by file and place, and no copy of them is stored.
    """
    if copies.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs already has a column named {copies}")
    row, n = fresh(docs, "_mix_row"), fresh(docs, "_mix_copies")
    rows = numbered(docs, row, "mix-rows", from_files)
    kept = taken(rows, F.col(row)).where("copies > 0 AND size > 0").select(F.col("row").alias(row), F.col("copies").cast("int").alias(n))
    return rows.join(kept, row).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(n)))).drop(row, n)
