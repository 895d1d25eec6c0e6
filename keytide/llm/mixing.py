"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions alone.

Every source gets a target number of words. Its documents are taken whole as often as the target holds the source
(certain copies). For the words that are left, each document has an inclusion probability p in proportion to its size,
such that the expected words are those missing; documents for which that proportion reaches 1 are certain as well.

The others are dealt into classes by size (STEPS to a doubling). A class's sample has a fixed size, the sum of its p,
rounded by systematic sampling over the classes with one random start a source, so that the sizes add up to the source's.
The sample is the first so many documents in the order of Pareto ranks, the random odds u/(1-u) over the inclusion odds
p/(1-p). As drawn sizes differ from expected ones, each class, from the largest documents to the smallest, then moves its
cut by at most NEAR ranks to the one that brings the source's words nearest to the target. No document is ever taken
before one of its class that has a smaller rank.

The cut is found without gathering a class in one task: ranks fall into about sqrt(n) bins a class, whose numbers and
words are accumulated, and only the bins around the cut are sorted. What is broadcast is one row a class, and only when a
count has shown that there are at most MAX_BROADCAST; beyond that the join is left to Spark.

Defined cases: a null text has size 0 and is never taken, nor is one without words; a very long text counts whole; a null
source is a source of its own, ordered last; a null id is an id like any other; rows that repeat id, text and source have
one rank and are taken or left together; an empty table gives an empty result; further columns play no part.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Largest number of copies of a document, and so of a source's target in units of its size.
MAX_COPIES = 3
#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (1, 2, 3)
#: Size classes to a doubling, and ranks by which a class's cut may move.
STEPS, NEAR = 4, 64
#: Rows of the plan, one a class and source: with this many the broadcast stays under 20 MB.
MAX_BROADCAST = 100_000
#: Probabilities are added up as whole numbers of this, so that sums don't depend on their order.
GRAIN = 1 << 30


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def random_unit(*columns: Column) -> Column:
    """A number in (0, 1) that depends on the values alone: the high 53 bits of their hash."""
    return (F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") + 0.5) / F.lit(float(2**53))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else df


def _eq(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_COPIES) -> DataFrame:
    """A row a source (source, source_size): adds its target.

    Names are numbered by a sort in ranges: a row's number is that in its range after those of the ranges before. Then
    the excess of the sources above their caps is reshared by weight until none is; each round is one aggregate.
    """
    spark = sizes.sparkSession
    order = [F.col("source").isNull(), F.col("source")]
    ranged = common.materialize(sizes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    # One row a range.
    counts = sorted((r.part, r["count"]) for r in ranged.groupBy(F.shiftright("at", 33).alias("part")).count().collect())
    before = [(part, sum(n for _, n in counts[:i])) for i, (part, _) in enumerate(counts)]
    starts = spark.createDataFrame(before, "part long, before long")
    number = (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))) % len(weights)
    weighed = common.materialize(
        ranged.join(F.broadcast(starts), F.shiftright("at", 33) == F.col("part")).select(*sizes.columns, F.element_at(F.array(*map(F.lit, weights)), (number + 1).cast("int")).cast("long").alias("weight"))
    )
    words, weight = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level, above = Fraction(words, weight or 1), 0
    limit = F.col("source_size") * cap
    while True:
        capped = weighed.where(limit < F.lit(float(level)) * F.col("weight"))
        n, full, used = capped.agg(F.count(F.lit(1)), F.coalesce(F.sum(limit), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if n <= above or used == weight:
            break
        level, above = Fraction(words - full, weight - used), n
    return weighed.select(*sizes.columns, F.least(limit.cast("double"), F.lit(float(level)) * F.col("weight")).alias("target"))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """doc_id, source, size, size class and the random number u of every row."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        random_unit(F.lit(seed), F.col(id_col), F.col(text_col)).alias("u"),
    )
    return rows.withColumn("step", size_class(F.col("size")))


def size_class(size: Column) -> Column:
    """Number of a size's class; -1 for no words."""
    return F.when(size > 0, F.floor(F.log2(size.cast("double")) * STEPS).cast("int")).otherwise(-1)


def rank(u: Column, p: Column) -> Column:
    """Pareto rank: random odds over inclusion odds."""
    return (u / (1 - u)) / (p / (1 - p))


def laws(rows: DataFrame) -> DataFrame:
    """From the rows of sized(), a row a source and class: source_size, target, copies, the words still missing, and the proportion by which a size becomes a probability, or null where nothing is missing."""
    spark = rows.sparkSession
    square = (F.col("size") * F.col("size")).cast("decimal(20,0)")
    classes = common.materialize(rows.groupBy("source", "step").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"), F.sum(square).cast("double").alias("squares"), F.min("size").alias("least")))
    aims = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    aims = (
        aims.withColumn("copies", F.least(F.floor(ratio), F.lit(MAX_COPIES)).cast("long"))
        .withColumn("missing", F.greatest(F.col("target") - F.col("copies") * F.col("source_size"), F.lit(0.0)))
        .withColumnRenamed("source", "s")
    )
    falling = W.partitionBy("source").orderBy(F.desc("step"))
    up = falling.rowsBetween(W.unboundedPreceding, -1)
    joined = classes.join(_small(common.materialize(aims)), _eq("source", "s")).drop("s")
    # From the largest class on, classes are certain while the proportion for the rest would give their smallest document 1.
    rest = joined.withColumns(
        {
            "above": F.coalesce(F.sum("words").over(up), F.lit(0)),
            "below": F.sum(F.when(F.col("step") >= 0, F.col("squares")).otherwise(0.0)).over(falling.rowsBetween(W.currentRow, W.unboundedFollowing)),
        }
    ).withColumn("own", F.when((F.col("below") > 0) & (F.col("missing") > 0), (F.col("missing") - F.col("above")) / F.col("below")))
    open_ = F.col("own").isNotNull() & (F.col("own") * F.col("least") < 1)
    first = F.max(F.when(open_, F.struct("step", "own"))).over(W.partitionBy("source"))
    return rest.withColumn("proportion", first["own"]).select("source", "step", "n", "source_size", "target", "copies", "missing", "proportion")


def _drawn(law: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (source, step, size, u) with their law's columns, the probability p, the rank q and its bin; p is null where nothing is drawn."""
    met = rows.join(law, _eq("source", "law_source") & (F.col("step") == F.col("law_step")))
    p = F.when((F.col("size") > 0) & F.col("proportion").isNotNull(), F.least(F.col("proportion") * F.col("size"), F.lit(1.0)))
    # As u among equal probabilities, so that the bins fill alike.
    even = F.col("q") * F.col("odds")
    return (
        met.withColumn("p", p)
        .withColumn("q", F.when(F.col("p") < 1, rank(F.col("u"), F.col("p"))))
        .withColumn("odds", F.col("middle") / (1 - F.col("middle")))
        .withColumn("bin", F.floor(even / (1 + even) * F.ceil(F.sqrt(F.col("n").cast("double")))).cast("long"))
    )


def _as_law(found: DataFrame) -> DataFrame:
    """The laws under names that rows don't have, with a probability in the middle of each class."""
    middle = F.col("proportion") * F.pow(F.lit(2.0), (F.col("step") + 0.5) / STEPS)
    return found.withColumn("middle", F.least(F.greatest(middle, F.lit(1e-9)), F.lit(1 - 1e-9))).withColumnsRenamed({"source": "law_source", "step": "law_step"})


def plan(rows: DataFrame, seed: int = 0) -> DataFrame:
    """From the rows of sized(), a row a source and class: its law, and the rank up to which documents are taken once more."""
    spark = rows.sparkSession
    found = common.materialize(_as_law(laws(rows)))
    small = _small(found)
    drawn = _drawn(small, rows.select("source", "step", "size", "u"))
    units = F.sum(F.round(F.col("p") * GRAIN).cast("long"))
    # Certain documents are in the bin -1, documents of which nothing is drawn in none.
    bins = common.materialize(drawn.where("p is not null").groupBy("source", "step", F.coalesce("bin", F.lit(-1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"), units.alias("units"), F.first("missing").alias("missing")))
    sizes = bins.groupBy("source", "step").agg(
        F.sum(F.when(F.col("bin") >= 0, F.col("units"))).alias("units"), F.sum(F.when(F.col("bin") < 0, F.col("words")).otherwise(0)).alias("certain"), F.first("missing").alias("missing")
    )
    falling = W.partitionBy("source").orderBy(F.desc("step"))
    start = random_unit(F.lit(seed), F.lit("start"), F.coalesce("source", F.lit(""))) * GRAIN
    upto = F.coalesce(F.sum("units").over(falling), F.lit(0))
    fixed = common.materialize(
        sizes.withColumn("upto", upto)
        .withColumn("size_fixed", (F.floor((F.col("upto") + start) / GRAIN) - F.floor((F.col("upto") - F.coalesce("units", F.lit(0)) + start) / GRAIN)).cast("long"))
        .select(F.col("source").alias("s"), F.col("step").alias("c"), "size_fixed", "certain", "missing", F.col("units").isNotNull().alias("drawn"))
    )
    # The bins in which the cut may fall.
    within = W.partitionBy("source", "step").orderBy("bin")
    near = (
        bins.where("bin >= 0")
        .withColumn("n_before", F.sum("n").over(within) - F.col("n"))
        .withColumn("words_before", F.sum("words").over(within) - F.col("words"))
        .join(_small(fixed), _eq("source", "s") & (F.col("step") == F.col("c")))
        .where((F.col("n_before") < F.col("size_fixed") + NEAR) & (F.col("n_before") + F.col("n") > F.col("size_fixed") - NEAR))
        .select(F.col("source").alias("s"), F.col("step").alias("c"), F.col("bin").alias("b"), "size_fixed", "n_before", "words_before")
    )
    near = common.materialize(near)
    by_rank = W.partitionBy("source", "step", "bin").orderBy("q")
    around = (
        drawn.where("bin is not null").select("source", "step", "bin", "size", "q")
        .join(_small(near), _eq("source", "s") & (F.col("step") == F.col("c")) & (F.col("bin") == F.col("b")))
        .groupBy("source", "step", "bin", "q", "size_fixed", "n_before", "words_before").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
        .withColumn("place", F.col("n_before") + F.sum("n").over(by_rank))
        .withColumn("words", F.col("words_before") + F.sum("words").over(by_rank))
        .where(F.abs(F.col("place") - F.col("size_fixed")) <= NEAR)
    )
    cut = F.struct(F.col("place"), F.col("q"), F.col("words").cast("double").alias("words"))
    cuts = around.groupBy("source", "step").agg(F.array_sort(F.collect_list(cut)).alias("cuts")).withColumnsRenamed({"source": "s2", "step": "c2"})
    none = F.struct(F.lit(0).cast("long").alias("place"), F.lit(-1.0).alias("q"), F.lit(0.0).alias("words"))
    all_cuts = F.coalesce("cuts", F.array().cast("array<struct<place: bigint, q: double, words: double>>"))
    classes = (
        fixed.join(cuts, _eq("s", "s2") & (F.col("c") == F.col("c2")), "left")
        .withColumn("cuts", F.when(F.col("size_fixed") <= NEAR, F.concat(F.array(none), all_cuts)).otherwise(all_cuts))
        # The last cut that takes no more than the fixed size.
        .withColumn("base", F.array_max(F.filter("cuts", lambda x: x["place"] <= F.col("size_fixed"))))
        .withColumn("base", F.coalesce("base", F.element_at("cuts", 1)))
    )
    listed = classes.groupBy("s").agg(
        F.reverse(F.array_sort(F.collect_list(F.struct(F.col("c"), F.col("base"), F.col("cuts"))))).alias("classes"),
        (F.first("missing") - F.sum("certain")).alias("open"),
    )
    # For what the classes still to come can give or take: their words within the cuts, above and below their bases.
    first, last = lambda x: F.element_at(x["cuts"], 1)["words"], lambda x: F.element_at(x["cuts"], -1)["words"]
    total = lambda f: F.aggregate("classes", F.lit(0.0), lambda t, x: t + f(x))
    begin = F.struct(
        (F.col("open") - total(lambda x: x["base"]["words"])).alias("open"),
        total(lambda x: last(x) - x["base"]["words"]).alias("more"),
        total(lambda x: x["base"]["words"] - first(x)).alias("less"),
        F.array().cast("array<struct<c: int, q: double>>").alias("chosen"),
    )

    def settle(state: Column, x: Column) -> Column:
        base = x["base"]["words"]
        gap, more, less = state["open"] + base, state["more"] - (last(x) - base), state["less"] - (base - first(x))

        def judged(y: Column) -> Column:
            left = gap - y["words"]
            lost = F.greatest(left - more, -left - less, F.lit(0.0))
            return F.struct(lost.alias("lost"), F.abs(left).alias("error"), F.abs(y["place"] - x["base"]["place"]).alias("moved"), y["q"].alias("q"), left.alias("left"))

        best = F.array_min(F.transform(x["cuts"], judged))
        return F.struct(best["left"].alias("open"), more.alias("more"), less.alias("less"), F.array_append(state["chosen"], F.struct(x["c"].alias("c"), best["q"].alias("q"))).alias("chosen"))

    chosen = listed.select("s", F.explode(F.aggregate("classes", begin, settle)["chosen"]).alias("x")).select(F.col("s"), F.col("x.c").alias("c"), F.col("x.q").alias("q_cut"))
    return common.materialize(found.join(chosen, _eq("law_source", "s") & (F.col("law_step") == F.col("c")), "left").drop("s", "c"))


def with_copies(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (source, step, size, u) with the columns of their plan and the number of copies that the mix takes."""
    once_more = F.when((F.col("p") >= 1) | (F.col("q") <= F.col("q_cut")), 1).otherwise(0)
    return _drawn(_small(found), rows).withColumn("times", F.when(F.col("size") > 0, F.col("copies") + once_more).otherwise(0))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of docs. Documents without words stay out."""
    found = plan(common.materialize(sized(docs, id_col, text_col, source_col, seed)), seed)
    u = random_unit(F.lit(seed), F.col(f"d.`{id_col}`"), F.col(f"d.`{text_col}`"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d")).select("d", u.alias("u"), F.col(f"d.`{source_col}`").alias("source"), word_count(F.col(f"d.`{text_col}`")).alias("size"))
    taken = with_copies(packed.withColumn("step", size_class(F.col("size"))), found)
    return taken.where("times > 0").select("d", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")).select("d.*")


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    rows = common.materialize(sized(common.table(spark, sf_dir, "documents")))
    taken = with_copies(rows, plan(rows))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"))


QUERIES = {"op8_mix": op8_mix}
ORACLES: dict[str, str] = {}
