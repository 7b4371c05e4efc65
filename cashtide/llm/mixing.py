"""Mixing sources to target weights by entropy balancing.

Rates r of documents stay as close as possible (in relative entropy) to one copy each, at most
two, while the words taken from each source meet its target. The convex dual has one
multiplier per source and its solution is an exponential tilt, r = min(2, exp(m * size)),
sizes being measured against the source's mean. Safeguarded Newton steps find all multipliers
at once; as a rate depends on source and size only, a step is an aggregation over the table of
(source, size, count), which is exact and far smaller than the documents.

Rates become whole copies: of the c documents of one source and size, the number that gets
the larger whole rate follows from running sums over the sizes of the source, then a few
documents are moved where that brings the source closer to its target. Which documents
these are is decided by the hash of doc_id, so reruns agree. All sums are of whole numbers or
decimals, so that no order of rows shows in a result.

Null text has size 0; a document of size 0 takes no words. A null source is a source of its
own, last in order. Repeated rows count as often as they come and any of them may be taken.
An empty table gives an empty result; further columns are ignored.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from cashtide import session
from cashtide.llm.common import documents, row_key, row_order

WORD = "[^\\x20\\x09-\\x0D]+"
# Weights of the sources in order, the share of all words, and the most copies.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Documents of one source and size ranked in one task.
RANKED = 1000
STEPS = 60
TOLERANCE = 1e-9
REPAIRS = 12
EXACT = "decimal(38,9)"


def sizes(docs):
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    return docs.select("doc_id", "source", words.alias("size"))


def ordered(sources):
    """Sources with their place by code point, nulls last, from 0 on.

    They are dealt by ranges, numbered within each, and moved up by the ranges before.
    """
    dealt = sources.repartitionByRange(F.col("source").asc_nulls_last())
    held = session.cut(dealt.withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        held.groupBy("part")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    within = F.row_number().over(
        Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    )
    return (
        held.withColumn("within", within)
        .join(offsets, "part")
        .withColumn("place", F.col("offset") + F.col("within") - 1)
        .drop("part", "within", "offset")
    )


def targets(histogram, weights=WEIGHTS, share=SHARE, most=MOST):
    """Per source: its size and target words.

    All sources get ``level * weight`` words, those that cannot take it get their most; the
    level rises until the whole share is placed.
    """
    sums = histogram.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"),
        F.sum("n").alias("source_docs"),
    )
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        (F.col("place") % len(weights) + 1).cast("int"),
    )
    table = session.cut(ordered(sums).withColumn("weight", weight), "targets")
    top = F.col("source_size") * float(most)
    total = float(table.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:
        full = F.col("weight") * F.lit(level) >= top
        placed, open_weight = table.agg(
            F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)) * most,
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
        ).first() or (0, 0.0)
        risen = (total - float(placed)) / open_weight if open_weight else level
        if risen <= level:
            break
        level = risen
    return table.withColumn("target", F.least(top, F.col("weight") * F.lit(level)))


def tilted(multiplier, size, mean, most=MOST):
    """The rate of a document of ``size`` in a source of mean size ``mean``."""
    return F.least(F.lit(float(most)), F.exp(F.least(F.lit(700.0), multiplier * size / mean)))


def multipliers(histogram, goals, most=MOST, steps=STEPS):
    """Solve the dual: per source the multiplier that meets its target.

    A source whose target is all it can give has the largest multiplier of its bracket, where
    every rate is at the most. Newton steps that leave the bracket are replaced by halving.
    """
    mean = F.greatest(F.col("source_size") / F.col("source_docs"), F.lit(1e-300))
    reach = F.coalesce(F.col("mean") / F.col("least"), F.lit(0.0))
    at_most = F.log(F.lit(float(most) * (1 + 1e-12))) * reach
    need = F.col("target") / F.col("source_size")
    low = F.least(F.lit(0.0), F.log(F.greatest(need, F.lit(1e-300))) * reach)
    full = F.col("target") >= F.col("source_size") * float(most)
    state = goals.withColumn("mean", mean).withColumns(
        {
            "low": F.when(F.col("source_size") > 0, low).otherwise(0.0),
            "high": F.when(F.col("source_size") > 0, at_most).otherwise(0.0),
            "full": F.coalesce(full, F.lit(True)),
        }
    )
    state = session.cut(
        state.withColumn("m", F.when(F.col("full"), F.col("high")).otherwise(0.0)), "dual"
    )
    a, r = F.col("size") / F.col("mean"), F.col("rate")
    words = F.col("n") * F.col("size")
    for _ in range(steps):
        live = state.filter(~F.col("full")).select(F.col("source").alias("s"), "m", "mean")
        sums = (
            histogram.filter("size > 0")
            .join(live, F.col("source").eqNullSafe(F.col("s")))
            .withColumn("rate", tilted(F.col("m"), F.col("size"), F.col("mean"), most))
            .groupBy(F.col("s"))
            .agg(
                F.sum((words * r).cast(EXACT)).cast("double").alias("got"),
                F.sum(F.when(r < most, words * a * r).otherwise(0.0).cast(EXACT))
                .cast("double")
                .alias("slope"),
            )
        )
        over = F.col("got") > F.col("target")
        newton = F.col("m") - (F.col("got") - F.col("target")) / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high"))
        moved = F.when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        state = session.cut(
            state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left")
            .withColumn("gap", F.abs(F.col("got") / F.col("target") - 1))
            .withColumn("low", F.when(over, F.col("low")).otherwise(F.greatest("low", "m")))
            .withColumn("high", F.when(over, F.least("high", "m")).otherwise(F.col("high")))
            .withColumn(
                "full", F.col("full") | F.coalesce(F.col("gap") <= TOLERANCE, F.lit(True))
            )
            .withColumn("m", F.when(F.col("full"), F.col("m")).otherwise(moved))
            .drop("s", "got", "slope", "gap"),
            "dual",
        )
        if state.filter(~F.col("full")).isEmpty():
            break
    return state


def whole(histogram, dual, most=MOST, repairs=REPAIRS):
    """Per (source, size): rate, the smaller number of copies and how many get one more."""
    held = dual.select(
        F.col("source").alias("s"), "source_size", "target", "mean", F.col("m").alias("tilt")
    )
    rate = tilted(F.col("tilt"), F.col("size"), F.col("mean"), most)
    table = histogram.join(held, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    table = (
        table.withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(1.0))
        .withColumn("floor", F.floor("rate"))
        .withColumn("part", (F.col("n") * (F.col("rate") - F.col("floor"))).cast(EXACT))
    )
    larger = Window.partitionBy("source").orderBy(F.desc("size"))
    upto = F.sum("part").over(larger)
    grown = F.floor(upto + F.lit(0.5)) - F.floor(upto - F.col("part") + F.lit(0.5))
    table = session.cut(
        table.withColumn("up", F.least(F.greatest(grown, F.lit(0)), F.col("n")).cast("bigint")),
        "copies",
    )
    free = (F.col("size") > 0) & (F.col("floor") < most)
    for _ in range(repairs):
        taken = F.sum(F.col("size") * (F.col("n") * F.col("floor") + F.col("up")))
        gaps = table.groupBy(F.col("source").alias("s")).agg(
            (F.round(F.first("target")) - taken).cast("bigint").alias("gap")
        )
        can = F.when(F.col("gap") > 0, F.col("n") - F.col("up")).otherwise(F.col("up"))
        gain = F.abs("gap") - F.abs(F.abs(F.col("gap")) - F.col("size"))
        near = table.join(gaps, F.col("source").eqNullSafe(F.col("s")))
        # The size nearest to the gap; moving one document of it brings the source closer.
        chosen = (
            near.filter(free & (can > 0) & (gain > 0))
            .groupBy("s", "gap")
            .agg(F.max(F.struct(gain.alias("gain"), "size")).alias("best"))
            .select("s", "gap", F.col("best.size").alias("chosen"))
        )
        if chosen.isEmpty():
            break
        many = F.greatest(F.floor(F.abs("gap") / F.col("size")), F.lit(1))
        step = F.least(can, many) * F.signum("gap")
        hit = F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("chosen"))
        table = session.cut(
            table.join(chosen, hit, "left")
            .withColumn("up", F.col("up") + F.coalesce(step, F.lit(0)).cast("bigint"))
            .drop("s", "gap", "chosen"),
            "copies",
        )
    return table


def copies(sized, plan):
    """Documents with their copies; of equal source and size the smallest hashes get more.

    Ranks are taken in blocks by hash, moved up by the blocks before, so that a huge group of
    one size is spread over tasks.
    """
    plan = plan.select(
        F.col("source").alias("s"), F.col("size").alias("z"),
        "source_size", "target", "rate", "floor", "up", "n",
    )
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
    joined = sized.join(plan, same).drop("s", "z")
    mixed = (F.col("up") > 0) & (F.col("up") < F.col("n"))
    plain = joined.filter(~mixed).withColumn(
        "copies", F.col("floor") + (F.col("up") > 0).cast("bigint")
    )
    blocks = F.ceil(F.col("n") / RANKED)
    split = joined.filter(mixed).withColumn(
        "block", F.least(F.floor((F.xxhash64("doc_id") / 2.0**64 + 0.5) * blocks), blocks - 1)
    )
    key = ["source", "size", "block"]
    before = Window.partitionBy("source", "size").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        split.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(
            F.col("source").alias("s"), F.col("size").alias("z"), F.col("block").alias("b"),
            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"),
        )
    )
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("doc_id"), "doc_id"))
    found = (
        split.withColumn("within", rank)
        .join(
            offsets,
            F.col("source").eqNullSafe(F.col("s"))
            & (F.col("size") == F.col("z"))
            & (F.col("block") == F.col("b")),
        )
        .withColumn(
            "copies",
            F.col("floor") + (F.col("within") + F.col("offset") <= F.col("up")).cast("bigint"),
        )
    )
    out = ["doc_id", "source", "size", "source_size", "target", "rate", "copies"]
    return plain.select(*out).unionByName(found.select(*out))


def mix(docs, weights=WEIGHTS, share=SHARE, most=MOST):
    """Per document: size, its source's size and target, rate and whole copies to take."""
    sized = session.cut(sizes(docs), "sizes")
    histogram = session.cut(
        sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "size-counts"
    )
    goals = session.cut(targets(histogram, weights, share, most), "goals")
    plan = whole(histogram, multipliers(histogram, goals, most), most)
    return copies(sized, plan).withColumn("taken", F.col("copies") * F.col("size"))


def take_copies(docs, **more):
    """The rows of ``docs`` as often as the mix takes them.

    Rows of one id, source and text share their copies; the least of them by all columns is taken.
    """
    key = row_key(F.xxhash64("text"), "source")
    keyed = docs.select(F.struct("*").alias("row"), key.alias("key"))
    mixed = mix(docs.select(key.alias("doc_id"), "source", "text"), **more)
    taken = mixed.groupBy("doc_id").agg(F.sum("copies").cast("int").alias("copies"))
    own = Window.partitionBy("key").orderBy(*row_order(docs.schema))
    return (
        keyed.join(
            taken.filter("copies > 0").hint("shuffle_hash"), F.col("key") == F.col("doc_id")
        )
        .withColumn("place", F.row_number().over(own))
        .filter("place = 1")
        .select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
        .select("row.*")
    )


def op7_source_mixing(spark, sf_dir):
    mixed = mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")
