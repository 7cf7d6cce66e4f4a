"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words. A document's expected copies are its weight times a factor of the source,
at most ``cap``; the whole part is certain copies, the fraction is its inclusion probability ``p``. Documents are ranked
by random odds over inclusion odds, ``(u / (1 - u)) / (p / (1 - p))``, and taken in that order until the source's words
are used up; one last document whose size is nearest to the words still missing closes the gap. ``u`` is a hash of
the id, so reruns agree.

Nothing is sorted per source: ranks fall into buckets of about ``BUCKET`` documents, bucket sums find the bucket that the
target ends in, and only that bucket is ordered. A source that holds a third of all rows costs no more per task than any
other. All steps are DataFrame operations.

Nulls and edges: null text has size 0; a null source is a source of its own, last in order; rows with a null id are drawn
together, as are rows that repeat an id; an empty table, or one without words, gives targets of 0; other columns are
kept by ``add_copies`` and its own names start with an underscore.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dawnpress.llm.common import WORD, stored
from dawnpress.operators.frames import global_position

WEIGHTS = (1, 2, 3)
CAP = 3
BUCKET = 4096
SEED = "mix"
#: Probabilities this near to 0 or 1 count as 0 or 1.
EDGE = 1e-12


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Text that is never null and sorts as the source does, null last."""
    return F.when(source.isNull(), F.lit("z")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def uniform(doc_id: Column) -> Column:
    """A number between 0 and 1, not included, from the md5 of the id."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{SEED}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def level_of(size: Column) -> Column:
    """Length class of a document: the number of binary digits of its size plus one."""
    return F.length(F.bin(size + 1)).cast("int")


def level_weight(level: Column) -> Column:
    """Weight of a length class: longer documents are a little likelier to be taken."""
    return (level + 4).cast("double")


@dataclass
class Plan:
    """``strata``: copies and probability by source and length class; ``ends``: where each source's draw ends."""

    targets: DataFrame
    strata: DataFrame
    ends: DataFrame


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """``_source, source_size, _docs, target`` from ``_source, _size``: weights repeat along the sources' order.

    Shares add up to all words; a target above ``cap`` times its source's size stops there and the excess is shared by
    weight among the others until none is above.
    """
    totals = sizes.groupBy("_source").agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("_docs"))
    dealt = stored(totals.repartitionByRange("_source").withColumn("_part", F.spark_partition_id()))
    placed = global_position(dealt, ["_source"], F.col("_part"), "_place").drop("_part")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    weighted = stored(placed.withColumn("_weight", weight))
    words = weighted.agg(F.sum("source_size")).first()[0] or 0
    limit, factor = F.col("source_size") * float(cap), 0.0
    while True:  # each round caps more sources, usually two or three rounds in all
        full = limit <= F.col("_weight") * factor
        rest, open_weight = weighted.agg(
            words - F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)), F.sum(F.when(~full, F.col("_weight")))
        ).first()
        if not open_weight or rest <= 0 or rest / open_weight <= factor:
            break
        factor = rest / open_weight
    target = F.least(limit, F.col("_weight") * factor)
    return weighted.select("_source", "source_size", "_docs", target.alias("target"))


def plan_mix(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> Plan:
    """Plan a mix from one row per document: ``_id, _source, _size``."""
    targets = stored(source_targets(sizes, weights, cap))
    level = level_of(F.col("_size"))
    strata = sizes.groupBy("_source", level.alias("_level")).agg(F.sum("_size").alias("_words"))
    above = Window.partitionBy("_source").orderBy(F.col("_level").desc()).rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy("_source").orderBy("_level").rowsBetween(Window.unboundedPreceding, 0)
    value = level_weight(F.col("_level"))
    # with the classes above at the cap, the factor that makes the rest meet the target; the highest that keeps to the cap holds
    rest = F.col("target") - cap * F.coalesce(F.sum("_words").over(above), F.lit(0))
    factor = F.try_divide(rest, F.sum(F.col("_words") * value).over(below))  # null where no class has words
    tried = strata.join(targets, "_source").withColumn("_value", value).withColumn("_factor", factor)
    holds = F.when(F.col("_factor") * F.col("_value") <= cap, F.struct("_level", "_factor"))
    factors = tried.groupBy("_source").agg(F.max(holds)["_factor"].alias("_factor"), F.max("target").alias("_target"))
    expected = F.least(F.lit(float(cap)), F.greatest(F.lit(0.0), F.coalesce("_factor", F.when(F.col("_target") > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))) * level_weight(F.col("_level"))))
    drawn = strata.join(factors, "_source").withColumn("_expected", expected)
    whole = F.floor(F.col("_expected") + EDGE)
    part = F.col("_expected") - whole
    strata = stored(
        drawn.select("_source", "_level", "_words", whole.cast("int").alias("_whole"), F.when(part > EDGE, part).otherwise(F.lit(0.0)).alias("_p"))
    )
    open_words = F.sum(F.when(F.col("_p") > 0, F.col("_words")))
    needs = (
        strata.groupBy("_source")
        .agg(F.sum(F.col("_whole") * F.col("_words")).alias("_sure"), F.coalesce(open_words, F.lit(0)).alias("_open"))
        .join(targets, "_source")
        .withColumn("_need", F.greatest(F.lit(0.0), F.col("target") - F.col("_sure")))
    )
    mean = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), F.col("_need") / F.when(F.col("_open") > 0, F.col("_open")).otherwise(1)))
    needs = stored(
        needs.select("_source", "_need", (mean / (1 - mean)).alias("_odds"), F.ceil(F.col("_docs") / BUCKET).alias("_buckets"))
    )
    ranked = _ranked(sizes, strata, needs).where("_p > 0")
    sums = ranked.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_words"), F.max("_need").alias("_need"))
    so_far = F.sum("_words").over(Window.partitionBy("_source").orderBy("_bucket"))
    crossing = (
        sums.withColumn("_so_far", so_far)
        .where("_so_far > _need")
        .groupBy("_source")
        .agg(F.min(F.struct("_bucket", (F.col("_so_far") - F.col("_words")).alias("_before"), "_need")).alias("_at"))
        .select("_source", "_at.*")
    )
    inside = ranked.drop("_need").join(crossing, ["_source", "_bucket"])
    running = F.sum("_size").over(Window.partitionBy("_source").orderBy("_q", "_id"))  # equal ranks count together
    last = (
        inside.withColumn("_got", F.col("_before") + running)
        .where("_got <= _need")
        .groupBy("_source")
        .agg(F.max(F.struct("_q", "_id")).alias("_last"), F.max("_got").alias("_got"))
    )
    ends = stored(
        needs.join(crossing.drop("_need"), "_source", "left")
        .join(last, "_source", "left")
        .select("_source", "_need", "_odds", "_buckets", "_bucket", "_last", F.coalesce("_got", "_before").alias("_got"))
        .withColumnRenamed("_bucket", "_end")
    )
    missing = F.col("_need") - F.col("_got")
    left_out = _ranked(sizes, strata, ends).where((F.col("_p") > 0) & ~_taken()).where(F.abs(F.col("_size") - missing) < missing)
    filler = left_out.groupBy("_source").agg(F.min(F.struct(F.abs(F.col("_size") - missing).alias("_off"), "_id"))["_id"].alias("_filler"))
    return Plan(targets, strata, stored(ends.join(filler, "_source", "left")))


def _ranked(sizes: DataFrame, strata: DataFrame, ends: DataFrame) -> DataFrame:
    """Documents with their probability, Pareto rank ``_q`` and bucket."""
    u = uniform(F.col("_id"))
    rank = (u / (1 - u)) / (F.col("_p") / (1 - F.col("_p")))
    place = F.col("_q") * F.col("_odds")
    known = sizes.withColumn("_level", level_of(F.col("_size"))).join(strata.drop("_words"), ["_source", "_level"]).join(ends, "_source")
    ranked = known.withColumn("_q", F.when(F.col("_p") > 0, rank))
    return ranked.withColumn("_bucket", F.floor(place / (1 + place) * F.col("_buckets")).cast("long"))


def _taken() -> Column:
    """Whether a document lies before the end of its source's draw; a source that no bucket ends takes all."""
    at_end = F.struct("_q", "_id") <= F.col("_last")
    before = F.col("_bucket") < F.col("_end")
    return F.col("_end").isNull() | before | ((F.col("_bucket") == F.col("_end")) & F.coalesce(at_end, F.lit(False)))


def add_copies(sizes: DataFrame, plan: Plan) -> DataFrame:
    """``sizes`` with ``_copies``: how often the mix takes each document."""
    drawn = F.when((F.col("_p") > 0) & (_taken() | F.coalesce(F.col("_id") == F.col("_filler"), F.lit(False))), 1).otherwise(0)
    return _ranked(sizes, plan.strata, plan.ends).withColumn("_copies", F.col("_whole") + drawn).select(*sizes.columns, "_copies")


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs`` (``doc_id, text, source``)."""
    sizes = stored(
        docs.select(F.col("doc_id").alias("_id"), source_key(F.col("source")).alias("_source"), words_in(F.col("text")).alias("_size"))
    )
    plan = plan_mix(sizes, weights, cap)
    taken = (F.col("_copies") * F.col("_size")).cast("long")
    return (
        add_copies(sizes, plan)
        .join(plan.targets, "_source")
        .select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", taken.alias("taken"))
    )


def mixed_rows(docs: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """``docs`` itself with each row repeated as often as the mix takes it; rows taken no time are left out.

    The plan is made from ids, sources and sizes alone; texts are read once more and not shuffled by id.
    """
    named = docs.withColumns({"_id": F.col("doc_id"), "_source": source_key(F.col("source")), "_size": words_in(F.col("text"))})
    plan = plan_mix(stored(named.select("_id", "_source", "_size")), weights, cap)
    copied = add_copies(named, plan).where("_copies > 0")
    return copied.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(docs.columns)
