"""Mixing sources to target weights by capped water-filling.

Every source wants a share of the budget in proportion to its weight.  A
source whose share would exceed ``max_epochs`` passes over its words is held
there, and what it cannot take is shared again by weight among the others.
Held sources are those with the smallest cap per weight, so one ordering of
the sources finds the level at which nothing exceeds its cap.

Documents then take ``floor(target / size)`` whole repetitions, and the rest
of the target is sampled: in the order of a seeded hash, documents are taken
once more until the rest is used up; the document at the border gives only its
first words.  A source's words thus sum to its rounded target.

Edge cases: a null or empty text has size 0 and takes nothing; null is a source
of its own, placed last; a source without words has target 0; an empty table
gives an empty mix; rows that repeat a doc_id are separate documents, and of
such rows with one size any may stand at the border; rows with a null id are
drawn by their text; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: A source's documents are summed in so many parts, by the first hash digits.
SPREAD_DIGITS = 3


def water_levels(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """``sources``: source, source_size (one row each).  Adds weight and target."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    upto = fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("source_size").over(everything) * F.lit(float(budget))
    left = total - F.sum("cap").over(upto)
    open_weight = F.sum("weight").over(everything) - F.sum("weight").over(upto)
    stepped = ranked.withColumn("left", left + F.col("cap")).withColumn("open", open_weight + F.col("weight"))
    # the level if this source and all after it are open; held if that is above its cap
    stepped = stepped.withColumn("level", F.col("left") / F.col("open")).withColumn("held", F.col("level") * F.col("weight") >= F.col("cap"))
    level = F.min(F.when(~F.col("held"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)
    target = F.when(F.col("held"), F.col("cap")).otherwise(F.least(F.col("cap"), level["level"] * F.col("weight")))
    return stepped.withColumn("target", target).select("source", "source_size", "weight", "target")


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, max_epochs: float = 2.0, seed: int = 17, id_column: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """How much of every document the mix takes.

    Returns the id, ``keep``, size, source_size, target, copies (whole
    repetitions), extra (first words of one more) and taken = copies * size + extra.
    """
    name = F.coalesce(F.col(id_column).cast("string"), F.concat(F.lit("null "), F.xxhash64(F.col("text").cast("string")).cast("string")))
    sized = docs.select(F.col(id_column), *keep, F.col("source").alias("__source"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), name.alias("__name"))
    sized = sized.withColumn("__draw", F.md5(F.concat("__name", F.lit(f":{seed}")))).withColumn("__part", F.substring("__draw", 1, SPREAD_DIGITS))
    parts = sized.groupBy("__source", "__part").agg(F.sum("size").alias("__words"))
    sources = water_levels(parts.groupBy(F.col("__source").alias("source")).agg(F.sum("__words").alias("source_size")), weights, budget, max_epochs)
    plan = sources.select(F.col("source").alias("__of"), "source_size", "target", F.round("target").cast("long").alias("__goal"))
    plan = plan.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("__goal") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")).withColumn("__rest", F.col("__goal") - F.col("copies") * F.col("source_size"))
    before = Window.partitionBy("__source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(F.col("__source").alias("__of2"), F.col("__part").alias("__part2"), F.coalesce(F.sum("__words").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__source", "__part").orderBy("__draw", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("__inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(starts, F.col("__source").eqNullSafe(F.col("__of2")) & (F.col("__part") == F.col("__part2"))).join(plan, F.col("__source").eqNullSafe(F.col("__of")))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("__rest") - F.col("__before") - F.col("__inside")))
    copies = F.when(F.col("size") > 0, F.col("copies")).otherwise(F.lit(0)).cast("long")
    return placed.select(id_column, *keep, "size", "source_size", "target", copies.alias("copies"), extra.alias("extra"), (copies * F.col("size") + extra).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows: the columns of ``docs`` and ``repetition`` from 0.

    A document has one row per repetition.  The last one may hold only its
    first words, joined by one space, with n_chars (if there) to match.
    """
    keyed = docs.withColumn("__row", F.xxhash64("doc_id", "text", "source"))
    same = Window.partitionBy("__row")  # rows that are equal take the plan's rows in any order
    plan = mix_plan(keyed, keep=("__row",), **options).select(F.col("__row").alias("__of"), "copies", "extra", F.row_number().over(Window.partitionBy("__row").orderBy("copies", "extra")).alias("__nth"))
    plan = plan.select("__of", "__nth", F.col("copies").alias("__copies"), F.col("extra").alias("__extra"))
    numbered = keyed.withColumn("__turn", F.row_number().over(same.orderBy("__row")))
    joined = numbered.join(plan, (F.col("__row") == F.col("__of")) & (F.col("__turn") - F.col("__nth") == 0))
    turns = F.col("__copies") + F.when(F.col("__extra") > 0, 1).otherwise(0)
    repeated = joined.where(turns > 0).withColumn("__rep", F.explode(F.sequence(F.lit(0), (turns - 1).cast("int"))))
    whole = F.col("__rep") < F.col("__copies")
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0)), F.lit(1), F.col("__extra").cast("int")), " ")
    repeated = repeated.withColumn("text", F.when(whole, F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        repeated = repeated.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    quoted = ["`" + name.replace("`", "``") + "`" for name in docs.columns]
    return repeated.select(*quoted, F.col("__rep").alias("repetition"))
