"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, written

#: Sources in order of their code points, null last, weigh these, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source's share of the mix at the start of training, relative to its share on average: even ranks are
#: taught more early, odd ranks more late. The rate of a source is linear in time, so integrates to a parabola.
TILT = 0.5
MOST_EPOCHS = 3
#: Slices of a source's hash range, each ordered in a task of its own.
SLICES = 1024


def sized(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, size, key): rows without an id are told apart, and dealt, by their text."""
    words = F.regexp_count(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit(WORD)).cast("long")
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), words.alias("size"), F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.concat(F.lit("none "), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))).alias("key"))


def targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target, rank) for each source of ``rows(source, size)``; one row a source, few.

    A target is a share by weight of all sizes, at most MOST_EPOCHS times the source's size. In order of size
    over weight the capped sources come first, so one running sum finds where sharing by weight holds.
    """
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(1))
    order = everything.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("rank", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", (F.lit(MOST_EPOCHS) * F.col("source_size")).cast("double"))
    tight = everything.orderBy(F.col("cap") / F.col("weight"), "rank")
    upto = tight.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("weight").over(tight.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    final = F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.col("cap") / F.col("weight"))).over(everything)
    per = per.withColumn("final", final)
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("weight")))
    return per.select("source", "source_size", target.alias("target"), "rank")


def position(cumulated: F.Column, target: F.Column, rank: F.Column, tilt: float = TILT) -> F.Column:
    """Time in 0..1 at which a source's demand reaches ``cumulated`` words of its target.

    The rate is (1 + a - 2 a t) with a = tilt or -tilt; demand is its integral (1 + a) t - a t^2, inverted here.
    """
    a = F.when(rank % 2 == 0, F.lit(tilt)).otherwise(F.lit(-tilt))
    share = F.least(F.lit(1.0), F.try_divide(cumulated, target))
    if not tilt:
        return share
    return (1 + a - F.sqrt((1 + a) * (1 + a) - 4 * a * share)) / (2 * a)


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, tilt: float = TILT) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, taken and passes, an array of (words, position).

    Within a source rows follow the MD5 of their id, those without one that of their text. A source's target, rounded down, is filled by whole passes
    over its rows and a last pass that ends in the row where the target is met, of which the first words count.
    Each pass of a row starts at the training position where the source's cumulated demand reaches it.
    Null texts have size 0; a null source is a source; rows of size 0 are taken 0 words, in no pass. Repeated
    rows count as often as they occur; which of several rows with equal id and size comes first doesn't matter.
    A source of a third of all rows is ordered in SLICES parts by hash, with sums of the parts before each.
    """
    rows = written(sized(df, id_col, text_col, source_col), "sizes")
    rows = rows.withColumn("slice", F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)) * F.lit(SLICES) / F.lit(2.0**32), F.lit(SLICES)).cast("int"))
    per = targets(rows.select("source", "size"), weights)
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = rows.groupBy("source", "slice").agg(F.sum("size").alias("s")).withColumn("before", F.coalesce(F.sum("s").over(before), F.lit(0)))
    # a row for each source and slice: no more than SLICES for each source
    plan = slices.join(per, slices.source.eqNullSafe(per.source)).select(slices.source.alias("p_source"), F.col("slice").alias("p_slice"), "before", "source_size", "target", "rank")
    within = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("own", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("slice") == F.col("p_slice"))).withColumn("at", F.col("before") + F.col("own"))
    whole = F.floor("target").cast("long")
    full = F.when(F.col("source_size") > 0, (whole / F.col("source_size")).cast("long")).otherwise(F.lit(0))
    full = F.least(full, F.lit(MOST_EPOCHS)).cast("int")
    rows = rows.withColumn("full", full).withColumn("rest", whole - F.col("full") * F.col("source_size"))
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("at"))).cast("long")
    rows = rows.withColumn("taken", F.col("full") * F.col("size") + last)
    passes = [
        F.struct(
            F.when(F.lit(k) < F.col("full"), F.col("size")).otherwise(F.when(F.lit(k) == F.col("full"), last).otherwise(F.lit(0))).cast("long").alias("words"),
            position((F.lit(k) * F.col("source_size") + F.col("at")).cast("double"), F.col("target"), F.col("rank"), tilt).alias("position"),
        )
        for k in range(MOST_EPOCHS)
    ]
    made = F.filter(F.array(*passes), lambda x: x.words > 0)
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken", made.alias("passes"))


def schedule(mixed: DataFrame) -> DataFrame:
    """A row for each pass of each row, range-sorted by training position: doc_id, words, position."""
    return mixed.select("doc_id", F.explode("passes").alias("p")).select("doc_id", "p.words", "p.position").orderBy("position", "doc_id")


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``df``, each as often as it has passes of at least half its words, in order of position.

    Rows without words stay once: they are no training tokens, so no weight speaks against them.
    """
    mixed = mix(df, id_col, text_col, source_col)
    half = F.filter("passes", lambda x: x.words * 2 >= F.col("size"))
    at = F.when(F.col("size") == 0, F.array(F.lit(0.0))).otherwise(F.transform(half, lambda x: x.position))
    ref, places, place = (f"{x}_{uuid.uuid4().hex}" for x in ("ref", "places", "place"))
    # of rows with equal ids each gets the passes of one of them
    times = mixed.groupBy(F.col("doc_id").alias(ref)).agg(F.max(at).alias(places))
    joined = df.join(times, F.col(f"`{id_col}`").eqNullSafe(F.col(ref)))
    return joined.select(*[df[f"`{c}`"] for c in df.columns], F.explode(places).alias(place)).orderBy(place).drop(place)
