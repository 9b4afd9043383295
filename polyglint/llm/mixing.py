"""Mixing of sources to target weights, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyglint.llm.common import WORD, fresh, written

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: Share of all words that the mix takes, and how often it may repeat a source.
BUDGET, MAX_EPOCHS = 1.5, 2
SEED = "mix-1"
#: Hash slices of a source (a power of two): their sums are ordered, and then only the rows of the one in which its sample ends.
SLICE_BITS = 12
#: Turns in which a source's sample goes on past a row that does not fit.
TURNS = 4


def word_count(text: Column) -> Column:
    """Words of a text as runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(*parts: Column) -> Column:
    """A number from 0 to 2**60 - 1 by the md5 of the seed and the parts (null as an empty part)."""
    text = F.concat_ws(":", F.lit(SEED), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def water_fill(sizes: DataFrame, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) to (source, source_size, target): capped water-filling.

    Every source gets its weight's share of budget times all sizes, at most max_epochs times its size; what is above is
    shared anew among the others by weight until none is above. The final level is found at once: in order of cap over weight,
    the sources at their caps come first, and each place says what level the rest would have. Orders one row per source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(place, F.lit(len(weights))).cast("int") + 1).cast("long"))
    weighed = weighed.withColumn("cap", F.col("source_size") * max_epochs).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(budget) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    share = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levels = weighed.withColumn("level", left / share)
    final = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(everything)["level"]
    return levels.withColumn("final", final).select("source", "source_size", F.coalesce(F.least("ratio", "final"), "ratio").alias("level"), "weight", "cap").select(
        "source", "source_size", F.least(F.col("level") * F.col("weight"), F.col("cap").cast("double")).alias("target")
    )


def row_draw(id_: Column, text: Column) -> Column:
    """The number by which a row is sampled: of its id, or of its text where it has none."""
    return seeded(F.coalesce(id_.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Adds the struct `mix`: key (of the source, never null), size and draw (60 bits by which rows are sampled)."""
    size = word_count(F.col(text_col))
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit(""))
    return docs.withColumn("mix", F.struct(key.alias("key"), F.col(source_col).alias("source"), size.alias("size"), row_draw(F.col(id_col), F.col(text_col)).alias("draw")))


def _filled(sized: DataFrame, state: DataFrame) -> DataFrame:
    """One turn of all samples: (key, edge, missing) to the same after it, and `from` and `most`, the edge and the missing words before it.

    Rows beyond the edge that are no larger than what is missing are taken in the order of their draws as long as they fit. Slices
    of the draws are summed first, and only the rows of the slice in which a source's turn ends are ordered.
    """
    slice_ = F.shiftright("draw", 60 - SLICE_BITS)
    open_ = sized.join(state, "key").where("missing > 0 and draw > edge and size <= missing")
    slices = open_.groupBy("key", "missing", slice_.alias("slice")).agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = slices.withColumn("upto", upto).where("upto > missing").groupBy("key").agg(F.min_by(F.struct("slice", (F.col("upto") - F.col("words")).alias("before")), "slice").alias("c")).select("key", "c.*")

    there = open_.withColumn("slice", slice_).join(cut, ["key", "slice"])
    filled = F.col("before") + F.sum("size").over(Window.partitionBy("key").orderBy("draw").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    edge = there.withColumn("filled", filled).where("filled <= missing").groupBy("key").agg(F.max("draw").alias("last"), F.max("filled").alias("filled"))
    whole = slices.groupBy("key").agg(F.sum("words").alias("words"))
    after = state.join(whole, "key", "left").join(cut, "key", "left").join(edge, "key", "left")
    ended = F.when(F.col("slice").isNull(), F.lit((1 << 60) - 1)).otherwise(F.coalesce("last", F.greatest("edge", F.shiftleft(F.col("slice").cast("long"), 60 - SLICE_BITS) - 1)))
    taken = F.when(F.col("slice").isNull(), F.coalesce("words", F.lit(0))).otherwise(F.coalesce("filled", "before"))
    return after.select("key", F.col("edge").alias("from"), F.col("missing").alias("most"), ended.alias("edge"), (F.col("missing") - taken).alias("missing"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """All columns of `docs` and a struct `mix`: size, source_size, target and copies, from 0 to max_epochs, of each row.

    Every row of a source is taken floor(target / source_size) times. The rest of the target is a seeded sample: the rows in
    order of a hash of their ids as long as they fit. A row that does not fit ends a turn; the next one passes over it and goes on with the later
    rows that are no larger than what is missing, and after TURNS turns the one more is taken that comes nearest to what
    is still missing. Slices of the hash are summed first, and only the slice in which a source's turn ends is ordered, so a
    hot source never meets in one task; the sums of a source's slices (4,096) and a row for each source are ordered in one task.
    Rows with one id that fit are taken together, rows without an id by their text. Null texts have size 0, null sources are one
    source, and a source without words has target 0. Equal inputs give equal results in any partitioning. An input column named `mix` is replaced.
    """
    keyed = _keyed(docs, id_col, text_col, source_col)
    sized = written(keyed.select("mix.*"), "sizes")
    targets = water_fill(sized.groupBy("key", "source").agg(F.sum("size").alias("source_size")).select("source", "source_size"), budget, max_epochs, weights)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))).withColumn("whole", whole)
    targets = written(targets.withColumn("part", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))), "targets")

    state = targets.select("key", F.lit(-1).cast("long").alias("edge"), F.col("part").alias("missing"))
    plan = targets.select("key", "source_size", "target", "whole")
    for turn in range(TURNS):
        state = written(_filled(sized, state), "turn")
        plan = plan.join(state.select("key", F.struct("from", "most", "edge").alias(f"turn{turn}")), "key")
        state = state.select("key", "edge", "missing")
    turns = F.array(*(f"turn{turn}" for turn in range(TURNS))).alias("turns")
    plan = written(plan.join(state, "key").select("key", "source_size", "target", "whole", "missing", turns), "plan")

    def taken(turns: Column, draw: Column, size: Column) -> Column:
        return F.exists(turns, lambda t: (t["most"] > 0) & (draw > t["from"]) & (draw <= t["edge"]) & (size <= t["most"]))

    def close(size: Column, missing: Column) -> Column:
        return (size > 0) & (size < 2 * missing)

    # Of the rows that no turn has taken, those of one id whose words come nearest to what is missing.
    rest = sized.join(plan, "key").where(close(F.col("size"), F.col("missing"))).where(~taken(F.col("turns"), F.col("draw"), F.col("size")))
    gains = rest.groupBy("key", "missing", "draw").agg(F.sum("size").alias("gain")).where("gain < 2 * missing")
    near = gains.groupBy("key").agg(F.min_by("draw", F.struct(F.abs(F.col("gain") - F.col("missing")), "draw")).alias("near"))
    plan = written(plan.join(near, "key", "left"), "plan")

    p = F.col(own := fresh(docs, "plan"))
    extra = taken(p["turns"], F.col("mix.draw"), F.col("mix.size")) | (F.coalesce(F.col("mix.draw") == p["near"], F.lit(False)) & close(F.col("mix.size"), p["missing"]))
    copies = F.least(p["whole"] + extra.cast("long"), F.lit(max_epochs)).cast("int")
    kept = [c for c in docs.columns if c != "mix"]
    placed = keyed.join(plan.select(F.struct("*").alias(own)), F.col("mix.key") == p["key"])
    return placed.select(*kept, F.struct("mix.size", p["source_size"].alias("source_size"), p["target"].alias("target"), copies.alias("copies")).alias("mix"))
