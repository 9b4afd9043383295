"""Derived figures for operating: fronts, cheapest choices, service levels, capacity and placement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pareto_front(candidates: DataFrame) -> DataFrame:
    """Candidates (slo, cost, risk, ..) that no other dominates: no less slo, no more cost, no more risk, and one of them strictly.

    Compares distinct points with each other; see `skyline` for many.
    """
    points = candidates.select("slo", "cost", "risk").distinct()
    a, b = points.alias("a"), points.alias("b")
    worse = (F.col("b.slo") >= F.col("a.slo")) & (F.col("b.cost") <= F.col("a.cost")) & (F.col("b.risk") <= F.col("a.risk"))
    strict = (F.col("b.slo") > F.col("a.slo")) | (F.col("b.cost") < F.col("a.cost")) | (F.col("b.risk") < F.col("a.risk"))
    return candidates.join(a.join(b, worse & strict, "left_anti"), ["slo", "cost", "risk"]).select(*candidates.columns)


def skyline(candidates: DataFrame) -> DataFrame:
    """The same front by a first sweep that a sort can do: a point is out if one of a higher or equal slo has no more cost and risk.

    For each slo the best risk by cost is kept, which leaves few points for the exact comparison.
    """
    by_cost = Window.partitionBy("slo").orderBy("cost", "risk").rowsBetween(Window.unboundedPreceding, -1)
    few = candidates.select("slo", "cost", "risk").distinct().withColumn("least", F.min("risk").over(by_cost)).where(F.col("least").isNull() | (F.col("risk") < F.col("least"))).drop("least")
    front = pareto_front(few.withColumn("name", F.lit("")))
    return candidates.join(front.drop("name"), ["slo", "cost", "risk"], "left_semi").select(*candidates.columns)


def weighted_choice(front: DataFrame, slo: float, cost: float, risk: float) -> DataFrame:
    score = slo * F.col("slo") - cost * F.col("cost") - risk * F.col("risk")
    return front.withColumn("score", score).orderBy(F.col("score").desc(), "ord").limit(1)


def cheapest(options: DataFrame, residency: str, quota: int, slo_required: bool, price: str = "price") -> DataFrame:
    """The eligible option of least price, the first in `ord` of equals."""
    fit = (F.col("residency") == residency) & (F.col("quota") >= quota)
    fit = fit & F.col("meets_slo") if slo_required else fit
    return options.where(fit).orderBy(price, "ord").limit(1)


def expected_spot_cost(penalty: float = 2.0) -> Column:
    return F.col("price") * (1 + F.col("interruption_rate") * penalty)


def bid_wins(cap: float, max_rate: float) -> Column:
    return (F.lit(cap) >= F.col("price")) & (F.col("interruption_rate") <= max_rate)


def rolling_compliance(outcomes: DataFrame, n: int, target: float, band: float = 0.10) -> DataFrame:
    """Outcomes (slo, seq, success) with the share of the last n that succeeded, and COMPLIANT, AT_RISK (within the band) or BREACHED."""
    last = Window.partitionBy("slo").orderBy("seq").rowsBetween(-(n - 1), Window.currentRow)
    share = F.avg(F.col("success").cast("double")).over(last)
    status = F.when(F.col("compliance") >= target, "COMPLIANT").when(F.col("compliance") >= target - band, "AT_RISK").otherwise("BREACHED")
    return outcomes.withColumn("compliance", share).withColumn("status", status)


def slo_budget(rows: DataFrame, target: float, max_nodes: int, headroom: float = 2.0) -> DataFrame:
    """(.., suggested, action) for rows with compliance and nodes: as many more nodes as the deficit asks for, one at least."""
    deficit = (target - F.col("compliance")) / target
    more = F.greatest(F.lit(1), F.ceil(F.col("nodes") * deficit * headroom).cast("int"))
    met = F.col("compliance") >= target
    return rows.withColumn("suggested", F.when(met, F.col("nodes")).otherwise(F.least(F.lit(max_nodes), F.col("nodes") + more)).cast("int")).withColumn("action", F.when(met, "MAINTAIN").otherwise("SCALE_UP"))


def negotiate(slos: DataFrame) -> DataFrame:
    """(worst_slo, worst_deficit, weighted_deficit) of rows (slo, attainment, target, weight, ord)."""
    deficit = F.greatest(F.lit(0.0), (F.col("target") - F.col("attainment")) / F.col("target"))
    rows = slos.withColumn("deficit", deficit)
    weight = F.sum("weight")
    worst = F.max("deficit")
    return rows.agg(F.min_by("slo", F.struct(-F.col("deficit"), F.col("ord"))).alias("worst_slo"), worst.alias("worst_deficit"), F.when(weight == 0, worst).otherwise(F.sum(F.col("weight") * F.col("deficit")) / F.when(weight == 0, 1.0).otherwise(weight)).alias("weighted_deficit"))


def cost_suggestions(profiles: DataFrame, low_activity: int, write_ratio: float, large_kb: int) -> DataFrame:
    """(tenant, kind, saving, risk) of profiles (tenant, reads, writes, storage_gb, value_kb, cost)."""
    ops = F.col("reads") + F.col("writes")

    def offer(condition: Column, kind: str, share: float, risk: Column) -> Column:
        return F.when(condition, F.struct(F.lit(kind).alias("kind"), (F.col("cost") * share).alias("saving"), risk.alias("risk")))

    offers = F.array(
        offer((ops < low_activity) & (F.col("storage_gb") > 0), "SCALE_DOWN", 0.30, F.when(F.col("storage_gb") >= 100, "MEDIUM").otherwise("LOW")),
        offer((ops > 0) & (F.col("writes") / F.when(ops > 0, ops) >= write_ratio) & (F.col("storage_gb") >= 50), "COLD_TIER", 0.50, F.lit("MEDIUM")),
        offer(F.col("value_kb") >= large_kb, "COMPRESSION", 0.15, F.lit("LOW")),
    )
    return profiles.select("tenant", F.explode(F.filter(offers, lambda x: x.isNotNull())).alias("s")).select("tenant", "s.*")


def alerts(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Metric values (metric, value) beyond their rule (metric, comparison > or <, threshold)."""
    beyond = F.when(F.col("comparison") == ">", F.col("value") > F.col("threshold")).otherwise(F.col("value") < F.col("threshold"))
    return metrics.join(rules, "metric").where(beyond)


def hot_keys(accesses: DataFrame, width_ms: int, threshold: int) -> DataFrame:
    """(window_ms, key, n) of keys with at least `threshold` accesses in a window."""
    return accesses.groupBy((F.col("ts_ms") - F.pmod("ts_ms", F.lit(width_ms))).alias("window_ms"), "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= threshold)


def rebalance(loads: DataFrame, max_load: int) -> DataFrame:
    """(source, target, amount): for each overloaded and each underloaded node the lesser of excess and room.

    Nodes are few and every such pair is the result, so the product of the two filtered sides is meant.
    """
    over = loads.where(F.col("load") > max_load).select(F.col("node").alias("source"), (F.col("load") - max_load).alias("excess"))
    under = loads.where(F.col("load") < max_load).select(F.col("node").alias("target"), (max_load - F.col("load")).alias("room"))
    return over.crossJoin(under).select("source", "target", F.least("excess", "room").alias("amount"))


def placement(regions: DataFrame, max_skew: int) -> DataFrame:
    """(most, least, skew, balanced) regions on a node, over normal regions (region, state, peers)."""
    held = regions.where("state = 'NORMAL'").select(F.explode("peers").alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    most, least = F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.min("n"), F.lit(0))
    return held.agg(most.alias("most"), least.alias("least"), (most - least).alias("skew"), (most - least <= max_skew).alias("balanced"))


def sampled(rows: DataFrame, key: Column, rate: float) -> DataFrame:
    """Rows whose key's hash, in thousandths, is below the rate: the same keys in every run."""
    from polyglint.plans.sharding import java_hash

    return rows.where(F.pmod(java_hash(key).bitwiseAND(F.lit(0x7FFFFFFF)), F.lit(1000)) / 1000 < rate)


def clause_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(clause, change): distinct clauses that only the new or only the old ones have (added, removed), and for each pair of an old
    and a new clause of which one is the other up to a colon, the new one (changed)."""
    old, new = (side.select("clause").where("clause is not null").distinct() for side in (old, new))

    def heads(side: DataFrame) -> DataFrame:
        """Each clause with what stands before each of its colons."""
        parts = F.split("clause", ":")
        upto = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), ":"))
        return side.where(F.col("clause").contains(":")).select("clause", F.explode(upto).alias("head"))

    longer = heads(new).join(old.withColumnRenamed("clause", "head"), "head", "left_semi").select("clause")
    shorter = heads(old).join(new.withColumnRenamed("clause", "head"), "head").select(F.col("head").alias("clause"))
    named = lambda side, change: side.select("clause", F.lit(change).alias("change"))
    return named(new.join(old, "clause", "left_anti"), "added").union(named(old.join(new, "clause", "left_anti"), "removed")).union(named(longer.union(shorter), "changed"))


#: Bytes kept beside each value, seconds of a day, spare queries, and latency budgets in milliseconds of read- and write-heavy work.
KEY_OVERHEAD, DAY_SECONDS, SPARE, READ_BUDGET, WRITE_BUDGET = 96, 86_400, 0.2, 5.0, 10.0


def capacity(inputs: DataFrame) -> DataFrame:
    """Adds memory_bytes, disk_bytes, required_qps and latency_ms to rows (active_keys, value_bytes, qps, read_ratio, replication, retention_days)."""
    memory = F.col("active_keys") * (F.col("value_bytes") + KEY_OVERHEAD) * F.col("replication")
    disk = F.col("qps") * (1 - F.col("read_ratio")) * F.col("value_bytes") * DAY_SECONDS * F.col("retention_days") * F.col("replication")
    budget = F.when(F.col("read_ratio") >= 0.5, READ_BUDGET).otherwise(WRITE_BUDGET)
    return inputs.withColumns({"memory_bytes": memory.cast("double"), "disk_bytes": disk.cast("double"), "required_qps": F.col("qps") * (1 + SPARE), "latency_ms": budget})
