"""Counts and summaries over build and tracking records.

Everything aggregates with per-task partial aggregation; the only ordered steps run on result-sized
tables. Kinematic (K) and physics (P) verdicts are never merged; an absent P means "not tested".
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import exclusion_label, reason_kind
from .blocks import spread

STAGES = ("source", "excluded", "retargeted", "K", "P_tested", "P", "K_and_P", "written", "errors")


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def stage_flags() -> dict[str, Column]:
    status, k, p = F.col("status"), F.col("K"), F.col("P")
    k_ok, p_ok = _true(k["passed"]), _true(p["passed"])
    return {"source": F.lit(True), "excluded": _true(status == "excluded"),
            "retargeted": _true(status == "ok") | (_true(status == "excluded") & k.isNotNull()),
            "K": k_ok, "P_tested": p.isNotNull(), "P": p_ok, "K_and_P": k_ok & p_ok,
            "written": F.coalesce(F.length("file") > 0, F.lit(False)),
            "errors": _true(status.isin("error", "read_error"))}


def stage_counts(records: DataFrame) -> DataFrame:
    """Stage counts per family, per dataset and in total. One pass: the (family, dataset) sums are
    re-aggregated on three groupings of that small table."""
    base = records.groupBy(F.coalesce("family", F.lit("?")).alias("family"), F.coalesce("dataset", F.lit("?")).alias("dataset")) \
        .agg(*[F.sum(f.cast("long")).alias(s) for s, f in stage_flags().items()])
    level = F.when(F.grouping("family") == 0, "family").when(F.grouping("dataset") == 0, "dataset").otherwise("total")
    name = F.coalesce("family", "dataset", F.lit("total"))
    out = base.groupingSets([["family"], ["dataset"], []], "family", "dataset") \
        .agg(level.alias("level"), *[F.sum(s).alias(s) for s in STAGES])
    return out.select("level", name.alias("name"), *STAGES)


def top(counts: DataFrame, by: str, name: str, k: int) -> DataFrame:
    """The k largest counts, ties by name (a bounded top-k, not a sort of everything)."""
    return counts.orderBy(F.col(by).desc(), F.col(name)).limit(k)


def top_per_group(counts: DataFrame, group: Sequence[str], by: str, name: str, k: int) -> DataFrame:
    """The k largest counts per group of an aggregated table."""
    w = Window.partitionBy(*group).orderBy(F.col(by).desc(), F.col(name))
    return counts.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= k).drop("__rank")


def body_part_counts(records: DataFrame) -> DataFrame:
    parts = F.array_join(F.array_sort(F.coalesce("body_parts", F.array().cast("array<string>"))), " + ")
    return records.where(_true(F.col("K.passed"))).groupBy(parts.alias("body_parts")).agg(F.count(F.lit(1)).alias("episodes"))


def regime_counts(records: DataFrame) -> DataFrame:
    regime = F.coalesce("regime", F.lit("unknown"))
    return records.where(_true(F.col("K.passed"))).groupBy(regime.alias("regime")).agg(F.count(F.lit(1)).alias("episodes"))


def exclusion_reasons(records: DataFrame, k: int = 25) -> DataFrame:
    counts = records.where(F.col("status") == "excluded") \
        .groupBy(exclusion_label(F.col("excluded"), F.col("reason")).alias("reason")).agg(F.count(F.lit(1)).alias("episodes"))
    return top(counts, "episodes", "reason", k)


def storage_per_episode(records: DataFrame) -> DataFrame:
    """MB per written episode and dataset: its own file, plus new library bytes, plus referenced bytes."""
    scene = F.col("scene")

    def total(field: str) -> Column:
        return F.sum(F.coalesce(scene[field], F.lit(0)))

    kept = records.where((F.length("file") > 0) & scene.isNotNull()).groupBy(F.coalesce("dataset", F.lit("?")).alias("dataset"))
    sums = kept.agg(F.count(F.lit(1)).alias("episodes"), total("episode_bytes").alias("own"),
                    total("assets_new_bytes").alias("new"), total("assets_referenced_bytes").alias("referenced"))
    own, n = F.col("own"), F.col("episodes")
    return sums.select("dataset", "episodes", (own / n / 1e6).alias("episode_only"),
                       ((own + F.col("new")) / n / 1e6).alias("with_library_share"),
                       ((own + F.col("referenced")) / n / 1e6).alias("with_own_assets"))


def reason_kinds(records: DataFrame) -> DataFrame:
    """One row per record, tier and reason position."""
    tiers = F.explode(F.array(*[F.struct(F.lit(t).alias("tier"), F.col(f"{t}.reasons").alias("reasons"),
                                         _true(F.col(f"{t}.passed")).alias("passed")) for t in ("K", "P")]))
    rows = records.select("uid", tiers.alias("v")).select("uid", "v.tier", "v.passed", F.posexplode("v.reasons").alias("at", "reason"))
    return rows.withColumn("kind", reason_kind(F.col("reason")))


def reason_counts(records: DataFrame, *, failed_only: bool = False) -> DataFrame:
    """Episodes per reason kind and tier: as the first reason, and anywhere among the reasons; every kind."""
    rows = reason_kinds(records)
    if failed_only:
        rows = rows.where(~F.col("passed"))
    per = rows.groupBy("uid", "tier", "kind").agg(F.min("at").alias("at"))
    return per.groupBy("tier", "kind").agg(F.count_if(F.col("at") == 0).alias("first"), F.count(F.lit(1)).alias("anywhere"))


def failure_reasons(records: DataFrame, k: int = 25) -> DataFrame:
    """The ``k`` most frequent kinds of a tier in each of two rankings: as the first reason, and anywhere."""
    counts = reason_counts(records)
    out = [top_per_group(counts.where(F.col(r) > 0).select("tier", "kind", F.col(r).alias("episodes")), ["tier"], "episodes", "kind", k).withColumn("ranking", F.lit(r)) for r in ("first", "anywhere")]
    return out[0].unionByName(out[1]).select("tier", "ranking", "kind", "episodes")


AXES = ("cell", "neck", "extent", "speed", "start", "base_motion")


def axis_counts(records: DataFrame) -> DataFrame:
    """Episodes and K passes per value of every scenario axis (``source`` where there is no scenario)."""
    scenario = F.col("scenario")
    pairs = [F.struct(F.lit(a).alias("axis"), scenario[a].cast("string").alias("value")) for a in AXES]
    source = F.array(F.struct(F.lit("source").alias("axis"), F.col("source_family").alias("value")))
    exploded = records.select(_true(F.col("K.passed")).alias("ok"),
                              F.explode(F.when(scenario.isNotNull(), F.array(*pairs)).otherwise(source)).alias("a"))
    return (exploded.where(F.col("a.value").isNotNull()).groupBy("a.axis", "a.value")
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ok").cast("long")).alias("k")))


def attempt_histogram(records: DataFrame, attempts: DataFrame) -> DataFrame:
    """Records per number of attempts; a record without any counts as one attempt."""
    tried = spread(attempts.select("uid"), ["uid"]).groupBy("uid").agg(F.count(F.lit(1)).alias("__n"))
    n = F.coalesce("__n", F.lit(1)).cast("long")
    return records.join(tried, "uid", "left").groupBy(n.alias("attempts")).agg(F.count(F.lit(1)).alias("episodes"))


def tracking_totals(records: DataFrame, attempts: DataFrame) -> DataFrame:
    """Passes, errors, pre-screen regenerations, compute and tracked seconds over all records."""
    ok = _true(F.col("K.passed"))
    zero = F.lit(0.0)
    screened = attempts.where("prescreen").groupBy("uid").agg(F.count(F.lit(1)).alias("__pre"))
    return records.join(screened, "uid", "left").agg(
        F.count(F.lit(1)).alias("total"), F.sum(ok.cast("long")).alias("k_passed"),
        F.sum(_true(F.col("status").isin("error", "read_error")).cast("long")).alias("errors"),
        F.sum(F.coalesce("__pre", F.lit(0))).alias("prescreen"),
        F.sum(F.coalesce("seconds", zero)).alias("seconds"), F.sum(F.coalesce("duration", zero)).alias("duration_s"),
        F.sum(F.when(ok, F.coalesce("duration", zero)).otherwise(zero)).alias("k_duration_s"))


def written_episodes(records: DataFrame, attempts: DataFrame) -> DataFrame:
    """Every written attempt, the last one final and the earlier ones variants of it; a record without
    attempts stands for its own file. Attempts are numbered from 0 per record."""
    tried = attempts.groupBy("uid").agg(F.max("attempt").alias("__last"))
    final = F.col("attempt") == F.col("__last")
    rows = attempts.where(F.col("file").isNotNull()).join(tried, "uid").join(records.select("uid"), "uid").select(
        "uid", "attempt", final.alias("final"), F.when(~final, F.col("uid")).alias("variant_of"), "file")
    alone = records.where(F.col("file").isNotNull()).join(tried, "uid", "left_anti").select(
        "uid", F.lit(0).cast("long").alias("attempt"), F.lit(True).alias("final"),
        F.lit(None).cast(records.schema["uid"].dataType).alias("variant_of"), "file")
    return rows.unionByName(alone)


def evaluation_table(records: DataFrame) -> DataFrame:
    """Per task: episodes, K, P and joint passes, mean seconds."""
    k, p = _true(F.col("K.passed")), _true(F.col("P.passed"))
    return records.groupBy(F.coalesce("task", F.lit("?")).alias("task")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(k.cast("long")).alias("k"), F.sum(p.cast("long")).alias("p"),
        F.sum((k & p).cast("long")).alias("k_and_p"), F.avg(F.coalesce("seconds", F.lit(0.0))).alias("seconds"))


def task_reasons(records: DataFrame, k_top: int = 6, p_top: int = 8) -> DataFrame:
    """The most frequent reason kinds per task and tier."""
    rows = reason_kinds(records).select("uid", "tier", "kind").distinct()
    named = rows.join(records.select("uid", F.coalesce("task", F.lit("?")).alias("task")), "uid")
    counts = named.groupBy("task", "tier", "kind").agg(F.count(F.lit(1)).alias("episodes"))
    limit = F.when(F.col("tier") == "K", k_top).otherwise(p_top)
    w = Window.partitionBy("task", "tier").orderBy(F.col("episodes").desc(), F.col("kind"))
    return counts.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= limit).drop("__rank")


def build_counters(records: DataFrame) -> DataFrame:
    """One row of running-build counters (also used by the streaming job)."""
    f = stage_flags()
    n = lambda c: F.sum(c.cast("long"))
    return records.agg(F.count_if(F.col("status") != "read_error").alias("episodes"), n(f["errors"]).alias("errors"),
                       n(f["excluded"]).alias("excluded"), n(f["written"]).alias("written"), n(f["K"]).alias("k"),
                       n(f["P_tested"]).alias("p_tested"), n(f["P"]).alias("p"), F.max("rss_mb").alias("max_rss_mb"))


def markdown_stages(counts: DataFrame) -> str:
    """Markdown of a stage-count table (a report-sized result, the only collect in this module)."""
    lines = ["| level | name | " + " | ".join(STAGES) + " |", "|---" * (len(STAGES) + 2) + "|"]
    for r in counts.orderBy("level", "name").collect():
        lines.append("| " + " | ".join(str(r[c]) for c in ("level", "name", *STAGES)) + " |")
    return "\n".join(lines) + "\n"


def index_rows(records: DataFrame) -> DataFrame:
    """Index entries of every record: its own row and those of its final attempts."""
    none = F.array().cast(records.schema["index_rows"].dataType.simpleString())
    rows = F.concat(F.array("index_row"), F.coalesce("index_rows", none))
    return records.select(F.explode(F.array_compact(rows)).alias("r")).select("r.*")


def resolve_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows whose file exists, as given or below ``episodes/``; the first existing candidate is kept."""
    candidates = F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.col("file").alias("path")),
                                   F.struct(F.lit(1).alias("rank"), F.concat(F.lit("episodes/"), F.col("file")).alias("path"))))
    found = rows.select("uid", "file", candidates.alias("c")).join(files.select(F.col("path").alias("have")).distinct(),
                                                                    F.col("c.path") == F.col("have"))
    best = found.groupBy("uid", "file").agg(F.min_by("c.path", "c.rank").alias("__path"))
    return rows.join(best, ["uid", "file"]).withColumn("file", F.col("__path")).drop("__path")
