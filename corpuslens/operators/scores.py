"""From hits to one score row per repository.

``tallies`` sums the hits per (repository, detector, technology); that is the only wide shuffle of a
run, and its map side already combines.  ``score_rows`` then folds the few hundred tallies of a
repository into maps, so that every later rule - peers, corrections, normalisation, validation - is
plain row arithmetic without another shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuslens.functions.numbers import exact_round

MAX_EVIDENCE = 5


def tallies(hits: DataFrame) -> DataFrame:
    """Points and strongest sub-category per repository, detector and technology."""
    return hits.groupBy("repo_id", "detector", "tech").agg(
        F.sum("points").alias("points"), F.max("category").alias("category")
    )


def score_rows(tallied: DataFrame, detectors: list[str]) -> DataFrame:
    """One row per repository: a map per detector, the set of flags, sub-category codes."""
    detector = F.col("detector")

    def as_map(value: str, *names: str) -> Column:
        entries = F.collect_list(F.when(detector.isin(*names), F.struct("tech", value)))
        return F.map_from_entries(entries)

    columns = [as_map("points", d).alias(d) for d in detectors]
    columns += [as_map("category", d).alias(f"{d}_category") for d in detectors if d in CATEGORISED]
    flags = F.collect_list(F.when(detector == "flag", F.col("tech"))).alias("flags")
    return tallied.groupBy("repo_id").agg(*columns, flags)


CATEGORISED = ("frontend", "devops", "testing")


def top_evidence(hits: DataFrame, limit: int = MAX_EVIDENCE) -> DataFrame:
    """First distinct evidence strings per repository, detector and technology.

    Duplicates collapse before anything is ranked, and the ranking keeps only ``limit`` rows per
    group on the map side, so no task ever holds all evidence of a large repository.
    """
    keys = ["repo_id", "detector", "tech"]
    distinct = (
        hits.where("evidence is not null and detector <> 'flag' and detector not like 'architecture+%'")
        .withColumn("detector", F.substring_index("detector", "+", 1))
        .groupBy(*keys, "evidence")
        .agg(F.min(F.struct("step", "path", "ordinal")).alias("place"))
    )
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("place", "evidence"))
    first = distinct.withColumn("rank", rank).where(F.col("rank") <= limit)
    return first.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "evidence"))), lambda s: s["evidence"]).alias("evidence")
    )


def score(scores: Column, tech: str) -> Column:
    """Points of a technology, NULL when it was never scored."""
    return F.try_element_at(scores, F.lit(tech))


def scored(scores: Column, tech: str) -> Column:
    return F.map_contains_key(scores, F.lit(tech))


def with_score(scores: Column, tech: str, value: Column) -> Column:
    """Set the points of one technology, adding it when it is missing."""
    others = F.map_filter(scores, lambda k, _: k != tech)
    return F.map_concat(others, F.create_map(F.lit(tech), value.cast("double")))


def divided(points: Column, divisor: int) -> Column:
    return F.floor(points / divisor).cast("double")


def where_scored(scores: Column, change) -> Column:
    """Apply ``change(tech, points)`` to every scored technology."""
    return F.transform_values(scores, change)


def divide_unless(scores: Column, tech: str, holds: Column, divisor: int) -> Column:
    """Integer-divide the points of a technology whose supporting condition fails."""
    return F.transform_values(
        scores, lambda k, v: F.when((k == tech) & ~holds, divided(v, divisor)).otherwise(v)
    )


def add_all(scores: Column, extra: Column) -> Column:
    """Add the points of ``extra``, creating technologies that are missing."""
    return F.map_zip_with(scores, extra, lambda _, a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))


def normalised(scores: Column, thresholds: dict[str, float], default: float) -> Column:
    """tech -> (matches, confidence): share of the best score in percent, thresholded unrounded.

    A repository whose best score is zero has no entries.
    """
    best = F.array_max(F.map_values(scores))
    limit = lambda k: _by_tech(k, thresholds, default)
    percent = lambda v: F.least(F.lit(100.0), F.try_divide(v, best) * 100)
    kept = F.map_filter(scores, lambda k, v: (best > 0) & (percent(v) >= limit(k)))
    return F.transform_values(
        kept, lambda _, v: F.struct(v.alias("matches"), exact_round(percent(v), 2).alias("confidence"))
    )


def _by_tech(tech: Column, values: dict[str, float], default: float) -> Column:
    chosen = F.lit(float(default))
    for name, value in values.items():
        chosen = F.when(tech == name, float(value)).otherwise(chosen)
    return chosen
