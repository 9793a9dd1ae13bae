"""Interactive queries over the tables of an analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import SEVERITIES, severity_rank, token_estimate
from codeloom.operators import graph


def search(rows: DataFrame, words: str, *columns: str) -> DataFrame:
    """Rows that hold all words, in any case, in the given columns together."""
    hay = F.lower(F.concat_ws(" ", *columns))
    parts = [w for w in words.lower().split() if w]
    return rows.where(F.forall(F.lit(parts), lambda w: F.contains(hay, w))) if parts else rows


def uncertain(score: DataFrame, below: int = 75) -> DataFrame:
    return score.where(F.col("score") < below)


def top_risk(routine: DataFrame, risk: DataFrame) -> DataFrame:
    """Routines by package and line with their gravest severity."""
    worst = risk.groupBy(F.col("owner_id").alias("id")).agg(F.min(severity_rank(F.col("severity"))).alias("r"))
    named = F.element_at(F.lit(list(SEVERITIES)), F.col("r") + 1)
    return routine.join(worst, "id", "left").select("owner", "line", "id", F.when(F.col("r").isNotNull(), named).alias("worst")).orderBy("owner", "line", "id")


def step_at(step: DataFrame, owner: str, line: int) -> DataFrame:
    """The narrowest step that holds a line."""
    hit = step.where((F.col("owner_id") == owner) & (F.col("line") <= line) & (F.col("end_line") >= line))
    w = Window.orderBy(F.col("end_line") - F.col("line"), F.desc("depth"), "link_seq")
    return hit.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")  # the steps of one routine


def prompt_pack(pages: DataFrame, edges: DataFrame, start: str, hops: int, budget: int) -> DataFrame:
    """(id, distance, tokens, running, fits) of a routine's page and those it reaches, near ones first; ``pages`` has id
    and content."""
    near = graph.neighbourhood(edges, start, hops)
    rows = near.join(pages.select(F.col("id").alias("node"), token_estimate(F.col("content")).alias("tokens")), "node")
    w = Window.orderBy("distance", "node").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("running", F.sum("tokens").over(w))  # a routine's neighbourhood
    return rows.select(F.col("node").alias("id"), "distance", "tokens", "running", (F.col("running") <= budget).alias("fits"))
