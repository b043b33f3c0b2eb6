"""Checks of specification documents: normative words, scenarios, requirement headings, dropped requirements, open tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.operators.near_names import near_names

# Fixed patterns: lines end at \n only, whatever the text's other line ends are.
NORMATIVE = r"\b(SHALL|MUST)\b"
SCENARIO = r"(?md)^####\s+Scenario:"
REQUIREMENT = r"(?md)^###\s+Requirement:"
REQUIREMENT_NAME = r"(?md)^###\s+Requirement:[ \t]*(\S.*?)\s*$"
OPEN_TASK = r"(?md)^\s*[-*]\s+\[ \]"


def issues(text: Column) -> Column:
    """What a specification lacks; none for null."""
    found = F.array(
        F.when(~text.rlike(NORMATIVE), F.lit("no normative requirement (use SHALL/MUST)")),
        F.when(~text.rlike(SCENARIO), F.lit('no "#### Scenario:" acceptance criteria')),
        F.when(~text.rlike(REQUIREMENT), F.lit('no "### Requirement:" header')),
    )
    return F.array_compact(found)


def requirement_names(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(REQUIREMENT_NAME), 1)


def open_tasks(text: Column) -> Column:
    return F.regexp_count(text, F.lit(OPEN_TASK)).cast("long")


def is_report(name: Column) -> Column:
    """A markdown file other than a readme."""
    return name.endswith(".md") & (F.lower(name) != "readme.md")


def split_path(docs: DataFrame, root: str, path: str = "path") -> DataFrame:
    """docs with area (specs or changes), capability (the folder below) and file, for documents below the folder ``root``."""
    at = rf"^\Q{root}\E/(specs|changes)/([^/]+)/(.+)$"
    part = lambda i: F.regexp_extract(path, at, i)
    return docs.filter(F.col(path).rlike(at)).select("*", part(1).alias("area"), part(2).alias("capability"), part(3).alias("file"))


def dropped_requirements(deltas: DataFrame, canonical: DataFrame, key: list[str]) -> DataFrame:
    """key..., dropped: requirement names of the canonical text that the delta of the same key lacks, where there are any."""
    c = canonical.select(*key, requirement_names(F.col("text")).alias("had"))
    both = deltas.select(*key, requirement_names(F.col("text")).alias("has")).join(c, key)
    return both.select(*key, F.array_except("had", "has").alias("dropped")).filter(F.size("dropped") > 0)


def validation(deltas: DataFrame, canonical: DataFrame) -> DataFrame:
    """capability, file, issues, dropped, near: all that is found in each delta (capability, file, text), in one row.

    issues as issues(); dropped: requirements of the canonical text of the same place that the delta lacks; near: for a
    capability that is not canonical, the canonical names within two edits, nearest first. All are empty where there is nothing.
    """
    key = ["capability", "file"]
    lost = dropped_requirements(deltas, canonical, key)
    alike = near_capabilities(deltas, canonical).groupBy(F.col("name").alias("capability"))
    alike = alike.agg(F.transform(F.array_sort(F.collect_list(F.struct("distance", "near"))), lambda x: x["near"]).alias("near"))
    none = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    both = deltas.select(*key, F.coalesce(issues(F.col("text")), F.array().cast("array<string>")).alias("issues")).join(lost, key, "left").join(alike, "capability", "left")
    return both.select(*key, "issues", none("dropped"), none("near"))


def sync_plan(deltas: DataFrame, canonical: DataFrame, key: list[str]) -> DataFrame:
    """key..., action of copying deltas over the canonical texts: created, updated, or same where they are equal."""
    c = canonical.select(*key, F.col("text").alias("now"), F.lit(True).alias("there"))
    state = F.when(F.col("there").isNull(), "created").when(F.col("now").eqNullSafe(F.col("text")), "same").otherwise("updated")
    return deltas.join(c, key, "left").select(*key, state.alias("action"))


def near_capabilities(deltas: DataFrame, canonical: DataFrame) -> DataFrame:
    """name, near, distance: capabilities of deltas that are not canonical but within two edits of one that is."""
    return near_names(deltas, canonical, "capability")
