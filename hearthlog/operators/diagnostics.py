"""Coverage and a report that gives nothing private away."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlog.functions import scalars as S
from hearthlog.operators.merge import union_lists, with_first


def warning_groups(warnings: DataFrame, most_paths: int = 8, by: str | None = None) -> DataFrame:
    """category, n, paths from (message, path), and for each value of `by` if given; paths are redacted."""
    keys = [by] if by else []
    rows = warnings.select(*keys, S.warning_category(F.col("message")).alias("category"), S.redact_file(F.col("path")).alias("path"))
    return with_first(rows, [*keys, "category"], "path", most_paths, F.count("*").alias("n")).withColumnRenamed("path", "paths")


def merged(parts: DataFrame, counters: list[str], most_shapes: int = 100) -> DataFrame:
    """One row from (seq, format, shapes, counters...): sums, mixed format and the first distinct shapes."""
    kind = F.when(F.size(F.collect_set("format")) > 1, "mixed").otherwise(F.max("format"))
    return parts.agg(kind.alias("format"), *[F.sum(c).alias(c) for c in counters], union_lists("shapes", F.col("seq"), most_shapes).alias("shapes"))


def coverage(sections: DataFrame) -> DataFrame:
    """section, status and numbers, by name."""
    return sections.select("section", "status", "records", "warnings").orderBy("section")


def coverage_sets(parts: DataFrame, sections: DataFrame, states: DataFrame) -> DataFrame:
    """detected, imported, partial, unsupported, malformed, skipped_parts: sorted distinct lists, in one row.

    Of parts (sections array), folded sections (section, status) and states (part_id, status). The names of sections
    are few; a list of skipped parts has at most as many entries as an archive has files.
    """
    detected = parts.select(F.explode("sections").alias("v")).select(F.lit("detected").alias("k"), "v")
    by_status = sections.select(F.col("status").alias("k"), F.col("section").alias("v"))
    skipped = states.filter("status = 'skipped'").select(F.lit("skipped_parts").alias("k"), F.col("part_id").alias("v"))
    names = ("detected", "imported", "partial", "unsupported", "malformed", "skipped_parts")
    return detected.union(by_status.filter("k != 'detected'")).union(skipped).agg(*[F.array_sort(F.collect_set(F.when(F.col("k") == n, F.col("v")))).alias(n) for n in names])


def parts_status(parts: DataFrame) -> DataFrame:
    """connected: the ids of connected and of missing parts."""
    return parts.groupBy("connected").agg(F.array_sort(F.collect_list("part_id")).alias("part_ids"))


def report(parts: DataFrame, warnings: DataFrame) -> DataFrame:
    """One JSON text; file names lose what they say and ids are replaced."""
    files = parts.agg(F.array_sort(F.collect_list(S.redact_file(F.col("filename")))).alias("parts"), F.count("*").alias("n_parts"))
    groups = warning_groups(warnings).agg(F.array_sort(F.collect_list(F.struct("category", "n", "paths"))).alias("warnings"))
    both = files.crossJoin(groups)  # one row each
    return both.select(F.to_json(F.struct(F.lit("<session>").alias("session"), "parts", "n_parts", "warnings"), {"ignoreNullFields": "false"}).alias("report"))
