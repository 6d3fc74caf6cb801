"""Reports: filters, orders, nested counts, and Markdown made of small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def report_filter(report: DataFrame, rel: str | None = None, least_gap: int = 1, without_note: str | None = None) -> DataFrame:
    """Rows of a gap report; each argument that is given narrows it."""
    out = report if rel is None else report.where(F.col("rel") == rel)
    out = out if least_gap <= 1 else out.where(F.abs("gap") >= least_gap)
    return out if without_note is None else out.where(~F.col("note").eqNullSafe(without_note))


def in_outline(rows: DataFrame, state: str | None = None, county_id: str | None = None, county: str | None = None) -> DataFrame:
    """Outlines of a focus: a county by its id, else by state and name in any case, else a
    whole state, else all."""
    if county_id is not None:
        return rows.where(F.col("poly_id") == county_id)
    out = rows if state is None else rows.where(F.col("state") == state)
    return out if county is None else out.where(F.lower("county") == county.lower())


def by_gap(report: DataFrame, over: bool = False) -> DataFrame:
    """Largest shortfall first; with ``over``, largest excess first."""
    return report.orderBy(F.asc("gap") if over else F.desc("gap"), "fips", "rel")


def by_move(moves: DataFrame, length: str = "move_m") -> DataFrame:
    return moves.orderBy(F.desc(length), "state", "name")


def by_state_and_name(rows: DataFrame) -> DataFrame:
    """By state, and by name in any case."""
    return rows.orderBy("state", F.lower("name"), "name", "row_id")


def gap_totals(report: DataFrame, by: str) -> DataFrame:
    """Totals of a gap report by a class: what lacks where something lacks, both counts, and
    their difference."""
    total = lambda c: F.sum(c).cast("long")
    return report.groupBy(by).agg(
        total(F.greatest("gap", F.lit(0))).alias("positive_gap"), total("mapped").alias("mapped"), total("census").alias("census"), (total("census") - total("mapped")).alias("difference")
    )


def nested_counts(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """``outer, counts``: a map from the values of ``inner`` to their counts."""
    pairs = df.groupBy(outer, inner).agg(F.count("*").alias("n"))
    entry = F.struct(F.coalesce(F.col(inner).cast("string"), F.lit("")).alias("key"), F.col("n").alias("value"))
    return pairs.groupBy(outer).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("counts"))


def distinct_values(df: DataFrame, value: Column, keep: Column, name: str = "value") -> DataFrame:
    """The different values that pass a test, in order."""
    return df.where(keep).select(value.alias(name)).where(F.col(name).isNotNull()).distinct().orderBy(name)


def markdown_table(df: DataFrame, most: int = 80) -> str:
    """The first ``most`` rows as a table; the rest is counted."""
    rows = df.limit(most + 1).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join(cell(v) for v in row) + " |" for row in rows[:most]]
    return "\n".join(lines if len(rows) <= most else [*lines, f"\nThe first {most} rows."])


def markdown_report(title: str, counters: dict[str, object], tables: dict[str, DataFrame], most: int = 80) -> str:
    """A report of counters and tables; no more than ``most`` rows of each reach the driver."""
    parts = [f"# {title}", "\n".join(f"* {name}: {value}" for name, value in counters.items())]
    parts += [f"## {name}\n\n{markdown_table(df, most)}" for name, df in tables.items()]
    return "\n\n".join(p for p in parts if p) + "\n"


def noted(meta: dict, rows: DataFrame, by: str, marker: str, note: str) -> dict:
    """``meta`` with the rows counted anew, in all and by class, and the note added to its
    source, once: not where the marker is there already."""
    counts = {str(r[0]): r[1] for r in rows.groupBy(by).count().collect()}
    source = meta.get("source") or ""
    return {**meta, "n": sum(counts.values()), "by": dict(sorted(counts.items())), "source": source if marker in source else source + note}
