"""Small result tables as CSV and Markdown; what is large stays Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.sources.shards import write_text


def human_bytes(n: float) -> str:
    for unit in ("B", "KiB", "MiB", "GiB", "TiB"):
        if abs(n) < 1024 or unit == "TiB":
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    raise AssertionError


def _cell(x: object) -> str:
    return "" if x is None else f"{x:.6g}" if isinstance(x, float) else ", ".join(map(str, x)) if isinstance(x, list) else str(x)


def markdown(title: str, tables: dict[str, DataFrame], most: int = 200) -> str:
    """A heading for each table and at most `most` of its rows, in the order of their cells; what is left out is said."""
    out = [f"# {title}"]
    for name, df in tables.items():
        rows = df.limit(most + 1).collect()
        lines = sorted("| " + " | ".join(_cell(x).replace("|", "\\|").replace("\n", " ") for x in r) + " |" for r in rows[:most])
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *lines]
        if len(rows) > most:
            out += ["", f"Only {most} rows are shown."]
    return "\n".join(out) + "\n"


def publish(title: str, tables: dict[str, DataFrame], path: str) -> None:
    """Each table as CSV (one file a folder) and all of them in report.md."""
    for name, df in tables.items():
        flat = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
        df.select(*flat).coalesce(1).write.mode("overwrite").csv(f"{path}/{name}", header=True, emptyValue="")
    spark = next(iter(tables.values())).sparkSession
    write_text(spark, f"{path}/report.md", markdown(title, tables))
