"""Call files of other tools as one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# 0-based columns of chr, start, end and support, what is added to start, and whether the file has a header.
LAYOUTS = {
    "own": ((0, 1, 2, 3), 0, False),
    "CE": ((0, 1, 2, 12), 1, False),
    "CE2": ((0, 1, 2, 12), 1, False),
    "PTESFinder": ((0, 1, 2, 4), 1, True),
    "CircMarker": ((0, 1, 2, 3), 0, False),
    "DCC": ((0, 1, 2, 3), 0, True),
    "find_circ": ((0, 1, 2, 4), 1, False),
    "circRNA_finder": ((0, 1, 2, 4), 1, False),
    "SEGEMEHL": ((1, 2, 3, 0), 0, False),
    "CIRI": ((1, 2, 3, 16), 0, True),
    "NCLscan": ((0, 1, 4, 10), 0, False),
}
#: Column of the strand in NCLscan files.
NCLSCAN_STRAND = 2


def tool_calls(lines: DataFrame, tool: str) -> DataFrame:
    """tool, chr, start_pos, end_pos, support from the lines (column value) of one tool's file."""
    columns, shift, header = LAYOUTS[tool]
    cells = F.split("value", "\t")
    start, end = F.get(cells, columns[1]).cast("long") + shift, F.get(cells, columns[2]).cast("long")
    rows = lines
    if header:
        rows = rows.where(F.try_to_number(F.get(cells, columns[1]), F.lit("999999999999")).isNotNull())
    if tool == "own":
        rows = rows.where((F.get(cells, 4) == "STC") & (F.get(cells, 7) == "Pass"))
    if tool == "NCLscan":
        start, end = swap_by_strand(start, end, F.get(cells, NCLSCAN_STRAND))
    return rows.select(F.lit(tool).alias("tool"), F.get(cells, columns[0]).alias("chr"), start.alias("start_pos"), end.alias("end_pos"), F.get(cells, columns[3]).cast("long").alias("support"))


def swap_by_strand(start: Column, end: Column, strand: Column) -> tuple[Column, Column]:
    """Start and end in genome order where a tool lists them along the strand."""
    return F.when(strand == "+", end).otherwise(start), F.when(strand == "+", start).otherwise(end)


def knife_calls(lines: DataFrame) -> DataFrame:
    """KNIFE junction files: chr|gene:start|gene:end|type|strand, posteriors and support; both posteriors below 0 drop a row."""
    cells, name = F.split("value", "\t"), F.split(F.split("value", "\t")[0], "\\|")
    rows = lines.where(F.get(cells, 2).try_cast("double").isNotNull())
    kept = rows.where(~((F.get(cells, 2).cast("double") < 0) & (F.get(cells, 4).cast("double") < 0)))
    start, end = swap_by_strand(F.split(name[1], ":")[1].cast("long"), F.split(name[2], ":")[1].cast("long"), name[4])
    return kept.select(F.lit("KNIFE").alias("tool"), name[0].alias("chr"), start.alias("start_pos"), end.alias("end_pos"), F.get(cells, 5).cast("long").alias("support"))


def read_tool_calls(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """The files of several tools ({tool: path}) as one table."""
    out = None
    for tool, path in paths.items():
        lines = spark.read.text(path)
        rows = knife_calls(lines) if tool == "KNIFE" else tool_calls(lines, tool)
        out = rows if out is None else out.unionByName(rows)
    return out
