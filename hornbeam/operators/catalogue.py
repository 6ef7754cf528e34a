"""API catalogues: from tables of sensitive APIs to catalogue rows, formulas and lists for other engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def from_sensitive_apis(table: DataFrame, separator: str = ".") -> DataFrame:
    """(id, full_name, name, base_type, functionality, source_type, sink_type, arg_ids) from the columns Sources,
    SourceType, Sinks, SinkType, Dangers, DangerType; a cell may end in argument places like `:0:2`, which become arg_ids.
    Both `::` and the given separator part base and name. Ids follow functionality and name."""
    kinds = [F.struct(F.lit(k).alias("functionality"), F.col(c).alias("cell"), F.col(t).alias("type")) for k, c, t in (("SOURCE", "Sources", "SourceType"), ("SINK", "Sinks", "SinkType"), ("DANGER", "Dangers", "DangerType"))]
    rows = table.select(F.explode(F.array(*kinds)).alias("r")).select("r.*").withColumn("cell", F.trim("cell")).filter(F.length("cell") > 0)
    places = F.regexp_extract("cell", r"((?::\d+)+)$", 1)
    rows = rows.withColumn("arg_ids", F.transform(F.filter(F.split(places, ":"), lambda x: x != ""), lambda x: x.cast("int"))).withColumn("full_name", F.regexp_replace(F.regexp_replace("cell", r"(:\d+)+$", ""), "::|->", separator))
    rows = rows.groupBy("functionality", "full_name").agg(F.min(F.trim("type")).alias("type"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("arg_ids")))).alias("arg_ids"))
    base = F.substring_index("full_name", separator, -1)
    source = F.col("functionality") == "SOURCE"
    return rows.select(
        F.row_number().over(Window.orderBy("functionality", "full_name")).alias("id"), "full_name", base.alias("name"),
        F.nullif(F.expr(f"left(full_name, greatest(length(full_name) - length(substring_index(full_name, '{separator}', -1)) - {len(separator)}, 0))"), F.lit("")).alias("base_type"),
        "functionality", F.when(source, F.col("type")).alias("source_type"), F.when(~source, F.col("type")).alias("sink_type"), "arg_ids",
    )


def formula_of(catalogue: DataFrame) -> str:
    """((sources) & (sinks)) | dangers, over a catalogue's ids; a group without any is false."""
    ids = {r["functionality"]: r["ids"] for r in catalogue.groupBy("functionality").agg(F.array_sort(F.collect_set("id")).alias("ids")).collect()}
    group = lambda k: "(" + " | ".join(map(str, ids.get(k, []))) + ")"
    return f"({group('SOURCE')} & {group('SINK')}) | {group('DANGER')}"


def trigger_words(catalogue: DataFrame) -> DataFrame:
    """(functionality, word) as a taint engine for scripts takes them: the call with its opening bracket."""
    return catalogue.filter(F.col("functionality").isin("SOURCE", "SINK")).select("functionality", F.concat("full_name", F.lit("(")).alias("word")).distinct()


def sink_parameters(catalogue: DataFrame) -> DataFrame:
    """(full_name, sink_type, parameter, complete): one row an argument place; sinks without any are kept and marked."""
    sinks = catalogue.filter(F.col("functionality").isin("SINK", "DANGER"))
    return sinks.select("full_name", "sink_type", F.explode_outer("arg_ids").alias("parameter"), (F.size("arg_ids") > 0).alias("complete"))


def extended(catalogue: DataFrame, summaries: DataFrame) -> DataFrame:
    """The catalogue with APIs that summaries of dependencies add (full_name, functionality, type), first by name kept."""
    new = summaries.join(catalogue, ["full_name", "functionality"], "left_anti").groupBy("full_name", "functionality").agg(F.min("type").alias("type"))
    top = catalogue.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    source = F.col("functionality") == "SOURCE"
    rows = new.crossJoin(F.broadcast(top)).select(
        (F.row_number().over(Window.orderBy("functionality", "full_name")) + F.col("top")).alias("id"), "full_name", F.substring_index("full_name", ".", -1).alias("name"),
        F.nullif(F.regexp_extract("full_name", r"^(.*)\.[^.]*$", 1), F.lit("")).alias("base_type"), "functionality",
        F.when(source, F.col("type")).alias("source_type"), F.when(~source, F.col("type")).alias("sink_type"), F.array().cast("array<int>").alias("arg_ids"),
    )
    return catalogue.unionByName(rows)
