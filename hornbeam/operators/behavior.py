"""Behaviour alerts: from JSON lines to validated values for each package, and counts of values over packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hornbeam.functions.names import first_hostname, split_container
from hornbeam.functions.storage import sized

#: Fields of an alert that are read (fixed values).
FIELDS = ["container.name", "fd.sip", "fd.cip", "fd.name", "proc.name", "proc.cmdline", "user.name", "evt.type", "evt.arg.data"]
ALERT = T.StructType([T.StructField("rule", T.StringType()), T.StructField("output_fields", T.MapType(T.StringType(), T.StringType()))])
RULES = ["outgoing_domain", "incoming_domain", "outgoing_ip", "incoming_ip", "write_file", "read_file", "stat_file", "spawn_process", "sensitive_operation"]
KINDS = {"domain": ["outgoing_domain", "incoming_domain"], "ip": ["outgoing_ip", "incoming_ip"], "file": ["write_file", "read_file", "stat_file"], "process": ["spawn_process"], "sensitive": ["sensitive_operation"]}
MODES = {"write_file": "w", "read_file": "r", "stat_file": "e"}
#: A value seen in more packages than this is noise.
NOISE = 200


def value_of() -> Column:
    """What an alert's rule asks for, or null."""
    field = lambda k: F.col("output_fields").getItem(k)
    rule = F.col("rule")
    process = F.when(field("proc.name").isNotNull() & field("proc.cmdline").isNotNull() & field("user.name").isNotNull(), F.concat_ws(":", field("user.name"), field("proc.cmdline")))
    sensitive = F.when(field("proc.cmdline").isNotNull() & field("user.name").isNotNull(), F.concat_ws(":", field("user.name"), F.coalesce(field("evt.type"), F.lit("None")), field("proc.cmdline")))
    return (
        F.when(rule.isin(KINDS["domain"]), first_hostname(field("evt.arg.data"))).when(rule == "outgoing_ip", field("fd.sip")).when(rule == "incoming_ip", field("fd.cip"))
        .when(rule.isin(KINDS["file"]), F.concat_ws(":", field("fd.name"), F.when(field("fd.name").isNotNull(), F.element_at(F.create_map(*[F.lit(x) for kv in MODES.items() for x in kv]), rule))))
        .when(rule == "spawn_process", process).when(rule == "sensitive_operation", sensitive)
    )


def alert_values(alerts: DataFrame) -> DataFrame:
    """(pkg, version, sudo, rule, value) from (rule, output_fields map): the host's own alerts, unknown rules and
    alerts without what their rule needs are left out. Works on a stream too."""
    host, known = F.col("output_fields").getItem("container.name"), F.col("rule").isin(RULES)
    rows = alerts.filter(known & host.isNotNull() & (host != "") & (host != "host")).select(split_container(host).alias("of"), "rule", value_of().alias("value"))
    return rows.filter(F.col("of").isNotNull() & F.col("value").isNotNull() & (F.col("value") != "")).select("of.pkg", "of.version", "of.sudo", "rule", "value")


def alert_sets(values: DataFrame) -> DataFrame:
    """(pkg, version, sudo, rule, values): distinct values, sorted."""
    return values.groupBy("pkg", "version", "sudo", "rule").agg(F.array_sort(F.collect_set("value")).alias("values"))


def dynamic_results(values: DataFrame) -> DataFrame:
    """One row a package, version and user with its network, file, process and sensitive activities as arrays."""
    of = lambda *kinds: F.array_sort(F.collect_set(F.when(F.col("rule").isin([r for k in kinds for r in KINDS[k]]), F.col("value"))))
    user = F.when(F.col("sudo"), "sudo").otherwise("user").alias("exe_user")
    return values.groupBy("pkg", "version", user).agg(of("domain", "ip").alias("network"), of("file").alias("file"), of("process").alias("child_process"), of("sensitive").alias("sensitive"))


def value_counts(values: DataFrame, pkg: str = "pkg", kind: str = "rule", value: str = "value", most: int | None = NOISE, detail: bool = False) -> DataFrame:
    """(kind, value, packages[, names]): distinct packages of each value, without values of more than `most`. Names are
    put together for the values that are left only."""
    rows = values.filter(F.col(value).isNotNull()).select(F.col(kind).alias("kind"), F.col(value).alias("value"), F.col(pkg).alias("pkg"))
    found = rows.groupBy("kind", "value").agg(F.count_distinct("pkg").alias("packages"))
    found = found if most is None else found.filter(F.col("packages") <= most)
    if not detail:
        return found
    names = rows.join(found, ["kind", "value"], "left_semi").groupBy("kind", "value").agg(F.array_sort(F.collect_set("pkg")).alias("names"))
    return found.join(names, ["kind", "value"])


def suspicious_installs(values: DataFrame, packages: DataFrame, key: str = "pkg", hook: str = "has_install", most: int = NOISE) -> DataFrame:
    """(pkg, values): packages with an install hook, and their network values that are no noise."""
    network = values.filter(F.col("rule").isin(KINDS["domain"] + KINDS["ip"]))
    rare = value_counts(network, key, "rule", "value", most).select(F.col("kind").alias("rule"), "value")
    hooked = packages.filter(F.col(hook)).select(key).distinct()
    return network.join(rare, ["rule", "value"], "left_semi").join(hooked, key, "left_semi").groupBy(key).agg(F.array_sort(F.collect_set("value")).alias("values"))


def containers_by_pair(connections: DataFrame, rows: int | None = None) -> DataFrame:
    """(pair, containers) of src:dst addresses, most containers first; rows: about how many connections there are."""
    pairs = connections.select(F.concat_ws(":", "src", "dst").alias("pair"), "container")
    return sized(pairs, rows, "pair", "container").groupBy("pair").agg(F.count_distinct("container").alias("containers")).orderBy(F.col("containers").desc(), "pair")
