"""The named queries over the driver's tables, each beside the SQL that states the same result.

The tables stand in for registry data; every query applies the library's own operator to a whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hornbeam.functions import names
from hornbeam.functions.formula import satisfied
from hornbeam.functions.storage import cut, sized
from hornbeam.operators import authors, behavior, catalogue, content, extract, flows, graph, ranking, rules, similarity, usage, versions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(c: Column, by: str = ",") -> Column:
    return F.array_join(c, by)


def event_values(spark: SparkSession, d: str) -> DataFrame:
    """events as behaviour values: user = package, type = rule, props.k = value."""
    return table(spark, d, "events").select(F.col("user_id").alias("pkg"), F.col("event_type").alias("rule"), F.get_json_object("props", "$.k").alias("value"), "ts", "event_id")


# Behaviour


@query("SELECT event_type AS kind, json_extract_string(props, '$.k') AS value, count(DISTINCT user_id) AS packages FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT user_id) <= 20")
def behavior_value_counts(spark: SparkSession, d: str) -> DataFrame:
    return behavior.value_counts(event_values(spark, d), most=20)


@query("SELECT user_id AS pkg, event_type AS rule, array_to_string(list_sort(list(DISTINCT json_extract_string(props, '$.k'))), ',') AS vals FROM events GROUP BY 1, 2")
def behavior_alert_sets(spark: SparkSession, d: str) -> DataFrame:
    v = event_values(spark, d).withColumn("version", F.lit("1")).withColumn("sudo", F.lit(False))
    return behavior.alert_sets(v).select("pkg", "rule", joined(F.col("values")).alias("vals"))


@query(
    """WITH r AS (SELECT event_type, json_extract_string(props, '$.k') AS k FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1, 2 HAVING count(DISTINCT user_id) <= 20)
    SELECT user_id AS pkg, array_to_string(list_sort(list(DISTINCT json_extract_string(props, '$.k'))), ',') AS vals
    FROM events e JOIN r ON e.event_type = r.event_type AND json_extract_string(props, '$.k') = r.k
    WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1"""
)
def behavior_install_network(spark: SparkSession, d: str) -> DataFrame:
    as_rule = F.when(F.col("rule") == "click", "outgoing_domain").when(F.col("rule") == "view", "outgoing_ip").when(F.col("rule") == "purchase", "incoming_ip")
    values = event_values(spark, d).withColumn("rule", as_rule).filter("rule IS NOT NULL")
    packages = table(spark, d, "customer").select(F.col("c_custkey").alias("pkg"), (F.col("c_mktsegment") == "BUILDING").alias("has_install"))
    return behavior.suspicious_installs(values, packages, most=20).select("pkg", joined(F.col("values")).alias("vals"))


@query(
    """SELECT 'u..' || user_id AS pkg, CASE event_type WHEN 'view' THEN NULL ELSE '1.' || event_type END AS version, event_type = 'purchase' AS sudo,
      'read_file' AS rule, array_to_string(list_sort(list(DISTINCT '/tmp/' || json_extract_string(props, '$.k') || ':r')), ',') AS vals
    FROM events WHERE event_type <> 'click' AND json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1, 2, 3"""
)
def behavior_alert_parsing(spark: SparkSession, d: str) -> DataFrame:
    """events as alerts of containers u..user..version..job; those of clicks come from the host."""
    kind = F.col("event_type")
    version = F.when(kind == "view", "None").otherwise(F.concat(F.lit("1."), kind))
    job = F.when(kind == "purchase", "install-sudo").otherwise("install")
    container = F.when(kind == "click", "host").otherwise(F.concat_ws("..", F.lit("u"), F.col("user_id").cast("string"), version, job))
    fields = F.create_map(F.lit("container.name"), container, F.lit("fd.name"), F.concat(F.lit("/tmp/"), F.get_json_object("props", "$.k")))
    values = behavior.alert_values(table(spark, d, "events").select(F.lit("read_file").alias("rule"), fields.alias("output_fields")))
    return behavior.alert_sets(values).select("pkg", "version", "sudo", "rule", joined(F.col("values")).alias("vals"))


@query("SELECT s_nationkey || ':' || c_nationkey AS pair, count(DISTINCT o_orderkey) AS containers FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def behavior_address_pairs(spark: SparkSession, d: str) -> DataFrame:
    n, lines = line_count(spark, d), table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    orders = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    facts = sized(lines.select("l_orderkey", "s_nationkey"), n, "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return behavior.containers_by_pair(facts.select(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst"), F.col("o_orderkey").alias("container")), n)


@query(
    """SELECT * FROM (SELECT event_id, CASE event_id % 16 WHEN 0 THEN 'outgoing_domain' WHEN 1 THEN CASE WHEN json_extract_string(props, '$.k')::INT >= 30 THEN 'outgoing_ip' END WHEN 2 THEN 'incoming_ip'
      WHEN 3 THEN CASE WHEN json_extract_string(props, '$.k')::INT < 50 THEN 'write_file' END WHEN 4 THEN 'read_file' WHEN 5 THEN 'spawn_process' WHEN 6 THEN 'sensitive_operation'
      WHEN 8 THEN 'write_file' WHEN 9 THEN 'write_file' WHEN 10 THEN 'spawn_process' WHEN 11 THEN 'spawn_process' WHEN 12 THEN 'spawn_process' WHEN 13 THEN 'sensitive_operation' END AS rule
    FROM events) WHERE rule IS NOT NULL"""
)
def tracing_rules(spark: SparkSession, d: str) -> DataFrame:
    """events as system calls: sixteen kinds, of which some fit a rule, some only with a certain value, some none."""
    k = F.get_json_object("props", "$.k").cast("int")
    calls = [  # type and the fields that count
        {"evt_type": "recvfrom", "fd_sport": "53"}, {"evt_type": "connect", "fd_sip": F.when(k < 30, "192.168.7.9").otherwise("8.8.4.4")}, {"evt_type": "accept", "fd_cip": "8.8.4.4"},
        {"evt_type": "open", "evt_is_open_write": "true", "fd_name": F.when(k < 50, "/etc/passwd").otherwise("/tmp/x")}, {"evt_type": "open", "evt_is_open_read": "true", "fd_name": "/home/u/.ssh/id"},
        {"evt_type": "execve", "proc_name": "nc"}, {"evt_type": "setuid", "proc_name": "node"}, {"evt_type": "execve", "proc_name": "nc", "container_id": "host"},
        {"evt_type": "rename", "fd_directory": "/usr/bin"}, {"evt_type": "creat", "fd_directory": "/dev", "fd_name": "/dev/x"}, {"evt_type": "execve", "proc_name": "sh", "proc_pname": "mysqld"},
        {"evt_type": "execve", "proc_name": "grep", "proc_cmdline": "grep -r id_rsa /"}, {"evt_type": "execve", "proc_name": "ls", "user_name": "eve"}, {"evt_type": "symlink", "fd_name": "/etc/shadow"},
        {"evt_type": "setuid", "proc_name": "sudo"}, {"evt_type": "connect", "fd_sip_name": "pypi.org", "fd_sip": "8.8.4.4"},
    ]
    fields = sorted({f for c in calls for f in c} | {"container_id"})
    which = F.col("event_id") % len(calls)
    lit = lambda v: F.lit(v) if isinstance(v, str) else v

    def field(name: str) -> Column:
        out = F.lit("c1" if name == "container_id" else None).cast("string")
        for n, c in enumerate(calls):
            out = F.when(which == n, lit(c[name])).otherwise(out) if name in c else out
        return out.alias(name)

    return rules.WATCH.alerts(table(spark, d, "events").select("event_id", *map(field, fields))).select("event_id", "rule")


# Names

PART_NAMES = "SELECT DISTINCT p_name AS n FROM part"


@query(f"WITH p AS ({PART_NAMES}) SELECT a.n AS a, b.n AS b, levenshtein(a.n, b.n)::BIGINT AS distance FROM p a JOIN p b ON a.n < b.n AND levenshtein(a.n, b.n) <= 2")
def name_edit_distance_pairs(spark: SparkSession, d: str) -> DataFrame:
    return similarity.edit_distance_pairs(table(spark, d, "part"), name="p_name", limit=2).withColumn("distance", F.col("distance").cast("long"))


@query("SELECT a.s_name AS a, b.s_name AS b, round(levenshtein(a.s_name, b.s_name)::DOUBLE / greatest(length(a.s_name), length(b.s_name)), 9) AS distance FROM supplier a JOIN supplier b ON a.s_name < b.s_name AND levenshtein(a.s_name, b.s_name) <= 1")
def supplier_edit_distance(spark: SparkSession, d: str) -> DataFrame:
    return similarity.edit_distance_pairs(table(spark, d, "supplier"), name="s_name", limit=1, metric="normalized").withColumn("distance", F.round("distance", 9))


@query("WITH n AS (SELECT p_name AS x FROM part UNION SELECT p_type FROM part UNION SELECT split_part(p_name, ' ', 1) FROM part) SELECT a.x AS first, b.x AS second FROM n a JOIN n b ON a.x <> b.x AND length(a.x) > 5 AND length(b.x) > 5 AND contains(b.x, a.x)")
def combo_squat_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    every = p.select(F.col("p_name").alias("name")).union(p.select("p_type")).union(p.select(F.substring_index("p_name", " ", 1)))
    return similarity.combo_squats(every)


@query(
    """SELECT page_id, regexp_replace(replace(url, '/', '..'), '[^a-zA-Z0-9_.-]', '..', 'g') AS file_name, substr(md5(url), 1, 16) AS md5_prefix,
      strlen(url) AS bytes, regexp_matches(url, '^[\\x15-\\x7f]*$') AS is_ascii FROM pages"""
)
def name_sanitizing(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", names.file_name(url).alias("file_name"), names.md5_prefix(url).alias("md5_prefix"), F.length(names.as_bytes(url)).cast("long").alias("bytes"), names.is_ascii(url).alias("is_ascii"))


# Selection


@query("SELECT c_custkey, c_name, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS downloads FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 100")
def select_top_packages(spark: SparkSession, d: str) -> DataFrame:
    return ranking.select_packages(_customer_downloads(spark, d), "downloads", "c_custkey", top=100)


def _customer_downloads(spark: SparkSession, d: str) -> DataFrame:
    sums = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("downloads"))
    return table(spark, d, "customer").select("c_custkey", "c_name").join(sums, "c_custkey")


@query("SELECT c_custkey, c_name, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS downloads FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2 HAVING sum(o_totalprice::DECIMAL(18,2)) >= 3000000")
def select_threshold(spark: SparkSession, d: str) -> DataFrame:
    return ranking.select_packages(_customer_downloads(spark, d), "downloads", "c_custkey", threshold=3_000_000)


@query(
    """WITH n AS (SELECT event_type AS manager, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2),
    l AS (SELECT manager, arg_max(n, day) AS n FROM n GROUP BY 1) SELECT manager, n FROM l WHERE n >= 10"""
)
def select_manager(spark: SparkSession, d: str) -> DataFrame:
    daily = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).pivot("event_type", _kinds(spark, d)).count()
    return ranking.select_managers(daily, "day", 10)


def _kinds(spark: SparkSession, d: str) -> list[str]:
    """The registries: the columns of a wide table, of which there are few."""
    return [r[0] for r in table(spark, d, "events").select("event_type").distinct().orderBy("event_type").collect()]


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def filter_packages_by_api(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pkg"), F.col("l_returnflag").alias("full_name"))
    wanted = spark.createDataFrame([("R",)], "full_name string")
    return usage.packages_using(table(spark, d, "orders").withColumnRenamed("o_orderkey", "pkg"), used, wanted).select(F.col("pkg").alias("o_orderkey"), "o_custkey")


@query(
    """SELECT c_custkey, coalesce(m['overall'], m['last_month']) AS downloads FROM (
      SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN MAP {'overall': c_custkey * 10, 'last_month': c_custkey} ELSE MAP {'last_month': c_custkey} END AS m FROM customer)"""
)
def package_downloads(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    cell = F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("{u'overall': "), k, F.lit("0, 'last_month': "), k, F.lit("}"))).otherwise(F.concat(F.lit("{'last_month': "), k, F.lit(", 'last_week': None}")))
    return table(spark, d, "customer").select("c_custkey", ranking.downloads_of(names.literal_map(cell)).alias("downloads"))


# Usage


def part_usage(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as API usage: order = package, brand = API."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("full_name"), "p_type")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pkg"), "l_partkey", F.col("l_returnflag").alias("file")).join(part, "l_partkey")


USAGE = "(SELECT l_orderkey AS pkg, p_brand AS full_name, l_returnflag AS file FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query(f"SELECT full_name AS api, count(*) AS n FROM {USAGE} GROUP BY 1 UNION ALL SELECT 'analyzed', count(DISTINCT pkg) FROM {USAGE}")
def api_usage_counts(spark: SparkSession, d: str) -> DataFrame:
    return usage.usage_counts(part_usage(spark, d))


@query(f"SELECT file || ':' || full_name AS api, count(DISTINCT pkg) AS n, sum(DISTINCT pkg)::BIGINT AS keys FROM {USAGE} GROUP BY 1 UNION ALL SELECT 'analyzed', count(DISTINCT pkg), sum(DISTINCT pkg)::BIGINT FROM {USAGE}")
def api_usage_packages(spark: SparkSession, d: str) -> DataFrame:
    return usage.usage_packages(part_usage(spark, d), by_file=True).groupBy("api").agg(F.count("pkg").alias("n"), F.sum("pkg").alias("keys"))


@query("SELECT l_orderkey AS pkg, split_part(p_type, ' ', 1) AS permission, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def permission_counts(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("full_name"), F.lit("SOURCE").alias("functionality"), F.substring_index("p_type", " ", 1).alias("source_type"), F.lit(None).cast("string").alias("sink_type"))
    used = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pkg"), F.col("l_partkey").cast("string").alias("full_name"))
    return usage.permission_counts(used, known)


@query(
    """WITH a AS (SELECT o_custkey AS pkg, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 END AS id FROM orders UNION ALL SELECT o_custkey, 3 FROM orders WHERE o_orderstatus = 'P'),
    s AS (SELECT pkg, bool_or(id = 1) AND bool_or(id = 2) OR bool_or(id = 3) AS ok FROM a WHERE id IS NOT NULL GROUP BY 1)
    SELECT c_custkey AS pkg, coalesce(ok, FALSE) AS satisfied FROM customer LEFT JOIN s ON c_custkey = pkg"""
)
def smt_formula(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    used = o.select(F.col("o_custkey").alias("pkg"), F.col("o_orderpriority").alias("full_name")).union(o.select("o_custkey", F.concat(F.lit("status "), F.col("o_orderstatus"))))
    known = spark.createDataFrame([(1, "1-URGENT"), (2, "2-HIGH"), (3, "status P")], "id int, full_name string")
    packages = table(spark, d, "customer").select(F.col("c_custkey").alias("pkg"))
    return usage.formula_verdicts(packages, used, known, "(1 & 2) | 3").select("pkg", "satisfied")


@query(
    """WITH RECURSIVE c(src, dst) AS (SELECT p_partkey, p_partkey // 2 FROM part WHERE p_partkey > 0 UNION SELECT c.src, c.dst // 2 FROM c WHERE c.dst > 0),
    u AS (SELECT p_partkey AS pkg, CASE p_brand WHEN 'Brand#11' THEN 1 WHEN 'Brand#22' THEN 2 WHEN 'Brand#33' THEN 3 END AS id FROM part),
    a AS (SELECT pkg, id FROM u UNION SELECT src, id FROM c JOIN u ON dst = pkg),
    s AS (SELECT pkg, bool_or(id = 1) AND (bool_or(id = 2) OR bool_or(id = 3)) AS ok FROM a WHERE id IS NOT NULL GROUP BY 1)
    SELECT p_partkey AS pkg, coalesce(ok, FALSE) AS satisfied FROM part LEFT JOIN s ON p_partkey = pkg"""
)
def formula_with_dependencies(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    known = spark.createDataFrame([(1, "Brand#11"), (2, "Brand#22"), (3, "Brand#33")], "id int, full_name string")
    used = p.select(F.col("p_partkey").alias("pkg"), F.col("p_brand").alias("full_name"))
    return usage.formula_verdicts(p.select(F.col("p_partkey").alias("pkg")), used, known, "1 & (2 | 3)", tree_edges(spark, d)).select("pkg", "satisfied")


@query("SELECT DISTINCT user_id, event_type, json_extract_string(props, '$.k') AS value FROM events")
def dedupe_findings(spark: SparkSession, d: str) -> DataFrame:
    return usage.distinct_findings(event_values(spark, d).select(F.col("pkg").alias("user_id"), F.col("rule").alias("event_type"), "value"), "user_id", "event_type", "value")


@query("SELECT DISTINCT o_custkey, o_orderpriority, 'fixed' AS status FROM orders o WHERE o_orderdate < TIMESTAMP '1996-01-01' AND NOT EXISTS (SELECT 1 FROM orders n WHERE n.o_orderdate >= TIMESTAMP '1996-01-01' AND n.o_custkey = o.o_custkey AND n.o_orderpriority = o.o_orderpriority) UNION ALL SELECT DISTINCT o_custkey, o_orderpriority, 'new' FROM orders o WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND NOT EXISTS (SELECT 1 FROM orders n WHERE n.o_orderdate < TIMESTAMP '1996-01-01' AND n.o_custkey = o.o_custkey AND n.o_orderpriority = o.o_orderpriority)")
def report_diff(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return usage.report_diff(o.filter("o_orderdate < '1996-01-01'"), o.filter("o_orderdate >= '1996-01-01'"), "o_custkey", "o_orderpriority")


@query(
    """WITH n AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS m FROM part UNION SELECT DISTINCT CASE WHEN p_size > 25 THEN p_name ELSE split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2) END FROM part),
    f AS (SELECT DISTINCT p_name || ' x' AS name FROM part)
    SELECT name, m AS match FROM f LEFT JOIN n ON contains(name, m) QUALIFY row_number() OVER (PARTITION BY name ORDER BY length(m) DESC, m) = 1"""
)
def best_name_match(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    known = p.select(F.substring_index("p_name", " ", 1).alias("full_name")).union(p.select(F.when(F.col("p_size") > 25, F.col("p_name")).otherwise(F.concat_ws(" ", F.split("p_name", " ")[0], F.split("p_name", " ")[1])))).distinct()
    return usage.best_match(p.select(F.concat("p_name", F.lit(" x")).alias("name")).distinct(), known)


# Versions


def order_versions(spark: SparkSession, d: str) -> DataFrame:
    """orders as releases: customer = package, order key = version number."""
    return table(spark, d, "orders").select(F.col("o_custkey").alias("pkg"), F.concat(F.lit("v1."), F.col("o_orderkey").cast("string")).alias("version"), F.col("o_orderdate").alias("ts"))


def line_count(spark: SparkSession, d: str) -> int:
    """Rows of lineitem, from its files' footers."""
    return table(spark, d, "lineitem").count()


def version_items(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("key"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("version"), "l_partkey").join(part, "l_partkey").select("version", "key")
    return sized(lines, line_count(spark, d), "version").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("version"), F.col("o_custkey").alias("pkg")), "version").select("pkg", "version", "key")


ITEMS = "(SELECT o_custkey AS pkg, l_orderkey AS version, p_brand AS key FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"


@query(
    f"""WITH i AS (SELECT * FROM {ITEMS}), t AS (SELECT pkg, count(DISTINCT version) AS v FROM i GROUP BY 1), h AS (SELECT pkg, key, count(DISTINCT version) AS m FROM i GROUP BY 1, 2)
    SELECT i.pkg, i.version, i.key, count(*) AS n, m = v AS is_common, m <> v AS is_unique FROM i JOIN t ON i.pkg = t.pkg JOIN h ON i.pkg = h.pkg AND i.key = h.key GROUP BY i.pkg, i.version, i.key, m, v"""
)
def version_comparison(spark: SparkSession, d: str) -> DataFrame:
    return versions.compare(version_items(spark, d), rows=line_count(spark, d))


@query(f"WITH i AS (SELECT * FROM {ITEMS}), t AS (SELECT pkg, count(DISTINCT version) AS v FROM i GROUP BY 1) SELECT i.pkg, key FROM i JOIN t USING (pkg) GROUP BY i.pkg, key, v HAVING count(DISTINCT version) = v")
def version_common_unique(spark: SparkSession, d: str) -> DataFrame:
    return versions.common_keys(version_items(spark, d), line_count(spark, d))


@query(
    f"""WITH i AS (SELECT * FROM {ITEMS}), t AS (SELECT pkg, count(DISTINCT version) AS v FROM i GROUP BY 1), h AS (SELECT pkg, key, count(DISTINCT version) AS m FROM i GROUP BY 1, 2),
    bad AS (SELECT DISTINCT i.pkg, i.version FROM i JOIN t ON i.pkg = t.pkg JOIN h ON i.pkg = h.pkg AND i.key = h.key WHERE m <> v AND i.key IN ('Brand#11', 'Brand#22'))
    SELECT o_custkey AS pkg, count(bad.pkg) AS bad_versions, count(*) AS versions FROM orders LEFT JOIN bad ON o_custkey = bad.pkg AND o_orderkey = bad.version
    GROUP BY 1 HAVING count(bad.pkg) * 2 < count(*) AND max(CASE WHEN bad.pkg IS NOT NULL AND o_orderdate > TIMESTAMP '2000-01-01' - INTERVAL 730 DAY THEN 1 ELSE 0 END) = 1"""
)
def version_interest_filter(spark: SparkSession, d: str) -> DataFrame:
    times = table(spark, d, "orders").select(F.col("o_custkey").alias("pkg"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("ts"))
    return versions.interesting(version_items(spark, d), times, ["Brand#11", "Brand#22"], "2000-01-01")


@query(
    """WITH v AS (SELECT o_custkey AS pkg, o_orderkey AS k, o_orderdate AS ts, count(*) OVER (PARTITION BY o_custkey) AS n, max(o_orderdate) OVER (PARTITION BY o_custkey) AS m FROM orders),
    b AS (SELECT *, (epoch_us(m) - epoch_us(ts)) // (30::BIGINT * 86400000000) AS bucket FROM v),
    h AS (SELECT *, row_number() OVER (PARTITION BY pkg, bucket ORDER BY k DESC) AS r FROM b),
    p AS (SELECT *, row_number() OVER (PARTITION BY pkg ORDER BY bucket) AS place FROM h WHERE n <= 8 OR r = 1)
    SELECT pkg, 'v1.' || k AS version, ts FROM p WHERE n <= 8 OR place <= 8"""
)
def version_thinning(spark: SparkSession, d: str) -> DataFrame:
    return versions.thin(order_versions(spark, d), most=8, gap_days=30)


@query("WITH v AS (SELECT o_custkey AS pkg, 'v1.' || o_orderkey AS version, o_orderdate AS ts, lag(o_orderdate) OVER w AS a, lead(o_orderdate) OVER w AS b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey DESC)) SELECT pkg, version, ts FROM v WHERE a < ts AND ts > b")
def version_local_max(spark: SparkSession, d: str) -> DataFrame:
    return versions.out_of_turn(order_versions(spark, d))


@query("SELECT o_custkey AS pkg, 'v1.' || o_orderkey AS version, o_orderdate AS ts FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) <= 3")
def version_highest(spark: SparkSession, d: str) -> DataFrame:
    return versions.highest(order_versions(spark, d), 3)


@query("SELECT o_custkey AS pkg, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS require FROM orders GROUP BY 1")
def version_latest_release(spark: SparkSession, d: str) -> DataFrame:
    releases = table(spark, d, "orders").select(F.col("o_custkey").alias("pkg"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("require"))
    return versions.latest_release(releases)


@query("SELECT c_custkey AS pkg, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE ends_with(o_orderpriority, 'URGENT') OR ends_with(o_orderpriority, 'LOW'))")
def version_permission_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("pkg"), "c_name")
    permissions = table(spark, d, "orders").select(F.col("o_custkey").alias("pkg"), F.col("o_orderpriority").alias("permission"))
    return versions.with_sensitive_permissions(rows, permissions, ["URGENT", "LOW"])


# Content


@query("SELECT lang AS pkg, sha1(text) AS version, count(DISTINCT source) AS sources, count(DISTINCT doc_id) AS hashes FROM documents GROUP BY 1, 2 HAVING count(DISTINCT source) >= 2 AND count(DISTINCT doc_id) > 1")
def hash_mismatch(spark: SparkSession, d: str) -> DataFrame:
    return content.hash_mismatches(table(spark, d, "documents").select("source", F.col("lang").alias("pkg"), F.sha1(F.encode("text", "UTF-8")).alias("version"), F.col("doc_id").alias("hash")))


@query("SELECT sha1(text) AS sha1, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_content(spark: SparkSession, d: str) -> DataFrame:
    return content.duplicates(table(spark, d, "documents").select(F.encode("text", "UTF-8").alias("content")))


@query(
    """WITH a AS (SELECT text AS path, min(sha1(text || source)) AS s FROM documents WHERE source = 'src0' GROUP BY 1), b AS (SELECT text AS path, min(sha1(text || source)) AS s FROM documents WHERE source <> 'src0' GROUP BY 1)
    SELECT sha1(coalesce(a.path, b.path)) AS path, a.s AS left_sha1, b.s AS right_sha1 FROM a FULL JOIN b ON a.path = b.path WHERE a.s IS DISTINCT FROM b.s"""
)
def content_difference(spark: SparkSession, d: str) -> DataFrame:
    text = F.sha1(F.encode("text", "UTF-8"))
    side = lambda which: table(spark, d, "documents").filter(which).groupBy(text.alias("path")).agg(F.min(F.sha1(F.encode(F.concat("text", "source"), "UTF-8"))).alias("sha1"))
    return content.content_differences(side(F.col("source") == "src0"), side(F.col("source") != "src0"))


@query(r"SELECT doc_id, array_to_string(list_filter(string_split_regex(text, '\r?\n'), lambda x: regexp_matches(x, '(?i)license')), '|') AS lines FROM documents WHERE regexp_matches(text, '(?i)license')")
def grep_documents(spark: SparkSession, d: str) -> DataFrame:
    return content.grep(table(spark, d, "documents"), "(?i)license", "doc_id", "text").select("doc_id", joined(F.col("lines"), "|").alias("lines"))


@query("""SELECT page_id FROM pages WHERE contains(html, 'lang="fr"')""")
def anchor_pages(spark: SparkSession, d: str) -> DataFrame:
    return content.anchors(table(spark, d, "pages"), 'lang="fr"', "page_id")


@query("""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link FROM pages""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.explode(names.links(F.col("html"))).alias("link"))


@query(
    r"""WITH h AS (SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1) AS host FROM pages)
    SELECT host, count(DISTINCT page_id) AS pages FROM h WHERE length(host) <= 255 AND contains(host, '.') AND regexp_matches(host, '^[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?(\.[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?)+\.?$') GROUP BY 1"""
)
def url_hosts(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "pages").select("page_id", names.host_of(F.col("url")).alias("host"))
    return h.filter(names.is_hostname(F.col("host"))).groupBy("host").agg(F.count_distinct("page_id").alias("pages"))


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-06-01' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-06-01')")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return content.snapshot_diff(o.filter("o_orderdate >= '1996-06-01'"), o.filter("o_orderdate < '1996-06-01'"), ["o_custkey"]).select("o_orderkey", "o_custkey", "o_orderdate")


@query("SELECT n_name AS pkg FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) AND n_nationkey IN (SELECT s_nationkey FROM supplier)")
def common_packages(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("pkg"))
    one = n.join(table(spark, d, "customer"), F.col("n_nationkey") == F.col("c_nationkey"), "left_semi")
    two = n.join(table(spark, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left_semi")
    return content.common_packages([one, two])


# Authors


@query(r"SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[\w.-]+@[\w.-]+')) AS email FROM documents")
def author_emails(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(names.emails(F.col("text"))).alias("email"))


def author_facts(spark: SparkSession, d: str) -> DataFrame:
    """orders as packages of authors: customer = author, priority = registry, order price = downloads."""
    return table(spark, d, "orders").select(F.col("o_custkey").alias("email"), F.substring("o_orderpriority", 1, 1).alias("language"), F.round(F.col("o_totalprice") * 100).cast("long").alias("downloads"), (F.col("o_orderkey") % 100).alias("uses"))


AUTHORS = "(SELECT o_custkey AS email, substr(o_orderpriority, 1, 1) AS language, round(o_totalprice * 100)::BIGINT AS downloads, o_orderkey % 100 AS uses FROM orders)"


@query(
    "SELECT email, count(*) AS packages, sum(downloads)::BIGINT AS downloads, sum(uses)::BIGINT AS uses, "
    + ", ".join(f"count(*) FILTER (language = '{x}') AS \"{x}_packages\", coalesce(sum(downloads) FILTER (language = '{x}'), 0)::BIGINT AS \"{x}_downloads\", coalesce(sum(uses) FILTER (language = '{x}'), 0)::BIGINT AS \"{x}_uses\"" for x in "12345")
    + f" FROM {AUTHORS} GROUP BY 1"
)
def author_stats(spark: SparkSession, d: str) -> DataFrame:
    return authors.author_stats(author_facts(spark, d), list("12345"))


@query(f"SELECT email FROM {AUTHORS} GROUP BY 1 HAVING count(DISTINCT language) = (SELECT count(DISTINCT language) FROM {AUTHORS})")
def authors_in_all_managers(spark: SparkSession, d: str) -> DataFrame:
    return authors.in_all_languages(author_facts(spark, d))


@query(
    f"""WITH s AS (SELECT email, count(*) AS packages, sum(downloads)::BIGINT AS downloads, sum(uses)::BIGINT AS uses FROM {AUTHORS} GROUP BY 1)
    SELECT * FROM s WHERE email IN (SELECT email FROM (SELECT email FROM s ORDER BY packages DESC, email LIMIT 200)) OR email IN (SELECT email FROM (SELECT email FROM s ORDER BY downloads DESC, email LIMIT 200)) OR email IN (SELECT email FROM (SELECT email FROM s ORDER BY uses DESC, email LIMIT 200))"""
)
def top_authors_union(spark: SparkSession, d: str) -> DataFrame:
    return authors.top_union(authors.author_stats(author_facts(spark, d), []), "email", ["packages", "downloads", "uses"])


@query("SELECT c_nationkey AS author, count(DISTINCT c_custkey) AS n FROM customer GROUP BY 1 HAVING count(DISTINCT c_custkey) > 1")
def same_author(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("author"), F.col("c_custkey").alias("pkg"))
    return authors.same_author(c).select("author", F.size("packages").cast("long").alias("n"))


# Graphs


def tree_edges(spark: SparkSession, d: str) -> DataFrame:
    """Parts as packages that depend on the part of half their number."""
    return table(spark, d, "part").filter("p_partkey > 0").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst"))


def cyclic_edges(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("user_id")
    return table(spark, d, "events").select(u.alias("src"), ((u * u + 1) % 150).alias("dst")).distinct()


TREE = "WITH RECURSIVE c(src, dst) AS (SELECT p_partkey, p_partkey // 2 FROM part WHERE p_partkey > 0 UNION SELECT c.src, c.dst // 2 FROM c WHERE c.dst > 0)"
CYCLIC = "WITH RECURSIVE e AS (SELECT DISTINCT user_id AS src, (user_id * user_id + 1) % 150 AS dst FROM events), c(src, dst) AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src)"


@query(
    """WITH e AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem), a AS (SELECT src AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e)
    SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM a GROUP BY 1"""
)
def graph_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(table(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("dst")))


@query(f"{TREE}, n AS (SELECT p_partkey AS id FROM part UNION SELECT p_partkey // 2 FROM part) SELECT n.id, (n.id > 0)::BIGINT AS dep_count, count(c.dst) AS flatten_dep_count FROM n LEFT JOIN c ON c.src = n.id GROUP BY 1, 2")
def graph_descendants(spark: SparkSession, d: str) -> DataFrame:
    return graph.dependency_counts(tree_edges(spark, d))


@query(f"{TREE} SELECT p_partkey AS id, count(c.src) AS use_count FROM part LEFT JOIN c ON c.dst = p_partkey GROUP BY 1")
def graph_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return graph.use_counts(table(spark, d, "part").select(F.col("p_partkey").alias("id")), tree_edges(spark, d))


@query(f"{CYCLIC} SELECT src, dst FROM c")
def graph_closure_cyclic(spark: SparkSession, d: str) -> DataFrame:
    return graph.closure(cyclic_edges(spark, d))


@query(f"{CYCLIC}, k AS (SELECT dst AS id FROM c WHERE src IN (3, 5) UNION SELECT 3 UNION SELECT 5) SELECT src, dst FROM e WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)")
def graph_induced_subgraph(spark: SparkSession, d: str) -> DataFrame:
    return graph.induced(cyclic_edges(spark, d), spark.createDataFrame([(3,), (5,)], "id long"))


@query(f"{TREE}, n AS (SELECT p_partkey AS id FROM part UNION SELECT p_partkey // 2 FROM part) SELECT n.id, count(c.dst)::INTEGER AS level FROM n LEFT JOIN c ON c.src = n.id GROUP BY 1")
def graph_levels(spark: SparkSession, d: str) -> DataFrame:
    return graph.levels(tree_edges(spark, d))


@query(f"{CYCLIC}, r AS (SELECT a.src, a.dst FROM c a JOIN c b ON a.src = b.dst AND a.dst = b.src), s AS (SELECT src AS id, min(dst) AS component, count(*) AS n FROM r GROUP BY 1) SELECT id, component FROM s WHERE n > 1")
def strong_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.strong_components(cyclic_edges(spark, d))


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT user_id AS src, (user_id * user_id + 1) % 150 AS dst FROM events WHERE user_id <> (user_id * user_id + 1) % 150),
    c(src, dst) AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src),
    s AS (SELECT a.src AS id, min(a.dst) AS component FROM c a JOIN c b ON a.src = b.dst AND a.dst = b.src GROUP BY 1),
    g AS (SELECT dst AS id, count(*) AS n FROM e GROUP BY 1),
    worst AS (SELECT e.src, e.dst FROM e JOIN s a ON a.id = e.src JOIN s b ON b.id = e.dst AND a.component = b.component LEFT JOIN g x ON x.id = e.src LEFT JOIN g y ON y.id = e.dst
      QUALIFY row_number() OVER (PARTITION BY a.component ORDER BY coalesce(x.n, 0) + coalesce(y.n, 0) DESC, e.src DESC, e.dst DESC) = 1)
    SELECT src, dst FROM e EXCEPT SELECT src, dst FROM worst"""
)
def scc_break_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Scored by in-degree. Every node has one edge out, so each strong component is one cycle and loses one edge."""
    e = graph.without_loops(cyclic_edges(spark, d))
    return graph.break_cycles(e, graph.degrees(e).select("id", F.col("in_degree").alias("rank")))


PAGERANK_ROUNDS = 20


def _pagerank_sql(rounds: int) -> str:
    steps = [
        """e AS MATERIALIZED (SELECT DISTINCT user_id AS src, (user_id * user_id + 1) % 150 AS dst FROM events)""",
        """n AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e)""",
        """o AS MATERIALIZED (SELECT src, count(*) AS out FROM e GROUP BY 1)""",
        """r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM n) AS rank FROM n)""",
    ]
    for k in range(rounds):
        steps.append(
            f"""r{k + 1} AS MATERIALIZED (SELECT n.id, (0.15::DOUBLE + 0.85::DOUBLE * coalesce((SELECT sum(rank) FROM r{k} WHERE id NOT IN (SELECT src FROM o)), 0)) / (SELECT count(*) FROM n) + 0.85::DOUBLE * coalesce(got, 0) AS rank
            FROM n LEFT JOIN (SELECT e.dst AS id, sum(rank / out) AS got FROM e JOIN r{k} ON r{k}.id = e.src JOIN o ON o.src = e.src GROUP BY 1) g ON g.id = n.id)"""
        )
    return f"WITH {', '.join(steps)} SELECT id, round(rank, 10) AS rank FROM r{rounds}"


@query(_pagerank_sql(PAGERANK_ROUNDS))
def pagerank(spark: SparkSession, d: str) -> DataFrame:
    return graph.pagerank(cyclic_edges(spark, d), rounds=PAGERANK_ROUNDS).withColumn("rank", F.round("rank", 10))


@query(
    """WITH e AS (SELECT DISTINCT user_id AS src, event_type || json_extract_string(props, '$.k') AS dst FROM events), n AS (SELECT src, count(*) AS n FROM e GROUP BY 1)
    SELECT a.src AS a, b.src AS b, round(count(*)::DOUBLE / (x.n + y.n - count(*)), 9) AS jaccard FROM e a JOIN e b ON a.dst = b.dst AND a.src < b.src JOIN n x ON x.src = a.src JOIN n y ON y.src = b.src
    GROUP BY a.src, b.src, x.n, y.n HAVING count(*) >= 0.15 * (x.n + y.n - count(*))"""
)
def neighbour_similarity(spark: SparkSession, d: str) -> DataFrame:
    e = event_values(spark, d).select(F.col("pkg").alias("src"), F.concat("rule", "value").alias("dst"))
    return graph.neighbour_similarity(e, 0.15).withColumn("jaccard", F.round("jaccard", 9))


@query("WITH RECURSIVE e AS (SELECT DISTINCT user_id AS a, (user_id * user_id + 1) % 150 AS b FROM events), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), c(a, b) AS (SELECT a, b FROM u UNION SELECT c.a, u.b FROM c JOIN u ON c.b = u.a) SELECT a AS id, least(a, min(b)) AS label FROM c GROUP BY 1")
def component_labels(spark: SparkSession, d: str) -> DataFrame:
    return graph.component_labels(cyclic_edges(spark, d))


@query("SELECT p_partkey AS id FROM part WHERE p_partkey = 0")
def without_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return graph.without_dependencies(table(spark, d, "part").select(F.col("p_partkey").alias("id")), tree_edges(spark, d))


# Sources

def source_files(spark: SparkSession, d: str) -> DataFrame:
    """(k, pkg, version, language, path, content): a small file for every part, in five kinds, one of which does not parse."""
    k = F.col("p_partkey").cast("string")
    kinds = [
        ("python", "setup.py", "from base64 import b64decode as d\nimport os\nexec(d('{k}'))\nos.system('ls', {k})\n"),
        ("python", "bad.py", "def broken_{k}(:\n"),
        ("javascript", "index.js", "const cp = require('child_process');\nvar r = /eval(x)/.source;\ncp.exec(`ls ${eval({k})}`);\n// eval(no)\n"),
        ("ruby", "lib.rb", "eval(params)\nx = `ls {k}`\n"),
        ("php", "a.php", "<?php\n$o->run($x, {k});\nA::go(1);\n"),
    ]
    which = F.col("p_partkey") % len(kinds)

    def of(place: int) -> Column:
        out = F.lit(None).cast("string")
        for n, kind in enumerate(kinds):
            out = F.when(which == n, F.replace(F.lit(kind[place]), F.lit("{k}"), k) if place == 2 else F.lit(kind[place])).otherwise(out)
        return out

    return table(spark, d, "part").select(F.concat(F.lit("p"), k).alias("pkg"), F.lit("1.0").alias("version"), of(0).alias("language"), of(1).alias("path"), of(2).alias("content"))


@query(
    """WITH p AS (SELECT p_partkey, p_partkey::VARCHAR AS k FROM part),
    calls(kind, language, file, base_type, name, arguments, source, start_row, start_col, end_row, end_col) AS (VALUES
      (0, 'python', 'setup.py', NULL, 'exec', 'd(''{k}'')', 'exec(d(''{k}''))', 3, 0, 3, '{k}+11'), (0, 'python', 'setup.py', 'base64', 'b64decode', '''{k}''', 'd(''{k}'')', 3, 5, 3, '{k}+10'),
      (0, 'python', 'setup.py', 'os', 'system', '''ls''; {k}', 'os.system(''ls'', {k})', 4, 0, 4, '{k}+17'),
      (2, 'javascript', 'index.js', NULL, 'require', '''child_process''', 'require(''child_process'')', 1, 11, 1, '35'), (2, 'javascript', 'index.js', 'cp', 'exec', '`ls ${eval({k})}`', 'cp.exec(`ls ${eval({k})}`)', 3, 0, 3, '{k}+23'),
      (2, 'javascript', 'index.js', NULL, 'eval', '{k}', 'eval({k})', 3, 14, 3, '{k}+20'),
      (3, 'ruby', 'lib.rb', NULL, 'eval', 'params', 'eval(params)', 1, 0, 1, '12'), (3, 'ruby', 'lib.rb', NULL, 'builtin_xstring', 'ls {k}', '`ls {k}`', 2, 4, 2, '{k}+9'),
      (4, 'php', 'a.php', '$o', 'run', '$x; {k}', '$o->run($x, {k})', 2, 0, 2, '{k}+13'), (4, 'php', 'a.php', 'A', 'go', '1', 'A::go(1)', 3, 0, 3, '8'))
    SELECT 'p' || k AS pkg, language, file, base_type, name, coalesce(base_type || '.', '') || name AS full_name, replace(arguments, '{k}', k) AS arguments, replace(source, '{k}', k) AS source,
      start_row, start_col, end_row, CASE WHEN starts_with(end_col, '{k}+') THEN length(k) + substr(end_col, 5)::INT ELSE end_col::INT END::INTEGER AS end_col, FALSE AS failed
    FROM p JOIN calls ON p_partkey % 5 = kind
    UNION ALL SELECT 'p' || k, 'python', 'bad.py', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, TRUE FROM p WHERE p_partkey % 5 = 1"""
)
def source_api_calls(spark: SparkSession, d: str) -> DataFrame:
    got = extract.api_calls(source_files(spark, d)).withColumn("arguments", joined(F.col("arguments"), "; "))
    return got.select("pkg", "language", "file", "base_type", "name", "full_name", "arguments", "source", "start_row", "start_col", "end_row", "end_col", F.col("error").isNotNull().alias("failed"))


@query(
    """SELECT 'c' || c_custkey AS pkg, 'a.py|get:input()' AS source, 'b.py|<module>:run()' AS sink,
      'a.py|get:input() > a.py|get:x > get#return > b.py|<module>:get() > b.py|<module>:y > b.py|<module>:run()' AS hops
    FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE')"""
)
def taint_flows(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's package reads in one file and runs in another: some clean what they have read, some run what they
    have not read, some pass it where it does no harm; the files of one package name the functions of all."""
    segment = F.col("c_mktsegment")
    run = F.when(segment == "BUILDING", "run(clean(y))").when(segment == "MACHINERY", "run(z)").when(segment == "FURNITURE", "run(1, y)").otherwise("run(y)")
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("pkg"), F.concat(F.lit("from a import get\ny = get()\n"), run, F.lit("\n")).alias("b"))
    one = F.struct(F.lit("a.py").alias("path"), F.lit("def get():\n    x = input()\n    return x\n").alias("content"))
    files = c.select("pkg", F.explode(F.array(one, F.struct(F.lit("b.py").alias("path"), F.col("b").alias("content")))).alias("f")).select("pkg", "f.*")
    edges = flows.def_use_edges(files)
    names = lambda *x: spark.createDataFrame([(i,) for i in x], "name string")
    edges = cut(flows.only_at(edges, spark.createDataFrame([("run", 0)], "name string, parameter int")))
    found = flows.flows(edges, flows.calls(edges, names("input")), flows.calls(edges, names("run")), flows.calls(edges, names("clean")))
    return found.withColumn("hops", joined(F.col("hops"), " > "))


@query("SELECT 'SINK' AS functionality, p_brand AS full_name, min(p_type) AS sink_type FROM part GROUP BY 2")
def catalogue_from_table(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    wide = table(spark, d, "part").select(none.alias("Sources"), none.alias("SourceType"), F.concat(F.lit(" "), "p_brand", F.lit(":0")).alias("Sinks"), F.col("p_type").alias("SinkType"), none.alias("Dangers"), none.alias("DangerType"))
    return catalogue.from_sensitive_apis(wide).select("functionality", "full_name", "sink_type")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN TRUE ELSE FALSE END AS satisfied FROM events")
def formula_on_rows(spark: SparkSession, d: str) -> DataFrame:
    ids = F.when(F.col("event_type") == "click", F.array(F.lit(1), F.lit(4))).otherwise(F.array(F.lit(2)))
    return table(spark, d, "events").select("event_id", satisfied("(1 & 4) | () | (3 & 2)", ids).alias("satisfied"))


from hornbeam.plans import analysis, details  # noqa: E402, F401  these register more queries
