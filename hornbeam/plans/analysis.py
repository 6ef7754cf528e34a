"""Queries of the code and event analyses: matched calls, conditions of sinks, summaries by package, checks of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornbeam.functions.storage import cut
from hornbeam.operators import checks, extract, flows, paths
from hornbeam.plans.catalog import ORACLES, joined, query, source_files, table
from hornbeam.streaming import limits, traces

# Flows


@query(
    """WITH RECURSIVE o AS (SELECT o_custkey AS pkg, o_orderkey AS k, o_orderkey % 3 AS lvl, o_orderstatus AS st, o_orderpriority AS pr FROM orders),
    e AS (
      SELECT pkg, 'v' || k AS src, 'f' || (lvl + 1) AS dst, 'call' AS kind, k AS site FROM o
      UNION ALL SELECT pkg, 'f' || (lvl + 1) || 'r', 'r' || k, 'result', k FROM o
      UNION ALL SELECT pkg, 'f' || lvl, 'v' || k, 'inner', NULL FROM o WHERE lvl > 0 AND st <> 'P'
      UNION ALL SELECT pkg, 'r' || k, 'f' || lvl || 'r', 'inner', NULL FROM o WHERE lvl > 0 AND pr < '4'
      UNION ALL SELECT DISTINCT pkg, 'f3', 'f3r', 'inner', NULL FROM o),
    walk(pkg, source, node, stack) AS (
      SELECT pkg, 'v' || k, 'v' || k, []::BIGINT[] FROM o WHERE lvl = 0
      UNION
      SELECT w.pkg, source, e.dst, CASE kind WHEN 'call' THEN list_append(stack, site) WHEN 'result' THEN stack[:-2] ELSE stack END
      FROM walk w JOIN e ON w.pkg = e.pkg AND w.node = e.src AND (kind <> 'result' OR len(stack) = 0 OR stack[-1] = site))
    SELECT DISTINCT w.pkg, source, node AS sink FROM walk w JOIN o ON w.pkg = o.pkg AND node = 'r' || k WHERE lvl = 0"""
)
def matched_calls(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders as calls on three levels of functions: what is passed by one call comes back at that call only."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("pkg"), F.col("o_orderkey").alias("k"), (F.col("o_orderstatus") != "P").alias("entered"), (F.col("o_orderpriority") < "4").alias("left"))
    text = lambda *x: F.concat(*[F.lit(i) if isinstance(i, str) else i.cast("string") for i in x])
    k, lvl, none = F.col("k"), F.col("k") % 3, F.lit(None).cast("string")
    row = lambda src, dst=none, kind=none, site=none, role="edge": F.struct(src.alias("src"), dst.alias("dst"), kind.alias("kind"), site.cast("string").alias("site"), F.lit(role).alias("role"))
    call, result, inner = map(F.lit, ("call", "result", "inner"))
    made = [row(text("v", k), text("f", lvl + 1), call, k), row(text("f", lvl + 1, "r"), text("r", k), result, k), row(F.lit("f3"), F.lit("f3r"), inner)]
    made += [F.when((lvl > 0) & F.col("entered"), row(text("f", lvl), text("v", k), inner)), F.when((lvl > 0) & F.col("left"), row(text("r", k), text("f", lvl, "r"), inner))]
    made += [F.when(lvl == 0, row(text("v", k), role="source")), F.when(lvl == 0, row(text("r", k), role="sink"))]
    return paths.realizable_of(o, lambda df: df.select("pkg", F.inline(F.array(*made))).filter("role IS NOT NULL")).select("pkg", "source", "sink")


def customer_files(spark: SparkSession, d: str, which, variants: list[str], path: str) -> DataFrame:
    """(pkg, path, content): for every customer one of the variants."""
    content = F.element_at(F.array(*map(F.lit, variants)), which + 1)
    return table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("pkg"), F.lit(path).alias("path"), content.alias("content"))


@query(
    """WITH v(k, sink, hops) AS (VALUES
      (0, 'a.py|<module>:run()@7.0', 'a.py|<module>:input()@5.9 > a.py|<module>:same()@5.4 > a.py|<module>:a > a.py|<module>:run()@7.0'),
      (3, 'a.py|<module>:run()@9.0', 'a.py|<module>:input()@5.9 > a.py|<module>:same()@5.4 > a.py|<module>:a > a.py|<module>:deep()@9.4 > a.py|<module>:run()@9.0'),
      (4, 'a.py|out:run()@8.4', 'a.py|<module>:input()@5.9 > a.py|<module>:same()@5.4 > a.py|<module>:a > out#0 > a.py|out:y > a.py|out:run()@8.4'))
    SELECT 'c' || c_custkey AS pkg, 'a.py|<module>:input()@5.9' AS source, sink, hops FROM customer JOIN v ON c_custkey % 5 = k"""
)
def matched_call_flows(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's file calls one function with what is read and with a constant: only the value of the first call is
    tainted. One file passes it through a second function, one down into another, one into one that drops it."""
    head = "def same(x):\n    return x\ndef const(x):\n    return 1\na = same(input())\nb = same(2)\n"
    ends = ["run(a)\n", "run(b)\n", "run(const(a))\n", "def deep(z):\n    return same(z)\nrun(deep(a))\n", "def out(y):\n    run(y)\nout(a)\n"]
    e = flows.def_use_edges(customer_files(spark, d, (F.col("c_custkey") % 5).cast("int"), [head + x for x in ends], "a.py"), sites=True).transform(cut)
    names = lambda x: spark.createDataFrame([(x,)], "name string")
    return paths.realizable(e, flows.calls(e, names("input")), flows.calls(e, names("run"))).withColumn("hops", joined(F.col("hops"), " > "))


@query(
    """WITH v(k, sink, attack) AS (VALUES (0, 'query', 'sql'), (1, 'query', 'sql'), (3, 'query', 'sql'), (6, 'query', 'sql'), (7, 'show', 'xss'), (9, 'query', 'sql'), (11, 'query', 'sql'), (12, 'show', 'xss'))
    SELECT 'c' || c_custkey AS pkg, sink, 0::INTEGER AS place, attack FROM customer JOIN v ON c_custkey % 14 = k"""
)
def sink_conditions(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's script passes what it reads to a sink in one of fourteen ways; the conditions of the sinks, what was
    cleaned, quoted, cast, tested or taken out of an array say which do harm."""
    ways = [
        "$x = read(); query(\"select '\" . $x . \"'\");",  # 0 as it is: harm
        "$x = clean(read()); query(\"a = '\" . $x . \"'\");",  # 1 quoted, quotes left in: harm
        "$x = escape(read()); query(\"a = '\" . $x . \"'\");",  # 2 quoted, quotes cleaned
        '$x = escape(read()); query("a = " . $x);',  # 3 not quoted: harm
        '$x = read(); $y = (int) $x; query("a = " . $y);',  # 4 a number
        "$x = read(); if (is_ok($x)) { query($x); }",  # 5 tested
        "$x = read(); if (!is_ok($x)) { query($x); }",  # 6 tested the other way: harm
        "$a = read_all(); show($a);",  # 7 an array where arrays do harm
        "$a = read_all(); query($a);",  # 8 an array where they do not
        "$a = read_all(); query($a['k']);",  # 9 its element: harm
        "$x = wipe(read()); query($x);",  # 10 cleaned of everything
        "$x = read(); query(\"a = '$x'\");",  # 11 within a text: harm
        "$x = clean(read()); show($x);",  # 12 cleaned of another attack: harm
        "$x = read(); $l = [1, $x]; query($l);",  # 13 into an array
    ]
    e = flows.def_use_edges(customer_files(spark, d, (F.col("c_custkey") % len(ways)).cast("int"), ["<?php\n" + w + "\n" for w in ways], "a.php"), "php", sites=True)
    sources = spark.createDataFrame([("read", "variable"), ("read_all", "array")], "name string, kind string")
    sinks = spark.createDataFrame([("query", 0, "QUOTES", "sql"), ("show", 0, "array_tainted", "xss")], "name string, parameter int, condition string, attack string")
    cleaners = spark.createDataFrame([("clean", ["sql"]), ("escape", ["sql", "QUOTES"]), ("wipe", ["ALL"])], "name string, prevents array<string>")
    found = paths.conditional_flows(e, sources, sinks, cleaners, spark.createDataFrame([("is_ok",)], "name string"))
    return found.select("pkg", F.regexp_extract("sink", flows.CALLED, 1).alias("sink"), "place", "attack")


@query(
    """SELECT 'c' || c_custkey AS pkg, 'c.py|<module>:mid()' AS source, 'c.py|<module>:run()' AS sink FROM customer WHERE c_mktsegment <> 'BUILDING'
    UNION ALL SELECT 't' || c_custkey, 't.py|<module>:input()', 't.py|<module>:put()' FROM customer"""
)
def taint_tree(spark: SparkSession, d: str) -> DataFrame:
    """Seven packages for each customer: c needs b, which needs a, whose get() reads (or, in one segment, does not); d needs
    e, which has a get() that does not; t puts into s what it reads, and s runs it."""
    reads = F.when(F.col("c_mktsegment") == "BUILDING", "def get():\n    return 1\n").otherwise("def get():\n    return input()\n")
    code = {"a": reads, "b": F.lit("def mid():\n    return get()\n"), "c": F.lit("run(mid())\n"), "d": F.lit("run(get())\n"), "e": F.lit("def get():\n    return 1\n"), "s": F.lit("def put(x):\n    run(x)\n"), "t": F.lit("put(input())\n")}
    c = table(spark, d, "customer")
    of = lambda x: F.concat(F.lit(x), F.col("c_custkey").cast("string"))
    files = c.select(F.explode(F.array(*[F.struct(of(x).alias("pkg"), F.lit(f"{x}.py").alias("path"), text.alias("content")) for x, text in code.items()])).alias("f")).select("f.*")
    needs = c.select(F.explode(F.array(*[F.struct(of(x).alias("src"), of(y).alias("dst")) for x, y in ("ba", "cb", "de", "ts")])).alias("n")).select("n.*")
    names = lambda x: spark.createDataFrame([(x,)], "name string")
    return flows.taint_tree(needs, flows.def_use_edges(files).select("pkg", "src", "dst"), names("input"), names("run")).select("pkg", "source", "sink")


# Checks of calls


def ruby_files(spark: SparkSession, d: str, lines: list[str]) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    line = F.element_at(F.array(*map(F.lit, lines)), (F.col("p_partkey") % len(lines) + 1).cast("int"))
    return table(spark, d, "part").select(F.concat(F.lit("p"), k).alias("pkg"), F.lit("1.0").alias("version"), F.lit("ruby").alias("language"), F.lit("a.rb").alias("path"), F.replace(line, F.lit("{k}"), k).alias("content"))


@query(
    """WITH v(n, "check", method, source) AS (VALUES
      (0, 'execute', 'system', 'system("ls #{x}")'), (2, 'execute', 'builtin_xstring', '`cat #{f}{k}`'), (3, 'evaluation', 'eval', 'eval(params[:{k}])'), (4, 'deserialize', 'load', 'Marshal.load(x)'),
      (6, 'send', 'send', 'a.send(params[:m], {k})'), (8, 'file_access', 'open', 'File.open(params[:f])'), (9, 'redirect', 'redirect_to', 'redirect_to(params[:u])'), (10, 'sql', 'order', ').order("a #{x}")'),
      (12, 'weak_hash', 'hexdigest', 'Digest::MD5.hexdigest("{k}")'), (13, 'unsafe_reflection', 'constantize', ').constantize()'), (14, 'dynamic_finder', 'find_by_reset_token', 'User.find_by_reset_token(t)'),
      (15, 'render_inline', 'render', 'render(inline: "x{k}")'))
    SELECT 'p' || p_partkey AS pkg, "check", method, replace(source, '{k}', p_partkey::VARCHAR) AS source, 1::INTEGER AS start_row FROM part JOIN v ON p_partkey % 18 = n"""
)
def call_checks(spark: SparkSession, d: str) -> DataFrame:
    """A line of Ruby for every part, in eighteen kinds, of which twelve are what a check is about."""
    lines = [
        'system("ls #{x}")\n', 'system("ls #{x.shellescape}")\n', "`cat #{f}{k}`\n", "eval(params[:{k}])\n", "Marshal.load(x)\n", "JSON.load(x)\n", "a.send(params[:m], {k})\n", "a.send(:m, params[:{k}])\n", "File.open(params[:f])\n",
        "redirect_to(params[:u])\n", 'User.where(a: 1).order("a #{x}")\n', 'q.where(a: 1).order("a #{x}")\n', 'Digest::MD5.hexdigest("{k}")\n', "a.classify(x).constantize()\n", "User.find_by_reset_token(t)\n", 'render(inline: "x{k}")\n',
        "# eval(params)\n", "raw(params[:x]).strip()\n",
    ]
    found = checks.find(checks.index(extract.api_calls(ruby_files(spark, d, lines))), checks.ruby_checks(spark))
    return found.select("pkg", "check", "method", "source", "start_row")


# Events over time


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER w AS n, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    w(user_id, n, event_id, had) AS (
      SELECT user_id, n, event_id, 57600000000 FROM e WHERE n = 1
      UNION ALL SELECT e.user_id, e.n, e.event_id, least(57600000000, had - CASE WHEN had >= 28800000000 THEN 28800000000 ELSE 0 END + gap) FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
    SELECT event_id, had >= 28800000000 AS passed FROM w"""
)
def rate_limited_events(spark: SparkSession, d: str) -> DataFrame:
    """A user's events, of which one in eight hours passes, and two after a pause."""
    return limits.limited(table(spark, d, "events"), "user_id", 1, 8 * 3600, 2, span=5 * 86_400).select("event_id", "passed")


@query(
    """WITH g AS (SELECT user_id, ts, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w > 3600000000, TRUE) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
    SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) AS last, count(*) AS events, max(ts) < (SELECT max(ts) FROM events) - INTERVAL 3600 SECONDS AS quiet FROM s GROUP BY user_id, n"""
)
def rolled_traces(spark: SparkSession, d: str) -> DataFrame:
    """A user's events as traces: those that have been quiet for an hour are rolled, the others are active."""
    quiet, active = traces.rolled(table(spark, d, "events"), ["user_id"])
    both = quiet.withColumn("quiet", F.lit(True)).unionByName(active.withColumn("quiet", F.lit(False)))
    return both.select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start"), F.unix_micros(F.col("last").cast("timestamp")).alias("last"), "events", "quiet")


@query(
    """WITH l AS (SELECT l_orderkey || '-' || l_linenumber AS container, epoch_us(min(l_shipdate)) AS started, epoch_us(min(CASE WHEN l_returnflag <> 'N' THEN l_shipdate + to_hours(l_quantity::INT) END)) AS stopped FROM lineitem GROUP BY 1),
    n AS (SELECT greatest(max(started), max(stopped)) AS now FROM l)
    SELECT container, started, started + 86400000000 AS evicted FROM l, n WHERE started + 86400000000 < coalesce(stopped, now)"""
)
def overtime_containers(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders as containers: all start when they are shipped, some stop after as many hours as they have pieces."""
    li = table(spark, d, "lineitem").select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("container"), F.col("l_shipdate").alias("ts"), "l_returnflag", F.col("l_quantity").cast("int").alias("hours"))
    starts = li.select("container", F.lit("start").alias("event"), "ts")
    stops = li.filter("l_returnflag <> 'N'").select("container", F.lit("stop").alias("event"), (F.col("ts") + F.make_dt_interval(hours=F.col("hours"))).alias("ts"))
    found = traces.overtime(starts.unionByName(stops), 86_400)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(c)
    return found.select("container", micros("started"), micros("evicted"))


# Extractors in SQL


@query(ORACLES["source_api_calls"])
def lateral_api_calls(spark: SparkSession, d: str) -> DataFrame:
    """source_api_calls by the registered table function."""
    extract.register(spark)
    return spark.sql(
        """SELECT f.pkg, f.language, f.path AS file, c.base_type, c.name, c.full_name, array_join(c.arguments, '; ') AS arguments, c.source, c.start_row, c.start_col, c.end_row, c.end_col, c.error IS NOT NULL AS failed
        FROM {files} f, LATERAL api_calls_of(f.language, f.content) c""",
        files=source_files(spark, d),
    )
