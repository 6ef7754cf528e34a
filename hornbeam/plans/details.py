"""More queries of the catalogue: parsers, scalar functions and the smaller operators, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hornbeam.functions import names, syscalls
from hornbeam.functions.storage import shared_folder, sized
from hornbeam.operators import authors, catalogue, content, dispatch, extract, findings, flows, graph, ranking, rules, similarity, usage, versions
from hornbeam.plans.catalog import CYCLIC, TREE, USAGE, cyclic_edges, event_values, joined, line_count, part_usage, query, table, tree_edges
from hornbeam.sources import graphs, metadata, readers

# Parsers of text, on lines made from the tables


@query("SELECT DISTINCT lower(p_brand) AS name, p_size::VARCHAR AS version FROM part")
def requirement_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "part").select(F.concat("p_brand", F.lit("=="), F.col("p_size").cast("string")).alias("value"))
    return readers.requirements(lines.withColumn("value", F.regexp_replace("value", "^Brand#", "Brand-"))).withColumn("name", F.replace("name", F.lit("-"), F.lit("#"))).distinct()


@query("SELECT c_custkey AS k, 'pkg' || c_custkey AS name, c_nationkey || '.1' AS version FROM customer")
def gem_lines(spark: SparkSession, d: str) -> DataFrame:
    line = F.format_string("pkg%d (default: %d.1, 0.9)", "c_custkey", "c_nationkey")
    got = readers.gems(table(spark, d, "customer").select(line.alias("value")))
    return got.select(F.substring("name", 4, 20).cast("long").alias("k"), "name", "version")


@query("SELECT 'g' || l_suppkey || '/a' || l_partkey AS name, l_linenumber || '.0' AS version, l_linenumber AS depth, l_linenumber = 1 AS direct FROM lineitem")
def maven_tree_lines(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("[INFO] "), F.repeat(F.lit("|  "), F.col("l_linenumber") - 1), F.format_string("+- g%d:a%d:jar:%d.0:compile", "l_suppkey", "l_partkey", "l_linenumber"))
    return readers.maven_tree(table(spark, d, "lineitem").select(line.alias("value")))


@query("SELECT o_custkey AS pkg, 'dep' || o_orderkey AS name, o_orderstatus AS version, o_orderpriority = '1-URGENT' AS direct FROM orders")
def npm_locks(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("dep"), F.col("o_orderkey").cast("string"))
    entry = F.struct(name.alias("k"), F.struct(F.col("o_orderstatus").alias("version")).alias("v"))
    grouped = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("pkg")).agg(F.map_from_entries(F.collect_list(entry)).alias("dependencies"), F.collect_list(F.when(F.col("o_orderpriority") == "1-URGENT", name)).alias("declared"))
    return readers.locked_npm(grouped.select("pkg", F.to_json(F.struct("dependencies")).alias("lock"), "declared"))


@query("SELECT 'p' || o_custkey AS pkg, 'v' || o_orderkey AS version, o_orderdate AS ts FROM orders")
def npm_release_rows(spark: SparkSession, d: str) -> DataFrame:
    times = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("v"), F.col("o_orderkey").cast("string")), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))))
    docs = table(spark, d, "orders").groupBy(F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("pkg")).agg(times.alias("time"))
    return metadata.release_rows(metadata.normalize(docs.select("pkg", F.to_json(F.struct("time")).alias("value")), "javascript"))


@query("SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem")
def gem_dependency_edges(spark: SparkSession, d: str) -> DataFrame:
    one = F.struct(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("name"), F.lit(">= 0").alias("requirements"))
    docs = table(spark, d, "lineitem").groupBy(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("pkg")).agg(F.struct(F.collect_list(one).alias("runtime")).alias("dependencies"))
    return metadata.edges(metadata.normalize(docs.select("pkg", F.to_json(F.struct("dependencies")).alias("value")), "ruby"))


@query("SELECT s_suppkey AS k, lower(replace(s_name, '#', '-')) AS name FROM supplier")
def declared_names(spark: SparkSession, d: str) -> DataFrame:
    requirement = F.concat(F.replace("s_name", F.lit("#"), F.lit("-")), F.lit(" [extra] (>=1.0); python_version < '3'"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), readers.declared(requirement).alias("name"))


@query("SELECT conv_id, turn, string_split(text, ' ')[1] AS first, len(string_split(text, ' ')) AS parts FROM conversations WHERE NOT regexp_matches(text, '(?i)the|password')")
def without_noise_lines(spark: SparkSession, d: str) -> DataFrame:
    kept = content.without_noise(table(spark, d, "conversations"), ["(?i)the", "(?i)password"], "text")
    return kept.select("conv_id", "turn", F.split("text", " ")[0].alias("first"), F.size(F.split("text", " ")).cast("long").alias("parts"))


@query("SELECT DISTINCT regexp_replace(list_extract(string_split(regexp_replace(link, '/+$', ''), '/'), -1), '\\?.*$', '') AS name FROM (SELECT unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS link FROM pages) WHERE NOT starts_with(link, '..') AND regexp_replace(list_extract(string_split(regexp_replace(link, '/+$', ''), '/'), -1), '\\?.*$', '') <> ''")
def index_page_names(spark: SparkSession, d: str) -> DataFrame:
    return readers.index_links(table(spark, d, "pages"))


# Scalar functions


#: Every listed call with what it is expected to be, written out apart from the lists that the operator reads.
EXPECTED = {
    "file": """
        _llseek access chdir chmod chown chown32 chroot close creat create_module dup dup2 dup3 epoll_create epoll_create1 epoll_ctl epoll_pwait
        epoll_wait faccessat fadvise64 fadvise64_64 fallocate fanotify_init fanotify_mark fchdir fchmod fchmodat fchown fchown32 fchownat fcntl
        fcntl64 fdatasync fgetxattr flistxattr flock fremovexattr fsetxattr fstat fstat64 fstatat fstatat64 fstatfs fstatfs64 fsync ftruncate
        ftruncate64 futimesat getcwd getdents getdents64 getrandom getxattr inotify_add_watch inotify_init inotify_init1 inotify_rm_watch ioctl
        io_cancel io_destroy io_getevents io_setup io_submit lchown lchown32 lgetxattr link linkat listxattr llistxattr lookup_dcookie lremovexattr
        lseek lsetxattr lstat lstat64 memfd_create mkdir mkdirat mknod mknodat msync name_to_handle_at open openat open_by_handle_at poll ppoll pread
        pread64 preadv preadv2 pselect6 pwrite pwrite64 pwritev pwritev2 read readahead readdir readlink readlinkat readv removexattr rename renameat
        renameat2 rmdir select sendfile sendfile64 setxattr stat stat64 statfs statfs64 statx symlink symlinkat sync syncfs sync_file_range
        sync_file_range2 truncate truncate64 umask unlink unlinkat utime utimensat utimes write writev
    """,
    "network": """
        accept accept4 bind bpf connect getpeername getsockname getsockopt listen recv recvfrom recvmmsg recvmsg send sendmmsg sendmsg sendto
        setdomainname sethostname setsockopt shutdown socket socketcall socketpair
    """,
    "process": """
        arch_prctl brk capget capset clone execve execveat exit exit_group fork getegid getegid32 geteuid geteuid32 getgid getgid32 getgroups
        getgroups32 getpgid getpgrp getpid getppid getpriority getresgid getresgid32 getresuid getresuid32 getrlimit getrusage getsid gettid getuid
        getuid32 get_thread_area ioprio_get ioprio_set kcmp madvise membarrier mincore mlock mlock2 mlockall mmap mmap2 modify_ldt mprotect mremap
        munlock munlockall munmap nice prctl prlimit prlimit64 process_vm_readv process_vm_writev ptrace sched_getaffinity sched_getattr
        sched_getparam sched_getscheduler sched_get_priority_max sched_get_priority_min sched_rr_get_interval sched_setaffinity sched_setattr
        sched_setparam sched_setscheduler sched_yield seccomp setfsgid setfsgid32 setfsuid setfsuid32 setgid setgid32 setgroups setgroups32 setns
        setpgid setpriority setregid setregid32 setresgid setresgid32 setresuid setresuid32 setreuid setreuid32 setrlimit setsid setuid setuid32
        set_thread_area set_tid_address unshare uselib vfork wait4 waitid
    """,
    "time": """
        adjtimex alarm clock_adjtime clock_getres clock_gettime clock_nanosleep clock_settime getitimer gettimeofday nanosleep setitimer settimeofday
        time timerfd_create timerfd_gettime timerfd_settime timer_create timer_delete timer_getoverrun timer_gettime timer_settime times
    """,
    "signal": """
        eventfd eventfd2 kill pause restart_syscall rt_sigaction rt_sigpending rt_sigprocmask rt_sigqueueinfo rt_sigreturn rt_sigsuspend
        rt_sigtimedwait rt_tgsigqueueinfo sigaction sigaltstack signal signalfd signalfd4 sigpending sigprocmask sigreturn sigsuspend tgkill tkill
    """,
    "ipc": """
        futex get_robust_list ipc mq_getsetattr mq_notify mq_open mq_timedreceive mq_timedsend mq_unlink msgctl msgget msgrcv msgsnd pipe pipe2 semctl
        semget semop semtimedop set_robust_list shmat shmctl shmdt shmget splice tee vmsplice
    """,
    "key_management": """
        add_key keyctl request_key
    """,
}
#: All of them, and three that no list has.
CALLS = [(call, kind) for kind, calls in EXPECTED.items() for call in calls.split()] + [("unknown_call", None), ("sched_nonsense", None), ("mmap64", None)]


@query(
    "WITH c(k, call, category) AS (VALUES "
    + ", ".join(f"({k}, '{call}', {kind and repr(kind) or 'NULL'})" for k, (call, kind) in enumerate(CALLS))
    + f") SELECT event_id, call, category FROM events JOIN c ON event_id % {len(CALLS)} = k"
)
def syscall_categories(spark: SparkSession, d: str) -> DataFrame:
    call = F.element_at(F.array(*[F.lit(c) for c, _ in CALLS]), (F.col("event_id") % len(CALLS) + 1).cast("int"))
    return table(spark, d, "events").select("event_id", call.alias("call")).withColumn("category", syscalls.category(F.col("call")))


@query(
    """WITH o AS (SELECT event_id, user_id % 224 AS a, event_id % 256 AS b FROM events)
    SELECT event_id, '1.' || b || '.7.' || a AS reversed, a = 10 OR (a = 172 AND b BETWEEN 16 AND 31) AS local,
      (a::BIGINT * 16777216 + 7 * 65536 + b * 256 + 1)::BIGINT AS number FROM o"""
)
def ip_addresses(spark: SparkSession, d: str) -> DataFrame:
    a, b = (F.col("user_id") % 224).cast("string"), (F.col("event_id") % 256).cast("string")
    ip, other = F.concat_ws(".", a, F.lit("7"), b, F.lit("1")), F.concat_ws(".", a, b, F.lit("7"), F.lit("1"))
    local = rules.Rules({"nets": ["10.0.0.0/8", "172.16.0.0/12"]}).column("ip in (nets)")
    rows = table(spark, d, "events").withColumn("ip", other).withColumn("local", local)
    return rows.select("event_id", names.reversed_octets(ip).alias("reversed"), "local", names.ipv4_number(ip).alias("number"))


@query("SELECT c_custkey, substr(md5(c_name), 1, 16) AS prefix, lower(c_mktsegment) IN ('building', 'machinery') AS chosen, list_extract(string_split(c_name, '#'), -1) AS base FROM customer")
def digests(spark: SparkSession, d: str) -> DataFrame:
    yes = names.is_yes(F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "Yes").otherwise("no"))
    return table(spark, d, "customer").select("c_custkey", names.md5_prefix(F.col("c_name")).alias("prefix"), yes.alias("chosen"), names.base_name(F.replace("c_name", F.lit("#"), F.lit("/"))).alias("base"))


@query("SELECT o_orderkey, [1, o_orderkey % 100, o_orderkey // 100][3] AS last, 'v1.' || (o_orderkey % 100) || '.' || (o_orderkey // 100) AS version FROM orders")
def version_numbers(spark: SparkSession, d: str) -> DataFrame:
    v = F.concat(F.lit("v1."), (F.col("o_orderkey") % 100).cast("string"), F.lit("."), F.expr("o_orderkey div 100").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", F.element_at(names.version_array(v), -1).cast("long").alias("last"), v.alias("version"))


# Versions and content


@query("SELECT o_custkey AS pkg, o_orderpriority AS version, max(o_orderdate) AS ts FROM orders GROUP BY 1, 2")
def version_latest_times(spark: SparkSession, d: str) -> DataFrame:
    return versions.latest_times(table(spark, d, "orders").select(F.col("o_custkey").alias("pkg"), F.col("o_orderpriority").alias("version"), F.col("o_orderdate").alias("ts")))


@query("SELECT o_custkey AS pkg, arg_max('r' || o_orderkey, (CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END, o_orderkey)) AS version FROM orders GROUP BY 1")
def version_latest_stable(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    normalized = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("dev."), key)).otherwise(key)
    return versions.latest_stable(table(spark, d, "orders").select(F.col("o_custkey").alias("pkg"), F.concat(F.lit("r"), key).alias("version"), normalized.alias("normalized")))


@query(
    """WITH i AS (SELECT o_custkey AS pkg, l_orderkey AS version, p_brand AS key, p_type AS source, l_returnflag AS file FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
    t AS (SELECT pkg, count(DISTINCT version) AS v FROM i GROUP BY 1), h AS (SELECT pkg, key, count(DISTINCT version) AS m FROM i GROUP BY 1, 2)
    SELECT i.pkg, i.version, i.key, count(*) AS calls FROM i JOIN t ON i.pkg = t.pkg JOIN h ON i.pkg = h.pkg AND i.key = h.key WHERE m <> v AND file <> 'N' GROUP BY 1, 2, 3"""
)
def version_api_details(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("full_name"), F.col("p_type").alias("source"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("version"), F.col("o_custkey").alias("pkg"), F.col("o_orderdate").alias("ts"))
    n, lines = line_count(spark, d), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("version"), "l_partkey", F.col("l_returnflag").alias("file")).join(part, "l_partkey")
    calls = sized(lines, n, "version").join(orders, "version")
    differences = versions.compare(calls.select("pkg", "version", F.col("full_name").alias("key")), rows=n)
    return versions.correlate(differences, calls, orders, blocked=["N"], rows=n).select("pkg", "version", "key", F.size("calls").cast("long").alias("calls"))


@query(
    """WITH a AS (SELECT p_brand AS key, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT p_brand AS key, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A' GROUP BY 1)
    SELECT coalesce(a.key, b.key) AS key, coalesce(a.n, 0) AS left_n, coalesce(b.n, 0) AS right_n FROM a FULL JOIN b ON a.key = b.key WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)"""
)
def api_count_differences(spark: SparkSession, d: str) -> DataFrame:
    side = lambda flag: part_usage(spark, d).filter(F.col("file") == flag).groupBy(F.col("full_name").alias("key")).agg(F.count("*").alias("n"))
    return content.api_differences(side("R"), side("A"))


@query("SELECT o_custkey AS pkg, o_orderstatus AS version, coalesce(max(o_orderkey) FILTER (o_orderpriority = '1-URGENT'), max(o_orderkey) FILTER (o_orderpriority = '2-HIGH')) AS hash FROM orders GROUP BY 1, 2 HAVING coalesce(max(o_orderkey) FILTER (o_orderpriority = '1-URGENT'), max(o_orderkey) FILTER (o_orderpriority = '2-HIGH')) IS NOT NULL")
def version_hashes(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "orders").select(F.col("o_custkey").alias("pkg"), F.col("o_orderstatus").alias("version"), F.col("o_orderpriority").alias("extension"), F.col("o_orderkey").alias("hash"))
    return content.version_hash(f, ("1-URGENT", "2-HIGH"))


# Graphs, selection and catalogues


@query("SELECT DISTINCT CASE WHEN n_name = 'FRANCE' THEN NULL ELSE r_name END AS src, n_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name <> 'FRANCE' UNION ALL SELECT 'ROOT', n_name FROM nation")
def graph_with_root(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    e = n.select(F.col("r_name").alias("src"), F.col("n_name").alias("dst"), F.when(F.col("n_name") == "FRANCE", "https://x/y").otherwise("1.0").alias("dst_version"))
    return graph.with_root(graph.plain_versions(e), n.select(F.col("n_name").alias("id")))


@query("SELECT DISTINCT c_mktsegment || '@x.org' AS email, 's' || c_nationkey || ':' || c_name AS pkg FROM customer")
def author_package_edges(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "customer").select(F.concat(F.lit("s"), F.col("c_nationkey").cast("string")).alias("source"), F.col("c_name").alias("name"), F.array(F.concat("c_mktsegment", F.lit("@x.org")), F.concat("c_mktsegment", F.lit("@x.org"))).alias("emails"))
    return authors.author_edges(p)


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b, levenshtein(a.s_name, b.s_name)::INTEGER AS distance FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE a.s_suppkey <> b.s_suppkey AND levenshtein(a.s_name, b.s_name) <= 2")
def distance_matrix_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return ranking.near_pairs(similarity.near_in_groups(s, "s_nationkey", "s_suppkey", "s_name", 2), 2)


@query("SELECT s_suppkey AS class1, n_name AS class2, l_returnflag AS relation, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3")
def class_relation_counts(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return flows.relation_counts(r.select(F.col("s_suppkey").alias("class1"), F.col("n_name").alias("class2"), F.col("l_returnflag").alias("relation")))


@query(
    """WITH b AS (SELECT o_custkey AS method, o_orderkey AS seq, o_orderkey % 3 AS od, o_orderkey % 5 AS ld, o_orderkey % 7 + 1 AS w, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt FROM orders),
    e AS (SELECT a.method, a.w AS wa, b.w AS wb, a.seq AS sa, b.seq AS sb, a.od AS oa, b.od AS ob, a.ld AS la, b.ld AS lb FROM b a JOIN b ON a.nxt = b.seq AND a.method = b.method)
    SELECT method, round(sum(wa * sa + wb * sb)::DOUBLE / sum(wa + wb), 6) AS x, round(sum(wa * oa + wb * ob)::DOUBLE / sum(wa + wb), 6) AS y, round(sum(wa * la + wb * lb)::DOUBLE / sum(wa + wb), 6) AS z, sum(wa + wb)::BIGINT AS w FROM e GROUP BY 1"""
)
def method_centroids(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    k = F.col("o_orderkey")
    o = table(spark, d, "orders").withColumn("next", F.lead(k).over(Window.partitionBy("o_custkey").orderBy(k)))
    blocks = o.select(F.col("o_custkey").alias("method"), k.alias("seq"), (k % 3).alias("out_degree"), (k % 5).alias("loop_depth"), (k % 7 + 1).alias("stmt_count"))
    got = flows.centroids(blocks, o.filter("next IS NOT NULL").select(F.col("o_custkey").alias("method"), k.alias("src"), F.col("next").alias("dst")))
    return got.select("method", *[F.round(c, 6).alias(c) for c in "xyz"], "w")


@query("SELECT user_id AS pkg, event_type AS base, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2")
def known_api_calls(spark: SparkSession, d: str) -> DataFrame:
    calls = event_values(spark, d).select("pkg", F.concat("rule", F.lit("::run")).alias("full_name"), F.col("rule").alias("base"))
    known = spark.createDataFrame([("click.run",), ("view->run",)], "full_name string")
    return extract.known_calls(calls, known).groupBy("pkg", "base").agg(F.count("*").alias("n"))


@query("SELECT p_brand AS full_name, 'SINK' AS functionality FROM part GROUP BY 1 UNION ALL SELECT 'new.' || p_type, 'SOURCE' FROM part GROUP BY p_type")
def catalogue_extension(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    p = table(spark, d, "part")
    wide = p.select(none.alias("Sources"), none.alias("SourceType"), F.col("p_brand").alias("Sinks"), F.col("p_type").alias("SinkType"), none.alias("Dangers"), none.alias("DangerType"))
    summaries = p.select(F.concat(F.lit("new."), F.col("p_type")).alias("full_name"), F.lit("SOURCE").alias("functionality"), F.lit("T").alias("type")).union(p.select("p_brand", F.lit("SINK"), F.lit("T")))
    return catalogue.extended(catalogue.from_sensitive_apis(wide), summaries).select("full_name", "functionality")


@query("SELECT c_custkey AS pkg, bool_or(coalesce(o_orderpriority = '1-URGENT', FALSE)) AS used FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def formula_by_function(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("pkg"), F.concat(F.lit("x."), F.col("o_orderpriority")).alias("full_name"))
    known = spark.createDataFrame([(1, "y.1-URGENT"), (2, "z.1-URGENT"), (3, "nothing")], "id int, full_name string")
    packages = table(spark, d, "customer").select(F.col("c_custkey").alias("pkg"))
    return usage.formula_verdicts(packages, o, known, "(1 & 2) | 3", func_only=True).select("pkg", F.col("satisfied").alias("used"))


DRAW = "('0x' || substr(md5({} || '|0'), 1, 13))::BIGINT"


@query(f"SELECT c_custkey, ({DRAW.format('c_custkey')} % 20)::INTEGER AS slice FROM customer")
def package_slices(spark: SparkSession, d: str) -> DataFrame:
    return ranking.slices(table(spark, d, "customer").select("c_custkey"), "c_custkey", 20)


@query(f"SELECT c_custkey FROM customer ORDER BY {DRAW.format('c_custkey')}, c_custkey LIMIT 100")
def package_sample(spark: SparkSession, d: str) -> DataFrame:
    return ranking.sample_packages(table(spark, d, "customer").select("c_custkey"), "c_custkey", 100)


@query(f"SELECT c_custkey, (ntile(20) OVER (ORDER BY {DRAW.format('c_custkey')}, c_custkey) - 1)::INTEGER AS slice FROM customer")
def package_even_slices(spark: SparkSession, d: str) -> DataFrame:
    return ranking.even_slices(table(spark, d, "customer").select("c_custkey"), "c_custkey", 20)


@query(
    f"""{TREE}, n AS (SELECT p_partkey AS id FROM part UNION SELECT p_partkey // 2 FROM part), s AS (SELECT id, ({DRAW.format('id')} % 8)::INTEGER AS slice FROM n),
    k AS (SELECT slice, dst AS id FROM c JOIN s ON c.src = s.id UNION SELECT slice, id FROM s)
    SELECT a.slice, p_partkey AS src, p_partkey // 2 AS dst FROM part JOIN k a ON a.id = p_partkey JOIN k b ON b.id = p_partkey // 2 AND a.slice = b.slice WHERE p_partkey > 0"""
)
def graph_split(spark: SparkSession, d: str) -> DataFrame:
    return graph.split(tree_edges(spark, d), 8)


@query(
    """WITH b AS (SELECT o_custkey || '-' || year(o_orderdate) AS function, o_orderkey AS block, lead(o_orderkey) OVER (PARTITION BY o_custkey, year(o_orderdate), o_orderpriority ORDER BY o_orderkey) AS next FROM orders)
    SELECT i.function, j.block, i.block::VARCHAR AS definition FROM b i JOIN b j ON i.function = j.function AND j.block > i.block AND (i.next IS NULL OR j.block <= i.next)"""
)
def reaching_definitions(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders of a year as blocks in a row: each defines the variable its priority names and kills the
    other definitions of it."""
    function = F.concat_ws("-", F.col("o_custkey").cast("string"), F.year("o_orderdate").cast("string"))
    o = table(spark, d, "orders").select(function.alias("function"), F.col("o_orderkey").alias("block"), F.col("o_orderkey").cast("string").alias("definition"), "o_orderpriority")
    every = F.collect_set("definition").over(Window.partitionBy("function", "o_orderpriority"))
    own = F.array("definition")
    blocks = o.select("function", "block", own.alias("generates"), F.array_except(every, own).alias("kills"))
    edges = o.select("function", F.col("block").alias("src"), F.lead("block").over(Window.partitionBy("function").orderBy("block")).alias("dst")).filter("dst IS NOT NULL")
    return flows.reaching_definitions(blocks, edges)


@query(
    """SELECT user_id::INTEGER AS pid, event_id + 0.5::DOUBLE AS ts, 'openat' AS syscall, 'AT_FDCWD|"/tmp/a,' || event_id || '"|O_RDONLY' AS args, '3' AS return, 'file' AS category FROM events WHERE event_type = 'click'
    UNION ALL SELECT NULL, event_id + 0.5, 'connect', '3|{sa_family=AF_INET, sin_port=htons(' || event_id || ')}|16', '0', 'network' FROM events WHERE event_type = 'view'
    UNION ALL SELECT user_id, NULL, 'execve', '''a,b ' || event_id || '''|["x\\"", "y"]...', '-1', 'process' FROM events WHERE event_type = 'purchase'
    UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL FROM events WHERE event_type NOT IN ('click', 'view', 'purchase')"""
)
def trace_lines(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    line = (
        F.when(kind == "click", F.format_string('%d %d.5 openat(AT_FDCWD, "/tmp/a,%d", O_RDONLY) = 3', "user_id", "event_id", "event_id"))
        .when(kind == "view", F.format_string("%d.5 connect(3, {sa_family=AF_INET, sin_port=htons(%d)}, 16) = 0", "event_id", "event_id"))
        .when(kind == "purchase", F.format_string("""[pid %d] execve('a,b %d', ["x\\"", "y"]...) = -1 ENOENT (none)""", "user_id", "event_id"))
        .otherwise("--- SIGCHLD ---")
    )
    return syscalls.parse_trace(table(spark, d, "events").select(line.alias("value"))).withColumn("args", joined(F.col("args"), "|"))


# Results by type, keys, records


@query(
    f"""SELECT full_name AS key, count(DISTINCT pkg) AS packages FROM {USAGE} GROUP BY 1 UNION ALL SELECT 'analyzed', count(DISTINCT pkg) FROM {USAGE}"""
)
def statistics_by_type(spark: SparkSession, d: str) -> DataFrame:
    return dispatch.statistics("api", part_usage(spark, d))


@query(
    """SELECT flow AS key, count(DISTINCT o_custkey) AS packages FROM (SELECT o_custkey, 'read_' || lower(o_orderstatus) || '() -> run_' || substr(o_orderpriority, 1, 1) || '()' AS flow FROM orders) GROUP BY 1
    UNION ALL SELECT 'analyzed', count(DISTINCT o_custkey) FROM orders"""
)
def flow_packages(spark: SparkSession, d: str) -> DataFrame:
    source = F.concat(F.col("o_orderkey").cast("string"), F.lit(".py|main:read_"), F.lower("o_orderstatus"), F.lit("()"))
    sink = F.concat(F.lit("x.py|main:run_"), F.substring("o_orderpriority", 1, 1), F.lit("()"))
    return dispatch.statistics("taint", table(spark, d, "orders").select(F.col("o_custkey").alias("pkg"), source.alias("source"), sink.alias("sink")))


@query(
    """WITH r AS (SELECT DISTINCT l_returnflag AS source, o_custkey AS pkg, o_orderpriority AS version FROM lineitem JOIN orders ON l_orderkey = o_orderkey), n AS (SELECT pkg, count(DISTINCT source) AS n FROM r GROUP BY 1)
    SELECT pkg, version FROM r JOIN n USING (pkg) WHERE n > 1 GROUP BY pkg, version, n HAVING count(*) = n"""
)
def common_versions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("pkg"), F.col("o_orderpriority").alias("version"))
    return content.common_versions(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("source"), "l_orderkey").join(o, "l_orderkey"))


@query(
    """WITH k(kind, suffix, versioned) AS (VALUES ('trace', 'strace', TRUE), ('trace_dep', 'dep.strace', TRUE), ('metadata', 'metadata.json', TRUE), ('versions', 'versions.json', FALSE), ('version2hash', 'version2hash.json', FALSE),
      ('dep', 'dep.json', TRUE), ('flatten_dep', 'flatten_dep.json', TRUE), ('astgen', 'astgen.txt', TRUE), ('compare_versions', 'compare_versions.json', FALSE), ('astfilter', 'astfilter.txt', TRUE),
      ('taint', 'taint.txt', TRUE), ('danger', 'danger.txt', TRUE), ('static', 'static.txt', TRUE), ('dynamic', 'dynamic.txt', TRUE), ('concolic', 'dynamic.txt', TRUE), ('result', 'result.txt', TRUE))
    SELECT s_suppkey, kind, 'x..' || replace(s_name, '#', '..') || CASE WHEN versioned THEN ':' || CASE s_nationkey % 2 WHEN 0 THEN 'latest' ELSE s_nationkey || '.0' END || CASE WHEN s_suppkey % 3 = 0 THEN ':sudo' ELSE '' END ELSE '' END || '.' || suffix AS file
    FROM supplier, k"""
)
def result_file_names(spark: SparkSession, d: str) -> DataFrame:
    s, n = table(spark, d, "supplier"), F.col("s_nationkey")
    keys = names.result_keys(F.concat(F.lit("x/"), F.col("s_name")), F.when(n % 2 != 0, F.concat(n.cast("string"), F.lit(".0"))), F.col("s_suppkey") % 3 == 0)
    return s.select("s_suppkey", F.explode(keys).alias("kind", "file"))


@query(
    f"""{TREE} SELECT 'found' AS kind, c.dst AS id, c.src AS dependent FROM c WHERE c.dst IN (3, 5) AND c.dst IN (SELECT p_partkey FROM part)
    UNION ALL SELECT 'unknown', x, NULL FROM (VALUES (3), (5), (-7)) t(x) WHERE x NOT IN (SELECT p_partkey FROM part UNION SELECT p_partkey // 2 FROM part)"""
)
def high_impact_packages(spark: SparkSession, d: str) -> DataFrame:
    found, unknown = graph.high_impact(spark.createDataFrame([(3,), (5,), (-7,)], "id long"), tree_edges(spark, d))
    return found.select(F.lit("found").alias("kind"), "id", "dependent").unionByName(unknown.select(F.lit("unknown").alias("kind"), "id", F.lit(None).cast("long").alias("dependent")))


@query(
    f"""{CYCLIC}, n AS (SELECT src AS id FROM e UNION SELECT dst FROM e), r AS (SELECT a.src AS id, a.dst AS other FROM c a JOIN c b ON a.src = b.dst AND a.dst = b.src UNION SELECT id, id FROM n),
    s AS (SELECT id, min(other) AS component FROM r GROUP BY 1), l AS (SELECT DISTINCT a.component FROM e JOIN s a ON a.id = e.src JOIN s b ON b.id = e.dst WHERE a.component <> b.component)
    SELECT id, component, count(*) OVER (PARTITION BY component) AS size FROM s WHERE component NOT IN (SELECT component FROM l)"""
)
def graph_attractors(spark: SparkSession, d: str) -> DataFrame:
    return graph.attractors(cyclic_edges(spark, d))


@query(
    """WITH m AS (SELECT DISTINCT o_custkey AS pkg, list_sort(list(DISTINCT 'd' || o_orderstatus) OVER (PARTITION BY o_custkey)) AS declared FROM orders WHERE o_custkey % 3 <> 0),
    d AS (SELECT o_custkey AS pkg, list_sort(list(DISTINCT 'p' || o_orderpriority)) AS requires FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1)
    SELECT coalesce(m.pkg, d.pkg)::VARCHAR AS pkg, array_to_string(coalesce(requires, declared), ',') AS requires, CASE WHEN m.pkg IS NULL THEN 'dependencies' WHEN d.pkg IS NULL THEN 'metadata' ELSE 'both' END AS known
    FROM m FULL JOIN d ON m.pkg = d.pkg"""
)
def package_records(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    declared = F.map_from_entries(F.collect_set(F.struct(F.concat(F.lit("d"), F.col("o_orderstatus")), F.lit("*"))))
    docs = o.filter("o_custkey % 3 <> 0").groupBy(F.col("o_custkey").cast("string").alias("pkg")).agg(F.to_json(F.struct(declared.alias("dependencies"))).alias("value"))
    resolved = o.filter("o_custkey % 2 = 0").select(F.col("o_custkey").cast("string").alias("src"), F.concat(F.lit("p"), F.col("o_orderpriority")).alias("dst"))
    return metadata.package_records(metadata.normalize(docs, "javascript"), resolved).select("pkg", joined(F.col("requires")).alias("requires"), "known")


@query("SELECT DISTINCT c_custkey AS k, c_name || '''s \"' || c_mktsegment || '\"' AS email, c_nationkey AS n FROM customer")
def literal_cells(spark: SparkSession, d: str) -> DataFrame:
    """Nested cells as scripts print them, with both kinds of quotes."""
    cell = F.format_string("""{u'owners': [{'email': '%s\\'s "%s"', 'n': %d}, {"email": None, 'n': True}]}""", "c_name", "c_mktsegment", "c_nationkey")
    owners = F.from_json(names.literal_json(cell), "struct<owners:array<struct<email:string,n:string>>>")["owners"]
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), owners[0]["email"].alias("email"), owners[0]["n"].cast("int").alias("n")).distinct()


@query("SELECT c_custkey AS k, lower(replace(c_name, '#', '-')) AS name, c_nationkey || '.1' AS version, 'six,' || lower(c_mktsegment) AS requires FROM customer")
def shown_packages(spark: SparkSession, d: str) -> DataFrame:
    text = F.format_string("Name: %s\nVersion: %d.1\nSummary: Version: 9\nRequires: six, %s\nk: %d", F.replace("c_name", F.lit("#"), F.lit("-")), "c_nationkey", "c_mktsegment", "c_custkey")
    got = readers.shown(table(spark, d, "customer").select(text.alias("value")))
    return got.select(F.regexp_extract("name", r"(\d+)$", 1).cast("long").alias("k"), "name", "version", joined(F.col("requires")).alias("requires"))


@query("SELECT DISTINCT 'n' || l_partkey AS name FROM lineitem")
def listed_names(spark: SparkSession, d: str) -> DataFrame:
    names_ = F.array_sort(F.collect_set(F.concat(F.lit("n"), F.col("l_partkey").cast("string"))))
    docs = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.to_json(F.struct(names_.alias("packageNames"))).alias("value"))
    return readers.listed_names(docs, "packagist")


@query(
    """WITH a AS (SELECT event_id, [(event_id * 7919) % 256, (event_id * 31) % 256, user_id % 256, 1] AS o FROM events), n AS (SELECT event_id, o[1] AS a, o[2] AS b, o[3] AS c FROM a)
    SELECT event_id, a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 192 AND b = 88 AND c = 99)
      OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113) AS private FROM n"""
)
def private_addresses(spark: SparkSession, d: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    ip = F.concat_ws(".", ((e * 7919) % 256).cast("string"), ((e * 31) % 256).cast("string"), (u % 256).cast("string"), F.lit("1"))
    return table(spark, d, "events").select("event_id", names.is_private_ip(ip).alias("private"))


# Other engines


@query(
    """SELECT c_custkey AS k, 'read_' || c_nationkey AS source, 'a.php' AS source_file, c_custkey::INTEGER AS source_line, 'run_' || c_mktsegment AS sink, 'b.php' AS sink_file, 7 AS sink_line, 'injection' AS kind, 'id' || c_custkey AS finding FROM customer"""
)
def engine_findings(spark: SparkSession, d: str) -> DataFrame:
    """A report of two equal findings for each customer."""
    one = F.struct(
        F.array(F.format_string("read_%d", "c_nationkey")).alias("source_name"), F.array(F.col("c_custkey")).alias("source_line"), F.array(F.lit("a.php")).alias("source_file"), F.concat(F.lit("run_"), F.col("c_mktsegment")).alias("sink_name"),
        F.lit(7).alias("sink_line"), F.lit("b.php").alias("sink_file"), F.lit("injection").alias("vuln_name"), F.format_string("id%d", "c_custkey").alias("vuln_id"),
    )
    reports = table(spark, d, "customer").select(F.col("c_custkey").alias("pkg"), F.to_json(F.array(one, one)).alias("value"))
    return findings.parsed(reports, "php").withColumnRenamed("pkg", "k")


@query(
    """SELECT DISTINCT '<' || p_brand || ': void ' || split_part(p_type, ' ', 1) || '(int,' || p_size || ')> -> ' || CASE WHEN p_brand < 'Brand#3' THEN '_SOURCE_' ELSE '_SINK_' END AS line
    FROM part"""
)
def engine_signatures(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("name", F.substring_index("p_type", " ", 1))
    signatures = p.select(F.col("p_brand").alias("base_type"), "name", F.lit("void").alias("result"), F.array(F.lit("int"), F.col("p_size").cast("string")).alias("arguments"))
    known = p.select(F.col("p_brand").alias("base_type"), "name", F.when(F.col("p_brand") < "Brand#3", "SOURCE").otherwise("DANGER").alias("functionality"))
    return findings.signature_lines(signatures, known)


@query(f"SELECT pkg, file, count(*) AS calls FROM {USAGE} GROUP BY 1, 2")
def calls_by_file(spark: SparkSession, d: str) -> DataFrame:
    return findings.file_counts(part_usage(spark, d))


@query("SELECT seed FROM (SELECT DISTINCT split_part(p_type, ' ', 1) AS seed FROM part UNION SELECT DISTINCT 'g' || s_nationkey FROM supplier)")
def group_seeds(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "part").select(F.concat(F.substring_index("p_type", " ", 1), F.lit("/"), F.col("p_name")).alias("name"))
    return findings.group_seeds(one, table(spark, d, "supplier").select(F.format_string("g%d/a", "s_nationkey").alias("name")))


@query("SELECT o_custkey::VARCHAR AS pkg, count(DISTINCT o_orderkey)::INTEGER AS versions, count(DISTINCT o_orderpriority)::INTEGER AS dependencies FROM orders GROUP BY 1")
def metadata_counts(spark: SparkSession, d: str) -> DataFrame:
    times = F.map_from_entries(F.collect_set(F.struct(F.col("o_orderkey").cast("string"), F.lit("2020-01-01T00:00:00Z"))))
    needs = F.map_from_entries(F.collect_set(F.struct("o_orderpriority", F.lit("*"))))
    docs = table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("pkg")).agg(F.to_json(F.struct(times.alias("time"), needs.alias("dependencies"))).alias("value"))
    return findings.metadata_counts(metadata.normalize(docs, "javascript"))


@query("SELECT DISTINCT o_custkey AS a, min(o_orderkey) OVER (PARTITION BY o_custkey) AS b FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) > 1")
def author_packages(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("author"), F.col("o_orderkey").alias("pkg"))
    return authors.author_packages(o).groupBy(F.col("author").alias("a")).agg(F.min("pkg").alias("b"))


@query(
    """WITH b AS (SELECT o_custkey AS method, o_orderkey AS seq, o_orderkey % 3 AS od, o_orderkey % 5 AS ld, o_orderkey % 7 + 1 + o_orderkey % 2 AS w, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
    e AS (SELECT a.method, a.w AS wa, b.w AS wb, a.seq AS sa, b.seq AS sb, a.od AS oa, b.od AS ob, a.ld AS la, b.ld AS lb FROM b a JOIN b ON a.nxt = b.seq AND a.method = b.method)
    SELECT method, round(sum(wa * sa + wb * sb)::DOUBLE / sum(wa + wb), 6) AS x, round(sum(wa * oa + wb * ob)::DOUBLE / sum(wa + wb), 6) AS y, round(sum(wa * la + wb * lb)::DOUBLE / sum(wa + wb), 6) AS z, sum(wa + wb)::BIGINT AS w FROM e GROUP BY 1
    UNION ALL SELECT method, seq::DOUBLE, od::DOUBLE, ld::DOUBLE, w FROM b WHERE n = 1"""
)
def invoke_centroids(spark: SparkSession, d: str) -> DataFrame:
    """Centroids of all methods, those of one block too, by statements and calls."""
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").withColumn("next", F.lead(k).over(Window.partitionBy("o_custkey").orderBy(k)))
    blocks = o.select(F.col("o_custkey").alias("method"), k.alias("seq"), (k % 3).alias("out_degree"), (k % 5).alias("loop_depth"), (k % 7 + 1).alias("stmt_count"), (k % 2).alias("invokes"))
    got = flows.method_centroids(blocks, o.filter("next IS NOT NULL").select(F.col("o_custkey").alias("method"), k.alias("src"), F.col("next").alias("dst")), invokes=True)
    return got.select("method", *[F.round(c, 6).alias(c) for c in "xyz"], "w")


@query(
    """SELECT p_name || ' ' || p_partkey AS name, p_brand AS author, p_size || '.0' AS version, 'http://x/' || p_partkey AS url, p_partkey AS downloads, CASE WHEN p_size > 10 THEN split_part(p_name, ' ', 1) || ',' || split_part(p_name, ' ', 2) ELSE '' END AS dependencies FROM part"""
)
def gem_records(spark: SparkSession, d: str) -> DataFrame:
    one = lambda name: F.struct(name.alias("name"), F.lit(">= 0").alias("requirements"))
    words = F.split("p_name", " ")
    needs = F.when(F.col("p_size") > 10, F.struct(F.array(one(words[0]), one(words[1])).alias("runtime"), F.array(one(F.lit("rake"))).alias("development")))
    fields = [F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"), F.col("p_brand").alias("authors"), F.concat(F.col("p_size").cast("string"), F.lit(".0")).alias("version"), F.concat(F.lit("http://x/"), F.col("p_partkey").cast("string")).alias("project_uri"), F.col("p_partkey").alias("downloads"), needs.alias("dependencies")]
    docs = table(spark, d, "part").select(F.col("p_name").alias("pkg"), F.to_json(F.struct(*fields)).alias("value"))
    return metadata.gem_records(docs).withColumn("dependencies", joined(F.col("dependencies")))


@query(
    """WITH f AS (SELECT DISTINCT substr(split_part(p_name, ' ', 2), 1, 4) AS name FROM part), c AS (SELECT p_partkey AS id, p_brand || '.' || p_name AS full_name FROM part)
    SELECT name || '(' AS name, id, full_name FROM f LEFT JOIN c ON contains(full_name, name) QUALIFY row_number() OVER (PARTITION BY name ORDER BY id DESC) = 1"""
)
def last_name_match(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue's last entry whose full name has a finding's name in it."""
    p = table(spark, d, "part")
    found = p.select(F.concat(F.substring(F.split("p_name", " ")[1], 1, 4), F.lit("(")).alias("name")).distinct()
    return usage.last_match(found, p.select(F.col("p_partkey").alias("id"), F.concat_ws(".", "p_brand", "p_name").alias("full_name")))


@query(
    """SELECT 'overall' AS kind, 'p' || p_partkey AS src, 'p' || p_partkey // 2 AS dst FROM part WHERE p_partkey > 0
    UNION ALL SELECT 'popular', 'p' || p_partkey, 'p' || p_partkey // 2 FROM part WHERE p_partkey > 0 AND p_partkey < 64
    UNION ALL SELECT 'popular_versions', 'p' || p_partkey || '==' || p_size, 'p' || p_partkey // 2 || '==latest' FROM part WHERE p_partkey > 0 AND p_partkey < 64"""
)
def dependency_graphs(spark: SparkSession, d: str) -> DataFrame:
    """The three graphs of a tree of parts, written and read again by kind: all, what 32 to 63 need, and its versions."""
    name = lambda c: F.concat(F.lit("p"), c.cast("string"))
    p = table(spark, d, "part").filter("p_partkey > 0")
    rows = p.select(name(F.col("p_partkey")).alias("src"), F.col("p_size").cast("string").alias("src_version"), name(F.floor(F.col("p_partkey") / 2)).alias("dst"), F.lit(None).cast("string").alias("dst_version"))
    popular = table(spark, d, "part").filter("p_partkey BETWEEN 32 AND 63").select(name(F.col("p_partkey")).alias("id"))
    folder = f"{shared_folder(spark)}/graphs-{uuid.uuid4().hex}"
    graphs.write(graphs.kinds(rows, popular), folder)
    wanted = {"overall": {}, "popular": {"popular": True}, "popular_versions": {"popular": True, "versions": True}}
    parts = [graphs.load(spark, folder, **how).select(F.lit(kind).alias("kind"), "src", "dst") for kind, how in wanted.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
