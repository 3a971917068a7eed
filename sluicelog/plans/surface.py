"""The relational surface: each category of SQL as a query, by SQL where both dialects agree, else by DataFrames."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..workdir import temporary

TABLES = "region nation customer supplier part orders lineitem events flows dns http documents".split()


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query by SQL text over the tables that it names."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for name in TABLES:
            if f" {name}" in text:
                _t(spark, sf_dir, name).createOrReplaceTempView(name)
        return spark.sql(text)

    return run


#: The same text for Spark and DuckDB.
BOTH = {
    "scan_filter_project": "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' AND l_quantity >= 45",
    "filter_predicates": """SELECT row_id, method, status_code, host FROM http WHERE (status_code IN (200, 206) OR status_code BETWEEN 400 AND 404)
        AND host LIKE '%.test' AND referrer IS NOT NULL AND NOT (method = 'HEAD')""",
    "join_inner": "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'",
    "join_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000",
    "join_right": "SELECT n_name, r_name FROM region RIGHT JOIN nation ON r_regionkey = n_regionkey AND r_name <> 'ASIA'",
    "join_full": "SELECT s_suppkey, c_custkey FROM (SELECT * FROM supplier WHERE s_acctbal > 0) s FULL JOIN (SELECT * FROM customer WHERE c_acctbal < 0) c ON s_suppkey = c_custkey",
    "join_using_three": "SELECT r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "subquery_exists": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    "subquery_scalar": "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part) AND p_size = (SELECT max(p_size) FROM part)",
    "join_lateral": """SELECT c_custkey, x.n, x.most FROM customer, LATERAL (SELECT count(*) AS n, max(o_totalprice) AS most FROM orders WHERE o_custkey = c_custkey) AS x""",
    "agg_group": """SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_qty, min(l_extendedprice) AS low, max(l_extendedprice) AS high, avg(l_quantity) AS avg_qty, count(*) AS n
        FROM lineitem GROUP BY l_returnflag, l_linestatus""",
    "agg_having": "SELECT name, count(*) AS n FROM flows GROUP BY name HAVING count(*) >= 10",
    "agg_distinct": "SELECT s_ip, count(DISTINCT c_ip) AS clients, count(DISTINCT query) AS queries FROM dns GROUP BY s_ip",
    "agg_filter": "SELECT s_ip, count(*) FILTER (WHERE resp_code = 'NXDOMAIN') AS failed, count(*) AS n FROM dns GROUP BY s_ip",
    "agg_stats": "SELECT event_type, round(stddev_pop(value), 6) AS sp, round(stddev_samp(value), 6) AS ss, round(var_pop(value), 4) AS vp, round(corr(value, event_id), 8) AS c FROM events GROUP BY event_type",
    "agg_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderpriority) AS BIGINT) AS g FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "agg_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "agg_grouping_sets": "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())",
    "win_rank": """SELECT s_suppkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER w AS BIGINT) AS rk, CAST(dense_rank() OVER w AS BIGINT) AS dr, CAST(ntile(4) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS BIGINT) AS q,
        round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey)""",
    "win_lag_gap": """SELECT row_id, time_start - lag(time_start) OVER (PARTITION BY c_ip ORDER BY time_start, row_id) AS gap,
        lead(row_id, 2) OVER (PARTITION BY c_ip ORDER BY time_start, row_id) AS after_next FROM flows""",
    "win_running": "SELECT row_id, CAST(sum(coalesce(s_bytes, 0)) OVER (PARTITION BY c_ip ORDER BY time_start, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS so_far, max(s_bytes) OVER (PARTITION BY c_ip ORDER BY time_start, row_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING) AS near FROM flows",
    "win_range": "SELECT row_id, count(*) OVER (PARTITION BY c_ip ORDER BY time_start RANGE BETWEEN 600 PRECEDING AND CURRENT ROW) AS lately FROM flows",
    "topk_domains": "SELECT name, count(*) AS n FROM flows WHERE name IS NOT NULL GROUP BY name ORDER BY n DESC, name LIMIT 20",
    "topk_per_group": "SELECT s_ip, query, n, CAST(r AS BIGINT) AS r FROM (SELECT s_ip, query, n, row_number() OVER (PARTITION BY s_ip ORDER BY n DESC, query) AS r FROM (SELECT s_ip, query, count(*) AS n FROM dns WHERE query IS NOT NULL AND s_ip IS NOT NULL GROUP BY s_ip, query) q) p WHERE r <= 3",
    "sort_limit_offset": "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 15 OFFSET 5",
    "set_union": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "set_union_distinct": "SELECT c_ip FROM flows UNION SELECT c_ip FROM dns",
    "set_intersect": "SELECT c_ip FROM flows INTERSECT SELECT c_ip FROM dns",
    "set_intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "set_except": "SELECT c_ip FROM dns EXCEPT SELECT c_ip FROM flows",
    "set_except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "fn_string": "SELECT s_suppkey, upper(s_name) AS u, CAST(length(s_name) AS BIGINT) AS n, substring(s_name, 3, 4) AS mid, lpad(CAST(s_suppkey AS STRING), 6, '0') AS padded, replace(s_name, '#', '-') AS r, concat_ws('/', s_name, 'x') AS j, trim(concat('  ', s_name, ' ')) AS t, reverse(s_name) AS b FROM supplier",
    "fn_math": "SELECT s_suppkey, abs(s_acctbal) AS a, CAST(ceil(s_acctbal) AS BIGINT) AS c, CAST(floor(s_acctbal) AS BIGINT) AS f, round(sqrt(abs(s_acctbal)), 6) AS q, round(ln(abs(s_acctbal) + 1), 9) AS l, round(log10(abs(s_acctbal) + 1), 9) AS d, CAST(sign(s_acctbal) AS DOUBLE) AS s, mod(s_suppkey, 7) AS m, greatest(s_acctbal, 0) AS g FROM supplier",
    "fn_date": "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d, CAST(hour(o_orderdate) AS BIGINT) AS h, CAST(date_trunc('month', o_orderdate) AS DATE) AS first_day, CAST(quarter(o_orderdate) AS BIGINT) AS q FROM orders",
    "fn_conditional": "SELECT row_id, CASE WHEN status_code < 300 THEN 'ok' WHEN status_code < 400 THEN 'moved' WHEN status_code IS NULL THEN 'none' ELSE 'bad' END AS kind, coalesce(content_type, server, '?') AS what, nullif(method, 'GET') AS other FROM http",
    "cte_chain": "WITH a AS (SELECT c_ip, count(*) AS n FROM flows GROUP BY c_ip), b AS (SELECT n, count(*) AS clients FROM a GROUP BY n) SELECT n, clients FROM b WHERE clients > 1",
    "cte_recursive_range": "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 60) SELECT n, CAST(n AS BIGINT) * n AS sq FROM t",
    "cte_recursive_components": """WITH RECURSIVE c(nation, least, step) AS (SELECT n_nationkey, n_nationkey, 0 FROM nation UNION ALL
        SELECT c.nation, n.n_nationkey, c.step + 1 FROM c JOIN nation m ON m.n_nationkey = c.least JOIN nation n ON n.n_regionkey = m.n_regionkey AND n.n_nationkey < c.least WHERE c.step < 25)
        SELECT nation, min(least) AS component, count(*) AS paths FROM c GROUP BY nation""",
    "pricing_summary": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge, count(*) AS n
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
    "shipping_revenue": """SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1996-03-15' GROUP BY o_orderkey ORDER BY revenue DESC, o_orderkey LIMIT 10""",
    "region_revenue": """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey
        JOIN lineitem ON l_suppkey = s_suppkey GROUP BY n_name""",
}


def _join_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    # 25 nations at any scale
    return _t(spark, sf_dir, "supplier").join(F.broadcast(_t(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")


def _join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "flows").join(_t(spark, sf_dir, "dns").select("c_ip"), "c_ip", "left_semi").select("row_id", "c_ip")


def _join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "dns").join(_t(spark, sf_dir, "flows").select("c_ip"), "c_ip", "left_anti").select("row_id", "c_ip")


def _join_theta_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user within the hour after another: hours are equal or adjoin, so a busy user is spread over them."""
    events = _t(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("hour"))
    hour = F.expr("INTERVAL '1' HOUR")
    a = events.select(F.col("event_id").alias("a_id"), "user_id", F.col("ts").alias("from"), F.explode(F.array("hour", F.col("hour") + hour)).alias("hour"))
    b = events.select(F.col("event_id").alias("b_id"), "user_id", "ts", "hour")
    return a.join(b, ["user_id", "hour"]).where((F.col("ts") > F.col("from")) & (F.col("ts") <= F.col("from") + hour)).select("a_id", "b_id")


def _join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The client's last look-up at or before each flow: one sort of both sides by client and day; what a day ends with is carried on to the next ones."""
    day = F.floor(F.col("t") / 86400).alias("day")
    flows = _t(spark, sf_dir, "flows").select("c_ip", F.col("time_start").alias("t"), F.lit(1).alias("side"), "row_id")
    dns = _t(spark, sf_dir, "dns").where("req_time IS NOT NULL").select("c_ip", F.col("req_time").alias("t"), F.lit(0).alias("side"), "row_id")
    both = flows.unionByName(dns).select("*", day)
    look_up = F.when(F.col("side") == 0, F.col("row_id"))
    within = Window.partitionBy("c_ip", "day").orderBy("t", "side", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("here", F.last(look_up, True).over(within)).where("side = 1").select("c_ip", "day", "row_id", "here")
    days = both.groupBy("c_ip", "day").agg(F.max_by(look_up, F.when(F.col("side") == 0, F.struct("t", "row_id"))).alias("last"))
    earlier = Window.partitionBy("c_ip").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select(F.col("c_ip").alias("_c"), F.col("day").alias("_d"), F.last("last", True).over(earlier).alias("carried"))
    same = F.col("c_ip").eqNullSafe(F.col("_c")) & F.col("day").eqNullSafe(F.col("_d"))
    return found.join(carried, same, "left").select("row_id", F.coalesce("here", "carried").alias("dns_id"))


def _join_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    # 5 regions at any scale
    return _t(spark, sf_dir, "nation").crossJoin(F.broadcast(_t(spark, sf_dir, "region"))).select("n_nationkey", "r_regionkey", (F.col("n_regionkey") == F.col("r_regionkey")).alias("own"))


def _join_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    # five bands at any scale; no equality at all
    bands = spark.createDataFrame([(i, i * 400.0, (i + 1) * 400.0) for i in range(5)], "band int, low double, high double")
    parts = _t(spark, sf_dir, "part")
    return parts.join(F.broadcast(bands), (F.col("p_retailprice") >= F.col("low")) & (F.col("p_retailprice") < F.col("high"))).select("p_partkey", "band")


def _scan(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    """A whole table written to the shared folder in another format and scanned from there."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = _t(spark, sf_dir, "orders")
        path = temporary(spark, f"orders-{kind}")
        orders.write.format(kind).save(path)
        return spark.read.format(kind).schema(orders.schema).load(path).where("o_totalprice > 1000").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")

    return run


def _agg_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").groupBy("event_type").agg(*[F.round(F.percentile("value", F.lit(p)), 9).alias(f"p{int(p * 100)}") for p in (0.05, 0.25, 0.5, 0.75, 0.95)])


def _agg_approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "dns").groupBy("resp_code").agg(F.approx_count_distinct("query", 0.02).alias("queries"))


def _agg_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1)))


def _win_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("c_ip").orderBy("time_start", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    return _t(spark, sf_dir, "flows").select("row_id", F.first("name", True).over(w).alias("first_name"), F.last("s_pkt", True).over(w).alias("last_pkt"), F.nth_value("name", 3).over(w).alias("third"))


def _win_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return e.select(F.unix_timestamp("window.start").alias("start_s"), "event_type", "n")


def _win_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour", "15 minutes")).agg(F.count(F.lit(1)).alias("n"))
    return e.select(F.unix_timestamp("window.start").alias("start_s"), "n")


def _win_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "2 hours")).agg(F.count(F.lit(1)).alias("n"))
    return e.select("user_id", F.unix_micros("session_window.start").alias("start_us"), "n")


def _fn_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "http").select("row_id", F.nullif(F.regexp_extract("user_agent", r"^([A-Za-z]+)/([0-9]+)", 1), F.lit("")).alias("agent"), F.regexp_replace("path", "[0-9]+", "N").alias("shape"), F.col("host").rlike(r"^cdn[0-9]\.").alias("cdn"))


def _fn_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "dns").select(
        "row_id", F.array_size("answers").cast("long").alias("n"), F.get("answers", F.lit(0)).alias("first"), F.array_contains("answer_types", "CNAME").alias("aliased"),
        F.array_join(F.array_sort("answers"), ",").alias("joined"), F.aggregate(F.transform("answer_ttls", lambda x: F.coalesce(x, F.lit(0))), F.lit(0).cast("long"), lambda a, b: a + b).alias("ttls"),
        F.array_size(F.filter("answer_ttls", lambda x: x > 300)).cast("long").alias("long_ttls"),
    )


def _fn_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.from_json("props", "k INT")["k"].alias("k2"))


def _fn_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _t(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    m = pairs.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("m"))
    return m.select("user_id", F.array_join(F.map_keys("m"), ",").alias("kinds"), F.try_element_at("m", F.lit("click")).alias("clicks"))


def _fn_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("flags_resp")
    return _t(spark, sf_dir, "dns").select("row_id", f.bitwiseAND(F.lit(8).cast("long")).alias("rd"), f.bitwiseOR(F.lit(1).cast("long")).alias("o"), f.bitwiseXOR(F.lit(12).cast("long")).alias("x"), F.shiftleft(f, 2).alias("l"), F.shiftright(f, 2).alias("r"))


def _nested_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "dns").select("row_id", F.posexplode(F.arrays_zip("answers", "answer_types")))
    return d.select("row_id", F.col("pos").cast("long").alias("pos"), F.col("col.answers").alias("answer"), F.col("col.answer_types").alias("kind"))


def _nested_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("nations"))


def _unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "flows").select("row_id", "c_bytes", "s_bytes").unpivot("row_id", ["c_bytes", "s_bytes"], "side", "bytes").where("bytes IS NOT NULL")


def _fillna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "http").select("row_id", "server", "request_body_len").na.fill("-", ["server"]).na.fill(0, ["request_body_len"])


FRAMES = {
    "join_broadcast": (_join_broadcast, "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "join_semi": (_join_semi, "SELECT row_id, c_ip FROM flows WHERE c_ip IN (SELECT c_ip FROM dns)"),
    "join_anti": (_join_anti, "SELECT row_id, c_ip FROM dns WHERE c_ip IS NULL OR NOT EXISTS (SELECT 1 FROM flows WHERE flows.c_ip = dns.c_ip)"),
    "join_theta_interval": (_join_theta_interval, "SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL '1' HOUR"),
    "join_cross": (_join_cross, "SELECT n_nationkey, r_regionkey, n_regionkey = r_regionkey AS own FROM nation CROSS JOIN region"),
    "join_bands": (_join_bands, "SELECT p_partkey, CAST(floor(p_retailprice / 400) AS INT) AS band FROM part WHERE p_retailprice >= 0 AND p_retailprice < 2000"),
    **{f"scan_{kind}": (_scan(kind), "SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice, o_orderpriority FROM orders WHERE o_totalprice > 1000") for kind in ("csv", "json", "orc")},
    "join_asof": (
        _join_asof,
        """WITH b AS (SELECT c_ip, time_start AS t, 1 AS side, row_id FROM flows UNION ALL SELECT c_ip, req_time, 0, row_id FROM dns WHERE req_time IS NOT NULL)
        SELECT row_id, dns_id FROM (SELECT row_id, side, last_value(CASE WHEN side = 0 THEN row_id END IGNORE NULLS) OVER (PARTITION BY c_ip ORDER BY t, side, row_id ROWS UNBOUNDED PRECEDING) AS dns_id FROM b) WHERE side = 1""",
    ),
    "agg_percentile": (_agg_percentile, "SELECT event_type, " + ", ".join(f"round(quantile_cont(value, {p}), 9) AS p{int(p * 100)}" for p in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM events GROUP BY event_type"),
    "agg_approx_distinct": (_agg_approx_distinct, None),
    "agg_pivot": (_agg_pivot, "SELECT l_returnflag, nullif(count(*) FILTER (WHERE l_linestatus = 'F'), 0) AS F, nullif(count(*) FILTER (WHERE l_linestatus = 'O'), 0) AS O FROM lineitem GROUP BY l_returnflag"),
    "win_first_last": (
        _win_first_last,
        """SELECT row_id, first_value(name IGNORE NULLS) OVER w AS first_name, last_value(s_pkt IGNORE NULLS) OVER w AS last_pkt, nth_value(name, 3) OVER w AS third
        FROM flows WINDOW w AS (PARTITION BY c_ip ORDER BY time_start, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    ),
    "win_tumbling": (_win_tumbling, "SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS start_s, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "win_sliding": (
        _win_sliding,
        "SELECT s AS start_s, count(*) AS n FROM (SELECT unnest([CAST(floor(epoch(ts) / 900) AS BIGINT) * 900 - 900 * i FOR i IN range(4)]) AS s FROM events) GROUP BY s",
    ),
    "win_session": (
        _win_session,
        """WITH g AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 7200000000 THEN 0 ELSE 1 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(t) AS start_us, count(*) AS n FROM s GROUP BY user_id, k""",
    ),
    "fn_regex": (
        _fn_regex,
        r"SELECT row_id, nullif(regexp_extract(user_agent, '^([A-Za-z]+)/([0-9]+)', 1), '') AS agent, regexp_replace(path, '[0-9]+', 'N', 'g') AS shape, regexp_matches(host, '^cdn[0-9]\.') AS cdn FROM http",
    ),
    "fn_array": (
        _fn_array,
        """SELECT row_id, len(answers) AS n, answers[1] AS first, CASE WHEN list_contains(answer_types, 'CNAME') THEN true WHEN answer_types IS NULL OR len(list_filter(answer_types, lambda x: x IS NULL)) > 0 THEN NULL ELSE false END AS aliased,
        array_to_string(list_sort(answers), ',') AS joined, CASE WHEN answer_ttls IS NULL THEN NULL ELSE CAST(coalesce(list_sum(answer_ttls), 0) AS BIGINT) END AS ttls, len(list_filter(answer_ttls, lambda x: x > 300)) AS long_ttls FROM dns""",
    ),
    "fn_json": (_fn_json, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS INT) AS k2 FROM events"),
    "fn_map": (
        _fn_map,
        "WITH p AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS kinds, max(CASE WHEN event_type = 'click' THEN n END) AS clicks FROM p GROUP BY user_id",
    ),
    "fn_bits": (_fn_bits, "SELECT row_id, flags_resp & 8 AS rd, flags_resp | 1 AS o, xor(flags_resp, 12) AS x, flags_resp << 2 AS l, flags_resp >> 2 AS r FROM dns"),
    "nested_explode": (
        _nested_explode,
        """SELECT row_id, i AS pos, answers[i + 1] AS answer, answer_types[i + 1] AS kind
        FROM (SELECT row_id, answers, answer_types, unnest(range(greatest(len(answers), len(answer_types)))) AS i FROM dns WHERE answers IS NOT NULL AND answer_types IS NOT NULL)""",
    ),
    "nested_collect": (_nested_collect, "SELECT n_regionkey, list(n_name ORDER BY n_name) AS nations FROM nation GROUP BY n_regionkey"),
    "unpivot": (_unpivot, "SELECT row_id, side, bytes FROM (UNPIVOT (SELECT row_id, c_bytes, s_bytes FROM flows) ON c_bytes, s_bytes INTO NAME side VALUE bytes)"),
    "fillna": (_fillna, "SELECT row_id, coalesce(server, '-') AS server, coalesce(request_body_len, 0) AS request_body_len FROM http"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: sql_query(text) for name, text in BOTH.items()} | {name: query for name, (query, _) in FRAMES.items()}
SQL = {**BOTH, **{name: text for name, (_, text) in FRAMES.items() if text}}
