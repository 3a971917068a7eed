"""The queries p1, p4, p6, p8, p9 and p10 with their SQL twins."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import plain_form, plain_form_sql
from ..workdir import materialize
from . import cooccurrence, distinct, encode, packing, quantiles, splitting

CAPACITY = 2048
TTL_MOST = 2**31 - 1
DAILY = ["day_utc", "s_ip"]
#: Size of the small sketches that the checks hold against exact results.
CHECK_K = 64


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day(seconds: Column) -> Column:
    """The UTC day of epoch seconds as a date; NULL for NULL, NaN and times out of any calendar."""
    fair = F.when(seconds.between(-6e10, 2.5e11), seconds)
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(fair / 86400).cast("int"))


def _pairs(spark: SparkSession, sf_dir: str, min_count: int) -> DataFrame:
    flows = _table(spark, sf_dir, "flows")
    return cooccurrence.pair_counts(flows, [F.col("c_ip"), _day(F.col("time_start"))], plain_form(F.col("name")), min_count)


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of plain names in any client-day together, with counts and lift."""
    return _pairs(spark, sf_dir, 1)


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of plain names in at least 20 client-days together, with counts and lift."""
    return _pairs(spark, sf_dir, 20)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those at least 8 times as frequent as chance suggests."""
    return cooccurrence.lifted(p1_pairs(spark, sf_dir), 8).select("name_a", "name_b")


def _served(spark: SparkSession, sf_dir: str) -> DataFrame:
    dns = _table(spark, sf_dir, "dns").where(F.col("s_ip").isNotNull() & F.col("req_time").isNotNull())
    return dns.select(F.date_format(_day(F.col("req_time")), "yyyy-MM-dd").alias("day_utc"), "s_ip", "c_ip", plain_form(F.col("query")).alias("query"))


def _daily_sketches(spark: SparkSession, sf_dir: str, k: int = distinct.K) -> DataFrame:
    served = _served(spark, sf_dir)
    return distinct.sketch(served, {c: F.col(c) for c in DAILY}, {c: F.col(c) for c in ("c_ip", "query")}, k)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which a resolver served far more different clients or queries than it does on average."""
    daily = distinct.estimate(_daily_sketches(spark, sf_dir), ["day_utc", "s_ip"])
    return distinct.outstanding(daily, "day_utc", "s_ip", 50, 4.0)


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different clients and queries by day and resolver, by day, by resolver and in all, with bounds."""
    return distinct.estimate(_sets(spark, sf_dir, distinct.K), ["level", *DAILY])


def _sets(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return distinct.grouping_sets(_daily_sketches(spark, sf_dir, k), DAILY, [DAILY, ["day_utc"], ["s_ip"], []], k)


def p4_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each day shares with the next, by resolver and over all of them: clients and queries of either, of both, of one alone, with bounds."""
    daily = _daily_sketches(spark, sf_dir)
    sets = distinct.grouping_sets(daily, DAILY, [DAILY, ["day_utc"]]).select("level", "day_utc", "s_ip", "counted", "hashes")
    after = sets.select("level", F.date_format(F.date_sub("day_utc", 1), "yyyy-MM-dd").alias("day_utc"), F.coalesce("s_ip", F.lit("")).alias("_s"), "counted", F.col("hashes").alias("later"))
    pairs = sets.withColumn("_s", F.coalesce("s_ip", F.lit(""))).join(after, ["level", "day_utc", "_s", "counted"])
    return distinct.compare(pairs, "hashes", "later", ["level", *DAILY, "counted"])


def p4_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact numbers beside sketches of only 64 hashes, whose estimates they must lie within five standard errors of."""
    bounds = distinct.estimate(_sets(spark, sf_dir, CHECK_K), ["level", *DAILY], CHECK_K, 5.0)
    served = _served(spark, sf_dir)
    exact = served.groupingSets([DAILY, ["day_utc"], ["s_ip"], []], *DAILY).agg(F.grouping_id().alias("g"), F.countDistinct("c_ip").alias("c_ip"), F.countDistinct("query").alias("query"))
    long = exact.select((3 - F.col("g")).alias("level"), *DAILY, F.explode(F.array(*[F.struct(F.lit(c).alias("counted"), F.col(c).alias("n")) for c in ("c_ip", "query")])).alias("_c")).select("level", *DAILY, "_c.*")
    same = F.lit(True)
    for c in ("level", *DAILY, "counted"):
        same &= F.col(f"e.{c}").eqNullSafe(F.col(f"b.{c}"))
    return long.alias("e").join(bounds.alias("b"), same, "left").select(
        F.col("e.level").cast("int").alias("level"), "e.day_utc", "e.s_ip", "e.counted", "e.n", (F.col("e.n") >= CHECK_K).alias("estimated"), F.coalesce(F.col("e.n").between(F.col("lower"), F.col("upper")), F.lit(False)).alias("within")
    )


def _ttls(spark: SparkSession, sf_dir: str) -> DataFrame:
    dns = _table(spark, sf_dir, "dns").select(_day(F.col("req_time")).alias("day"), plain_form(F.col("query")).alias("query"), F.explode("answer_ttls").alias("ttl"))
    return dns.where(F.col("query").isNotNull() & F.col("ttl").between(0, TTL_MOST))


def p6_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TTL percentiles of each plain query, from daily sketches merged over the days."""
    daily = quantiles.sketch(_ttls(spark, sf_dir), {"day": F.col("day"), "query": F.col("query")}, F.col("ttl"))
    return quantiles.percentiles(quantiles.merge(daily, ["query"]), ["query"], {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries with at least 40 TTLs whose 95th percentile is at least 10 times the median."""
    sketches = quantiles.sketch(_ttls(spark, sf_dir), {"query": F.col("query")}, F.col("ttl")).where("n >= 40")
    ranks = quantiles.percentiles(sketches, ["query"], {"p50": 0.5, "p95": 0.95})
    return ranks.where(F.col("p95") >= 10 * F.col("p50")).select("query")


def p6_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the percentiles of sketches of level size 64, merged over the days, have exact ranks within twice their bound, for queries with more than 200 TTLs."""
    ttls = _ttls(spark, sf_dir)
    ranks = {"p50": 0.5, "p95": 0.95}
    merged = quantiles.merge(quantiles.sketch(ttls, {"day": F.col("day"), "query": F.col("query")}, F.col("ttl"), CHECK_K), ["query"], CHECK_K).where("n > 200")
    found = quantiles.percentiles(merged, ["query"], ranks)
    error = 2 * 2.3 / CHECK_K**0.9
    shares = ttls.join(found, "query").groupBy("query", "n").agg(*[F.avg((F.col("ttl") <= F.col(p)).cast("double")).alias(f"{p}_upto") for p in ranks], *[F.avg((F.col("ttl") < F.col(p)).cast("double")).alias(f"{p}_below") for p in ranks])
    # among equal values any rank is theirs
    return shares.select("query", "n", *[((F.col(f"{p}_upto") >= q - error) & (F.col(f"{p}_below") <= q + error)).alias(f"{p}_within") for p, q in ranks.items()])


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of each document."""
    return encode.encode(_table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MD5 of each document's text as its ids spell it."""
    return encode.decoded_md5(p8_ids(spark, sf_dir), "doc_id", "ids").withColumnRenamed("md5", "text_md5")


def p9_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document whether its pieces hold as many tokens as its ids, all but the last fill a container, and no container of theirs is over its capacity or holds other than its fill."""
    packed = materialize(p9_containers(spark, sf_dir), "packed")
    fills = packed.groupBy("container").agg((F.sum("size") == F.max("fill")).alias("_sum"), (F.max("fill") <= CAPACITY).alias("_under"))
    last = F.max("piece_no").over(Window.partitionBy("doc_id"))
    whole = packed.withColumn("_full", (F.col("piece_no") == last) | (F.col("size") == CAPACITY)).join(fills, "container")
    docs = whole.groupBy("doc_id").agg(F.sum("size").alias("_n"), F.count(F.lit(1)).alias("_pieces"), F.bool_and("_full").alias("full_before_last"), F.bool_and(F.col("_sum") & F.col("_under")).alias("within_capacity"))
    ids = p8_ids(spark, sf_dir).select("doc_id", F.size("ids").alias("_ids"))
    return ids.join(docs, "doc_id", "left").select(
        "doc_id", F.coalesce(F.col("_n") == F.col("_ids"), F.lit(False)).alias("tokens_agree"), F.coalesce(F.col("_pieces") == F.greatest(F.lit(1), F.ceil(F.col("_ids") / CAPACITY)), F.lit(False)).alias("pieces_agree"), "full_before_last", "within_capacity"
    )


def p10_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document whether its pieces are what the text holds there, cover it, stay within the limit (counted again), overlap by 32 to 64 tokens (counted alone), and are more than one only beyond the limit."""
    limits = splitting.Limits()
    pieces = materialize(p10_pieces(spark, sf_dir), "pieces")
    by_doc = Window.partitionBy("doc_id").orderBy("piece_no")
    after, name = F.lead("start").over(by_doc), F.concat_ws("-", "doc_id", "piece_no")
    linked = pieces.select("*", name.alias("_name"), after.alias("_after"), F.expr("substring(text, lead(start) OVER (PARTITION BY doc_id ORDER BY piece_no) - start + 1, end - lead(start) OVER (PARTITION BY doc_id ORDER BY piece_no))").alias("_shared"))
    again = encode.token_counts(linked, "_name", "text").withColumnRenamed("n_tokens", "_again")
    shared = encode.token_counts(linked.where("_after IS NOT NULL"), "_name", "_shared").withColumnRenamed("n_tokens", "_both")
    texts = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("_whole"))
    joined = linked.join(again, "_name").join(shared, "_name", "left").join(texts, "doc_id")
    here = F.expr("substring(_whole, start + 1, end - start)")
    docs = joined.groupBy("doc_id").agg(
        F.bool_and(F.coalesce(F.col("text") == here, F.col("_whole").isNull())).alias("texts_agree"),
        (F.min("start") == 0).alias("_first"), (F.max("end") == F.coalesce(F.max(F.length("_whole")), F.lit(0))).alias("_last"), F.bool_and(F.coalesce((F.col("_after") > F.col("start")) & (F.col("_after") < F.col("end")), F.lit(True))).alias("_linked"),
        F.bool_and((F.col("_again") == F.col("n_tokens")) & (F.col("n_tokens") <= limits.most)).alias("within_limit"),
        F.bool_and(F.coalesce(F.col("_both").between(limits.least_shared, limits.most_shared), F.lit(True))).alias("overlaps_hold"), F.count(F.lit(1)).alias("_pieces"),
    )
    ids = p8_ids(spark, sf_dir).select("doc_id", F.size("ids").alias("_ids"))
    return ids.join(docs, "doc_id", "left").select(
        "doc_id", "texts_agree", (F.col("_first") & F.col("_last") & F.col("_linked")).alias("covered"), "within_limit", "overlaps_hold", ((F.col("_pieces") > 1) == (F.col("_ids") > limits.most)).alias("split_if_needed")
    )


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in containers of 2,048 tokens."""
    sizes = encode.token_counts(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return packing.pack(sizes, "doc_id", "n_tokens", CAPACITY)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents divided among containers."""
    return p9_containers(spark, sf_dir).where("piece_no > 0").select("doc_id").distinct()


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of at most 512 tokens of all documents."""
    return splitting.split(_table(spark, sf_dir, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in more than one piece."""
    return p10_pieces(spark, sf_dir).where("piece_no > 0").select("doc_id").distinct()


QUERIES = {
    "p1_found": p1_found, "p1_pairs": p1_pairs, "p1_counts": p1_counts, "p4_found": p4_found, "p4_counts": p4_counts, "p4_compare": p4_compare, "p4_check": p4_check, "p6_found": p6_found, "p6_percentiles": p6_percentiles, "p6_check": p6_check,
    "p8_ids": p8_ids, "p8_roundtrip": p8_roundtrip, "p9_found": p9_found, "p9_containers": p9_containers, "p9_check": p9_check, "p10_found": p10_found, "p10_pieces": p10_pieces, "p10_check": p10_check,
}

_BASKETS = f"""WITH i AS (SELECT DISTINCT c_ip, CAST(floor(time_start / 86400) AS INT) AS d, {plain_form_sql("name")} AS x FROM flows WHERE {plain_form_sql("name")} IS NOT NULL),
    s AS (SELECT x, count(*) AS n FROM i GROUP BY x), t AS (SELECT count(*) AS n FROM (SELECT DISTINCT c_ip, d FROM i)),
    p AS (SELECT a.x AS name_a, b.x AS name_b, count(*) AS n_ab FROM i AS a JOIN i AS b ON a.c_ip = b.c_ip AND a.d = b.d AND a.x < b.x GROUP BY 1, 2 HAVING count(*) >= 20),
    q AS (SELECT name_a, name_b, n_ab, sa.n AS n_a, sb.n AS n_b, t.n AS n_baskets, n_ab * t.n::DOUBLE / (sa.n::DOUBLE * sb.n) AS lift
        FROM p JOIN s AS sa ON sa.x = name_a JOIN s AS sb ON sb.x = name_b, t)"""
_TTLS = f"""WITH t AS (SELECT query, ttl FROM (SELECT {plain_form_sql('"query"')} AS query, unnest(answer_ttls) AS ttl FROM dns)
    WHERE query IS NOT NULL AND ttl BETWEEN 0 AND {TTL_MOST})"""
_SERVED = f"""r AS (SELECT strftime(make_timestamp(CAST(floor(req_time) AS BIGINT) * 1000000), '%Y-%m-%d') AS day_utc, s_ip, c_ip, {plain_form_sql('"query"')} AS q
    FROM dns WHERE s_ip IS NOT NULL AND req_time IS NOT NULL)"""

SQL = {
    "p1_pairs": f"{_BASKETS} SELECT * FROM q",
    "p1_counts": f"{_BASKETS.replace(' HAVING count(*) >= 20', '')} SELECT * FROM q",
    "p1_found": f"{_BASKETS} SELECT name_a, name_b FROM q WHERE n_ab * n_baskets >= 8 * n_a * n_b",
    "p8_roundtrip": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents",
    "p9_check": "SELECT doc_id, true AS tokens_agree, true AS pieces_agree, true AS full_before_last, true AS within_capacity FROM documents",
    "p10_check": "SELECT doc_id, true AS texts_agree, true AS covered, true AS within_limit, true AS overlaps_hold, true AS split_if_needed FROM documents",
    "p4_check": f"""WITH {_SERVED},
        e AS (SELECT 3 - grouping_id(day_utc, s_ip) AS level, day_utc, s_ip, count(DISTINCT c_ip) AS c_ip, count(DISTINCT q) AS query FROM r GROUP BY GROUPING SETS ((day_utc, s_ip), (day_utc), (s_ip), ())),
        u AS (UNPIVOT e ON c_ip, query INTO NAME counted VALUE n)
        SELECT level::INT AS level, day_utc, s_ip, counted, n, n >= {CHECK_K} AS estimated, true AS within FROM u""",
    "p6_check": f"""{_TTLS} SELECT query, count(*) AS n, true AS p50_within, true AS p95_within FROM t GROUP BY query HAVING count(*) > 200""",
    "p4_compare": f"""WITH {_SERVED},
        x AS (SELECT day_utc, s_ip, 'c_ip' AS counted, c_ip AS v FROM r UNION ALL SELECT day_utc, s_ip, 'query', q FROM r),
        v AS (SELECT DISTINCT 3 AS level, day_utc, s_ip, counted, v FROM x UNION ALL SELECT DISTINCT 2, day_utc, NULL, counted, v FROM x),
        g AS (SELECT DISTINCT level, day_utc, s_ip, counted FROM v),
        p AS (SELECT a.*, b.day_utc AS later FROM g AS a JOIN g AS b ON a.level = b.level AND a.s_ip IS NOT DISTINCT FROM b.s_ip AND a.counted = b.counted AND b.day_utc = strftime(a.day_utc::DATE + 1, '%Y-%m-%d')),
        s AS (SELECT p.level, p.day_utc, p.s_ip, p.counted, v, bool_or(v.day_utc = p.day_utc) AS a, bool_or(v.day_utc = p.later) AS b
            FROM p JOIN v ON v.level = p.level AND v.s_ip IS NOT DISTINCT FROM p.s_ip AND v.counted = p.counted AND v.day_utc IN (p.day_utc, p.later) GROUP BY ALL),
        c AS (SELECT level, day_utc, s_ip, counted, count(v) AS "union", count(v) FILTER (a AND b) AS "both", count(v) FILTER (a AND NOT b) AS only_a, count(v) FILTER (b AND NOT a) AS only_b FROM s GROUP BY 1, 2, 3, 4),
        m AS (UNPIVOT c ON "union", "both", only_a, only_b INTO NAME measure VALUE n)
        SELECT level, day_utc, s_ip, counted, measure, n::DOUBLE AS estimate, n::DOUBLE AS lower, n::DOUBLE AS upper FROM m""",
    "p4_found": f"""WITH {_SERVED},
        d AS (SELECT day_utc, s_ip, count(DISTINCT c_ip) AS c_ip, count(DISTINCT q) AS query FROM r GROUP BY 1, 2),
        u AS (UNPIVOT d ON c_ip, query INTO NAME counted VALUE n),
        m AS (SELECT *, avg(n) OVER (PARTITION BY s_ip, counted) AS mean FROM u)
        SELECT day_utc, s_ip, counted FROM m WHERE n >= 50 AND n >= 4 * mean""",
    "p6_found": f"""{_TTLS} SELECT query FROM t GROUP BY query HAVING count(*) >= 40
        AND quantile_disc(ttl, 0.95) >= 10 * quantile_disc(ttl, 0.5)""",
}
