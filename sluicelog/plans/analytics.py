"""The analytics over the test tables, with their SQL twins."""

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ip, misc, names
from ..operators import anomaly, attribution, clustering, features, pageload, resolvers, traffic, windows

ORDER = ("time_start", "row_id")
CORES = ("www.clilkioyaen.invalid", "edge_trusk.waenplun.example", "rulbrousdraesk.co.test")
SERVICE = attribution.Params(CORES, observe=900.0, gap=600.0, evaluate=300.0, min_share=0.02)
PAGE = pageload.Params(CORES, window=1200.0, gap=600.0, min_share=0.02, checkpoints=3)
MIN_RESOLUTIONS = 20
#: A small routing table over the answered addresses; those beyond the first are nested in it, others have no route.
PREFIXES = (("100.127.0.0/16", "66000"), ("100.96.0.0/18", "65001"), ("100.96.0.0/20", "65002"), ("100.96.0.0/24", "65003"), ("100.96.1.0/24", "65004"), ("100.96.16.0/20", "65005"), ("100.96.128.0/17", "65006"))
_CORE_LIST = ", ".join(f"'{c}'" for c in CORES)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows by plain names."""
    return _t(spark, sf_dir, "flows").withColumn("name", F.coalesce(names.plain_form(F.col("name")), F.lit("-")))


def _prefixes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PREFIXES, "prefix string, asn string")


def _hijacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``dns``, in which resolvers with an address that ends in ``.2`` answer with few addresses of their own and one long time to live: what the study is to find."""
    dns = _t(spark, sf_dir, "dns")
    rogue = F.col("s_ip").like("%.2") & (F.size("answers") > 0)
    return dns.withColumns({
        "answers": F.when(rogue, F.array(F.concat(F.lit("100.127.0."), (F.length("query") % 4).cast("string")))).otherwise(F.col("answers")),
        "answer_ttls": F.when(rogue, F.array((F.length("query") % 2 + 86400).cast("bigint"))).otherwise(F.col("answer_ttls")),
    })


def _study(spark: SparkSession, sf_dir: str) -> resolvers.Study:
    return resolvers.Study(_hijacked(spark, sf_dir), _prefixes(spark), MIN_RESOLUTIONS)


def traffic_per_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.domain_traffic(_t(spark, sf_dir, "flows"))


def contacted_resolvers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.contacted_resolvers(_t(spark, sf_dir, "dns"))


def name_service_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "flows").select("name", names.service_form(F.col("name")).alias("form")).distinct()


def name_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    fqdn = F.lower(F.col("query"))
    return _t(spark, sf_dir, "dns").where("query IS NOT NULL AND query != ''").select(fqdn.alias("fqdn"), names.second_level(fqdn).alias("second"), names.third_level(fqdn).alias("third"), names.site(fqdn).alias("site")).distinct()


def address_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _t(spark, sf_dir, "dns").select(F.explode("answers").alias("x")).union(_t(spark, sf_dir, "flows").select("c_ip")).where("x IS NOT NULL").distinct()
    return a.select("x", ip.is_ipv4(F.col("x")).alias("v4"), ip.is_ipv6(F.col("x")).alias("v6"), ip.is_ip(F.col("x")).alias("any"))


def address_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _t(spark, sf_dir, "dns").select(F.explode("answers").alias("x")).where("x IS NOT NULL")
    return ip.network_names(a, "x", _prefixes(spark))


def http_url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _t(spark, sf_dir, "http").select("row_id", "method", F.when(F.col("method") == "CONNECT", F.concat_ws(":", "host", "s_port")).otherwise(F.concat(F.lit("http://"), "host", F.coalesce("path", F.lit("/")))).alias("url"))
    host, port, path = misc.url_parts(F.col("method"), F.col("url"), bare_connect=False)
    return h.select("row_id", host.alias("host"), port.alias("port"), path.alias("path"))


def series_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "flows").groupBy(misc.time_bin(F.col("time_start"), 3600.0).alias("time")).agg(F.sum(F.coalesce("s_bytes", F.lit(0))).alias("bytes"), F.count(F.lit(1)).alias("flows"))


def service_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.bags(_flows(spark, sf_dir), list(CORES), SERVICE.gap, SERVICE.observe, ORDER)


def service_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = attribution.rules(_flows(spark, sf_dir), SERVICE, ORDER)
    return r.select("core", "support", F.round("share", 9).alias("share"), F.round("weight", 9).alias("weight"))


def service_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _flows(spark, sf_dir)
    return attribution.classify(f, attribution.rules(f, SERVICE, ORDER), SERVICE, ORDER).select("row_id", "service")


def service_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.report(_flows(spark, sf_dir), SERVICE, ORDER)


def page_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, supports = windows.finished_windows(_flows(spark, sf_dir), list(CORES), PAGE.gap, PAGE.window, ORDER)
    return supports.select("core", "c_ip", "start", "support", F.round("delta", 6).alias("delta"))


def _page_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pageload.bags(_flows(spark, sf_dir), PAGE, ORDER)


def page_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _page_bags(spark, sf_dir)
    return b.select("core", "support", "n", F.round("freq", 6).alias("freq"), F.round("avg_time", 4).alias("avg_time"), F.round("stdev_time", 4).alias("stdev_time"))


def page_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, seen = pageload.evaluation_windows(_flows(spark, sf_dir), _page_bags(spark, sf_dir), PAGE, ORDER)
    joined = found.join(seen, ["core", "c_ip", "start", "at"], "left")
    return joined.select("core", "c_ip", "start", F.col("at.row_id").alias("row_id"), "support", F.round("delta", 6).alias("delta"))


def page_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, seen = pageload.evaluation_windows(_flows(spark, sf_dir), _page_bags(spark, sf_dir), PAGE, ORDER)
    return pageload.model(seen, PAGE.checkpoints)


def page_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = pageload.report(_flows(spark, sf_dir), PAGE, ORDER)
    return r.select("time", "c_ip", "page", *[F.round(f"cp_{i}", 6).alias(f"cp_{i}") for i in range(1, PAGE.checkpoints + 1)])


def resolver_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _study(spark, sf_dir).domains


def resolver_normality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _study(spark, sf_dir).normal.select("fqdn", "feature", F.round("threshold", 6).alias("threshold"))


def resolver_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _study(spark, sf_dir).anomalies


def resolver_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _study(spark, sf_dir).norms


def resolver_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _study(spark, sf_dir).networks


def resolver_suspicious(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _study(spark, sf_dir).suspicious


def resolver_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _study(spark, sf_dir).summary


def resolver_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _study(spark, sf_dir).report()


def _known_domains(spark: SparkSession, sf_dir: str, s: resolvers.Study) -> DataFrame:
    """What the whole of ``dns`` tells of each domain: ``asns`` that at least two resolvers answered with, and ``aliases`` in the answers.

    The tables' content networks have invented names with a label ``edge-...``, which stands for ``edgekey``.
    """
    asns = s.domains.where("feature = 'asn'").groupBy("fqdn", "value").agg(F.countDistinct("resolver").alias("n")).groupBy("fqdn").agg(F.collect_list(F.when(F.col("n") >= 2, F.col("value"))).alias("asns"))
    answers = _hijacked(spark, sf_dir).select(F.lower("query").alias("fqdn"), F.explode("answers").alias("x")).where("fqdn IS NOT NULL AND x IS NOT NULL")
    named = answers.where(~ip.is_ip(F.col("x"))).withColumn("x", F.regexp_replace(F.lower("x"), r"(^|\.)edge-[^.]*", "$1edgekey"))
    aliases = named.groupBy("fqdn").agg(F.collect_set("x").alias("aliases"))
    none = F.array().cast("array<string>")
    return asns.join(aliases, "fqdn", "full").select(F.col("fqdn").alias("domain"), F.coalesce("asns", none).alias("asns"), F.coalesce("aliases", none).alias("aliases"))


def resolver_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _study(spark, sf_dir)
    return resolvers.verify(s.report(), _known_domains(spark, sf_dir, s))


def univariate_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.gaussian(_t(spark, sf_dir, "flows"), "s_bytes").select("row_id", "s_bytes")


def univariate_boxplot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.boxplot(_t(spark, sf_dir, "flows"), "s_bytes").select("row_id", "s_bytes")


def seasonal_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.seasonal_esd(series_tumbling(spark, sf_dir), "time", "bytes", period=24)


def density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all parts, one point each: its size and a twentieth of its price."""
    q = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 20).alias("y"))
    return clustering.dbscan(q, "id", eps=1.1, min_points=4, features=["x", "y"])


def density_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all clients of ``flows``, one point each: powers of ten of its flows and of its bytes."""
    total = F.sum(F.coalesce("c_bytes", F.lit(0)) + F.coalesce("s_bytes", F.lit(0)))
    clients = _t(spark, sf_dir, "flows").groupBy("c_ip").agg(F.log10(F.count(F.lit(1))).alias("x"), F.log10(1 + total).alias("y"))
    return clustering.dbscan(clients, "c_ip", eps=0.05, min_points=4, features=["x", "y"])


def feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _t(spark, sf_dir, "http")
    out = features.transform(h, "SELECT row_id, method, response_body_len FROM records", ["response_body_len"], ["method"])
    return out.select("row_id", F.transform(vector_to_array("features"), lambda x: F.round(x, 9)).alias("features"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


def cluster_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.kmeans(_vectors(spark, sf_dir)).select("vec_id", "prediction")


def cluster_bisecting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.bisecting_kmeans(_vectors(spark, sf_dir)).select("vec_id", "prediction")


def cluster_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    return clustering.gaussian_mixture(features.transform(c, None, ["c_acctbal", "c_nationkey"], [], normalize=False), k=3).select("c_custkey", "prediction")


_NAMES = """
    traffic_per_domain contacted_resolvers name_service_form name_site address_kinds address_networks http_url_parts series_tumbling service_bags service_rules service_flows service_report
    page_windows page_bags page_visits page_model page_report resolver_domains resolver_normality resolver_anomalies resolver_norms resolver_networks resolver_suspicious resolver_summary
    resolver_report resolver_verified univariate_gaussian univariate_boxplot seasonal_outliers density_clusters density_clients feature_vectors cluster_kmeans cluster_bisecting cluster_mixture"""
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: globals()[name] for name in _NAMES.split()}

_V4 = r"regexp_full_match({x}, '(0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]))(\.0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){{3}}')"
#: Groups of hexadecimal digits, with one run of them left out at most: eight in all, or fewer than eight and one "::".
_V6 = "(regexp_full_match(x, '([0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}') AND NOT contains(x, ':::') AND len(string_split(x, '::')) <= 2 AND (NOT starts_with(x, ':') OR starts_with(x, '::')) AND (NOT ends_with(x, ':') OR ends_with(x, '::')) AND (CASE WHEN contains(x, '::') THEN len(list_filter(string_split(x, ':'), lambda g: g <> '')) <= 7 ELSE len(string_split(x, ':')) = 8 END))"
_NUMBER = "(CAST(split_part({x}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({x}, '.', 2) AS BIGINT) * 65536 + CAST(split_part({x}, '.', 3) AS BIGINT) * 256 + CAST(split_part({x}, '.', 4) AS BIGINT))"
_ROUTES = "(VALUES " + ", ".join(f"({sum(int(b) << 8 * (3 - i) for i, b in enumerate(p.split('/')[0].split('.')))}, {p.split('/')[1]}, '{a}')" for p, a in PREFIXES) + ") AS p(net, bits, asn)"


def _network(addresses: str) -> str:
    """``x, asn`` of the distinct ``x`` that a query gives."""
    number = _NUMBER.format(x="x")
    return f"""(SELECT x, CASE WHEN NOT v4 OR x LIKE '127.0.%' THEN x ELSE coalesce((SELECT max_by(asn, bits) FROM {_ROUTES} WHERE n // (1 << (32 - bits)) = net // (1 << (32 - bits))),
        split_part(x, '.', 1) || '.' || split_part(x, '.', 2) || '.0.0') END AS asn FROM (SELECT x, {_V4.format(x="x")} AS v4, CASE WHEN {_V4.format(x="x")} THEN {number} END AS n FROM (SELECT DISTINCT x FROM ({addresses}))))"""


_F = f"f AS (SELECT row_id, c_ip, time_start AS t, coalesce({names.plain_form_sql('name')}, '-') AS name FROM flows)"


def _opened(gap: float) -> str:
    return f"""WITH {_F},
    a AS (SELECT *, coalesce(name IN ({_CORE_LIST}) AND t - lag(t) OVER (PARTITION BY c_ip ORDER BY t, row_id) > {gap}, false) AS trig FROM f),
    w AS (SELECT *, last_value(CASE WHEN trig THEN t END IGNORE NULLS) OVER k AS wt, last_value(CASE WHEN trig THEN name END IGNORE NULLS) OVER k AS wn, last_value(CASE WHEN trig THEN row_id END IGNORE NULLS) OVER k AS wr
        FROM a WINDOW k AS (PARTITION BY c_ip ORDER BY t, row_id ROWS UNBOUNDED PRECEDING)),
    occ AS (SELECT name AS core, count(*) AS windows FROM a WHERE trig GROUP BY 1)"""


_FORM = names.service_form_sql("name")
_BAGS = f"""{_opened(SERVICE.gap)},
    b AS (SELECT wn AS core, {_FORM} AS support, count(*) AS n FROM w WHERE NOT trig AND t - wt <= {SERVICE.observe} GROUP BY 1, 2),
    bags AS (SELECT b.core, support, n, windows FROM b JOIN occ ON b.core = occ.core)"""
_RULES = f"""{_BAGS},
    l AS (SELECT core, support, n / windows::DOUBLE AS share FROM bags WHERE n / windows::DOUBLE >= {SERVICE.min_share}),
    h AS (SELECT support, count(*) AS holders FROM l GROUP BY 1)
    SELECT core, l.support, round(share, 9) AS share, round(share * log10((SELECT count(DISTINCT core) FROM l) / holders::DOUBLE), 9) AS weight FROM l JOIN h ON l.support = h.support"""

_FINISHED = f"""{_opened(PAGE.gap)},
    o AS (SELECT c_ip, name AS core, t AS start, row_id, lead(t) OVER (PARTITION BY c_ip ORDER BY t, row_id) AS again FROM a WHERE trig),
    e AS (SELECT * FROM o WHERE start + {PAGE.window} < (SELECT max(t) FROM f) AND (again IS NULL OR again > start + {PAGE.window})),
    s AS (SELECT e.core, e.c_ip, e.start, e.row_id, {_FORM} AS support, min(w.t - e.start) AS delta FROM w JOIN e ON w.c_ip = e.c_ip AND w.wr = e.row_id
        WHERE NOT trig AND w.t - e.start <= {PAGE.window} GROUP BY ALL),
    n AS (SELECT core, count(*) AS windows FROM e GROUP BY 1),
    g AS (SELECT s.core, support, count(*) AS n, 100.0 * count(*) / any_value(windows) AS freq, avg(delta) AS avg_time, stddev_pop(delta) AS stdev_time FROM s JOIN n ON s.core = n.core GROUP BY 1, 2
        HAVING count(*) >= 2 AND 100.0 * count(*) / any_value(windows) >= {100 * PAGE.min_share})"""
_VISITS = f"""{_FINISHED.replace("WITH ", "WITH RECURSIVE ", 1)},
    v AS (SELECT c_ip, t, row_id, name AS core, row_number() OVER (PARTITION BY c_ip ORDER BY t, row_id) AS i FROM f WHERE name IN ({_CORE_LIST})),
    nx AS (SELECT x.c_ip, x.i, min(y.i) AS j FROM v AS x JOIN v AS y ON x.c_ip = y.c_ip AND y.t - x.t > {PAGE.window} GROUP BY 1, 2),
    gr AS (SELECT c_ip, i FROM v WHERE i = 1 UNION ALL SELECT gr.c_ip, nx.j FROM gr JOIN nx ON gr.c_ip = nx.c_ip AND gr.i = nx.i),
    op AS (SELECT v.c_ip, v.core, v.t AS start, v.row_id FROM v JOIN gr ON v.c_ip = gr.c_ip AND v.i = gr.i WHERE v.t + {PAGE.window} < (SELECT max(t) FROM f)),
    sn AS (SELECT op.core, op.c_ip, op.start, op.row_id, {_FORM} AS support, min(f.t - op.start) AS delta FROM op JOIN f ON f.c_ip = op.c_ip AND (f.t > op.start OR f.t = op.start AND f.row_id > op.row_id) AND f.t - op.start < {PAGE.window}
        JOIN g ON g.core = op.core AND g.support = {_FORM} GROUP BY ALL),
    rk AS (SELECT core, support, rank() OVER (PARTITION BY core, c_ip, start, row_id ORDER BY delta) - 1 AS b FROM sn),
    wt AS (SELECT core, support, CAST(sum(b) AS BIGINT) AS weight FROM rk GROUP BY 1, 2 HAVING sum(b) > 0),
    pl AS (SELECT *, row_number() OVER (PARTITION BY core ORDER BY weight, support) - 1 AS p, count(*) OVER (PARTITION BY core) AS n FROM wt),
    md AS (SELECT core, support, weight, CAST(CASE WHEN n < {PAGE.checkpoints} THEN p ELSE ((p + 1) * {PAGE.checkpoints} - 1) // n END + 1 AS INT) AS checkpoint FROM pl)"""

_HIJACKED = """h AS (SELECT * REPLACE (CASE WHEN s_ip LIKE '%.2' AND len(answers) > 0 THEN ['100.127.0.' || (length(query) % 4)::VARCHAR] ELSE answers END AS answers,
        CASE WHEN s_ip LIKE '%.2' AND len(answers) > 0 THEN [length(query)::BIGINT % 2 + 86400] ELSE answer_ttls END AS answer_ttls) FROM dns)"""
_DNS = f"""WITH {_HIJACKED}, d AS (SELECT row_id, c_ip, s_ip AS resolver, lower(query) AS fqdn, list_distinct(list_filter(coalesce(answers, []), lambda x: x IS NOT NULL AND {_V4.format(x="x")})) AS ad,
        len(list_filter(coalesce(answers, []), lambda x: x IS NULL OR NOT {_V4.format(x="x")})) AS clen, list_filter(coalesce(answer_ttls, []), lambda x: x IS NOT NULL) AS ttls
        FROM h WHERE resp_code = 'NOERROR' AND flags_resp & 4 <> 0 AND flags_resp & 8 <> 0),
    ad AS (SELECT row_id, unnest(ad) AS x FROM d), nets AS (SELECT * FROM {_network("SELECT x FROM ad")}),
    u AS (SELECT * FROM d WHERE len(ad) > 0),
    hd AS (SELECT resolver, fqdn, feature, value, count(*) AS cnt FROM (
        SELECT resolver, fqdn, 'n' AS feature, '' AS value FROM u UNION ALL SELECT resolver, fqdn, 'clen', CAST(clen AS VARCHAR) FROM u UNION ALL SELECT resolver, fqdn, 'nip', CAST(len(ad) AS VARCHAR) FROM u
        UNION ALL SELECT resolver, fqdn, 'ttl', CAST(unnest(ttls) AS VARCHAR) FROM u UNION ALL SELECT resolver, fqdn, 'sip', unnest(ad) FROM u
        UNION ALL SELECT resolver, fqdn, 'asn', asn FROM u JOIN ad ON u.row_id = ad.row_id JOIN nets ON ad.x = nets.x) WHERE fqdn IS NOT NULL GROUP BY ALL),
    kn AS (SELECT fqdn FROM hd WHERE feature = 'n' GROUP BY 1 HAVING sum(cnt) > {MIN_RESOLUTIONS}),
    tp AS (SELECT fqdn, resolver, ceil(max(CAST(value AS BIGINT)) / 5.0) * 5 AS top FROM hd WHERE feature = 'ttl' AND fqdn IN (FROM kn) GROUP BY 1, 2),
    ov AS (SELECT fqdn, feature, value, CAST(sum(cnt) AS BIGINT) AS cnt FROM hd WHERE feature IN ('clen', 'nip', 'asn') GROUP BY 1, 2, 3),
    st AS (SELECT *, row_number() OVER (PARTITION BY fqdn, feature ORDER BY cnt DESC, value) - 1 AS i, sum(cnt) OVER (PARTITION BY fqdn, feature ORDER BY cnt DESC, value ROWS UNBOUNDED PRECEDING) AS upto, sum(cnt) OVER (PARTITION BY fqdn, feature) AS al
        FROM ov WHERE fqdn IN (FROM kn)),
    qu AS (SELECT fqdn, feature, min_by(i + (al / 4.0 - (upto - cnt)) / cnt, i) FILTER (WHERE upto * 4 >= al) AS q1, min_by(i + (al * 3 / 4.0 - (upto - cnt)) / cnt, i) FILTER (WHERE upto * 4 >= al * 3) AS q3 FROM st GROUP BY 1, 2),
    no AS (SELECT fqdn, 'ttl' AS feature, quantile_cont(top, 0.75) + 1.5 * (quantile_cont(top, 0.75) - quantile_cont(top, 0.15)) AS threshold FROM tp GROUP BY 1
        UNION ALL SELECT qu.fqdn, qu.feature, CAST(coalesce(st.cnt, 0) AS DOUBLE) FROM qu LEFT JOIN st ON st.fqdn = qu.fqdn AND st.feature = qu.feature AND st.i = floor(q3 + 1.5 * (q3 - q1))),
    fl AS (SELECT hd.resolver, hd.fqdn, hd.feature FROM hd JOIN no ON hd.fqdn = no.fqdn AND hd.feature = no.feature LEFT JOIN ov ON ov.fqdn = hd.fqdn AND ov.feature = hd.feature AND ov.value = hd.value
        GROUP BY 1, 2, 3 HAVING bool_and(CASE WHEN hd.feature = 'ttl' THEN TRY_CAST(hd.value AS BIGINT) > threshold ELSE ov.cnt < threshold END)),
    an AS (SELECT resolver, fqdn, string_agg(feature, ':' ORDER BY feature) AS type FROM fl GROUP BY 1, 2),
    np AS (SELECT asn, {names.site_sql("fqdn")} AS sld, count(*) AS cnt FROM d JOIN ad ON d.row_id = ad.row_id JOIN nets ON ad.x = nets.x
        WHERE fqdn IS NOT NULL AND NOT EXISTS (SELECT 1 FROM an WHERE an.resolver IS NOT DISTINCT FROM d.resolver AND an.fqdn = d.fqdn) GROUP BY 1, 2),
    nm AS (SELECT 'pairs' AS measure, cnt AS x FROM np UNION ALL SELECT 'slds', count(*) FROM np GROUP BY asn),
    ra AS (SELECT DISTINCT u.row_id, resolver, fqdn, clen, len(ad) AS nip, ttls, asn FROM u JOIN ad ON u.row_id = ad.row_id JOIN nets ON ad.x = nets.x),
    hn AS (SELECT resolver, asn, feature, value, count(*) AS cnt FROM (SELECT resolver, asn, 'n' AS feature, '' AS value FROM ra UNION ALL SELECT resolver, asn, 'query', fqdn FROM ra UNION ALL SELECT resolver, asn, 'cname', CAST(clen AS VARCHAR) FROM ra
        UNION ALL SELECT resolver, asn, 'nip', CAST(nip AS VARCHAR) FROM ra UNION ALL SELECT resolver, asn, 'ttl', CAST(unnest(ttls) AS VARCHAR) FROM ra
        UNION ALL SELECT resolver, asn, 'server', ad.x FROM u JOIN ad ON u.row_id = ad.row_id JOIN nets ON ad.x = nets.x) GROUP BY ALL),
    sm AS (SELECT d.resolver, count(*) AS count, count(DISTINCT c_ip) AS clients, count(DISTINCT fqdn) AS queried_domains,
        (SELECT count(DISTINCT ad.x) FROM d AS e JOIN ad ON e.row_id = ad.row_id WHERE e.resolver IS NOT DISTINCT FROM d.resolver) AS servers,
        (SELECT count(DISTINCT asn) FROM d AS e JOIN ad ON e.row_id = ad.row_id JOIN nets ON nets.x = ad.x WHERE e.resolver IS NOT DISTINCT FROM d.resolver) AS asns FROM d GROUP BY d.resolver),
    fx AS (SELECT resolver, asn, list(feature ORDER BY feature) AS fixed FROM (SELECT resolver, asn, feature FROM hn WHERE feature IN ('ttl', 'cname', 'nip') GROUP BY ALL HAVING count(*) = 1) GROUP BY 1, 2),
    sl AS (SELECT resolver, asn, sum(cnt) FILTER (WHERE feature = 'n') AS n, count(DISTINCT {names.site_sql("value")}) FILTER (WHERE feature = 'query') AS slds FROM hn WHERE feature IN ('n', 'query') GROUP BY 1, 2),
    su AS (SELECT sl.resolver, q.fqdn, sl.asn, v.value AS server, array_to_string(fixed, ':') AS fixed_features FROM sl JOIN fx ON sl.resolver IS NOT DISTINCT FROM fx.resolver AND sl.asn = fx.asn
        JOIN (SELECT DISTINCT resolver, asn, value AS fqdn FROM hn WHERE feature = 'query' AND value IS NOT NULL) AS q ON q.resolver IS NOT DISTINCT FROM sl.resolver AND q.asn = sl.asn
        JOIN an ON an.resolver IS NOT DISTINCT FROM sl.resolver AND an.fqdn = q.fqdn
        JOIN (SELECT resolver, asn, value FROM hn WHERE feature = 'server') AS v ON v.resolver IS NOT DISTINCT FROM sl.resolver AND v.asn = sl.asn
        WHERE len(fixed) > 1 AND slds > (SELECT quantile_cont(x, 0.5) FROM nm WHERE measure = 'slds') AND n / slds > (SELECT quantile_cont(x, 0.5) FROM nm WHERE measure = 'pairs'))"""

SQL = {
    "traffic_per_domain": "SELECT name AS domain, CAST(sum(coalesce(s_bytes, 0) + coalesce(c_bytes, 0)) AS BIGINT) AS bytes FROM flows GROUP BY name ORDER BY bytes DESC, domain NULLS LAST LIMIT 50",
    "contacted_resolvers": "SELECT s_ip AS resolver, count(*) AS queries FROM dns GROUP BY s_ip ORDER BY queries DESC, resolver NULLS LAST LIMIT 50",
    "name_service_form": f"SELECT DISTINCT name, {_FORM} AS form FROM flows",
    "name_site": f"""SELECT DISTINCT fqdn, array_to_string(list_slice(string_split(bare, '.'), -2, -1), '.') AS second, array_to_string(list_slice(string_split(bare, '.'), -3, -1), '.') AS third, {names.site_sql("fqdn")} AS site
        FROM (SELECT lower(query) AS fqdn, regexp_replace(lower(query), '[.]$', '') AS bare FROM dns WHERE query IS NOT NULL AND query <> '')""",
    "address_kinds": f"SELECT x, v4, {_V6} AS v6, v4 OR {_V6} AS any FROM (SELECT DISTINCT x, {_V4.format(x='x')} AS v4 FROM (SELECT unnest(answers) AS x FROM dns UNION ALL SELECT c_ip FROM flows) WHERE x IS NOT NULL)",
    "address_networks": f"SELECT * FROM {_network('SELECT unnest(answers) AS x FROM dns')} WHERE x IS NOT NULL",
    "http_url_parts": """WITH h AS (SELECT row_id, method, host, path, s_port FROM http)
        SELECT row_id, CASE WHEN method = 'CONNECT' THEN CASE WHEN host IS NOT NULL AND s_port IS NOT NULL THEN host END WHEN method IS NULL OR method <> 'CONNECT' THEN host END AS host,
        CASE WHEN method = 'CONNECT' THEN CASE WHEN host IS NOT NULL AND s_port IS NOT NULL THEN s_port END WHEN host IS NOT NULL THEN 80 END AS port,
        CASE WHEN (method IS NULL OR method <> 'CONNECT') AND host IS NOT NULL THEN coalesce(path, '/') END AS path FROM h""",
    "series_tumbling": "SELECT floor(time_start / 3600) * 3600.0 AS time, CAST(sum(coalesce(s_bytes, 0)) AS BIGINT) AS bytes, count(*) AS flows FROM flows GROUP BY 1",
    "service_bags": f"{_BAGS} SELECT * FROM bags",
    "service_rules": _RULES,
    "page_windows": f"{_FINISHED} SELECT core, c_ip, start, support, round(delta, 6) AS delta FROM s",
    "page_bags": f"{_FINISHED} SELECT core, support, n, round(freq, 6) AS freq, round(avg_time, 4) AS avg_time, round(stdev_time, 4) AS stdev_time FROM g",
    "page_visits": f"{_VISITS} SELECT op.core, op.c_ip, op.start, op.row_id, support, round(delta, 6) AS delta FROM op LEFT JOIN sn ON sn.row_id = op.row_id WHERE op.core IS NOT NULL",
    "page_model": f"{_VISITS} SELECT * FROM md",
    "page_report": f"""{_VISITS} SELECT op.start AS time, op.c_ip, op.core AS page, {", ".join(f"round(max(delta) FILTER (WHERE checkpoint = {i}), 6) AS cp_{i}" for i in range(1, PAGE.checkpoints + 1))}
        FROM op LEFT JOIN sn ON sn.row_id = op.row_id LEFT JOIN md ON md.core = op.core AND md.support = sn.support WHERE op.core IN (SELECT core FROM md) GROUP BY op.start, op.c_ip, op.core, op.row_id""",
    "resolver_domains": f"{_DNS} SELECT * FROM hd",
    "resolver_normality": f"{_DNS} SELECT fqdn, feature, round(threshold, 6) AS threshold FROM no",
    "resolver_anomalies": f"{_DNS} SELECT * FROM an",
    "resolver_norms": f"{_DNS} SELECT measure, " + ", ".join(f"quantile_cont(x, {p}) AS {n}" for n, p in (("min", 0), ("p5", 0.05), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95), ("max", 1))) + " FROM nm GROUP BY measure",
    "resolver_networks": f"{_DNS} SELECT * FROM hn",
    "resolver_suspicious": f"{_DNS} SELECT * FROM su",
    "resolver_summary": f"{_DNS} SELECT * FROM sm",
    "resolver_report": f"""{_DNS} SELECT sm.resolver, queried_domains, count, clients, coalesce(asn, '-') AS asn, coalesce(string_agg(DISTINCT fqdn, ':' ORDER BY fqdn), '-') AS domains, coalesce(string_agg(DISTINCT server, ':' ORDER BY server), '-') AS servers
        FROM sm LEFT JOIN su ON sm.resolver IS NOT DISTINCT FROM su.resolver GROUP BY 1, 2, 3, 4, 5""",
    "resolver_verified": f"""{_DNS}, rp AS (SELECT sm.resolver, queried_domains, count, clients, coalesce(asn, '-') AS asn, coalesce(string_agg(DISTINCT fqdn, ':' ORDER BY fqdn), '-') AS domains, coalesce(string_agg(DISTINCT server, ':' ORDER BY server), '-') AS servers
        FROM sm LEFT JOIN su ON sm.resolver IS NOT DISTINCT FROM su.resolver GROUP BY 1, 2, 3, 4, 5),
        ka AS (SELECT fqdn, value AS asn FROM hd WHERE feature = 'asn' GROUP BY 1, 2 HAVING count(DISTINCT resolver) >= 2),
        kc AS (SELECT lower(query) AS fqdn, bool_or(regexp_matches(lower(x), '(^|[.])(edge-[^.]*|akamaiedge|edgekey|akamai|edgesuite|akadns)([.]|$)')) AS cdn FROM (SELECT query, unnest(answers) AS x FROM h)
            WHERE x IS NOT NULL AND NOT {_V4.format(x="x")} AND NOT contains(x, ':') GROUP BY 1),
        ju AS (SELECT su.resolver, su.asn, bool_or(ka.asn IS NOT NULL) AS known, bool_and(coalesce(cdn, false)) AS cdn FROM (SELECT DISTINCT resolver, asn, fqdn FROM su) AS su
            LEFT JOIN ka ON ka.fqdn = su.fqdn AND ka.asn = su.asn LEFT JOIN kc ON kc.fqdn = su.fqdn GROUP BY 1, 2)
        SELECT rp.*, CASE WHEN known THEN 'Verified.' WHEN cdn THEN 'CDN.' ELSE '' END AS hint FROM rp LEFT JOIN ju ON ju.resolver IS NOT DISTINCT FROM rp.resolver AND ju.asn = rp.asn""",
    "feature_vectors": """WITH h AS (SELECT row_id, coalesce(method, '__NA__') AS m, coalesce(response_body_len, 0)::DOUBLE AS x FROM http),
        k AS (SELECT m, row_number() OVER (ORDER BY count(*) DESC, m) - 1 AS i, count(*) OVER () AS n FROM h GROUP BY m),
        v AS (SELECT row_id, list_concat([x], list_transform(range(n - 1), lambda j: CASE WHEN j = i THEN 1.0 ELSE 0.0 END::DOUBLE)) AS f FROM h JOIN k ON h.m = k.m),
        w AS (SELECT row_id, f, sqrt(list_sum(list_transform(f, lambda e: e * e))) AS norm FROM v)
        SELECT row_id, list_transform(f, lambda e: round(CASE WHEN norm > 0 THEN e / norm ELSE e END, 9)) AS features FROM w""",
    "univariate_gaussian": "WITH m AS (SELECT avg(s_bytes) AS m, stddev_pop(s_bytes) AS s FROM flows) SELECT row_id, s_bytes FROM flows, m WHERE s_bytes > m + 3 * s OR s_bytes < m - 3 * s",
    "univariate_boxplot": "WITH m AS (SELECT quantile_disc(s_bytes, 0.25) AS a, quantile_disc(s_bytes, 0.75) AS b FROM flows) SELECT row_id, s_bytes FROM flows, m WHERE s_bytes > b + 3 * (b - a) OR s_bytes < a - 3 * (b - a)",
    "density_clusters": """WITH RECURSIVE p AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice / 20 AS y FROM part),
        n AS (SELECT a.id AS a, b.id AS b FROM p AS a, p AS b WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 1.1),
        c AS (SELECT a AS id FROM n GROUP BY a HAVING count(*) >= 4),
        r AS (SELECT id, id AS to_id FROM c UNION SELECT r.id, n.b FROM r JOIN n ON n.a = r.to_id JOIN c ON c.id = n.b),
        l AS (SELECT id, min(to_id) AS least FROM r GROUP BY id), k AS (SELECT id, dense_rank() OVER (ORDER BY least) - 1 AS no FROM l),
        o AS (SELECT n.a AS id, min(k.no) AS no FROM n JOIN k ON n.b = k.id GROUP BY 1)
        SELECT p.id, x, y, CAST(coalesce(k.no, o.no, -1) AS INT) AS prediction FROM p LEFT JOIN k ON k.id = p.id LEFT JOIN o ON o.id = p.id""",
}
