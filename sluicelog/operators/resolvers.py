"""Resolvers whose answers differ from what others answer, in stages that each give a table.

Only answered recursive look-ups count: code NOERROR with recursion desired and
available. Histograms are kept as rows (key, feature, value, count), so they
are summed in the map tasks and never gathered into one value. Unlike the
addresses, times to live, chain lengths and address counts take few values a
domain, which bounds the windows over them.
"""

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ip
from ..functions.names import SUFFIXES, site
from ..workdir import materialize

RECURSION_AVAILABLE, RECURSION_DESIRED = 0x04, 0x08
TTL_STEP = 5
#: Labels in names of content delivery networks.
CDN_LABELS = ("akamaiedge", "edgekey", "akamai", "edgesuite", "akadns")


def answered(dns: DataFrame) -> DataFrame:
    """Rows of answered recursive look-ups: ``c_ip, resolver, fqdn`` (lower case), ``addresses`` (different IPv4 answers), ``clen`` (other answers), ``nip``, ``ttls``."""
    has = lambda bit: F.col("flags_resp").bitwiseAND(F.lit(bit).cast("long")) != 0
    kept = dns.where((F.col("resp_code") == "NOERROR") & has(RECURSION_AVAILABLE) & has(RECURSION_DESIRED))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    checked = kept.select(
        "c_ip", F.col("s_ip").alias("resolver"), F.lower("query").alias("fqdn"), F.coalesce("answers", none("string")).alias("_all"), F.coalesce(F.filter("answers", ip.is_ipv4), none("string")).alias("_v4"),
        F.coalesce(F.filter("answer_ttls", lambda x: x.isNotNull()), none("bigint")).alias("ttls"),
    )
    sized = checked.select("c_ip", "resolver", "fqdn", F.array_distinct("_v4").alias("addresses"), (F.size("_all") - F.size("_v4")).cast("long").alias("clen"), "ttls")
    return sized.select("c_ip", "resolver", "fqdn", "addresses", "clen", F.size("addresses").cast("long").alias("nip"), "ttls")


def networks(rows: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``address, asn`` of all different answered addresses."""
    return ip.network_names(rows.select(F.explode("addresses").alias("address")), "address", prefixes)


def by_domain(rows: DataFrame, nets: DataFrame) -> DataFrame:
    """Histograms ``resolver, fqdn, feature, value, cnt`` of look-ups with addresses.

    Features: ``n`` (look-ups, value empty), ``clen``, ``nip``, ``ttl``, ``sip``
    and ``asn`` (one for each answered address).
    """
    useful = rows.where((F.col("nip") > 0) & F.col("fqdn").isNotNull())
    cell = lambda name, value: F.struct(F.lit(name).alias("feature"), value.cast("string").alias("value"))
    one = F.array(cell("n", F.lit("")), cell("clen", F.col("clen")), cell("nip", F.col("nip")))
    cells = F.concat(one, F.transform("ttls", lambda x: cell("ttl", x)), F.transform("addresses", lambda x: cell("sip", x)))
    flat = useful.select("resolver", "fqdn", F.explode(cells).alias("c")).groupBy("resolver", "fqdn", "c.feature", "c.value").agg(F.count(F.lit(1)).alias("cnt"))
    asn = flat.where("feature = 'sip'").join(nets, F.col("value") == F.col("address")).groupBy("resolver", "fqdn", F.lit("asn").alias("feature"), F.col("asn").alias("value")).agg(F.sum("cnt").alias("cnt"))
    return flat.unionByName(asn)


def rare_below(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, threshold``: values with a smaller count are rare.

    Counts are ranked downwards. The rank at which a share f of all is reached,
    with a fraction inside the step, gives the quartiles; from three quarters
    and half as much again of their distance on, ranks are rare. The threshold
    is the count at that rank, 0 if there is none that far.
    """
    ranked = Window.partitionBy(*keys).orderBy(F.col("cnt").desc(), "value")
    whole = Window.partitionBy(*keys)
    steps = histogram.select(
        *keys, "cnt", (F.row_number().over(ranked) - 1).alias("_i"), F.sum("cnt").over(ranked.rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"), F.sum("cnt").over(whole).alias("_all")
    )

    def quartile(numerator: int) -> Column:
        reached = F.col("_upto") * 4 >= F.col("_all") * numerator
        at = F.col("_i") + (F.col("_all") * numerator / 4.0 - (F.col("_upto") - F.col("cnt"))) / F.col("cnt")
        return F.min(F.when(reached, F.struct(F.col("_i"), at.alias("q"))))["q"]

    bound = steps.groupBy(*keys).agg(quartile(1).alias("_q1"), quartile(3).alias("_q3"))
    edge = bound.select(*keys, F.floor(F.col("_q3") + 1.5 * (F.col("_q3") - F.col("_q1"))).alias("_edge"))
    at_edge = steps.join(edge, keys).where(F.col("_i") == F.col("_edge")).select(*keys, F.col("cnt").alias("_cnt"))
    return edge.join(at_edge, keys, "left").select(*keys, F.coalesce("_cnt", F.lit(0)).alias("threshold"))


def normality(hist: DataFrame, min_resolutions: int = 50) -> DataFrame:
    """``fqdn, feature, threshold`` of domains with more than ``min_resolutions`` look-ups.

    For ``ttl`` it is a ceiling: of the resolvers' greatest times, rounded up to
    steps of five, the 75th percentile and one and a half times its distance
    from the 15th. For ``clen``, ``nip`` and ``asn`` it is the least count that
    is not rare.
    """
    known = hist.where("feature = 'n'").groupBy("fqdn").agg(F.sum("cnt").alias("_n")).where(F.col("_n") > min_resolutions).select("fqdn")
    mine = hist.join(known, "fqdn", "left_semi")
    longest = mine.where("feature = 'ttl'").groupBy("fqdn", "resolver").agg((F.ceil(F.max(F.col("value").cast("bigint")) / TTL_STEP) * TTL_STEP).alias("top"))
    ranks = longest.groupBy("fqdn").agg(F.percentile("top", F.array(F.lit(0.15), F.lit(0.75))).alias("p"))
    ttl = ranks.select("fqdn", F.lit("ttl").alias("feature"), (F.col("p")[1] + 1.5 * (F.col("p")[1] - F.col("p")[0])).alias("threshold"))
    overall = mine.where("feature IN ('clen', 'nip', 'asn')").groupBy("fqdn", "feature", "value").agg(F.sum("cnt").alias("cnt"))
    return ttl.unionByName(rare_below(overall, ["fqdn", "feature"]).withColumn("threshold", F.col("threshold").cast("double")))


def domain_anomalies(hist: DataFrame, normal: DataFrame) -> DataFrame:
    """``resolver, fqdn, type``: the features (joined by ``:``) in which all that a resolver answered for a domain is out of the normal."""
    overall = hist.where("feature IN ('clen', 'nip', 'asn')").groupBy("fqdn", "feature", "value").agg(F.sum("cnt").alias("_overall"))
    local = hist.where("feature IN ('ttl', 'clen', 'nip', 'asn')").join(normal, ["fqdn", "feature"]).join(overall, ["fqdn", "feature", "value"], "left")
    odd = F.when(F.col("feature") == "ttl", F.col("value").try_cast("bigint") > F.col("threshold")).otherwise(F.col("_overall") < F.col("threshold"))
    flags = local.groupBy("resolver", "fqdn", "feature").agg(F.bool_and(odd).alias("_odd")).where("_odd")
    return flags.groupBy("resolver", "fqdn").agg(F.concat_ws(":", F.array_sort(F.collect_list("feature"))).alias("type"))


def _normal_pairs(rows: DataFrame, nets: DataFrame, anomalies: DataFrame, suffixes: list[str]) -> DataFrame:
    bad = anomalies.select(F.col("resolver").alias("_r"), F.col("fqdn").alias("_d"))
    fine = rows.join(bad, F.col("resolver").eqNullSafe(F.col("_r")) & (F.col("fqdn") == F.col("_d")), "left_anti").where("fqdn IS NOT NULL")
    each = fine.select(site(F.col("fqdn"), suffixes).alias("sld"), F.explode("addresses").alias("address")).groupBy("sld", "address").agg(F.count(F.lit(1)).alias("cnt"))
    return each.join(nets, "address").groupBy("asn", "sld").agg(F.sum("cnt").alias("cnt"))


def network_norms(rows: DataFrame, nets: DataFrame, anomalies: DataFrame, suffixes: list[str] = SUFFIXES) -> DataFrame:
    """``measure, min, p5, p25, p50, p75, p95, max``: over networks, how many sites each serves (``slds``) and how many answered addresses per network and site (``pairs``); anomalous resolver-domain pairs left out."""
    pairs = _normal_pairs(rows, nets, anomalies, suffixes)
    counts = pairs.groupBy("asn").agg(F.count(F.lit(1)).alias("x")).select(F.lit("slds").alias("measure"), "x").unionByName(pairs.select(F.lit("pairs").alias("measure"), F.col("cnt").alias("x")))
    shares = {"min": 0.0, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "max": 1.0}
    ranks = counts.groupBy("measure").agg(F.percentile("x", F.array(*map(F.lit, shares.values()))).alias("p"))
    return ranks.select("measure", *[F.col("p")[i].alias(n) for i, n in enumerate(shares)])


def by_network(rows: DataFrame, nets: DataFrame) -> DataFrame:
    """Histograms ``resolver, asn, feature, value, cnt`` of responses with addresses in a network: ``n``, ``query``, ``cname``, ``ttl``, ``nip``, ``server`` (addresses of that network)."""
    alike = ["resolver", "fqdn", "clen", "nip", "ttls", "addresses"]
    # a response is known by a number from here on; written, it stays the same
    responses = materialize(rows.where("nip > 0").groupBy(*alike).agg(F.count(F.lit(1)).alias("times")).withColumn("_no", F.monotonically_increasing_id()), "responses")
    hosts = responses.select("_no", F.explode("addresses").alias("address")).join(nets, "address")
    # a list holds no more than one response's addresses
    inside = hosts.groupBy("_no", "asn").agg(F.collect_list("address").alias("inside"))
    per_response = responses.join(inside, "_no")
    cell = lambda name, value: F.struct(F.lit(name).alias("feature"), value.cast("string").alias("value"))
    cells = F.concat(
        F.array(cell("n", F.lit("")), cell("query", F.col("fqdn")), cell("cname", F.col("clen")), cell("nip", F.col("nip"))), F.transform("ttls", lambda x: cell("ttl", x)), F.transform("inside", lambda x: cell("server", x))
    )
    return per_response.select("resolver", "asn", "times", F.explode(cells).alias("c")).groupBy("resolver", "asn", "c.feature", "c.value").agg(F.sum("times").alias("cnt"))


def network_anomalies(hist: DataFrame, norms: DataFrame, anomalies: DataFrame, suffixes: list[str] = SUFFIXES) -> DataFrame:
    """``resolver, fqdn, asn, server, fixed_features`` of suspicious (resolver, network) pairs, for domains that are anomalous too.

    A pair is suspicious if it serves more sites than the median network, with
    more responses a site than the median pair, and at least two of the times
    to live, chain lengths and address counts never vary. One row a domain and
    server; ``summary`` gathers them.
    """
    key = ["resolver", "asn"]
    n = hist.where("feature = 'n'").groupBy(*key).agg(F.sum("cnt").alias("_n"))
    slds = hist.where("feature = 'query' AND value IS NOT NULL").select(*key, site(F.col("value"), suffixes).alias("_sld")).distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("_slds"))
    fixed = hist.where("feature IN ('ttl', 'cname', 'nip')").groupBy(*key, "feature").agg(F.count(F.lit(1)).alias("_values")).where("_values = 1")
    fixed = fixed.groupBy(*key).agg(F.array_sort(F.collect_list("feature")).alias("_fixed")).where(F.size("_fixed") > 1)
    median = norms.agg(F.max(F.when(F.col("measure") == "slds", F.col("p50"))).alias("s"), F.max(F.when(F.col("measure") == "pairs", F.col("p50"))).alias("p"))
    least_slds, least_ratio = median.select("s").scalar(), median.select("p").scalar()
    same = lambda a, b: F.col(f"{a}.resolver").eqNullSafe(F.col(f"{b}.resolver")) & (F.col(f"{a}.asn") == F.col(f"{b}.asn"))
    found = n.alias("n").join(slds.alias("s"), same("n", "s")).join(fixed.alias("f"), same("n", "f"))
    found = found.where((F.col("_slds") > least_slds) & (F.col("_n") / F.col("_slds") > least_ratio)).select("n.resolver", "n.asn", F.concat_ws(":", "_fixed").alias("fixed_features"))
    domains = hist.where("feature = 'query' AND value IS NOT NULL").select(*key, F.lower("value").alias("fqdn")).distinct()
    servers = hist.where("feature = 'server'").select(*key, F.col("value").alias("server"))
    named = found.alias("x").join(domains.alias("d"), same("x", "d")).select("x.*", "d.fqdn")
    bad = anomalies.select(F.col("resolver").alias("_r"), F.col("fqdn").alias("_d"))
    named = named.join(bad, F.col("resolver").eqNullSafe(F.col("_r")) & (F.col("fqdn") == F.col("_d")), "left_semi")
    return named.alias("x").join(servers.alias("v"), same("x", "v")).select("x.resolver", "x.fqdn", "x.asn", "v.server", "x.fixed_features")


def resolver_summary(rows: DataFrame, nets: DataFrame) -> DataFrame:
    """``resolver, count, clients, queried_domains, servers, asns``: look-ups and different values of each resolver."""
    key = F.col("resolver")
    base = rows.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    cells = F.concat(
        F.array(F.struct(F.lit("clients").alias("f"), F.col("c_ip").alias("v")), F.struct(F.lit("queried_domains").alias("f"), F.col("fqdn").alias("v"))), F.transform("addresses", lambda x: F.struct(F.lit("servers").alias("f"), x.alias("v")))
    )
    values = rows.select(key, F.explode(cells).alias("c")).select(key, "c.f", "c.v").where("v IS NOT NULL").distinct()
    asns = values.where("f = 'servers'").join(nets, F.col("v") == F.col("address")).select(key, F.lit("asns").alias("f"), F.col("asn").alias("v")).distinct()
    kinds = ("clients", "queried_domains", "servers", "asns")
    counts = values.unionByName(asns).groupBy(key).agg(*[F.count_if(F.col("f") == k).alias(k) for k in kinds])
    joined = base.alias("b").join(counts.alias("c"), F.col("b.resolver").eqNullSafe(F.col("c.resolver")), "left")
    return joined.select("b.resolver", "b.count", *[F.coalesce(f"c.{k}", F.lit(0)).alias(k) for k in kinds])


def final_report(summary: DataFrame, suspicious: DataFrame) -> DataFrame:
    """``resolver, queried_domains, count, clients, asn, domains, servers``: every resolver, with its suspicious networks' domains and servers (joined by ``:``); ``-`` where there are none."""
    found = suspicious.select(F.col("resolver").alias("_r"), F.col("asn").cast("string").alias("asn"), "fqdn", "server")
    joined = summary.join(found, F.col("resolver").eqNullSafe(F.col("_r")), "left")
    text = lambda c: F.coalesce(F.nullif(F.concat_ws(":", F.array_sort(F.collect_set(c))), F.lit("")), F.lit("-"))
    grouped = joined.groupBy("resolver", "queried_domains", "count", "clients", F.coalesce("asn", F.lit("-")).alias("asn")).agg(text("fqdn").alias("domains"), text("server").alias("servers"))
    return grouped.orderBy(F.col("queried_domains").desc(), "asn", "resolver")


def verify(report: DataFrame, known: DataFrame) -> DataFrame:
    """``report`` with ``hint``, from a table that the user supplies.

    ``known`` has ``domain, asns`` (networks known to serve it) and ``aliases``
    (names it is an alias of). ``Verified.`` if the row's network is one of
    those of its domains; else ``CDN.`` if every domain has an alias with the
    label of a content delivery network; else empty.
    """
    domains = report.where("domains != '-'").select("resolver", "asn", F.explode(F.split("domains", ":")).alias("domain"))
    labels = F.flatten(F.transform("aliases", lambda a: F.split(F.lower(a), r"\.")))
    facts = known.select("domain", "asns", F.arrays_overlap(labels, F.array(*map(F.lit, CDN_LABELS))).alias("_cdn"))
    judged = domains.join(facts, "domain", "left").groupBy("resolver", "asn").agg(
        F.bool_or(F.coalesce(F.array_contains("asns", F.col("asn")), F.lit(False))).alias("_known"), F.bool_and(F.coalesce("_cdn", F.lit(False))).alias("_all_cdn")
    )
    same = F.col("r.resolver").eqNullSafe(F.col("j.resolver")) & (F.col("r.asn") == F.col("j.asn"))
    hint = F.when(F.col("_known"), "Verified.").when(F.col("_all_cdn"), "CDN.").otherwise("")
    return report.alias("r").join(judged.alias("j"), same, "left").select("r.*", hint.alias("hint"))


class Study:
    """All stages over one DNS table; ``prefixes`` has ``prefix, asn``.

    A stage is planned when first asked for. Those that several others read
    (answered look-ups, networks, domain histograms, anomalies) are written once
    to the shared folder, so answers are judged once and the table is scanned once.
    """

    def __init__(self, dns: DataFrame, prefixes: DataFrame, min_resolutions: int = 50, suffixes: list[str] = SUFFIXES):
        self.dns, self.prefixes, self.min_resolutions, self.suffixes = dns, prefixes, min_resolutions, suffixes

    @cached_property
    def rows(self) -> DataFrame:
        return materialize(answered(self.dns), "answered")

    @cached_property
    def nets(self) -> DataFrame:
        return materialize(networks(self.rows, self.prefixes), "networks")

    @cached_property
    def domains(self) -> DataFrame:
        return materialize(by_domain(self.rows, self.nets), "domains")

    @cached_property
    def normal(self) -> DataFrame:
        return normality(self.domains, self.min_resolutions)

    @cached_property
    def anomalies(self) -> DataFrame:
        return materialize(domain_anomalies(self.domains, self.normal), "anomalies")

    @cached_property
    def norms(self) -> DataFrame:
        return network_norms(self.rows, self.nets, self.anomalies, self.suffixes)

    @cached_property
    def networks(self) -> DataFrame:
        return by_network(self.rows, self.nets)

    @cached_property
    def suspicious(self) -> DataFrame:
        return network_anomalies(materialize(self.networks, "histograms"), materialize(self.norms, "norms"), self.anomalies, self.suffixes)

    @cached_property
    def summary(self) -> DataFrame:
        return resolver_summary(self.rows, self.nets)

    def report(self) -> DataFrame:
        """The last stage."""
        return final_report(self.summary, self.suspicious)
