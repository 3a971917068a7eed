"""Analytics against state machines written from their description, on random and edge cases."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from sluicelog.functions import ip, misc, names
from sluicelog.operators import anomaly, attribution, clustering, features, pageload, resolvers, windows
from sluicelog.plans import analytics

CORES = ["aa.it", "bb.it"]
ORDER = ("time_start", "row_id")


def trace(seed, n=300, clients=3):
    rng = random.Random(seed)
    pool = ["aa.it", "bb.it", "xx.net", "yy.net", "zz.net", "-"]
    return [(i, rng.choice([f"c{k}" for k in range(clients)]), float(rng.randint(0, 1500)), rng.choice(pool), float(rng.choice([0, 1, 40]))) for i in range(n)]


def flows(spark, rows):
    return spark.createDataFrame([(i, c, t, t + length, n, 10, 1, "s", 1, 1) for i, c, t, n, length in rows], "row_id long, c_ip string, time_start double, time_end double, name string, c_bytes long, s_bytes long, s_ip string, c_port long, s_port long")


def machine(rows, gap, length):
    """Windows and bag counts by scanning all flows in time order."""
    last, window, opened, counts = {}, {}, [], Counter()
    for i, c, t, n, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        if n in CORES and c in last and t - last[c] > gap:
            window[c] = (n, t)
            opened.append((c, n, t))
        elif c in window and t - window[c][1] <= length:
            counts[window[c][0], n] += 1
        last[c] = t
    return opened, counts


@pytest.mark.parametrize("seed,gap,length", [(1, 3, 20), (2, 0, 5), (3, 10, 100), (4, 30, 30)])
def test_triggers_and_bags(spark, monkeypatch, seed, gap, length):
    monkeypatch.setattr(windows, "BUCKET", 64.0)
    rows = trace(seed)
    opened, counts = machine(rows, gap, length)
    df = flows(spark, rows)
    assert sorted((r.c_ip, r.core, r.start) for r in windows.triggers(df, CORES, gap, ORDER).collect()) == sorted(opened)
    got = {(r.core, r.support): (r.n, r.windows) for r in windows.bags(df, CORES, gap, length, ORDER).collect()}
    per_core = Counter(n for _, n, _ in opened)
    assert got == {k: (n, per_core[k[0]]) for k, n in counts.items()}


def test_first_flow_and_equal_gap(spark):
    rows = [(0, "c", 0.0, "aa.it", 0.0), (1, "c", 10.0, "aa.it", 0.0), (2, "c", 20.5, "aa.it", 0.0), (3, "c", 25.5, "xx.net", 0.0), (4, "c", 25.6, "yy.net", 0.0)]
    df = flows(spark, rows)
    assert [r.start for r in windows.triggers(df, CORES, 10, ORDER).collect()] == [20.5]
    assert {(r.support, r.n) for r in windows.bags(df, CORES, 10, 5, ORDER).collect()} == {("xx.net", 1)}
    assert windows.bags(df.limit(0), CORES, 10, 5, ORDER).count() == 0


@pytest.mark.parametrize("seed", [5, 6])
def test_visits_are_greedy(spark, seed):
    rows, length = trace(seed), 37.0
    want, open_until = [], {}
    for i, c, t, n, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        if n in CORES and (c not in open_until or t > open_until[c]):
            want.append((c, n, t))
            open_until[c] = t + length
    end = max(r[2] for r in rows)
    want = sorted(w for w in want if w[2] + length < end)
    assert sorted((r.c_ip, r.core, r.start) for r in windows.visits(flows(spark, rows), CORES, length, ORDER).collect()) == want


def label_machine(rows, bags, ew):
    """Attribution of one client's day, from the description."""
    out, open_, history = {}, {}, []
    rows = sorted(rows, key=lambda r: (r[2], r[0]))
    score = lambda seen, bag: sum(n * bag.get(d, 0) for d, n in seen.items()) / len(seen) if seen else 0
    for k, (i, _, t, n, length) in enumerate(rows):
        open_ = {c: w for c, w in open_.items() if w[1] >= t}
        history = [h for h in history if t - h[0] <= 5 * ew]
        if n == "-":
            out[i] = "UNKNOWN"
            continue
        newest = sorted(open_.items(), key=lambda x: -x[1][0])
        trigger = n in bags
        if trigger:
            rival = next(((c, w) for c, w in newest if n in bags[c]), None)
            if rival:
                at = next((j for j, h in enumerate(history) if h[0] == rival[1][0]), None)
                if at is not None:
                    ahead = Counter(r[3] for r in rows[k + 1 :] if r[2] - t <= ew and r[3] != "-")
                    past = Counter(h[1] for h in history[at + 1 :] if h[0] != rival[1][0]) + Counter([n])
                    trigger = score(ahead, bags[n]) >= score(past + ahead, bags[rival[0]])
        if trigger:
            open_[n] = (t, t + length + ew)
            out[i] = n
        else:
            owner = next((c for c, _ in newest if n in bags[c]), None)
            if owner:
                open_[owner] = (open_[owner][0], max(open_[owner][1], t + length + ew))
            out[i] = owner or "UNKNOWN"
        history.append((t, n))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_classification(spark, seed):
    rng = random.Random(seed)
    rows = trace(seed + 20, 400, 2)
    bags = {"aa.it": {"xx.net": 0.5, "bb.it": 0.3, "aa.it": 0.1, "yy.net": 0.0}, "bb.it": {"zz.net": 0.7, "aa.it": rng.random(), "yy.net": 0.2}}
    learned = spark.createDataFrame([(c, s, w, w) for c, b in bags.items() for s, w in b.items()], "core string, support string, share double, weight double")
    p = attribution.Params(tuple(CORES), evaluate=float(rng.choice([2, 7, 15])))
    df = flows(spark, rows)
    labelled = attribution.classify(df, learned, p, ORDER)
    got = {r.row_id: r.service for r in labelled.collect()}
    want = {}
    for c in {r[1] for r in rows}:
        want |= label_machine([r for r in rows if r[1] == c], bags, p.evaluate)
    assert got == want and len(got) == len(rows)
    report = attribution.service_traffic(labelled)
    assert report.agg(F.sum("bytes")).first()[0] == 11 * len(rows)


def test_classification_of_null_names(spark):
    df = flows(spark, trace(1, 20)).withColumn("name", F.lit(None).cast("string"))
    rules = spark.createDataFrame([], "core string, support string, share double, weight double")
    got = attribution.classify(df, rules, attribution.Params(tuple(CORES)), ORDER).collect()
    assert len(got) == 20 and all(r.service == "UNKNOWN" and r.name is None for r in got)


def test_single_core_weighs_nothing(spark):
    rows = [(i, "c", i * 100.0 + d, n, 0.0) for i, (d, n) in enumerate([(0, "xx.net"), (0, "aa.it"), (-95, "xx.net"), (0, "aa.it"), (-95, "yy.net")])]
    r = attribution.rules(flows(spark, rows), attribution.Params(("aa.it",), 10, 10, 5, 0.05), ORDER).collect()
    assert {(x.support, x.share, x.weight) for x in r} == {("xx.net", 0.5, 0.0), ("yy.net", 0.5, 0.0)}


def test_model_chunks(spark):
    for n, k in ((7, 3), (2, 4), (4, 4), (9, 4)):
        seen = [("c", "cl", 0.0, 0, f"s{i}", float(i)) for i in range(n + 1)]
        df = spark.createDataFrame(seen, "core string, c_ip string, start double, at int, support string, delta double")
        got = {r.support: r.checkpoint for r in pageload.model(df, k).collect()}
        want = {f"s{i + 1}": (i if n < k else ((i + 1) * k - 1) // n) + 1 for i in range(n)}
        assert got == want  # the first support never follows another


def test_rarity(spark):
    def reference(counts):
        counts = sorted(counts, reverse=True)
        total, upto, q = sum(counts), 0, {}
        for i, c in enumerate(counts):
            for f in (0.25, 0.75):
                if f not in q and (upto + c) * 4 >= total * f * 4:
                    q[f] = i + (f * total - upto) / c
            upto += c
        edge = math.floor(q[0.75] + 1.5 * (q[0.75] - q[0.25]))
        return counts[edge] if edge < len(counts) else 0

    rng = random.Random(3)
    groups = {f"g{i}": [rng.choice([1, 2, 5, 100, 1000]) for _ in range(rng.randint(1, 12))] for i in range(40)}
    df = spark.createDataFrame([(g, str(i), c) for g, cs in groups.items() for i, c in enumerate(cs)], "g string, value string, cnt long")
    assert {r.g: r.threshold for r in resolvers.rare_below(df, ["g"]).collect()} == {g: reference(cs) for g, cs in groups.items()}


def test_suspicious_resolver(spark):
    rows = [("c", "tiny", f"w.other{i}.it", [f"30.{i}.0.1"], [60]) for i in range(60)]
    for d in range(12):
        rows += [("c", f"r{i % 5}", f"w.site{d}.it", [f"10.{d}.0.1"], [100 + i % 7]) for i in range(100)]
        rows += [("c", "r5", f"w.site{d}.it", [f"20.{d}.0.1"], [100 + i % 7]) for i in range(12)]
        rows += [("c", "rogue", f"W.site{d}.it", ["66.6.6.6"], [5])] * 10
    df = spark.createDataFrame(rows, "c_ip string, s_ip string, query string, answers array<string>, answer_ttls array<long>").withColumns({"resp_code": F.lit("NOERROR"), "flags_resp": F.lit(12).cast("long")})
    df = df.unionByName(df.limit(3).withColumns({"flags_resp": F.lit(None).cast("long"), "query": F.lit(None).cast("string")}))
    prefixes = spark.createDataFrame([("66.0.0.0/8", "666"), *[(f"10.{d}.0.0/16", str(d)) for d in range(12)]], "prefix string, asn string")
    study = resolvers.Study(df, prefixes, 50)
    bad = {(r.resolver, r.fqdn): r.type for r in study.anomalies.collect()}
    assert set(bad) == {("rogue", f"w.site{d}.it") for d in range(12)} and set(bad.values()) == {"asn"}
    assert {(r.asn, r.server, r.fixed_features) for r in study.suspicious.collect()} == {("666", "66.6.6.6", "cname:nip:ttl")}
    report = {r.resolver: r for r in study.report().collect()}
    assert report["rogue"].servers == "66.6.6.6" and report["rogue"].domains.count(":") == 11 and report["r0"].asn == "-" and len(report) == 8
    known = spark.createDataFrame([(f"w.site{d}.it", ["1"], [f"x.akamai.{d}"]) for d in range(12)], "domain string, asns array<string>, aliases array<string>")
    assert {r.resolver: r.hint for r in resolvers.verify(study.report(), known).collect()}["rogue"] == "CDN."
    known = known.withColumn("asns", F.array(F.lit("666")))
    hints = {r.resolver: r.hint for r in resolvers.verify(study.report(), known).collect()}
    assert hints["rogue"] == "Verified." and hints["r1"] == ""


def test_verified_resolvers(spark, tmp_path):
    alias = {d: f"e{d}.edge-x.example" if d < 12 else f"e{d}.plain.example" for d in range(24)}
    rows = [("c", "tiny", f"w.other{i}.it", [f"30.{i}.0.1"], [60]) for i in range(60)]
    for d in range(24):
        rows += [("c", f"r{i % 5}", f"w.site{d}.it", [alias[d], f"10.{d}.0.1"], [100 + i % 7]) for i in range(100)]
        rows += [("c", "r5", f"w.site{d}.it", [alias[d], f"20.{d}.0.1"], [100 + i % 7]) for i in range(12)]
        if d < 12:
            rows += [("c", r, f"w.site{d}.it", [alias[d], "66.6.6.6"], [5]) for r in ("both1", "both2") for _ in range(5)]
            rows += [("c", "edge", f"w.site{d}.it", [alias[d], "77.7.7.7"], [5])] * 5
        else:
            rows += [("c", "rogue", f"w.site{d}.it", [alias[d], "88.8.8.8"], [5])] * 5
    df = spark.createDataFrame(rows, "c_ip string, s_ip string, query string, answers array<string>, answer_ttls array<long>").withColumns({"resp_code": F.lit("NOERROR"), "flags_resp": F.lit(12).cast("long")})
    df.write.parquet(f"{tmp_path}/dns.parquet")
    hints = {r.resolver: r.hint for r in analytics.resolver_verified(spark, str(tmp_path)).where("domains != '-'").collect()}
    assert hints == {"both1": "Verified.", "both2": "Verified.", "edge": "CDN.", "rogue": ""}


def test_names_and_addresses(spark):
    df = spark.createDataFrame([(x,) for x in ["d111abc.cloudfront.net", "r3---sn-abc12.googlevideo.com", "a.b.c.x.com", "x-1-y.a1.com", "-", None, "www.bbc.co.uk.", "it", "a..b"]], "n string")
    rows = [tuple(r) for r in df.select(names.service_form(F.col("n")), names.site(F.col("n"))).collect()]
    assert [r[0] for r in rows] == ["X.cloudfront.net", "CD---sn-X.googlevideo.com", "C.C.C.C.com", "C-D-C.CD.com", "-", None, "www.bbc.co.uk.", "it", "C..b"]
    assert rows[6][1] == "bbc.co.uk" and rows[7][1] == "it" and rows[5][1] is None
    import ipaddress

    cases = ["1.2.3.4", "01.002.3.4", "256.1.1.1", "1.2.3", "::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::2::3", "::ffff:1.2.3.4", "12345::", "g::", "1:2:3:4:5:6:7", "fe80::1", "", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:8:9", ":1", "1:"]
    got = spark.createDataFrame([(x,) for x in cases], "x string").select("x", ip.is_ipv4(F.col("x")), ip.is_ipv6(F.col("x"))).collect()
    for x, v4, v6 in got:
        assert v4 == (x in ("1.2.3.4", "01.002.3.4")), x
        try:
            want = bool(ipaddress.IPv6Address(x))
            want = True
        except ValueError:
            want = False
        assert v6 == want, x


def test_small_functions(spark):
    df = spark.createDataFrame([('a "b c" d', "0x1F", '1,"x,y",z', None, 7)], "l string, h string, c string, n string, i int")
    r = df.select(misc.quoted_tokens(F.col("l")), misc.hex_number(F.col("h")), misc.hex_number(F.col("l")), misc.comma_tokens(F.col("c"), 3), misc.or_category(F.col("n")), misc.or_category(F.col("i")), misc.time_bin(F.lit(125.5), 60.0)).first()
    assert list(r) == [["a", "b c", "d"], 31, None, ["1", "x,y", "z"], "__NA__", "7", 120.0]


def test_features(spark):
    df = spark.createDataFrame([(1, 3.0, "a"), (2, None, None), (3, 4.0, "a"), (4, 0.0, "b")], "id int, x double, k string")
    got = {r.id: r.features.toArray().tolist() for r in features.transform(df, None, ["x"], ["k"], normalize=False).collect()}
    assert {len(v) for v in got.values()} == {3} and got[1] == [3.0, 1.0, 0.0] and got[2][0] == 0.0 and sum(map(tuple, got.values()), ()).count(1.0) == 3
    unit = features.transform(df, "SELECT id, x FROM records WHERE x > 0", ["x"], normalize_p=1.0).collect()
    assert [r.features[0] for r in unit] == [1.0, 1.0]
    with pytest.raises(ValueError):
        features.transform(df)


def brute_dbscan(points, eps, least):
    near = {i: [j for j in points if math.dist(points[i], points[j]) <= eps] for i in points}
    core = {i for i in points if len(near[i]) >= least}
    label, out = {}, {}
    for i in sorted(core):
        if i in label:
            continue
        number, todo = len(set(label.values())), [i]
        while todo:
            k = todo.pop()
            if k not in label:
                label[k] = number
                todo += [j for j in near[k] if j in core]
    for i in points:
        out[i] = label[i] if i in core else min((label[j] for j in near[i] if j in core), default=-1)
    return out


@pytest.mark.parametrize("seed,eps,least", [(1, 0.5, 4), (2, 0.2, 3), (3, 5.0, 2), (4, 0.01, 5)])
def test_dbscan(spark, seed, eps, least):
    rng = np.random.default_rng(seed)
    points = {int(i): tuple(map(float, p)) for i, p in zip(rng.permutation(120), np.vstack([rng.normal(0, 0.3, (50, 2)), rng.normal(3, 0.3, (50, 2)), rng.uniform(-2, 5, (20, 2))]), strict=True)}
    df = spark.createDataFrame([(i, Vectors.dense(p), "x") for i, p in points.items()], ["id", "features", "b"]).repartition(3)
    got = {r.id: r.prediction for r in clustering.dbscan(df, "id", eps, least).collect()}
    assert got == brute_dbscan(points, eps, least)


def test_density_clients(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    rows = analytics.density_clients(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/flows.parquet").select("c_ip").distinct().count() > 200
    got = {r.c_ip: r.prediction for r in rows}
    assert got == brute_dbscan({r.c_ip: (r.x, r.y) for r in rows}, 0.05, 4) and max(got.values()) > 0 and min(got.values()) == -1


def test_dbscan_links_behind_the_rim(spark):
    """The only link of two cells is a spot that lies outermost in none of the directions tried first."""
    points = {1: (0.7, 0.0), 2: (0.55, 0.55), 3: (0.68, 0.27), 4: (1.603, 0.652), 5: (1.69, 0.66), 6: (1.69, 0.66), 7: (math.nan, 0.0), 8: (math.inf, 0.0)}
    df = spark.createDataFrame([(i, list(x)) for i, x in points.items()], "id long, features array<double>")
    got = {r.id: r.prediction for r in clustering.dbscan(df, "id", 1.0, 2).collect()}
    assert got == brute_dbscan({i: x for i, x in points.items() if i < 7}, 1.0, 2) | {7: -1, 8: -1} and got[1] == got[5] == 0
    assert {r.prediction for r in clustering.dbscan(df.where("id IN (1, 2, 4, 5, 6)"), "id", 1.0, 2).collect()} == {0, 1}


@pytest.mark.parametrize("dimensions", [1, 3])
def test_dbscan_other_dimensions(spark, dimensions):
    rng = random.Random(dimensions)
    points = {i: tuple(rng.uniform(0, (60, 0, 8)[dimensions - 1]) for _ in range(dimensions)) for i in range(300)}
    df = spark.createDataFrame([(i, list(x)) for i, x in points.items()], "id long, features array<double>")
    got = {r.id: r.prediction for r in clustering.dbscan(df, "id", (0.3, 0, 0.8)[dimensions - 1], 4).collect()}
    assert got == brute_dbscan(points, (0.3, 0, 0.8)[dimensions - 1], 4) and max(got.values()) >= 2


def test_dbscan_long_chain(spark):
    df = spark.range(300).select("id", F.array((F.col("id") * 0.9).cast("double")).alias("features"))
    rows = clustering.dbscan(df, "id", 1.0, 2).collect()
    assert {r.prediction for r in rows} == {0} and len(rows) == 300


def test_univariate(spark):
    df = spark.createDataFrame([(float(x),) for x in [*range(20), 1000, -1000]] + [(None,)], "v double")
    assert sorted(r.v for r in anomaly.gaussian(df, "v", 2.0).collect()) == [-1000.0, 1000.0]
    assert sorted(r.v for r in anomaly.boxplot(df, "v").collect()) == [-1000.0, 1000.0]
    assert anomaly.boxplot(df.limit(0), "v").count() == 0


def test_student_quantile():
    for p, df, want in ((0.975, 1, 12.7062047362), (0.975, 10, 2.2281388520), (0.995, 30, 2.7499956536), (0.9, 3, 1.6377443537), (0.025, 10, -2.2281388520), (0.5, 4, 0.0), (0.99999, 200, 4.36939)):
        assert student_close(anomaly.student_quantile(p, df), want), (p, df)


def student_close(got, want):
    return abs(got - want) <= 1e-4 * max(1, abs(want))


def test_esd():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, 200)
    x[[5, 50, 120]] = [9, -8, 12]
    for hybrid in (True, False):
        assert {5, 50, 120} <= set(anomaly.generalized_esd(x, 20, 0.025, hybrid).tolist())
    assert set(anomaly.generalized_esd(x, 20, 0.025, False).tolist()) == {5, 50, 120}
    assert len(anomaly.generalized_esd(np.ones(50), 10)) == 0 and len(anomaly.generalized_esd(np.array([]), 3)) == 0 and len(anomaly.generalized_esd(np.array([1.0, 9.0]), 3)) == 0


def test_seasonal(spark):
    rng = np.random.default_rng(1)
    t = np.arange(24 * 14)
    y = 100 + 30 * np.sin(2 * np.pi * t / 24) + rng.normal(0, 1, len(t))
    y[[100, 200]] += 60
    assert anomaly.find_period(y) == 24
    df = spark.createDataFrame([(k, float(a), float(b)) for k in ("u", "w") for a, b in zip(t, y, strict=True)] + [("short", 1.0, 2.0), ("short", None, 2.0)], "k string, t double, y double")
    rows = anomaly.seasonal_esd(df, "t", "y", "k", hybrid=False).collect()
    assert len(rows) == 2 * len(t) + 1
    for k in ("u", "w"):
        assert {100.0, 200.0} <= {r.time for r in rows if r.key == k and r.outlier} and sum(r.outlier for r in rows if r.key == k) < 12
