"""Sinks, command line, streams and the shared folder."""

import csv
import json

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from sluicelog import cli, jobs, sinks, workdir
from sluicelog.operators import windows
from sluicelog.sql import run_sql
from sluicelog.streaming import triggers as stream_triggers
from sluicelog.streaming import windows as stream_windows

NATIVE = ["100.5 250 10.0.0.1 TCP_MISS/200 1234 GET http://a.it/x - DIRECT/1.2.3.4 text/html", "160.0 10 10.0.0.2 TCP_MISS/404 7 POST http://b.it/ - HIER_NONE/- -"]


def lines(path):
    return sorted(x for f in path.glob("part-*") for x in f.read_text().splitlines())


@pytest.fixture
def logs(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/access.log-20170301").write_text("\n".join(NATIVE) + "\n")
    return ["--tool", "Squid", "--table", "NamedFlows", "--input", str(tmp_path / "in"), "--start", "2017_03_01", "--end", "2017_03_02"]


def test_cli_query(spark, tmp_path, logs):
    cli.main(["query", *logs, "--query", "SELECT name, s_bytes FROM records", "--output", str(tmp_path / "q")], spark)
    assert lines(tmp_path / "q") == ["a.it,1234", "b.it,7"]
    cli.main(["query", *logs, "--query", "SELECT name FROM records ORDER BY name", "--local-output", str(tmp_path / "q.csv")], spark)
    assert list(csv.reader(open(tmp_path / "q.csv"))) == [["name"], ["a.it"], ["b.it"]]
    for both in ([], ["--output", "x", "--local-output", "y"]):
        with pytest.raises(SystemExit):
            cli.main(["query", *logs, "--query", "SELECT 1", *both], spark)


def test_cli_jobs(spark, tmp_path, logs):
    cli.main(["job", *logs, "--job", "TrafficPerDomain", "--parameters", '{"N_TOP": 1}', "--output", str(tmp_path / "t")], spark)
    assert lines(tmp_path / "t") == ["a.it,1234", "domain,bytes"]
    cli.main(["job", *logs, "--job", "Print", "--parameters", '{"N": 1}', "--output", str(tmp_path / "p")], spark)
    assert len(lines(tmp_path / "p")) == 2
    cli.main(["job", *logs, "--job", "ServiceTraffic", "--parameters", '{"CORES": ["a.it"]}', "--output", str(tmp_path / "s")], spark)
    assert lines(tmp_path / "s") == ["UNKNOWN,1241", "service,bytes"]
    cli.main(["job", *logs, "--job", "PageLoad", "--parameters", '{"CORES": ["a.it"]}', "--output", str(tmp_path / "v")], spark)
    assert lines(tmp_path / "v") == []
    cli.main(["cluster", *logs, "--algorithm", "KMeans", "--parameters", '{"K": 2}', "--numerical", "s_bytes", "--categorical", "name", "--query", "SELECT name, s_bytes FROM records", "--output", str(tmp_path / "c")], spark)
    got = list(csv.reader(lines(tmp_path / "c"), escapechar="\\"))
    assert [r[0] for r in got] == ["a.it", "b.it"] and {r[3] for r in got} == {"0", "1"} and json.loads(got[0][2])[0] == 1234
    cli.main(["anomaly", *logs, "--algorithm", "Gaussian", "--parameters", '{"times": 0.5}', "--query", "SELECT s_bytes AS value FROM records", "--output", str(tmp_path / "a")], spark)
    assert set(lines(tmp_path / "a")) == {"1234", "7", "value"}


def test_jobs_check_their_table(spark):
    with pytest.raises(ValueError, match="not a DNS table"):
        jobs.run_job("ContactedResolvers", spark.range(1))
    with pytest.raises(ValueError, match="no job"):
        jobs.run_job("x", spark.range(1))
    assert jobs.run_job("Print", spark.range(3), {"N": 2}).count() == 2


def test_resolver_job(spark, sf_dir, tmp_path):
    (tmp_path / "asn.dat").write_text("; prefixes\n100.96.0.0/16\t65001\n")
    from sluicelog.schema import TableType, conform

    dns = conform(spark.read.parquet(f"{sf_dir}/dns.parquet"), TableType.DNS)
    assert jobs.run_job("ResolverStudy", dns, {"ASN_VIEW": str(tmp_path / "asn.dat"), "min_resolutions": 10}).count() > 0
    assert jobs.run_job("ContactedResolvers", dns, {"N_TOP": 3}).count() == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, Vectors.dense(1, 2), ["x", "y"], 0), (2, Vectors.dense(3, 4), None, -1)], ["b", "features", "a", "prediction"]
    )
    sinks.to_labelled(df, str(tmp_path / "l"))
    assert [r[1:] for r in csv.reader(lines(tmp_path / "l"), escapechar="\\")] in ([["2", "[3.0,4.0]", "-1"], ["1", "[1.0,2.0]", "0"]], [["1", "[1.0,2.0]", "0"], ["2", "[3.0,4.0]", "-1"]])
    sinks.to_visits(spark.createDataFrame([(1.5, "c", "p", 2.0, None)], "time double, c_ip string, page string, cp_1 double, cp_2 double"), str(tmp_path / "v"))
    assert lines(tmp_path / "v") == ["1.5 c p 2.0 -"]
    sinks.to_model(df.select("b", "a"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m"), "b long, a array<string>").where("b = 1").first().a == ["x", "y"]
    sinks.save(df.select("b"), str(tmp_path / "s"), 1)
    assert len(lines(tmp_path / "s")) == 2
    assert run_sql(df, "SELECT sum(b) AS s FROM records").first().s == 3


def stream(spark, tmp_path, df, parts=4):
    for i in range(parts):
        df.where(F.pmod("row_id", F.lit(parts)) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "stream"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "stream"))


def drain(spark, df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def test_streams_equal_batch(spark, sf_dir, tmp_path):
    flows = spark.read.parquet(f"{sf_dir}/flows.parquet").select("row_id", "c_ip", "name", "time_start", "s_bytes", "c_bytes")
    live = stream(spark, tmp_path, flows)
    for name, of in (("tumbling", lambda f: stream_windows.traffic_by_window(f, "1 hour", late="60 days")), ("sliding", lambda f: stream_windows.traffic_by_window(f, "2 hours", "1 hour", late="60 days"))):
        got = drain(spark, of(live), name, "complete")
        assert sorted(map(str, got.collect())) == sorted(map(str, of(flows).collect()))
    visits = stream_windows.visits_by_client(flows, "30 minutes")
    assert visits.agg(F.sum("flows")).first()[0] == flows.count()
    got = drain(spark, stream_windows.visits_by_client(live, "30 minutes", late="60 days"), "visits", "complete")
    assert sorted(map(str, got.collect())) == sorted(map(str, visits.collect()))
    unique = drain(spark, stream_windows.first_seen(live.select("c_ip", "name", "time_start"), ["c_ip", "name", "time_start"], late="60 days"), "unique", "append")
    assert unique.count() == flows.select("c_ip", "name", "time_start").distinct().count()


def test_stream_triggers(spark, tmp_path):
    rows = [(i, f"c{i % 3}", 1.7e9 + 7.0 * i + (400 if i > 60 else 0), ["core.it", "xx.net"][i % 2]) for i in range(120)]
    df = spark.createDataFrame(rows, "row_id long, c_ip string, time_start double, name string")
    want = windows.triggers(df, ["core.it"], 100, ("time_start", "row_id")).select("c_ip", "core", "start").collect()
    df.coalesce(1).write.parquet(str(tmp_path / "stream"))
    live = spark.readStream.schema(df.schema).parquet(str(tmp_path / "stream"))
    got = drain(spark, stream_triggers.stream_triggers(live, ["core.it"], 100), "triggers", "append")
    assert want and sorted(map(tuple, got.collect())) == sorted(map(tuple, want))


def test_heavy_by_window(spark, sf_dir):
    dns = spark.read.parquet(f"{sf_dir}/dns.parquet")
    assert stream_windows.heavy_by_window(dns).agg(F.sum("queries")).first()[0] == dns.where("req_time IS NOT NULL").count()


def test_materialize(spark):
    df = workdir.materialize(spark.range(10).withColumn("r", F.rand()), "test")
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, df.collect())) and df.count() == 10
    assert workdir.shared_dir(spark) == workdir.shared_dir(spark)


def test_model_of_one_day_on_another(spark, tmp_path):
    """What was learned, written and read back labels another day's flows as the same rules at once do."""
    from sluicelog.operators import attribution

    params = attribution.Params(("core.it",), 10.0, 10.0, 5.0, 0.05)
    schema = "row_id long, c_ip string, s_ip string, c_port long, s_port long, time_start double, time_end double, name string"
    one = [(i, "c", "s", 1, 80, 100.0 * (i // 2) + i % 2, None, ("core.it", "cdn.it")[i % 2]) for i in range(20)]
    two = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4], r[5] + 86_400, *r[6:]) for r in one] + [(99, "c", "s", 1, 80, 90_000.0, None, "other.it")], schema)
    learned = attribution.rules(spark.createDataFrame(one, schema), params)
    sinks.to_model(learned, f"{tmp_path}/rules")
    again = sinks.read_model(spark, f"{tmp_path}/rules")
    assert again.schema.simpleString() == learned.schema.simpleString() and sorted(map(tuple, again.collect())) == sorted(map(tuple, learned.collect()))
    label = lambda rules: sorted((r.row_id, r.service) for r in attribution.classify(two, rules, params).collect())
    assert label(again) == label(learned) and (99, "UNKNOWN") in label(again) and {s for _, s in label(again)} == {"UNKNOWN", "core.it"}
