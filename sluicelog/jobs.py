"""The catalogue of analytics, clusterings and detectors that the command line runs by name."""

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .operators import anomaly, attribution, clustering, pageload, resolvers, traffic
from .schema import TableType


@dataclass(frozen=True)
class Job:
    """What a job takes, the batch that suits it, and its parameters with their meaning."""

    run: Callable[..., DataFrame]
    table: TableType
    batch: str
    description: str
    parameters: dict[str, str] = field(default_factory=dict)


def _service(df: DataFrame, CORES: list[str], OW: float = 10, GAP: float = 10, EW: float = 5, MINFREQ: float = 0.05, N_TOP: int = 50) -> DataFrame:
    return attribution.report(df, attribution.Params(tuple(CORES), OW, GAP, EW, MINFREQ, N_TOP))


def _page(df: DataFrame, CORES: list[str], EW: float = 30, GAP: float = 5, MINFREQ: float = 0.25, N_CP: int = 4) -> DataFrame:
    return pageload.report(df, pageload.Params(tuple(CORES), EW, GAP, MINFREQ, N_CP))


def _resolvers(df: DataFrame, ASN_VIEW: str, min_resolutions: int = 50) -> DataFrame:
    prefixes = df.sparkSession.read.csv(ASN_VIEW, sep="\t", comment=";", schema="prefix string, asn string")
    return resolvers.Study(df, prefixes, min_resolutions).report()


def _print(df: DataFrame, N: int = -1) -> DataFrame:
    return df if N < 0 else df.limit(N)


_TOP = {"N_TOP": "rows of the report, 50 by default"}
JOBS = {
    "ResolverStudy": Job(_resolvers, TableType.DNS, "5d", "Per-resolver statistics and resolvers whose answers differ from what others answer.", {"min_resolutions": "look-ups of a domain to be considered, 50 by default", "ASN_VIEW": "file of prefix, tab, network number"}),
    "ServiceTraffic": Job(_service, TableType.NAMED_FLOWS, "1d", "Traffic that web services cause, supporting flows included.", {"CORES": "core domains", "OW": "observation window in seconds", "GAP": "silence before it in seconds", "EW": "evaluation window in seconds", "MINFREQ": "least share of a support domain", **_TOP}),
    "PageLoad": Job(_page, TableType.NAMED_FLOWS, "5d", "Indicators of how fast pages of core domains load, for each visit.", {"CORES": "core domains", "EW": "window in seconds", "GAP": "silence before it in seconds", "MINFREQ": "least share of windows with a support", "N_CP": "checkpoints"}),
    "TrafficPerDomain": Job(lambda df, N_TOP=50: traffic.domain_traffic(df, N_TOP), TableType.NAMED_FLOWS, "1d", "Bytes by domain.", _TOP),
    "ContactedResolvers": Job(lambda df, N_TOP=50: traffic.contacted_resolvers(df, N_TOP), TableType.DNS, "1d", "Look-ups by resolver.", _TOP),
    "Print": Job(_print, TableType.ANY, "*", "The table itself.", {"N": "rows, all by default"}),
}

CLUSTERINGS: dict[str, Callable[..., DataFrame]] = {
    "KMeans": lambda df, K=5, seed=1: clustering.kmeans(df, K, seed),
    "BisectingKMeans": lambda df, K=5, seed=1: clustering.bisecting_kmeans(df, K, seed),
    "GaussianMixture": lambda df, K=5, seed=1: clustering.gaussian_mixture(df, K, seed),
    "DBScan": lambda df, id, eps=0.25, min_points=10: clustering.dbscan(df, id, eps, min_points),
}
DETECTORS: dict[str, Callable[..., DataFrame]] = {
    "SeasonalHybridESD": lambda df, time="time", value="value", key=None, period=None, alpha=0.025, hybrid=True: anomaly.seasonal_esd(df, time, value, key, period, alpha, hybrid),
    "Gaussian": lambda df, value="value", times=3.0: anomaly.gaussian(df, value, times),
    "Boxplot": lambda df, value="value", times=3.0: anomaly.boxplot(df, value, times),
}


def run_job(name: str, df: DataFrame, parameters: dict | None = None) -> DataFrame:
    """The job's result, after the table's columns are checked."""
    if name not in JOBS:
        raise ValueError(f"no job {name}; there are {', '.join(JOBS)}")
    from .schema import validate

    return JOBS[name].run(validate(df, JOBS[name].table), **(parameters or {}))
