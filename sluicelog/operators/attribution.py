"""Traffic of web services: every flow gets the core domain that caused it, or ``UNKNOWN``."""

from bisect import bisect_right
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import service_form
from ..session import ship
from . import windows
from .traffic import leaders

UNKNOWN = "UNKNOWN"
#: Rules that tasks may hold (some hundred bytes each).
MOST_RULES = 1_000_000
_DAY = 86400


@dataclass(frozen=True)
class Params:
    """Core domains; observation window, silence before it and evaluation window in seconds; least share of a support domain; rows of the report."""

    cores: tuple[str, ...]
    observe: float = 10.0
    gap: float = 10.0
    evaluate: float = 5.0
    min_share: float = 0.05
    n_top: int = 50


def rules(flows: DataFrame, p: Params, order: tuple[str, ...] = windows.ORDER) -> DataFrame:
    """``core, support, share, weight`` learned from observation windows.

    ``share`` is the number of a support's flows per window (it may exceed 1);
    supports below ``min_share`` go. The weight is the share times the decimal
    logarithm of the number of cores left over the number of them that have the
    support, so one shared by all weighs nothing.
    """
    share = F.col("n") / F.col("windows")
    left = windows.bags(windows.named(flows), list(p.cores), p.gap, p.observe, order).where(share >= p.min_share).select("core", "support", share.alias("share"))
    holders = left.groupBy("support").agg(F.count(F.lit(1)).alias("_holders"))
    cores = left.agg(F.countDistinct("core")).scalar()
    return left.join(holders, "support").select("core", "support", "share", (F.col("share") * F.log10(cores / F.col("_holders"))).alias("weight"))


def _score(seen: Counter, bag: dict[str, float]) -> float:
    return sum(n * bag.get(name, 0.0) for name, n in seen.items()) / len(seen) if seen else 0.0


class _Client:
    """State of one client's open windows while its flows go by in time order."""

    def __init__(self, bags: dict[str, dict[str, float]], evaluate: float):
        self.bags, self.evaluate = bags, evaluate

    def label(self, times: list[float], ends: list[float], names: list[str], forms: list[str]) -> list[str]:
        opened: dict[str, list[float]] = {}  # core: [start, end]
        recent: deque[tuple[float, str]] = deque()
        out = []
        for i, (t, name, form) in enumerate(zip(times, names, forms, strict=True)):
            opened = {core: w for core, w in opened.items() if w[1] >= t}
            while recent and t - recent[0][0] > 5 * self.evaluate:
                recent.popleft()
            if name == "-":
                out.append(UNKNOWN)
                continue
            until = t + (ends[i] - t) + self.evaluate
            newest = sorted(opened, key=lambda c: -opened[c][0])
            if name in self.bags and self._opens(name, newest, opened, recent, times, names, i):
                opened[name] = [t, until]
                recent.append((t, name))
                out.append(name)
                continue
            owner = next((c for c in newest if form in self.bags.get(c, ())), None)
            if owner is not None:
                opened[owner][1] = max(opened[owner][1], until)
            recent.append((t, form))
            out.append(owner or UNKNOWN)
        return out

    def _opens(self, name, newest, opened, recent, times, names, i) -> bool:
        """Whether a core's own flow starts a visit rather than supporting the newest window that lists it."""
        rival = next((c for c in newest if name in self.bags.get(c, ())), None)
        if rival is None:
            return True
        start = opened[rival][0]
        held = [t for t, _ in recent]
        first = next((k for k, t in enumerate(held) if t == start), None)
        if first is None:
            return True  # the rival's start is forgotten
        past = Counter(n for t, n in list(recent)[first + 1 :] if t != start)
        past[name] += 1
        ahead = Counter(n for n in names[i + 1 : bisect_right(times, times[i] + self.evaluate)] if n != "-")
        return _score(ahead, self.bags[name]) >= _score(past + ahead, self.bags[rival])


def classify(flows: DataFrame, learned: DataFrame, p: Params, order: tuple[str, ...] = windows.ORDER) -> DataFrame:
    """``flows`` with ``service``: the core domain each belongs to, or ``UNKNOWN``.

    Clients are followed by day. A client's day is cut wherever nothing of it
    can matter later: no window can still be open and all history is
    forgotten. Groups so are as short as the client's pauses allow. A missing
    end counts as the start. The learned rules, a few for each core, are
    collected when this is called and sent along; more than ``MOST_RULES`` are
    refused, never cut.
    """
    ship(flows.sparkSession)
    bags: dict[str, dict[str, float]] = {}
    few = learned.limit(MOST_RULES + 1).collect()
    if len(few) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules; raise min_share")
    for r in few:
        bags.setdefault(r.core, {})[r.support] = r.weight
    clean = F.coalesce("name", F.lit("-"))
    rows = flows.withColumns({"_clean": clean, "_form": service_form(clean), "_end": F.coalesce("time_end", "time_start"), "_when": F.col("time_start")})
    by_day = Window.partitionBy("c_ip", "_day").orderBy(*order)
    reach = F.max(F.greatest("_end", "time_start")).over(by_day.rowsBetween(Window.unboundedPreceding, -1)) + p.evaluate
    fresh = F.coalesce((F.col("time_start") > reach) & (F.col("time_start") - F.lag("time_start").over(by_day) > 5 * p.evaluate), F.lit(True))
    day = rows.withColumn("_day", F.floor(F.col("time_start") / _DAY)).withColumn("_fresh", fresh.cast("long"))
    cut = day.withColumn("_part", F.sum("_fresh").over(by_day.rowsBetween(Window.unboundedPreceding, 0)))
    key = ["c_ip", "_day", "_part"]
    out = T.StructType([*flows.schema.fields, T.StructField("service", T.StringType())])
    rows = cut.select(*flows.columns, "_clean", "_form", "_end", *key[1:], "_when").repartition(*key).sortWithinPartitions(*key, *order)
    return rows.mapInPandas(_labeller(bags, p.evaluate, key, out.fieldNames()), out)


def _labeller(bags: dict[str, dict[str, float]], evaluate: float, key: list[str], wanted: list[str]):
    """Label sorted batches part by part; only a batch's last part waits for the next batch."""
    client = _Client(bags, evaluate)

    def label(rows: pd.DataFrame) -> pd.DataFrame:
        new = (rows[key] != rows[key].shift()).any(axis=1).to_numpy()
        starts = [*new.nonzero()[0].tolist(), len(rows)]
        times, ends, names, forms = (rows[c].tolist() for c in ("_when", "_end", "_clean", "_form"))
        labels: list[str] = []
        for i, j in zip(starts, starts[1:]):
            labels += client.label(times[i:j], ends[i:j], names[i:j], forms[i:j])
        return rows.assign(service=labels)[wanted]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            last = (batch[key] == batch[key].iloc[-1]).all(axis=1).to_numpy()
            if held and last.all() and (held[-1][key].iloc[-1] == batch[key].iloc[-1]).all():
                held.append(batch)
                continue
            cut = int(last.argmax())
            ready = pd.concat([*held, batch.iloc[:cut]], ignore_index=True)
            if len(ready):
                yield label(ready)
            held = [batch.iloc[cut:]]
        if held:
            yield label(pd.concat(held, ignore_index=True))

    return run


def service_traffic(labelled: DataFrame, n_top: int = 50) -> DataFrame:
    """``service, bytes`` of all labels, the greatest first."""
    both = F.coalesce("s_bytes", F.lit(0)) + F.coalesce("c_bytes", F.lit(0))
    return leaders(labelled.groupBy("service").agg(F.sum(both).alias("bytes")), "bytes", "service", n_top)


def report(flows: DataFrame, p: Params, order: tuple[str, ...] = windows.ORDER) -> DataFrame:
    """Learn, classify and total in one go."""
    return service_traffic(classify(flows, rules(flows, p, order), p, order), p.n_top)
