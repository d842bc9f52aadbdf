"""The latest filing of each company, kept as state over a stream, with timers.

Filings come in any order. State is one row a company, whatever it has filed: the filing that is last by date and name,
how many there were, and when the company was last heard of. A filing that arrives late but is older counts and replaces
nothing. A company that is not heard of for `idle` of event time expires: its state goes with a last row, and a filing
after that begins anew. So state is bounded by the companies that are active, and its outcome does not depend on order.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "ticker string, status string, filing_date date, source_file string, filing_type string, n_filings bigint"
_STATE = "filing_date date, source_file string, filing_type string, n bigint, heard bigint"


class LatestFiling(StatefulProcessor):
    """Rows (ticker, filing_date, source_file, filing_type, arrived); a row OUT for each company that a batch changes."""

    def __init__(self, idle_seconds: int) -> None:
        self.idle = idle_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.latest.get() if self.latest.exists() else None
        best = None if held is None else tuple(held[:3])
        n, heard = (0, 0) if held is None else (held[3], held[4])
        for part in rows:
            n += len(part)
            heard = max(heard, int(part["arrived"].max().timestamp() * 1000))
            # by date, then name; nulls first
            order = part.assign(_no_date=part["filing_date"].notna(), _name=part["source_file"].fillna("")).sort_values(["_no_date", "filing_date", "_name"])
            last = order.iloc[-1]
            found = tuple(None if pd.isna(last[c]) else last[c] for c in ("filing_date", "source_file", "filing_type"))
            best = found if best is None or _place(found) > _place(best) else best
        self.latest.update((*best, n, heard))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(int(timer[0] if isinstance(timer, (tuple, list)) else timer))
        self.handle.registerTimer(max(heard + self.idle, timerValues.getCurrentWatermarkInMs() + 1))
        yield self._row(key, "latest", (*best, n))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.latest.exists():
            held = self.latest.get()
            self.latest.clear()
            yield self._row(key, "expired", held)

    @staticmethod
    def _row(key, status: str, held) -> pd.DataFrame:
        return pd.DataFrame({"ticker": [key[0]], "status": [status], "filing_date": [held[0]], "source_file": [held[1]], "filing_type": [held[2]], "n_filings": [held[3]]})

    def close(self) -> None:
        pass


def _place(filing: tuple) -> tuple:
    return (filing[0] is not None, str(filing[0] or ""), filing[1] or "")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that timers need, for streams that start in here; the session's own comes back after."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def latest_filings(filings: DataFrame, idle_seconds: int = 90 * 86_400, late: str = "1 day") -> DataFrame:
    """A stream OUT of the companies' latest filings: start it within state_store(), in update mode."""
    kept = filings.select("ticker", "filing_date", "source_file", "filing_type", "arrived").withWatermark("arrived", late)
    return kept.groupBy("ticker").transformWithStateInPandas(LatestFiling(idle_seconds), OUT, "Update", "EventTime")


def batch_latest(filings: DataFrame) -> DataFrame:
    """What the stream's state is in the end, without expiry, from all filings at once."""
    place = F.struct(F.col("filing_date").isNotNull().alias("a"), F.coalesce(F.col("filing_date").cast("string"), F.lit("")).alias("b"), F.coalesce("source_file", F.lit("")).alias("c"), "filing_type")
    last = F.max_by(F.struct("filing_date", "source_file", "filing_type"), place)
    return filings.groupBy("ticker").agg(last.alias("l"), F.count("*").alias("n_filings")).select("ticker", "l.*", "n_filings")
