"""A cache of keyed lookups: the first success of a key answers all later requests, failures are never kept.

Requests are (key, ts, id, ok, value): what the source would answer at that time. :func:`cached` says for a table which
requests the cache answers and with what; :func:`cached_stream` does the same for a stream, with the answer as keyed state.
An answer expires at the end of the period (``seconds`` from the epoch) that it was fetched in; without one it stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Buckets of keys of a stream, each with one state; a stream that has begun keeps their number.
BUCKETS = 1024
ANSWER = "key string, ts timestamp, id long, source string, value double"


def _period(seconds: int | None) -> Column:
    return F.lit(0).cast("long") if seconds is None else F.floor(F.unix_micros("ts") / (seconds * 1_000_000)).cast("long")


def cached(requests: DataFrame, seconds: int | None = None) -> DataFrame:
    """key, ts, id, source, value: ``cache``, ``fetched`` or ``failed`` (null value) for each request in order of (ts, id).

    The first success of each key and period is a minimum, taken before the shuffle, so a key that everyone asks for isn't
    sorted in one task. Requests without a key or a time are dropped.
    """
    own = requests.where("key IS NOT NULL AND ts IS NOT NULL").withColumn("period", _period(seconds))
    first = own.where("ok").groupBy("key", "period").agg(F.min(F.struct("ts", "id", "value")).alias("first"))
    met = own.join(first, ["key", "period"], "left")
    at = F.struct("ts", "id")
    since = F.struct(F.col("first.ts").alias("ts"), F.col("first.id").alias("id"))
    source = F.when(F.col("first").isNotNull() & (at > since), "cache").when(F.col("ok"), "fetched").otherwise("failed")
    return met.withColumn("source", source).select("key", "ts", "id", "source", F.when(F.col("source") == "cache", F.col("first.value")).when(F.col("source") == "fetched", F.col("value")).alias("value"))


class Lookups(StatefulProcessor):
    """Keeps the answers of a bucket's keys, each with its period, as one value state."""

    def __init__(self, seconds: int | None):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("answers", "keys array<string>, periods array<long>, values array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows)).sort_values(["key", "ts", "id"], kind="stable").reset_index(drop=True)
        time = asked["ts"].to_numpy("datetime64[ns]").astype("int64")
        asked["period"] = 0 if self.seconds is None else time // (self.seconds * 1_000_000_000)
        kept = self.state.get() or ([], [], [])
        held = pd.DataFrame({"period": np.array(kept[1], "int64"), "value": np.array(kept[2], "float64")}, index=pd.Index(list(kept[0]), dtype=object))
        known = held.reindex(asked["key"])
        place, ok, value = np.arange(len(asked)), asked["ok"].eq(True).to_numpy(), asked["value"].to_numpy("float64")
        first = pd.Series(np.where(ok, place, len(asked))).groupby([asked["key"], asked["period"]]).transform("min").to_numpy()
        stored, later = known["period"].to_numpy() == asked["period"].to_numpy(), place > first
        asked["source"] = np.where(stored | later, "cache", np.where(ok, "fetched", "failed"))
        before = value[np.minimum(first, len(asked) - 1)]
        asked["value"] = np.where(stored, known["value"].to_numpy(), np.where(later, before, np.where(ok, value, np.nan)))
        new = asked[asked["source"] == "fetched"].drop_duplicates("key", keep="last").set_index("key")[["period", "value"]]
        if len(new):
            own = pd.concat([held[~held.index.isin(new.index)], new])
            self.state.update((own.index.tolist(), own["period"].astype("int64").tolist(), own["value"].tolist()))
        yield asked[["key", "ts", "id", "source", "value"]]

    def close(self) -> None:
        pass


def cached_stream(requests: DataFrame, seconds: int | None = None) -> DataFrame:
    """The same for a streaming table whose batches come in order of time; the rows of a bucket of keys meet its state once a batch."""
    own = requests.where("key IS NOT NULL AND ts IS NOT NULL").select(F.col("key").cast("string").alias("key"), "ts", "id", "ok", F.col("value").cast("double").alias("value"))
    return own.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")).groupBy("bucket").transformWithStateInPandas(statefulProcessor=Lookups(seconds), outputStructType=ANSWER, outputMode="Append", timeMode="None")
