"""Streams: incremental counters, sessions, stateful program checks and a frozen tokenizer applied record by record."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.program import Machine, parse


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """A stream over the Parquet files of that name in a folder; the schema is read from them, zone-less times become timestamps."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, key: str, length: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, key, n): counters by event time; rows later than `late` behind the newest are dropped from state."""
    w = F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(key, start, stop, n): maximal runs of a key's events without a longer gap."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def drain(rows: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there now into an in-memory table; for results known to be small, as counters are."""
    q = rows.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return rows.sparkSession.table(name)


def progress(rows: DataFrame, every: Callable[[int, int], None]) -> StreamingQuery:
    """Starts a stream that reports (batch, rows) after each batch."""
    return rows.writeStream.foreachBatch(lambda batch, k: every(k, batch.count())).trigger(availableNow=True).start()


def encode_stream(graphs: DataFrame, fold: Callable[[list[str]], list[str]]) -> DataFrame:
    """(graph_id, tokens) with tokens encoded by a frozen model; stateless."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            own["tokens"] = [fold(list(t)) for t in own["tokens"]]
            yield own

    return graphs.select("graph_id", "tokens").mapInPandas(run, "graph_id string, tokens array<string>")


def check_programs(tokens: DataFrame, codes: dict[int, dict], ref_window: int = 768) -> DataFrame:
    """(graph_id, executed, illegal, done) of programs that arrive token by token (graph_id, pos, tok), one state for each graph.

    A batch's tokens of a graph are applied in order of pos; a graph's batches must arrive in order.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen: list[str] = list(state.get[0]) if state.exists else []
        new = pd.concat(list(batches)).sort_values("pos")["tok"].tolist()
        seen += new
        m = Machine(codes, ref_window=ref_window)
        for t in seen:
            m.step(*parse(t))
        if m.stopped:
            state.remove()
        else:
            state.update((seen,))
        yield pd.DataFrame([(str(key[0]), m.n["executed"], m.n["illegal"], m.stopped)], columns=["graph_id", "executed", "illegal", "done"])

    return tokens.groupBy("graph_id").applyInPandasWithState(step, "graph_id string, executed long, illegal long, done boolean", "seen array<string>", "update", GroupStateTimeout.NoTimeout)
