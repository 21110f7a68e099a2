"""Streams of candidates and pages: rank what has arrived when a query's time is up."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import values as v
from ..operators.cut import shared

SERP = "query_id long, place int, event_id long, score double, closed_by string"
STATE = "until double, open boolean, closed boolean, n long, ids array<bigint>, scores array<double>"


def deadline_serp(arrivals: DataFrame, budget_s: float, k: int = 3, enough: int = 0, delay: str = "0 seconds", grace_s: float = 0.0, tail_s: float | None = None) -> DataFrame:
    """The k best arrivals of each query within ``budget_s`` seconds of its first one, emitted once.

    ``arrivals`` streams query_id, event_id, ts (timestamp) and score; it may have ``kind``, of
    which ``start`` (the query came in), ``plan`` (its plan's last line was read) and ``end``
    (nothing more will come) are marks and not candidates. With ``grace_s`` the time to the
    first candidate after a start mark is free up to so many seconds: what is unused is handed
    back, as the window is measured from that candidate. After a plan mark stragglers have
    ``tail_s`` seconds, if given, within the window. A query closes at its end mark, when an
    arrival is past its deadline, when the watermark is, or when ``enough`` (if any) have come;
    whatever comes later is dropped. State holds the k best and how many came.
    """
    marked = arrivals if "kind" in arrivals.columns else arrivals.withColumn("kind", F.lit("page"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        until, open_, closed, n, ids, scores = state.get if state.exists else (0.0, True, False, 0, [], [])
        best, why = list(zip(scores, ids, strict=True)), ""
        if closed:
            return
        if state.hasTimedOut:
            why = "time"
        else:
            rows = pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable")
            at = rows["ts"].astype("datetime64[us]").astype("int64") / 1e6
            fresh = not state.exists
            for t, i, s, kind in zip(at, rows["event_id"], rows["score"], rows["kind"], strict=True):
                if fresh:
                    until, fresh = t + budget_s + (grace_s if kind == "start" else 0.0), False
                    open_ = kind == "start"
                if t > until:
                    why = "arrival"
                    break
                if kind == "end":
                    why = "end"
                    break
                if kind == "plan":
                    until = min(until, t + tail_s) if tail_s is not None else until
                if kind in ("start", "plan"):
                    continue
                if open_:  # the plan's first address: the unused grace goes back
                    until, open_ = min(until, t + budget_s), False
                n += 1
                best = sorted([*best, (float(s), int(i))], key=lambda x: (-x[0], x[1]))[:k]
                if enough and n >= enough:
                    why = "enough"
                    break
        if why:
            state.update((until, False, True, n, [], []))
            yield pd.DataFrame([(key[0], m + 1, i, s, why) for m, (s, i) in enumerate(best)], columns=["query_id", "place", "event_id", "score", "closed_by"])
        else:
            state.update((until, open_, False, n, [i for _, i in best], [s for s, _ in best]))
            state.setTimeoutTimestamp(max(int(until * 1000) + 1, state.getCurrentWatermarkMs() + 1))

    return marked.withWatermark("ts", delay).groupBy("query_id").applyInPandasWithState(step, SERP, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def plan_lines(chunks: DataFrame) -> DataFrame:
    """Lines of plans as their pieces come in: query_id, line, text. ``chunks`` streams query_id, seq, chunk and last.

    A line is there once its end has come, or the chunk marked ``last``; state holds what
    follows the last line end, and chunks that came before one with a smaller number.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        due, line, tail, seqs, texts, lasts = state.get if state.exists else (0, 0, "", [], [], [])
        held = {int(a): (b, bool(c)) for a, b, c in zip(seqs, texts, lasts, strict=True)}
        for frame in frames:
            held |= {int(a): (b or "", bool(c)) for a, b, c in zip(frame["seq"], frame["chunk"], frame["last"], strict=True) if a >= due}
        out: list[tuple] = []
        while due in held:
            chunk, last = held.pop(due)
            due += 1
            *done, tail = (tail + chunk).split("\n")
            if last and tail:
                done, tail = [*done, tail], ""
            for text in done:
                out.append((key[0], line, text))
                line += 1
        state.update((due, line, tail, list(held), [x for x, _ in held.values()], [x for _, x in held.values()]))
        yield pd.DataFrame(out, columns=["query_id", "line", "text"])

    kind = chunks.schema["query_id"].dataType.simpleString()
    x = chunks.select("query_id", "seq", "chunk", "last").groupBy("query_id")
    return x.applyInPandasWithState(step, f"query_id {kind}, line int, text string", "due int, line int, tail string, seqs array<int>, texts array<string>, lasts array<boolean>", "append", GroupStateTimeout.NoTimeout)


def changed(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Progress events (query_id, kind, payload, ts), each content of a kind once: a plan is told only when it differs from all told before."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["query_id", "kind", "payload"])


def coalesced(requests: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Requests (host, ts) for one host's catalogue, one for each host while the answer is on its way."""
    return requests.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["host"])


def outbound(rows: DataFrame, send, checkpoint: str, size: int = 20, most: int = 200, every: str = "2 seconds"):
    """Starts a bounded queue: every so often at most ``most`` rows go out by ``send(batch, n, dropped)``, ``size`` at a time, and the rest are counted as dropped; returns the running query."""

    def go(batch: DataFrame, n: int) -> None:
        total = batch.count()
        x = batch.limit(most).withColumn("part", F.floor((F.row_number().over(Window.orderBy(F.lit(0))) - 1) / size))  # at most ``most`` rows
        send(x, n, max(0, total - most))

    return rows.writeStream.foreachBatch(go).trigger(processingTime=every).option("checkpointLocation", checkpoint).start()


def atlas_counts(confirmed: DataFrame) -> DataFrame:
    """Running confirmations of each (host, template), as a stream in update or complete mode."""
    return confirmed.groupBy("host", "template").agg(F.count(F.lit(1)).alias("seen"), F.max("ts").alias("updated"))


def collected(stream: DataFrame, name: str, mode: str, checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over what its source holds now and returns what it wrote, as a Parquet table in the shared folder.

    A batch that is run again after a failure overwrites its own part.
    """
    spark: SparkSession = stream.sparkSession
    root = f"{checkpoint or shared(spark)}/{name}-{uuid.uuid4().hex}"

    def store(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out" if mode == "complete" else f"{root}/out/batch={n}")

    q = stream.writeStream.foreachBatch(store).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{root}/log").start()
    q.awaitTermination()
    schema = stream.schema
    spark.createDataFrame([], schema).write.mode("append").parquet(f"{root}/out" if mode == "complete" else f"{root}/out/batch=-1")
    return spark.read.schema(schema).parquet(f"{root}/out").select(*schema.names)


def events(spark: SparkSession, sf_dir: str, files: str = "events.parquet", files_at_once: int | None = None) -> DataFrame:
    """The events table as a stream; its times become instants, as a watermark needs. ``files_at_once`` bounds what a batch takes in."""
    schema = spark.read.parquet(f"{sf_dir}/{files}").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    return reader.parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def budget(depth: str, explicit: float | None = None, supplied: bool = False, floor_s: float = 0.0) -> tuple[float, float]:
    """Seconds of a search's window, and of the grace for its plan: a given budget and a given plan have no grace; a planner that needs longer than the window widens it instead."""
    window = v.TIERS[depth][3] if explicit is None else explicit
    if explicit is not None or supplied:
        return window, 0.0
    return (floor_s, 0.0) if floor_s > window else (window, v.PLAN_GRACE[depth])
