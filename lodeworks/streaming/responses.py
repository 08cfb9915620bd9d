"""Answers of providers as they stream in: chunks of bytes keyed by response, folded by a stateful operator.

A response's state is its parser: the bytes that are no whole event yet, the events' metadata, and its texts as appended lists, so
that a batch writes what is new and not what came before.  Chunks may come in any order and twice: those ahead of their turn wait in
an appended list.  Every access is a call out of Python, so a batch reads and writes each of a response's states once, and only those that have something.  A response gives one row, when it ends, is closed, or has had no chunk for `idle` of event time (the timer of a stream that never ends);
from then on its number of chunks is kept, so that late or repeated chunks change nothing, until a second timer clears it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodeworks.sources.event_streams import Response, compact, restored
from lodeworks.sources.shared import shared_root

CHUNKS = "resp_id string, seq long, chunk binary, closed boolean, at timestamp"
ROWS_OUT = "resp_id string, ended string, content string, sources array<string>, final string, error string"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FoldResponses(StatefulProcessor):
    def __init__(self, idle_ms: int, most_bytes: int):
        self.idle_ms, self.most_bytes = idle_ms, most_bytes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parser = handle.getValueState("parser", "state string, rest binary, turn long, ahead long, timer long")
        self.texts = handle.getListState("texts", "text string")
        self.contents = handle.getListState("contents", "text string")
        self.waiting = handle.getListState("waiting", "seq long, chunk binary, closed boolean")

    def _timer(self, at_ms: int, old: int | None) -> int:
        """The time of the response's only timer, set anew if it is another."""
        new = at_ms + self.idle_ms
        if new != old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(new)
        return new

    def _load(self) -> tuple[Response, int, int, int | None]:
        """The response, its next chunk's number, how many chunks have been kept ahead of their turn, its timer."""
        found = self.parser.get()
        if found is None:
            return Response(most_bytes=self.most_bytes), 0, 0, None
        state, rest, turn, ahead, timer = found
        if json.loads(state)["ended"]:
            return restored(state, bytes(rest), [], []), turn, ahead, timer
        return restored(state, bytes(rest), *([r[0] for r in held.get()] for held in (self.texts, self.contents))), turn, ahead, timer

    def _keep(self, response: Response, turn: int, ahead: int, timer: int) -> None:
        self.parser.update((response.to_state(), response.rest, turn, ahead, timer))

    def _rows(self, key: tuple, r: Response) -> Iterator[Row]:
        final = None if r.final is None else compact(r.final)
        yield Row(resp_id=key[0], ended=r.ended, content=r.text(), sources=r.sources(), final=final, error=r.error)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        response, turn, ahead, timer = self._load()
        was, had = response.ended, (len(response.texts), len(response.contents))
        latest, arrived = timerValues.getCurrentWatermarkInMs(), {}
        for row in rows:
            arrived.setdefault(row.seq, (row.chunk, row.closed))
            latest = max(latest, int(row.at.timestamp() * 1000)) if row.at else latest
        if was:  # this response has had its row
            return
        known: dict = {}
        for seq, chunk, closed in self.waiting.get() if ahead else ():
            known.setdefault(seq, (chunk, closed))
        while not response.ended and (turn in arrived or turn in known):
            chunk, closed = arrived.pop(turn) if turn in arrived else known[turn]
            response.feed(bytes(chunk or b""))
            if closed:
                response.close()
            turn += 1
        timer = self._timer(latest, timer)
        if response.ended:
            yield from self._ended(key, response, turn, ahead, timer)
            return
        new = [(seq, *held) for seq, held in arrived.items() if seq is not None and seq > turn and seq not in known]
        if ahead and not new and all(seq < turn for seq in known):
            self.waiting.clear()
            ahead = 0
        elif new:
            self.waiting.appendList(new)
            ahead += len(new)
        self._keep(response, turn, ahead, timer)
        for held, now, before in ((self.texts, response.texts, had[0]), (self.contents, response.contents, had[1])):
            if len(now) > before:
                held.appendList([(t,) for t in now[before:]])

    def _ended(self, key, response: Response, turn: int, ahead: int, timer: int) -> Iterator[Row]:
        for held, some in ((self.texts, response.texts), (self.contents, response.contents), (self.waiting, ahead)):
            if some:
                held.clear()
        self._keep(Response(ended=response.ended), turn, 0, timer)
        yield from self._rows(key, response)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        response, turn, ahead, _ = self._load()
        if response.ended:
            self.parser.clear()
            return
        response.close()
        yield from self._ended(key, response, turn, ahead, self._timer(timerValues.getCurrentWatermarkInMs(), None))


def with_state_store(spark: SparkSession) -> SparkSession:
    """A session whose streams keep state in RocksDB, which this operator's several states need; the other settings are the given one's."""
    session = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(key, spark.conf.get(key))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return session


def drain_in_steps(spark: SparkSession, steps: list[DataFrame], idle: str = "10 minutes", files_per_batch: int = 100) -> DataFrame:
    """Write each step's chunks to a folder and run the stream over what is new, anew each time: it goes on where the last run ended.

    Rows are written under their batch's number, so a batch that runs again writes over itself.
    """
    root = f"{shared_root(spark)}/responses-{uuid.uuid4().hex}"
    session = with_state_store(spark)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/batch={number}")

    for step in steps:
        step.write.mode("append").parquet(f"{root}/chunks")
        stream = folded_responses(chunk_stream(session, f"{root}/chunks", files_per_batch), idle)
        stream.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(ROWS_OUT).option("basePath", f"{root}/rows").parquet(f"{root}/rows")


def chunk_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def folded_responses(chunks: DataFrame, idle: str = "10 minutes", most_bytes: int = 10 << 20) -> DataFrame:
    """chunks (CHUNKS, a stream) -> a row (ROWS_OUT) for each response; `idle` is the watermark's delay and the time without a chunk after which a response counts as closed."""
    idle_ms = chunks.sparkSession.sql(f"SELECT timestampdiff(MILLISECOND, timestamp'1970-01-01', timestamp'1970-01-01' + INTERVAL {idle})").first()[0]
    processor = FoldResponses(idle_ms, most_bytes)
    return chunks.withWatermark("at", idle).groupBy("resp_id").transformWithState(statefulProcessor=processor, outputStructType=ROWS_OUT, outputMode="Append", timeMode="EventTime")
