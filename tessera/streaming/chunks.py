"""Event streams that come in byte chunks cut anywhere: a stateful operator carries what a chunk leaves unfinished.

The operator only finds where an event's empty line is complete and hands out whole events as text; their fields are
read by the same expressions as those of whole texts (``operators.files.stream_events``). Chunks of a stream have
numbers from 0. A batch reads them in order, one chunk at a time; a stream keeps an early chunk until its turn comes and
ignores one that it has had, so a source that delivers twice changes nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructType

from tessera.operators.files import stream_events

#: An empty line behind another line, or at the start: events end with one.
_END = re.compile(rb"\n\r?\n")
_FRAME = StructType().add("stream", StringType()).add("at", LongType()).add("text", StringType())


def _cut(tail: bytes, new: bytes) -> int:
    """How many bytes of new belong to finished events; tail is what comes before it (its last two bytes are enough)."""
    seen, last = tail[-2:] + new, 0
    for m in _END.finditer(seen):
        last = m.end()
    return max(0, last - len(tail[-2:]))


def _text(parts: list[bytes]) -> str:
    return b"".join(parts).decode("utf-8", "replace")


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finished events of streams whose chunks come in order. Holds the unfinished event of one stream."""
    schema = pa.schema([("stream", pa.string()), ("at", pa.int64()), ("text", pa.string())])
    now, at, held, first = None, 0, [], True
    for batch in batches:
        out = []
        for stream, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if first or stream != now:
                out += [(now, at, _text(held))] if held else []
                now, at, held, first = stream, 0, [], False
            n = _cut(b"".join(held[-2:]), chunk)
            if n:
                out.append((now, at, _text([*held, chunk[:n]])))
                at, held, chunk = at + sum(map(len, held)) + n, [], chunk[n:]
            if chunk:
                held.append(chunk)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([at]), pa.array([_text(held)])], schema=schema)


class Frames(StatefulProcessor):
    """State of a stream: the next chunk's number, where its unfinished event starts, that event's parts, and early chunks."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", StructType().add("next", LongType()).add("at", LongType()).add("size", LongType()).add("tail", BinaryType()))
        self.parts = handle.getListState("parts", StructType().add("part", BinaryType()))
        self.early = handle.getMapState("early", StructType().add("n", LongType()), StructType().add("chunk", BinaryType()).add("last", BooleanType()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        following, at, size, tail = self.place.get() if self.place.exists() else (0, 0, 0, b"")
        came: dict[int, tuple[bytes, bool]] = {}
        for frame in rows:
            for n, chunk, last in zip(frame["n"], frame["chunk"], frame["last"], strict=True):
                if n >= following:
                    came.setdefault(int(n), (bytes(chunk or b""), bool(last)))
        new, ended = [], False
        while not ended:
            if following in came:
                chunk, ended = came.pop(following)
            elif self.early.exists() and self.early.containsKey((following,)):
                chunk, ended = self.early.getValue((following,))
                self.early.removeKey((following,))
            else:
                break
            new.append(bytes(chunk))
            following += 1
        for n, (chunk, last) in came.items():
            self.early.updateValue((n,), (chunk, last))
        data = b"".join(new)
        done = len(data) if ended else _cut(bytes(tail), data)
        if done or ended and size:
            before = b"".join(bytes(x[0]) for x in self.parts.get()) if size else b""
            yield pd.DataFrame({"stream": [key[0]], "at": [at], "text": [(before + data[:done]).decode("utf-8", "replace")]})
            at, size, data, tail = at + size + done, 0, data[done:], data[:done]
            self.parts.clear()
        if data:
            self.parts.appendValue((data,))
        self.place.update((following, at, size + len(data), (bytes(tail) + data)[-2:]))

    def close(self) -> None:
        pass


def frames(chunks: DataFrame, stream: str, n: str, chunk: str, last: str | None = None) -> DataFrame:
    """Whole events of each stream: stream, at (the byte that text starts at), text (one event or more).

    last tells the last chunk of a stream, after which an event without an empty line counts too; a batch takes the
    chunk with the largest number for it. Streams need the RocksDB state store. A null chunk is
    empty, of chunks with one number any counts once, bytes that aren't UTF-8 are replaced."""
    named = chunks.select(F.col(stream).cast("string").alias("stream"), F.col(n).cast("bigint").alias("n"), F.coalesce(F.col(chunk).cast("binary"), F.lit(b"")).alias("chunk"), (F.coalesce(F.col(last), F.lit(False)) if last else F.lit(False)).alias("last"))
    if chunks.isStreaming:
        return named.groupBy("stream").transformWithStateInPandas(Frames(), _FRAME, "Append", "None")
    ordered = named.dropDuplicates(["stream", "n"]).repartition("stream").sortWithinPartitions("stream", "n")
    return ordered.select("stream", "chunk").mapInArrow(_frames, _FRAME)


def events_of_chunks(chunks: DataFrame, stream: str, n: str, chunk: str, last: str | None = None) -> DataFrame:
    """Events of chunked streams: stream, at, n (order within at), event, data, last_id, retry."""
    whole = frames(chunks, stream, n, chunk, last).withColumn("_key", F.struct("stream", "at"))
    return stream_events(whole, "_key", "text").select("_key.stream", "_key.at", "n", "event", "data", "last_id", "retry")
