"""Structured Streaming forms: metric windows over late data, sweeps as files arrive, caches and alarms in state."""

from __future__ import annotations

import heapq
import json
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mnemo.operators.metrics import metric_windows
from mnemo.sources.shared import shared_path


def stream_metric_windows(events: DataFrame, period: str, late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Metric windows that close once the watermark passes them."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return metric_windows(timed, period, ts)


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run an append stream over what there is, then read back what it wrote."""
    spark = stream.sparkSession
    path = shared_path(spark, name)
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Run a batch operator (a sweep, a classification) on what has arrived since the last run, then stop."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


LATE = "1 hour"


def _ms(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[us]").astype("int64") // 1000


class LruCache:
    """A cache of bounded size that forgets: the least recently used entry goes first, an entry after ``seconds`` at the latest.

    Entries are (key, when it was put), the least recently used first, so that they can be kept as a list.
    """

    def __init__(self, entries: list, capacity: int, seconds: int):
        self.entries, self.capacity, self.ms = dict(entries), capacity, seconds * 1000

    def ask(self, key: str, at: int) -> bool:
        """Whether ``key`` is there at the time; if not, it is put there."""
        put = self.entries.pop(key, None)
        hit = put is not None and at - put < self.ms
        self.entries[key] = put if hit else at
        if len(self.entries) > self.capacity:
            del self.entries[next(iter(self.entries))]
        return hit


class _InOrder:
    """Requests (at, asked) in the order of both, however many: runs of RUN_ROWS are sorted and laid down in files, then merged."""

    RUN_ROWS, BATCH_ROWS = 1 << 18, 1 << 12

    def __init__(self, folder: str):
        self.folder, self.held, self.rows, self.runs = folder, [], 0, 0

    def add(self, at: pa.Array, asked: pa.Array) -> None:
        self.held.append(pa.table({"at": at.cast(pa.int64()), "asked": asked.cast(pa.large_string())}))
        self.rows += len(at)
        if self.rows >= self.RUN_ROWS:
            self._lay()

    def _lay(self) -> None:
        run = pa.concat_tables(self.held)
        run = run.take(pc.sort_indices(run, [("at", "ascending"), ("asked", "ascending")]))
        with pa.OSFile(f"{self.folder}/{self.runs}", "wb") as sink, pa.ipc.new_file(sink, run.schema) as out:
            out.write_table(run, max_chunksize=self.BATCH_ROWS)
        self.held, self.rows, self.runs = [], 0, self.runs + 1

    def _read(self, run: int) -> Iterator[tuple[int, str]]:
        with pa.OSFile(f"{self.folder}/{run}") as source:
            file = pa.ipc.open_file(source)
            for k in range(file.num_record_batches):
                batch = file.get_batch(k)
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)

    def __iter__(self) -> Iterator[tuple[int, str]]:
        if self.held:
            self._lay()
        return heapq.merge(*[self._read(run) for run in range(self.runs)])


def _answers(cache: str, rows: list[tuple[int, str, bool, bool]]) -> pd.DataFrame:
    return pd.DataFrame({"cache": [cache] * len(rows), "content_hash": [r[1] for r in rows], "at": pd.Series([r[0] for r in rows], dtype="int64"), "hit": pd.Series([r[2] for r in rows], dtype="bool"), "late": pd.Series([r[3] for r in rows], dtype="bool")})


ANSWER_ROWS = 10_000


def cached_lookups(requests: DataFrame, capacity: int = 1000, seconds: int = 600, late: str = LATE) -> DataFrame:
    """(cache, content_hash, at, hit, late): requests (cache, content_hash, ts) answered by a cache of bounded size each, in the order of their time.

    ``cache`` names one of many caches, as one process has one. Requests wait until the watermark, ``late``
    behind the newest, has passed them, so the order of arrival doesn't matter; one that comes
    after that is late: a miss that the cache never sees. The watermark will be ``late`` behind a cache's own
    newest request at least, so what lies before that is answered at once and never kept: state of a cache is
    ``capacity`` entries and the requests of the last ``late``; timers answer what waits when no more comes.
    A batch may hold any number of a cache's requests: they are sorted in files, a run in memory at a time.
    """
    delay = int(pd.Timedelta(late).total_seconds() * 1000)

    def look(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entries, waiting = state.get if state.exists else ("[]", None)
        passed = state.getCurrentWatermarkMs()
        upto = passed
        with tempfile.TemporaryDirectory(prefix="lookups-") as folder:
            asked = _InOrder(folder)
            if waiting:
                kept = pa.ipc.open_stream(waiting).read_all()
                asked.add(kept["at"].combine_chunks(), kept["asked"].combine_chunks())
                upto = max(upto, pc.max(kept["at"]).as_py() - delay)
            if not state.hasTimedOut:
                for pdf in batches:
                    at, names = pa.array(_ms(pdf["ts"])), pa.array(pdf["content_hash"])
                    if not len(at):
                        continue
                    upto = max(upto, pc.max(at).as_py() - delay)
                    old = pc.less(at, passed)
                    if pc.any(old).as_py():
                        yield _answers(key[0], [(t, n, False, True) for t, n in zip(at.filter(old).to_pylist(), names.filter(old).to_pylist(), strict=True)])
                    asked.add(at.filter(pc.invert(old)), names.filter(pc.invert(old)))
            cache = LruCache(json.loads(entries), capacity, seconds)
            rows, left = [], []
            for at, name in asked:
                if at >= upto:
                    left.append((at, name))
                    continue
                rows.append((at, name, cache.ask(name, at), False))
                if len(rows) == ANSWER_ROWS:
                    yield _answers(key[0], rows)
                    rows = []
        kept = pa.table({"at": pa.array([at for at, _ in left], pa.int64()), "asked": pa.array([name for _, name in left], pa.large_string())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, kept.schema) as out:
            out.write_table(kept)
        state.update((json.dumps(list(cache.entries.items())), sink.getvalue().to_pybytes() if left else None))
        if left:
            state.setTimeoutTimestamp(max(left[0][0], passed + 1))
        yield _answers(key[0], rows)

    timed = requests.withWatermark("ts", late).select("cache", "content_hash", "ts")
    return timed.groupBy("cache").applyInPandasWithState(look, "cache string, content_hash string, at long, hit boolean, late boolean", "entries string, waiting binary", "append", GroupStateTimeout.EventTimeTimeout)


def stream_alarms(events: DataFrame, period_seconds: int, threshold: float, periods: int, below: bool = False, rate: bool = False, late: str = LATE) -> DataFrame:
    """(metric, window_start, value, breach, alarm) of every period once the watermark has closed it.

    ``events``: metric, ts, up, down. A period's value is the sum of ``up``, or with ``rate`` 100 * up / (up + down);
    a period without events is no breach and ends a run. Rows of closed periods are dropped. State of a
    metric: the sums of open periods, the last closed one and the length of its run.
    """
    step = period_seconds * 1000

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, last, run = json.loads(state.get[0]) if state.exists else ([], None, 0)
        sums = {start: [up, down] for start, up, down in held}
        passed = state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            for pdf in batches:
                start = _ms(pdf["ts"]) // step * step
                for s, part in pdf.groupby(start):
                    if s + step > passed:
                        total = sums.setdefault(int(s), [0.0, 0.0])
                        total[0] += float(part["up"].sum())
                        total[1] += float(part["down"].sum())
        rows = []
        for s in sorted(s for s in sums if s + step <= passed):
            up, down = sums.pop(s)
            value = (100.0 * up / (up + down) if up + down else None) if rate else up
            breach = value is not None and (value < threshold if below else value > threshold)
            run = (run if last == s - step else 0) + 1 if breach else 0
            last = s
            rows.append((s, value, breach, run >= periods))
        state.update((json.dumps([[[s, *v] for s, v in sums.items()], last, run]),))
        if sums:
            state.setTimeoutTimestamp(max(min(sums) + step - 1, passed + 1))
        at = pd.to_datetime(pd.Series([r[0] for r in rows], dtype="int64"), unit="ms", utc=True)
        yield pd.DataFrame({"metric": [key[0]] * len(rows), "window_start": at, "value": pd.Series([r[1] for r in rows], dtype="float64"), "breach": pd.Series([r[2] for r in rows], dtype="bool"), "alarm": pd.Series([r[3] for r in rows], dtype="bool")})

    timed = events.withWatermark("ts", late).select("metric", "ts", "up", "down")
    return timed.groupBy("metric").applyInPandasWithState(watch, "metric string, window_start timestamp, value double, breach boolean, alarm boolean", "held string", "append", GroupStateTimeout.EventTimeTimeout)
