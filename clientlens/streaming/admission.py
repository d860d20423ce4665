"""Token bucket and time-to-live rules on streams, with state per key.

Keys are dealt to ``BUCKETS`` buckets by a hash. A bucket is one group of Spark, which costs the same however few rows it has,
and its keys' states are the entries of one map.

``answers="arrival"`` answers at once: the rows of a bucket are folded as they come,
in pieces of about ``PIECE_ROWS`` rows, each in time order. A row older than the state of
its key counts as arriving at the state's time, so the result equals the batch
operators' when each key's rows arrive in order.

``answers="time"`` answers when the watermark has passed: rows wait in the state in
cells of ``cell_seconds``, one timer for each, and a cell is folded in time order
once no more rows can come for it. The result equals the batch operators'
whatever the order of arrival, and memory holds the rows of one bucket and cell.

Rows later than ``lateness`` behind the newest are dropped by the watermark. A
state is cleared by a timer once every row that may still come would find the same without it: a token bucket when it is
full again, an entry when it has expired. Timers go off once a lifetime at most, so an idle state stays for two at most.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from clientlens.operators.admission import MAX_TOKENS, MICROS, NEVER, REFILL_RATE, TTL_SECONDS, Bucket, Lifetime

LATENESS = "1 hour"
CELL_SECONDS = 60
#: Fixed for good: a checkpoint's states lie in their buckets.
BUCKETS = 1024
PIECE_ROWS = 200_000
#: Key values as text, times to the microsecond.
_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


class _Fold(StatefulProcessor):
    """Folds the rows of a bucket's keys, each from its stored state (a, b, due): ``b`` is the time of the last row, ``due`` when to forget."""

    def __init__(self, order: str, columns: list[str], cell: int | None):
        self.order = order
        self.columns = columns
        self.cell = cell

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getMapState("state", "key string", "a long, b long, due long")
        self.wake = handle.getValueState("wake", "at long")
        if self.cell:
            self.pieces = handle.getMapState("pieces", "cell long", "n long")
            self.waiting = handle.getMapState("waiting", "cell long, piece long", "rows binary")

    def fold(self, times: np.ndarray, state: tuple[int, int] | None):
        """New columns and the state after the ordered times."""
        raise NotImplementedError

    @property
    def span(self) -> int:
        """Microseconds a state matters at most."""
        raise NotImplementedError

    def forget_after(self, state: tuple[int, int]) -> int:
        """The microsecond up to which a later row depends on the state."""
        raise NotImplementedError

    def _folded(self, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_us", self.order], ignore_index=True)
        times, parts, least = pdf["_us"].to_numpy(dtype=np.int64), [], None
        groups = pdf.groupby("_key", sort=False).indices
        for key, rows in groups.items():
            before = self.state.getValue((key,))[:2] if self.state.containsKey((key,)) else None
            new, after = self.fold(times[rows], before and tuple(before))
            parts.append(new)
            due = self.forget_after(after) // 1000 + 1
            self.state.updateValue((key,), (*after, due))
            least = due if least is None else min(least, due)
        self._wake_at(least)
        places = np.concatenate(list(groups.values()))
        cells = {}
        for name in parts[0]:
            joined = np.concatenate([part[name] for part in parts])
            cells[name] = np.empty_like(joined)
            cells[name][places] = joined
        return pdf[self.columns].assign(**cells)

    def _wake_at(self, due: int) -> None:
        """A timer for the end of the lifetime that ``due`` falls in, unless an earlier one is set."""
        span = self.span // 1000 + 1
        due = -(-due // span) * span
        before = self.wake.get()[0] if self.wake.exists() else None
        if before is None or due < before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(due)
            self.wake.update((due,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in rows:
            pdf.columns = [*self.columns, "_us", "_time", "_key", "_bucket"]
            pdf = pdf.drop(columns=["_time", "_bucket"])
            if self.cell:
                self._put_aside(pdf)
            elif len(pdf):
                held.append(pdf)
                size += len(pdf)
                if size >= PIECE_ROWS:
                    yield self._folded(pd.concat(held))
                    held, size = [], 0
        if held:
            yield self._folded(pd.concat(held))

    def _put_aside(self, pdf: pd.DataFrame) -> None:
        for cell, part in pdf.groupby(pdf["_us"] // self.cell):
            cell = int(cell)
            n = self.pieces.getValue((cell,))[0] if self.pieces.containsKey((cell,)) else 0
            if not n:
                self.handle.registerTimer((cell + 1) * self.cell // 1000)
            self.waiting.updateValue((cell, n), (pickle.dumps(part),))
            self.pieces.updateValue((cell,), (n + 1,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        if self.cell:
            # A bucket's cells go in order, whichever of their timers comes first.
            for cell in sorted(c for (c,) in self.pieces.keys() if (c + 1) * self.cell // 1000 <= passed):
                places = [(cell, n) for n in range(self.pieces.getValue((cell,))[0])]
                pdf = pd.concat([pickle.loads(self.waiting.getValue(p)[0]) for p in places])
                for place in places:
                    self.waiting.removeKey(place)
                self.pieces.removeKey((cell,))
                yield self._folded(pdf)
        if self.wake.exists() and self.wake.get()[0] <= expiredTimerInfo.getExpiryTimeInMs():
            self.wake.clear()
            gone, least = [], None
            for (name,), (_, _, due) in self.state.iterator():
                if due <= passed:
                    gone.append(name)
                else:
                    least = due if least is None else min(least, due)
            for name in gone:
                self.state.removeKey((name,))
            if least is not None:
                self._wake_at(least)

    def close(self) -> None:
        pass


class _BucketFold(_Fold):
    def __init__(self, order, columns, cell, bucket: Bucket, per_token: float):
        super().__init__(order, columns, cell)
        self.bucket = bucket
        self.per_token = per_token

    def fold(self, times, state):
        tokens = self.bucket.capacity
        if state is not None:
            times = np.maximum(times, state[1])
            tokens = self.bucket.refill(state[0], int(times[0]) - state[1])
        admitted, left, tokens = self.bucket.run(times, tokens)
        return {"admitted": admitted, "tokens_left": left / self.per_token}, (int(tokens), int(times[-1]))

    @property
    def span(self):
        return self.bucket.full_after

    def forget_after(self, state):
        return state[1] + self.bucket.full_after


class _LifetimeFold(_Fold):
    def __init__(self, order, columns, cell, life: Lifetime):
        super().__init__(order, columns, cell)
        self.life = life

    def fold(self, times, state):
        opened = NEVER
        if state is not None:
            times = np.maximum(times, state[1])
            opened = state[0]
        hit, entry = self.life.run(times, opened)
        return {"hit": hit, "opened_us": entry}, (int(entry[-1]), int(times[-1]))

    @property
    def span(self):
        return self.life.ttl

    def forget_after(self, state):
        return state[0] + self.life.ttl


def _transformed(events: DataFrame, keys: list[str], ts: str, lateness: str, processor: _Fold, output: T.StructType) -> DataFrame:
    timed = events.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp"))).where(F.col("_us").isNotNull())
    for k in keys:
        timed = timed.where(F.col(k).isNotNull())
    timed = timed.withColumn("_time", F.timestamp_micros("_us")).withWatermark("_time", lateness)
    timed = timed.withColumn("_key", F.to_json(F.struct(*keys), _EXACT)).withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(BUCKETS)))
    schema = T.StructType(events.schema.fields + output.fields)
    return timed.groupBy("_bucket").transformWithStateInPandas(processor, schema, "Append", "EventTime")


def _cell(order: str, cell_seconds: int) -> int | None:
    if order not in ("arrival", "time"):
        raise ValueError("rows go in order of arrival or of time")
    return cell_seconds * MICROS if order == "time" else None


def stream_rate_limit(events: DataFrame, key: str, ts: str = "timestamp", order: str = "event_id",
                      max_tokens: float = MAX_TOKENS, refill_rate: float = REFILL_RATE, cost: float = 1,
                      answers: str = "arrival", lateness: str = LATENESS, cell_seconds: int = CELL_SECONDS) -> DataFrame:
    """Streaming form of ``rate_limit``; ``answers`` is the module text's order, "arrival" or "time"."""
    bucket = Bucket.of(max_tokens, refill_rate, cost)
    processor = _BucketFold(order, events.columns, _cell(answers, cell_seconds), bucket,
                            bucket.capacity / float(Fraction(str(max_tokens))))
    output = T.StructType([T.StructField("admitted", T.BooleanType()), T.StructField("tokens_left", T.DoubleType())])
    return _transformed(events, [key], ts, lateness, processor, output)


def stream_ttl_repeats(events: DataFrame, keys: str | list[str], ts: str = "timestamp", order: str = "event_id",
                       ttl: int = TTL_SECONDS, answers: str = "arrival", lateness: str = LATENESS,
                       cell_seconds: int = CELL_SECONDS) -> DataFrame:
    """Streaming form of ``ttl_repeats``; ``answers`` is the module text's order, "arrival" or "time"."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    processor = _LifetimeFold(order, events.columns, _cell(answers, cell_seconds), Lifetime(int(ttl * MICROS)))
    output = T.StructType([T.StructField("hit", T.BooleanType()), T.StructField("opened_us", T.LongType())])
    return _transformed(events, keys, ts, lateness, processor, output)
