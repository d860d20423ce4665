"""Order-dependent rules per key: token-bucket admission and time-to-live repeats.

Both rules fold over a key's rows in time order. A key may hold a large part of
the table, so its rows are never brought to one task. They are cut into time
slots by load, and

1. a partial aggregate counts the rows of each (key, slot) and gives their first
   and last time; slots of more than ``rows_per_slot`` rows are cut into shorter
   ones and counted again, down to one microsecond;
2. a slot far enough from the one before starts afresh, whatever came before;
3. for the others, the slot before is reduced to a small function from its entry
   state to its exit state (pieces ``slope * x + value``);
4. the functions of a key are composed in runs of FANOUT slots, the runs are
   chained, and the slots of each run are chained from the run's entry state;
5. every (key, slot) is folded from its entry state, all in parallel.

Times are whole microseconds and tokens whole units, so the parallel result is
the sequential one exactly.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientlens.common import small_side
from clientlens.session import scratch_path

# Bucket size, tokens per second, and seconds an entry serves.
MAX_TOKENS = 100
REFILL_RATE = 10.0
TTL_SECONDS = 3600

MICROS = 1_000_000
DAY = 86_400

# Rows of a key that one slot may hold, the fewest and most parts a crowded slot is cut into, and slots of a run.
ROWS_PER_SLOT = 100_000
LEAST_PARTS, MOST_PARTS = 64, 1024
FANOUT = 512
NEVER = -(1 << 62)

# A piecewise function: from each ``lo`` on, slope * x + value. The first piece also holds below its ``lo``.
Function = tuple[list[int], list[int], list[int]]
_PIECES = ("lo", "slope", "value")


@dataclass(frozen=True)
class Bucket:
    """Token bucket in whole units: one microsecond refills ``per_micro`` of them."""

    capacity: int
    cost: int
    per_micro: int

    @classmethod
    def of(cls, max_tokens: float, refill_rate: float, cost: float) -> Bucket:
        rate, size, price = (Fraction(str(v)) for v in (refill_rate, max_tokens, cost))
        unit = MICROS * rate.denominator * size.denominator * price.denominator
        bucket = cls(int(size * unit), int(price * unit), int(rate * unit / MICROS))
        if bucket.per_micro <= 0 or bucket.cost <= 0 or max(bucket.capacity, bucket.cost) >= 1 << 61:
            raise ValueError("refill rate and cost must be positive and the bucket of reasonable size")
        return bucket

    @property
    def full_after(self) -> int:
        """Microseconds after which any bucket is full again."""
        return -(-self.capacity // self.per_micro)

    def refill(self, tokens: int, micros: int) -> int:
        if micros >= self.full_after:
            return self.capacity
        return min(self.capacity, tokens + max(micros, 0) * self.per_micro)

    def carried(self, micros: int) -> Function:
        """``refill`` as a function of the tokens."""
        gain = max(micros, 0) * self.per_micro
        if micros >= self.full_after or gain >= self.capacity:
            return [0], [0], [self.capacity]
        return [0, self.capacity - gain], [1, 0], [gain, self.capacity]

    def run(self, times: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Admissions and tokens left for ordered times; ``tokens`` holds at the first."""
        admitted, left = np.zeros(len(times), dtype=bool), np.zeros(len(times), dtype=np.int64)
        last = int(times[0]) if len(times) else 0
        for i, now in enumerate(times.tolist()):
            tokens = self.refill(tokens, now - last)
            last = max(last, now)
            if tokens >= self.cost:
                tokens -= self.cost
                admitted[i] = True
            left[i] = tokens
        return admitted, left, tokens

    def pieces(self, times: np.ndarray) -> tuple[list[int], list[int], list[int]]:
        """Exit tokens as a function of entry tokens over the ordered times."""
        capacity, cost = self.capacity, self.cost
        from_full = capacity - cost if capacity >= cost else capacity
        parts = [(0, 1, 0)]
        last = int(times[0])
        for i, now in enumerate(times.tolist()):
            if len(parts) == 1 and not parts[0][1]:
                # Every entry state has met: the rest is one ordinary run.
                start = self.refill(parts[0][2], now - last)
                return [0], [0], [int(self.run(times[i:], start)[2])]
            gain = min(now - last, self.full_after) * self.per_micro
            last = now
            ends = [p[0] for p in parts[1:]]
            ends.append(capacity + 1)
            after: list[tuple[int, int, int]] = []

            def put(lo: int, slope: int, value: int) -> None:
                if not after or after[-1][1] != slope or after[-1][2] != value:
                    after.append((lo, slope, value))

            for (lo, slope, value), end in zip(parts, ends):
                value += gain
                if slope:
                    full, admits = capacity - value, cost - value
                    rising_end = min(end, max(full, lo))
                    if lo < rising_end:
                        if lo < admits:
                            put(lo, 1, value)
                        if admits < rising_end:
                            put(max(lo, admits), 1, value - cost)
                    if rising_end < end:
                        put(rising_end, 0, from_full)
                else:
                    value = min(value, capacity)
                    put(lo, 0, value - cost if value >= cost else value)
            parts = after
        lo, slope, value = zip(*parts)
        return list(lo), list(slope), list(value)


@dataclass(frozen=True)
class Lifetime:
    """An entry serves repeats until its age exceeds ``ttl`` microseconds."""

    ttl: int

    def carried(self, micros: int) -> Function:
        """An entry's opening time does not change with time."""
        return [NEVER], [1], [0]

    def run(self, times: np.ndarray, opened: int) -> tuple[np.ndarray, np.ndarray]:
        """Hit flags and the opening time of the entry behind each ordered row."""
        ordered = times.tolist()
        row = bisect_right(ordered, opened + self.ttl) if opened != NEVER else 0
        starts, entries = [0], [opened]
        while row < len(ordered):
            starts.append(row)
            entries.append(ordered[row])
            row = bisect_right(ordered, ordered[row] + self.ttl, row)
        hit = np.ones(len(ordered), dtype=bool)
        hit[starts[1:]] = False
        return hit, np.repeat(np.array(entries, dtype=np.int64), np.diff([*starts, len(ordered)]))

    def pieces(self, times: np.ndarray) -> tuple[list[int], list[int], list[int]]:
        """Last opening time as a function of the opening time on entry."""
        ordered = sorted(set(times.tolist()))
        n, end = len(ordered), len(ordered)
        final = [0] * n
        for i in range(n - 1, -1, -1):
            while ordered[end - 1] > ordered[i] + self.ttl:
                end -= 1
            final[i] = i if end == n else final[end]
        # Entries opened before the slot expire within one lifetime of its first row.
        lo, value = [NEVER], [ordered[final[0]]]
        for before, after in zip(ordered, final[1:]):
            if before > ordered[0] + self.ttl:
                return lo, [0] * len(lo), value
            if ordered[after] != value[-1]:
                lo.append(before - self.ttl)
                value.append(ordered[after])
        # Opened so late that the entry outlives the slot.
        return [*lo, ordered[-1] - self.ttl], [*[0] * len(lo), 1], [*value, 0]


def _apply(lo, slope, value, x: int) -> int:
    i = max(bisect_right(lo, x) - 1, 0)
    return slope[i] * x + value[i]


def _compose(first: Function, second: Function) -> Function:
    """``second`` after ``first``; slopes are 0 or 1."""
    out: list[tuple[int, int, int]] = []

    def put(lo: int, slope: int, value: int) -> None:
        if not out or out[-1][1:] != (slope, value):
            out.append((lo, slope, value))

    ends = [*first[0][1:], None]
    for lo, slope, value, end in zip(*first, ends, strict=True):
        if not slope:
            put(lo, 0, _apply(*second, value))
            continue
        at = max(bisect_right(second[0], lo + value) - 1, 0)
        put(lo, second[1][at], second[1][at] * value + second[2][at])
        for at in range(at + 1, len(second[0])):
            if end is not None and second[0][at] - value >= end:
                break
            put(second[0][at] - value, second[1][at], second[1][at] * value + second[2][at])
    lows, slopes, values = zip(*out)
    return list(lows), list(slopes), list(values)


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.RecordBatch, list[int], bool]]:
    """Sorted batches with the bounds of their groups of equal ``names``.

    The flag tells whether the first group carries on the last one of the batch before.
    """
    previous = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(n) for n in names]
        changed = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            changed[1:] |= np.asarray(pc.not_equal(c[1:], c[:-1]))
        first = tuple(c[0].as_py() for c in columns)
        yield batch, [0, *np.flatnonzero(changed).tolist(), batch.num_rows], first == previous
        previous = tuple(c[-1].as_py() for c in columns)


def _sorted_by(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Rows of a key together in one partition, in order.

    The shuffle is on a hash of the keys, not on the keys: one on the keys can
    be taken as done by a join below, which AQE may later turn into a broadcast
    join that leaves the rows where they were.
    """
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)


def _slots_by_load(rows: DataFrame, keys: list[str], slot_micros: int, rows_per_slot: int) -> tuple[DataFrame, DataFrame]:
    """Rows with ``_slot`` (where their slot starts, in microseconds), and (keys, _slot, _first, _last) of every slot.

    A round counts the rows of the slots that the round before cut. Lists of
    crowded slots have at most one row per ``rows_per_slot`` events.
    """
    spark, slot = rows.sparkSession, [*keys, "_slot"]

    def cut(df: DataFrame, crowded: DataFrame, how: str) -> DataFrame:
        joined = df.join(crowded, slot, how)
        shorter = F.greatest(F.lit(1), F.ceil(F.col("_width") / F.col("_parts"))).cast("long")
        joined = joined.withColumn("_width", F.when(F.col("_parts").isNull(), F.col("_width")).otherwise(shorter)).drop("_parts")
        return joined.withColumn("_slot", F.expr("_slot + ((_us - _slot) div _width) * _width"))

    placed = rows.withColumn("_width", F.lit(slot_micros).cast("long"))
    placed = placed.withColumn("_slot", F.col("_us") - F.pmod("_us", F.col("_width")))
    counting, spans = placed, None
    while True:
        path = scratch_path(spark, "slots")
        counting.groupBy(*slot, "_width").agg(F.count(F.lit(1)).alias("_n"), F.min("_us").alias("_first"),
                                              F.max("_us").alias("_last")).write.parquet(path)
        cells = spark.read.parquet(path)
        over = (F.col("_n") > rows_per_slot) & (F.col("_width") > 1)
        settled = cells.where(~over).select(*slot, "_first", "_last")
        spans = settled if spans is None else spans.unionByName(settled)
        crowded = cells.where(over).select(*slot, F.greatest(F.lit(LEAST_PARTS), F.least(
            F.lit(MOST_PARTS), F.ceil(4 * F.col("_n") / rows_per_slot))).alias("_parts"))
        found = crowded.count()
        if not found:
            return placed.drop("_width"), spans
        crowded = small_side(crowded, found)
        placed, counting = cut(placed, crowded, "left"), cut(counting, crowded, "inner")


def _fold_by_slot(events: DataFrame, keys: list[str], ts: str, order: str, slot_seconds: int, rows_per_slot: int,
                  linked_within: int, fresh: int, pieces: Callable, carry: Callable[[int, int], int],
                  carried: Callable[[int], Function], fold: Callable, output: T.StructType, dtypes: tuple) -> DataFrame:
    """Steps 1 to 5 of the module text.

    ``linked_within``: a slot starting at least this many microseconds after the
    one before starts from ``fresh``. ``carry(exit, gap)`` gives the next entry
    state, ``carried(gap)`` does as a function; ``fold(times, entry)`` gives new
    columns and the exit state. Every Python step reads sorted Arrow batches and
    keeps the state of one group.
    """
    columns, out_names = events.columns, output.names
    empty = tuple(np.empty(0, dtype=t) for t in dtypes)
    rows = events.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    rows, spans = _slots_by_load(rows, keys, slot_seconds * MICROS, rows_per_slot)
    chunk, run = [*keys, "_slot"], [*keys, "_run"]

    by_slot = Window.partitionBy(*keys).orderBy("_slot")
    gap = F.col("_first") - F.lag("_last").over(by_slot)
    spans = spans.withColumn("_gap", gap).withColumn("_linked", F.coalesce(F.col("_gap") < linked_within, F.lit(False)))
    spans = spans.withColumn("_needed", F.coalesce(F.lead("_linked").over(by_slot), F.lit(False)))
    spans = spans.withColumn("_run", F.floor(F.row_number().over(by_slot) / FANOUT).cast("long"))
    chained = spans.where(F.col("_linked") | F.col("_needed"))

    key_fields = [events.schema[k] for k in keys] + [T.StructField("_slot", T.LongType())]
    piece_schema = T.StructType(key_fields + [T.StructField(n, T.ArrayType(T.LongType())) for n in _PIECES])
    entry_schema = T.StructType(key_fields + [T.StructField("_entry", T.LongType())])
    run_fields = key_fields[:-1] + [T.StructField("_run", T.LongType())]
    run_schema = T.StructType(run_fields + piece_schema.fields[-len(_PIECES):])
    run_entry_schema = T.StructType(run_fields + [T.StructField("_start", T.LongType())])

    def reduce_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        held: list[np.ndarray] = []
        done: list[tuple] = []
        types: list[pa.DataType] = []

        def close() -> None:
            if key is not None:
                done.append((*key, *[[int(v) for v in p] for p in pieces(np.concatenate(held))]))

        def closed() -> pa.RecordBatch:
            values = list(zip(*done)) if done else [()] * (len(chunk) + len(_PIECES))
            arrays = [pa.array(v, t) for v, t in zip(values, [*types, *[pa.list_(pa.int64())] * len(_PIECES)])]
            done.clear()
            return pa.RecordBatch.from_arrays(arrays, names=[*chunk, *_PIECES])

        for batch, bounds, carries in _groups(batches, chunk):
            types = [batch.schema.field(c).type for c in chunk]
            times = np.asarray(batch.column("_us"), dtype=np.int64)
            keys_here = list(zip(*[batch.column(c).take(pa.array(bounds[:-1])).to_pylist() for c in chunk]))
            for n, (start, end) in enumerate(zip(bounds, bounds[1:])):
                if n or not carries:
                    close()
                    key, held = keys_here[n], []
                held.append(times[start:end])
            yield closed()
        if key is not None:
            close()
            yield closed()

    needed = spans.where("_needed").select(*chunk)
    functions = (_sorted_by(rows.select(*chunk, "_us").join(needed, chunk, "left_semi"), chunk, "_us")
                 .mapInArrow(reduce_slots, piece_schema))

    def compose_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One function for the slots of a run."""
        key: tuple | None = None
        whole: Function | None = None
        types: list[pa.DataType] = []

        def closed() -> pa.RecordBatch:
            arrays = [pa.array([v], t) for v, t in zip((*key, *whole), [*types, *[pa.list_(pa.int64())] * len(_PIECES)])]
            return pa.RecordBatch.from_arrays(arrays, names=[*run, *_PIECES])

        for batch, bounds, carries in _groups(batches, run):
            types = [batch.schema.field(c).type for c in run]
            keys_here = list(zip(*[batch.column(c).take(pa.array(bounds[:-1])).to_pylist() for c in run]))
            slots_here = list(zip(*[batch.column(n).to_pylist() for n in ("_linked", "_gap", *_PIECES)]))
            for n, (start, end) in enumerate(zip(bounds, bounds[1:])):
                if n or not carries:
                    if key is not None:
                        yield closed()
                    key, whole = keys_here[n], None
                for linked, gap_us, *function in slots_here[start:end]:
                    entry = carried(gap_us) if linked else ([NEVER], [0], [fresh])
                    after = _compose(entry, function if function[0] is not None else ([NEVER], [0], [fresh]))
                    whole = after if whole is None else _compose(whole, after)
        if key is not None:
            yield closed()

    def chain_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state each run starts from: what the run before leaves."""
        state = fresh
        for batch, bounds, carries in _groups(batches, keys):
            fresh_rows = set(bounds[1:-1] if carries else bounds[:-1])
            entries = []
            for n, function in enumerate(zip(*[batch.column(n).to_pylist() for n in _PIECES])):
                state = fresh if n in fresh_rows else state
                entries.append(state)
                state = _apply(*function, state)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in run], pa.array(entries, pa.int64())],
                                             names=[*run, "_start"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state each slot starts from, run by run."""
        state = fresh
        for batch, bounds, carries in _groups(batches, run):
            first_rows = set(bounds[1:-1] if carries else bounds[:-1])
            entries = []
            rows_here = zip(*[batch.column(n).to_pylist() for n in ("_start", "_linked", "_gap", *_PIECES)])
            for n, (opening, linked, gap_us, *function) in enumerate(rows_here):
                if n in first_rows:
                    state = opening
                start = carry(state, gap_us) if linked else fresh
                entries.append(start)
                state = fresh if function[0] is None else _apply(*function, start)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in chunk], pa.array(entries, pa.int64())],
                                             names=[*chunk, "_entry"])

    links = chained.select(*chunk, "_run", "_linked", "_gap").join(functions, chunk, "left")
    composed = _sorted_by(links, run, "_slot").mapInArrow(compose_runs, run_schema)
    starts = _sorted_by(composed, keys, "_run").mapInArrow(chain_runs, run_entry_schema)
    entries = _sorted_by(links.join(starts, run), run, "_slot").mapInArrow(chain, entry_schema)

    def folded_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last, opening = fresh, 0, False
        for batch, bounds, carries in _groups(batches, chunk):
            times = np.asarray(batch.column("_us"), dtype=np.int64)
            first = batch.column("_entry").take(pa.array(bounds[:-1])).to_pylist()
            kept = np.ones(batch.num_rows, dtype=bool)
            folded = [empty]
            for n, (start, end) in enumerate(zip(bounds, bounds[1:])):
                if first[n] is not None:
                    # The slot's entry state goes ahead of its rows.
                    kept[start] = False
                    state, opening = first[n], True
                    start += 1
                    if start == end:
                        continue
                elif n or not carries:
                    state = fresh
                elif not opening:
                    state = carry(state, int(times[start]) - last)
                opening = False
                new, state = fold(times[start:end], state)
                folded.append(new)
                last = int(times[end - 1])
            rows_here = batch.filter(pa.array(kept)) if not kept.all() else batch
            added = [pa.array(np.concatenate(part)) for part in zip(*folded)]
            yield pa.RecordBatch.from_arrays([*[rows_here.column(c) for c in columns], *added], names=[*columns, *out_names])

    # Entry states travel as rows of their own ahead of the slot's first row, so
    # that the events are shuffled once and joined with nothing.
    tagged = (rows.withColumn("_entry", F.lit(None).cast("long"))
              .unionByName(entries.withColumn("_us", F.lit(NEVER).cast("long")), allowMissingColumns=True))
    return _sorted_by(tagged, chunk, "_us", order).mapInArrow(
        folded_rows, T.StructType(events.schema.fields + output.fields))


def rate_limit(events: DataFrame, key: str, ts: str = "timestamp", order: str = "event_id",
               max_tokens: float = MAX_TOKENS, refill_rate: float = REFILL_RATE, cost: float = 1,
               slot_seconds: int = DAY, rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """Adds ``admitted`` and ``tokens_left`` by a token bucket per key.

    The bucket starts full and refills continuously; a refused request costs
    nothing. Rows of equal time go by ``order``. Rows without a key or time are
    left out.
    """
    bucket = Bucket.of(max_tokens, refill_rate, cost)
    per_token = bucket.capacity / float(Fraction(str(max_tokens)))

    def fold(times, start):
        admitted, left, tokens = bucket.run(times, start)
        return (admitted, left / per_token), tokens

    output = T.StructType([T.StructField("admitted", T.BooleanType()), T.StructField("tokens_left", T.DoubleType())])
    rows = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    return _fold_by_slot(rows, [key], ts, order, slot_seconds, rows_per_slot, bucket.full_after, bucket.capacity,
                         bucket.pieces, bucket.refill, bucket.carried, fold, output, (bool, float))


def ttl_repeats(events: DataFrame, keys: str | list[str], ts: str = "timestamp", order: str = "event_id",
                ttl: int = TTL_SECONDS, slot_seconds: int = DAY,
                rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """Adds ``hit`` (served by a live entry) and ``opened_us``, the entry's opening time.

    The first request opens an entry; it serves repeats while its age is at most
    ``ttl`` seconds and is not extended by them.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    life = Lifetime(int(ttl * MICROS))

    def fold(times, start):
        hit, entry = life.run(times, start)
        return (hit, entry), int(entry[-1])

    output = T.StructType([T.StructField("hit", T.BooleanType()), T.StructField("opened_us", T.LongType())])
    rows = events.where(F.col(ts).isNotNull())
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    return _fold_by_slot(rows, keys, ts, order, slot_seconds, rows_per_slot, life.ttl + 1, NEVER,
                         life.pieces, lambda opened, gap: opened, life.carried, fold, output, (bool, np.int64))


def ttl_dedup(events: DataFrame, keys: str | list[str], ts: str = "timestamp", order: str = "event_id",
              ttl: int = TTL_SECONDS, slot_seconds: int = DAY,
                rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """The requests that opened an entry."""
    marked = ttl_repeats(events, keys, ts, order, ttl, slot_seconds, rows_per_slot)
    return marked.where(~F.col("hit")).drop("hit", "opened_us")
