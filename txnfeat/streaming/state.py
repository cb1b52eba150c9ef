"""Keyed state for strictly-prior history: the streaming form of operators.history, for the same specification.

State of an entity: moments of all rows before the open clock value, moments of the rows of the open one (only without a
tie-break: they become visible when a later clock value comes, in this micro-batch or in any later one), the last
position, and the rows that rolling windows can still reach. All rows of an entity in a micro-batch are sorted before
they are used. A row behind its entity's position is late: it comes out with a reason and without features.

Entities are grouped by a hash, because a call of the processor costs far more than a row; the state is a map with an entry
for each entity, and only entries of a micro-batch's entities are read and written."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.history import History
from ..session import ship

LATE, NO_CLOCK = "LATE_EVENT", "BAD_FIELD_TYPE"
# n: rows with an amount.
_MOMENTS = ("rows", "n", "mean", "m2", "total", "top", "shares")
# Names that begin with an underscore are lost on the way to pandas.
_ENTITY, _GROUP = "history_entity", "history_group"
#: Fixed, because the state is kept by it: other numbers can't continue a checkpoint.
GROUPS = 1024


def _state_type() -> T.StructType:
    """Lists have no structs in them, whose conversion takes longer than the state itself."""
    longs, doubles = T.ArrayType(T.LongType()), T.ArrayType(T.DoubleType())
    kinds = {"rows": T.LongType(), "n": T.LongType(), "shares": longs}
    moments = lambda p: [T.StructField(f"{p}_{m}", kinds.get(m, T.DoubleType())) for m in _MOMENTS]
    position = [T.StructField(c, T.LongType()) for c in ("clock", "tie", "before")]
    recent = [T.StructField(f"recent_{c}", k) for c, k in (("clock", longs), ("n", longs), ("total", doubles))]
    return T.StructType([*moments("past"), *moments("open"), *position, *recent])


def output_type(schema: T.StructType, h: History, share_names: list[str]) -> T.StructType:
    n = h.names
    return T.StructType([
        *(T.StructField(f.name, f.dataType, True) for f in schema),
        T.StructField(n["count"], T.IntegerType()), *(T.StructField(n[k], T.DoubleType()) for k in ("sum", "mean", "std", "max")),
        *(T.StructField(k, T.IntegerType()) for k in h.rolling_counts), *(T.StructField(k, T.DoubleType()) for k in h.rolling_sums),
        T.StructField(n["first"], T.ByteType()), T.StructField(n["since"], T.IntegerType()), T.StructField(n["zscore"], T.DoubleType()),
        *(T.StructField(k, T.DoubleType()) for k in share_names), T.StructField("reason_code", T.StringType()),
    ])


class HistoryProcessor(StatefulProcessor):
    """share_flags: name of the share, and the 0/1 input column that it counts. Rows come with their entity as _ENTITY."""

    def __init__(self, h: History, schema: T.StructType, share_flags: dict[str, str], min_count: int = 3, min_std: float = 1e-5):
        self.h, self.schema, self.share_flags, self.min_count, self.min_std = h, schema, share_flags, min_count, min_std
        self.width = max([*h.rolling_counts.values(), *h.rolling_sums.values(), 0])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.histories = handle.getMapState("histories", T.StructType([T.StructField("entity", T.StringType())]), _state_type())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        h = self.h
        batch = pd.concat(list(rows), ignore_index=True)
        order = [h.clock, h.tie_break] if h.tie_break else [h.clock]
        usable = batch[order].notna().all(axis=1)
        codes, entities = pd.factorize(batch[_ENTITY], use_na_sentinel=False)
        good = batch.assign(**{_GROUP: codes})[usable].sort_values([_GROUP, *order], kind="stable", ignore_index=True)
        codes, clocks = good[_GROUP].to_numpy(), good[h.clock].astype("int64").tolist()
        ties = good[h.tie_break].astype("int64").tolist() if h.tie_break else clocks
        amounts = good[h.amount].astype("float64").tolist()
        hits = list(zip(*(good[c].fillna(0).astype(int).tolist() for c in self.share_flags.values()), strict=True)) if self.share_flags else [()] * len(good)
        known = self.histories.exists()
        late, out = np.zeros(len(good), bool), []
        edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(good)] if len(good) else []
        for start, end in zip(edges, edges[1:]):
            entity = entities[codes[start]]
            entity = None if pd.isna(entity) else entity
            history = _History(self, self.histories.getValue((entity,)) if known else None)
            # In order, so the late rows come first.
            first = start
            while first < end and history.passed(clocks[first], ties[first]):
                first += 1
            late[start:first] = True
            if first < end:
                out += history.features(*(x[first:end] for x in (clocks, ties, amounts, hits)))
                self.histories.updateValue((entity,), history.state())
        kinds = output_type(self.schema, h, list(self.share_flags))
        if out:
            names = kinds.names[len(self.schema) : -1]
            made = pd.DataFrame({k: np.array(v, float) for k, v in zip(names, zip(*out, strict=True), strict=True)})
            yield _typed(pd.concat([good[~late].reset_index(drop=True), made], axis=1), kinds)
        for rows_, why in ((good[late], LATE), (batch[~usable], NO_CLOCK)):
            if len(rows_):
                yield _typed(rows_.assign(reason_code=why), kinds)

    def close(self) -> None:
        pass


class _History:
    """The history of one entity, taken from its state (None: a new one) and back to it."""

    def __init__(self, p: HistoryProcessor, state):
        self.p, self.tied = p, bool(p.h.tie_break)
        self.fresh = (0, 0, 0.0, 0.0, 0.0, float("-inf"), (0,) * len(p.share_flags))
        k = len(_MOMENTS)
        if state is None:
            self.past = self.open = self.fresh
            self.clock = self.tie = self.before = None
            # One entry for each value of the clock in the widest window, however many rows it has.
            self.times, self.rows, self.totals = [], [], []
        else:
            self.past, self.open = ((*x[:-1], tuple(x[-1])) for x in (state[:k], state[k : 2 * k]))
            self.clock, self.tie, self.before = state[2 * k : 2 * k + 3]
            self.times, self.rows, self.totals = (list(x) for x in state[2 * k + 3 :])

    def passed(self, clock: int, tie: int) -> bool:
        """Whether a row comes too late."""
        return self.clock is not None and (clock < self.clock or self.tied and clock == self.clock and tie <= self.tie)

    def features(self, clocks: list, ties: list, amounts: list, hits: list) -> list[tuple]:
        """The features of the next rows (amount: NaN if there is none), in the order of the output.

        One loop over plain variables: this is what a row costs, and calls and attributes were most of it."""
        p, tied, out = self.p, self.tied, []
        rows, n, mean, m2, total, top, shares = self.past
        rows_o, n_o, mean_o, m2_o, total_o, top_o, shares_o = self.open
        clock, before = self.clock, self.before
        times, counts, totals = self.times, self.rows, self.totals
        # Of all entries before each.
        count_before, total_before = ([0, *accumulate(x)][: len(x)] for x in (counts, totals))
        widths = list(dict.fromkeys((*p.h.rolling_counts.values(), *p.h.rolling_sums.values())))
        counted, summed = ([widths.index(w) for w in x.values()] for x in (p.h.rolling_counts, p.h.rolling_sums))
        lows, head = [0] * len(widths), None
        for at, amount, hit in zip(clocks, amounts, hits, strict=True):
            new, known = at != clock, amount == amount
            if tied:
                before = clock
            elif new and clock is not None:
                if n_o:
                    d, both = mean_o - mean, n + n_o
                    m2 += m2_o + d * d * n * n_o / both
                    mean += d * n_o / both
                    total += total_o
                    n = both
                    if top_o > top:
                        top = top_o
                rows += rows_o
                shares = tuple(map(add, shares, shares_o))
                (rows_o, n_o, mean_o, m2_o, total_o, top_o, shares_o), before = self.fresh, clock
            if new and widths:
                count_before.append(count_before[-1] + counts[-1] if counts else 0)
                total_before.append(total_before[-1] + totals[-1] if counts else 0.0)
                times.append(at)
                counts.append(0)
                totals.append(0.0)
            if new or head is None:
                # Rolling counts and sums of the entries before the last, which is the clock's own.
                for i, w in enumerate(widths):
                    low, least = lows[i], at - w
                    while times[low] < least:
                        low += 1
                    lows[i] = low
                rolling = [count_before[-1] - count_before[lows[i]] for i in counted] + [total_before[-1] - total_before[lows[i]] for i in summed]
            if new or tied or head is None:
                std = (m2 / (n - 1)) ** 0.5 if n > 1 else None
                scored = rows >= p.min_count and std is not None and std > p.min_std
                head = (rows, total, mean if n else None, std, top if n else None, *rolling, int(rows == 0), None if before is None else at - before)
                tail = [x / rows if rows else None for x in shares]
            out.append((*head, (amount - mean) / std if scored else None, *tail))
            if widths:
                counts[-1] += 1
                if known:
                    totals[-1] += amount
            if tied:
                rows += 1
                if hit:
                    shares = tuple(map(add, shares, hit))
                if known:
                    n += 1
                    d = amount - mean
                    mean += d / n
                    m2 += d * (amount - mean)
                    total += amount
                    if amount > top:
                        top = amount
            else:
                rows_o += 1
                if hit:
                    shares_o = tuple(map(add, shares_o, hit))
                if known:
                    n_o += 1
                    d = amount - mean_o
                    mean_o += d / n_o
                    m2_o += d * (amount - mean_o)
                    total_o += amount
                    if amount > top_o:
                        top_o = amount
            clock = at
        self.past, self.open = (rows, n, mean, m2, total, top, shares), (rows_o, n_o, mean_o, m2_o, total_o, top_o, shares_o)
        self.clock, self.tie, self.before = clock, ties[-1], before
        return out

    def state(self) -> tuple:
        pack = lambda m: (*m[:-1], list(m[-1]))
        low = bisect_left(self.times, self.clock - self.p.width)
        return *pack(self.past), *pack(self.open), self.clock, self.tie, self.before, self.times[low:], self.rows[low:], self.totals[low:]


def _typed(f: pd.DataFrame, schema: T.StructType) -> pd.DataFrame:
    """The schema's columns in its order, with nullable types, so that an integer column with nulls stays one."""
    kinds = {"integer": "Int32", "byte": "Int8", "long": "Int64", "double": "Float64"}
    out = {}
    for s in schema:
        col = f[s.name] if s.name in f else pd.Series([None] * len(f), index=f.index)
        kind = kinds.get(s.dataType.typeName())
        out[s.name] = col.astype(kind) if kind else col.astype(object).where(col.notna(), None)
    return pd.DataFrame(out).reset_index(drop=True)


def with_state(df: DataFrame, h: History, share_flags: dict[str, str] | None = None) -> DataFrame:
    """`df` (a stream) with the history's features and reason_code (null, or why the row has no features).

    All of its columns go through Python, row by row; see pipelines for a way around with many of them."""
    ship(df.sparkSession)
    flags = share_flags or {}
    entity = F.col(h.entity).cast("string")
    grouped = df.select("*", entity.alias(_ENTITY), F.pmod(F.xxhash64(entity), F.lit(GROUPS)).cast("int").alias(_GROUP)).groupBy(_GROUP)
    return grouped.transformWithStateInPandas(HistoryProcessor(h, df.schema, flags), output_type(df.schema, h, list(flags)), outputMode="Append", timeMode="None")
