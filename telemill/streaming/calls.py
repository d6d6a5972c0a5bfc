"""Tool calls of a stream: contributions without a use id wait in state for the call that they belong to.

The state of a session holds its calls and the contributions that are not yet
placed.  A contribution is placed once all that was received up to its time, the
window and ``grace`` is there; it then claims the nearest open call, started
before or after it, as :func:`telemill.operators.tool_calls.assign_keyless` does
over a whole table.  Time moves by receipt, so no row is ever too late to be
taken: one that arrives after its turn is placed at once, among the calls that
the state still has.  Nothing is read from storage.

What is known when a contribution is placed counts: a call's start is the least
time of its rows that have arrived.  A call is kept until twice the window after
its result, or ``keep`` after its start when none comes.

Placed contributions are stored by the day of their time.  The projection is
folded anew for the days that a batch touches and their neighbours, so that what
a batch reads does not grow with history; a call lasts a day at most.
"""

from __future__ import annotations

import bisect
import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from telemill.operators import tool_calls
from telemill.sources import days

MINUTE = 60_000_000
GRACE = 5 * MINUTE
KEEP = 24 * 60 * MINUTE
OUTPUT = "session_id string, call_id string, heuristic boolean, row string"


class Matcher(StatefulProcessor):
    """Places the contributions of a session; times are microseconds.

    Open calls and waiting contributions are one value, read and written once a
    batch: both are few, as calls that nothing can claim any more are forgotten.
    Only the numbers of opened calls stay for good, a value for each prompt and tool.
    """

    def __init__(self, window: int = tool_calls.WINDOW_SECONDS * 1_000_000, grace: int = GRACE, keep: int = KEEP):
        self.window, self.grace, self.keep = window, grace, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "held string")
        self.numbers = handle.getMapState("numbers", "place string", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        out = []
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                if pd.isna(r.call_id):
                    held["asks"].append([int(r.at), None if pd.isna(r.vendor_seq) else int(r.vendor_seq), r.dedup_key, json.dumps(["" if pd.isna(r.prompt_id) else r.prompt_id, r.tool_name]), r.row])
                else:
                    _known(held["calls"], r)
                    out.append((key[0], r.call_id, False, r.row))
        yield from self._given(out + self._placed(key[0], held, timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        held["timer"] = None
        yield from self._given(self._placed(key[0], held, timerValues))

    def close(self) -> None:
        pass

    def _held(self) -> dict:
        """calls: by id [place, time of the prompt, of the start, of the first row, of the result, number if a contribution opened it, claimed]; asks: contributions that wait; timer: when the next is due."""
        return json.loads(self.open.get()[0]) if self.open.exists() else {"calls": {}, "asks": [], "timer": None}

    @staticmethod
    def _given(out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame(out, columns=["session_id", "call_id", "heuristic", "row"])

    def _placed(self, session: str, held: dict, timerValues) -> list[tuple]:
        """Place what is due, in order of time; set the timer of what is not; forget calls that nothing can claim any more."""
        now, calls = timerValues.getCurrentWatermarkInMs() * 1000, held["calls"]
        due = sorted((a for a in held["asks"] if a[0] + self.window + self.grace <= now), key=lambda a: (a[0], a[1] is None, a[1] or 0, a[2]))
        held["asks"] = [a for a in held["asks"] if a[0] + self.window + self.grace > now]
        wanted, numbers = {a[3] for a in due}, {}
        pools: dict[str, list[tuple]] = {place: [] for place in wanted}
        for call_id, c in calls.items():
            if c[0] in wanted and not c[6]:
                pools[c[0]].append((_start(c), call_id))
        for pool in pools.values():
            pool.sort()
        out = []
        for at, _, _, place, row in due:
            found = _claimed(pools[place], calls, at, self.window)
            if found is not None:
                call = calls[found]
                call[6] = True
                out.append((session, found, call[5] is None, row))
            else:
                if place not in numbers:
                    numbers[place] = self.numbers.getValue((place,))[0] if self.numbers.containsKey((place,)) else 0
                n = numbers[place]
                numbers[place] = n + 1
                call_id = str(uuid.uuid5(uuid.UUID(tool_calls.NAMESPACE), "|".join([session, *json.loads(place), str(n)])))
                calls[call_id] = [place, None, None, at, None, n, False]
                bisect.insort(pools[place], (at, call_id))
                out.append((session, call_id, False, row))
        for place, n in numbers.items():
            self.numbers.updateValue((place,), (n,))
        held["calls"] = {k: c for k, c in calls.items() if self._last(c) + 2 * self.window + self.grace >= now}
        timer = min((a[0] for a in held["asks"]), default=None)
        timer = None if timer is None else (timer + self.window + self.grace) // 1000 + 1
        if timer != held["timer"]:
            if held["timer"] is not None:
                self.handle.deleteTimer(held["timer"])
            if timer is not None:
                self.handle.registerTimer(timer)
            held["timer"] = timer
        self.open.update((json.dumps(held),))
        return out

    def _last(self, call: list) -> int:
        """The last time that counts for how long a call is kept."""
        result_at, opened = call[4:6]
        start = _start(call)
        return max(start, start if opened is not None else start + self.keep if result_at is None else result_at)


def _start(call: list) -> int:
    return call[3] if call[2] is None else call[2]


def _claimed(pool: list[tuple], calls: dict[str, list], at: int, window: int) -> str | None:
    """Take the nearest open call out of ``pool``, which is (start, id) in order of one place's unclaimed calls; none within the window.

    Contributions ask in order of time, so a call that has its result by now is taken out for good.
    """
    best, far = None, window
    k = bisect.bisect_left(pool, (at,))
    for step in (-1, 1):
        i = k - 1 if step < 0 else k
        while 0 <= i < len(pool) and abs(pool[i][0] - at) <= far:
            start, call_id = pool[i]
            result_at, opened = calls[call_id][4:6]
            if result_at is not None and result_at <= at:
                del pool[i]
                if step < 0:
                    i, k = i - 1, k - 1
                continue
            rank = (abs(start - at), opened is not None, opened or 0, start, call_id)
            if best is None or rank < best:
                best, far = rank, rank[0]
            i += step
    if best is None:
        return None
    del pool[bisect.bisect_left(pool, best[-2:])]
    return best[-1]


def _known(calls: dict[str, list], r) -> None:
    """Add a row with a use id to what is known of its call: the earliest prompt, the least tool, start and result."""
    at = int(r.at)
    place, prompt_at, strict_at, first_at, result_at, _, claimed = calls.get(r.call_id, [None, None, None, at, None, None, False])
    prompt, tool = json.loads(place) if place else ("", r.tool_name)
    if not pd.isna(r.prompt_id) and (prompt_at is None or at < prompt_at):
        prompt, prompt_at = r.prompt_id, at
    if r.kind in ("tool.pre", "tool.decision"):
        strict_at = at if strict_at is None else min(strict_at, at)
    if r.kind == "tool.result":
        result_at = at if result_at is None else min(result_at, at)
    calls[r.call_id] = [json.dumps([prompt, min(tool, r.tool_name)]), prompt_at, strict_at, min(first_at, at), result_at, None, claimed]


def placed(events: DataFrame, window_seconds: int = tool_calls.WINDOW_SECONDS, grace: int = GRACE, keep: int = KEEP, delay: str = "0 seconds") -> DataFrame:
    """Contributions of a stream of events, each with ``call_id`` and ``heuristic``, given out once.

    delay: how far receipts (``ingested_at``) may run apart between tasks.  Needs the RocksDB state store.
    """
    rows = tool_calls.contributions(events.withWatermark("ingested_at", delay), "ingested_at")
    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    asked = rows.select(
        "session_id", "prompt_id", "tool_name", "kind", F.unix_micros("ts").alias("at"), "vendor_seq", "dedup_key", "ingested_at",
        F.when(F.col("tool_use_id").isNotNull(), tool_calls.keyed_id()).alias("call_id"), F.to_json(F.struct(*rows.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("row"),
    )
    out = asked.groupBy("session_id").transformWithStateInPandas(Matcher(window_seconds * 1_000_000, grace, keep), OUTPUT, "append", "eventTime")
    full = out.select("call_id", "heuristic", F.from_json("row", kinds).alias("r"))
    return full.select("r.*", "call_id", "heuristic").drop("ingested_at")


def project_calls(spark: SparkSession, placed_path: str, calls_path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function over :func:`placed`: stores the contributions by day, and folds the days that they touch into the projection of calls."""

    def write(batch: DataFrame, batch_id: int) -> None:
        days.write(batch, placed_path, batch_id)
        touched = days.of(batch)
        if touched:
            # a call belongs to the day of its start and lasts a day at most: a row of a day may belong to a call of
            # the day before, and to tell these from calls that began yet earlier takes one more day
            near = days.read(spark, placed_path, days.with_neighbours(touched, 2, 1))
            calls = tool_calls.fold_placed(near.drop("batch"))
            days.replace(calls, calls_path, days.with_neighbours(touched, 1, 0), "start_month", "started_at")

    return write
