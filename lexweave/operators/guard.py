"""Request budgets per session, kept as a virtual schedule in whole microseconds.

A budget of ``capacity`` credits that regains one credit every ``seconds_per_credit`` seconds is
one number: the time at which it will be full again. A request of ``c`` credits moves that time
``c`` credit periods ahead and fits as long as it stays within ``capacity`` periods of the
session's clock. All times are integers, so there is no rounding and no tolerance.

Defined results: a null session has decision ``no_session`` and no budget; a document count
under one is ``invalid``, one over the capacity ``over_capacity``, both without effect; a null
outcome leaves the failure count as it is. The clock of a session never runs backwards, so an
earlier time regains nothing. ``too_short`` counts the documents a request reports as too short.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.operators.ordered import fold

SECOND = 1_000_000


class GuardConfig(NamedTuple):
    """Fixed values of the default budget: 200 credits, 20 at least a request, one regained in 30 s; 3 failures, 120 s."""

    capacity: int = 200
    least_cost: int = 20
    seconds_per_credit: float = 30.0
    failures: int = 3
    cooldown: float = 120.0

    def micros(self) -> tuple[int, int]:
        """Period of a credit and length of a cooldown in microseconds; an unusable budget is an error."""
        period, rest = (round(x * SECOND) if 0 < x < 1e9 else 0 for x in (self.seconds_per_credit, self.cooldown))
        if period < 1 or rest < 1 or self.failures < 1 or not 1 <= self.least_cost <= self.capacity:
            raise ValueError(f"not a usable budget: {self}")
        return period, rest


class Schedule(NamedTuple):
    """State of a session: its clock, when its budget is full again, when a cooldown ends, and its counts."""

    clock: int
    full_at: int
    rest_until: int = 0
    attempts: int = 0
    successes: int = 0
    failed: int = 0
    too_short: int = 0

    def owed(self) -> int:
        return max(0, self.full_at - self.clock)


def _seconds(micros: int) -> int:
    return max(1, -(-micros // SECOND))


def request(s: Schedule | None, at: int, documents: int | None, success: bool | None, config: GuardConfig, too_short: int = 0) -> tuple[Schedule | None, str, int]:
    """State after a request at ``at`` microseconds, its decision, and the whole seconds to wait where it is refused."""
    period, rest = config.micros()
    size = documents or 0
    if not 1 <= size <= config.capacity:
        return s, "invalid" if size < 1 else "over_capacity", 0
    s = Schedule(at, at) if s is None else s._replace(clock=max(s.clock, at))
    if at < s.rest_until:
        return s, "cooldown", _seconds(s.rest_until - at)
    owed = s.owed() + period * max(size, config.least_cost)
    beyond = owed - period * config.capacity
    if beyond > 0:
        return s, "budget", _seconds(beyond)
    run = {True: 0, False: s.failed + 1, None: s.failed}[success]
    ends = at + rest if success is False and run >= config.failures else 0
    after = Schedule(s.clock, s.clock + owed, max(s.rest_until, ends), s.attempts + 1, s.successes + (success is True), run, s.too_short + max(0, too_short))
    return after, "allowed", 0


OUT = "request_id bigint, session_key string, at double, decision string, retry_after int, credits double, attempts int, successes int, failed int, too_short int"


def shown(s: Schedule | None, config: GuardConfig) -> dict[str, object]:
    """The columns of a state."""
    if s is None:
        return {"credits": float(config.capacity), "attempts": 0, "successes": 0, "failed": 0, "too_short": 0}
    return {"credits": config.capacity - s.owed() / config.micros()[0], "attempts": s.attempts, "successes": s.successes, "failed": s.failed, "too_short": s.too_short}


def once(requests: DataFrame) -> DataFrame:
    """Requests without second deliveries: the same session, time, size and outcome count once (smallest id)."""
    return requests.groupBy("session_key", "ts", "documents", "success").agg(F.min("request_id").alias("request_id"))


def narrow(requests: DataFrame) -> DataFrame:
    """The columns the rules read; ``too_short`` is optional."""
    short = F.col("too_short") if "too_short" in requests.columns else F.lit(0)
    return requests.select(
        F.col("request_id").cast("bigint"), F.col("session_key").cast("string"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.col("documents").cast("int"), F.col("success").cast("boolean"), F.coalesce(short.cast("int"), F.lit(0)).alias("too_short"),
    )


def decisions(requests: DataFrame, config: GuardConfig = GuardConfig()) -> DataFrame:
    """A decision per request; those of a session in order of time and id. Null sessions need no state and no shuffle;
    a null time counts as time zero."""
    config.micros()
    rows = narrow(requests).withColumn("us", F.coalesce("us", F.lit(0)))

    def step(state, r):
        state, said, wait = request(state, r["us"], r["documents"], r["success"], config, r["too_short"])
        return state, {"request_id": r["request_id"], "session_key": r["session_key"], "at": r["us"] / SECOND, "decision": said, "retry_after": wait, **shown(state, config)}

    kept = fold(rows.filter("session_key is not null"), "session_key", ["us", "request_id"], lambda: None, step, OUT)
    none = shown(None, config)
    nobody = rows.filter("session_key is null").select(
        "request_id", "session_key", (F.col("us") / SECOND).alias("at"), F.lit("no_session").alias("decision"), F.lit(0).alias("retry_after"), *(F.lit(v).alias(k) for k, v in none.items())
    )
    return kept.union(nobody)
