"""Request budgets as a stateful stream: one small state per session, with a timeout."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from lexweave.operators.guard import OUT, SECOND, GuardConfig, Schedule, narrow, request, shown

STATE = "clock bigint, full_at bigint, rest_until bigint, attempts int, successes int, failed int, too_short int"


def decisions_stream(stream: DataFrame, config: GuardConfig = GuardConfig(), expire_ms: int = 30 * 60 * 1000) -> DataFrame:
    """A decision per request of the stream; a session without requests for ``expire_ms`` starts anew."""
    config.micros()
    rows = narrow(stream).filter("session_key is not null")
    columns = [c.split()[0] for c in OUT.split(", ")]

    def run(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        s = Schedule(*state.get) if state.exists else None
        out = []
        for pdf in frames:
            for r in pdf.sort_values(["us", "request_id"]).itertuples():
                ok = None if pd.isna(r.success) else bool(r.success)
                s, said, wait = request(s, int(r.us), None if pd.isna(r.documents) else int(r.documents), ok, config, int(r.too_short))
                out.append({"request_id": r.request_id, "session_key": key[0], "at": r.us / SECOND, "decision": said, "retry_after": wait, **shown(s, config)})
        if s is not None:
            state.update(tuple(s))
            state.setTimeoutDuration(expire_ms)
        yield pd.DataFrame(out, columns=columns)

    return rows.groupBy("session_key").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
