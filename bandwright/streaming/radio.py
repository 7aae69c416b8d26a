"""Listening sessions as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from bandwright.operators.radio import Session

STATE = "likes array<long>, recents array<long>, excluded array<long>"
OUT = "session long, event_id long, likes array<long>, recents array<long>, n_excluded long"


def advance(session: Session, key: int, events: pd.DataFrame) -> pd.DataFrame:
    """The session after each of its events (ts, event_id, kind, track_id)."""
    rows = []
    for e in events.sort_values(["ts", "event_id"]).itertuples(index=False):
        session.apply(e.kind, int(e.track_id))
        rows.append((key, e.event_id, list(session.likes), list(session.recents), len(session.excluded)))
    return pd.DataFrame(rows, columns=["session", "event_id", "likes", "recents", "n_excluded"])


def sessions(events: DataFrame) -> DataFrame:
    """Batch: the state after every event of each session. Events come sorted; a task holds one session's state and a batch, however long a session is."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = session = None
        for frame in frames:
            for own, part in frame.groupby("session", sort=False):
                if own != key:
                    key, session = own, Session()
                yield advance(session, int(own), part)

    return events.repartition("session").sortWithinPartitions("session", "ts", "event_id").mapInPandas(run, OUT)


def session_stream(events: DataFrame) -> DataFrame:
    """Streaming: the same, with the state kept between batches."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session = Session(*state.get) if state.exists else Session()
        yield advance(session, int(key[0]), pd.concat(list(frames)))
        state.update((list(session.likes), list(session.recents), sorted(session.excluded)))

    return events.groupBy("session").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
