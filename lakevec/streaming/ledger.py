"""A ledger kept on a stream: a document is sealed when its puts reach the number of its chunks, or given up as partial."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RECORDS = "source string, content_hash string, chunks int, puts int, status string, at timestamp"
_STATE = "chunks int, seen array<int>, last long, sealed boolean"


def ledger_stream(events: DataFrame, late: str = "10 minutes", patience_ms: int = 600_000) -> DataFrame:
    """RECORDS of a stream of events (source, content_hash, chunks int, chunk_idx int, at timestamp), one record a document and content.

    An event tells how many chunks a document has (``chunks``), that one of them was put (``chunk_idx``), or both, in any order. The record is
    ``done`` as soon as as many different chunks were put; a document without chunks is done at once. It is ``partial`` when the watermark
    (``late`` behind the latest event) has gone ``patience_ms`` beyond the document's last event. A put that comes again counts once, and
    a sealed document is remembered as long, so that it is not recorded twice. State is in the checkpoint: a run that ends in mid-document goes on
    in the next.
    """

    def seal(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chunks, seen, last, sealed = state.get if state.exists else (None, [], 0, False)
        if state.hasTimedOut:
            state.remove()
            if not sealed:
                yield _record(key, chunks, len(seen), "partial", last)
            return
        found = set(seen or ())
        for batch in batches:
            known = batch["chunks"].dropna()
            if len(known):
                chunks = int(known.max()) if chunks is None else max(chunks, int(known.max()))
            found |= set(batch["chunk_idx"].dropna().astype(int))
            last = max(last, int(batch["at"].max().timestamp() * 1000))
        if not sealed and chunks is not None and len(found) >= chunks:
            sealed = True
            yield _record(key, chunks, len(found), "done", last)
        state.update((chunks, sorted(found), last, sealed))
        state.setTimeoutTimestamp(max(last + patience_ms, state.getCurrentWatermarkMs() + 1))

    timed = events.select("source", "content_hash", "chunks", "chunk_idx", "at").withWatermark("at", late)
    return timed.groupBy("source", "content_hash").applyInPandasWithState(seal, RECORDS, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _record(key: tuple, chunks: int | None, puts: int, status: str, at_ms: int) -> pd.DataFrame:
    return pd.DataFrame({"source": [key[0]], "content_hash": [key[1]], "chunks": pd.array([chunks], "Int32"), "puts": [puts], "status": [status], "at": [pd.Timestamp(at_ms, unit="ms")]})


def marked(events: DataFrame, at: str, late: str) -> DataFrame:
    """``events`` with a watermark on ``at``, unless they have one."""
    return events if "spark.watermarkDelayMs" in events.schema[at].metadata else events.withWatermark(at, late)


def interval_join(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, within: str, late: str = "1 hour") -> DataFrame:
    """Rows of two streams (or tables) with equal ``by`` where ``right_at`` is from ``left_at`` up to ``within`` later; the names of their other
    columns differ. Both sides have a watermark of ``late``, and state goes as it passes the interval."""
    from pyspark.sql import functions as F

    other = marked(right.select(*(F.col(c).alias(f"_{c}") if c in by else F.col(c) for c in right.columns)), right_at, late)
    same = [F.col(c) == F.col(f"_{c}") for c in by]
    timed = [F.col(right_at) >= F.col(left_at), F.col(right_at) <= F.col(left_at) + F.expr(f"INTERVAL {within}")]
    return marked(left, left_at, late).join(other, [*same, *timed]).drop(*(f"_{c}" for c in by))


def once(events: DataFrame, by: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """The first row of each ``by``, as long as its repeats come within ``late``."""
    timed = marked(events, at, late)
    return timed.dropDuplicatesWithinWatermark(by) if events.isStreaming else timed.dropDuplicates(by)


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query left out because they came after its watermark, by its progress so far."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
