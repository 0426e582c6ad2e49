"""Cohort retention: users by cohort and period, from a scan of clicks that are sorted by client and time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlint.llm.common import materialise, table

CLICK_COLUMNS = ("click_id", "ts", "arrived_at", "client_id", "kind", "value", "props")
#: What state 0 knows: clicks that arrive before this time.
FIRST_STATE_UNTIL = "2024-03-01 00:00:00"
#: Days that a cohort and a period last.
DAYS = 3
#: A client with more clicks than this is hot; at most one in so many of all clicks, so hot clients are fewer than HOT_SHARE.
SHARD_CLICKS = 4096
HOT_SHARE = 20_000

_DAY = 86_400_000_000
_NEVER = np.iinfo(np.int64).max
_EMITTED = "state int, client_id long, cohort long, period long, moved long, cents long, hot boolean"


def arrival(click_id: Column, arrived_at: Column) -> Column:
    """When a click counts as arrived: a third of them, told by a checksum of the id, up to 99 days late."""
    h = F.crc32(click_id.cast("string"))
    return F.when(h % 3 == 0, arrived_at + F.make_dt_interval((h % 100).cast("int"))).otherwise(arrived_at)


def known_clicks(clicks: DataFrame, until: str = FIRST_STATE_UNTIL) -> DataFrame:
    """Distinct clicks with a time and a client as (client_id, ts, turn, cents, click_id).

    ``turn`` orders clicks of one time, so that whatever can start a client comes first: 0 a purchase that state 0 knows,
    1 a later known one, 2 another click that state 0 knows, 3 the rest. Without an arrival, state 1 alone knows a click.
    Equal rows are merged before and after the shuffle, so that many copies of one row don't meet in one task; props
    stand in by their digest. Values that aren't finite numbers count nothing, like null.
    """
    rows = clicks.select(*CLICK_COLUMNS).where("ts is not null and client_id is not null")
    rows = rows.withColumn("props", F.unhex(F.sha2("props", 256))).distinct()
    early = F.coalesce(arrival(F.col("click_id"), F.col("arrived_at")) < F.lit(until).cast(clicks.schema["arrived_at"].dataType), F.lit(False))
    bought = F.coalesce(F.col("kind") == "purchase", F.lit(False))
    turn = F.when(bought & early, 0).when(bought, 1).when(early, 2).otherwise(3)
    cents = F.floor(100 * F.col("value") + 0.5).cast("long")
    finite = F.abs("value") < 9e16  # false for NaN, which is ordered last
    return rows.select(
        F.col("client_id").cast("long").alias("client_id"), "ts", turn.cast("byte").alias("turn"), F.when(finite, cents).otherwise(F.lit(0).cast("long")).alias("cents"), "click_id"
    )


def hot_clients(known: DataFrame, shard_clicks: int = SHARD_CLICKS, share: int = HOT_SHARE) -> DataFrame:
    """(hot_id, shards, first_0, first_1): clients with more than ``shard_clicks`` clicks and more than one in ``share`` of all.

    There are fewer than ``share`` of these, whatever the input. Their starts come from an aggregate, so that their
    clicks may be dealt over any number of tasks.
    """
    least = max(shard_clicks, known.count() // share)
    early = F.when(F.col("turn") == 0, F.col("ts"))
    bought = F.when(F.col("turn") < 2, F.col("ts"))
    per_client = known.groupBy(F.col("client_id").alias("hot_id")).agg(F.count("*").alias("n"), F.min(early).alias("first_0"), F.min(bought).alias("first_1"))
    return per_client.where(F.col("n") > least).select("hot_id", F.ceil(F.col("n") / least).cast("int").alias("shards"), "first_0", "first_1")


def _micros(column: pa.Array) -> np.ndarray:
    return column.cast(pa.timestamp("us", tz=column.type.tz)).cast(pa.int64()).fill_null(_NEVER).to_numpy(zero_copy_only=False)


class _State:
    """What one state knows of the client at hand while its clicks pass in order of time."""

    def __init__(self, last_turns: tuple[int, int]):
        #: Largest turn of a purchase that it knows; turns that it knows.
        self.buys, self.knows = last_turns
        self.start = _NEVER
        self.done: list[tuple[np.ndarray, np.ndarray]] = []

    def runs(self, first: np.ndarray, run: np.ndarray, ts: np.ndarray, turn: np.ndarray, cents: np.ndarray, given: np.ndarray, goes_on: bool):
        """Start of each run of one client, then (run, period, cents) for each of its periods, in order."""
        buys = np.where(turn <= self.buys, ts, _NEVER)
        start = np.minimum(np.minimum.reduceat(buys, first), given[first])
        if goes_on:
            start[0] = min(start[0], self.start)
        own = start[run]
        known = np.isin(turn, self.knows) & (ts >= own) & (own != _NEVER)
        run, period, cents = run[known], (ts[known] - own[known]) // (DAYS * _DAY), cents[known]
        if len(run) == 0:
            return start, run, period, cents
        # A change of period, or of client, ends one user of a cell.
        new = np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | (period[1:] != period[:-1])])
        return start, run[new], period[new], np.add.reduceat(cents, new)


def scan_sorted(batches):
    """Users by state, cohort and period from batches of clicks sorted by (client_id, shard, ts, turn).

    What is held beyond a batch is the client at hand: its starts, and one number a period, of which a client has at most as
    many as the range of its times has (a period is added to the last one while it lasts). No set of users is kept.
    """
    states = (_State((0, (0, 2))), _State((1, (0, 1, 2, 3))))
    held = None  # (client, shard, hot) whose clicks may go on in the next batch

    def flush(key) -> list[tuple]:
        out = []
        moved = int(states[0].start != _NEVER and _cohort(states[0].start) != _cohort(states[1].start))
        for k, s in enumerate(states):
            for period, cents in s.done:
                out.append((k, key[0], _cohort(s.start), int(period), moved, int(cents), key[2]))
            s.start, s.done = _NEVER, []
        return out

    for b in batches:
        if b.num_rows == 0:
            continue
        client, shard = (b.column(n).to_numpy(zero_copy_only=False) for n in ("client_id", "shard"))
        ts, turn, cents = _micros(b.column("ts")), b.column("turn").to_numpy(), b.column("cents").to_numpy()
        hot = b.column("hot").to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.r_[True, (client[1:] != client[:-1]) | (shard[1:] != shard[:-1])])
        run = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(client)]))
        goes_on = held is not None and held[:2] == (client[0], shard[0])
        rows: list[tuple] = [] if goes_on or held is None else flush(held)
        last = len(first) - 1
        columns = [[] for _ in range(7)]
        found = [s.runs(first, run, ts, turn, cents, _micros(b.column(f"first_{k}")), goes_on) for k, s in enumerate(states)]
        if goes_on:
            for s, (start, at, period, sums) in zip(states, found, strict=True):
                s.start = start[0]
                _append(s.done, period[at == 0], sums[at == 0])
            if last > 0:
                rows += flush(held)
        # Clients that begin and end within the batch go out as columns, the last one is held.
        starts = np.array([f[0] for f in found])
        moved = (starts[0] != _NEVER) & (starts[0] // _DAY // DAYS != starts[1] // _DAY // DAYS)
        for k, (start, at, period, sums) in enumerate(found):
            inner = (at < last) & ~((at == 0) & goes_on)
            at, period, sums = at[inner], period[inner], sums[inner]
            whole = (np.full(len(at), k), client[first][at], start[at] // _DAY // DAYS, period, moved[at].astype(np.int64), sums, hot[first][at])
            for c, values in zip(columns, whole, strict=True):
                c.append(values)
        held = (client[-1], shard[-1], bool(hot[-1]))
        if last > 0 or not goes_on:
            for s, (start, at, period, sums) in zip(states, found, strict=True):
                s.start = start[last]
                _append(s.done, period[at == last], sums[at == last])
        yield _emitted(columns, rows)
    if held is not None:
        yield _emitted([[] for _ in range(7)], flush(held))


def _cohort(start: int) -> int:
    return int(start // _DAY // DAYS)


def _append(done: list, period: np.ndarray, sums: np.ndarray) -> None:
    for p, c in zip(period.tolist(), sums.tolist(), strict=True):
        if done and done[-1][0] == p:
            done[-1] = (p, done[-1][1] + c)
        else:
            done.append((p, c))


def _emitted(columns: list[list[np.ndarray]], rows: list[tuple]) -> pa.RecordBatch:
    names = ("state", "client_id", "cohort", "period", "moved", "cents", "hot")
    kinds = (pa.int32(), *[pa.int64()] * 5, pa.bool_())
    tails = list(zip(*rows, strict=True)) if rows else [()] * 7
    arrays = []
    for kind, parts, tail in zip(kinds, columns, tails, strict=True):
        whole = np.concatenate([*parts, np.array(tail, dtype=kind.to_pandas_dtype())]) if parts else np.array(tail, dtype=kind.to_pandas_dtype())
        arrays.append(pa.array(whole.astype(kind.to_pandas_dtype()), kind))
    return pa.RecordBatch.from_arrays(arrays, names=list(names))


def users_by_period(known: DataFrame, hot: DataFrame) -> DataFrame:
    """(state, client_id, cohort, period, moved, cents, hot): a row for each user of a cell, but some for each shard of a hot client."""
    dealt = known.join(F.broadcast(hot), F.col("client_id") == F.col("hot_id"), "left")
    shard = F.coalesce(F.pmod(F.xxhash64("click_id", "ts"), "shards").cast("int"), F.lit(0))
    rows = dealt.select("client_id", shard.alias("shard"), "ts", "turn", "cents", "first_0", "first_1", F.col("hot_id").isNotNull().alias("hot"))
    return rows.repartition("client_id", "shard").sortWithinPartitions("client_id", "shard", "ts", "turn").mapInArrow(scan_sorted, _EMITTED)


def retention(clicks: DataFrame, clients: DataFrame, until: str = FIRST_STATE_UNTIL, shard_clicks: int = SHARD_CLICKS) -> DataFrame:
    """(state, segment, cohort, period, users, users_crc32, moved, cents) for each cell with users.

    ``clicks`` and ``clients`` may have other columns; they aren't looked at, nor do they make rows differ. Clicks without a time or a client
    are left out, equal ones count once. A client without a known purchase starts nowhere and is in no cell; clicks at the very
    time of the start count. Of repeated rows of a client the least city counts; null cities, clients that aren't listed, and
    those with a null id have the segment ''. Times are read as they stand, those with a zone in UTC. Without clicks there are no rows.
    """
    known = materialise(known_clicks(clicks, until), "retention-clicks")
    hot = hot_clients(known, shard_clicks)
    users = materialise(users_by_period(known, hot), "retention-users")
    merged = users.where("hot").groupBy("state", "client_id", "cohort", "period", "moved").agg(F.sum("cents").alias("cents"))
    whole = users.where("not hot").drop("hot").unionByName(merged)
    cities = clients.where("client_id is not null").groupBy(F.col("client_id").cast("long").alias("client_id")).agg(F.min("city").alias("segment"))
    cells = whole.join(cities, "client_id", "left").groupBy("state", F.coalesce("segment", F.lit("")).alias("segment"), "cohort", "period")
    return cells.agg(
        F.count("*").alias("users"), F.sum(F.crc32(F.col("client_id").cast("string"))).alias("users_crc32"), F.sum("moved").alias("moved"), F.sum("cents").alias("cents")
    )


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The retention matrix of all ``clicks`` before and after March 2024; see ``retention`` for nulls, repeated rows, ties and empty tables."""
    return retention(table(spark, sf_dir, "clicks", *CLICK_COLUMNS), table(spark, sf_dir, "clients", "client_id", "city"))


def crc32_sql(x: str) -> str:
    """CRC-32 of a text as SQL: an exclusive or for each byte, then eight steps of the polynomial 0xEDB88320."""
    data = f"list_transform(range(0, strlen({x})), lambda i: CAST('0x' || substr(hex({x}), 2 * i + 1, 2) AS BIGINT))"
    step = "list_reduce(list_prepend(xor(c, d), range(8)), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {data}), lambda c, d: {step}), 4294967295)"


OP11_SQL = f"""
WITH c AS (SELECT DISTINCT click_id, ts, arrived_at, client_id, kind, value, props FROM clicks WHERE ts IS NOT NULL AND client_id IS NOT NULL),
h AS (SELECT click_id, {crc32_sql("CAST(click_id AS VARCHAR)")} AS h FROM (SELECT DISTINCT click_id FROM c)),
k AS (SELECT c.client_id, c.ts, c.kind, CASE WHEN abs(value) < 9e16 THEN CAST(floor(100 * value + 0.5) AS BIGINT) ELSE 0 END AS cents,
  CASE WHEN h % 3 = 0 THEN arrived_at + to_days(CAST(h % 100 AS INTEGER)) ELSE arrived_at END < TIMESTAMP '{FIRST_STATE_UNTIL}' AS early
  FROM c LEFT JOIN h ON c.click_id = h.click_id),
s AS (SELECT 0 AS state, client_id, ts, kind, cents FROM k WHERE early UNION ALL SELECT 1, client_id, ts, kind, cents FROM k),
b AS (SELECT state, client_id, epoch_us(min(ts)) AS start FROM s WHERE kind = 'purchase' GROUP BY state, client_id),
f AS (SELECT b.*, CAST(floor(floor(start / 86400000000) / {DAYS}) AS BIGINT) AS cohort FROM b),
m AS (SELECT x.client_id, CAST(x.cohort <> y.cohort AS BIGINT) AS moved FROM f x JOIN f y ON x.client_id = y.client_id AND x.state = 0 AND y.state = 1),
u AS (SELECT s.state, s.client_id, f.cohort, CAST((epoch_us(s.ts) - f.start) // ({DAYS} * 86400000000) AS BIGINT) AS period, sum(cents) AS cents
  FROM s JOIN f ON s.state = f.state AND s.client_id = f.client_id AND epoch_us(s.ts) >= f.start GROUP BY ALL),
g AS (SELECT client_id, min(city) AS city FROM clients GROUP BY client_id),
i AS (SELECT client_id, {crc32_sql("CAST(client_id AS VARCHAR)")} AS crc FROM (SELECT DISTINCT client_id FROM u))
SELECT u.state, coalesce(g.city, '') AS segment, u.cohort, u.period, count(*) AS users, CAST(sum(i.crc) AS BIGINT) AS users_crc32,
  CAST(sum(coalesce(m.moved, 0)) AS BIGINT) AS moved, CAST(sum(u.cents) AS BIGINT) AS cents
FROM u JOIN i ON u.client_id = i.client_id LEFT JOIN m ON u.client_id = m.client_id LEFT JOIN g ON u.client_id = g.client_id
GROUP BY u.state, coalesce(g.city, ''), u.cohort, u.period
"""
