"""Differences between two copies of a table.

Method: rows that are the same on both sides cancel out by multiplicity. What is
left over of each key is paired so that the pairs differ in as few fields as
possible (minimum-cost assignment on the counts of differing fields); pairs give
field differences, rows without a partner are missing on the other side.

Where: cancelling is one aggregation on (key, hash of the row), with partial
sums before the shuffle. All that is left over goes through the assignment:
partitions sorted by key, read as a stream, in which keys of one row a side pair
at once, a batch of them together, and others by the Hungarian method. Up to
``exact_rows`` rows a side it works on the table of all costs; beyond that
costs are computed a row at a time, from the fields as numbers, so memory grows
with the rows left of a key and not with their pairs. The total is the least for
every key, whatever its size; what is left of one key has to fit into a task,
and the time grows faster than the rows.

Defined results: a field that is null (or absent) equals one that is absent;
fields with a tolerance differ from it on where both are numbers, and as texts
where one is not. Rows without a key have the key ``''``. With ``once`` repeated
rows of a side are deliveries of one row and count once, before anything cancels.
"""

from __future__ import annotations

import decimal
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import partitions_for, stage

EXACT_ROWS = 256


# --- leaves of JSON texts -------------------------------------------------


def _number(token: str) -> str:
    value = decimal.Decimal(token).normalize()
    return "n:" + ("0" if value == 0 else str(value))


def _canonical(value) -> object:
    """Nested values with numbers tagged, keys sorted and null members left out."""
    if isinstance(value, dict):
        return {k: _canonical(v) for k, v in sorted(value.items()) if v is not None}
    if isinstance(value, list):
        return [_canonical(v) for v in value]
    if isinstance(value, str) and value[:2] == "n:" and not isinstance(value, _Num):
        return "s:" + value
    return value


class _Num(str):
    """A number's canonical text."""


def _parse(text: str):
    return json.loads(text, parse_float=lambda t: _Num(_number(t)), parse_int=lambda t: _Num(_number(t)), parse_constant=lambda t: _Num("n:" + t))


def leaves(text: str | None, root: str) -> dict[str, str]:
    """Path -> tagged value of each leaf. Text that is not JSON is one leaf, as it stands; blank text has none."""
    if text is None or not text.strip():
        return {}
    try:
        value = _parse(text)
    except (ValueError, RecursionError, decimal.InvalidOperation):
        return {root: "t:" + text.strip()}
    found: dict[str, str] = {}
    held = [(root, value)]
    while held:
        path, v = held.pop()
        if v is None:
            continue
        if isinstance(v, dict):
            held += [(f"{path}.{k}", x) for k, x in v.items()]
        elif isinstance(v, list):
            found[path] = "a:" + json.dumps(_canonical(v))
        elif isinstance(v, bool):
            found[path] = "b:true" if v else "b:false"
        else:
            found[path] = str(v) if isinstance(v, _Num) else "s:" + v
    return found


def json_leaves(column: str, root: str) -> Column:
    """Map of the leaves of a JSON text."""

    @F.arrow_udf("map<string,string>")
    def flat(texts: pa.Array) -> pa.Array:
        found = [leaves(t, root) for t in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, found)])
        return pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array([k for f in found for k in f], pa.string()), pa.array([v for f in found for v in f.values()], pa.string()))

    return flat(F.col(column))


# --- pairing ----------------------------------------------------------------


def _augment(i: int, row, u: np.ndarray, v: np.ndarray, match: np.ndarray) -> None:
    """Give row i (from 1) a column by the shortest augmenting path; ``row`` gives the costs of a row (from 0)."""
    m = len(v) - 1
    match[0], j = i, 0
    least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=np.int64), np.zeros(m + 1, dtype=bool)
    while True:
        used[j] = True
        at = match[j]
        now = row(at - 1) - u[at] - v[1:]
        better = ~used[1:] & (now < least[1:])
        least[1:][better], way[1:][better] = now[better], j
        free = np.where(used, np.inf, least)
        k = int(np.argmin(free[1:])) + 1
        delta = free[k]
        u[match[used]] += delta
        v[used] -= delta
        least[~used] -= delta
        j = k
        if match[j] == 0:
            break
    while j:
        match[j], j = match[way[j]], way[j]


def _columns(n: int, match: np.ndarray) -> np.ndarray:
    out = np.full(n, -1)
    taken = np.flatnonzero(match[1:])
    out[match[1:][taken] - 1] = taken
    return out


def assign(cost: np.ndarray) -> np.ndarray:
    """For each row its column, -1 for none, at the least total cost (Hungarian method); any shape."""
    if cost.shape[0] > cost.shape[1]:
        back, out = assign(cost.T), np.full(cost.shape[0], -1)
        out[back] = np.arange(len(back))
        return out
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=np.int64)
    for i in range(1, n + 1):
        _augment(i, cost.__getitem__, u, v, match)
    return _columns(n, match)


def assign_by_rows(n: int, m: int, row) -> np.ndarray:
    """``assign`` for n <= m without the table of costs: ``row`` gives those of a row. Rows that find a free column at their least cost take it, the others are given one by augmenting paths."""
    u, v, match, waiting = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=np.int64), []
    for i in range(1, n + 1):
        cost = row(i - 1)
        u[i] = cost.min()
        free = (cost == u[i]) & (match[1:] == 0)
        j = int(np.argmax(free))
        if free[j]:
            match[j + 1] = i
        else:
            waiting.append(i)
    for i in waiting:
        _augment(i, row, u, v, match)
    return _columns(n, match)


def _number_or_nan(text: str | None) -> float:
    try:
        return float(text) if text is not None else np.nan
    except ValueError:
        return np.nan


def pair_rows(left: list[dict], right: list[dict], tolerances: dict[str, float], table_rows: int = EXACT_ROWS) -> list[tuple[int, int]]:
    """Pairs of positions (-1: no partner) that differ in the fewest fields."""
    order = lambda rows: sorted(range(len(rows)), key=lambda i: sorted(rows[i].items()))
    a, b = order(left), order(right)
    fields = sorted({k for r in (*left, *right) for k in r})
    column = lambda f: np.array([rows[i].get(f) for rows, at in ((left, a), (right, b)) for i in at], dtype=object)
    codes = [(f, pd.factorize(column(f))[0].astype(np.int32)) for f in fields]
    numbers = {f: np.array([_number_or_nan(v) for v in column(f)]) for f in fields if f in tolerances}

    def costs(mine: slice, turned: bool) -> np.ndarray:
        """Differing fields of some rows (columns, if turned) with all on the other side."""
        cost, cut = 0.0, len(a)
        halves = lambda c: (c[cut:][mine][:, None], c[:cut][None, :]) if turned else (c[:cut][mine][:, None], c[cut:][None, :])
        for f, c in codes:
            x, y = halves(c)
            differ = x != y
            if f in numbers:
                x, y = halves(numbers[f])
                differ = np.where(np.isfinite(x) & np.isfinite(y), np.abs(x - y) >= tolerances[f] * (1 - 1e-6), differ)
            cost = cost + differ
        return cost

    if not (len(a) and len(b) and fields):
        to = np.full(len(a), -1)
        to[: min(len(a), len(b))] = np.arange(min(len(a), len(b)))
    elif max(len(a), len(b)) <= table_rows:
        to = assign(costs(slice(None), False))
    elif len(a) <= len(b):
        to = assign_by_rows(len(a), len(b), lambda i: costs(slice(i, i + 1), False)[0])
    else:
        back, to = assign_by_rows(len(b), len(a), lambda i: costs(slice(i, i + 1), True)[0]), np.full(len(a), -1)
        to[back] = np.arange(len(back))
    taken = set(to.tolist())
    return [(a[i], b[j] if j >= 0 else -1) for i, j in enumerate(to)] + [(-1, b[j]) for j in range(len(b)) if j not in taken]


def _paired(tolerances: dict[str, float], table_rows: int):
    """Task over rows (table_name, record_id, side, vals) sorted by key: (table_name, record_id, x, y), the pairs at the least cost."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        """All rows of some keys."""
        table = table.combine_chunks()
        columns = {c: table.column(c).chunk(0) for c in table.column_names}
        side, n = columns["side"].to_numpy(), table.num_rows
        change = np.zeros(n, dtype=bool)
        change[0] = True
        for c in ("table_name", "record_id"):
            change[1:] |= pc.not_equal(columns[c].slice(1), columns[c].slice(0, n - 1)).to_numpy(zero_copy_only=False)
        start = np.flatnonzero(change)
        stop = np.append(start[1:], n)
        lefts = np.add.reduceat(side == 1, start)
        rights = stop - start - lefts
        plain = (lefts <= 1) & (rights <= 1)
        x, y = [np.where(lefts > 0, start, -1)[plain]], [np.where(rights > 0, stop - 1, -1)[plain]]
        for a, middle, b in zip(start[~plain], (start + lefts)[~plain], stop[~plain]):
            rows = [dict(v) for v in columns["vals"].slice(a, b - a).to_pylist()]
            pairs = np.array(pair_rows(rows[: middle - a], rows[middle - a :], tolerances, table_rows))
            x.append(np.where(pairs[:, 0] >= 0, a + pairs[:, 0], -1))
            y.append(np.where(pairs[:, 1] >= 0, middle + pairs[:, 1], -1))
        x, y = np.concatenate(x), np.concatenate(y)
        at = lambda k: pa.array(k, pa.int64(), mask=k < 0)
        own = pa.array(np.maximum(x, y))
        return pa.RecordBatch.from_arrays([columns["table_name"].take(own), columns["record_id"].take(own), columns["vals"].take(at(x)), columns["vals"].take(at(y))], ["table_name", "record_id", "x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = lambda b, i: (b.column("table_name")[i].as_py(), b.column("record_id")[i].as_py())
        for batch in batches:
            if not batch.num_rows:
                continue
            key = last(batch, batch.num_rows - 1)
            if held and last(held[-1], held[-1].num_rows - 1) == key:  # one key only, and more of it may come
                held.append(batch)
                continue
            k = batch.num_rows - 1
            while k and last(batch, k - 1) == key:
                k -= 1
            if held or k:
                yield from pa.Table.from_batches([solve(pa.Table.from_batches([*held, batch.slice(0, k)]))]).to_batches(max_chunksize=10_000)
            held = [batch.slice(k)]
        if held:
            yield from pa.Table.from_batches([solve(pa.Table.from_batches(held))]).to_batches(max_chunksize=10_000)

    return run


def compare_copies(rows: DataFrame, sides: tuple[str, str], tolerances: dict[str, float] | None = None, once: bool = True, exact_rows: int = EXACT_ROWS) -> DataFrame:
    """(table_name, record_id, difference, field_name) of rows (table_name, record_id, side, vals map<string,string>)."""
    tolerances = tolerances or {}
    key, (one, two) = ["table_name", "record_id"], sides

    def rounded(e: Column) -> Column:
        value = e["value"]
        for f, t in tolerances.items():
            value = F.when(e["key"] == f, F.coalesce(F.round(e["value"].try_cast("double") / t).cast("decimal(38,0)").cast("string"), e["value"])).otherwise(value)
        return F.struct(e["key"].alias("k"), value.alias("v"))

    canonical = F.array_sort(F.transform(F.map_entries(F.map_filter("vals", lambda k, v: v.isNotNull())), rounded))
    present = rows.filter(F.col("side").isin(one, two)).select(F.coalesce("table_name", F.lit("")).alias("table_name"), F.coalesce("record_id", F.lit("")).alias("record_id"), "side", "vals", F.xxhash64(canonical).alias("h"))
    # Multiplicities of each different row; of deliveries of one row, one counts.
    count = lambda s: (F.max if once else F.sum)((F.col("side") == s).cast("long"))
    held = present.groupBy(*key, "h").agg(count(one).alias("l"), count(two).alias("r"), F.first("vals").alias("vals"))
    cancelled = F.least("l", "r")
    left = stage(held.select(*key, "h", (F.col("l") - cancelled).alias("l"), (F.col("r") - cancelled).alias("r"), "vals").filter("l + r > 0"))
    several = F.expr("explode(sequence(1L, l + r))")
    each = left.select(*key, "h", F.when(F.col("l") > 0, 1).otherwise(2).alias("side"), F.map_filter("vals", lambda k, v: v.isNotNull()).alias("vals"), several.alias("_n"))
    parts = partitions_for(left.sparkSession, left.count(), 50_000)
    in_order = each.repartition(parts, *key).sortWithinPartitions(*key, "side", "h").select(*key, "side", "vals")
    pairs = in_order.mapInArrow(_paired(tolerances, exact_rows), "table_name string, record_id string, x map<string,string>, y map<string,string>")

    def differs(k: Column, p: Column) -> Column:
        x, y = p["x"], p["y"]
        out = ~x.eqNullSafe(y)
        for f, t in tolerances.items():
            a, b = x.try_cast("double"), y.try_cast("double")
            out = F.when((k == f) & a.isNotNull() & b.isNotNull(), F.abs(a - b) >= t * (1 - 1e-6)).otherwise(out)
        return out

    zipped = F.map_zip_with("x", "y", lambda k, x, y: F.struct(x.alias("x"), y.alias("y")))
    fields = F.map_keys(F.map_filter(zipped, differs))
    missing = lambda s: F.array(F.struct(F.lit(f"missing_in_{s}").alias("difference"), F.lit("").alias("field_name")))
    found = F.when(F.col("x").isNull(), missing(one)).when(F.col("y").isNull(), missing(two)).otherwise(F.transform(fields, lambda f: F.struct(F.lit("differs").alias("difference"), f.alias("field_name"))))
    return pairs.select(*key, F.inline(found))
