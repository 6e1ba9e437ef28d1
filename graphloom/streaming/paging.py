"""Evaluation in bounded pages.

Every row of a query has a key: the keys of the rows it was made of, in order of
the scans. A page holds the rows after the last key seen, in key order; the
token that resumes is that key with a fingerprint of the query and of the data.
So a call's state is a few values, whatever the plan, and the pages together are
exactly the whole result.

The first key column is the first scan's. Where it is a number, a page asks for
a range of it that should hold enough rows by what earlier pages found, so that
this scan reads only its part, and goes on with a wider one if it doesn't. Rows
are read ahead in growing steps and held for the next call. Where the steps
come to more than STREAMED rows, the executors sort all the rest, and what is
held is a stream of it, of which the driver has a small part at a time.

Rows come to the driver as Arrow batches that executors have packed. A top-k is
merged by an executor too, so that its parts never come here, and a row becomes
a Python object only when its page is given out.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import math
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.conversion import ArrowTableToRowsConversion
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from graphloom.functions.terms import node_id
from graphloom.operators.lineage import cut
from graphloom.plans.algebra import Op, Query, Slice
from graphloom.plans.compiler import compile_select, sort_columns
from graphloom.plans.parser import parse
from graphloom.sources.dataset import Dataset, Key, Rel

#: Rows that are fetched before the first look at the clock (twice as many before each further one), and of a call without limit or time.
CHUNK, UNTIMED_CHUNK = 10_000, 1_000_000
#: Rows that a call reads ahead for each that were given out before it.
AHEAD = 4
#: Rows that all queries together hold ready for later calls, at most.
READ_AHEAD = 1_000_000
#: Rows that a call without a clock fetches at once, at most; where it would be more, they come out of a stream.
STREAMED = 100_000
#: Rows in a part of a stream, about; streams that are held for later calls.
STREAM_PART, STREAMS = 50_000, 4
#: Rows, and bytes of them, that joined() keeps before it writes them.
JOINED, JOINED_BYTES = 1_000_000, 32_000_000


class TokenError(ValueError):
    """A token that isn't for this query over this dataset."""


@dataclass(frozen=True)
class Budget:
    """Rows and milliseconds of a call; None is no limit."""

    limit: int | None = None
    timeout_ms: int | None = None

    def within(self, other: Budget) -> Budget:
        """The lesser of two budgets, as between server and request."""
        least = lambda a, b: b if a is None else a if b is None else min(a, b)
        return Budget(least(self.limit, other.limit), least(self.timeout_ms, other.timeout_ms))


@dataclass
class Page:
    """Rows of one call, and the token for the next; None when all is done."""

    columns: list[str]
    rows: list[Row]
    token: str | None
    emitted: int


def fingerprint(q: Query, data: Dataset) -> str:
    return hashlib.sha256(f"{q.op!r}|{q.default_graphs}|{q.named_graphs}|{data.fingerprint()}".encode()).hexdigest()[:24]


def _pack(v: object) -> object:
    if isinstance(v, (dt.datetime, dt.date)):
        return {"time": v.isoformat()}
    if isinstance(v, float):
        return {"float": repr(v)}
    return v if v is None or isinstance(v, (bool, int, str)) else {"text": str(v)}


def _unpack(v: object) -> object:
    if isinstance(v, dict):
        if set(v) == {"time"}:
            return dt.datetime.fromisoformat(v["time"])
        if set(v) == {"float"}:
            return float(v["float"])
        if set(v) == {"text"}:
            return v["text"]
        raise TokenError("malformed key")
    if v is None or isinstance(v, (bool, int, str)):
        return v
    raise TokenError("malformed key")


def after(keys: tuple[Key, ...], last: list[object], types: list[str]) -> Column:
    """Rows whose key comes after the last one, spelled out column by column so that the first can reach the files' statistics."""
    out: Column | None = None
    for (c, up), value, kind in reversed(list(zip(keys, last, types))):
        col = F.col(c)
        if value is None:  # nulls come first when rising, last when falling
            further, same = (col.isNotNull() if up else F.lit(False)), col.isNull()
        else:
            v = F.lit(value).cast(kind)
            further = col > v if up else (col < v) | col.isNull()
            same = col == v
        out = further if out is None else further | (same & out)
    first, value, kind = keys[0], last[0], types[0]
    if value is not None and first[1]:
        out = (F.col(first[0]) >= F.lit(value).cast(kind)) & out
    return out


def _read_token(token: str | None, mark: str, n_keys: int) -> tuple[int, list[object] | None, float | None]:
    """Rows given out so far, the last key, and rows for each unit of the first key column where that is known."""
    if token is None:
        return 0, None, None
    try:
        got = json.loads(token)
        if got["query"] != mark:
            raise TokenError("the token belongs to another query or dataset")
        emitted, last, rate = got["emitted"], [_unpack(v) for v in got["last"]], got["rate"]
    except (KeyError, TypeError, json.JSONDecodeError) as e:
        raise TokenError("malformed token") from e
    if not isinstance(emitted, int) or emitted < 0 or len(last) != n_keys or not (rate is None or isinstance(rate, float) and rate > 0):
        raise TokenError("malformed token")
    return emitted, last, rate


def _pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches as bytes, one to a row."""
    for b in batches:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
            out.write_batch(b)
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["rows"])


def _unpack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The other way round."""
    for b in batches:
        for x in b.column(0):
            yield from pa.ipc.open_stream(x.as_buffer())


def packed(df: DataFrame) -> DataFrame:
    """df with its rows packed, in their order. An operator above a top-k also has it merged by an executor."""
    return df.mapInArrow(_pack_rows, "rows binary")


def _unpacked(rows: Iterator[Row], kind: StructType) -> pa.Table:
    parts = [pa.ipc.open_stream(r[0]).read_all() for r in rows]
    # Of every column nulls are let be, as a filter may rule them out in one fetch and not in another.
    return pa.concat_tables(pa.Table.from_arrays(t.columns, t.column_names) for t in parts) if parts else to_arrow_schema(kind).empty_table()


def _values(t: pa.Table) -> list[tuple]:
    """Rows with the values that collect() gives them."""
    return ArrowTableToRowsConversion.convert(t, from_arrow_schema(t.schema), return_as_tuples=True)


def _key_of_last(rows: pa.Table, n: int) -> list[object]:
    """The key of the last row, which follows n other columns."""
    return list(_values(rows.slice(len(rows) - 1).select(range(n, rows.num_columns)))[0])


class _Stream:
    """Rows that are left of a sorted result, of which a part is here."""

    def __init__(self, rows: Iterator[Row], kind: StructType) -> None:
        self.rows, self.kind, self.here = rows, kind, None

    def take(self, want: int) -> tuple[pa.Table, bool]:
        """So many rows, and whether these are the last."""
        parts, n = ([], 0) if self.here is None else ([self.here], len(self.here))
        while n <= want and (r := next(self.rows, None)) is not None:
            parts.append(_unpacked(iter([r]), self.kind))
            n += len(parts[-1])
        every = pa.concat_tables(parts) if parts else _unpacked(iter(()), self.kind)
        self.here = every.slice(want) if n > want else None
        return every.slice(0, want), n <= want


class _Ahead:
    """Rows that were fetched beyond a page, by the token that asks for them. A token that isn't here is answered by the data."""

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._held: dict[str, tuple[pa.Table | None, bool, _Stream | None]] = {}

    def put(self, token: str, rows: pa.Table, last: bool, stream: _Stream | None = None) -> None:
        with self._lock:
            self._held.pop(token, None)
            self._held[token] = (rows, last, stream)
            while sum(len(r) for r, _, _ in self._held.values()) > READ_AHEAD:
                del self._held[next(iter(self._held))]
            streams = [t for t, (_, _, s) in self._held.items() if s is not None]
            for t in streams[: max(0, len(streams) - STREAMS)]:
                del self._held[t]

    def take(self, token: str) -> tuple[pa.Table | None, bool, _Stream | None]:
        with self._lock:
            return self._held.pop(token, (None, False, None))


_AHEAD = _Ahead()


class _Fetch:
    """Rows of a keyed result in key order, from a key on."""

    def __init__(self, data: Dataset, rel: Rel, names: list[str], last: list[object] | None, rate: float | None) -> None:
        self.data, self.rel, self.names, self.rate, self.last = data, rel, names, rate, last
        self.types = [rel.df.schema[c].dataType.simpleString() for c, _ in rel.keys]
        self.low = None if last is None else last[0]
        self.reach, self.done = 2.0, False
        self.stream: _Stream | None = None
        self.ranged = self.types[0] in ("int", "bigint", "smallint", "double") and rel.keys[0][1]

    @cached_property
    def from_(self) -> Column | None:
        """What rows have to meet; made when they are asked of the data."""
        return None if self.last is None else after(self.rel.keys, self.last, self.types)

    def _high(self, want: int) -> object:
        """Where a range of the first key column that should hold so many rows ends; None if there is no telling."""
        if not self.ranged or self.rate is None or not isinstance(self.low, (int, float)) or self.reach > 100:
            return None
        high = self.low + max(1, self.reach * want / self.rate)
        return high if self.types[0] == "double" else int(high) if high < 2**31 or self.types[0] == "bigint" and high < 2**62 else None

    def open(self, offset: int = 0) -> None:
        """From now on rows come out of a stream of all that is left, in parts that executors sort."""
        df = self.rel.df if self.from_ is None else self.rel.df.where(self.from_)
        if offset:
            df = df.orderBy(*sort_columns(self.rel.keys)).offset(offset)
        rows = df.count()
        rel = replace(self.rel, df=df)
        shown = self.data.decode(rel, self.names)
        order = sort_columns(tuple((f"k{n}", up) for n, (_, up) in enumerate(self.rel.keys)))
        df = self._columns(rel, shown)
        # Parts by range of the whole key, which no two rows share, so that their sizes are about equal.
        parts = df.repartitionByRange(1 + rows // STREAM_PART, *order).sortWithinPartitions(*order)
        self.stream = _Stream(packed(parts).toLocalIterator(prefetchPartitions=True), df.schema)

    def _columns(self, rel: Rel, shown: Rel) -> DataFrame:
        """Values of names, then the keys."""
        return shown.df.select(*[F.col(v).alias(f"v{n}") for n, v in enumerate(self.names)], *_keys_of(rel, shown, self.names))

    def take(self, want: int, offset: int = 0) -> pa.Table:
        """Up to so many rows; fewer than that don't mean the end, ``done`` does. Values of names, then the keys."""
        if self.stream is not None:
            got, self.done = self.stream.take(want)
            return got
        df, high = self.rel.df, None if offset else self._high(want)
        if self.from_ is not None:
            df = df.where(self.from_)
        first = self.rel.keys[0][0]
        if high is not None:  # so that the first scan reads no more than the page needs
            df = df.where(F.col(first) <= F.lit(high).cast(self.types[0]))
        df = df.orderBy(*sort_columns(self.rel.keys))
        part = replace(self.rel, df=(df.offset(offset) if offset else df).limit(want + 1))
        shown = self.data.decode(part, self.names)
        df = self._columns(part, shown)
        got = _unpacked(packed(df).collect(), df.schema)
        n = len(self.names)
        if any(shown.kinds[v] != part.kinds[v] for v in self.names):
            keys = [_sort_key(r, n, self.rel.keys) for r in _values(got)]
            got = got.take(pa.array(sorted(range(len(keys)), key=keys.__getitem__), pa.int64()))
        if len(got) > want:
            got = got.slice(0, want)
            last = _key_of_last(got, n)
            self.from_ = after(self.rel.keys, last, self.types)
            new_low = last[0]
            self.reach = 2.0
        else:
            self.done = high is None
            new_low = high
            if high is not None:
                self.from_ = F.col(first) > F.lit(high).cast(self.types[0])
                self.reach *= 8
        if self.ranged and len(got) and isinstance(new_low, (int, float)):
            base = self.low if isinstance(self.low, (int, float)) else got.column(n)[0].as_py()
            if isinstance(base, (int, float)) and 0 < new_low - base < math.inf:
                self.rate = len(got) / float(new_low - base)
        self.low = new_low
        return got


_COMPILED: dict[tuple[int, str], Rel] = {}


def _compiled(mark: str, op: Op, data: Dataset) -> Rel:
    """The keyed result, whose plan is made once for all pages of a session."""
    key = (id(data.spark.sparkContext), mark)  # which an entry keeps alive
    if key not in _COMPILED:
        while len(_COMPILED) >= 100:
            _COMPILED.pop(next(iter(_COMPILED)), None)
        _COMPILED[key] = compile_select(op, data, keys=True, decode=False)
    return _COMPILED[key]


def run_page(data: Dataset, query: str | Query, budget: Budget = Budget(), token: str | None = None, server: Budget = Budget(), prefixes: dict[str, str] | None = None, chunk: int | None = None) -> Page:
    """Rows of a SELECT query from a token on, until the budget is used or all is done.

    At least one chunk is done in each call, so every call gets further; a later
    one that is still running at the deadline is cancelled. A query's own LIMIT and
    OFFSET count over all pages. At most ``limit`` rows are returned; without a
    clock AHEAD times the rows given out before are read ahead, or all as a stream
    where that is more than STREAMED. Without a limit or time the budget is UNTIMED_CHUNK rows.
    """
    q = parse(query, prefixes) if isinstance(query, str) else query
    data = data.with_graphs(q.default_graphs, q.named_graphs)
    most = server.within(budget)
    if most.timeout_ms is None:
        most = most.within(Budget(UNTIMED_CHUNK))
    deadline = None if most.timeout_ms is None else time.monotonic() + most.timeout_ms / 1000
    op, offset, cap = q.op, 0, None
    if isinstance(op, Slice):
        op, offset, cap = op.child, op.offset, op.limit
    # Keys first: terms are looked up for a page's rows only.
    mark = fingerprint(q, data)
    rel = _compiled(mark, op, data)
    emitted, last, rate = _read_token(token, mark, len(rel.keys))
    names = [v for v in rel.vars if not v.startswith("?")]
    n = len(names)
    held, ended, stream = _AHEAD.take(token) if token is not None else (None, False, None)
    given, ready = emitted, 0 if held is None else len(held)
    fetch = _Fetch(data, rel, names, _key_of_last(held, n) if ready and stream is None else last, rate)
    fetch.stream = stream
    fetch.done = ended or cap is not None and emitted >= cap
    size = chunk or CHUNK
    room = min((x for x in (None if most.limit is None else max(1, most.limit), None if cap is None else cap - emitted) if x is not None), default=None)
    while not fetch.done and (room is None or ready < room):
        left = None if room is None else room - ready
        skip = offset if last is None and not ready else 0
        if deadline is not None:
            want = size if left is None else min(size, left)
        elif chunk is not None:
            want = min(chunk, left)
        else:
            want = left + (AHEAD * given if cap is None else min(AHEAD * given, cap - emitted - left))
            if want > STREAMED and fetch.stream is None:
                fetch.open(skip)
            if fetch.stream is not None:
                want = left
        if want <= 0:
            break
        got = _within(data, lambda want=want, skip=skip: fetch.take(want, skip), deadline if ready else None)
        if got is None:
            break
        held, size = got if not ready else pa.concat_tables([held, got]) if len(got) else held, size * 2
        ready = len(held)
        if ready and deadline is not None and time.monotonic() >= deadline:
            break
    given_out = ready if room is None else min(ready, room)
    emitted += given_out
    over = fetch.done and ready == given_out or cap is not None and emitted >= cap
    row = Row(*names)
    rows = [row(*r) for r in _values(held.slice(0, given_out).select(range(n)))] if given_out else []
    if over:
        return Page(names, rows, None, emitted)
    if given_out:
        last = _key_of_last(held.slice(0, given_out), n)
    following = json.dumps({"query": mark, "emitted": emitted, "last": [_pack(v) for v in last], "rate": fetch.rate})
    if ready > given_out or fetch.stream is not None:
        _AHEAD.put(following, held.slice(given_out), fetch.done, fetch.stream)
    return Page(names, rows, following, emitted)


def _within(data: Dataset, job: Callable[[], pa.Table], deadline: float | None) -> pa.Table | None:
    """What a job returns, or None if it was still running at the deadline and is cancelled."""
    if deadline is None:
        return job()
    context, group = data.spark.sparkContext, f"page-{uuid.uuid4().hex}"
    timer = threading.Timer(max(0.0, deadline - time.monotonic()), lambda: context.cancelJobGroup(group))
    context.setJobGroup(group, "a page's chunk", interruptOnCancel=True)
    timer.start()
    try:
        return job()
    except Exception:
        if time.monotonic() >= deadline:
            return None
        raise
    finally:
        timer.cancel()
        for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            context.setLocalProperty(name, None)


def _keys_of(part: Rel, shown: Rel, names: list[str]) -> list[Column]:
    """Key columns. Where a key is a variable that was looked up, its id is made again."""
    changed = {v for v in names if shown.kinds[v] != part.kinds[v]}
    return [(node_id(F.col(c)) if c in changed else F.col(c)).alias(f"k{n}") for n, (c, _) in enumerate(part.keys)]


class _Desc:
    def __init__(self, v: object) -> None:
        self.v = v

    def __lt__(self, other: _Desc) -> bool:
        return other.v < self.v

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Desc) and other.v == self.v


def _sort_key(row: tuple, n: int, keys: tuple[Key, ...]) -> list:
    """A page's rows in key order again, after the joins that looked up terms."""
    out = []
    for v, (_, up) in zip(row[n:], keys):
        v = v.encode() if isinstance(v, str) else v
        out.append((0 if v is None else 1, v if v is not None else 0) if up else (1 if v is None else 0, _Desc(v if v is not None else 0)))
    return out


def each_page(data: Dataset, query: str, limit: int, prefixes: dict[str, str] | None = None) -> Iterator[Page]:
    """All pages of a query, one after the other."""
    q, token = parse(query, prefixes), None
    while True:
        page = run_page(data, q, Budget(limit=limit), token)
        yield page
        token = page.token
        if token is None:
            return


def pages(data: Dataset, query: str, limit: int, prefixes: dict[str, str] | None = None) -> list[Page]:
    """All pages of a query."""
    return list(each_page(data, query, limit, prefixes))


def joined(data: Dataset, query: str, limit: int, schema: str, prefixes: dict[str, str] | None = None) -> DataFrame:
    """All pages of a query, put together. Of the rows that were given out the driver keeps JOINED at most, and JOINED_BYTES but for one page; earlier ones are on disk."""
    spark, kind = data.spark, StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)
    done: list[DataFrame] = []
    held: list[pa.Table] = []
    rows = size = 0

    def part() -> DataFrame:
        # As bytes, that the JVM doesn't hold a row object for each.
        batches = pa.concat_tables([arrow.empty_table(), *held]).combine_chunks().to_batches(CHUNK)
        table = pa.Table.from_batches(_pack_rows(iter(batches)), pa.schema({"rows": pa.binary()}))
        return spark.createDataFrame(table).mapInArrow(_unpack_rows, kind)

    for p in each_page(data, query, limit, prefixes):
        columns = list(zip(*p.rows)) or [()] * len(arrow)
        held.append(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow))
        rows, size = rows + len(p.rows), size + held[-1].nbytes
        if rows >= JOINED or size >= JOINED_BYTES:
            done.append(cut(part()))
            held.clear()
            rows = size = 0
    return reduce(DataFrame.unionAll, [*done, part()] if held or not done else done)


def progress(page: Page, total: int) -> float:
    """Share of the result that is out; 1 for an empty one."""
    return page.emitted / total if total else 1.0
