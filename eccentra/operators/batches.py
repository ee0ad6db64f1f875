"""Whole profiles as flat arrays, many of them at a time.

A grouped pandas function pays about a millisecond for every group, however
small; here a task's rows arrive sorted by profile in Arrow batches and the
array work sees a hundred thousand of them at once. A task sorts its rows once,
which spills, and Python holds one lot of rows and the profile it ends in.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ARROW = {"double": pa.float64(), "int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}


def map_profiles(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str],
                 work: Callable, results: Sequence[tuple[str, str]], rows: int = 1 << 17, kept: Sequence[str] | None = None) -> DataFrame:
    """(keys, or those ``kept``, results) of ``work(values, starts) -> (at, found)`` over lots of whole profiles.

    ``values`` has an array for each of ``columns``, sorted by profile and ``order``, nulls
    as NaN; ``starts`` the first row of each profile. ``found`` has an array for each
    result and ``at`` the row that each line takes its keys from. NaN becomes null.
    """
    keys, columns = list(keys), list(columns)
    kept = keys if kept is None else list(kept)
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order)).alias("_at")
    t = df.select(*dict.fromkeys([*keys, *columns]), place)
    schema = T.StructType([t.schema[k] for k in kept] + [T.StructField(n, T._parse_datatype_string(kind)) for n, kind in results])

    def lines(table: pa.Table) -> pa.Table:
        values = {c: table[c].to_numpy() for c in columns}
        at, found = work(values, np.flatnonzero(table["_at"].to_numpy() == 1))
        own = table.select(kept).take(pa.array(at))
        return pa.table([*own.columns, *[pa.array(found[n], from_pandas=True).cast(ARROW[kind]) for n, kind in results]], names=[*kept, *[n for n, _ in results]])

    def stream(batches):
        held, size = [], 0
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                size += batch.num_rows
            if not size or (batch is not None and size < rows):
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            whole = size if batch is None else int(np.flatnonzero(table["_at"].to_numpy() == 1)[-1])
            if whole:
                yield from lines(table.slice(0, whole)).combine_chunks().to_batches()
            held, size = table.slice(whole).to_batches(), size - whole

    return t.mapInArrow(stream, schema)


def owners(starts: np.ndarray, n: int) -> np.ndarray:
    """Number of the profile of each of ``n`` rows."""
    return np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))


def average_ranks(v: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Ranks from 1 inside each profile, ties averaged; NaN is the largest and ties with itself."""
    order = np.lexsort((v, own))
    s, o = v[order], own[order]
    same = (s[1:] == s[:-1]) | (np.isnan(s[1:]) & np.isnan(s[:-1]))
    first = np.flatnonzero(np.r_[True, ~same | (o[1:] != o[:-1])])
    length = np.diff(np.r_[first, len(s)])
    base = np.searchsorted(o, o[first])  # the profile's first place
    out = np.empty(len(v))
    out[order] = np.repeat(first - base + (length + 1) / 2, length)
    return out


def medians(v: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """Median of each of ``n`` profiles, NaN for none."""
    s = v[np.lexsort((v, own))]
    count = np.bincount(own, minlength=n)
    first = np.cumsum(count) - count
    out = np.full(n, np.nan)
    some = count > 0
    lo, hi = (first + (count - 1) // 2)[some], (first + count // 2)[some]
    out[some] = (s[lo] + s[hi]) / 2
    return out
