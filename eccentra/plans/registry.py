"""The table of named queries and of their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from eccentra.plans.bindings import Bindings, sql_prelude

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _scale(digits: int) -> int:
    """A power of two near 10**digits: scaling is exact and decimal ties, which
    means of whole numbers hit often, are not rounding ties."""
    return 2 ** (digits * 10 // 3)


def _round_col(name: str, digits: int):
    scale = float(_scale(digits))
    return (F.floor(F.col(name) * scale + 0.5) / scale).alias(name)


def _merge_with(prelude: str, body: str) -> str:
    body = body.strip()
    low = body.lower()
    for head in ("with recursive", "with"):
        if low.startswith(head + " ") or low.startswith(head + "\n"):
            rest = body[len(head):].lstrip()
            word = "WITH RECURSIVE" if head == "with recursive" else "WITH"
            return f"{word} {prelude + ', ' if prelude else ''}{rest}"
    return f"WITH {prelude} {body}" if prelude else body


def query(name: str, oracle: str | None = None, rounded: str = "", digits: int = 6):
    """Register ``fn(bindings) -> DataFrame`` under ``name``.

    ``rounded`` names the float columns whose last bits depend on summation
    order; they are rounded alike on both sides.
    """
    cols = rounded.split()

    def wrap(fn: Callable[[Bindings], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(Bindings(spark, sf_dir))
            if cols:
                out = out.select(*[_round_col(c, digits) if c in cols else F.col(f"`{c}`")
                                   for c in out.columns])
            return out

        run.__name__ = name
        run.__doc__ = fn.__doc__
        assert name not in QUERIES, name
        QUERIES[name] = run
        if oracle is not None:
            text = _merge_with(sql_prelude(oracle), oracle)
            if cols:
                scale = f"{_scale(digits)}e0"
                rep = ", ".join(f"floor({c} * {scale} + 0.5) / {scale} AS {c}" for c in cols)
                text = f"SELECT * REPLACE ({rep}) FROM ({text})"
            ORACLES[name] = text
        return fn

    return wrap
