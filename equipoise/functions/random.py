"""Seeded, partition-independent random numbers as native column expressions.

Every random choice in the library (splits, shuffles, draws, bootstrap weights)
is a function of ``(row key, seed, stream)`` only, so results do not depend on
partitioning, task retries or executor loss, and DuckDB can recompute them:

    Spark : conv(substr(md5(concat_ws(':', key, seed, stream)), 1, 8), 16, 10) / 2^32
    DuckDB: ('0x' || substr(md5(key || ':' || seed || ':' || stream), 1, 8))::BIGINT / 4294967296.0
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _key_string(key: Column | str, seed: int, stream: str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.concat_ws(":", key.cast("string"), F.lit(str(int(seed))), F.lit(str(stream)))


def hash_u(key: Column | str, seed: int, stream: str = "u", part: int = 0) -> Column:
    """Uniform in [0, 1) with 2^-32 granularity; ``part`` 0..3 picks a 32-bit slice."""
    digest = F.md5(_key_string(key, seed, stream))
    return F.conv(F.substring(digest, 1 + 8 * part, 8), 16, 10).cast("double") / F.lit(TWO_32)


def hash_u_sql(key_sql: str, seed: int, stream: str = "u", part: int = 0) -> str:
    """The same number as :func:`hash_u`, written as DuckDB SQL."""
    s = f"md5(CAST({key_sql} AS VARCHAR) || ':{int(seed)}:{stream}')"
    return f"(CAST(('0x' || substr({s}, {1 + 8 * part}, 8)) AS BIGINT) / 4294967296.0)"


def hash_normal(key: Column | str, seed: int, stream: str = "z") -> Column:
    """Standard normal by Box-Muller from two slices of one digest."""
    u1 = F.lit(1.0) - hash_u(key, seed, stream, 0)  # (0, 1]: log is finite
    u2 = hash_u(key, seed, stream, 1)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def hash_normal_sql(key_sql: str, seed: int, stream: str = "z") -> str:
    u1 = f"(1.0 - {hash_u_sql(key_sql, seed, stream, 0)})"
    u2 = hash_u_sql(key_sql, seed, stream, 1)
    return f"(sqrt(-2.0 * ln({u1})) * cos({float(2.0 * math.pi)!r} * {u2}))"


# A prime, 2^31 - 1: products of two numbers below it fit a 64-bit integer.
FIELD = 2147483647


def poly_seeds(key: Column | str, seed: int, stream: str) -> list[Column]:
    """Four integers below FIELD from one digest, the coefficients of a cubic
    whose values at 0, 1, 2, ... modulo FIELD are many uniform numbers per row."""
    digest = F.md5(_key_string(key, seed, stream))
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") % FIELD for i in range(4)]


def poly_u_sql(key_sql: str, seed: int, stream: str, at_sql: str) -> str:
    """DuckDB SQL of the uniform number at ``at_sql`` of :func:`poly_seeds`."""
    s = f"md5(CAST({key_sql} AS VARCHAR) || ':{int(seed)}:{stream}')"
    c = [f"(CAST(('0x' || substr({s}, {1 + 8 * i}, 8)) AS BIGINT) % {FIELD})" for i in range(4)]
    v = c[3]
    for i in (2, 1, 0):
        v = f"(({v} * CAST({at_sql} AS BIGINT) + {c[i]}) % {FIELD})"
    return f"(CAST({v} AS DOUBLE) / CAST('{FIELD}' AS DOUBLE))"


def poisson1_thresholds(max_k: int = 12) -> list[float]:
    """CDF of Poisson(1) at 0..max_k-1; weight = number of thresholds <= u. What
    lies beyond 12 (2e-10 of the draws) is below the grain of the uniforms."""
    out, acc, term = [], 0.0, math.exp(-1.0)
    for k in range(max_k):
        if k > 0:
            term /= k
        acc += term
        out.append(acc)
    return out


def poisson1_weight(u: Column) -> Column:
    """Poisson(1) draw by inverse CDF on a uniform column (bootstrap weight)."""
    w = F.lit(0)
    for t in poisson1_thresholds():
        w = w + F.when(u >= F.lit(t), 1).otherwise(0)
    return w


def poisson1_weight_sql(u_sql: str) -> str:
    parts = [f"(CASE WHEN {u_sql} >= CAST('{t!r}' AS DOUBLE) THEN 1 ELSE 0 END)"
             for t in poisson1_thresholds()]
    return "(" + " + ".join(parts) + ")"
