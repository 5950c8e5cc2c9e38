"""Row-keyed pseudo-random values: the same for a row under any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_M31 = 2147483648  # 2**31

# Cumulative probabilities of the Poisson(1) distribution from 0 on.
POISSON1_CDF = [0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317, 0.99940581518, 0.99991675885, 0.99998975080, 0.99999887480]


def keyed_uniform(key: Column, salt: str) -> Column:
    """A uniform value in [0,1) from the md5 of salt and key."""
    digest = F.md5(F.concat(F.lit(salt + ":"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def keyed_uniform_sql(key: str, salt: str) -> str:
    return f"(CAST('0x' || substr(md5('{salt}:' || CAST({key} AS VARCHAR)),1,8) AS BIGINT) / 4294967296.0::DOUBLE)"


def seed31(key: Column, salt: str) -> Column:
    """A 31-bit integer per row, to be mixed with a resample number."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt + ":"), key.cast("string"))), 1, 8), 16, 10).cast("long") % _M31


def _mix(x: Column) -> Column:
    x = (x * 1103515245 + 12345) % _M31
    x = x.bitwiseXOR(F.shiftright(x, 16))
    x = (x * 1540483477) % _M31
    return x.bitwiseXOR(F.shiftright(x, 13))


def poisson_weight(seed: Column, b: Column) -> Column:
    """Poisson(1) weight of a row in resample ``b``."""
    u = _mix(_mix((seed + b * 40503) % _M31)) / F.lit(float(_M31))
    w = F.lit(0)
    for c in POISSON1_CDF:
        w = w + (u >= F.lit(c)).cast("int")
    return w


def poisson_weight_sql(key: str, salt: str, b: str) -> str:
    def mix(x: str, level: int) -> str:
        a = f"(({x} * 1103515245 + 12345) % {_M31})"
        a = f"xor({a}, {a} >> 16)"
        c = f"(({a} * 1540483477) % {_M31})"
        return f"xor({c}, {c} >> 13)"

    seed = f"(CAST('0x' || substr(md5('{salt}:' || CAST({key} AS VARCHAR)),1,8) AS BIGINT) % {_M31})"
    u = f"({mix(mix(f'(({seed} + {b} * 40503) % {_M31})', 0), 1)} / {float(_M31)}::DOUBLE)"
    return "(SELECT " + " + ".join(f"CAST(uu >= {c}::DOUBLE AS INT)" for c in POISSON1_CDF) + f" FROM (SELECT {u} AS uu))"
