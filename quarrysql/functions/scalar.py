"""Built-in scalar functions: a name and what builds its column.

What Spark has is used as it is. Mathematical functions that it lacks run as pandas functions over
Python's own, which define their results.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

Builder = Callable[..., Column]


def _pandas(name: str, kind: str) -> Builder:
    call = _nullable(getattr(math, name), kind)

    def build(*args: Column) -> Column:
        @F.pandas_udf(kind)
        def over(*columns: pd.Series) -> pd.Series:
            rows = zip(*columns)
            return pd.Series([None if any(_missing(x) for x in r) else call(*(_argument(x, kind) for x in r)) for r in rows], dtype=object)

        # Structs come back as frames, so they go through a row-wise function instead.
        if kind.startswith("struct"):
            return F.udf(lambda *r: None if any(_missing(x) for x in r) or (found := call(*r)) is None else tuple(map(float, found)), kind, useArrow=True)(*args)
        return over(*args)

    return build


def _missing(x) -> bool:
    return x is None or isinstance(x, float) and x != x


def _argument(x, kind: str):
    if hasattr(x, "tolist"):
        x = x.tolist()
    return int(x) if kind == "long" and isinstance(x, float) else x


def _nullable(call: Callable, kind: str) -> Callable:
    """``call`` with null for what it isn't defined for, and for integers beyond 64 bits."""

    def result(*args):
        try:
            found = call(*args)
        except (ValueError, OverflowError):
            return None
        return None if kind == "long" and not -(1 << 63) <= found < 1 << 63 else found

    return result


def _expandtabs(s: Column, size: Column | None = None) -> Column:
    @F.pandas_udf("string")
    def over(texts: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or _missing(n) else t.expandtabs(int(n)) for t, n in zip(texts, sizes)], dtype=object)

    return over(s, F.lit(8) if size is None else size)


def _where(test: Column, then, otherwise) -> Column:
    return F.when(test, then).otherwise(otherwise)


def _double(c: Column) -> Column:
    return c.cast("double")


def _capwords(s: Column, sep: Column | None = None) -> Column:
    parts = F.filter(F.split(F.trim(F.regexp_replace(s, r"\s+", " ")), " "), lambda x: x != "") if sep is None else F.call_function("split", s, F.concat(F.lit("\\Q"), sep, F.lit("\\E")), F.lit(-1))
    cap = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))
    return F.array_join(F.transform(parts, cap), " ") if sep is None else F.call_function("array_join", F.transform(parts, cap), sep)


def _isclose(a: Column, b: Column, rel: Column | None = None, abs_: Column | None = None) -> Column:
    rel, abs_ = F.lit(1e-9) if rel is None else rel, F.lit(0.0) if abs_ is None else abs_
    near = F.abs(a - b) <= F.greatest(rel * F.greatest(F.abs(a), F.abs(b)), _double(abs_))
    return (a == b) | near


def _whole(build: Builder) -> Builder:
    return lambda x: build(_double(x)).cast("long")


_INF = float("inf")

#: Strings.
STRINGS: dict[str, Builder] = {
    "length": F.length,
    "capwords": _capwords,
    "upper": F.upper, "lower": F.lower, "strip": F.trim, "lstrip": F.ltrim, "rstrip": F.rtrim, "trim": F.trim, "ltrim": F.ltrim, "rtrim": F.rtrim,
    "split": lambda s, sep=None: F.filter(F.split(s, r"\s+"), lambda x: x != "") if sep is None else F.call_function("split", s, F.concat(F.lit("\\Q"), sep, F.lit("\\E")), F.lit(-1)),
    "join": lambda parts, sep=None: F.call_function("array_join", parts, F.lit(" ") if sep is None else sep),
    "replace": lambda s, a, b: F.call_function("replace", s, a, b),
    "find": lambda s, x: (F.call_function("instr", s, x) - 1).cast("long"),
    "index": lambda s, x: (F.call_function("instr", s, x) - 1).cast("long"),
    "rfind": lambda s, x: _where(F.call_function("instr", s, x) == 0, F.lit(-1), F.length(s) - F.length(x) - F.call_function("instr", F.reverse(s), F.reverse(x)) + 1).cast("long"),
    "capitalize": lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 30))),
    "swapcase": lambda s: F.array_join(F.transform(F.split(s, ""), lambda c: _where(c == F.upper(c), F.lower(c), F.upper(c))), ""),
    "ljust": lambda s, w: _where(F.length(s) >= w, s, F.call_function("rpad", s, w, F.lit(" "))),
    "rjust": lambda s, w: _where(F.length(s) >= w, s, F.call_function("lpad", s, w, F.lit(" "))),
    "center": lambda s, w: _where(F.length(s) >= w, s, F.call_function("rpad", F.call_function("lpad", s, F.length(s) + ((w - F.length(s)) / 2 + _where(((w - F.length(s)) % 2 == 1) & (w % 2 == 1), F.lit(0.5), F.lit(0.0))).cast("int"), F.lit(" ")), w, F.lit(" "))),
    "zfill": lambda s, w: _where(F.length(s) >= w, s, _where(s.rlike("^[+-]"), F.concat(F.substring(s, 1, 1), F.call_function("lpad", F.substring(s, 2, 1 << 30), (w - 1).cast("int"), F.lit("0"))), F.call_function("lpad", s, w, F.lit("0")))),
    "translate": lambda s, a, b: F.call_function("translate", s, a, b),
    "atoi": lambda s: F.trim(s).cast("long"), "atol": lambda s: F.trim(s).cast("long"), "atof": lambda s: F.trim(s).cast("double"),
    "expandtabs": _expandtabs,
    "concat": F.concat, "md5": F.md5, "coalesce": F.coalesce, "reflect": lambda *a: F.call_function("reflect", *a),
}

#: Mathematics that Spark has under the same name.
_SAME = "acos acosh asin asinh atan atan2 atanh cbrt cos cosh degrees exp expm1 hypot isnan log10 log1p log2 radians sin sinh sqrt tan tanh pow factorial".split()

MATHEMATICS: dict[str, Builder] = {name: getattr(F, name) for name in _SAME} | {
    "ceil": _whole(F.ceil), "floor": _whole(F.floor), "fabs": lambda x: F.abs(_double(x)), "fmod": lambda x, y: _double(x) % _double(y), "trunc": lambda x: x.cast("long"),
    "log": lambda x, base=None: F.ln(x) if base is None else F.ln(x) / F.ln(base),
    "isqrt": lambda x: F.floor(F.sqrt(x)).cast("long"), "exp2": lambda x: F.pow(F.lit(2.0), x),
    "copysign": lambda x, y: F.abs(_double(x)) * _where((y < 0) | (_double(y).cast("string") == "-0.0"), F.lit(-1.0), F.lit(1.0)),
    "isinf": lambda x: F.abs(_double(x)) == F.lit(_INF), "isfinite": lambda x: (F.abs(_double(x)) < F.lit(_INF)) & ~F.isnan(_double(x)),
    "ldexp": lambda x, i: _double(x) * F.pow(F.lit(2.0), i), "isclose": _isclose,
    "prod": lambda xs: F.aggregate(xs, F.lit(1.0), lambda a, x: a * x.cast("double")),
    "sumprod": lambda xs, ys: F.aggregate(F.zip_with(xs, ys, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x.cast("double")),
    "dist": lambda p, q: F.sqrt(F.aggregate(F.zip_with(p, q, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x.cast("double"))),
    "modf": _pandas("modf", "struct<fraction:double,whole:double>"), "frexp": _pandas("frexp", "struct<mantissa:double,exponent:double>"),
} | {name: _pandas(name, "long") for name in ("gcd", "lcm", "comb", "perm")} | {name: _pandas(name, "double") for name in ("erf", "erfc", "gamma", "lgamma", "remainder", "nextafter", "ulp", "fma", "fsum")}

BUILTIN: dict[str, Builder] = MATHEMATICS | STRINGS


def json_get(value: Column, key) -> Column:
    """``->``: the JSON text at a key or an index."""
    path = f"$[{key}]" if isinstance(key, int) else f"$['{key}']"
    return F.to_json(F.try_variant_get(F.try_parse_json(value), path, "variant"))


def json_get_text(value: Column, key) -> Column:
    """``->>``: the same as plain text."""
    return F.get_json_object(value, f"$[{key}]" if isinstance(key, int) else f"$['{key}']")


def floor_divide(a: Column, b: Column) -> Column:
    """Division of integers that rounds down."""
    whole = F.call_function("div", a, b)
    return whole - F.when((a % b != 0) & ((a < 0) != (b < 0)), F.lit(1)).otherwise(F.lit(0))


def is_integral(kind: T.DataType) -> bool:
    return isinstance(kind, T.IntegralType)
