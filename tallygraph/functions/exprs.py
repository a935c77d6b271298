"""Column helpers with explicit rules for nulls and non-finite numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.work import materialize, quantile_row

EPS = 1e-8
#: Formats and currencies of the fixed vocabularies.
FORMATS = ("Cheque", "Credit Card", "ACH", "Cash", "Reinvestment", "Wire", "Bitcoin")
RISK = {"Reinvestment": 0.2, "ACH": 0.4, "Credit Card": 0.5, "Cheque": 0.7, "Wire": 0.8, "Cash": 1.0}
OTHER_RISK = 0.4


def finite(x: Column, fill: float | None = 0.0) -> Column:
    """x, or ``fill`` where it is null, NaN or infinite."""
    return F.coalesce(F.when(F.abs(x) < float("inf"), x), F.lit(fill).cast("double"))


def finite_capped(x: Column, nan: float = 0.0, top: float = 10.0, bottom: float = -10.0) -> Column:
    return F.when(x.isNull() | F.isnan(x), F.lit(nan)).when(x == float("inf"), F.lit(top)).when(x == float("-inf"), F.lit(bottom)).otherwise(x)


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """x within [low, high]; null stays null (greatest and least would skip it)."""
    y = x if low is None else F.greatest(x, F.lit(float(low)))
    y = y if high is None else F.least(y, F.lit(float(high)))
    return F.when(x.isNotNull(), y)


def log1p_safe(x: Column) -> Column:
    """log(1 + x) with negative numbers as 0."""
    return F.log1p(clip(x.cast("double"), low=0.0))


def safe_z(x: Column, mean: Column, std: Column) -> Column:
    """(x - mean) / (std + eps); null where std is null or 0."""
    return (x - mean) / (F.nullif(std, F.lit(0.0)) + EPS)


def flag(c: Column) -> Column:
    return c.cast("int")


def off_hours(ts: Column) -> Column:
    return flag((F.hour(ts) < 8) | (F.hour(ts) > 18))


def weekend(ts: Column) -> Column:
    return flag(F.weekday(ts) >= 5)


def cross(a: Column, b: Column) -> Column:
    """1 where a differs from b or either is null."""
    return flag(F.coalesce(a != b, F.lit(True)))


def same(a: Column, b: Column) -> Column:
    """1 where a equals b, two nulls included."""
    return flag(a.eqNullSafe(b))


def epoch(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp"))


def from_epoch(seconds: Column) -> Column:
    """The timestamp (without zone, in UTC) of epoch seconds."""
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def hours_since(seconds: Column, start: Column) -> Column:
    return (seconds - start) / 3600.0


def entity_type(name: Column) -> Column:
    """Text before '#'; else all words but the last; a single word as it is; Unknown for null or blank."""
    t = F.trim(name)
    words = F.split(t, r"\s+")
    rest = F.when(F.size(words) > 1, F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(1))), " ")).otherwise(t)
    return F.when(name.isNull() | (t == ""), F.lit("Unknown")).when(t.contains("#"), F.trim(F.split_part(t, F.lit("#"), F.lit(1)))).otherwise(rest)


def one_hot(c: Column, values: list[str], prefix: str) -> list[Column]:
    """One 0/1 column a value of the vocabulary; an unknown value or null is 0 in all."""
    return [F.coalesce(flag(c == v), F.lit(0)).alias(f"{prefix}_{v}") for v in values]


def risk(fmt: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in RISK.items() for x in kv])
    return F.coalesce(table[fmt], F.lit(OTHER_RISK))


def sinusoid(position: Column, dim: int, scale: float = 10_000.0) -> Column:
    """sin and cos of position at dim / 2 frequencies, as one array; dim must be even."""
    if dim % 2:
        raise ValueError("dim must be even")
    import math

    freqs = [math.exp(-math.log(scale) * 2 * k / dim) for k in range(dim // 2)]
    return F.array(*[f(position * w) for f in (F.sin, F.cos) for w in freqs])


def cosine_ladder(dt: Column, dim: int) -> Column:
    """cos(dt * 10^-(9 k / (dim - 1))) for k below dim."""
    return F.array(*[F.cos(dt * (10.0 ** (-9.0 * k / (dim - 1)))) for k in range(dim)])


def q_norm(df: DataFrame, columns: list[str], q: float = 0.95) -> DataFrame:
    """df with <c>_n: the column over its q-quantile (its maximum where that isn't positive, 0 where neither is), in [0, 1].

    The quantiles are exact, by rank (see quantile_row), and all come as one row. df is read several times: pass a table.
    """
    ranks = quantile_row(df, {f"_q_{c}": (F.col(c), q) for c in columns})
    most = df.agg(*[F.max(c).cast("double").alias(f"_m_{c}") for c in columns])
    top = lambda c: F.when(F.col(f"_q_{c}") > 0, F.col(f"_q_{c}")).otherwise(F.when(F.col(f"_m_{c}") > 0, F.col(f"_m_{c}")))
    out = df.crossJoin(F.broadcast(ranks.crossJoin(most).select(F.array(*[top(c) for c in columns]).alias("_tops"))))
    scaled = lambda x, i: F.least(F.greatest(F.coalesce(x / F.get("_tops", i), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return each(out, columns, scaled, [f"{c}_n" for c in columns]).drop("_tops")


def each(df: DataFrame, columns: list[str], f: Callable[[Column, Column], Column], names: list[str] | None = None) -> DataFrame:
    """df with f(column as double, its number) for each of columns, under its own name or the one in names.

    The numbers go through one array, as so many expressions side by side make generated code too long to be compiled.
    """
    names = columns if names is None else names
    values = F.transform(F.array(*[F.col(f"`{c}`").cast("double") for c in columns]), f)
    rows = df.withColumn("_each", values)
    new = {n: F.col("_each")[k].alias(n) for k, n in enumerate(names)}
    kept = [new.pop(c) if c in new else F.col(f"`{c}`") for c in df.columns]
    return rows.select(*kept, *new.values())


def standardise(df: DataFrame, columns: list[str], mode: str = "eps", limit: float = 10.0) -> DataFrame:
    """df with each column as (x - mean) / spread, clipped: spread is std_pop + 1e-6 (``eps``), or std_pop with 1 for less than 1e-6 (``floor``).
    df is written once, as its means and its rows are both read."""
    df = materialize(df, "standardise")
    spread = lambda s: s + 1e-6 if mode == "eps" else F.when(s < 1e-6, F.lit(1.0)).otherwise(s)
    one = df.agg(F.array(*[F.avg(c) for c in columns]).alias("_means"), F.array(*[spread(F.stddev_pop(c)) for c in columns]).alias("_spreads"))
    # Null and NaN are 0; infinite ones are at the limit.
    z = lambda x, i: F.least(F.greatest(F.coalesce(F.nanvl((x - F.get("_means", i)) / F.get("_spreads", i), F.lit(0.0)), F.lit(0.0)), F.lit(-limit)), F.lit(limit))
    return each(df.crossJoin(F.broadcast(one)), columns, z).drop("_means", "_spreads")
