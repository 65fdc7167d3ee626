"""Places in a total order without one task holding all rows.

A window without a partition sorts everything in one task. Here approximate quantiles, which are few numbers, cut the
values into stretches; each stretch is numbered by itself, and the stretches before it are added. Equal values share a
stretch. The cuts decide only how the work is dealt, never the places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a stretch should hold, and the most stretches.
ROWS, STRETCHES = 200_000, 1000


def _cuts(df: DataFrame, columns: list[str], n: int) -> list[list[float]]:
    parts = min(STRETCHES, n // ROWS + 1)
    if parts == 1:
        return [[] for _ in columns]
    return [sorted(set(c)) for c in df.approxQuantile(columns, [i / parts for i in range(1, parts)], 0.2 / parts)]


def _stretch(column: str, cuts: list[float]) -> Column:
    """How many cuts lie below a value."""
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col(column)))


def _before(df: DataFrame, stretches: dict[str, Column], parts: int) -> dict[str, list[int]]:
    """For each name the rows in earlier stretches, by stretch: one aggregate for all names, at most STRETCHES numbers a name."""
    if parts == 1:
        return {name: [0] for name in stretches}
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), s.alias("s")) for name, s in stretches.items()]))
    counts = {(r["name"], r["s"]): r["count"] for r in df.select(pairs.alias("p")).groupBy("p.name", "p.s").count().collect()}
    out = {}
    for name in stretches:
        out[name] = [0]
        for s in range(parts):
            out[name].append(out[name][-1] + counts.get((name, s), 0))
    return out


def _at(numbers: list[int], place: Column) -> Column:
    return F.lit(0) if len(numbers) == 1 else F.element_at(F.array(*[F.lit(x) for x in numbers]), place + 1)


def with_places(df: DataFrame, columns: dict[str, str], tie: str, n: int) -> DataFrame:
    """df with, for each column (a number) -> name, its place from 1 in order of (column, tie).

    n: the number of rows; it only decides the number of stretches.
    """
    cuts = dict(zip(columns, _cuts(df, list(columns), n)))
    stretches = {c: _stretch(c, cuts[c]) for c in columns}
    before = _before(df, stretches, max(len(c) for c in cuts.values()) + 1)
    for column, name in columns.items():
        w = Window.partitionBy("_s").orderBy(column, tie)
        df = df.withColumn("_s", stretches[column]).withColumn(name, (F.row_number().over(w) + _at(before[column], F.col("_s"))).cast("bigint")).drop("_s")
    return df


def long_places(points: DataFrame, columns: list[str], keep: list[str], tie: str, n: int) -> DataFrame:
    """(keep, factor, x, place): one row a row and column, factor the column's number, place its place from 1 in order of (x, tie)."""
    cuts = dict(zip(columns, _cuts(points, columns, n)))
    stretches = {c: _stretch(c, cuts[c]) for c in columns}
    before = _before(points, stretches, max(len(c) for c in cuts.values()) + 1)
    rows = F.array(*[F.struct(F.lit(j).alias("factor"), F.col(c).alias("x"), stretches[c].alias("_s")) for j, c in enumerate(columns)])
    d = points.select(*keep, F.explode(rows).alias("r")).select(*keep, "r.*")
    shift = F.lit(0)
    if any(len(b) > 1 for b in before.values()):
        table = F.array(*[F.array(*[F.lit(x) for x in before[c]]) for c in columns])
        shift = F.element_at(F.element_at(table, F.col("factor") + 1), F.col("_s") + 1)
    w = Window.partitionBy("factor", "_s").orderBy("x", tie)
    return d.withColumn("place", (F.row_number().over(w) + shift).cast("bigint")).drop("_s")


def shares_under(df: DataFrame, column: str, name: str, n: int) -> DataFrame:
    """df with the share of all n rows at or under the column's value."""
    cuts = _cuts(df, [column], n)[0]
    before = _before(df, {column: _stretch(column, cuts)}, len(cuts) + 1)[column]
    d = df.withColumn("_s", _stretch(column, cuts))
    part = Window.partitionBy("_s")
    own = F.round(F.cume_dist().over(part.orderBy(column)) * F.count(F.lit(1)).over(part))
    return d.withColumn(name, (own + _at(before, F.col("_s"))) / n).drop("_s")


def with_previous(df: DataFrame, order: str, columns: dict[str, str], n: int) -> DataFrame:
    """df with the values that the row before, in order of a number, has in columns (column -> name), and ``first``: whether there is none."""
    cuts = _cuts(df, [order], n)[0]
    d = df.withColumn("_s", _stretch(order, cuts))
    w = Window.partitionBy("_s").orderBy(order)
    had = F.lag(F.struct(*[F.col(c).alias(a) for c, a in columns.items()])).over(w)
    d = d.withColumn("_p", had)
    if cuts:  # the first row of a stretch follows the last one of the stretch before
        lasts = d.groupBy("_s").agg(F.max_by(F.struct(*[F.col(c).alias(a) for c, a in columns.items()]), order).alias("_last"))
        lasts = lasts.select("_s", F.lag("_last").over(Window.orderBy("_s")).alias("_before"))  # a row a stretch
        d = d.join(F.broadcast(lasts), "_s").withColumn("_p", F.coalesce("_p", "_before")).drop("_before")
    return d.select(*df.columns, F.col("_p").isNull().alias("first"), *[F.col("_p")[a].alias(a) for a in columns.values()])


def tile(place: Column, n: int, tiles: int) -> Column:
    """The tile, from 1, of a place among n rows: the first n % tiles tiles have one row more."""
    size, more = n // tiles, n % tiles
    early = F.ceil(place / (size + 1))
    if size == 0:
        return place.cast("int")
    return F.when(place <= more * (size + 1), early).otherwise(more + F.ceil((place - more * (size + 1)) / size)).cast("int")
