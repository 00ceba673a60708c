"""Running sums, maxima, neighbours and runs along positions, in tiles.

A window over a whole contig is one task for each contig, however long it is. Here rows are cut into tiles of positions, and what goes on
beyond a tile is settled among the tiles' first and last rows alone: these share a lane for each contig, all other rows stay in the lane of their tile.
Every function reads its input once, so a plan of many steps grows with their number and no more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = 1 << 20

_SUM = {"sum": F.sum, "max": F.max}


def tiled(df: DataFrame, position: Column, tile: int = TILE) -> DataFrame:
    return df.withColumn("__tile", F.floor(position / F.lit(tile)).cast("long"))


def cut_at_tiles(df: DataFrame, tile: int = TILE) -> DataFrame:
    """Each interval as its pieces in tiles: __tile, __s, __e, __from (it comes from the tile before) and __to (it goes on in the next one)."""
    at = lambda c: F.floor(c / F.lit(tile)).cast("long")
    out = df.withColumn("__tile", F.explode(F.sequence(at(F.col("start")), at(F.greatest(F.col("end") - 1, F.col("start"))))))
    low, high = F.col("__tile") * tile, (F.col("__tile") + 1) * tile
    return out.withColumns({"__s": F.greatest("start", low), "__e": F.least("end", high), "__from": F.col("start") < low, "__to": F.col("end") > high})


def _laned(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds __n (row number in the tile), __last and __lane: null for a tile's first and last row, else the tile."""
    inside = Window.partitionBy(*by, "__tile").orderBy(*order)
    out = df.withColumns({"__n": F.row_number().over(inside), "__last": F.lead(F.lit(1)).over(inside).isNull()})
    return out.withColumn("__lane", F.when((F.col("__n") > 1) & ~F.col("__last"), F.col("__tile")))


def _across(by: list[str]):
    return Window.partitionBy(*by, "__lane").orderBy("__tile", "__n")


def running(df: DataFrame, by: list[str], order: list[str], values: dict[str, tuple[str, Column]], before: bool = False) -> DataFrame:
    """Adds columns: name -> ("sum" or "max", expression), taken over rows up to each row (before: without it) in `order` within `by`.

    df has come through tiled(); order must not go backwards over tiles. Sums start at 0, maxima at null."""
    inside = Window.partitionBy(*by, "__tile").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    less = Window.partitionBy(*by, "__tile").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumns({f"__v_{n}": e for n, (_, e) in values.items()})
    rows = rows.withColumns({f"__u_{n}": _SUM[h](f"__v_{n}").over(inside) for n, (h, _) in values.items()} | ({f"__b_{n}": _SUM[h](f"__v_{n}").over(less) for n, (h, _) in values.items()} if before else {}))
    rows = _laned(rows, by, order)
    up = _across(by).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"__c_{n}": _SUM[h](F.when(F.col("__last"), F.col(f"__u_{n}"))).over(up) for n, (h, _) in values.items()})
    whole = Window.partitionBy(*by, "__tile")
    cols, zero = {}, F.lit(0)
    for n, (h, _) in values.items():
        here, there = F.col(f"__b_{n}" if before else f"__u_{n}"), F.max(F.when(F.col("__n") == 1, F.col(f"__c_{n}"))).over(whole)
        cols[n] = F.coalesce(here, zero) + F.coalesce(there, zero) if h == "sum" else F.greatest(here, there)
    return rows.withColumns(cols).drop("__n", "__last", "__lane", *[f"__{x}_{n}" for n in values for x in "vubc"])


def neighbour(df: DataFrame, by: list[str], order: list[str], columns: list[str], name: str, ahead: bool = False) -> DataFrame:
    """Adds a struct `name` of the given columns of the row before (ahead: after) each row; null at the ends."""
    row, step = F.struct(*columns), F.lead if ahead else F.lag
    rows = _laned(df.withColumn("__o", step(row).over(Window.partitionBy(*by, "__tile").orderBy(*order))), by, order)
    edge = F.col("__last") if ahead else F.col("__n") == 1
    return rows.withColumn(name, F.when(edge, step(row).over(_across(by))).otherwise(F.col("__o"))).drop("__o", "__n", "__last", "__lane")


def numbered(df: DataFrame, by: list[str], order: list[str], columns: list[str], begins: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Adds a number for each name: how many rows up to each one begin something new, as begins[name] says (true or false) of the struct of `columns` of
    the row before it (null for the first row)."""
    inside = Window.partitionBy(*by, "__tile").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = _laned(df.withColumn("__o", F.lag(F.struct(*columns)).over(inside)), by, order)
    flag = lambda c: F.when(c, 1).otherwise(0)
    rows = rows.withColumns({f"__u_{n}": F.sum(F.when(F.col("__n") > 1, flag(f(F.col("__o")))).otherwise(0)).over(upto) for n, f in begins.items()})
    rows = rows.withColumn("__p", F.lag(F.struct(*columns)).over(_across(by)))
    first = F.col("__n") == 1
    rows = rows.withColumns({f"__f_{n}": F.when(first, flag(f(F.col("__p")))).otherwise(0) for n, f in begins.items()})
    up = _across(by).rowsBetween(Window.unboundedPreceding, -1)
    total = lambda n: F.coalesce(F.sum(F.col(f"__f_{n}") + F.when(F.col("__last"), F.col(f"__u_{n}")).otherwise(0)).over(up), F.lit(0)) + F.col(f"__f_{n}")
    rows = rows.withColumns({f"__c_{n}": total(n) for n in begins})
    whole = Window.partitionBy(*by, "__tile")
    rows = rows.withColumns({n: F.max(F.when(first, F.col(f"__c_{n}"))).over(whole) + F.col(f"__u_{n}") for n in begins})
    return rows.drop("__o", "__p", "__n", "__last", "__lane", *[f"__{x}_{n}" for n in begins for x in "ufc"])


def runs(df: DataFrame, by: list[str], order: list[str], columns: list[str], joins: Callable[[Column], Column], local: list[Column], final: list[Column]) -> DataFrame:
    """Runs of rows, aggregated inside tiles by `local` and over tiles by `final`.

    joins(p): whether a row goes on from the row before it, p being the struct of its `columns`; local must make these columns (and
    the ones in `order`) again for the runs of a tile, so that joins() says the same of a tile's first run and the last run of the tile before."""
    inside = Window.partitionBy(*by, "__tile").orderBy(*order)
    rows = df.withColumn("__p", F.lag(F.struct(*columns)).over(inside))
    rows = rows.withColumn("__run", F.sum(F.when(joins(F.col("__p")), 0).otherwise(1)).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return linked(rows.groupBy(*by, "__tile", "__run").agg(*local).drop("__run"), by, order, columns, joins, final)


def linked(found: DataFrame, by: list[str], order: list[str], columns: list[str], joins: Callable[[Column], Column], final: list[Column], edge: Column | None = None) -> DataFrame:
    """What has been found inside tiles, joined where joins() says so of rows that follow each other in two tiles. edge: which rows may go on in
    another tile; without it the first and the last row of each tile."""
    if edge is None:
        rows = _laned(found, by, order)
    else:
        rows = found.withColumns({"__n": F.lit(1), "__lane": F.when(edge, F.lit(None).cast("long")).otherwise(F.col("__tile"))})
    across = Window.partitionBy(*by, "__lane").orderBy("__tile", *order)
    rows = rows.withColumn("__p", F.lag(F.struct("__tile", *columns)).over(across))
    on = F.col("__lane").isNull() & (F.col("__p.__tile") != F.col("__tile")) & joins(F.col("__p"))
    rows = rows.withColumn("__chain", F.sum(F.when(on, 0).otherwise(1)).over(across.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by, "__lane", "__chain").agg(*final).drop("__lane", "__chain")
