"""Interval algebra. Rows are (contig, start, end, ...), 0-based and half-open; every function is DataFrame -> DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusmill.operators.running import TILE, cut_at_tiles, linked, neighbour, running, runs, tiled

KEY = ("contig", "start", "end")


def sweep(intervals: DataFrame, sums: dict[str, Column] | None = None, tile: int = TILE) -> DataFrame:
    """Segmenting merge: contig, start, end, n and each of `sums` added up over the intervals that cover a segment.

    Cut at every start and every end, also where nothing changes on balance; gaps give no row; equal neighbours stay apart.
    Intervals are cut at tiles, so that sums begin anew in each; segments that go on over a tile's end are joined again, and cuts that only tiles made
    are told from real ones. Events are pre-aggregated by position before the shuffle."""
    values = {"n": F.lit(1), **(sums or {})}
    rows = cut_at_tiles(intervals.where("start < end").select("contig", "start", "end", *[e.cast("long").alias(n) for n, e in values.items()]), tile)
    event = lambda at, sign, cut: F.struct("__tile", F.col(at).alias("pos"), (~F.col(cut)).alias("__real"), *[(F.col(n) * sign).alias(n) for n in values])
    events = rows.select("contig", F.explode(F.array(event("__s", 1, "__from"), event("__e", -1, "__to"))).alias("e")).select("contig", "e.*")
    events = events.groupBy("contig", "__tile", "pos").agg(F.max("__real").alias("__real"), *[F.sum(n).alias(n) for n in values])
    inside = Window.partitionBy("contig", "__tile").orderBy("pos")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    found = events.select("contig", "__tile", F.col("pos").alias("start"), F.lead("pos").over(inside).alias("end"), (~F.col("__real")).alias("__from"), (~F.lead("__real").over(inside)).alias("__to"), *[F.sum(n).over(upto).alias(n) for n in values])
    on = lambda p: p["__to"] & F.col("__from") & (p["end"] == F.col("start"))
    final = [F.min("start").alias("start"), F.max("end").alias("end"), *[F.first(n).alias(n) for n in values]]
    return linked(found.where("n > 0"), ["contig"], ["start"], ["end", "__to"], on, final, edge=F.col("__from") | F.col("__to"))


def zero_filled(intervals: DataFrame, contigs: DataFrame, sums: dict[str, Column] | None = None, tile: int = TILE) -> DataFrame:
    """sweep() over whole contigs: positions that nothing covers are segments with zeros."""
    names = list(sums or {})
    rows = intervals.select("contig", "start", "end", F.lit(1).alias("n1"), *[e.alias(n) for n, e in (sums or {}).items()])
    whole = contigs.select("contig", F.lit(0).cast("long").alias("start"), F.col("len").cast("long").alias("end"), F.lit(0).alias("n1"), *[F.lit(0).alias(n) for n in names])
    out = sweep(rows.unionByName(whole), {"n1": F.col("n1"), **{n: F.col(n) for n in names}}, tile)
    return out.select("contig", "start", "end", F.col("n1").alias("n"), *names)


def merge(intervals: DataFrame, gap: int = 0, abut: bool = True, sums: dict[str, Column] | None = None, tile: int = TILE) -> DataFrame:
    """Union: contig, start, end, n (intervals joined) and sums of payloads.

    abut=True: intervals that touch, or are at most `gap` apart, are joined; abut=False: only those that share a position. Intervals are joined inside
    tiles, and over their ends where one goes on or the gap is small enough; an interval counts where it starts."""
    own = ~F.col("__from")
    rows = cut_at_tiles(intervals.select("contig", "start", "end", *[e.alias(f"__sum_{n}") for n, e in (sums or {}).items()]), tile)
    rows = rows.select("contig", "__tile", F.col("__s").alias("start"), F.col("__e").alias("end"), "__from", "__to", own.cast("long").alias("n"), *[F.when(own, F.col(f"__sum_{n}")).alias(n) for n in sums or {}])
    inside = Window.partitionBy("contig", "__tile").orderBy("start", "end")
    rows = rows.withColumn("__reach", F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    apart = F.col("start") > F.col("__reach") + gap if abut else F.col("start") >= F.col("__reach")
    rows = rows.withColumn("__island", F.sum(F.when(F.col("__reach").isNull() | apart, 1).otherwise(0)).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    final = [F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"), *[F.sum(n).alias(n) for n in sums or {}]]
    found = rows.groupBy("contig", "__tile", "__island").agg(*final, F.max("__from").alias("__from"), F.max("__to").alias("__to")).drop("__island")
    on = lambda p: (p["__to"] & F.col("__from")) | (F.col("start") <= p["end"] + gap if abut else F.lit(False))
    return linked(found, ["contig"], ["start"], ["end", "__to"], on, final)


def overlap_join(left: DataFrame, right: DataFrame, bucket: int = 1 << 14, how: str = "inner", prefix: str = "r_") -> DataFrame:
    """Rows of left and right on one contig that share a position; right's columns get the prefix; how: inner, left, left_semi, left_anti.

    An overlap predicate alone would be a nested loop. Both sides are dealt to every bucket of positions they touch and meet by
    (contig, bucket); a pair is kept in the bucket where its overlap starts, so it comes out once."""
    if how != "inner":
        # the id must be the same when the plan runs twice, so it is made of the row itself
        keyed = left.withColumn("__id", F.struct(*left.columns))
        pairs = overlap_join(left, right, bucket, "inner", prefix)
        if how in ("left_semi", "left_anti"):
            hit = pairs.select(F.struct(*left.columns).alias("__id")).distinct()
            return keyed.join(hit, "__id", how).select(*left.columns)
        hit = pairs.select(F.struct(*left.columns).alias("__id")).distinct()
        miss = keyed.join(hit, "__id", "left_anti").select(*left.columns)
        return pairs.unionByName(miss, allowMissingColumns=True)
    r = right.select(*[F.col(c).alias(prefix + c) for c in right.columns])
    span = lambda s, e: F.sequence(F.floor(F.col(s) / bucket), F.floor((F.greatest(F.col(e) - 1, F.col(s))) / bucket))
    a = left.where("start < end").withColumn("__b", F.explode(span("start", "end")))
    b = r.where(f"{prefix}start < {prefix}end").withColumn("__rb", F.explode(span(f"{prefix}start", f"{prefix}end")))
    first = F.floor(F.greatest(F.col("start"), F.col(f"{prefix}start")) / bucket)
    on = (F.col("contig") == F.col(f"{prefix}contig")) & (F.col("__b") == F.col("__rb")) & (F.col("start") < F.col(f"{prefix}end")) & (F.col(f"{prefix}start") < F.col("end"))
    return a.join(b, on).where(F.col("__b") == first).drop("__b", "__rb")


def overlap_totals(left: DataFrame, right: DataFrame, by: list[str], tile: int = TILE) -> DataFrame:
    """by, pairs, bases: how many pairs overlap_join() has for each value of right's columns `by`, and how many positions they share in all.

    No pair is made. An interval of right meets the intervals of left that start before its end, less those that end at or before its start; the positions
    shared are those covered up to its end, less those up to its start. Both are running sums over positions, at which rows are counted first."""
    event = lambda at, **v: F.struct(F.col(at).cast("long").alias("pos"), *[F.lit(x).alias(n) for n, x in v.items()])
    own = left.where("start < end AND contig IS NOT NULL").select("contig", F.explode(F.array(event("start", s=1, e=0), event("end", s=0, e=1))).alias("v"))
    own = own.groupBy("contig", F.col("v.pos").alias("pos")).agg(F.sum("v.s").alias("__s"), F.sum("v.e").alias("__e"))
    # at one position: ends of right, then left, then starts of right
    asked = right.where("start < end AND contig IS NOT NULL").select("contig", F.struct(*by).alias("__by"), F.explode(F.array(event("start", k=2), event("end", k=0))).alias("v"))
    asked = asked.groupBy("contig", "__by", F.col("v.pos").alias("pos"), F.col("v.k").alias("__k")).agg(F.count(F.lit(1)).alias("__m"))
    rows = tiled(own.withColumn("__k", F.lit(1)).unionByName(asked, allowMissingColumns=True), F.col("pos"), tile)
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = {"__starts": ("sum", zero(F.col("__s"))), "__ends": ("sum", zero(F.col("__e"))), "__at": ("sum", zero(F.col("pos") * (F.col("__s") - F.col("__e"))))}
    rows = running(rows, ["contig"], ["pos", "__k"], sums).where("__k <> 1")
    upto = F.col("pos") * (F.col("__starts") - F.col("__ends")) - F.col("__at")
    pairs = F.when(F.col("__k") == 0, F.col("__starts")).otherwise(-F.col("__ends"))
    bases = F.when(F.col("__k") == 0, upto).otherwise(-upto)
    out = rows.groupBy("__by").agg(F.sum(F.col("__m") * pairs).alias("pairs"), F.sum(F.col("__m") * bases).alias("bases"))
    return out.where("pairs > 0").select("__by.*", "pairs", "bases")


def intersect(left: DataFrame, right: DataFrame, **options) -> DataFrame:
    """Common parts, with left's payload."""
    other = [c for c in left.columns if c not in KEY]
    out = overlap_join(left, right.select("contig", "start", "end"), **options)
    return out.select("contig", F.greatest("start", "r_start").alias("start"), F.least("end", "r_end").alias("end"), *other)


def subtract(left: DataFrame, right: DataFrame, tile: int = TILE) -> DataFrame:
    """Positions of left that right doesn't cover: contig, start, end; neighbouring pieces joined where left's own pieces were cut only by right."""
    both = left.select("contig", "start", "end", F.lit(1).alias("l"), F.lit(0).alias("r")).union(right.select("contig", "start", "end", F.lit(0), F.lit(1)))
    only = sweep(both, {"l": F.col("l"), "r": F.col("r")}, tile).where("l > 0 AND r = 0")
    return merge(only.select("contig", "start", "end"), tile=tile).select("contig", "start", "end")


def depth(intervals: DataFrame, tile: int = TILE) -> DataFrame:
    """Segments with the number of intervals over each."""
    return sweep(intervals, tile=tile)


def covered_times(intervals: DataFrame, times: int = 1, tile: int = TILE) -> DataFrame:
    """Segments that exactly `times` intervals cover (1: single coverage)."""
    return sweep(intervals, tile=tile).where(F.col("n") == times).select("contig", "start", "end")


def multi_intersect(tables: Sequence[DataFrame], least: int | None = None, tile: int = TILE) -> DataFrame:
    """Segments that at least `least` of the tables cover (default: all), each table counted once; touching ones joined."""
    every = None
    for t in tables:
        own = merge(t.select("contig", "start", "end"), tile=tile).select("contig", "start", "end")
        every = own if every is None else every.union(own)
    found = sweep(every, tile=tile).where(F.col("n") >= (least or len(tables)))
    return merge(found.select("contig", "start", "end"), tile=tile).select("contig", "start", "end")


def union_all(tables: Sequence[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def priority_overlay(tables: Sequence[DataFrame], contigs: DataFrame, tile: int = TILE) -> DataFrame:
    """contig, start, end, region: the first table (numbered from 1) that covers a position; 0 where none does."""
    sums, rows = {}, None
    for k, t in enumerate(tables, 1):
        own = t.select("contig", "start", "end", *[F.lit(1 if j == k else 0).alias(f"t{j}") for j in range(1, len(tables) + 1)])
        rows = own if rows is None else rows.union(own)
        sums[f"t{k}"] = F.col(f"t{k}")
    found = zero_filled(rows, contigs, sums, tile)
    region = F.lit(0)
    for k in range(len(tables), 0, -1):
        region = F.when(F.col(f"t{k}") > 0, k).otherwise(region)
    return collapse(found.select("contig", "start", "end", region.alias("region")), ["region"], tile)


def collapse(segments: DataFrame, values: list[str], tile: int = TILE) -> DataFrame:
    """Run-length collapse: neighbours that touch and agree in `values` become one segment."""

    def same(p: Column) -> Column:
        on = p["end"].eqNullSafe(F.col("start"))
        for v in values:
            on = on & p[v].eqNullSafe(F.col(v))
        return on

    final = [F.min("start").alias("start"), F.max("end").alias("end"), *[F.first(v).alias(v) for v in values]]
    rows = tiled(segments.select("contig", "start", "end", *values), F.col("start"), tile)
    return runs(rows, ["contig"], ["start"], ["end", *values], same, final, final).select("contig", "start", "end", *values)


def fill_gaps(blocks: DataFrame, tile: int = TILE) -> DataFrame:
    """Gaps between consecutive blocks (contig, start, end, source) are shared out by the neighbours' lengths, rounded down for the left one.

    Returns the gap parts: contig, start, end, source (of the neighbour that gets them)."""
    rows = neighbour(tiled(blocks, F.col("start"), tile), ["contig"], ["start"], ["start", "end", "source"], "p")
    gap = F.col("start") - F.col("p.end")
    left, right = F.col("p.end") - F.col("p.start"), F.col("end") - F.col("start")
    cut = F.col("p.end") + F.floor(gap * left / (left + right))
    parts = F.array(F.struct(F.col("p.end").alias("start"), cut.alias("end"), F.col("p.source").alias("source")), F.struct(cut.alias("start"), F.col("start").alias("end"), F.col("source").alias("source")))
    return rows.where(gap > 0).select("contig", F.explode(parts).alias("g")).select("contig", "g.start", "g.end", "g.source").where("start < end")


def relation(left: DataFrame, right: DataFrame, **options) -> DataFrame:
    """Pairs that overlap, with `relation`: perfect, contained (left in right), container, partial."""
    kind = F.when((F.col("start") == F.col("r_start")) & (F.col("end") == F.col("r_end")), "perfect").when((F.col("start") >= F.col("r_start")) & (F.col("end") <= F.col("r_end")), "contained").when((F.col("start") <= F.col("r_start")) & (F.col("end") >= F.col("r_end")), "container").otherwise("partial")
    return overlap_join(left, right, **options).withColumn("relation", kind)


def overlapping(left: DataFrame, right: DataFrame, ratio: float = 0.0, **options) -> DataFrame:
    """Rows of left more than `ratio` of whose length a single row of right covers."""
    pairs = overlap_join(left, right.select("contig", "start", "end"), **options)
    share = (F.least("end", "r_end") - F.greatest("start", "r_start")) / (F.col("end") - F.col("start"))
    return left.join(pairs.where(share > ratio).select(*left.columns).distinct(), left.columns, "left_semi")


def complement(blocks: DataFrame, contigs: DataFrame, tile: int = TILE) -> DataFrame:
    """Parts of contigs outside blocks."""
    return subtract(contigs.select("contig", F.lit(0).cast("long").alias("start"), F.col("len").cast("long").alias("end")), blocks, tile)


def split_batches(blocks: DataFrame, batches: int, tile: int = TILE) -> DataFrame:
    """contig, start, end, batch: blocks in order of contig and start, cut so that each of `batches` has ceil(total / batches) bases."""
    per = blocks.groupBy("contig").agg(F.sum(F.col("end") - F.col("start")).alias("len"))
    above = Window.orderBy("contig").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("contig", F.coalesce(F.sum("len").over(above), F.lit(0)).alias("__base"), F.sum("len").over(Window.partitionBy()).alias("__all"))
    rows = running(tiled(blocks.select("contig", "start", "end"), F.col("start"), tile), ["contig"], ["start"], {"__off": ("sum", F.col("end") - F.col("start"))}, before=True)
    rows = rows.join(per, "contig").withColumn("__size", F.ceil(F.col("__all") / batches)).withColumn("__off", F.col("__off") + F.col("__base"))
    first, last = F.floor(F.col("__off") / F.col("__size")), F.floor((F.col("__off") + F.col("end") - F.col("start") - 1) / F.col("__size"))
    rows = rows.where("start < end").withColumn("batch", F.explode(F.sequence(first, last)))
    a = F.col("start") + F.greatest(F.lit(0), F.col("batch") * F.col("__size") - F.col("__off"))
    b = F.least(F.col("end"), F.col("start") + (F.col("batch") + 1) * F.col("__size") - F.col("__off"))
    return rows.select("contig", a.alias("start"), b.alias("end"), F.col("batch").cast("int").alias("batch"))


def pack_contigs(contigs: DataFrame, bins: int) -> DataFrame:
    """contig, len, bin: the `bins` longest contigs open a bin each (as many as there are contigs); by falling length the others fill one bin after the
    other until it has total / (bins + 1) + 1 bases, and what is left then goes round the bins.

    For the list of contigs, which is small whatever the data on them: one row holds it."""
    one = contigs.agg(F.sort_array(F.collect_list(F.struct((-F.col("len")).alias("n"), "contig"))).alias("s"), F.sum("len").alias("all"))
    one = one.withColumn("k", F.least(F.lit(bins), F.size("s"))).withColumn("full", F.floor(F.col("all") / (F.col("k") + 1)) + 1)
    seed = lambda g: F.when(g < F.col("k"), -F.try_element_at("s", (g + 1).cast("int"))["n"]).otherwise(F.lit(0)).cast("long")
    opened = F.size(F.filter(F.slice("s", 1, F.col("k")), lambda x: -x["n"] >= F.col("full")))

    def put(state: Column, i: Column) -> Column:
        more = state["size"] >= F.col("full")
        g = F.when(more, state["g"] + 1).otherwise(state["g"])
        size = F.when(more, seed(g)).otherwise(state["size"]) - F.element_at("s", i)["n"]
        over = g >= F.col("k")
        bin_ = F.when(over, (i - 1) % F.col("k")).otherwise(g).cast("int")
        return F.struct(g.cast("int").alias("g"), F.when(over, F.lit(0).cast("long")).otherwise(size.cast("long")).alias("size"), F.concat(state["bins"], F.array(bin_)).alias("bins"))

    first = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: i.cast("int"))
    start = F.struct(opened.cast("int").alias("g"), seed(opened).alias("size"), first.alias("bins"))
    rest = F.when(F.size("s") > F.col("k"), F.sequence(F.col("k") + 1, F.size("s"))).otherwise(F.array().cast("array<int>"))
    made = one.where(F.size("s") > 0).select(F.arrays_zip("s", F.aggregate(rest, start, put)["bins"].alias("bins")).alias("z"))
    return made.select(F.explode("z").alias("z")).select("z.s.contig", (-F.col("z.s.n")).alias("len"), "z.bins").toDF("contig", "len", "bin")


def chunk_last(length: Column, size: int) -> Column:
    """Number of a contig's last chunk: chunks are `size` long, the last one takes a rest of up to 2 * size - 2 (a single one 2 * size - 1)."""
    return F.when(length < 2 * size, 0).otherwise(F.greatest(F.lit(1), F.ceil((length - 2 * size + 2) / F.lit(size)))).cast("long")


def tile_contigs(contigs: DataFrame, size: int) -> DataFrame:
    """contig, start, end, chunk: whole contigs cut by the chunk rule."""
    last = chunk_last(F.col("len"), size)
    rows = contigs.where("len > 0").withColumn("__last", last).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__last"))))
    end = F.when(F.col("chunk") == F.col("__last"), F.col("len")).otherwise((F.col("chunk") + 1) * size)
    return rows.select("contig", (F.col("chunk") * size).alias("start"), end.cast("long").alias("end"), "chunk")


def totals(blocks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """number and length of blocks."""
    return blocks.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("number"), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("length"))


def same_blocks(a: DataFrame, b: DataFrame) -> bool:
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()


def annotation_turns(segments: DataFrame, bits: str = "annot_bits", tile: int = TILE) -> DataFrame:
    """Adds starting and ending: annotation bits that begin with a segment and that ended with the one before it."""
    rows = neighbour(tiled(segments, F.col("start"), tile), ["contig"], ["start"], [bits], "__p")
    p = F.coalesce(F.col(f"__p.{bits}"), F.lit(0).cast("long"))
    return rows.withColumn("starting", F.col(bits).bitwiseAND(F.bitwise_not(p))).withColumn("ending", p.bitwiseAND(F.bitwise_not(F.col(bits)))).drop("__p", "__tile")


# shape


def truncate_left(b: DataFrame, by: int) -> DataFrame:
    return b.where(F.col("end") - F.col("start") > by).withColumn("start", F.col("start") + by)


def truncate_right(b: DataFrame, by: int) -> DataFrame:
    return b.where(F.col("end") - F.col("start") > by).withColumn("end", F.col("end") - by)


def truncate_both(b: DataFrame, by: int) -> DataFrame:
    return b.where(F.col("end") - F.col("start") > 2 * by).withColumn("start", F.col("start") + by).withColumn("end", F.col("end") - by)


def extend(b: DataFrame, contigs: DataFrame, left: int = 0, right: int = 0) -> DataFrame:
    """Longer on either side, held inside the contig."""
    cols = b.columns
    return b.join(contigs.select("contig", "len"), "contig").withColumn("start", F.greatest(F.lit(0), F.col("start") - left)).withColumn("end", F.least(F.col("len"), F.col("end") + right)).select(*cols)


def shift(b: DataFrame, by: int, low: int, high: int) -> DataFrame:
    """Moved, clipped to [low, high); what falls outside goes."""
    return b.withColumn("start", F.greatest(F.lit(low), F.col("start") + by)).withColumn("end", F.least(F.lit(high), F.col("end") + by)).where("start < end")


def reverse(b: DataFrame, contigs: DataFrame) -> DataFrame:
    """The same blocks counted from the contig's other end."""
    cols = b.columns
    return b.join(contigs.select("contig", "len"), "contig").withColumn("__s", F.col("len") - F.col("end")).withColumn("end", F.col("len") - F.col("start")).withColumn("start", F.col("__s")).select(*cols)


def longer_than(b: DataFrame, least: int) -> DataFrame:
    return b.where(F.col("end") - F.col("start") >= least)


def whole_contigs(contigs: DataFrame) -> DataFrame:
    return contigs.select("contig", F.lit(0).cast("long").alias("start"), F.col("len").cast("long").alias("end"))


def unsplit(b: DataFrame) -> DataFrame:
    """contig names ctg:start-end (0-based) back to ctg, with start and end moved along; other names stay."""
    offset = F.coalesce(F.regexp_extract("contig", r":(\d+)-\d+$", 1).try_cast("long"), F.lit(0))
    return b.withColumn("__o", offset).withColumn("contig", F.regexp_replace("contig", r":\d+-\d+$", "")).withColumn("start", F.col("start") + F.col("__o")).withColumn("end", F.col("end") + F.col("__o")).drop("__o")
