"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Every document of a source is expected target / source size times. Expected copies are summed up within the source
along documents in order of size, one offset of the source is added, and a document is emitted once for each integer
that its part of the sum crosses. In order of size, what a source takes differs from its target by about one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusmill.llm._tables import bitmap, small, with_bit, written

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, source: str, size: str, weights: list[int], most: int) -> DataFrame:
    """source, source_size and target of each source: weights repeat along sources by code point (null last), targets share the
    whole size by weight, and what stands above `most` times a source's size is shared again by weight among the others.

    That ends at target = least(most * source_size, level * weight) with one level for all, found from running sums over
    sources in the order of most * source_size / weight. Only the list of sources is ordered, not their documents.
    """
    per = sizes.groupBy(source).agg(F.sum(size).alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    per = per.withColumn("__w", weight).withColumn("__cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("__cap") / F.col("__w"), F.col(source).asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = per.withColumn("__left", F.sum("source_size").over(whole) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0)))
    per = per.withColumn("__share", F.col("__left") / (F.sum("__w").over(whole) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))))
    # the level is the share of the first source that it leaves below its cap; there is one unless all are at their caps
    per = per.withColumn("__level", F.min(F.when(F.col("__share") * F.col("__w") <= F.col("__cap"), F.struct((F.col("__cap") / F.col("__w")).alias("__at"), F.col("__share").alias("__level")))).over(whole)["__level"])
    return per.select(source, "source_size", F.coalesce(F.least(F.col("__cap"), F.col("__level") * F.col("__w")), F.col("__cap")).alias("target"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix", keys: tuple[str, ...] = ()) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies, taken (copies * size), and the columns `keys`.

    One row for each input row. size: words of the whole text (null: 0). Sources without words have target 0 and copies 0.
    copies never exceeds `most` rounded up. The offset is drawn from `seed` and the source's name, so reruns agree.
    Rows with the same doc_id and size are alike to the sampling: which of them comes first (by `keys`, where given) doesn't change how many are taken.
    A null source is a source of its own, a null doc_id sorts first.
    Order within a source is by size, then by 256 groups of ids' digests, then by id: ranks come from counts of (source, size,
    group), so that a source or a group of copies with a third of all rows is ranked by many tasks.
    """
    sizes = written(
        docs.select(docs[doc_id].alias("doc_id"), docs[source].cast("string").alias("source"), F.coalesce(F.regexp_count(docs[text].cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *[docs[c] for c in keys])
        .withColumn("__g", F.coalesce(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 2), F.lit(""))),
        "mix-sizes",
    )
    targets = source_targets(sizes, "source", "size", list(weights), most)
    groups = sizes.groupBy("source", "size", "__g").agg(F.count(F.lit(1)).alias("__n"))
    levels = groups.groupBy("source", "size").agg(F.sum("__n").alias("__m"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.withColumn("__below", F.coalesce(F.sum("__m").over(before("source").orderBy("size")), F.lit(0)))
    groups = groups.withColumn("__here", F.coalesce(F.sum("__n").over(before("source", "size").orderBy("__g")), F.lit(0)))
    l, g, t = levels.alias("l"), groups.alias("g"), targets.alias("t")
    starts = g.join(l, F.col("g.source").eqNullSafe(F.col("l.source")) & (F.col("g.size") == F.col("l.size"))).select(
        F.col("g.source").alias("s_source"), F.col("g.size").alias("s_size"), F.col("g.__g").alias("s_g"), (F.col("l.__below") + F.col("g.__here")).alias("__start")
    )
    starts = starts.join(t, F.col("s_source").eqNullSafe(F.col("t.source"))).select("s_source", "s_size", "s_g", "__start", "source_size", "target")
    ranked = sizes.withColumn("__r", F.row_number().over(Window.partitionBy("source", "size", "__g").orderBy("doc_id", *keys)))
    out = ranked.join(starts, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("size") == F.col("s_size")) & (F.col("__g") == F.col("s_g")))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce("source", F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank = F.col("__start") + F.col("__r")
    copies = (F.floor(rank * rate + offset) - F.floor((rank - 1) * rate + offset)).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *keys)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as mix() takes it, with its columns unchanged. An empty table gives an empty mix.

    Each row is a document of its own, also where doc_ids are null or shared: rows are written with a number first. A source takes each of its rows
    equally often or once more, so a bit for each row says how often: texts stay where they are while the bitmap is small enough to be broadcast."""
    names = [options.get(k, k) for k in ("text", "source")]
    rows = written(docs.withColumn("__h", F.xxhash64(*[docs[c].cast("string") for c in names])).withColumn("__row", F.monotonically_increasing_id()), "mix-rows")
    taken = written(mix(rows, keys=("__h", "__row"), **options).select("__row", F.col("source").alias("__source"), "copies"), "mix-copies")
    least = written(taken.groupBy("__source").agg(F.min("copies").alias("__least"), F.max("copies").alias("__most")), "mix-least")
    if least.where("__most > __least + 1").limit(1).count():  # sums so large that doubles are rounded
        joined = rows.join(taken.select("__row", F.col("copies").alias("copies__")), "__row")
    else:
        per = small(least, least.select(F.col("__source").alias("__s"), "__least"))
        more = bitmap(taken.join(per, F.col("__source").eqNullSafe(F.col("__s"))).where("copies > __least"), F.col("__row"), "mix-more")
        joined = with_bit(rows, F.col("__row"), more, "__more").join(per, rows[names[1]].cast("string").eqNullSafe(F.col("__s")))
        joined = joined.withColumn("copies__", F.col("__least") + F.col("__more").cast("long"))
    count = F.col("copies__").cast("int")
    return joined.where(count > 0).withColumn("__k", F.explode(F.sequence(F.lit(1), count))).select(*docs.columns)


def targets_sql(weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix") -> str:
    """The same as op9's query in DuckDB's SQL."""
    w = ", ".join(f"{float(x)}" for x in weights)
    return f"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                  coalesce(substr(md5(doc_id::VARCHAR), 1, 2), '') AS g FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size, sum(size)::DOUBLE * {float(most)} AS cap FROM s GROUP BY source),
q AS (SELECT *, [{w}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)}] AS w FROM p),
r AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0.0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0.0)) AS share
      FROM q WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, coalesce(least(cap, arg_min(CASE WHEN share * w <= cap THEN share END, CASE WHEN share * w <= cap THEN cap / w END) OVER () * w), cap) AS target FROM r),
k AS (SELECT s.doc_id, s.size, t.source_size, t.target, row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.g, s.doc_id) AS rank,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
             ('0x' || substr(md5('{seed}:' || coalesce(s.source, '')), 1, 8))::BIGINT / 4294967296.0 AS u
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(rank * rate + u) - floor((rank - 1) * rate + u))::BIGINT * size)::BIGINT AS taken FROM k
"""
