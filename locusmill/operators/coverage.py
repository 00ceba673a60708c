"""Coverage segments: depth with annotations and labels, histograms, bias detection and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusmill.functions import bits as B
from locusmill.operators.intervals import chunk_last, collapse, overlap_join, sweep
from locusmill.operators.running import TILE, runs, tiled

HISTOGRAM = 249  # depths above count as this one
WINDOW_CAP = 250


def alignment_flags(aln: DataFrame, min_mapq: int = 10, min_clip_ratio: float = 0.1) -> DataFrame:
    """Adds high_mapq and high_clip (0 or 1): mapq at least min_mapq; the longer clip at least min_clip_ratio of the reference length."""
    ratio = F.greatest("l_clip", "r_clip") / (F.col("end") - F.col("start"))
    return aln.withColumn("high_mapq", F.when(F.col("mapq") >= min_mapq, 1).otherwise(0)).withColumn("high_clip", F.when(ratio >= min_clip_ratio, 1).otherwise(0))


def usable(aln: DataFrame, min_length: int = 0, secondary: str = "secondary", keep_rate: float = 1.0, seed: int = 0) -> DataFrame:
    """Primary and supplementary alignments that are long enough, thinned at random (by seed) if asked for."""
    out = aln.where(~F.col(secondary) & (F.col("end") - F.col("start") >= min_length))
    return out if keep_rate >= 1 else out.where(F.rand(seed) <= keep_rate)


def coverage(aln: DataFrame, contigs: DataFrame, annotations: DataFrame | None = None, n_annotations: int = 0, start_only: bool = False, tile: int = TILE) -> DataFrame:
    """contig, start, end, cov, cov_mapq, cov_clip, annot_bits over whole contigs: depth and annotations in one sweep.

    aln has high_mapq and high_clip; annotations: contig, start, end, annot (1...). start_only counts an alignment at its first base."""
    n_annotations = n_annotations or 0
    rows = aln.select("contig", "start", (F.col("start") + 1 if start_only else F.col("end")).alias("end"), F.lit(1).alias("cov"), F.col("high_mapq").alias("cov_mapq"), F.col("high_clip").alias("cov_clip"), F.lit(0).alias("annot"))
    whole = contigs.select("contig", F.lit(0).cast("long").alias("start"), F.col("len").cast("long").alias("end"), *[F.lit(0).alias(c) for c in ("cov", "cov_mapq", "cov_clip", "annot")])
    every = rows.unionByName(whole)
    if annotations is not None:
        every = every.unionByName(annotations.select("contig", "start", "end", *[F.lit(0).alias(c) for c in ("cov", "cov_mapq", "cov_clip")], "annot"))
    sums = {c: F.col(c) for c in ("cov", "cov_mapq", "cov_clip")}
    sums |= {f"a{k}": F.when(F.col("annot") == k, 1).otherwise(0) for k in range(1, n_annotations + 1)}
    out = sweep(every, sums, tile)
    found = F.lit(0).cast("long")
    for k in range(1, n_annotations + 1):
        found = found.bitwiseOR(F.when(F.col(f"a{k}") > 0, B.flag(k)).otherwise(F.lit(0).cast("long")))
    return out.select("contig", "start", "end", "cov", "cov_mapq", "cov_clip", found.alias("annot_bits"))


def with_regions(segments: DataFrame, region_of: list[int], bits: str = "annot_bits") -> DataFrame:
    """Adds region: of a segment's annotations in ascending order the first whose region isn't 0. region_of[k]: region of annotation k (0: none)."""
    region = F.lit(0)
    for k in range(len(region_of) - 1, 0, -1):
        if region_of[k]:
            region = F.when(B.overlaps(F.col(bits), k), region_of[k]).otherwise(region)
    return segments.withColumn("region", F.when((F.col(bits) == 0) & F.lit(bool(region_of and region_of[0])), F.lit(region_of[0] if region_of else 0)).otherwise(region))


def with_labels(segments: DataFrame, labels: DataFrame, name: str, bucket: int = 1 << 14) -> DataFrame:
    """Cuts segments at label borders and adds `name`: the label over each part, -1 where there's none; of several the one that starts last."""
    other = segments.columns
    marks = labels.select("contig", "start", "end", F.col("label").alias("__l"), F.col("start").alias("__at"))
    pieces = sweep(segments.select("contig", "start", "end").unionByName(marks.select("contig", "start", "end")), tile=TILE)
    pieces = overlap_join(pieces.select("contig", "start", "end"), segments, bucket=bucket, prefix="s_").select("contig", "start", "end", *[F.col(f"s_{c}").alias(c) for c in other if c not in ("contig", "start", "end")])
    pairs = overlap_join(pieces, marks, bucket=bucket, how="left")
    keys = pieces.columns
    return pairs.groupBy(*keys).agg(F.coalesce(F.max_by("r___l", F.struct("r___at", "r___l")), F.lit(-1)).cast("int").alias(name))


def histogram(segments: DataFrame, dense_to: int = 0) -> DataFrame:
    """cov, bases: bases of each depth; with dense_to all depths from 0 to the larger of it and the deepest."""
    found = segments.groupBy("cov").agg(F.sum(F.col("end") - F.col("start")).alias("bases"))
    if not dense_to:
        return found
    top = found.agg(F.greatest(F.lit(dense_to).cast("long"), F.max(F.col("cov").cast("long"))).alias("top"))
    grid = top.select(F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("cov"))
    return grid.join(found.withColumnRenamed("cov", "__c"), F.col("cov") == F.col("__c"), "left").select("cov", F.coalesce("bases", F.lit(0)).alias("bases"))


def annotation_histogram(segments: DataFrame, bits: str = "annot_bits", n_annotations: int = 58) -> DataFrame:
    """annot, cov, bases: a segment counts for each of its annotations (0 without any); depths above 249 as 249. Summed before annotations are spread out."""
    few = segments.groupBy(bits, F.least(F.col("cov"), F.lit(HISTOGRAM)).alias("cov")).agg(F.sum(F.col("end") - F.col("start")).alias("bases"))
    return few.select(F.explode(B.indices(F.col(bits), n_annotations)).alias("annot"), "cov", "bases").groupBy("annot", "cov").agg(F.sum("bases").alias("bases"))


def start_only_histogram(segments: DataFrame, contigs: DataFrame, window: int, bits: str = "annot_bits", n_annotations: int = 58) -> DataFrame:
    """annotation_histogram() of windows of `window` bases: value is starts * window div the window's real length, weight that length."""
    w = tumbling(segments, contigs, window, chunk=None)
    w = w.withColumn("cov", F.expr(f"cov_sum * {window} div n")).select("contig", F.col("start"), F.col("end"), "cov", "annot_bits")
    return annotation_histogram(w, bits, n_annotations)


def modes(hist: DataFrame, by: list[str], min_cov: int = 0) -> DataFrame:
    """mode (depth of at least min_cov with most bases, the smallest of equals; -1 without any), max_count and total of each histogram."""
    okay = F.col("cov") >= min_cov
    best = F.max_by(F.when(okay, F.col("cov")), F.when(okay & (F.col("bases") > 0), F.struct("bases", (-F.col("cov")).alias("c"))))
    return hist.groupBy(*by).agg(F.coalesce(best, F.lit(-1)).cast("int").alias("mode"), F.coalesce(F.max(F.when(okay, F.col("bases"))), F.lit(0)).cast("long").alias("max_count"), F.sum("bases").cast("long").alias("total"))


def bias_table(found: DataFrame, baseline: int, candidates: list[int], threshold: float = 0.15, min_length: int = 100_000) -> DataFrame:
    """annot, mode, max_count, total, deviation, biased, region, region_cov from modes() by annotation.

    deviation: (mode - baseline's mode) / baseline's mode, 0 without a mode; biased beyond the threshold in more than min_length bases. Biased
    candidates get regions 1, 2, ... in order; others are in region 0, whose depth is the baseline's mode. A table of a row for each annotation."""
    base = found.where(F.col("annot") == baseline).agg(F.first("mode").alias("base"))
    rows = found.where(F.col("annot").isin(candidates)).crossJoin(F.broadcast(base))
    rows = rows.withColumn("deviation", F.when(F.col("mode") < 1, 0.0).otherwise((F.col("mode") - F.col("base")) / F.col("base")))
    rows = rows.withColumn("biased", (F.abs("deviation") > threshold) & (F.col("total") > min_length) & (F.col("mode") != -1))
    rank = F.sum(F.col("biased").cast("int")).over(Window.orderBy("annot"))
    return rows.select("annot", "mode", "max_count", "total", "deviation", F.col("biased").cast("int").alias("biased"), F.when(F.col("biased"), rank).otherwise(0).cast("int").alias("region"), F.when(F.col("biased"), F.col("mode")).otherwise(F.col("base")).cast("int").alias("region_cov"))


def average_alignment_length(aln: DataFrame) -> DataFrame:
    return aln.agg(F.round(F.avg(F.col("end") - F.col("start"))).cast("long").alias("avg_len"))


def mode_and_sd(hist: DataFrame, min_cov: int = 5, factor: float = 2.5) -> DataFrame:
    """mode: depth of at least min_cov with most bases; mean and sd over depths under factor * mode."""
    mode = hist.where(F.col("cov") >= min_cov).agg(F.max_by("cov", F.struct("bases", (-F.col("cov")).alias("c"))).alias("mode"))
    rows = hist.crossJoin(F.broadcast(mode)).where(F.col("cov") < factor * F.col("mode"))
    n, s, q = F.sum("bases"), F.sum(F.col("cov") * F.col("bases")), F.sum(F.col("cov") * F.col("cov") * F.col("bases"))
    return rows.groupBy("mode").agg((s / n).alias("mean"), F.sqrt(q / n - (s / n) * (s / n)).alias("sd"))


def collapsed_components(max_cov: Column, min_region_cov: Column) -> Column:
    """How many components the collapsed state needs: deepest depth div shallowest region + 1, held to 2 ... 10."""
    return F.least(F.lit(10), F.greatest(F.lit(2), (F.floor(max_cov / min_region_cov) + 1).cast("int")))


def _pieces(segments: DataFrame, contigs: DataFrame, window: int, chunk: int | None) -> DataFrame:
    """Segments cut into windows, which begin anew at each chunk: columns chunk, win, w_start, w_end and bases."""
    rows = segments.where("start < end").join(contigs.select("contig", "len"), "contig")
    if chunk:
        rows = rows.withColumn("__last", chunk_last(F.col("len"), chunk))
        rows = rows.withColumn("chunk", F.explode(F.sequence(F.least(F.floor(F.col("start") / chunk), "__last"), F.least(F.floor((F.col("end") - 1) / chunk), "__last"))))
        rows = rows.withColumn("__a", F.col("chunk") * chunk).withColumn("__z", F.when(F.col("chunk") == F.col("__last"), F.col("len")).otherwise((F.col("chunk") + 1) * chunk))
    else:
        rows = rows.withColumn("chunk", F.lit(0).cast("long")).withColumn("__a", F.lit(0).cast("long")).withColumn("__z", F.col("len").cast("long"))
    rows = rows.withColumn("__s", F.greatest("start", "__a")).withColumn("__e", F.least("end", "__z"))
    rows = rows.withColumn("win", F.explode(F.sequence(F.floor((F.col("__s") - F.col("__a")) / window), F.floor((F.col("__e") - 1 - F.col("__a")) / window))))
    rows = rows.withColumn("w_start", F.col("__a") + F.col("win") * window).withColumn("w_end", F.least("__z", F.col("__a") + (F.col("win") + 1) * window))
    return rows.withColumn("bases", F.least("__e", "w_end") - F.greatest("__s", "w_start")).drop("__last", "__a", "__z", "__s", "__e", "len")


WINDOW_KEYS = ["contig", "chunk", "win", "w_start", "w_end"]


def tumbling(segments: DataFrame, contigs: DataFrame, window: int, chunk: int | None, start_only: bool = False) -> DataFrame:
    """contig, chunk, win, start, end, n, cov (rounded mean depth, at most 250), cov_mapq, cov_clip, cov_sum, annot_bits, and the window's region, truth and
    pred by weight where segments have them. Whole numbers only, so sums don't depend on order; start_only scales by the nominal window."""
    cols = segments.columns
    p = _pieces(segments, contigs, window, chunk)
    deep = [c for c in ("cov", "cov_mapq", "cov_clip") if c in cols]
    agg = [F.sum("bases").alias("n"), *[F.sum(F.col(c) * F.col("bases")).alias(f"{c}_sum") for c in deep]]
    if "annot_bits" in cols:
        agg.append(F.bit_or("annot_bits").alias("annot_bits"))
    out = p.groupBy(*WINDOW_KEYS).agg(*agg)
    times = window if start_only else 1
    mean = lambda c: F.least(F.lit(WINDOW_CAP), F.expr(f"(2 * {c}_sum * {times} + n) div (2 * n)").cast("int")).alias(c)
    extra = [F.col("annot_bits")] if "annot_bits" in cols else []
    out = out.select("contig", "chunk", "win", F.col("w_start").alias("start"), F.col("w_end").alias("end"), "n", *[mean(c) for c in deep], "cov_sum", *extra)
    for c in ("region", "truth", "pred"):
        if c in cols:
            out = out.join(window_mode(segments.select("contig", "start", "end", c), contigs, window, chunk, c), ["contig", "chunk", "win"])
    return out


def window_mode(segments: DataFrame, contigs: DataFrame, window: int, chunk: int | None, value: str) -> DataFrame:
    """contig, chunk, win and the value that most bases of the window have; the smallest of equals."""
    p = _pieces(segments, contigs, window, chunk).groupBy("contig", "chunk", "win", value).agg(F.sum("bases").alias("__b"))
    return p.groupBy("contig", "chunk", "win").agg(F.max_by(value, F.struct("__b", (-F.col(value)).alias("v"))).alias(value))


def wig_windows(segments: DataFrame, contigs: DataFrame, window: int, cap: int = 250) -> DataFrame:
    """contig, start, end, value: mean depth of fixed windows, held to cap after the mean."""
    w = tumbling(segments, contigs, window, None)
    return w.select("contig", "start", "end", F.least(F.lit(float(cap)), F.col("cov_sum") / F.col("n")).alias("value"))


def effective_windows(blocks: DataFrame, excluded: DataFrame, window: int) -> DataFrame:
    """contig, start, end, part: blocks without the excluded parts, cut into floor(bases / window) parts of `window` bases for each contig, at least
    one; the last takes the rest."""
    from locusmill.operators.intervals import subtract
    from locusmill.operators.running import running

    own = subtract(blocks, excluded)
    total = own.groupBy("contig").agg(F.sum(F.col("end") - F.col("start")).alias("__all"))
    rows = running(tiled(own, F.col("start")), ["contig"], ["start"], {"__off": ("sum", F.col("end") - F.col("start"))}, before=True).join(total, "contig")
    last = F.greatest(F.lit(1), F.floor(F.col("__all") / window)) - 1
    first = F.least(last, F.floor(F.col("__off") / window))
    final = F.least(last, F.floor((F.col("__off") + F.col("end") - F.col("start") - 1) / window))
    rows = rows.withColumn("part", F.explode(F.sequence(first, final))).withColumn("__last", last)
    a = F.col("start") + F.greatest(F.lit(0), F.col("part") * window - F.col("__off"))
    b = F.when(F.col("part") == F.col("__last"), F.col("end")).otherwise(F.least(F.col("end"), F.col("start") + (F.col("part") + 1) * window - F.col("__off")))
    return rows.select("contig", a.alias("start"), b.alias("end"), "part")


def depth_to_segments(depth: DataFrame) -> DataFrame:
    """Per-position depth (contig, pos from 1, depth) as run-length segments; like the text tool it stands for, a gap in positions doesn't end a run
    of equal depth."""
    final = [F.min("pos").alias("pos"), F.max("last").alias("last"), F.first("depth").alias("depth")]
    rows = runs(tiled(depth.withColumn("last", F.col("pos")), F.col("pos")), ["contig"], ["pos"], ["depth"], lambda p: p.isNotNull() & p["depth"].eqNullSafe(F.col("depth")), final, final)
    return rows.select("contig", (F.col("pos") - 1).alias("start"), F.col("last").alias("end"), F.col("depth").alias("cov"))


def component_blocks(segments: DataFrame, table: DataFrame, names: list[str]) -> DataFrame:
    """contig, start, end, component: each segment's depth looked up in a probability table (cov and one column for each name), the likeliest component
    taken (the first of equals, compared as 32-bit floats), and neighbours that touch joined. Depths beyond the table take its last row."""
    best = F.array_max(F.array(*[F.struct(F.col(c).cast("float").alias("p"), F.lit(-k).alias("k")) for k, c in enumerate(names)]))["k"]
    look = table.select(F.col("cov").cast("long").alias("__c"), (-best).alias("component"))
    top = look.agg(F.max("__c").alias("__top"))
    rows = segments.crossJoin(F.broadcast(top)).withColumn("__k", F.least(F.col("cov").cast("long"), F.col("__top")))
    rows = rows.join(look, F.col("__k") == F.col("__c"))
    return collapse(rows.select("contig", "start", "end", "component"), ["component"])
