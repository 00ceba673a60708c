"""Operators on read alignments: phasing by markers, filters and rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusmill.functions import cigar as G
from locusmill.functions.scalar import marker_score


def mismatch_markers(steps: DataFrame, min_q: int) -> DataFrame:
    """read, aln, read_pos, q: mismatched bases of each alignment whose base quality is at least min_q. steps: read, aln, op, read_start, read_end,
    quals (array, from the read's first base)."""
    rows = steps.where("op = 'X'").select("read", "aln", F.explode(F.sequence(F.col("read_start"), F.col("read_end") - 1)).alias("read_pos"), "quals")
    return rows.select("read", "aln", "read_pos", F.element_at("quals", (F.col("read_pos") + 1).cast("int")).alias("q")).where(F.col("q") >= min_q)


def confident_positions(markers: DataFrame, min_q: int) -> DataFrame:
    """Markers of read positions whose lowest quality over alignments is above min_q; q becomes that lowest one."""
    low = markers.groupBy("read", "read_pos").agg(F.min("q").alias("low")).where(F.col("low") > min_q)
    return markers.join(low, ["read", "read_pos"]).select("read", "aln", "read_pos", F.col("low").alias("q"))


def usable_markers(markers: DataFrame, alignments: DataFrame, unaligned: DataFrame) -> DataFrame:
    """Markers at positions that no alignment of the read has in an insertion or clip (unaligned: read, start, end) and that don't mismatch in all of
    the read's alignments (read, aln)."""
    many = alignments.groupBy("read").agg(F.countDistinct("aln").alias("n"))
    seen = markers.groupBy("read", "read_pos").agg(F.countDistinct("aln").alias("k")).join(many, "read").where("k < n").select("read", "read_pos")
    gaps = unaligned.select("read", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("read_pos")).distinct()
    return markers.join(seen, ["read", "read_pos"], "left_semi").join(gaps, ["read", "read_pos"], "left_anti")


def with_matches(markers: DataFrame, alignments: DataFrame) -> DataFrame:
    """A row for each marker position and each alignment of its read, is_match where the alignment has no mismatch there."""
    grid = markers.groupBy("read", "read_pos").agg(F.first("q").alias("q")).join(alignments.select("read", "aln").distinct(), "read")
    seen = markers.select("read", "read_pos", "aln").distinct().withColumn("hit", F.lit(True))
    return grid.join(seen, ["read", "read_pos", "aln"], "left").select("read", "aln", "read_pos", "q", F.col("hit").isNull().alias("is_match"))


def consistency_scores(markers: DataFrame) -> DataFrame:
    """read, aln, score of with_matches()."""
    return markers.groupBy("read", "aln").agg(F.sum(marker_score(F.col("is_match"), F.col("q"))).alias("score"))


def best_alignment(scores: DataFrame, alignments: DataFrame, margin: float, min_score: float) -> DataFrame:
    """read, best: the alignment with the best score if it beats the primary's by more than margin and reaches min_score, else the primary one; of
    equals the smallest aln (where the original draws lots). alignments: read, aln, is_primary."""
    top = scores.groupBy("read").agg(F.max_by("aln", F.struct("score", (-F.col("aln")).alias("a"))).alias("best"), F.max("score").alias("top"))
    main = alignments.where("is_primary").select("read", F.col("aln").alias("main")).join(scores.select("read", F.col("aln").alias("main"), "score"), ["read", "main"], "left")
    better = (F.col("top") > F.coalesce("score", F.lit(float("-inf"))) + margin) & (F.col("top") >= min_score)
    return main.join(top, "read", "left").select("read", F.when(F.coalesce(better, F.lit(False)), F.col("best")).otherwise(F.col("main")).alias("best"))


def swapped_primary(alignments: DataFrame, best: DataFrame) -> DataFrame:
    """alignments with flags turned so that each read's best one is primary (bit 256 off) and the other formerly primary one secondary."""
    rows = alignments.join(best, "read", "left")
    changed = F.col("best").isNotNull() & (F.col("flag").bitwiseAND(F.lit(2048)) == 0)
    flag = F.when(changed & (F.col("aln") == F.col("best")), F.col("flag").bitwiseAND(F.lit(~256))).when(changed, F.col("flag").bitwiseOR(F.lit(256))).otherwise(F.col("flag"))
    return rows.withColumn("flag", flag.cast("int")).select(*alignments.columns)


def corrected(alignments: DataFrame, mapq: DataFrame | None = None, exclude: DataFrame | None = None, min_length: int = 0, max_divergence: float = 1.0, primary_only: bool = False) -> DataFrame:
    """Rows that aren't excluded and are long and close enough, with mapq from the table (read, contig, start, mapq) where it has one."""
    out = alignments
    if exclude is not None:
        out = out.join(exclude.select("read").distinct(), "read", "left_anti")
    out = out.where((F.col("end") - F.col("start") >= min_length) & (F.coalesce("de", F.lit(0.0)) <= max_divergence))
    if primary_only:
        out = out.where(F.col("flag").bitwiseAND(F.lit(256)) == 0)
    if mapq is None:
        return out
    new = mapq.select("read", "contig", "start", F.col("mapq").alias("__m")).dropDuplicates(["read", "contig", "start"])
    return out.join(new, ["read", "contig", "start"], "left").withColumn("mapq", F.coalesce("__m", "mapq")).select(*alignments.columns)


def raised_mapq(alignments: DataFrame, least: int) -> DataFrame:
    return alignments.withColumn("mapq", F.greatest("mapq", F.lit(least)))


def alternate_reads(steps: DataFrame, snps: DataFrame, min_ratio: float = 0.3, min_q: int = 10, margin: int = 1000) -> DataFrame:
    """Reads that carry another haplotype: in some cluster of SNPs (at most `margin` apart) at least min_ratio of those the read covers mismatch with
    enough base quality. steps: read, contig, op, ref_start, ref_end, q; snps: contig, pos."""
    from locusmill.operators.intervals import overlap_join
    from locusmill.operators.running import numbered, tiled

    far = lambda p: ~F.coalesce(F.col("pos") - p["pos"] <= margin, F.lit(False))
    s = numbered(tiled(snps.select("contig", "pos").distinct(), F.col("pos")), ["contig"], ["pos"], ["pos"], {"cluster": far})
    s = s.select("contig", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "cluster")
    a = steps.where(F.col("op").isin("=", "X", "M")).select("read", "contig", "op", "q", F.col("ref_start").alias("start"), F.col("ref_end").alias("end"))
    hits = overlap_join(a, s).groupBy("read", "contig", "r_cluster").agg((F.count_if((F.col("op") == "X") & (F.col("q") >= min_q)) / F.count(F.lit(1))).alias("ratio"))
    return hits.where(F.col("ratio") >= min_ratio).select("read").distinct()


def by_reference_name(alignments: DataFrame, first: str = "#1", second: str = "#2") -> DataFrame:
    """Adds haplotype: 1 or 2 by the pattern in the contig's name, else 0."""
    return alignments.withColumn("haplotype", F.when(F.col("contig").contains(first), 1).when(F.col("contig").contains(second), 2).otherwise(0))


def split_at_blocks(alignments: DataFrame, blocks: DataFrame) -> DataFrame:
    """Parts of alignments (paf columns) inside blocks of the reference, with coordinates and CIGARs of their own."""
    from locusmill.operators.lift import subset_alignments

    return subset_alignments(alignments, blocks)


def edit_steps(alignments: DataFrame) -> DataFrame:
    """aln and total edits (X, I, D) with reference length: what an alignment's divergence is made of."""
    return alignments.select("aln", G.total(F.col("cigar"), "XID").alias("edits"), G.total(F.col("cigar"), G.REF_OPS).alias("ref_len"))


