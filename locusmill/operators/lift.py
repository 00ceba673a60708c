"""Carrying intervals over from one assembly to another along alignments, in joins and sums only.

An alignment is cut into its operations (functions.cigar.walk). A block meets the aligned operations (=, X, M) it overlaps; the first and last
aligned base are its projection's ends, so insertions and deletions at a block's ends are left out and those inside count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusmill.functions import cigar as G
from locusmill.operators.intervals import covered_times, merge, overlap_join, relation, subtract, sweep

ALIGNED = ("=", "X", "M")


def primary(alignments: DataFrame, min_length: int = 0, max_divergence: float = 1.0) -> DataFrame:
    out = alignments.where("is_primary").where(F.col("chrom_end") - F.col("chrom_start") > min_length)
    return out.where(F.col("de") < max_divergence) if "de" in alignments.columns and max_divergence < 1 else out


def steps_of(alignments: DataFrame) -> DataFrame:
    """aln, contig, chrom, strand and the operations of walk()."""
    names = alignments.select("aln", "contig", "chrom", "strand")
    return G.walk(alignments, ["aln"]).join(names, "aln")


def project(blocks: DataFrame, alignments: DataFrame, to: str = "ref", bucket: int = 1 << 14) -> DataFrame:
    """Blocks (contig, start, end, ...) on the assembly (to="ref") or on the reference (to="asm") as carried over by each alignment they overlap.

    Adds aln, strand, from_start, from_end (the part that could be carried over), to_contig, to_start, to_end, and divergence: percent of differing
    bases (X, and I and D inside) of the projection's length. A block without an aligned base gives no row. Rows repeated in blocks count once."""
    steps = steps_of(alignments).where(F.col("op").isin(*ALIGNED))
    if to == "ref":
        steps = steps.select("aln", "strand", "op", F.col("chrom").alias("to_contig"), "contig", F.col("ctg_start").alias("start"), F.col("ctg_end").alias("end"), F.col("ref_start").alias("t_start"))
    else:
        steps = steps.select("aln", "strand", "op", F.col("contig").alias("to_contig"), F.col("chrom").alias("contig"), F.col("ref_start").alias("start"), F.col("ref_end").alias("end"), F.col("ctg_start").alias("t_start"))
    pairs = overlap_join(blocks, steps, bucket)
    s, e = F.greatest("start", "r_start"), F.least("end", "r_end")
    t = F.col("r_t_start") + F.when(F.col("r_strand") == "-", F.col("r_end") - e).otherwise(s - F.col("r_start"))
    pairs = pairs.select(*blocks.columns, F.col("r_aln").alias("aln"), F.col("r_strand").alias("strand"), F.col("r_to_contig").alias("to_contig"), F.col("r_op").alias("__op"), s.alias("__s"), e.alias("__e"), t.alias("__t"))
    out = pairs.groupBy(*blocks.columns, "aln", "strand", "to_contig").agg(
        F.min("__s").alias("from_start"), F.max("__e").alias("from_end"), F.min("__t").alias("to_start"), F.max(F.col("__t") + F.col("__e") - F.col("__s")).alias("to_end"),
        F.sum(F.col("__e") - F.col("__s")).alias("__n"), F.sum(F.when(F.col("__op") == "X", F.col("__e") - F.col("__s")).otherwise(0)).alias("__x"),
    )
    span, other = F.col("to_end") - F.col("to_start"), F.col("from_end") - F.col("from_start")
    return out.withColumn("divergence", 100.0 * (F.col("__x") + span - F.col("__n") + other - F.col("__n")) / span).drop("__n", "__x")


def sub_cigars(projections: DataFrame, alignments: DataFrame) -> DataFrame:
    """projections to the reference with the CIGAR of each one's part of its alignment."""
    steps = G.walk(alignments, ["aln"]).select("aln", "pos", "op", "len", "ref_start", "ref_end", "ctg_start", "ctg_end")
    keys = projections.columns
    rows = projections.join(steps, "aln")
    inside = F.when(F.col("op") == "I", (F.col("ctg_start") >= F.col("from_start")) & (F.col("ctg_end") <= F.col("from_end"))).when(F.col("op").isin("D", "N"), (F.col("ref_start") >= F.col("to_start")) & (F.col("ref_end") <= F.col("to_end"))).otherwise((F.col("ref_start") < F.col("to_end")) & (F.col("to_start") < F.col("ref_end")))
    size = F.when(F.col("op").isin("I", "D", "N"), F.col("len")).otherwise(F.least("ref_end", "to_end") - F.greatest("ref_start", "to_start"))
    ops = F.transform(F.sort_array(F.collect_list(F.struct("pos", "op", size.alias("n")))), lambda x: F.struct(x["op"].alias("op"), x["n"].alias("len")))
    return rows.where(inside & ~F.col("op").isin("S", "H", "P")).groupBy(*keys).agg(G.render(ops).alias("cigar"))


def subset_alignments(alignments: DataFrame, ref_blocks: DataFrame) -> DataFrame:
    """Alignments cut to reference blocks: aln, contig, contig_start, contig_end, strand, chrom, chrom_start, chrom_end, mapq 60 and the part's CIGAR."""
    p = project(ref_blocks.select("contig", "start", "end"), alignments, to="asm")
    p = p.select("aln", "strand", F.col("to_contig").alias("q"), F.col("to_start").alias("from_start"), F.col("to_end").alias("from_end"), F.col("contig").alias("chrom"), F.col("from_start").alias("to_start"), F.col("from_end").alias("to_end"))
    out = sub_cigars(p, alignments)
    return out.select("aln", F.col("q").alias("contig"), F.col("from_start").alias("contig_start"), F.col("from_end").alias("contig_end"), "strand", "chrom", F.col("to_start").alias("chrom_start"), F.col("to_end").alias("chrom_end"), F.lit(60).alias("mapq"), "cigar")


def covered_by_chrom(alignments: DataFrame, threshold: int, join: bool = False) -> DataFrame:
    """contig, start, end of the reference under alignments, without parts beyond indels longer than threshold; joined if asked for."""
    parts = G.covered_reference(G.walk(alignments, ["aln"]), ["aln"], threshold).join(alignments.select("aln", F.col("chrom").alias("contig")), "aln").select("contig", "start", "end")
    return merge(parts).select("contig", "start", "end") if join else parts


def single_alignment_blocks(alignments: DataFrame, on: str = "ref") -> DataFrame:
    """Parts under exactly one alignment."""
    a, b, c = ("chrom", "chrom_start", "chrom_end") if on == "ref" else ("contig", "contig_start", "contig_end")
    return covered_times(alignments.select(F.col(a).alias("contig"), F.col(b).alias("start"), F.col(c).alias("end")))


def _whole(lengths: DataFrame) -> DataFrame:
    return lengths.select("contig", F.lit(0).cast("long").alias("start"), F.col("len").cast("long").alias("end"))


def collapsed_candidates(alignments: DataFrame, ref_lengths: DataFrame, min_deletion: int) -> DataFrame:
    """Reference parts that the assembly lacks: in long deletions or under no alignment, joined."""
    gone = G.long_indels(steps_of(alignments), "D", min_deletion).select(F.col("chrom").alias("contig"), F.col("ref_start").alias("start"), F.col("ref_end").alias("end"))
    bare = subtract(_whole(ref_lengths), alignments.select(F.col("chrom").alias("contig"), F.col("chrom_start").alias("start"), F.col("chrom_end").alias("end")))
    return merge(gone.unionByName(bare)).select("contig", "start", "end")


def matched_candidates(first: DataFrame, second: DataFrame) -> DataFrame:
    """Pairs of candidates of two haplotypes on one reference, with how they relate."""
    return relation(first.select("contig", "start", "end"), second.select("contig", "start", "end"))


def duplicated_candidates(alignments: DataFrame, contig_lengths: DataFrame, min_insertion: int) -> DataFrame:
    """Assembly parts that may be there twice: in long insertions, under no alignment, or where an alignment overlaps the one before it on the
    reference (by order of reference start), as carried over to both contigs."""
    from locusmill.operators.running import neighbour, tiled

    long = G.long_indels(steps_of(alignments), "I", min_insertion).select("contig", F.col("ctg_start").alias("start"), F.col("ctg_end").alias("end"))
    bare = subtract(_whole(contig_lengths), alignments.select("contig", F.col("contig_start").alias("start"), F.col("contig_end").alias("end")))
    a = tiled(alignments.select("aln", "chrom", "chrom_start", "chrom_end"), F.col("chrom_start"))
    a = neighbour(a, ["chrom"], ["chrom_start", "aln"], ["aln", "chrom_end"], "__p").where(F.col("__p.chrom_end") > F.col("chrom_start"))
    shared = a.select(F.col("chrom").alias("contig"), F.col("chrom_start").alias("start"), F.least(F.col("__p.chrom_end"), F.col("chrom_end")).alias("end"), F.col("aln").alias("a1"), F.col("__p.aln").alias("a2"))
    over = project(shared, alignments, to="asm").where((F.col("aln") == F.col("a1")) | (F.col("aln") == F.col("a2")))
    twice = over.select(F.col("to_contig").alias("contig"), F.col("to_start").alias("start"), F.col("to_end").alias("end"))
    return merge(long.unionByName(bare).unionByName(twice)).select("contig", "start", "end")


def conservative_labels(labels: DataFrame, others: DataFrame) -> DataFrame:
    """contig, start, end, label: labels (0 Err, 1 Dup, 2 Hap, 3 Col) kept only where what maps to the same place bears them out.

    others: contig, start, end, label, way: labels of other contigs as carried over to this one (way: which direction). On each part: with three
    mappings or more Hap; Dup stays if a Dup maps there; Col stays if an Err maps there or one direction has no mapping; Err stays; else Hap."""
    cut = sweep(labels.select("contig", "start", "end").unionByName(others.select("contig", "start", "end"))).select("contig", "start", "end")
    own = overlap_join(cut, labels.select("contig", "start", "end", "label")).select("contig", "start", "end", F.col("r_label").alias("label"))
    met = overlap_join(own, others.select("contig", "start", "end", F.col("label").alias("other"), "way"), how="left")
    rows = met.groupBy("contig", "start", "end", "label").agg(F.count("r_other").alias("n"), F.count_if(F.col("r_other") == 1).alias("dup"), F.count_if(F.col("r_other") == 0).alias("err"), F.countDistinct("r_way").alias("ways"))
    kept = F.when(F.col("label") == 0, 0).when(F.col("n") >= 3, 2).when((F.col("label") == 1) & (F.col("dup") > 0), 1).when((F.col("label") == 3) & ((F.col("err") > 0) | (F.col("ways") < 2)), 3).otherwise(2)
    from locusmill.operators.intervals import collapse

    return collapse(rows.select("contig", "start", "end", kept.alias("label")), ["label"])


def homozygous(alignments: DataFrame, least: int, flank: int = 0) -> DataFrame:
    """aln, chrom, ref_start, ref_end, contig, ctg_start, ctg_end: matching stretches (=) of at least `least` bases, shortened by flank at both ends."""
    s = steps_of(alignments).where((F.col("op") == "=") & (F.col("len") >= least) & (F.col("len") > 2 * flank))
    return s.select("aln", "chrom", (F.col("ref_start") + flank).alias("ref_start"), (F.col("ref_end") - flank).alias("ref_end"), "contig", (F.col("ctg_start") + flank).alias("ctg_start"), (F.col("ctg_end") - flank).alias("ctg_end"))


