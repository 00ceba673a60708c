"""Simulated mis-assemblies: two haplotypes aligned to each other are cut at sampled places and put together wrongly.

A plan is a short list of operations (a few hundred whatever the genome), so sampling runs on the driver with a seed; what grows with the genome,
places to sample from and sequences to write, are DataFrames.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusmill.functions.scalar import reverse_complement
from locusmill.operators.intervals import intersect, subtract, truncate_right

KINDS = ("switch", "misjoin", "collapse", "duplication", "base_error")


def homology_blocks(alignments: DataFrame, contigs: DataFrame) -> DataFrame:
    """contig, start, end, chrom, c_start, c_end, strand: aligned blocks of primary alignments, and the parts of contigs under none with null chrom."""
    a = alignments.where("is_primary").select("contig", F.col("contig_start").alias("start"), F.col("contig_end").alias("end"), "chrom", F.col("chrom_start").alias("c_start"), F.col("chrom_end").alias("c_end"), "strand")
    whole = contigs.select("contig", F.lit(0).cast("long").alias("start"), F.col("len").cast("long").alias("end"))
    return a.unionByName(subtract(whole, a.select("contig", "start", "end")), allowMissingColumns=True)


def sampling_places(blocks: DataFrame, length: int, min_overlap: float = 1.0, allowed: DataFrame | None = None) -> DataFrame:
    """contig, start, end of where an event of `length` may begin: blocks shortened at their right end by the part of it that must lie inside, within
    the allowed places."""
    out = truncate_right(blocks.where("chrom IS NOT NULL").select("contig", "start", "end"), int(length * min_overlap))
    return out if allowed is None else intersect(out, allowed)


def feasible_number(places: DataFrame, length: int) -> int:
    """How many events of `length` fit at least: one for each of its lengths in each place."""
    return int(places.agg(F.coalesce(F.sum(F.floor((F.col("end") - F.col("start")) / length) + 1), F.lit(0)).alias("n")).first().n)


def sample(places: DataFrame, number: int, length: int, seed: int = 0, tries: int = 10) -> list[tuple[str, int, int]]:
    """Up to `number` events (contig, start, end), uniform over the places' bases and apart from each other; each is tried `tries` times.

    Only totals by contig come to the driver; the place that a sampled base falls on is looked up by a join."""
    from locusmill.operators.running import running, tiled

    rng, taken = np.random.default_rng(seed), []
    total = {r.contig: r.n for r in places.groupBy("contig").agg(F.sum(F.col("end") - F.col("start")).alias("n")).collect()}
    names = sorted(total)
    if not names or not sum(total.values()):
        return []
    laid = running(tiled(places.select("contig", "start", "end"), F.col("start")), ["contig"], ["start"], {"off": ("sum", F.col("end") - F.col("start"))}, before=True)
    weights = np.array([total[x] for x in names], float)
    draws = [(k, names[c], int(rng.integers(total[names[c]]))) for k, c in enumerate(rng.choice(len(names), number * tries, p=weights / weights.sum()))]
    asked = places.sparkSession.createDataFrame(draws, "k int, contig string, at long")
    found = asked.join(laid, "contig").where((F.col("at") >= F.col("off")) & (F.col("at") < F.col("off") + F.col("end") - F.col("start")))
    for _, contig, start in sorted((r.k, r.contig, r.start + r["at"] - r.off) for r in found.select("k", "contig", "start", "at", "off").collect()):
        if len(taken) == number:
            break
        if all(c != contig or start + length <= s or e <= start for c, s, e in taken):
            taken.append((contig, start, start + length))
    return taken


def pieces(contigs: list[tuple[str, int]], events: list[tuple[str, int, int]], kind: str, partner: dict[tuple[str, int, int], tuple[str, int, int, str]] | None = None) -> list[tuple[str, int, str, int, int, str, str]]:
    """(new contig, order, contig, start, end, strand, label): how the new contigs are made of the old ones.

    switch: an event's bases come from its partner on the other haplotype; collapse: they are left out; duplication: they come twice; misjoin: a contig's
    parts behind an event of two contigs are exchanged; base_error: they are labelled for single-base errors."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    by: dict[str, list] = {}
    for e in sorted(events):
        by.setdefault(e[0], []).append(e)
    out = []
    if kind == "misjoin":
        length = dict(contigs)
        cut = {c: e[0][1] for c, e in by.items()}
        order = sorted(cut)
        other = {a: b for a, b in zip(order[::2], order[1::2])} | {b: a for a, b in zip(order[::2], order[1::2])}
        for c, n in contigs:
            if c in other:
                o = other[c]
                out += [(f"{c}_mis", 0, c, 0, cut[c], "+", "Hap"), (f"{c}_mis", 1, o, cut[o], length[o], "+", "Msj")]
            else:
                out.append((c, 0, c, 0, n, "+", "Hap"))
        return [p for p in out if p[3] < p[4]]
    for c, n in contigs:
        at, k, mine = 0, 0, []

        def put(contig, s, e, strand, label):
            nonlocal k
            if s < e:
                mine.append((f"{c}_mis" if by.get(c) else c, k, contig, s, e, strand, label))
                k += 1

        for _, s, e in by.get(c, []):
            put(c, at, s, "+", "Hap")
            if kind == "switch":
                put(*(partner or {})[(c, s, e)], "Switch")
            elif kind == "duplication":
                put(c, s, e, "+", "Dup")
                put(c, s, e, "+", "Dup")
            elif kind == "base_error":
                put(c, s, e, "+", "Err")
            at = e
        put(c, at, n, "+", "Hap")
        out += mine
    return out


def emitted(plan: DataFrame, sequences: DataFrame, error_rate: float = 0.0, seed: int = 0) -> DataFrame:
    """name, seq of the new contigs. plan has the columns of pieces(): name, k, contig, start, end, strand, label; pieces labelled Err get single-base
    substitutions at error_rate, chosen by a hash of the place."""
    rows = plan.join(sequences.withColumnRenamed("name", "contig"), "contig")
    s = F.expr("substring(seq, CAST(start AS INT) + 1, CAST(end - start AS INT))")
    s = F.when(F.col("strand") == "-", reverse_complement(s)).otherwise(s)
    if error_rate > 0:
        turn = lambda ch: F.translate(ch, "ACGTacgt", "CGTAcgta")
        hit = lambda i: F.pmod(F.xxhash64("contig", F.col("start") + i, F.lit(seed)), F.lit(1_000_000)) < int(error_rate * 1_000_000)
        wrong = F.array_join(F.transform(F.split(s, ""), lambda ch, i: F.when(hit(i), turn(ch)).otherwise(ch)), "")
        s = F.when(F.col("label") == "Err", wrong).otherwise(s)
    rows = rows.select("name", F.struct("k", s.alias("s")).alias("p"))
    return rows.groupBy("name").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["s"]), "").alias("seq"))


def new_coordinates(plan: DataFrame) -> DataFrame:
    """name, start, end, label, contig, from_start, from_end: where each piece lies on the new contig."""
    from pyspark.sql import Window

    w = Window.partitionBy("name").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("end") - F.col("start")
    rows = plan.withColumn("__at", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long"))
    return rows.select("name", F.col("__at").alias("at"), (F.col("__at") + size).alias("to"), "label", "contig", F.col("start").alias("from_start"), F.col("end").alias("from_end")).withColumnRenamed("at", "start").withColumnRenamed("to", "end")
