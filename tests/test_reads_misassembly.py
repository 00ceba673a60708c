from conftest import rows

from locusmill.functions import cigar as G
from locusmill.operators import misassembly as Z
from locusmill.operators import reads as R
from pyspark.sql import functions as F


def test_phasing(spark):
    aln = spark.createDataFrame([("r", 1, True), ("r", 2, False)], "read string, aln int, is_primary boolean")
    steps = spark.createDataFrame([("r", 1, "X", 2, 4, [40] * 10), ("r", 1, "X", 7, 8, [40] * 10), ("r", 2, "X", 7, 8, [40] * 10), ("r", 2, "X", 5, 6, [5] * 10)], "read string, aln int, op string, read_start long, read_end long, quals array<int>")
    m = R.confident_positions(R.mismatch_markers(steps, 10), 20)
    assert rows(m) == [("r", 1, 2, 40), ("r", 1, 3, 40), ("r", 1, 7, 40), ("r", 2, 7, 40)]
    gaps = spark.createDataFrame([("r", 3, 4)], "read string, start long, end long")
    m = R.usable_markers(m, aln, gaps)
    assert rows(m, "aln", "read_pos") == [(1, 2)]
    full = R.with_matches(m, aln)
    assert rows(full, "aln", "is_match") == [(1, False), (2, True)]
    best = R.best_alignment(R.consistency_scores(full), aln, margin=1.0, min_score=-50.0)
    assert rows(best) == [("r", 2)]
    flags = spark.createDataFrame([("r", 1, 0), ("r", 2, 256), ("s", 3, 16)], "read string, aln int, flag int")
    assert rows(R.swapped_primary(flags, best)) == [("r", 1, 256), ("r", 2, 0), ("s", 3, 16)]


def test_filters(spark):
    a = spark.createDataFrame([("r", "c#1", 0, 100, 5, 0, 0.01), ("s", "c#2", 0, 50, 9, 256, None), ("t", "c", 0, 500, 9, 0, 0.5)], "read string, contig string, start long, end long, mapq int, flag int, de double")
    q = spark.createDataFrame([("r", "c#1", 0, 60)], "read string, contig string, start long, mapq int")
    out = R.corrected(a, q, spark.createDataFrame([("x",)], "read string"), min_length=60, max_divergence=0.1, primary_only=True)
    assert rows(out, "read", "mapq") == [("r", 60)]
    assert rows(R.by_reference_name(a), "read", "haplotype") == [("r", 1), ("s", 2), ("t", 0)]
    snps = spark.createDataFrame([("c", 5), ("c", 8), ("c", 5000)], "contig string, pos long")
    st = spark.createDataFrame([("r", "c", "X", 5, 6, 30), ("r", "c", "=", 6, 20, 30), ("s", "c", "=", 0, 20, 30), ("s", "c", "X", 5000, 5001, 2)], "read string, contig string, op string, ref_start long, ref_end long, q int")
    assert rows(R.alternate_reads(st, snps)) == [("r",)]


def test_misassemblies(spark):
    seqs = spark.createDataFrame([("a", "AAAACCCCGGGGTTTT"), ("b", "ACGTACGTACGTACGT")], "name string, seq string")
    cols = "name string, k int, contig string, start long, end long, strand string, label string"
    lens = [("a", 16), ("b", 16)]
    make = lambda kind, ev, p=None: spark.createDataFrame(Z.pieces(lens, ev, kind, p), cols)
    got = dict(rows(Z.emitted(make("collapse", [("a", 4, 8)]), seqs)))
    assert got == {"a_mis": "AAAAGGGGTTTT", "b": "ACGTACGTACGTACGT"}
    assert dict(rows(Z.emitted(make("duplication", [("a", 4, 8)]), seqs)))["a_mis"] == "AAAACCCCCCCCGGGGTTTT"
    assert dict(rows(Z.emitted(make("switch", [("a", 4, 8)], {("a", 4, 8): ("b", 1, 4, "-")}), seqs)))["a_mis"] == "AAAAACGGGGGTTTT"
    assert dict(rows(Z.emitted(make("misjoin", [("a", 4, 8), ("b", 2, 3)]), seqs))) == {"a_mis": "AAAAGTACGTACGTACGT", "b_mis": "ACCCCCGGGGTTTT"}
    err = dict(rows(Z.emitted(make("base_error", [("a", 4, 8)]), seqs, error_rate=1.0)))["a_mis"]
    assert err == "AAAAGGGGGGGGTTTT"
    assert rows(Z.new_coordinates(make("duplication", [("a", 4, 8)])).where("label = 'Dup'"), "name", "start", "end") == [("a_mis", 4, 8), ("a_mis", 8, 12)]
    aln = spark.createDataFrame([("a", 2, 14, "b", 0, 12, "+", True)], "contig string, contig_start long, contig_end long, chrom string, chrom_start long, chrom_end long, strand string, is_primary boolean")
    c = spark.createDataFrame(lens, "contig string, len long")
    h = Z.homology_blocks(aln, c)
    assert rows(h.where("chrom IS NULL"), "contig", "start", "end") == [("a", 0, 2), ("a", 14, 16), ("b", 0, 16)]
    places = Z.sampling_places(h, 4)
    assert rows(places) == [("a", 2, 10)] and Z.feasible_number(places, 4) == 3
    ev = Z.sample(places, 2, 4, seed=1)
    assert len(ev) == 2 and abs(ev[0][1] - ev[1][1]) >= 4 and all(2 <= s < 10 for _, s, _ in ev)
    assert ev == Z.sample(places, 2, 4, seed=1) and Z.sample(places.where("false"), 2, 4) == []


def test_split_at_gaps(spark):
    a = spark.createDataFrame([(1, "c", 0, 30, "+", "r", 0, 40, "3S10=8I5=15D7=")], "aln long, contig string, contig_start long, contig_end long, strand string, chrom string, chrom_start long, chrom_end long, x string").withColumn("cigar", G.parse(F.col("x")))
    got = rows(G.split_at_gaps(G.walk(a, ["aln"]), ["aln"], 5), "chrom_start", "chrom_end", "contig_start", "contig_end", "cigar")
    assert got == [(0, 10, 0, 10, "10="), (10, 15, 18, 23, "5="), (30, 37, 23, 30, "7=")]
