import pytest
from conftest import rows
from pyspark.sql import functions as F

from locusmill.operators import intervals as I
from locusmill.sources import cov, sinks, text

HEAD = cov.Header(["whole", "x"], [20, 30], 4, True, True)
TEXT = ">ctg1 110\n1\t10\t4\t4\t4\t0\t0\t2\t-1\n11\t15\t6\t0\t0\t1,2\t1\t0\t3\n>ctg2 10\n1\t10\t8\t8\t0\t0\t0\t1\t1\n"
WANT = [("ctg1", 110, 0, 10, 4, 4, 4, "0", 0, 2, -1), ("ctg1", 110, 10, 15, 6, 0, 0, "1,2", 1, 0, 3), ("ctg2", 10, 0, 10, 8, 8, 0, "0", 0, 1, 1)]


def test_cov_both_readers_and_writer(spark, tmp_path):
    p = tmp_path / "a.cov"
    p.write_text("\n".join(HEAD.lines()) + "\n" + TEXT)
    assert cov.header(spark, str(p)) == HEAD
    assert rows(cov.read(spark, str(p))) == WANT and rows(cov.read_text(spark, str(p))) == WANT
    out = str(tmp_path / "out")
    cov.write(cov.read_text(spark, str(p)), HEAD, out, "both")
    lines = [r.value for r in spark.read.text(out).collect()]
    assert sorted(lines) == sorted(HEAD.lines() + TEXT.strip().split("\n"))
    assert rows(cov.read_text(spark, out)) == WANT


def test_header_rules():
    with pytest.raises(ValueError):
        cov.parse_header(["#region:len:1", "#region:coverage:0:5"])
    with pytest.raises(ValueError):
        cov.parse_header(["#annotation:len:0", "#region:len:2", "#region:coverage:0:5"])
    with pytest.raises(ValueError):
        cov.parse_header(["#annotation:len:0", "#region:len:0", "#truth:true"])
    assert cov.parse_header(["#annotation:len:2", "#annotation:name:1:b", "#region:len:0"]).annotations == ["NA", "b"]


def test_bed_and_friends(spark, tmp_path):
    p = tmp_path / "a.bed"
    p.write_text("track name=x\n#c\nctg1\t10\t20\t3\nctg2 5 6\n")
    assert rows(text.bed(spark, str(p))) == [("ctg1", 10, 20), ("ctg2", 5, 6)]
    assert rows(text.label_bed(spark, str(p), True).where("truth >= 0")) == [("ctg1", 10, 20, 3, -1)]
    only = spark.createDataFrame([("ctg2",)], "contig string")
    assert rows(text.bed_of(spark, str(p), only)) == [("ctg2", 5, 6)]
    b = tmp_path / "bins"
    b.write_text("#s e n\n0\t1e9\tALL\n0 10 small\n")
    assert rows(text.size_bins(spark, str(b))) == [("ALL", 0, 10**9), ("small", 0, 10)]
    sinks.bed(text.bed(spark, str(p)), str(tmp_path / "o"))
    assert rows(text.bed(spark, str(tmp_path / "o"))) == [("ctg1", 10, 20), ("ctg2", 5, 6)]


def test_sam_paf_fasta_vcf(spark, tmp_path):
    p = tmp_path / "a.sam"
    p.write_text("@SQ\tSN:ctg1\tLN:100\nr1\t16\tctg1\t11\t60\t3S5M2D4=1I2M2H\t*\t0\t0\tACGT\t*\tcs:Z::5\tMD:Z:5\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tA\t*\n")
    got = rows(text.sam(spark, str(p)), "read", "start", "end", "l_clip", "r_clip", "strand", "unmapped")
    assert got == [("r1", 10, 23, 3, 2, "-", False), ("r2", -1, -1, 0, 0, "+", True)]
    assert rows(text.sam_contigs(spark, str(p))) == [("ctg1", 100)]
    q = tmp_path / "a.paf"
    q.write_text("ctg\t350\t100\t150\t+\tref\t158\t10\t58\t40\t48\t60\ttp:A:P\tNM:i:3\tde:f:0.01\tcg:Z:4=1X\n")
    r = text.paf(spark, str(q)).first()
    assert (r.contig_start, r.chrom_end, r.is_primary, r.nm, r.de, len(r.cigar)) == (100, 58, True, 3, 0.01, 2)
    sinks.paf(text.paf(spark, str(q)), str(tmp_path / "p"))
    assert text.paf(spark, str(tmp_path / "p")).first().chrom_start == 10
    f = tmp_path / "a.fa"
    f.write_text(">s1 desc\nACGTNN\nNNAC\n>s2\nTTTT\n")
    fa = text.fasta(spark, str(f))
    assert rows(fa) == [("s1", "ACGTNNNNAC"), ("s2", "TTTT")]
    assert rows(text.base_intervals(fa)) == [("s1", 4, 8)]
    assert rows(text.base_intervals(fa, "[ACGTacgt]+")) == [("s1", 0, 4), ("s1", 8, 10), ("s2", 0, 4)]
    assert rows(sinks.broken_at_gaps(fa)) == [("s1_0", "ACGT"), ("s1_1", "AC"), ("s2", "TTTT")]
    sinks.fasta(fa, str(tmp_path / "fo"), width=3)
    assert rows(text.fasta(spark, str(tmp_path / "fo"))) == rows(fa)
    v = tmp_path / "a.vcf"
    v.write_text("##x\n#CHROM\nctg1\t5\t.\tA\tC\nctg1\t9\t.\tAT\tC\n")
    assert rows(text.vcf_snps(spark, str(v))) == [("ctg1", 4, "A", "C")]


def test_more_sinks(spark, tmp_path):
    w = spark.createDataFrame([("a", 0, 10, 3, 2.5), ("a", 10, 15, 4, 1.0)], "contig string, start long, end long, cov int, value double")
    sinks.bedgraph(w, "cov", str(tmp_path / "g"), "t")
    assert [r.value for r in spark.read.text(str(tmp_path / "g")).orderBy(F.desc("value")).collect()] == ['track type=bedGraph name="t"', "a 10 15 4", "a 0 10 3"]
    sinks.wig(w, 10, str(tmp_path / "w"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "w")).collect()) == ["1.00", "2.50", "fixedStep chrom=a start=1 step=10 span=10"]
    sinks.table(w, str(tmp_path / "t"), ["start"], {"value": "%.2e"})
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect())[0] == "#contig\tstart\tend\tcov\tvalue"
    sinks.by_contig(w, str(tmp_path / "c"))
    assert I.totals(spark.createDataFrame([], "contig string, start long, end long")).first().length == 0
