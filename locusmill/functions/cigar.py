"""CIGAR strings as arrays of (op, len), and coordinates along them, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What each operation uses up.
READ_OPS = "MIS=X"
REF_OPS = "MDN=X"
CONTIG_OPS = "MIX="


def _in(op: Column, ops: str) -> Column:
    return op.isin(*ops)


def parse(cigar: Column) -> Column:
    """array<struct<op, len>> of a CIGAR string; `*` and null give an empty array."""
    ops = F.regexp_extract_all(cigar, F.lit(r"\d+([MIDNSHP=X])"), F.lit(1))
    lens = F.regexp_extract_all(cigar, F.lit(r"(\d+)[MIDNSHP=X]"), F.lit(1))
    return F.coalesce(F.zip_with(ops, lens, lambda o, n: F.struct(o.alias("op"), n.cast("long").alias("len"))), F.expr("CAST(array() AS array<struct<op:string,len:bigint>>)"))


def render(cigar: Column) -> Column:
    """The string of an array of operations."""
    return F.array_join(F.transform(cigar, lambda c: F.concat(c["len"].cast("string"), c["op"])), "")


def total(cigar: Column, ops: str) -> Column:
    """Sum of the lengths of operations in ops."""
    return F.aggregate(cigar, F.lit(0).cast("long"), lambda a, c: a + F.when(_in(c["op"], ops), c["len"]).otherwise(F.lit(0)))


def query_bases(cigar: Column) -> Column:
    return total(cigar, CONTIG_OPS)


def matches(cigar: Column) -> Column:
    return total(cigar, "=")


def perfect_rate(cigar: Column) -> Column:
    """Bases that match over reference length + 1."""
    return total(cigar, "=") / (total(cigar, "M=XD") + 1)


def without_clips(cigar: Column) -> Column:
    return F.filter(cigar, lambda c: ~_in(c["op"], "SH"))


def left_clip(cigar: Column, ops: str = "SH") -> Column:
    """Bases of clips before the first other operation."""
    first = F.array_position(F.transform(cigar, lambda c: ~_in(c["op"], "SH")), True)
    return total(F.slice(cigar, 1, F.when(first == 0, F.size(cigar)).otherwise((first - 1).cast("int"))), ops)


def right_clip(cigar: Column, ops: str = "SH") -> Column:
    return left_clip(F.reverse(cigar), ops)


def ref_end(start: Column, cigar: Column) -> Column:
    """End (half-open) on the reference of an alignment that starts there."""
    return start + total(cigar, REF_OPS)


def swap_indels(cigar: Column) -> Column:
    return F.transform(cigar, lambda c: F.struct(F.when(c["op"] == "I", "D").when(c["op"] == "D", "I").otherwise(c["op"]).alias("op"), c["len"].alias("len")))


def query_to_contig(position: Column, length: Column, strand: Column, left_hard: Column, right_hard: Column) -> Column:
    """Position on the whole contig of a position in an alignment's query, whose hard clips are left out of it."""
    return F.when(strand == "-", length - 1 - position + right_hard).otherwise(position + left_hard)


def walk(alignments: DataFrame, keys: list[str], cigar: str = "cigar", chrom_start: str = "chrom_start", contig_start: str = "contig_start", contig_end: str = "contig_end", strand: str = "strand") -> DataFrame:
    """keys, pos, op, len, ref_start, ref_end, ctg_start, ctg_end: each operation with the half-open intervals it spans on reference and contig.

    On the minus strand contig intervals run downwards from contig_end. Running sums are over one alignment's operations."""
    rows = alignments.select(*keys, chrom_start, contig_start, contig_end, strand, F.posexplode(cigar).alias("pos", "c"))
    before = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    used = lambda ops: F.when(_in(F.col("c.op"), ops), F.col("c.len")).otherwise(0)
    zero = F.lit(0)
    rows = rows.withColumn("__r", F.coalesce(F.sum(used(REF_OPS)).over(before), zero)).withColumn("__q", F.coalesce(F.sum(used(CONTIG_OPS)).over(before), zero))
    a = F.col(contig_start) + F.col("__q")
    b = F.col(contig_end) - F.col("__q")
    minus = F.col(strand) == "-"
    return rows.select(
        *keys, "pos", F.col("c.op").alias("op"), F.col("c.len").alias("len"),
        (F.col(chrom_start) + F.col("__r")).alias("ref_start"), (F.col(chrom_start) + F.col("__r") + used(REF_OPS)).alias("ref_end"),
        F.when(minus, b - used(CONTIG_OPS)).otherwise(a).alias("ctg_start"), F.when(minus, b).otherwise(a + used(CONTIG_OPS)).alias("ctg_end"),
    )


def parse_cs(cs: Column) -> Column:
    """array<struct<op, len>> of a cs string: = for :n, X for *xy (length 1), I for +seq, D for -seq."""
    parts = F.regexp_extract_all(cs, F.lit(r"(:\d+|\*[a-z]{2}|[+-][a-zA-Z]+)"), F.lit(1))
    kind = lambda p: F.element_at(F.create_map(F.lit(":"), F.lit("="), F.lit("*"), F.lit("X"), F.lit("+"), F.lit("I"), F.lit("-"), F.lit("D")), F.substring(p, 1, 1))
    size = lambda p: F.when(p.startswith(":"), F.substring(p, 2, 20).try_cast("long")).when(p.startswith("*"), F.lit(1).cast("long")).otherwise((F.length(p) - 1).cast("long"))
    return F.transform(parts, lambda p: F.struct(kind(p).alias("op"), size(p).alias("len")))


def parse_md(md: Column) -> Column:
    """array<struct<op, len>> of an MD tag: = for matches, X for each mismatch, D for deletions. Matches of length 0 are left out."""
    parts = F.regexp_extract_all(md, F.lit(r"(\d+|\^[A-Z]+|[A-Z])"), F.lit(1))
    one = lambda p: F.when(p.startswith("^"), F.struct(F.lit("D").alias("op"), (F.length(p) - 1).cast("long").alias("len"))).when(p.rlike("^[A-Z]"), F.struct(F.lit("X").alias("op"), F.lit(1).cast("long").alias("len"))).otherwise(F.struct(F.lit("=").alias("op"), p.try_cast("long").alias("len")))
    return F.filter(F.transform(parts, one), lambda c: c["len"] > 0)


def long_indels(steps: DataFrame, op: str, threshold: int) -> DataFrame:
    """Rows of walk() that are insertions (op I) or deletions (op D) longer than threshold."""
    return steps.where((F.col("op") == op) & (F.col("len") > threshold))


def covered_reference(steps: DataFrame, keys: list[str], threshold: int) -> DataFrame:
    """keys, start, end: reference parts of each alignment between deletions and insertions longer than threshold; only =, X and D count as
    covering."""
    rows = steps.withColumn("__cut", F.when(F.col("op").isin("I", "D") & (F.col("len") > threshold), 1).otherwise(0))
    rows = rows.withColumn("__part", F.sum("__cut").over(Window.partitionBy(*keys).orderBy("pos")))
    rows = rows.where((F.col("__cut") == 0) & F.col("op").isin("=", "X", "D"))
    return rows.groupBy(*keys, "__part").agg(F.min("ref_start").alias("start"), F.max("ref_end").alias("end")).drop("__part")


def split_at_gaps(steps: DataFrame, keys: list[str], max_gap: int) -> DataFrame:
    """keys, part, chrom_start, chrom_end, contig_start, contig_end, cigar: alignments cut at clips and at indels longer than max_gap."""
    rows = steps.withColumn("__cut", F.when(F.col("op").isin("S", "H") | (F.col("op").isin("I", "D") & (F.col("len") > max_gap)), 1).otherwise(0))
    rows = rows.withColumn("part", F.sum("__cut").over(Window.partitionBy(*keys).orderBy("pos"))).where("__cut = 0")
    ops = F.transform(F.sort_array(F.collect_list(F.struct("pos", "op", "len"))), lambda x: F.struct(x["op"].alias("op"), x["len"].alias("len")))
    return rows.groupBy(*keys, "part").agg(F.min("ref_start").alias("chrom_start"), F.max("ref_end").alias("chrom_end"), F.min("ctg_start").alias("contig_start"), F.max("ctg_end").alias("contig_end"), render(ops).alias("cigar"))


def joint_steps(cigar: list[tuple[str, int]], tags: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """M operations of a CIGAR told apart as = and X by the operations of its MD or cs tag, which may end elsewhere (plain Python, for kernels)."""
    out: list[tuple[str, int]] = []
    rest = [(o, n) for o, n in tags if o in "=X"]
    for op, n in cigar:
        if op != "M":
            out.append((op, n))
            if op in "=X":
                while n and rest:
                    o, m = rest[0]
                    take = min(n, m)
                    n -= take
                    rest = ([(o, m - take)] if m > take else []) + rest[1:]
            continue
        while n:
            o, m = rest[0] if rest else ("=", n)
            take = min(n, m)
            if out and out[-1][0] == o:
                out[-1] = (o, out[-1][1] + take)
            else:
                out.append((o, take))
            n -= take
            if rest:
                rest = ([(o, m - take)] if m > take else []) + rest[1:]
    return out
