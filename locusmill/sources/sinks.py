"""Writers of text formats. Each makes lines in the order asked for and leaves the parts to Spark's text writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusmill.functions import cigar as G


def _save(rows: DataFrame, line: Column, order: list, path: str, top: list[str] | None = None) -> None:
    """Lines in order (by range, so not through one task); lines of `top` go first."""
    out = rows.select(F.lit(1).alias("__k"), *[F.col(c).alias(f"__o{i}") if isinstance(c, str) else c.alias(f"__o{i}") for i, c in enumerate(order)], line.alias("value"))
    keys = ["__k", *[f"__o{i}" for i in range(len(order))]]
    if top:
        head = rows.sparkSession.createDataFrame([(i, x) for i, x in enumerate(top)], "__i long, value string").select((F.col("__i") - len(top)).cast("int").alias("__k"), *[F.lit(None).cast(out.schema[k].dataType).alias(k) for k in keys[1:]], "value")
        out = head.unionByName(out)
    out.repartitionByRange(*keys).sortWithinPartitions(*keys).select("value").write.mode("overwrite").text(path)


def _tsv(*cols) -> Column:
    return F.concat_ws("\t", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])


def bed(blocks: DataFrame, path: str, columns: list[str] | None = None, top: list[str] | None = None) -> None:
    """contig, start, end and further columns; rows that end before they start are left out."""
    _save(blocks.where("start <= end"), _tsv("contig", "start", "end", *(columns or [])), ["contig", "start"], path, top)


def display_bed(rows: DataFrame, path: str, track: str) -> None:
    bed(rows, path, ["name", "score", "strand", "thick_start", "thick_end", "color"], [f'track name="{track}" visibility=1 itemRgb="On"'])


def bedgraph(windows: DataFrame, value: str, path: str, name: str) -> None:
    line = F.concat_ws(" ", "contig", F.col("start").cast("string"), F.col("end").cast("string"), F.col(value).cast("string"))
    _save(windows, line, ["contig", "start"], path, [f'track type=bedGraph name="{name}"'])


def bedgraphs(windows: DataFrame, folder: str) -> None:
    for value, name in (("cov", "total"), ("cov_mapq", "high_mapq"), ("cov_clip", "high_clip"), ("region", "region_index")):
        bedgraph(windows, value, f"{folder}/{name}.bedgraph", name)


def wig(windows: DataFrame, window: int, path: str) -> None:
    """fixedStep: a declaration at each contig's first window, then one value for each window."""
    value = F.format_string("%.2f", "value")
    head = F.concat(F.lit("fixedStep chrom="), "contig", F.lit(f" start=1 step={window} span={window}\n"), value)
    _save(windows, F.when(F.col("start") == 0, head).otherwise(value), ["contig", "start"], path)


def counts(hist: DataFrame, path: str) -> None:
    _save(hist, _tsv("cov", "bases"), ["cov"], path)


def table(rows: DataFrame, path: str, order: list[str], formats: dict[str, str] | None = None) -> None:
    """Tab-separated with a header line; null is NA."""
    cell = lambda c: F.coalesce(F.format_string((formats or {})[c], F.col(c)) if c in (formats or {}) else F.col(c).cast("string"), F.lit("NA"))
    _save(rows, F.concat_ws("\t", *[cell(c) for c in rows.columns]), order, path, ["#" + "\t".join(rows.columns)])


def posterior_bed(decoded: DataFrame, path: str) -> None:
    p = [F.format_string("%.2f", c) for c in ("p_err", "p_dup", "p_hap", "p_col")]
    name = F.element_at(F.array(*[F.lit(x) for x in ("Err", "Dup", "Hap", "Col")]), F.col("pred") + 1)
    _save(decoded, _tsv("contig", "start", "end", *p, name), ["contig", "start"], path)


def paf(alignments: DataFrame, path: str) -> None:
    ops = G.render(F.col("cigar")) if dict(alignments.dtypes)["cigar"].startswith("array") else F.col("cigar")
    kind = F.concat(F.lit("tp:A:"), F.when(F.col("is_primary"), "P").otherwise("S"))
    span = F.col("chrom_end") - F.col("chrom_start")
    _save(alignments, _tsv("contig", "contig_len", "contig_start", "contig_end", "strand", "chrom", "chrom_len", "chrom_start", "chrom_end", span, span, "mapq", kind, F.concat(F.lit("cg:Z:"), ops)), ["contig", "contig_start"], path)


def projections(rows: DataFrame, path: str, extra: list[str] | None = None) -> None:
    _save(rows, _tsv("contig", "from_start", "from_end", "to_contig", "to_start", "to_end", *(extra or [])), ["contig", "from_start"], path)


def by_contig(segments: DataFrame, path: str) -> None:
    """One folder for each contig."""
    segments.write.mode("overwrite").partitionBy("contig").option("sep", "\t").csv(path)


def fasta(sequences: DataFrame, path: str, width: int = 80) -> None:
    wrapped = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    _save(sequences, F.concat(F.lit(">"), "name", F.lit("\n"), wrapped), ["name"], path)


def broken_at_gaps(sequences: DataFrame) -> DataFrame:
    """name, seq: contigs between runs of N, named name_0, name_1, ... where there are several."""
    parts = F.filter(F.split("seq", "[nN]+"), lambda x: x != "")
    rows = sequences.select(F.col("name").alias("n"), F.size(parts).alias("c"), F.posexplode(parts).alias("i", "seq"))
    return rows.select(F.when(F.col("c") > 1, F.concat_ws("_", "n", F.col("i").cast("string"))).otherwise(F.col("n")).alias("name"), "seq")
