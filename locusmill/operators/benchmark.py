"""Labels and how well a prediction agrees with the truth: runs, confusion matrices, and metrics by stratum and size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusmill.functions import bits as B
from locusmill.operators.intervals import collapse, intersect, merge, subtract
from locusmill.operators.running import numbered, tiled

#: Labels, their numbers and display colours.
LABELS = {"Err": 0, "Dup": 1, "Hap": 2, "Col": 3, "Unk": 4}
COLORS = {"Err": "162,0,37", "Dup": "250,104,0", "Hap": "0,138,0", "Col": "170,0,255", "Unk": "99,99,96"}
UNKNOWN = 4
HAPLOID = 2


def label_number(name: Column) -> Column:
    """Err, Dup, Hap, Col (also Col_Err, Col_Del) as numbers; others null."""
    return F.when(name == "Err", 0).when(name == "Dup", 1).when(name == "Hap", 2).when(name.isin("Col", "Col_Err", "Col_Del"), 3)


def runs(segments: DataFrame, ref: str, query: str, in_stratum: Column, by: list[str] | None = None) -> DataFrame:
    """Parts of label runs: run, ref, query, sub (run of query inside the run), bases; separately for each value of `by`.

    A run is a stretch of rows in the stratum, one right after the other in the order of all rows of the contig, with one label `ref`. Distance
    doesn't end a run; a row outside the stratum does."""
    keys = [*(by or []), "contig"]
    rows = segments.select(*keys, "start", "end", F.col(ref).alias("__r"), F.col(query).alias("__q"), F.coalesce(in_stratum, F.lit(False)).alias("__in"))
    new = lambda p: ~(F.col("__in") & p["__in"].eqNullSafe(F.lit(True)) & F.coalesce(p["__r"] == F.col("__r"), F.lit(False)))
    begins = {"run": new, "sub": lambda p: new(p) | ~F.coalesce(p["__q"] == F.col("__q"), F.lit(False))}
    rows = numbered(tiled(rows, F.col("start")), keys, ["start"], ["__in", "__r", "__q"], begins)
    known = lambda c: F.when(F.col(c) < 0, UNKNOWN).otherwise(F.col(c)).cast("int")
    return rows.where("__in").groupBy(*keys, "run", "sub").agg(F.first(known("__r")).alias("ref"), F.first(known("__q")).alias("query"), F.sum(F.col("end") - F.col("start")).alias("bases"))


def with_bins(parts: DataFrame, bins: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adds the run's length and each size bin (b_start <= length < b_end) that it falls into; bins may overlap. bins is a handful of rows."""
    from pyspark.sql import Window

    keys = [*(by or []), "contig", "run"]
    parts = parts.withColumn("len", F.sum("bases").over(Window.partitionBy(*keys)))
    return parts.join(F.broadcast(bins), (F.col("len") >= F.col("b_start")) & (F.col("len") < F.col("b_end"))).select(*keys, "sub", "ref", "query", "bases", "len", "bin")


def confusion(parts: DataFrame, metric: str, threshold: float = 0.4, by: list[str] | None = None) -> DataFrame:
    """bin, ref, query, value (for each value of `by`) from with_bins().

    base: bases. overlap: runs of which query labels make up more than the threshold (a run without such a label counts as unknown). aun: squares of
    the lengths of query stretches inside runs, over all bases of ref in the bin."""
    by = list(by or [])
    if metric == "base":
        return parts.groupBy(*by, "bin", "ref", "query").agg(F.sum("bases").cast("double").alias("value"))
    if metric == "overlap":
        per = parts.groupBy(*by, "contig", "run", "bin", "ref", "len", "query").agg(F.sum("bases").alias("b"))
        hits = F.collect_set(F.when(F.col("b") / F.col("len") > threshold, F.col("query")))
        per = per.groupBy(*by, "contig", "run", "bin", "ref").agg(hits.alias("h"))
        return per.select(*by, "bin", "ref", F.explode(F.when(F.size("h") == 0, F.array(F.lit(UNKNOWN))).otherwise(F.col("h"))).alias("query")).groupBy(*by, "bin", "ref", "query").agg(F.count(F.lit(1)).cast("double").alias("value"))
    from pyspark.sql import Window

    squares = parts.groupBy(*by, "bin", "ref", "query").agg(F.sum(F.col("bases") * F.col("bases")).alias("sq"), F.sum("bases").alias("t"))
    return squares.select(*by, "bin", "ref", "query", (F.col("sq") / F.sum("t").over(Window.partitionBy(*by, "bin", "ref"))).alias("value"))


COMPARISONS = {"truth_vs_prediction": ("truth", "pred"), "prediction_vs_truth": ("pred", "truth"), "truth": ("truth", "truth"), "prediction": ("pred", "pred")}


def summary(segments: DataFrame, bins: DataFrame, strata: dict[str, Column], comparisons: list[str] | None = None, metrics: list[str] | None = None, threshold: float = 0.4) -> DataFrame:
    """stratum, comparison, metric, bin, ref, query, value for all asked for; aun only where truth is the reference.

    Each segment is copied to its strata and comparisons, so that one pass finds the runs of all of them."""
    by = ["stratum", "comparison"]
    case = [F.struct(F.lit(s).alias("stratum"), F.lit(c).alias("comparison"), F.coalesce(inside, F.lit(False)).alias("inside"), F.col(COMPARISONS[c][0]).alias("ref"), F.col(COMPARISONS[c][1]).alias("query")) for s, inside in strata.items() for c in comparisons or COMPARISONS]
    rows = segments.select("contig", "start", "end", F.explode(F.array(*case)).alias("z")).select("contig", "start", "end", "z.*")
    parts = with_bins(runs(rows, "ref", "query", F.col("inside"), by), bins, by)
    out = None
    for m in metrics or ("base", "overlap", "aun"):
        own = parts.where(F.col("comparison").isin("truth_vs_prediction", "truth")) if m == "aun" else parts
        one = confusion(own, m, threshold, by).select("stratum", "comparison", F.lit(m).alias("metric"), "bin", "ref", "query", "value")
        out = one if out is None else out.unionByName(one)
    return out


def stratum_of(annotation: int) -> Column:
    return B.overlaps(F.col("annot_bits"), annotation)


def percentages(table: DataFrame, by: list[str]) -> DataFrame:
    """Adds row_total, row_percent (of ref) and total_percent within `by`."""
    row = table.groupBy(*by, "ref").agg(F.sum("value").alias("row_total"))
    whole = table.groupBy(*by).agg(F.sum("value").alias("__whole"))
    return table.join(row, [*by, "ref"]).join(whole, by).withColumn("row_percent", 100 * F.col("value") / F.col("row_total")).withColumn("total_percent", 100 * F.col("value") / F.col("__whole")).drop("__whole")


EPS = 1e-9


def per_label(table: DataFrame, by: list[str], labels: int = 4) -> DataFrame:
    """by, label, tp_recall, total_ref, tp_precision, total_query, recall, precision, f1 (percent) from a summary with both comparisons.

    Recall is taken from truth_vs_prediction, precision from prediction_vs_truth; unknown labels are no rows of their own. A label without rows has
    null for what can't be said."""
    def side(comparison: str, tp: str, total: str) -> DataFrame:
        rows = table.where((F.col("comparison") == comparison) & (F.col("ref") < labels))
        return rows.groupBy(*by, F.col("ref").alias("label")).agg(F.sum(F.when(F.col("ref") == F.col("query"), F.col("value")).otherwise(0.0)).alias(tp), F.sum("value").alias(total))

    out = side("truth_vs_prediction", "tp_recall", "total_ref").join(side("prediction_vs_truth", "tp_precision", "total_query"), [*by, "label"], "full")
    recall = F.when(F.col("total_ref") > 0, 100 * F.col("tp_recall") / (F.col("total_ref") + EPS))
    precision = F.when(F.col("total_query") > 0, 100 * F.col("tp_precision") / (F.col("total_query") + EPS))
    out = out.withColumn("recall", recall).withColumn("precision", precision)
    return out.withColumn("f1", F.when(F.col("recall").isNotNull() & F.col("precision").isNotNull(), 2 * F.col("recall") * F.col("precision") / (F.col("recall") + F.col("precision") + EPS)))


def averages(scores: DataFrame, by: list[str]) -> DataFrame:
    """by and, over labels (and over labels other than Hap), macro and harmonic means of recall and precision, and their F1.

    Labels without a score don't count; in harmonic means a score of 0 counts as 1e-9."""
    out = []
    other = F.col("label") != HAPLOID
    for name in ("recall", "precision"):
        for tail, cond in (("", F.lit(True)), ("_no_hap", other)):
            x = F.when(cond, F.col(name))
            out.append(F.avg(x).alias(f"macro_{name}{tail}"))
            out.append((F.count(x) / F.sum(F.when(x.isNotNull(), 1 / F.greatest(x, F.lit(EPS))))).alias(f"harmonic_{name}{tail}"))
    rows = scores.groupBy(*by).agg(*out)
    for kind in ("macro", "harmonic"):
        for tail in ("", "_no_hap"):
            r, p = F.col(f"{kind}_recall{tail}"), F.col(f"{kind}_precision{tail}")
            rows = rows.withColumn(f"{kind}_f1{tail}", 2 * r * p / (r + p + EPS))
    return rows


def accuracy(table: DataFrame, by: list[str], labels: int = 4) -> DataFrame:
    """by, comparison, accuracy: percent of what has a known reference label that the query agrees with."""
    rows = table.where((F.col("ref") < labels) & F.col("comparison").isin("truth_vs_prediction", "prediction_vs_truth"))
    return rows.groupBy(*by, "comparison").agg((100 * F.sum(F.when(F.col("ref") == F.col("query"), F.col("value")).otherwise(0.0)) / (F.sum("value") + EPS)).alias("accuracy"))


def aun_ratio(table: DataFrame, by: list[str]) -> DataFrame:
    """by, label, ratio: auN of the truth's runs as predicted over that of the truth itself, on the diagonal."""
    diagonal = table.where((F.col("metric") == "aun") & (F.col("ref") == F.col("query")))
    a = diagonal.where(F.col("comparison") == "truth_vs_prediction").select(*by, F.col("ref").alias("label"), F.col("value").alias("a"))
    b = diagonal.where(F.col("comparison") == "truth").select(*by, F.col("ref").alias("label"), F.col("value").alias("b"))
    return b.join(a, [*by, "label"], "left").select(*by, "label", (F.coalesce("a", F.lit(0.0)) / F.col("b")).alias("ratio"))


# labels as intervals


def final_blocks(windows: DataFrame, label: str = "pred", min_length: dict[int, int] | None = None) -> DataFrame:
    """contig, start, end, label: windows without a label become unknown, runs of Err, Dup or Col under their least length become Hap, and equal
    neighbours that touch are joined."""
    known = windows.select("contig", "start", "end", F.when(F.col(label) < 0, UNKNOWN).otherwise(F.col(label)).cast("int").alias("label"))
    first = collapse(known, ["label"])
    short = F.lit(False)
    for k, least in (min_length or {}).items():
        if k not in (HAPLOID, UNKNOWN):
            short = short | ((F.col("label") == k) & (F.col("end") - F.col("start") < least))
    return collapse(first.withColumn("label", F.when(short, HAPLOID).otherwise(F.col("label"))), ["label"])


def display_rows(blocks: DataFrame) -> DataFrame:
    """The nine columns of a display BED: contig, start, end, name, score, strand, thick start and end, colour."""
    name, colour = F.lit("Unk"), F.lit(COLORS["Unk"])
    for x, k in LABELS.items():
        name, colour = F.when(F.col("label") == k, x).otherwise(name), F.when(F.col("label") == k, COLORS[x]).otherwise(colour)
    return blocks.select("contig", "start", "end", name.alias("name"), F.lit(0).alias("score"), F.lit("+").alias("strand"), F.col("start").alias("thick_start"), F.col("end").alias("thick_end"), colour.alias("color"))


def fill_haploid(blocks: DataFrame, canonical: DataFrame) -> DataFrame:
    """blocks and, as Hap, the canonical bases that they leave uncovered."""
    rest = subtract(canonical, blocks.select("contig", "start", "end")).withColumn("label", F.lit(HAPLOID))
    return blocks.select("contig", "start", "end", "label").unionByName(rest)


def display_without_haploid(blocks: DataFrame, canonical: DataFrame) -> DataFrame:
    """Blocks other than Hap, cut to canonical bases; the bases outside as label -2 (NNN)."""
    inside = intersect(blocks.where(F.col("label") != HAPLOID).select("contig", "start", "end", "label"), canonical)
    outside = subtract(blocks.select("contig", "start", "end"), canonical).withColumn("label", F.lit(-2))
    return inside.unionByName(outside)


def recombined(first: DataFrame, second: DataFrame) -> DataFrame:
    """contig, start, end, a, b: every part where two labelings meet, with both labels (their pairs name the recombined components)."""
    from locusmill.operators.intervals import overlap_join

    out = overlap_join(first.select("contig", "start", "end", F.col("label").alias("a")), second.select("contig", "start", "end", F.col("label").alias("b")))
    return out.select("contig", F.greatest("start", "r_start").alias("start"), F.least("end", "r_end").alias("end"), "a", F.col("r_b").alias("b"))


def family_intervals(annotations: DataFrame, families: dict[str, str]) -> DataFrame:
    """contig, start, end, family: annotation rows whose name matches a family's pattern, joined within each family."""
    out = None
    for family, pattern in families.items():
        own = merge(annotations.where(F.col("name").rlike(pattern)).select("contig", "start", "end")).select("contig", "start", "end", F.lit(family).alias("family"))
        out = own if out is None else out.unionByName(own)
    return out


def stratum_totals(blocks: DataFrame, strata: DataFrame) -> DataFrame:
    """stratum, label, bases, percent of the stratum that each label covers. strata: contig, start, end, stratum."""
    from locusmill.operators.intervals import overlap_join

    rows = overlap_join(blocks.select("contig", "start", "end", "label"), strata)
    rows = rows.groupBy(F.col("r_stratum").alias("stratum"), "label").agg(F.sum(F.least("end", "r_end") - F.greatest("start", "r_start")).alias("bases"))
    whole = rows.groupBy("stratum").agg(F.sum("bases").alias("__all"))
    return rows.join(whole, "stratum").select("stratum", "label", "bases", (100 * F.col("bases") / F.col("__all")).alias("percent"))


def length_statistics(lengths: DataFrame) -> DataFrame:
    """n, total, n25, n50, n75 (length of the block at which that share of all bases is reached from the longest down), aun, q25, q50, q75.

    Lengths are counted first, so what is ordered is distinct lengths."""
    from pyspark.sql import Window

    hist = lengths.groupBy("len").agg(F.count(F.lit(1)).alias("c"))
    down = Window.orderBy(F.col("len").desc())
    up = Window.orderBy("len")
    whole = Window.partitionBy()
    rows = hist.select("len", "c", F.sum(F.col("len") * F.col("c")).over(down).alias("b"), F.sum("c").over(up).alias("k"), F.sum(F.col("len") * F.col("c")).over(whole).alias("t"), F.sum("c").over(whole).alias("n"))
    nx = lambda x: F.max(F.when(F.col("b") * 100 >= F.col("t") * x, F.col("len"))).alias(f"n{x}")
    q = lambda x: F.min(F.when(F.col("k") * 100 >= F.col("n") * x, F.col("len"))).alias(f"q{x}")
    return rows.agg(F.max("n").alias("n"), F.max("t").alias("total"), nx(25), nx(50), nx(75), (F.sum(F.col("len") * F.col("len") * F.col("c")) / F.max("t")).alias("aun"), q(25), q(50), q(75))


def sorted_sizes(blocks: DataFrame, label: int = HAPLOID) -> DataFrame:
    """rank and size of the blocks of one label, longest first."""
    from pyspark.sql import Window

    return blocks.where(F.col("label") == label).select((F.col("end") - F.col("start")).alias("size")).withColumn("rank", F.row_number().over(Window.orderBy(F.col("size").desc())))
