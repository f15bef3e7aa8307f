"""Reports as rows: transition labels, chart data, text and LaTeX lines (I7, J7, V3, V4, K11). Nothing is rendered on the driver.

A report is a frame of lines with an order, which ``lines_to`` writes as one text file; tables in it may have any number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT = ("lab", "d", "n")


def transition_times(measurements: DataFrame) -> DataFrame:
    """I7 with W5: pairs of measurements of a lab and date whose numbers follow each other, with times and labels.

    measurements: lab, date, m_idx, mid, t_start, t_end. Rows without lab, date or number take no part; of equal numbers the last id
    meets the next number. label_start is null without a start, the longer labels without start or end.
    """
    rows = measurements.where("lab is not null and date is not null and m_idx is not null")
    w = Window.partitionBy("lab", "date").orderBy("m_idx", "mid", "t_start", "t_end")
    later = {"to": F.lead("m_idx"), "mid_to": F.lead("mid"), "t_end_to": F.lead("t_end"), "t_start_to": F.lead("t_start")}
    rows = rows.withColumns({k: c.over(w) for k, c in later.items()}).where("to = m_idx + 1")
    start, end = F.col("t_start").cast("string"), F.col("t_end_to").cast("string")
    span = F.concat(start, F.lit(" → "), end)  # null without one of them
    ids = F.concat(F.lit("  ("), F.coalesce("mid", F.lit("?")), F.lit(" -> "), F.coalesce("mid_to", F.lit("?")), F.lit(")"))
    return rows.select(
        "lab", F.col("date").alias("d"), F.col("m_idx").cast("long").alias("n"), F.col("mid").alias("mid_from"), "mid_to", F.col("t_start").alias("t_start_transition"), F.col("t_end_to").alias("t_end_transition"),
        F.col("t_end").alias("t_from_end"), F.col("t_start_to").alias("t_to_start"), start.alias("label_start"), span.alias("label_range"), F.concat(span, ids).alias("label_full"),
    )


def slots(times: DataFrame, prefer: str | None = None) -> DataFrame:
    """Labels by number of the preferred date, or of the first one in order of its text if that is not there; a row for each laboratory of that date."""
    days = times.select(F.col("d").cast("string").alias("d")).where("d is not null")
    first = days.agg(F.coalesce(F.max(F.when(F.col("d") == F.lit(prefer), F.col("d"))), F.min("d"))).scalar()
    return times.where(F.col("d").cast("string") == first).select("n", "lab", "label_start", "label_range")


def labelled(report: DataFrame, times: DataFrame, keys: Sequence[str] = SLOT, replace: bool = True) -> DataFrame:
    """Report with n_original, transition and transition_range of its keys; n becomes the label, null where there is none, if replace.

    Keys meet as text, n as a number. With ``slots`` as times and keys ("n",) a row of the report meets each laboratory of the reference date;
    give ("lab", "n") where the report has laboratories. An n_original that is there is kept.
    """
    alike = lambda c: (F.col(c).try_cast("double").try_cast("long") if c == "n" else F.col(c).cast("string")).alias(f"__{c}")
    found = times.select(*[alike(k) for k in keys], F.col("label_start").alias("transition"), F.col("label_range").alias("transition_range"))
    own = report.drop("transition", "transition_range")
    rows = own.select("*", *[alike(k) for k in keys]).join(found, [f"__{k}" for k in keys], "left")
    original = F.col("n_original") if "n_original" in report.columns else F.col("__n")
    n = F.col("transition") if replace else F.col("__n")
    out = [n.alias("n") if c == "n" else F.col(c) for c in own.columns if c != "n_original"]
    return rows.select(*out, original.alias("n_original"), "transition", "transition_range")


def bars(rows: DataFrame, value: str = "g_norm") -> DataFrame:
    """V3: heights of grouped bars: lab, laser, n, d, height (median) and place, the date's place among all dates from 1.

    Numbers are read as such; rows that lack one of them play no part. Dates are put in order once each, not row by row.
    """
    have = rows.select("lab", "laser", F.col("n").try_cast("double").try_cast("long").alias("n"), "d", F.col(value).try_cast("double").alias("height")).dropna()
    have = have.where(~F.isnan("height"))
    days = have.select("d").distinct().select("d", F.row_number().over(Window.orderBy("d")).alias("place"))  # a row a date
    return have.groupBy("lab", "laser", "n", "d").agg(F.percentile("height", F.lit(0.5)).alias("height")).join(days, "d")


def _section(at: int, title: str, rows: DataFrame, line: Column, order: Sequence[Column], most: int | None = None) -> DataFrame:
    """Lines of a title and of rows in order, or "- (none)"."""
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    head = n.select(F.posexplode(F.when(F.col("n") == 0, F.array(F.lit(title), F.lit("- (none)"))).otherwise(F.array(F.lit(title)))).alias("i", "line"))
    own = rows.select(line.alias("line"), *[c.alias(f"k{i}") for i, c in enumerate(order)])
    keys = [f"k{i}" for i in range(len(order))]
    if most:
        own = own.orderBy(*keys).limit(most)
    body = own.select((F.row_number().over(Window.orderBy(*keys)) + 1).alias("i"), "line")
    return head.unionByName(body).select(F.lit(at).alias("section"), "i", "line")


def quality_summary(run: DataFrame, threshold: float, worst: int = 10) -> DataFrame:
    """Section, i and line of the summary of a quality run (mid, fecha, lab, score, passed, reason): totals, reasons of skipped rows, worst scores, laboratories.

    Reasons and laboratories are few and numbered in one task each, the worst scores are a top-k; ties go by name.
    """
    done, skipped = run.where("reason is null"), run.where("reason is not null")
    n = run.agg(*[F.coalesce(F.count_if(c), F.lit(0)).alias(k) for k, c in {"scored": F.col("reason").isNull(), "passed": F.col("reason").isNull() & F.col("passed"), "skipped": F.col("reason").isNotNull()}.items()])
    said = {"Files scored": F.col("scored"), "Passed": F.col("passed"), "Failed": F.col("scored") - F.col("passed"), "Skipped": F.col("skipped")}
    lines = [F.lit(f"Quality summary, threshold {threshold:.2f}"), *[F.concat(F.lit(f"{k}: "), c.cast("string")) for k, c in said.items()]]
    top = n.select(F.posexplode(F.array(*lines)).alias("i", "line")).select(F.lit(0).alias("section"), "i", "line")
    reasons = skipped.groupBy("reason").agg(F.count("*").alias("k"))
    labs = done.groupBy("lab").agg(F.avg("score").alias("mean"), F.count("*").alias("k"))
    low = done.select(F.col("score"), F.coalesce(F.col("mid").cast("string"), F.lit("UNK")).alias("mid"), *[F.coalesce(F.col(c).cast("string"), F.lit("UNK")).alias(c) for c in ("fecha", "lab")])
    parts = [
        _section(1, "Skipped by reason", reasons, F.format_string("- %s: %d", "reason", "k"), [-F.col("k"), F.col("reason")]),
        _section(2, f"Worst scores (up to {worst})", low, F.format_string("- %s | %s %s | score %.3f", "mid", "fecha", "lab", "score"), [F.col("score"), F.col("mid"), F.col("fecha"), F.col("lab")], worst),
        _section(3, "Laboratories", labs, F.format_string("- %s | mean score %.3f | files %d", F.coalesce(F.col("lab").cast("string"), F.lit("UNK")), F.col("mean"), F.col("k")), [-F.col("mean"), F.col("lab")]),
    ]
    for p in parts:
        top = top.unionByName(p.select("section", F.col("i").cast("int").alias("i"), "line"))
    return top


def tex(c: Column) -> Column:
    """V4: text with the characters escaped that LaTeX takes for its own; null is empty."""
    text = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\\", "/")
    return F.regexp_replace(text, r"([_%&#$])", r"\\$1")


def tex_table(rows: DataFrame, order: Sequence[str], caption: str, label: str) -> DataFrame:
    """Part, the order's columns and line of a long LaTeX table of rows: lines of head and foot, one a row between them.

    The body is one projection; ``lines_to`` sorts it by ranges. Columns of the order must be among those of rows.
    """
    cells = F.concat(F.concat_ws(" & ", *[tex(F.col(c)) for c in rows.columns]), F.lit(" \\\\"))
    names = rows.sparkSession.range(1).select(*[F.lit(c).alias(f"c{i}") for i, c in enumerate(rows.columns)])
    head = F.array(F.lit(r"\begin{longtable}{" + "l" * len(rows.columns) + "}"), F.concat(F.lit(r"\caption{"), tex(F.lit(caption)), F.lit(r"} \label{" + label + r"} \\")), F.concat(F.concat_ws(" & ", *[tex(F.col(c)) for c in names.columns]), F.lit(r" \\ \hline")))
    ends = names.select(F.explode(F.array(F.struct(F.lit(0).alias("part"), head.alias("lines")), F.struct(F.lit(2).alias("part"), F.array(F.lit(r"\end{longtable}")).alias("lines")))).alias("x"))
    ends = ends.select("x.part", F.posexplode("x.lines").alias("i", "line"))
    kinds = dict(rows.dtypes)
    none = [F.lit(None).cast(kinds[c]).alias(c) for c in order]
    body = rows.select(F.lit(1).alias("part"), F.lit(0).alias("i"), *order, cells.alias("line"))
    return ends.select("part", "i", *none, "line").unionByName(body)


def lines_to(lines: DataFrame, path: str, order: Sequence[str]) -> None:
    """Writes lines in order as text: sorted by ranges in parallel, so that its files in order of name are the report."""
    lines.orderBy(*order).select("line").write.text(path)
