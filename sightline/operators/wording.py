"""Findings as rows: the question, the answer sentence and its numbers as JSON.

Each builder takes a table of numbers made in ``findings`` and words it.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.operators import findings as N
from sightline.operators.text import significance_rank
from sightline.plans.shared import beside

# Groups that a sentence lists, the first ones in its order; it also tells how many
# more there are. All values are in the tables of ``findings``.
LISTED = 1_000
COLUMNS = (
    "analyzer", "question", "answer", "insight_type", "significance", "data_json",
    "chart_type", "chart_config_json",
)


def num(c: str | Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f", F.col(c) if isinstance(c, str) else c)


def signed(c: str) -> Column:
    return F.concat(F.when(F.col(c) > 0, "+").otherwise(""), F.col(c).cast("string"))


def sentence(template: str, **parts: Column) -> Column:
    """Template with {name} places filled by columns."""
    names = []
    pieces = []
    rest = template
    while "{" in rest:
        text, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        pieces.append(text)
        names.append(name)
    out = []
    for text, name in zip(pieces, names):
        out += [F.lit(text), parts[name]]
    return F.concat(*out, F.lit(rest))


def listing(rows: DataFrame, line: Column, order: list[Column], separator: str) -> DataFrame:
    """The first LISTED lines in order in one text, and the number of the others.

    The sorted head is bounded, so the text never gathers an unbounded group.
    """
    lines = rows.select(line.alias("_l"), *[o.alias(f"_o{i}") for i, o in enumerate(order)])
    keys = [f"_o{i}" for i in range(len(order))]
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*keys, "_l"))), lambda s: s["_l"]), separator)
    head = lines.orderBy(*keys).limit(LISTED).agg(joined.alias("_first"))
    more = F.col("_total") - LISTED
    both = beside(head, lines.agg(F.count(F.lit(1)).alias("_total")))
    rest = F.when(more > 0, F.concat(F.lit(f"{separator}and "), more, F.lit(" more"))).otherwise("")
    return both.select(F.concat("_first", rest).alias("listed"))


def finding(
    rows: DataFrame,
    analyzer: str,
    question: str,
    answer: Column,
    insight_type: str,
    chart: str | None,
    config: dict,
    data: list[str],
) -> DataFrame:
    return rows.select(
        F.lit(analyzer).alias("analyzer"),
        F.lit(question).alias("question"),
        answer.alias("answer"),
        F.lit(insight_type).alias("insight_type"),
        "significance",
        F.to_json(F.struct(*data)).alias("data_json"),
        F.lit(chart).cast("string").alias("chart_type"),
        F.lit(json.dumps(config)).alias("chart_config_json"),
    )


# -- experiment -----------------------------------------------------------------
# The sentences below are fixed values: their text and number formats are part of
# the result.


def winner(df: DataFrame, m: str, d: str) -> DataFrame:
    means = N.group_means(df, d, m)
    line = F.concat(F.col("grp").cast("string"), F.lit("=$"), num("mean"), F.lit("K"))
    rows = beside(N.exp_winner(df, m, d), listing(means, line, [-F.col("mean"), F.col("grp")], ", "))
    answer = sentence(
        "{best} generates ${high}K mean " + m + " — {gap}% higher than {worst} (${low}K). All values: {all}.",
        best=F.col("winner"), high=num("winner_val"), gap=num("gap_pct"), worst=F.col("loser"),
        low=num("loser_val"), all=F.col("listed"),
    )
    return finding(
        rows, "experiment", f"Which {d} drives highest {m} overall?", answer, "winner", "bar",
        {"type": "bar", "x": d, "y": f"mean({m})", "sort": "desc", "annotate_pct_diff": True},
        ["winner", "winner_val", "loser", "loser_val", "gap_pct"],
    )


def segment_winners(df: DataFrame, m: str, d: str, other: str) -> DataFrame:
    per = N.exp_segment_winners(df, m, d, other)
    line = F.concat("segment", F.lit(": "), "winner")
    one = per.agg(F.first("consistent").alias("consistent"), F.first("significance").alias("significance"), F.min("winner").alias("winner"))
    rows = beside(one.where("consistent is not null"), listing(per, line, [F.col("segment")], "; "))
    answer = F.when(
        F.col("consistent"),
        sentence("Yes — {w} wins consistently across all " + other + " segments. ({all})", w=F.col("winner"), all=F.col("listed")),
    ).otherwise(
        sentence(
            "No — the winning " + d + " differs by " + other
            + ". {all}. A segmented strategy outperforms a one-size-fits-all approach.",
            all=F.col("listed"),
        )
    )
    return finding(
        rows, "experiment", f"Does the best {d} differ by {other}?", answer, "segment", "grouped_bar",
        {"type": "grouped_bar", "x": other, "y": f"mean({m})", "group": d}, ["consistent"],
    )


def period_stability(df: DataFrame, m: str, d: str, t: str) -> DataFrame:
    cells = N.exp_period_stability(df, m, d, t)
    per = cells.groupBy("period").agg(F.first("winner").alias("winner"), F.first("stable").alias("stable"))
    one = per.agg(F.first("stable").alias("stable"), F.count(F.lit(1)).alias("n_periods"))
    overall = N.exp_winner(df, m, d).select(F.col("winner").alias("overall"))
    line = F.concat("period", F.lit(": "), "winner")
    rows = beside(beside(one.where("n_periods > 0"), overall), listing(per, line, [F.col("period")], "; "))
    rows = rows.withColumn("significance", F.when(F.col("stable"), "low").otherwise("high"))
    answer = F.when(
        F.col("stable"),
        sentence(
            "Yes — {w} maintains its lead consistently across all {n} periods. Period winners: {all}",
            w=F.col("overall"), n=F.col("n_periods").cast("string"), all=F.col("listed"),
        ),
    ).otherwise(
        sentence(
            "No — {w} shows inconsistent performance across periods. Period winners: {all}",
            w=F.col("overall"), all=F.col("listed"),
        )
    )
    return finding(
        rows, "experiment", f"Is {d} performance consistent over {t}?", answer, "trend", "line",
        {"type": "multi_line", "x": t, "y": f"mean({m})", "group": d}, ["stable", "n_periods"],
    )


def spread(df: DataFrame, m: str, d: str) -> DataFrame:
    per = N.exp_spread(df, m, d)
    line = F.concat("variant", F.lit("="), F.round("std", 2).cast("string"))
    one = per.agg(F.max("significance").alias("_s"), F.min("significance").alias("significance"))
    rows = beside(one.where("_s is not null"), listing(per, line, [F.col("variant")], ", "))
    answer = F.when(
        F.col("significance") == "high",
        sentence(
            "High variability within groups — std by " + d + ": {all}. Location/unit factors dominate over " + d + " choice.",
            all=F.col("listed"),
        ),
    ).otherwise(sentence("Consistent performance within groups — std by " + d + ": {all}. ", all=F.col("listed")))
    return finding(
        rows, "experiment", f"How consistent is performance within each {d}?", answer, "gap", "box",
        {"type": "box_plot", "x": d, "y": m}, ["significance"],
    )


def unit_gap(df: DataFrame, m: str, unit: str) -> DataFrame:
    answer = sentence(
        "Top " + unit + "s average ${top}K vs bottom at ${low}K — a {gap}% gap suggesting location/unit factors dominate outcomes.",
        top=num("top_mean"), low=num("bottom_mean"), gap=num("gap_pct", 0),
    )
    return finding(
        N.exp_unit_gap(df, m, unit), "experiment",
        f"How large is the performance gap between best and worst {unit}s?", answer, "gap", None, {},
        ["top_mean", "bottom_mean", "gap_pct", "n_units", "top_ids"],
    )


def segment_impact(df: DataFrame, m: str, seg: str) -> DataFrame:
    buckets = N.segment_buckets(df, seg, m)
    bracket = F.concat(
        F.when(F.col("bucket") == 1, "[").otherwise("("), F.round("low", 3).cast("string"), F.lit(", "),
        F.round("high", 3).cast("string"), F.lit("]"),
    )
    line = F.concat(bracket, F.lit("=$"), num(F.round("mean", 2)), F.lit("K"))
    rows = beside(N.pattern_of(buckets), listing(buckets, line, [F.col("bucket")], "; "))
    title = F.initcap(F.replace(F.col("pattern"), F.lit("-"), F.lit(" ")))
    answer = sentence("{p} pattern for " + seg + ": {all}.", p=title, all=F.col("listed"))
    return finding(
        rows, "experiment", f"Does {seg} predict {m} performance?", answer, "pattern", "bar",
        {"type": "bar_horizontal", "x": "_bucket", "y": f"mean({m})"}, ["pattern"],
    )


# -- time series ----------------------------------------------------------------


def trend(df: DataFrame, m: str, t: str, means: DataFrame | None = None) -> DataFrame:
    answer = sentence(
        m + " shows a {dir} trend over {n} periods (R²={r2}). Total change: {chg}%. Range: ${low}K–${high}K.",
        dir=F.col("direction"), n=F.col("n_periods").cast("string"), r2=F.col("r2").cast("string"),
        chg=F.coalesce(signed("total_change_pct"), F.lit("n/a")), low=num("min_val"), high=num("max_val"),
    )
    return finding(
        N.ts_trend(df, m, t, means), "timeseries", f"What is the overall trend of {m}?", answer, "trend", "line",
        {"type": "line", "x": t, "y": m}, ["direction", "slope", "r2", "total_change_pct"],
    )


def best_worst(df: DataFrame, m: str, t: str, means: DataFrame | None = None) -> DataFrame:
    answer = sentence(
        "Best: {bp} at ${bv}K. Worst: {wp} at ${wv}K. Gap: {gap}%.",
        bp=F.col("best_period"), bv=num("best_val"), wp=F.col("worst_period"), wv=num("worst_val"),
        gap=F.coalesce(F.col("gap_pct").cast("string"), F.lit("n/a")),
    )
    return finding(
        N.ts_best_worst(df, m, t, means), "timeseries", f"What was the best and worst period for {m}?", answer, "gap", "bar",
        {"type": "bar", "x": t, "y": f"mean({m})"}, ["best_period", "best_val", "worst_period", "worst_val"],
    )


def spikes(df: DataFrame, m: str, t: str, means: DataFrame | None = None) -> DataFrame:
    answer = sentence(
        "Notable change at {p}: {chg}%. {n} period(s) show changes >25%.",
        p=F.col("notable_period"), chg=signed("change_pct"), n=F.col("n_notable").cast("string"),
    )
    return finding(
        N.ts_spikes(df, m, t, means), "timeseries", f"Are there sudden spikes or drops in {m}?", answer, "outlier", "line",
        {"type": "line", "x": t, "y": m, "annotate_spikes": True}, ["notable_period", "change_pct", "n_notable"],
    )


def latest_change(df: DataFrame, m: str, t: str, means: DataFrame | None = None) -> DataFrame:
    answer = sentence(
        "Most recent period ({lp}): ${lv}K vs previous ({pp}): ${pv}K. Change: {chg}%.",
        lp=F.col("last_period"), lv=num("last_val"), pp=F.col("prev_period"), pv=num("prev_val"), chg=signed("change_pct"),
    )
    return finding(
        N.ts_latest_change(df, m, t, means), "timeseries", f"What is the most recent change in {m}?", answer, "trend", "line",
        {"type": "line", "x": t, "y": m}, ["last_period", "last_val", "prev_val", "change_pct"],
    )


# -- transactional, customer, financial, general ----------------------------------


def pareto(df: DataFrame, m: str, d: str | None) -> DataFrame:
    answer = sentence(
        "Top 10% of records account for {share}% of total " + m + ". Average: ${top} vs overall ${all}. {risk}",
        share=F.col("top_share").cast("string"), top=num("top_mean"), all=num("overall_mean"),
        risk=F.when(F.col("top_share") > 50, "High concentration risk.").otherwise("Reasonably distributed."),
    )
    rows = N.pareto_top10(df, m).where("total is not null")
    return finding(
        rows, "transactional", f"Do top performers dominate {m}?", answer, "gap", "bar",
        {"type": "bar", "x": d or "rank", "y": m}, ["top_share", "top_mean", "overall_mean", "total"],
    )


def distribution(df: DataFrame, m: str, analyzer: str = "general") -> DataFrame:
    rows = N.distribution_summary(df, m)
    if analyzer == "transactional":
        question = f"What is the distribution shape of {m}?"
        label = (
            F.when(F.col("shape") == "right", "right-skewed (high outliers)")
            .when(F.col("shape") == "left", "left-skewed")
            .otherwise("approximately symmetric")
        )
        answer = sentence(
            m + " distribution is {shape}. Mean: ${mean}, Median: ${median}, Range: ${low}–${high}.",
            shape=label, mean=num("mean"), median=num("median"), low=num("min"), high=num("max"),
        )
    else:
        question = f"What is the distribution of {m}?"
        answer = sentence(
            m + ": average ${mean}, median ${median}, range ${low}–${high}. Skew: {shape}.",
            shape=F.col("shape"), mean=num("mean", 2), median=num("median", 2), low=num("min", 2), high=num("max", 2),
        )
    return finding(
        rows, analyzer, question, answer, "pattern", "histogram", {"type": "histogram", "x": m},
        ["mean", "median", "min", "max", "skew"],
    )


def impact(df: DataFrame, m: str, d: str, analyzer: str = "general") -> DataFrame:
    rows = N.dim_impact(df, m, d, analyzer)
    digits = 2 if analyzer == "general" else 1
    parts = {
        "best": F.col("best"), "v": num("best_val", digits), "gap": num("gap_pct"), "worst": F.col("worst"),
    }
    if analyzer == "transactional":
        question = f"Which {d} drives highest average {m}?"
        answer = sentence("{best} has the highest average " + m + " at ${v} — {gap}% above the lowest performing group.", **parts)
    elif analyzer == "customer":
        question = f"Which customer segment has the highest {m}?"
        answer = sentence("{best} segment leads with ${v} average " + m + " — {gap}% above {worst}.", **parts)
    else:
        question = f"Which {d} has the highest {m}?"
        answer = sentence("{best} leads with ${v} average " + m + " — {gap}% above the lowest group.", **parts)
    config = {"type": "bar", "x": d, "y": f"mean({m})"}
    if analyzer != "customer":
        config["sort"] = "desc"
    return finding(
        rows, analyzer, question, answer, "winner", "bar", config, ["best", "best_val", "worst", "worst_val", "gap_pct"]
    )


def share(df: DataFrame, d: str) -> DataFrame:
    answer = sentence(
        "{dom} is the largest segment at {pct}% of customers. Total segments: {n}.",
        dom=F.col("dominant"), pct=F.col("share_pct").cast("string"), n=F.col("n_segments").cast("string"),
    )
    return finding(
        N.segment_share(df, d), "customer", f"How are customers distributed across {d} segments?", answer, "pattern",
        "pie", {"type": "pie", "x": d}, ["dominant", "share_pct", "n_segments"],
    )


def total(df: DataFrame, m: str, t: str | None, d: str | None) -> DataFrame:
    chart = "line" if t else "bar"
    answer = sentence(
        "Total " + m + ": ${sum}. Average per period: ${mean}. Range: ${low}–${high}.",
        sum=F.format_number("total", 1), mean=num("mean"), low=num("min"), high=num("max"),
    )
    return finding(
        N.financial_total(df, m).where("total is not null"), "financial", f"What is the total and trend of {m}?",
        answer, "trend", chart, {"type": chart, "x": t or d, "y": m}, ["total", "mean"],
    )


def contribution(df: DataFrame, m: str, d: str) -> DataFrame:
    answer = sentence(
        "{top} accounts for {share}% of total " + m + " (${sum}).",
        top=F.col("top_group"), share=F.col("top_share").cast("string"), sum=F.format_number("top_sum", 1),
    )
    return finding(
        N.contribution_share(df, m, d), "financial", f"Which {d} contributes most to {m}?", answer, "winner", "bar",
        {"type": "bar", "x": d, "y": f"sum({m})"}, ["top_group", "top_sum", "total", "top_share"],
    )


def outliers(df: DataFrame, m: str) -> DataFrame:
    answer = sentence(
        "{n} record(s) show unusually high or low " + m
        + " values (beyond 2.5 standard deviations from average). These may warrant individual investigation.",
        n=F.col("outlier_count").cast("string"),
    )
    return finding(
        N.z_outlier_count(df, m), "general", f"Are there unusual values in {m}?", answer, "outlier", "scatter",
        {"type": "scatter", "x": "index", "y": m}, ["outlier_count"],
    )


def collect(parts: list[DataFrame]) -> DataFrame:
    """Findings in one table, numbered in the order asked, most significant first."""
    numbered = [p.withColumn("finding_id", F.lit(i)) for i, p in enumerate(parts)]
    table = reduce(lambda a, b: a.unionByName(b), numbered)
    return table.orderBy(significance_rank(), "finding_id").select("finding_id", *COLUMNS)
