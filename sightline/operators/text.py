"""Cleaning and validation of generated text, as column jobs over many replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Terms, replacements, defaults and limits the results depend on.
PLAIN_TERMS = (
    ("mean", "average"),
    ("std", "variation"),
    ("variance", "spread"),
    ("correlation", "connection"),
    ("distribution", "spread"),
    ("outlier", "unusually high or low value"),
    ("regression", "trend line"),
    ("coefficient", "relationship strength"),
    ("percentile", "ranking"),
    ("z-score", "statistical flag"),
)
IMPACT_AREAS = ("revenue", "cost", "risk", "growth", "efficiency")
LEVELS = ("high", "medium", "low")
DEFAULT_ACTION = "Review this finding with your team and develop a targeted response plan."
FALLBACK_ACTION = "Review this finding with your team and develop a response plan."
NO_INSIGHTS = (
    "No significant patterns were detected with the current data. "
    "Consider uploading a larger or more complete dataset for richer analysis."
)
INSIGHT_FIELDS = (
    "headline", "context", "recommended_action", "supporting_metric",
    "impact_area", "magnitude", "finding_reference",
)
MAX_INSIGHTS, MAX_FACTS, MAX_DECISIONS, FIELD_CHARS = 3, 5, 3, 300
# End of fixed values.


def strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")


def without_thinking(c: Column) -> Column:
    blocks = F.regexp_replace(c, r"(?s)<think>.*?</think>", "")
    return strip(F.regexp_replace(blocks, r"</?think>", ""))


def json_array_text(c: Column) -> Column:
    """Text from the first [ to the last ], code fences removed."""
    bare = strip(F.regexp_replace(c, r"```(?:json)?", ""))
    opened = F.regexp_replace(bare, r"(?s)^[^\[]*(?=\[)", "")
    return F.regexp_replace(opened, r"(?s)^(.*\])[^\]]*$", "$1")


def json_text(c: Column) -> Column:
    """Text from the first [ on, or from the first { where there is none."""
    bare = strip(F.regexp_replace(c, r"```(?:json)?", ""))
    return (
        F.when(F.contains(bare, F.lit("[")), F.regexp_replace(bare, r"(?s)^[^\[]*(?=\[)", ""))
        .when(F.contains(bare, F.lit("{")), F.regexp_replace(bare, r"(?s)^[^{]*(?=\{)", ""))
        .otherwise(bare)
    )


def plain_words(c: Column) -> Column:
    for term, plain in PLAIN_TERMS:
        c = F.regexp_replace(c, rf"(?i)\b{term}\b", plain)
    return c


def strip_thinking(replies: DataFrame, text_col: str) -> DataFrame:
    return replies.withColumn(text_col, without_thinking(F.col(text_col)))


def extract_json(replies: DataFrame, text_col: str, arrays_only: bool = True) -> DataFrame:
    cleaned = without_thinking(F.col(text_col))
    return replies.withColumn("json", json_array_text(cleaned) if arrays_only else json_text(cleaned))


def plain_language(replies: DataFrame, text_col: str) -> DataFrame:
    return replies.withColumn(text_col, plain_words(F.col(text_col)))


def safety_flag(replies: DataFrame, text_col: str) -> DataFrame:
    """``safe`` is false where the reply says unsafe."""
    return replies.withColumn("safe", ~F.contains(F.lower(text_col), F.lit("unsafe")))


def _items(replies: DataFrame, text_col: str, element: str, limit: int) -> DataFrame:
    """Parsed array elements of each reply with their 0-based position."""
    found = json_array_text(without_thinking(F.col(text_col)))
    parsed = F.from_json(F.when(F.startswith(found, F.lit("[")), found), f"array<{element}>")
    kept = F.slice(parsed, 1, limit)
    others = [c for c in replies.columns if c != text_col]
    return replies.select(*others, F.posexplode(kept).alias("position", "item"))


def _given(field: str) -> Column:
    c = F.col(f"item.{field}")
    return F.when(strip(c) != "", c)


def validate_insights(replies: DataFrame, text_col: str, findings: DataFrame, run: str = "run_id") -> DataFrame:
    """At most three complete insights per reply.

    ``findings`` has ``run``, ``position`` (0-based, most significant first),
    question, answer, significance and a text ``metric``; a blank field falls
    back to the finding of the same position, or the run's last one.
    """
    element = "struct<" + ",".join(f"{f}:string" for f in INSIGHT_FIELDS) + ">"
    items = _items(replies, text_col, element, MAX_INSIGHTS)
    # Per run only the first findings can be referred to.
    needed = findings.where(F.col("position") < MAX_INSIGHTS)
    last = needed.groupBy(run).agg(F.max("position").alias("_last"))
    matched = (
        items.join(last, run, "left")
        .withColumn("_use", F.least(F.col("position"), F.col("_last")))
        .join(
            needed.select(
                F.col(run).alias("_run"),
                F.col("position").alias("_use_position"),
                "question",
                "answer",
                "significance",
                "metric",
            ),
            (F.col(run) == F.col("_run")) & (F.col("_use") == F.col("_use_position")),
            "left",
        )
    )
    number = (F.col("position") + 1).cast("string")
    fallback = {
        "headline": F.concat(
            F.lit("Strategic insight "), number, F.lit(" from "), F.substring(F.coalesce("question", F.lit("")), 1, 40)
        ),
        "context": F.substring(F.coalesce("answer", F.lit("")), 1, 200),
        "recommended_action": F.lit(DEFAULT_ACTION),
        "supporting_metric": F.coalesce("metric", F.lit("See finding")),
        "impact_area": F.lit("growth"),
        "magnitude": F.coalesce("significance", F.lit("medium")),
        "finding_reference": F.concat(F.lit("FINDING "), number),
    }
    filled = {
        f: F.substring(F.coalesce(_given(f), fallback[f]), 1, FIELD_CHARS) for f in INSIGHT_FIELDS
    }
    filled["magnitude"] = F.when(filled["magnitude"].isin(*LEVELS), filled["magnitude"]).otherwise("medium")
    filled["impact_area"] = F.when(filled["impact_area"].isin(*IMPACT_AREAS), filled["impact_area"]).otherwise("growth")
    return matched.select(run, "position", *[plain_words(filled[f]).alias(f) for f in INSIGHT_FIELDS])


def validate_facts(replies: DataFrame, text_col: str) -> DataFrame:
    """At most five fact sentences per reply."""
    items = _items(replies, text_col, "string", MAX_FACTS)
    return items.withColumnRenamed("item", "fact")


def validate_causes(replies: DataFrame, text_col: str) -> DataFrame:
    """Observation and root cause pairs; elements that are no objects drop out."""
    items = _items(replies, text_col, "struct<observation:string,root_cause:string>", 2**31 - 1)
    keys = [c for c in items.columns if c != "item"]
    return items.where("item is not null").select(
        *keys, *[F.coalesce(f"item.{f}", F.lit("")).alias(f) for f in ("observation", "root_cause")]
    )


def validate_decisions(replies: DataFrame, text_col: str) -> DataFrame:
    """At most three decisions per reply with a known urgency."""
    fields = ("title", "insight", "action", "urgency", "metric_impact")
    items = _items(replies, text_col, "struct<" + ",".join(f"{f}:string" for f in fields) + ">", MAX_DECISIONS)
    keys = [c for c in items.columns if c != "item"]
    out = {f: F.coalesce(f"item.{f}", F.lit("Strategic Insight" if f == "title" else "")) for f in fields}
    out["urgency"] = F.when(F.col("item.urgency").isin(*LEVELS), F.col("item.urgency")).otherwise("medium")
    return items.where("item is not null").select(*keys, *[out[f].alias(f) for f in fields])


def significance_rank(name: str = "significance") -> Column:
    c = F.col(name)
    return F.when(c == "high", 0).when(c == "medium", 1).when(c == "low", 2).otherwise(3)


def top_findings(findings: DataFrame, run: str = "run_id", order: str = "finding_id", top: int = 3) -> DataFrame:
    """The most significant findings of each run as headline, detail and impact.

    Tasks forward at most ``top`` rows per run, so a run with very many findings
    does not gather in one place.
    """
    nth = F.row_number().over(Window.partitionBy(run).orderBy(significance_rank(), order))
    kept = findings.withColumn("rank", nth).where(F.col("rank") <= top)
    headline = F.when(F.coalesce(F.length("answer"), F.lit(0)) > 0, F.substring("answer", 1, 120)).otherwise(
        F.substring("question", 1, 80)
    )
    return kept.select(
        run,
        F.col("rank").cast("long").alias("rank"),
        headline.alias("headline"),
        F.col("question").alias("detail"),
        F.col("significance").alias("impact"),
    )


def next_steps(insights: DataFrame, run: str = "run_id") -> DataFrame:
    """Recommended actions of the validated insights."""
    return insights.where((F.col("recommended_action") != "") & (F.col("position") < MAX_INSIGHTS)).select(
        run,
        "position",
        F.col("recommended_action").alias("action"),
        F.col("headline").alias("reason"),
        F.col("magnitude").alias("priority"),
    )


def fallback_insights(findings: DataFrame, run: str = "run_id") -> DataFrame:
    """Insight rows made from a run's top findings (same columns as ``validate_insights``)."""
    return findings.where(F.col("position") < MAX_INSIGHTS).select(
        run,
        "position",
        F.substring("answer", 1, 120).alias("headline"),
        F.concat(F.lit("This finding addresses: "), "question").alias("context"),
        F.lit(FALLBACK_ACTION).alias("recommended_action"),
        F.substring(F.coalesce("metric", F.lit("See analysis")), 1, 80).alias("supporting_metric"),
        F.lit("growth").alias("impact_area"),
        F.col("significance").alias("magnitude"),
        F.concat(F.lit("FINDING "), (F.col("position") + 1).cast("string")).alias("finding_reference"),
    )


def run_summaries(
    runs: DataFrame, insights: DataFrame, findings: DataFrame, run: str = "run_id"
) -> DataFrame:
    """One paragraph per run: its description, then up to three headlines with context.

    ``runs`` has ``run`` and ``description``. Runs without a valid insight use
    their top findings, and runs with neither get a fixed sentence.
    """
    missing = findings.join(insights.select(run).distinct(), run, "left_anti")
    every = insights.unionByName(fallback_insights(missing, run))
    first_sentence = strip(F.substring_index("context", ".", 1))
    sentence = F.concat(
        F.col("headline"),
        F.lit("."),
        F.when(first_sentence != "", F.concat(F.lit(" "), first_sentence, F.lit("."))).otherwise(""),
    )
    # At most three short rows per run.
    lines = every.where((F.col("headline") != "") & (F.col("position") < MAX_INSIGHTS)).select(
        run, F.struct("position", sentence.alias("line")).alias("_line")
    )
    joined = lines.groupBy(run).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("_line")), lambda s: s["line"]), " ").alias("_body")
    )
    return runs.join(joined, run, "left").select(
        run,
        F.concat(F.col("description"), F.lit(". "), F.coalesce("_body", F.lit(NO_INSIGHTS))).alias("summary"),
    )


