"""Queries on tables of generated replies, made from conversations and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators import text
from sightline.registry.base import query, shown, table
from sightline.registry.profiles import union_sql


def _talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations with line ends as spaces, quotes and brackets left out."""
    plain = F.regexp_replace("text", r"[\r\n\t]+", " ")
    plain = F.trim(F.regexp_replace(plain, r"[\[\]{}\"\\`<>]", ""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", plain.alias("t"))


TALK = r"""(SELECT conv_id, turn, role, trim(regexp_replace(regexp_replace(text, '[\r\n\t]+', ' ', 'g'), '[\[\]{}"\\`<>]', '', 'g'), ' ') AS t FROM conversations)"""


def thought(c: Column) -> Column:
    return F.concat(F.lit("<think>first\nI look at "), c, F.lit("</think>\n  "), c, F.lit(" </think><think>x</think> "))


@query("strip_thinking", f"SELECT conv_id, turn, t FROM {TALK}")
def strip_thinking(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = _talk(spark, sf_dir)
    replies = talk.select("conv_id", "turn", thought(F.col("t")).alias("t"))
    return text.strip_thinking(replies, "t")


@query(
    "extract_json",
    f"""SELECT conv_id, turn, 'array' AS kind, '[{{"a": "' || t || '"}}, [1]]' AS json FROM {TALK}
    UNION ALL SELECT conv_id, turn, 'object', '{{"a": "' || t || '"}}' FROM {TALK}""",
)
def extract_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays inside fences and chatter; objects inside a fence."""
    talk = _talk(spark, sf_dir)
    body = F.concat(F.lit('{"a": "'), "t", F.lit('"}'))
    array = F.concat(F.lit("Here you are:\n```json\n["), body, F.lit(", [1]]\n```\nAnything else?"))
    fenced = F.concat(F.lit("```json\n"), body, F.lit("\n```"))
    one = text.extract_json(talk.select("conv_id", "turn", F.lit("array").alias("kind"), array.alias("t")), "t")
    two = text.extract_json(talk.select("conv_id", "turn", F.lit("object").alias("kind"), fenced.alias("t")), "t", False)
    return one.unionByName(two).drop("t")


@query(
    "plain_language",
    f"""SELECT conv_id, turn, t || ' — the average and variation, Spread of means; a connection, a unusually high or low value' AS t FROM {TALK}""",
)
def plain_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole words only, in any case; the turns themselves hold none of the terms."""
    talk = _talk(spark, sf_dir)
    said = F.concat("t", F.lit(" — the MEAN and Std, Spread of means; a correlation, a outlier"))
    return text.plain_language(talk.select("conv_id", "turn", said.alias("t")), "t")


@query(
    "safety_flag",
    f"SELECT conv_id, turn, NOT contains(lower(CASE WHEN role = 'assistant' THEN t ELSE t || ' UnSafe' END), 'unsafe') AS safe FROM {TALK}",
)
def safety_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("role") == "assistant", F.col("t")).otherwise(F.concat("t", F.lit(" UnSafe")))
    replies = _talk(spark, sf_dir).select("conv_id", "turn", said.alias("t"))
    return text.safety_flag(replies, "t").select("conv_id", "turn", "safe")


# Every turn is one run: its reply quotes the turn, its findings come from its length.


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = _talk(spark, sf_dir)
    run = F.concat_ws("-", "conv_id", "turn").alias("run_id")
    numbers = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(s).alias("significance")) for i, s in enumerate(("high", "medium"))])
    return talk.select(run, "t", F.inline(numbers)).select(
        "run_id",
        "position",
        F.concat(F.lit("How long is part "), F.col("position").cast("string"), F.lit(" of the turn in all?")).alias("question"),
        F.concat(F.lit("It has "), F.length("t").cast("string"), F.lit(" signs. "), "t").alias("answer"),
        "significance",
        F.length("t").cast("string").alias("metric"),
    )


FINDINGS = f"""(SELECT conv_id || '-' || turn AS run_id, p AS position, 'How long is part ' || p || ' of the turn in all?' AS question,
  'It has ' || length(t) || ' signs. ' || t AS answer, CASE p WHEN 0 THEN 'high' ELSE 'medium' END AS significance,
  CAST(length(t) AS VARCHAR) AS metric FROM {TALK}, range(2) r(p))"""


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four insights per reply, some incomplete; replies of one role are no JSON."""
    talk = _talk(spark, sf_dir)
    full = F.struct(
        F.concat(F.lit("Headline "), "t").alias("headline"),
        F.lit("First sentence. Second one.").alias("context"),
        F.lit("Act now").alias("recommended_action"),
        F.col("turn").cast("string").alias("supporting_metric"),
        F.lit("risk").alias("impact_area"),
        F.lit("low").alias("magnitude"),
        F.lit("FINDING 9").alias("finding_reference"),
    )
    blank = F.struct(
        F.lit("  ").alias("headline"),
        F.lit("").alias("context"),
        F.lit(None).cast("string").alias("recommended_action"),
        F.lit("").alias("supporting_metric"),
        F.lit("weather").alias("impact_area"),
        F.lit("extreme").alias("magnitude"),
        F.lit(" ").alias("finding_reference"),
    )
    body = F.to_json(F.array(full, blank, blank, full))
    reply = F.when(F.col("role") == "assistant", F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(
        F.concat(F.lit("Sorry: "), "t")
    )
    return talk.select(F.concat_ws("-", "conv_id", "turn").alias("run_id"), thought_free(reply).alias("reply"))


def thought_free(c: Column) -> Column:
    return F.concat(F.lit("<think>so [that]</think>"), c)


def _insight_sql() -> str:
    rows = f"(SELECT conv_id || '-' || turn AS run_id, turn, t FROM {TALK} WHERE role = 'assistant')"
    full = f"""SELECT run_id, CAST(0 AS INTEGER) AS position, substr('Headline ' || t, 1, 300) AS headline, 'First sentence. Second one.' AS context,
        'Act now' AS recommended_action, CAST(turn AS VARCHAR) AS supporting_metric, 'risk' AS impact_area, 'low' AS magnitude,
        'FINDING 9' AS finding_reference FROM {rows}"""
    blanks = f"""SELECT r.run_id, CAST(p AS INTEGER), substr('Strategic insight ' || (p + 1) || ' from ' || substr(question, 1, 40), 1, 300), substr(answer, 1, 200),
        '{text.DEFAULT_ACTION}', metric, 'growth', 'medium', 'FINDING ' || (p + 1)
      FROM {rows} r, range(1, 3) x(p), {FINDINGS} f WHERE f.run_id = r.run_id AND f.position = 1"""
    return f"{full} UNION ALL {blanks}"


@query("validate_insights", f"SELECT * REPLACE (CAST(position AS BIGINT) AS position) FROM ({_insight_sql()})")
def validate_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(text.validate_insights(_replies(spark, sf_dir), "reply", _findings(spark, sf_dir)))


@query(
    "next_steps",
    f"SELECT run_id, CAST(position AS BIGINT) AS position, recommended_action AS action, headline AS reason, magnitude AS priority FROM ({_insight_sql()})",
)
def next_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    insights = text.validate_insights(_replies(spark, sf_dir), "reply", _findings(spark, sf_dir))
    return shown(text.next_steps(insights))


@query(
    "validate_chain",
    union_sql(
        [
            f"SELECT conv_id, turn, 'fact' AS level, p AS position, t || ' ' || p AS a, '' AS b FROM {TALK}, range(5) r(p)",
            f"SELECT conv_id, turn, 'cause', p, t, CASE p WHEN 0 THEN 'habit' ELSE '' END FROM {TALK}, (SELECT unnest([0, 2]) AS p)",
            f"""SELECT conv_id, turn, 'decision', p, CASE p WHEN 1 THEN 'Strategic Insight' ELSE t END,
              CASE p WHEN 0 THEN 'high' ELSE 'medium' END FROM {TALK}, range(3) r(p)""",
        ]
    ),
)
def validate_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six facts, causes with an element that is no object, decisions with unknown urgency."""
    talk = _talk(spark, sf_dir)
    keys = ["conv_id", "turn"]
    facts = F.to_json(F.array(*[F.concat_ws(" ", "t", F.lit(str(i))) for i in range(6)]))
    cause = F.to_json(F.struct(F.col("t").alias("observation"), F.lit("habit").alias("root_cause")))
    lone = F.to_json(F.struct(F.col("t").alias("observation")))
    causes = F.concat(F.lit("["), cause, F.lit(", null, "), lone, F.lit("]"))

    def decision(title: Column, urgency: str) -> Column:
        return F.struct(title.alias("title"), F.lit(urgency).alias("urgency"), F.lit("Sales +1%").alias("metric_impact"))

    nameless = F.lit(None).cast("string")
    decisions = F.to_json(
        F.array(decision(F.col("t"), "high"), decision(nameless, "now"), decision(F.col("t"), "soon"), decision(F.col("t"), "low"))
    )
    one = text.validate_facts(talk.select(*keys, facts.alias("r")), "r").select(
        *keys, F.lit("fact").alias("level"), "position", F.col("fact").alias("a"), F.lit("").alias("b")
    )
    two = text.validate_causes(talk.select(*keys, causes.alias("r")), "r").select(
        *keys, F.lit("cause").alias("level"), "position", F.col("observation").alias("a"), F.col("root_cause").alias("b")
    )
    three = text.validate_decisions(talk.select(*keys, decisions.alias("r")), "r").select(
        *keys, F.lit("decision").alias("level"), "position", F.col("title").alias("a"), F.col("urgency").alias("b")
    )
    return shown(one.unionByName(two).unionByName(three))


@query(
    "top_findings",
    """SELECT run_id, rank, substr('Event ' || event_id || ' reached ' || printf('%.2f', value), 1, 120) AS headline,
      'How high is event ' || event_id || '?' AS detail, significance AS impact FROM
      (SELECT user_id AS run_id, event_id, value, CASE WHEN value > 20 THEN 'high' WHEN value > 5 THEN 'medium' ELSE 'low' END AS significance,
         row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN value > 20 THEN 0 WHEN value > 5 THEN 1 ELSE 2 END, event_id) AS rank
       FROM events WHERE value IS NOT NULL) WHERE rank <= 3""",
)
def top_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is a finding of its user's run."""
    events = table(spark, sf_dir, "events").where("value is not null")
    found = events.select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("finding_id"),
        F.concat(F.lit("How high is event "), F.col("event_id").cast("string"), F.lit("?")).alias("question"),
        F.format_string("Event %d reached %.2f", "event_id", "value").alias("answer"),
        F.when(F.col("value") > 20, "high").when(F.col("value") > 5, "medium").otherwise("low").alias("significance"),
    )
    return text.top_findings(found)


def _sentence_sql(headline: str, context: str) -> str:
    first = f"trim(split_part({context}, '.', 1), ' ')"
    return f"{headline} || '.' || CASE WHEN {first} <> '' THEN ' ' || {first} || '.' ELSE '' END"


@query(
    "run_summaries",
    f"""WITH i AS ({_insight_sql()}),
      f AS (SELECT run_id, position, substr(answer, 1, 120) AS headline, 'This finding addresses: ' || question AS context FROM {FINDINGS}
        WHERE run_id NOT IN (SELECT run_id FROM i)),
      a AS (SELECT run_id, position, headline, context FROM i UNION ALL SELECT * FROM f),
      l AS (SELECT run_id, string_agg({_sentence_sql("headline", "context")}, ' ' ORDER BY position) AS body FROM a GROUP BY 1),
      r AS (SELECT conv_id || '-' || turn AS run_id, 'Turn ' || turn AS description FROM {TALK}
        UNION ALL SELECT 'empty-' || n_nationkey, n_name FROM nation)
    SELECT r.run_id, description || '. ' || coalesce(body, '{text.NO_INSIGHTS}') AS summary FROM r LEFT JOIN l ON r.run_id = l.run_id""",
)
def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with valid replies, runs with findings only, and runs with neither."""
    found = _findings(spark, sf_dir)
    insights = text.validate_insights(_replies(spark, sf_dir), "reply", found)
    turns = _talk(spark, sf_dir).select(
        F.concat_ws("-", "conv_id", "turn").alias("run_id"), F.concat(F.lit("Turn "), F.col("turn").cast("string")).alias("description")
    )
    idle = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("empty-"), F.col("n_nationkey").cast("string")).alias("run_id"), F.col("n_name").alias("description")
    )
    return text.run_summaries(turns.unionByName(idle), insights, found)
