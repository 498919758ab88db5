"""Secret scan on a trigram inverted index, built of DataFrame functions only.

Each rule's regular expression gives a Boolean query of trigrams that every match
must contain. Postings (trigram, text_key) of the trigrams that occur in any query
are gathered by text and the queries are evaluated on them; only texts that pass a
rule's query are searched with its expression. Rules without mandatory trigrams
search every text. Texts are known by a hash of their content: a clash of hashes
only adds a text to search.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A kind of secret: expression, and the characters that its group ``value`` (0: the match) has at least."""

    kind: str
    pattern: str
    least: int
    value: int = 0


#: Base rules, in the order of their listing.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 1),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
)
#: Published shapes of further credentials.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    Rule("cloud_key", r"AIza[0-9A-Za-z_-]+", 39),
)


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Clauses that all must hold; a clause holds if all trigrams of one of its alternatives occur (lower case).

    Literal runs, optional literals and alternatives are followed exactly; anything
    else ends a run. A run some of whose strings are shorter than three characters
    gives no clause.
    """
    clauses: list[list[frozenset[str]]] = []

    def close(exact: set[str]) -> set[str]:
        if all(len(x) >= 3 for x in exact):
            clauses.append(sorted({frozenset(x[i : i + 3] for i in range(len(x) - 2)) for x in exact}, key=lambda a: (len(a), sorted(a))))
        return {""}

    def walk(nodes, exact: set[str]) -> tuple[set[str], bool]:
        """Strings after the nodes, and whether they still are all that can stand there."""
        for kind, arg in nodes:
            name = str(kind)
            if name == "LITERAL":
                exact = {x + chr(arg).lower() for x in exact}
            elif name in ("SUBPATTERN", "BRANCH"):
                branches = [arg[-1]] if name == "SUBPATTERN" else arg[1]
                ends = [walk(b, set(exact)) if simple(b) else None for b in branches]
                if None in ends:
                    exact = close(exact)
                    if len(branches) == 1:
                        close(walk(branches[0], {""})[0])
                else:
                    exact = set().union(*[e[0] for e in ends])
            elif name == "MAX_REPEAT" and arg[:2] == (0, 1) and simple(arg[2]):
                exact = exact | walk(arg[2], set(exact))[0]
            else:
                exact = close(exact)
        return exact, True

    def simple(nodes) -> bool:
        for kind, arg in nodes:
            name = str(kind)
            if name == "SUBPATTERN" and simple(arg[-1]) or name == "BRANCH" and all(simple(b) for b in arg[1]):
                continue
            if name == "MAX_REPEAT" and arg[:2] == (0, 1) and simple(arg[2]) or name == "LITERAL":
                continue
            return False
        return True

    close(walk(re._parser.parse(pattern), {""})[0])
    return clauses


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def postings(docs: DataFrame, text: str, trigrams: list[str]) -> DataFrame:
    """(trigram, text_key) for the given trigrams of the lower-cased texts."""
    low = F.lower(F.col(f"`{text}`"))
    rows = docs.select(text_key(F.col(f"`{text}`")).alias("text_key"), low.alias("low"))
    return rows.select(F.explode(F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains("low", t))).alias("trigram"), "text_key")


def candidates(docs: DataFrame, text: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(text_key, passed): kinds whose trigram queries a text passes; texts that pass none are absent."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    trigrams = sorted({t for q in queries.values() for clause in q for alternative in clause for t in alternative})
    if not trigrams:
        return docs.sparkSession.createDataFrame([], "text_key long, passed array<string>")
    by_text = postings(docs, text, trigrams).groupBy("text_key").agg(F.collect_set("trigram").alias("found"))

    def has(alternative: frozenset[str]) -> Column:
        return F.size(F.array_except(F.array(*map(F.lit, sorted(alternative))), "found")) == 0

    def holds(query) -> Column:
        out = F.lit(True)
        for clause in query:
            some = F.lit(False)
            for alternative in clause:
                some = some | has(alternative)
            out = out & some
        return out

    passed = F.array_compact(F.array(*[F.when(holds(q), F.lit(kind)) for kind, q in queries.items()]))
    return by_text.select("text_key", passed.alias("passed")).where(F.size("passed") > 0)


def spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end) of a rule's matches, leftmost first, those that are long enough; in code points."""
    pattern = F.lit(rf"(?s)(.*?)(?:({rule.pattern})|\z)")  # takes the rest of the text too, else its tail is searched from every place
    gaps = F.regexp_extract_all(text, pattern, F.lit(1))
    whole = F.regexp_extract_all(text, pattern, F.lit(2))
    value = F.regexp_extract_all(text, pattern, F.lit(2 + rule.value))
    found = F.filter(F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), value.alias("value")), lambda m: F.length(m["whole"]) > 0)
    empty = F.array().cast("array<struct<start: int, kind: int, end: int>>")

    def step(state: Column, m: Column) -> Column:
        start = state["at"] + F.length(m["gap"])
        end = start + F.length(m["whole"])
        one = F.array(F.struct(start.alias("start"), F.lit(order).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.length(m["value"]) >= rule.least, F.concat(state["out"], one)).otherwise(state["out"]).alias("out"))

    return F.aggregate(found, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda s: s["out"])


def scan(docs: DataFrame, text: str = "text", out: str = "secrets", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """Append array ``out`` of (start, kind, end): the secrets of every text, by start, then by the rules' order.

    kind is the rule's place in ``rules``; positions are code points, the end is
    exclusive. Matches of one rule don't overlap, those of different rules may.
    Null and empty texts have no secrets. Every row gives one row, repeated rows
    alike; a column already named ``out`` is replaced.
    """
    columns = [c for c in docs.columns if c.lower() != out.lower()]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    body = F.coalesce(F.col(f"row.`{text}`"), F.lit(""))
    joined = rows.withColumn("text_key", text_key(F.col(f"row.`{text}`"))).join(candidates(docs, text, rules), "text_key", "left")
    none = F.array().cast("array<struct<start: int, kind: int, end: int>>")
    found = []
    for i, r in enumerate(rules):
        if trigram_query(r.pattern):
            due = F.array_contains(F.coalesce("passed", F.array().cast("array<string>")), r.kind)
        else:  # every text; most fail the cheap search for a run that is long enough
            due = body.rlike(re.sub(r"\+$", f"{{{r.least},}}", r.pattern)) if r.value == 0 and re.fullmatch(r"\[[^\]]*\]\+", r.pattern) else F.lit(True)
        found.append(F.when(due, spans(body, r, i)).otherwise(none))
    return joined.select("row.*", F.array_sort(F.concat(*found)).alias(out))


def listed(found: Column, rules: tuple[Rule, ...], kinds: int | None = None) -> Column:
    """kind:start:end of secrets, comma-joined; of the first ``kinds`` rules only, if given."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    chosen = F.filter(found, lambda s: s["kind"] < kinds) if kinds is not None else found
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redacted(text: Column, found: Column, rules: tuple[Rule, ...]) -> Column:
    """The text with each secret replaced by its kind in brackets; where secrets overlap, by the first one's."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        shown = F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit("["), F.get(names, s["kind"]), F.lit("]"))
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"), F.when(s["start"] >= state["at"], shown).otherwise(state["out"]).alias("out")
        )

    done = F.aggregate(found, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(found) > 0, done).otherwise(text)
