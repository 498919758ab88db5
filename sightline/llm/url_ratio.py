"""URL filter: rules first, then the ratio of two character language models.

The URLs that rules decide train one model of accepted and one of rejected URLs:
variable-order Markov models of characters, in which every order is smoothed with
the next lower one by the number of different characters seen (Witten-Bell). All
characters are told apart; only the host has no case. A URL is judged by its mean
log-likelihood difference a character. All labelled URLs are counted; the threshold
is calibrated on held-out ones, scored by models without them. Counts grow with the
input and stay in tables.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.plans.shared import reliable

#: Characters of context, longest first; each backs off to the next.
ORDERS = (8, 6, 4, 3, 2, 1, 0)
#: Stands before a URL as often as the longest context has characters.
START = "\u0002"
#: Counts of a window: accepted and rejected URLs, of all and of those that aren't held out.
COUNTS = ("yes", "no", "fit_yes", "fit_no")
#: Log ratios are whole numbers of this unit, so that sums don't depend on their order.
UNIT = 1_000_000_000
#: Windows that make up more than one in so many positions are joined by broadcast; there are fewer than that.
COMMON = 2_000
#: Windows that UrlModel.score takes into one task; larger models score by UrlModel.scores.
LOCAL = 2_000_000
#: Characters and highest order of the dense table that log_model smooths.
SIZE, ORDER = 42, 3
#: One labelled URL of so many is held out for the threshold.
HELD_OUT = 10
#: Scores are counted by hundredths in this range when the threshold is chosen.
BINS = 1_000


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("org", "/", "allow"), UrlRule("example.org", "/es/", "block"), UrlRule("example.org", "/en/1", "block"),
    UrlRule("com", "/fr/", "allow"), UrlRule("com", "/de/", "block"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null and where ``://`` is missing."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after)), r"^([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def deciding(host: Column, path: Column, rules: tuple[UrlRule, ...], value) -> Column:
    """value(rule) of the longest rule that fits, else null; of equally long ones the first by name."""
    out = [F.lit(None).cast("string")]
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out.insert(-1, F.when(fits, F.lit(value(r))))
    return F.coalesce(*out)


def spelling(url: Column) -> Column:
    """The URL as the models read it: A-Z before the path in lower case."""
    host, _ = url_parts(url)
    head = F.when(F.instr(url, "://") > 0, F.instr(url, "://") + 2 + F.length(host)).otherwise(0)
    folded = F.translate(F.substring(url, F.lit(1), head), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat(folded, F.substring(url, head + 1, F.length(url)))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _cut(texts: pa.Array) -> pa.Array:
    padded = (START * ORDERS[0] + (t or "") for t in texts.to_pylist())
    return pa.array([[t[i - ORDERS[0] : i + 1] for i in range(ORDERS[0], len(t))] for t in padded], pa.list_(pa.string()))


def windows(url: Column) -> Column:
    """For each character, itself behind the ORDERS[0] before it."""
    return _cut(spelling(url))


def _summed(grams: DataFrame, key: str) -> DataFrame:
    return grams.groupBy(key).agg(*[F.sum(c).alias(c) for c in COUNTS])


def count_windows(labelled: DataFrame) -> DataFrame:
    """(window, *COUNTS) over (url, accepted, held)."""
    urls = labelled.groupBy("url", "accepted", "held").agg(F.count("*").alias("n"))
    fits = {"yes": "accepted", "no": "not accepted", "fit_yes": "accepted and not held", "fit_no": "not accepted and not held"}
    counts = [F.when(F.expr(fits[c]), F.col("n")).otherwise(0).alias(c) for c in COUNTS]
    return _summed(urls.select(F.explode(windows(F.col("url"))).alias("window"), *counts), "window")


def log_ratios(counted: DataFrame, asked: DataFrame) -> DataFrame:
    """(window, ratio, fit_ratio) of the distinct ``asked`` windows in UNITs.

    Grams of every order are summed from those of the next higher one; then the
    probabilities are worked out from the lowest order up, one join an order.
    """
    none = [F.lit(0).cast("long").alias(c) for c in COUNTS]
    levels = [reliable(_summed(counted.unionByName(asked.select("window", *none)).withColumnRenamed("window", "gram"), "gram"))]
    for order in ORDERS[1:]:
        levels.append(reliable(_summed(levels[-1].withColumn("gram", F.right("gram", F.lit(order + 1))), "gram")))
    different = levels[-1].where("yes + no > 0").count() + 1
    below = None
    for order, grams in zip(reversed(ORDERS), reversed(levels)):
        context = Window.partitionBy(F.substring("gram", 1, order))
        grams = grams.select(
            "gram", *COUNTS, *[F.sum(c).over(context).alias(f"total_{c}") for c in COUNTS],
            *[F.count_if(F.col(c) > 0).over(context).alias(f"kinds_{c}") for c in COUNTS],
        )
        if below is None:
            grams = grams.select("*", *[F.lit(1 / different).alias(f"low_{c}") for c in COUNTS])
        else:
            lower = below.select(F.col("gram").alias("_end"), *[F.col(c).alias(f"low_{c}") for c in COUNTS])
            grams = grams.join(lower, F.right("gram", F.lit(last + 1)) == F.col("_end"))
        p = {c: (F.col(c) + F.col(f"kinds_{c}") * F.col(f"low_{c}")) / (F.col(f"total_{c}") + F.col(f"kinds_{c}")) for c in COUNTS}
        below = grams.select("gram", *[F.when(F.col(f"total_{c}") > 0, p[c]).otherwise(F.col(f"low_{c}")).alias(c) for c in COUNTS])
        last = order
    ratio = lambda a, b: F.round((F.log(a) - F.log(b)) * UNIT).cast("long")
    every = below.select(F.col("gram").alias("window"), ratio("yes", "no").alias("ratio"), ratio("fit_yes", "fit_no").alias("fit_ratio"))
    return every.join(asked.select("window"), "window", "left_semi")


def log_model(counts: np.ndarray) -> np.ndarray:
    """The same smoothing over a dense table of all cells: log probability of each cell's last character after its context."""
    p = np.full(SIZE, 1 / SIZE)
    for order in range(ORDER + 1):
        n = counts.reshape(-1, SIZE ** (order + 1)).sum(axis=0).reshape(-1, SIZE)
        total, kinds = n.sum(axis=1, keepdims=True), (n > 0).sum(axis=1, keepdims=True)
        lower = np.broadcast_to(p.reshape(-1, SIZE), (SIZE, p.size // SIZE, SIZE)).reshape(-1, SIZE) if order else p.reshape(1, SIZE)
        p = np.where(total > 0, (n + kinds * lower) / np.maximum(total + kinds, 1), lower)
    return np.log(p).reshape(-1).astype(np.float32)


@dataclass
class UrlModel:
    """Counts of windows, in shared storage, and the least score of an accepted URL."""

    counted: DataFrame
    threshold: float

    def scores(self, urls: DataFrame) -> DataFrame:
        """(url, score, fit) of the distinct non-empty URLs: mean differences a character by all counts and by those not held out.

        Windows are joined to their log ratios; the common ones, a fixed number at most, by broadcast.
        """
        named = reliable(urls.where("url <> ''").select("url").distinct().withColumn("no", F.monotonically_increasing_id()))
        places = named.select("no", F.explode(windows(F.col("url"))).alias("window"))
        asked = reliable(places.groupBy("window").agg(F.count("*").alias("m")))
        total = asked.agg(F.sum("m")).first()[0] or 0
        ratios = reliable(log_ratios(self.counted, asked))
        common = asked.where(F.col("m") * COMMON > total).select("window").join(ratios, "window")
        marked = places.join(F.broadcast(common), "window", "left")
        rare = marked.where("ratio is null").select("no", "window").join(ratios, "window")
        every = marked.where("ratio is not null").select("no", "ratio", "fit_ratio").unionByName(rare.select("no", "ratio", "fit_ratio"))
        mean = lambda c: F.sum(c) / F.count("*") / UNIT
        return named.join(every.groupBy("no").agg(mean("ratio").alias("score"), mean("fit_ratio").alias("fit")), "no").drop("no")

    def score(self, url: Column) -> Column:
        """The score as a column, 0 for null and empty URLs; for models of at most LOCAL windows, which every task holds."""
        rows = self.counted.select("window", "yes", "no").limit(LOCAL + 1).toArrow()
        if rows.num_rows > LOCAL:
            raise ValueError("the model is too large for a task: use scores()")
        n = (Counter(), Counter())
        for window, *both in zip(*(rows[c].to_pylist() for c in ("window", "yes", "no"))):
            for order in ORDERS:
                for side, m in zip(n, both):
                    if m:
                        side[window[-order - 1 :]] += m
        total, kinds = (Counter(), Counter()), (Counter(), Counter())
        for side, t, k in zip(n, total, kinds):
            for gram, m in side.items():
                t[gram[:-1]] += m
                k[gram[:-1]] += 1
        different = len({g for side in n for g in side if len(g) == 1}) + 1

        def log_probability(window: str, i: int) -> float:
            p = 1 / different
            for order in reversed(ORDERS):
                gram = window[-order - 1 :]
                if t := total[i].get(gram[:-1]):
                    k = kinds[i][gram[:-1]]
                    p = (n[i].get(gram, 0) + k * p) / (t + k)
            return float(np.log(p))

        @F.arrow_udf(T.DoubleType())
        def mean(cut: pa.Array) -> pa.Array:
            each = ([round((log_probability(w, 0) - log_probability(w, 1)) * UNIT) for w in ws or ()] for ws in cut.to_pylist())
            return pa.array([sum(x) / len(x) / UNIT if x else 0.0 for x in each], pa.float64())

        return mean.asNondeterministic()(windows(url))


def best_threshold(rows: list[tuple[bool, int, int]]) -> float:
    """Lower end of the bin with the best mean of both classes' accuracies; 0 without examples of both.

    rows: (accepted, bin, n). Of equally good bins the one nearest to 0, then the lower one.
    """
    n = np.zeros((2, 2 * BINS + 1))
    for accepted, bin_, count in rows:
        n[int(accepted), bin_ + BINS] += count
    if not n.sum(axis=1).all():
        return 0.0
    blocked_below = np.concatenate([[0], np.cumsum(n[0])[:-1]]) / n[0].sum()
    allowed_from = 1 - np.concatenate([[0], np.cumsum(n[1])[:-1]]) / n[1].sum()
    good = blocked_below + allowed_from
    best = np.flatnonzero(good >= good.max() - 1e-12) - BINS
    return float(best[np.lexsort((best, np.abs(best)))[0]]) / 100


def train(labelled: DataFrame) -> UrlModel:
    """Models from (url, accepted) and their threshold; URLs held out for that are chosen by hash.

    Rows with a null in either column don't take part; without any rows all scores are 0.
    """
    usable = _usable(labelled)
    model = UrlModel(reliable(count_windows(usable)), 0.0)
    model.threshold = calibrate(usable, model.scores(usable.where("held")))
    return model


def _usable(labelled: DataFrame) -> DataFrame:
    held = F.pmod(F.xxhash64("url"), F.lit(HELD_OUT)) == 0
    return labelled.where("url is not null and accepted is not null").select("url", "accepted", held.alias("held"))


def calibrate(usable: DataFrame, scores: DataFrame) -> float:
    """Threshold from the held-out URLs and the scores by models without them."""
    held = usable.where("held").groupBy("url", "accepted").agg(F.count("*").alias("n")).join(scores, "url")
    bins = held.groupBy("accepted", F.greatest(F.least(F.floor(F.col("fit") * 100), F.lit(BINS)), F.lit(-BINS)).alias("bin"))
    return best_threshold([(r["accepted"], r["bin"], r["n"]) for r in bins.agg(F.sum("n").alias("n")).collect()])


def judge(pages: DataFrame, url: str = "url", rules: tuple[UrlRule, ...] = RULES, out: str = "filter") -> DataFrame:
    """Append struct ``out`` of host, path, rule, score and verdict (allow or block) to every row.

    A rule decides URLs of its host and all subdomains whose path begins with the
    rule's; the longest wins. All others get the model's verdict: allow if the
    score reaches the threshold. Null and empty URLs fit no rule and score 0.
    Repeated rows are judged alike; a column already named ``out`` is replaced.
    """
    column = F.col(f"`{url}`")
    host, path = url_parts(column)
    verdict = deciding(host, path, rules, lambda r: r.verdict)
    usable = _usable(pages.select(column.alias("url"), (verdict == "allow").alias("accepted")))
    scores = reliable(UrlModel(reliable(count_windows(usable)), 0.0).scores(pages.select(column.alias("url"))))
    threshold = calibrate(usable, scores)
    own = F.when(F.col("_score") >= threshold, "allow").otherwise("block")
    columns = [c for c in pages.columns if c.lower() != out.lower()]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), column.alias("_url"))
    scores = scores.select(F.col("url").alias("_of"), F.col("score").alias("_score"))
    rows = rows.join(scores, F.col("_url") == F.col("_of"), "left").select("_row", "_url", F.coalesce("_score", F.lit(0.0)).alias("_score"))
    host, path = url_parts(F.col("_url"))
    parts = F.struct(
        host.alias("host"), path.alias("path"), deciding(host, path, rules, lambda r: r.name).alias("rule"),
        F.col("_score").alias("score"), F.coalesce(deciding(host, path, rules, lambda r: r.verdict), own).alias("verdict"),
    )
    return rows.select("_row.*", parts.alias(out))
