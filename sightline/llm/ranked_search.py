"""Operator 12: the highest-scoring texts for each of many queries, by a hybrid of term-at-a-time and document-at-a-time.

Pass one reads the texts once and writes an index in segments of documents: postings
(term, document, occurrences) of the queries' terms and the documents' lengths. The
statistics of the collection are sums over segments. Pass two scores each
segment on its own: a query's short lists are summed into accumulators, and the
documents reached become one list with one upper bound; together with the long lists it
enters a document-at-a-time search that visits only documents whose lists could
beat the best results so far, and skips through the other lists by binary search.
The best of every segment meet in a ranking per query.

Terms are runs of letters and digits (everything outside ASCII is a letter), with A-Z in lower
case, held as 64-bit hashes. Scores are whole numbers and exact.

Cases: a null or empty text has no terms and is no document of the statistics; a
query without terms has no results. Repeated rows of the texts are documents of their
own, also under one id; without id they come first among equal scores. Equal rows of the
queries are one query; several texts under one query id are ranked each on their own.
Queries are worked on in groups of a bounded number of terms, so any number of queries
will do. Other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sightline.llm.words import ALNUM, per_text, slices, tokenize
from sightline.plans.shared import reliable

#: Pairs of query and term that are worked on in one pass over the texts.
GROUP_TERMS = 1_000_000
#: Documents and postings of a segment, one long text more at most.
SEGMENT_DOCS, SEGMENT_POSTINGS = 8192, 2_000_000
#: Lists that hold up to this share of a segment's documents together are short.
SHORT = 0.25

SEGMENT = "docs binary, words binary, terms binary, sizes binary, postings binary, counts binary"


# ---- queries ------------------------------------------------------------------------


def query_terms(queries: DataFrame, item: str, text: str) -> DataFrame:
    """(item, query, term) for each different term of each different query; ``query`` is a hash of item and text."""

    def terms(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        found = tokenize(data, offsets, ALNUM)
        return [pa.array([np.unique(h).view(np.int64) for h in np.split(found.hashes, found.first[1:-1])], pa.list_(pa.int64()))]

    kept = queries.select(F.col(item).alias("item"), F.col(text).alias("text")).distinct()
    hashed = kept.withColumn("query", F.xxhash64("item", "text")).withColumn("found", per_text(terms, [("terms", T.ArrayType(T.LongType()))], F.col("text")))
    return hashed.select("item", "query", F.explode("found.terms").alias("term"))


# ---- index --------------------------------------------------------------------------


def index(docs: DataFrame, terms: np.ndarray, doc_id: str, text: str) -> DataFrame:
    """Segments of documents with the postings of ``terms`` (sorted hashes), in the order of terms and documents."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, term, doc, count = [], [], [], [], []
        held = rows = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, words, term, doc, count, held, rows
            t, d, c = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (term, doc, count))
            order = np.argsort(t, kind="stable")
            used, sizes = np.unique(t, return_counts=True)
            row = [
                pa.concat_arrays(ids).fill_null(0).to_numpy(zero_copy_only=False), np.concatenate(words), used, sizes, d[order], c[order],
            ]
            has = pa.concat_arrays(ids).is_valid().to_numpy(zero_copy_only=False)
            out = [x.astype(k).tobytes() for x, k in zip(row, ("i8", "i8", "i4", "i4", "i4", "i4"))]
            out[0] += np.packbits(has).tobytes()
            ids, words, term, doc, count, held, rows = [], [], [], [], [], 0, 0
            return pa.RecordBatch.from_pydict(dict(zip([f.split()[0] for f in SEGMENT.split(", ")], [pa.array([x], pa.binary()) for x in out])))

        for batch in batches:
            names = batch.column(0).cast(pa.int64())
            for low, high, data, offsets in slices(batch.column(1)):
                found = tokenize(data, offsets, ALNUM)
                at = np.searchsorted(terms, found.hashes)
                at[at == len(terms)] = 0
                hit = terms[at] == found.hashes
                pairs, n = np.unique(found.text_of[hit] * len(terms) + at[hit], return_counts=True)
                ids.append(names.slice(low, high - low))
                words.append(found.counts)
                term.append(pairs % len(terms))
                doc.append(pairs // len(terms) + rows)
                count.append(n)
                rows, held = rows + high - low, held + len(pairs)
                if rows >= SEGMENT_DOCS or held >= SEGMENT_POSTINGS:
                    yield flush()
        if ids:
            yield flush()

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(segments, SEGMENT)


def statistics(segments: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with terms, all their terms, and the documents of each indexed term."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, length = np.zeros(n_terms, np.int64), 0, 0
        for batch in batches:
            for r in batch.to_pylist():
                words = np.frombuffer(r["words"], "i8")
                docs, length = docs + int((words > 0).sum()), length + int(words.sum())
                df[np.frombuffer(r["terms"], "i4")] += np.frombuffer(r["sizes"], "i4")
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": np.append(at, [-1, -2]).astype("i8"), "n": np.append(df[at], [docs, length]).astype("i8")})

    sums = segments.select("words", "terms", "sizes").mapInArrow(totals, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    found = dict(zip(sums["term"].to_pylist(), sums["n"].to_pylist()))
    df = np.zeros(n_terms, np.int64)
    for t, n in found.items():
        if t >= 0:
            df[t] = n
    return found.get(-1, 0), found.get(-2, 0), df


# ---- search -------------------------------------------------------------------------


class Segment:
    """One segment's lists with the share of a score that each posting gives for a weight of one."""

    def __init__(self, row: dict, docs: int, length: int):
        self.words = np.frombuffer(row["words"], "i8")
        n = len(self.words)
        self.ids = np.frombuffer(row["docs"], "i8", n)
        self.has_id = np.unpackbits(np.frombuffer(row["docs"], "u1", offset=8 * n))[:n].astype(bool)
        sizes = np.frombuffer(row["sizes"], "i4")
        self.start = dict(zip(np.frombuffer(row["terms"], "i4").tolist(), (np.cumsum(sizes) - sizes).tolist()))
        self.size = dict(zip(self.start, sizes.tolist()))
        self.posting = np.frombuffer(row["postings"], "i4")
        tf = np.frombuffer(row["counts"], "i4").astype("i8")
        m = 50 + (50 * self.words * docs) // max(length, 1)
        self.part = (1_000_000_000 * tf) // (1000 * tf + 20 * m[self.posting])
        self.top = {t: int(self.part[a : a + self.size[t]].max()) for t, a in self.start.items()}

    def list(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a = self.start[term]
        return self.posting[a : a + self.size[term]], self.part[a : a + self.size[term]]

    def search(self, terms: list[int], weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all documents that may be among the k best and score at least ``floor``."""
        # short lists are summed term at a time
        lists = sorted((self.size[t], t) for t in terms if t in self.start and weights[t] > 0)
        room, reached, summed = SHORT * len(self.words), [], []
        while lists and lists[0][0] <= room:
            size, t = lists.pop(0)
            room -= size
            docs, part = self.list(t)
            reached.append(docs)
            summed.append(part * weights[t])
        # the accumulators and each long list are the iterators: (upper bound, documents, gains)
        iterators = []
        if reached:
            sums = np.zeros(len(self.words), np.int64)
            for docs, gain in zip(reached, summed):
                sums[docs] += gain
            docs = np.flatnonzero(sums)
            if len(docs):
                iterators.append((int(sums.max()), docs, sums[docs], 1))
        for _, t in lists:
            docs, part = self.list(t)
            iterators.append((self.top[t] * int(weights[t]), docs, part, int(weights[t])))
        iterators.sort(key=lambda x: x[0])
        bounds = np.cumsum([x[0] for x in iterators])
        # documents are taken from the lists of the highest bounds down, as long as a document not seen yet could reach the floor
        scores = np.zeros(len(self.words), np.int64)
        open_docs = np.zeros(0, np.int64)
        for i in range(len(iterators) - 1, -1, -1):
            _, docs, gains, weight = iterators[i]
            if bounds[i] >= max(floor, 1):  # its documents can still enter
                scores[docs] += gains * weight
                open_docs = np.flatnonzero(scores)
            elif len(open_docs):  # only looked into for documents that are open
                at = np.searchsorted(docs, open_docs)
                at[at == len(docs)] = 0
                hit = docs[at] == open_docs
                scores[open_docs[hit]] += gains[at[hit]] * weight
            if len(open_docs) > k:
                floor = max(floor, int(np.partition(scores[open_docs], -k)[-k]))
            below = bounds[i - 1] if i else 0
            open_docs = open_docs[scores[open_docs] + below >= floor]
        return open_docs, scores[open_docs]


def score(segments: DataFrame, queries: list[tuple[int, list[int]]], weights: np.ndarray, docs: int, length: int, k: int) -> DataFrame:
    """(query, doc_id, score): at most k candidates of each task for each query, the true best k among all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        best = {q: (none, none, none) for q, _ in queries}
        floors = dict.fromkeys(best, 0)
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment(row, docs, length)
                for q, terms in queries:
                    places, scores = segment.search(terms, weights, k, floors[q])
                    if len(places):
                        s, d, h = best[q]
                        s, d, h = np.append(s, scores), np.append(d, segment.ids[places]), np.append(h, segment.has_id[places])
                        keep = np.lexsort((d, h, -s))[:k]  # rows without id first
                        best[q] = s[keep], d[keep], h[keep]
                        if len(keep) == k:
                            floors[q] = int(s[keep[-1]])
        for q, (s, d, h) in best.items():
            if len(s):
                yield pa.RecordBatch.from_pydict(
                    {"query": pa.array(np.full(len(s), q), pa.int64()), "doc_id": pa.array(d, pa.int64(), mask=h == 0), "score": pa.array(s, pa.int64())}
                )

    return segments.mapInArrow(run, "query bigint, doc_id bigint, score bigint")


def top_documents(
    docs: DataFrame, queries: DataFrame, k: int = 50, doc_id: str = "doc_id", item: str = "item_id", text: str = "text"
) -> DataFrame:
    """(item, rank from 1, doc_id, score): the ``k`` documents with the highest scores above 0 for each query.

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))); a document gets
    weight * (10^9 tf div (1000 tf + 20 m)) for each term, with m = 50 + (50 n N div L).
    """
    spark: SparkSession = docs.sparkSession
    pairs = reliable(query_terms(queries, item, text))
    n_groups = max(1, math.ceil(pairs.count() / GROUP_TERMS))
    results = []
    for g in range(n_groups):
        group = pairs.where(F.pmod(F.xxhash64("query"), F.lit(n_groups)) == g).select("query", "term").toArrow()
        hashes = group["term"].to_numpy().view(np.uint64)
        terms = np.unique(hashes)
        if not len(terms):
            continue
        asked: dict[int, list[int]] = {}
        for q, t in zip(group["query"].to_pylist(), np.searchsorted(terms, hashes).tolist()):
            asked.setdefault(q, []).append(t)
        segments = reliable(index(docs, terms, doc_id, text))
        n, length, df = statistics(segments, len(terms))
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(f) + 1))) for f in df], np.int64)
        results.append(score(segments, sorted(asked.items()), weights, n, length, k))
    if not results:
        return spark.createDataFrame([], T.StructType([queries.schema[item], *T.StructType.fromDDL("rank int, doc_id bigint, score bigint").fields]))
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))).where(F.col("rank") <= k)
    names = pairs.select("query", "item").distinct()
    return ranked.join(names, "query").select(F.col("item").alias(item), "rank", "doc_id", "score")


def oracle_sql(k: int = 50) -> str:
    """The same ranking by plain SQL over ``documents`` and ``benchmark``."""
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

    def words(table: str, key: str) -> str:
        folded = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        return f"SELECT {key}, unnest(regexp_extract_all({folded}, '{pattern}')) AS term FROM {table}"

    return f"""
    WITH said AS ({words('documents', 'doc_id')}),
    lengths AS (SELECT doc_id, count(*) AS n FROM said GROUP BY doc_id),
    total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM lengths),
    asked AS (SELECT DISTINCT item_id, term FROM ({words('benchmark', 'item_id')})),
    counts AS (SELECT doc_id, term, count(*) AS tf FROM said SEMI JOIN asked USING (term) GROUP BY doc_id, term),
    weights AS (
        SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
        FROM counts CROSS JOIN total GROUP BY term
    ),
    parts AS (
        SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))) AS part
        FROM counts JOIN weights USING (term) JOIN lengths USING (doc_id) CROSS JOIN total
    ),
    scored AS (
        SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM asked JOIN parts USING (term) GROUP BY item_id, doc_id
    )
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM scored WHERE score > 0 QUALIFY rank <= {k}
    """
