"""Near-duplicate documents with an LSH forest.

Each distinct shingle set gets several signatures ("trees"). The sets are sorted by
each signature in turn; neighbours in that order have the longest common prefixes
and become candidates. How deep a prefix has to be follows the region: where many
sets share a prefix, deeper levels are compared, until few sets are left. Regions
that stay larger are compared set against set in blocks, but only where the links
found so far don't join them yet. Candidates are confirmed on full shingle sets and
links are joined to components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm import words as W
from sightline.llm.components import components
from sightline.plans.shared import reliable

#: Two sets at the threshold of 0.8 share at least BASE levels of one of TREES trees but for a chance of (1 - 0.8^3)^24 = 3e-8.
TREES, DEPTH, BASE = 24, 6, 3
#: Bytes of a level: two equal ones stem from different shingles once in 65,536 cases.
LEVEL = 2
#: Sets of a region that are all compared; a larger region is split at its next level.
REGION = 6
#: Rows of a block when large regions are compared.
BLOCK = 2_000
#: Pairs whose estimated similarity is lower than the threshold by so much are not linked (six standard deviations).
SLACK = 0.2


def _shingles(w: W.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, shingle hash) pairs, sorted; a text with fewer words has one shingle."""
    hashes, at = W.window_hashes(w, size)
    doc = w.text_of[at] if len(at) else np.zeros(0, np.int64)
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    for n in range(1, size):
        these = short[w.counts[short] == n]
        if len(these):
            first = w.first[these]
            whole = W.combine(w.hashes[first + j] for j in range(n)) + np.uint64(n)
            doc, hashes = np.concatenate([doc, these]), np.concatenate([hashes, whole])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[new], hashes[new]


def shingle_set(text: Column, size: int) -> Column:
    """Array of the distinct shingle hashes of a text, sorted as unsigned numbers."""

    def fn(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        doc, hashes = _shingles(W.tokenize(data, offsets, W.LOWER), size)
        ends = np.searchsorted(doc, np.arange(len(offsets)))
        return [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(hashes.view(np.int64)))]

    return W.per_text(fn, [("set", T.ArrayType(T.LongType()))], text)["set"]


def signature(text: Column, size: int) -> Column:
    """Struct of the number of shingles, a digest of the set, and TREES * DEPTH minima as big-endian 16-bit numbers."""
    seeds = np.random.Generator(np.random.PCG64(77)).integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def fn(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        n = len(offsets) - 1
        doc, hashes = _shingles(W.tokenize(data, offsets, W.LOWER), size)
        ends = np.searchsorted(doc, np.arange(n + 1))
        sizes = np.diff(ends)
        some = np.flatnonzero(sizes)
        minima = np.zeros((n, len(seeds)), dtype=">u2")
        high = hashes ^ (hashes >> np.uint64(29))
        if len(some):
            for j, seed in enumerate(seeds):
                least = np.minimum.reduceat(high * seed, ends[some])
                minima[some, j] = (W.mix(least) >> np.uint64(48)).astype(np.uint16)
        raw = hashes.tobytes()
        digests = [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(ends[:-1], ends[1:])]
        width = LEVEL * len(seeds)
        packed = W.binary_array(np.frombuffer(minima.tobytes(), np.uint8), np.arange(n + 1) * width)
        return [pa.array(sizes.astype(np.int64)), pa.array(digests, pa.binary()), packed]

    return W.per_text(fn, [("n", T.LongType()), ("digest", T.BinaryType()), ("signature", T.BinaryType())], text)


NEAR = "kind int, a long, b long, tree int, path binary, n long, place long"


def _common(paths: np.ndarray, trees: np.ndarray) -> np.ndarray:
    """Levels that each row shares with the next; rows of different trees share none."""
    same = np.cumprod(paths[1:] == paths[:-1], axis=1).sum(axis=1)
    return np.where(trees[1:] == trees[:-1], same, 0)


def _neighbours(paths: np.ndarray, trees: np.ndarray, cut: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs of candidates in one sorted run of rows, and the rows of large regions.

    cut: the run may go on before and behind, so regions at its ends count as large.
    """
    n = len(paths)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.arange(n if cut else 0)
    shared = _common(paths, trees)
    need = np.full(n, DEPTH + 1)
    large = np.zeros(n, dtype=bool)
    for level in range(DEPTH, BASE - 1, -1):
        run = np.concatenate([[0], np.cumsum(shared < level)])
        size = np.bincount(run)[run]
        need[size <= REGION] = level
        if level == BASE:
            large = size > REGION
            if cut:
                large |= (run == 0) | (run == run[-1])
    left, right = [], []
    lcp = shared.copy()
    for step in range(1, min(REGION, n)):
        if step > 1:
            lcp = np.minimum(lcp[:-1], shared[step - 1 :])
        ok = lcp >= (BASE if step == 1 else np.minimum(need[: n - step], need[step:]))
        at = np.flatnonzero(ok)
        left.append(at)
        right.append(at + step)
    return np.concatenate(left), np.concatenate(right), np.flatnonzero(large)


def _columns(table: pa.Table) -> tuple[np.ndarray, ...]:
    data, _ = W.bytes_of(table["path"])
    paths = np.frombuffer(data.tobytes(), ">u2").reshape(-1, DEPTH)
    return paths, table["tree"].to_numpy(), table["rep"].to_numpy(), table["n"].to_numpy()


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of one sorted partition (kind 0), rows of large regions (1) and the partition's edges (2)."""
    from pyspark import TaskContext

    got = list(batches)
    if not got or not sum(b.num_rows for b in got):
        return
    table = pa.Table.from_batches(got)
    paths, trees, reps, n = _columns(table)
    left, right, large = _neighbours(paths, trees, cut=True)
    fits = 5 * np.minimum(n[left], n[right]) >= 4 * np.maximum(n[left], n[right])
    left, right = left[fits], right[fits]
    raw = table["path"].combine_chunks()
    edge = np.unique(np.concatenate([np.arange(min(REGION, len(n))), np.arange(max(0, len(n) - REGION), len(n))]))
    base = TaskContext.get().partitionId() << 32

    def out(kind, a, b, rows):
        m = len(a)
        rows = pa.array(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(m, kind, np.int32)), pa.array(a), pa.array(b), table["tree"].combine_chunks().take(rows), raw.take(rows)
             if kind else pa.nulls(m, pa.binary()), table["n"].combine_chunks().take(rows), pa.array(rows.to_numpy() + base)],
            ["kind", "a", "b", "tree", "path", "n", "place"],
        )

    yield out(0, np.minimum(reps[left], reps[right]), np.maximum(reps[left], reps[right]), left)
    yield out(1, reps[large], reps[large], large)
    yield out(2, reps[edge], reps[edge], edge)


def _edges(table: pa.Table) -> pa.Table:
    """Candidates across the borders of partitions, from the edge rows of one tree in their order."""
    table = table.sort_by("place")
    paths, trees, reps, n = _columns(table)
    part = table["place"].to_numpy() >> 32
    left, right, _ = _neighbours(paths, trees, cut=False)
    keep = (part[left] != part[right]) & (5 * np.minimum(n[left], n[right]) >= 4 * np.maximum(n[left], n[right]))
    left, right = left[keep], right[keep]
    return pa.table({"a": np.minimum(reps[left], reps[right]), "b": np.maximum(reps[left], reps[right])})


def candidates(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b), and (tree, region, id) of the regions that are too large to compare at once.

    ``sets`` has (rep, n, signature), one row for each distinct set.
    """
    slices = [
        F.struct(F.lit(t).alias("tree"), F.substring("signature", LEVEL * DEPTH * t + 1, LEVEL * DEPTH).alias("path")) for t in range(TREES)
    ]
    forest = sets.select("rep", "n", F.inline(F.array(*slices)))
    ordered = forest.repartitionByRange("tree", "path", "n", "rep").sortWithinPartitions("tree", "path", "n", "rep")
    found = reliable(ordered.mapInArrow(_scan, NEAR))
    borders = (
        found.where("kind = 2").select("tree", "path", F.col("a").alias("rep"), "n", "place").groupBy("tree").applyInArrow(_edges, "a long, b long")
    )
    pairs = found.where("kind = 0").select("a", "b").unionByName(borders).distinct()
    large = found.where("kind = 1").select("tree", F.substring("path", 1, LEVEL * BASE).alias("region"), F.col("a").alias("id"), "n")
    return pairs, large


def full_sets(ids: DataFrame, sets: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """(id, set) of the given distinct sets; ``rows`` has (id, text)."""
    chosen = ids.join(sets.select(F.col("rep").alias("id"), F.col("first.id").alias("of"), F.col("first.text_key").alias("key")), "id")
    texts = rows.select(F.col("id").alias("row_id"), "text", F.xxhash64("text").alias("text_key"))
    texts = texts.join(chosen, F.col("row_id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("key"))).dropDuplicates(["id"])
    return texts.select("id", shingle_set(F.col("text"), size).alias("set"))


def confirm(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough; ``full`` has (id, set)."""
    both = pairs.join(full.select(F.col("id").alias("a"), F.col("set").alias("left")), "a").join(
        full.select(F.col("id").alias("b"), F.col("set").alias("right")), "b"
    )
    common = F.size(F.array_intersect("left", "right"))
    return both.where(100 * common >= percent * (F.size("left") + F.size("right") - common)).select("a", "b")


def _counts(own: np.ndarray, values: np.ndarray, starts: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """How many members of sorted ``own`` each chosen set has; set i is values[starts[i]:starts[i + 1]] and not empty."""
    lengths = starts[chosen + 1] - starts[chosen]
    begin = np.cumsum(lengths) - lengths
    flat = values[np.repeat(starts[chosen] - begin, lengths) + np.arange(int(lengths.sum()))]
    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    return np.add.reduceat((own[at] == flat).astype(np.int64), begin)


def _compare(percent: int):
    """Links between asking and other rows of a block; none that earlier links of the block imply."""
    floor = percent / 100 - SLACK

    def compare(block: pa.Table) -> pa.Table:
        a, b = [], []
        asks = block["asks"]
        left, right = block.filter(asks), block.filter(pa.compute.invert(asks))
        if left.num_rows and right.num_rows:
            ours, theirs = (np.frombuffer(W.bytes_of(t["signature"])[0].tobytes(), ">u2").reshape(-1, TREES * DEPTH) for t in (left, right))
            sets = right["set"].combine_chunks()
            values, starts = sets.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(right["n"].to_numpy())])
            own_sets, own_starts = left["set"].combine_chunks().flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(left["n"].to_numpy())])
            ids, other, n, other_n = left["id"].to_numpy(), right["id"].to_numpy(), left["n"].to_numpy(), right["n"].to_numpy()
            part, other_part = left["component"].to_numpy().copy(), right["component"].to_numpy().copy()
            for i in range(len(ids)):
                near = np.flatnonzero((other_part != part[i]) & (100 * np.minimum(n[i], other_n) >= percent * np.maximum(n[i], other_n)))
                near = near[(theirs[near] == ours[i]).mean(axis=1) >= floor]
                if not len(near):
                    continue
                common = _counts(own_sets[own_starts[i] : own_starts[i + 1]], values, starts, near)
                for j in near[100 * common >= percent * (n[i] + other_n[near] - common)]:
                    if other_part[j] != part[i]:
                        a.append(ids[i])
                        b.append(other[j])
                        old, new = other_part[j], part[i]
                        part[part == old] = new
                        other_part[other_part == old] = new
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return compare


def _remaining(large: DataFrame, sets: DataFrame, full: DataFrame, labels: DataFrame, percent: int) -> DataFrame | None:
    """Links in large regions that the links found so far don't imply; None if all those regions are joined.

    Regions that share rows are taken together as a family, so that no two rows meet
    twice. In a family the rows of the largest component need no comparison with
    each other: the others are compared with all, in blocks of BLOCK rows, by
    signature and then by full set. A pair of blocks is a group, and gives at most
    as many links as it has rows.
    """
    named = large.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_ = named.groupBy("tree", "region").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    node = F.xxhash64(F.lit("row"), "id")
    edges = reliable(
        named.join(open_, ["tree", "region"]).select("id", "component", "n", node.alias("a"), F.xxhash64(F.lit("region"), "tree", "region").alias("b"))
    )
    if edges.isEmpty():
        return None
    families = components(edges.select("a", "b")).withColumnRenamed("component", "family").withColumnRenamed("id", "a")
    members = reliable(edges.select("id", "component", "n", "a").distinct().join(families, "a").drop("a"))
    inside = members.groupBy("family", "component").agg(F.count("*").alias("m"))
    totals = inside.groupBy("family").agg(F.max(F.struct("m", "component")).alias("main"), F.sum("m").alias("m")).select(
        "family", F.col("main.component").alias("main"), (F.col("m") / BLOCK).cast("int").alias("blocks"),
        ((F.col("m") - F.col("main.m")) / BLOCK).cast("int").alias("ask_blocks"),
    )
    placed = members.join(totals, "family").join(full, "id")
    placed = reliable(placed.join(sets.select(F.col("rep").alias("id"), "signature"), "id"))
    asking = placed.where("component <> main")
    own = lambda blocks: F.pmod(F.xxhash64("id"), F.col(blocks) + 1)
    all_of = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks)))
    columns = ["family", "id", "component", "n", "signature", "set"]
    left = asking.select(*columns, own("ask_blocks").cast("int").alias("ask_block"), all_of("blocks").alias("block"), F.lit(True).alias("asks"))
    right = placed.select(*columns, all_of("ask_blocks").alias("ask_block"), own("blocks").cast("int").alias("block"), F.lit(False).alias("asks"))
    return left.unionByName(right).groupBy("family", "ask_block", "block").applyInArrow(_compare(percent), "a long, b long")


def _joined(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Labels (id, component) after further links (a, b): only the components that these join are worked on."""
    if more.isEmpty():
        return labels
    ends = more.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    every = reliable(labels.join(ends, "id", "full").select("id", F.coalesce("component", "id").alias("component")))
    own = lambda end: every.select(F.col("id").alias(end), F.col("component").alias(f"{end}_part"))
    between = more.join(own("a"), "a").join(own("b"), "b").select(F.col("a_part").alias("a"), F.col("b_part").alias("b"))
    parts = components(between).select(F.col("id").alias("component"), F.col("component").alias("whole"))
    return every.join(parts, "component", "left").select("id", F.coalesce("whole", "component").alias("component"))


def _judge(rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(id, text_key, n, component_id, kept) for every row of (id, text)."""
    if percent < 80:
        raise ValueError("the forest finds links from 80 per cent upwards")
    signed = reliable(rows.select("id", F.xxhash64("text").alias("text_key"), signature(F.col("text"), shingle).alias("s")).select("id", "text_key", "s.*"))
    # The first row of a set has the smallest id, null behind all others, then the smallest text hash.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("first")
    distinct = signed.where("n > 0").groupBy("digest").agg(first, F.max("n").alias("n"))
    of = signed.where("n > 0").select("id", "text_key", "signature")
    of = of.join(distinct, F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text_key") == F.col("first.text_key"))).dropDuplicates(["digest"])
    sets = reliable(of.select(F.monotonically_increasing_id().alias("rep"), "digest", "first", "n", "signature"))
    pairs, large = candidates(sets)
    pairs = reliable(pairs)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(large.select("id")).distinct()
    full = reliable(full_sets(wanted, sets, rows, shingle))
    labels = components(confirm(pairs, full, percent))
    more = _remaining(large, sets, full, labels, percent)
    if more is not None:
        labels = _joined(labels, reliable(more))
    named = sets.select("digest", "rep", "first").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    named = named.select("digest", "first", F.coalesce("component", "rep").alias("component"))
    best = named.groupBy("component").agg(F.min("first").alias("best"))
    named = named.join(best, "component").select("digest", "best")
    out = signed.join(named, "digest", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("best.id")).otherwise(F.col("id")))
    chosen = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("text_key") == F.col("best.text_key"))
    return out.select("id", "text_key", "n", "component_id", ((F.col("n") == 0) | F.coalesce(chosen, F.lit(False))).alias("kept"))


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    A text's words are runs without ASCII white space, A-Z in lower case; its set
    holds the distinct shingles of ``shingle`` words, or its whole sequence if it is
    shorter. Texts are linked if their sets have at least ``percent`` per cent of
    their union in common. component_id is the smallest id reachable over links.

    Null, empty and wordless texts have no shingles and are linked with nothing, so
    they are kept. Every row gives one row. All others take part, whatever their id:
    of linked rows the one with the smallest id is kept, of several texts under that
    id the one with the smallest hash. Rows without id come after all others; where
    no linked row has an id, the smallest text hash is kept and component_id is null.
    Rows with the same id and text are kept or not alike. ``percent`` must be 80 or more: the trees are laid out for that.
    """
    judged = _judge(_rows(docs, doc_id, text), shingle, percent)
    return judged.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), "component_id", "kept")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that near_duplicates keeps, all columns; of rows with the same id and text one."""
    judged = _judge(_rows(docs, doc_id, text), shingle, percent).where("kept")
    keys = {"_id": F.coalesce("id", F.lit(0)), "_none": F.col("id").isNull(), "_text": F.col("text_key")}
    chosen = judged.select(*[c.alias(k) for k, c in keys.items()]).distinct()
    rows = docs.select(
        F.struct("*").alias("_row"), F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(0)).alias("_id"),
        F.col(f"`{doc_id}`").isNull().alias("_none"), F.xxhash64(F.col(f"`{text}`")).alias("_text"),
    )
    return rows.join(chosen, list(keys), "left_semi").dropDuplicates(list(keys)).select("_row.*")
