"""Line-first cleaning: judge lines, remove the failing ones, then judge what is left of a document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm import words as W

#: Phrases of site furniture, as folded words.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript",
    "sign in", "log in", "sign up", "click here", "read more", "share this", "powered by", "subscribe to our",
)
SYMBOLS = b"#*$%&|<>"
SEPARATORS = b"|<>"
#: Last bytes of a line that ends as a sentence: . ! ? " ' ) ] : ; and, by their last bytes, … ” ’ » and the full-width stops.
ENDS = b".!?\"')]:;"
WIDE_ENDS = {bytes(c, "utf-8")[-2:] for c in "…”’»。！？"}

METRICS = [
    ("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()),
    ("n_repeat_words", T.LongType()), ("n_lines", T.LongType()), ("n_lines_removed", T.LongType()),
    ("chars_left", T.LongType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType()), ("clean_text", T.StringType()),
]


def _class(members: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


_SYMBOL, _SEPARATOR, _END = _class(SYMBOLS), _class(SEPARATORS), _class(ENDS)
_WIDE_END = np.array([a[0] * 256 + a[1] for a in WIDE_ENDS])


def _phrase_hashes(phrases) -> list[np.ndarray]:
    out = []
    for p in phrases:
        data = np.frombuffer(p.encode(), np.uint8)
        out.append(W.tokenize(data, np.array([0, len(data)]), W.ALNUM).hashes)
    return out


def _repeats(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal (group, key) together, and where a run of equal ones begins in it."""
    order = np.lexsort((key, group))
    g, k = group[order], key[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
    return order, new


def clean(
    df: DataFrame,
    text: str = "text",
    out: str = "quality",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    max_lost_percent: int = 50,
    symbols_per_word: float = 0.5,
    separator_share: float = 0.4,
    shout_share: float = 0.5,
    short_line: int = 2,
    phrase_share: float = 0.4,
    phrases: tuple[str, ...] = BOILERPLATE,
) -> DataFrame:
    """Append struct ``out``: metrics of the whole text, the text without failing lines, and the verdict.

    A line with words fails if it has more symbols ``#*$%&|<>`` per word than
    ``symbols_per_word``; if at least ``separator_share`` of its words are menu
    separators (navigation); if boilerplate phrases cover at least ``phrase_share``
    of its words, counted as runs of letters and digits; if it shouts (``!!`` behind
    at least ``shout_share`` of its words); or if it has at most ``short_line`` words
    and doesn't end as a sentence does. A document is kept
    unless its base metrics fail or more than ``max_lost_percent`` of its word
    characters stood on failing lines.

    Every input row gives one row. A null text counts as empty: no words, base
    failed, clean_text ''. Line ends stay where they were; lines without words
    stay. Repeated rows are judged alike; a column already named ``out`` is replaced.
    """
    furniture = _phrase_hashes(phrases)

    def judge(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        n = len(offsets) - 1
        w = W.tokenize(data, offsets, W.PLAIN)
        counts, doc = w.counts, w.text_of
        lead = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
        symbol = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_SYMBOL[data], out=symbol[1:])
        chars = lead[w.ends] - lead[w.starts]
        word_chars = np.bincount(doc, chars, n).astype(np.int64)

        # lines: every text has one more line than line feeds
        breaks = np.flatnonzero(data == 10)
        line_start = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
        line_doc = np.sort(np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, "right") - 1]), kind="stable")
        line_end = np.empty_like(line_start)
        line_end[:-1] = line_start[1:] - (line_doc[1:] == line_doc[:-1])
        line_end[-1:] = len(data)
        at = np.searchsorted(w.starts, line_start)
        per_line = np.searchsorted(w.starts, line_end) - at
        worded = per_line > 0

        prefix = W.prefix_hash(data)
        k = np.flatnonzero(worded)
        order, new = _repeats(line_doc[k], W.range_hash(prefix, line_start[k], line_end[k]))
        dup_lines = np.bincount(line_doc[k][order[~new]], minlength=n)

        hashes, first = W.window_hashes(w, 3)
        covered = np.zeros(len(w.hashes) + 3, dtype=bool)
        if len(hashes):
            order, new = _repeats(doc[first], hashes)
            again = ~new
            twice = again.copy()
            twice[:-1] |= again[1:]
            for j in range(3):
                covered[first[order[twice]] + j] = True
        repeat_words = np.bincount(doc[covered[: len(doc)]], minlength=n)

        # line rules
        size = np.maximum(per_line, 1)
        length = line_end - line_start
        bad = symbol[line_end] - symbol[line_start] > symbols_per_word * size
        lone = (w.ends - w.starts == 1) & _SEPARATOR[data[w.starts]]
        runs = np.concatenate([[0], np.cumsum(lone)])
        bad |= runs[at + per_line] - runs[at] >= separator_share * size
        shout = np.zeros(len(w.starts), dtype=bool)
        two = w.ends - w.starts > 2
        shout[two] = (data[w.ends[two] - 1] == 33) & (data[w.ends[two] - 2] == 33)
        runs = np.concatenate([[0], np.cumsum(shout)])
        bad |= runs[at + per_line] - runs[at] >= shout_share * size
        last = np.zeros(len(line_start), np.int64)
        last[worded] = w.ends[(at + per_line - 1)[worded]] - 1
        ended = np.zeros(len(line_start), dtype=bool)
        if len(data):
            pair = data[np.maximum(last - 1, 0)].astype(np.int64) * 256 + data[last]
            ended = _END[data[last]] | np.isin(pair, _WIDE_END)
        bad |= (per_line <= short_line) & ~ended
        folded = W.tokenize(data, offsets, W.ALNUM)
        inside = np.zeros(len(folded.hashes), dtype=bool)
        for phrase in furniture:
            m = len(folded.hashes) - len(phrase) + 1
            if m > 0:
                hit = folded.hashes[:m] == phrase[0]
                for j in range(1, len(phrase)):
                    hit &= folded.hashes[j : j + m] == phrase[j]
                hit = np.flatnonzero(hit)
                here = np.searchsorted(line_start, folded.starts[hit], "right") - 1
                hit = hit[folded.ends[hit + len(phrase) - 1] <= line_end[here]]
                for j in range(len(phrase)):
                    inside[hit + j] = True
        runs = np.concatenate([[0], np.cumsum(inside)])
        at, stop = np.searchsorted(folded.starts, line_start), np.searchsorted(folded.starts, line_end)
        phrased = runs[stop] - runs[at]
        bad |= (phrased > 0) & (phrased >= phrase_share * (stop - at))
        bad &= worded & (length > 0)

        lost_words = np.repeat(bad, per_line)
        lost = np.bincount(doc[lost_words], chars[lost_words], n).astype(np.int64)
        failed = (counts < min_words) | (100 * repeat_words > max_repeat_percent * counts)
        kept = ~failed & (100 * lost <= max_lost_percent * word_chars)
        removed = np.bincount(line_doc[bad], minlength=n)

        raw = data.tobytes()
        texts = []
        edges = np.searchsorted(line_doc, np.arange(n + 1))
        for i in range(n):
            if not removed[i]:
                texts.append(raw[offsets[i] : offsets[i + 1]])
            else:
                texts.append(b"\n".join(raw[line_start[j] : line_end[j]] for j in range(edges[i], edges[i + 1]) if not bad[j]))
        longs = [counts, word_chars, np.diff(symbol[offsets]), dup_lines, repeat_words, np.diff(edges), removed, word_chars - lost]
        return [
            *(pa.array(x.astype(np.int64)) for x in longs), pa.array(failed), pa.array(kept),
            pa.array(texts, pa.binary()).cast(pa.string()),
        ]

    return df.withColumn(out, W.per_text(judge, METRICS, F.col(f"`{text}`")))
