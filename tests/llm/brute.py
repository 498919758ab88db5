"""Plain Python versions of the operators, one document at a time."""

import base64
import hashlib
import heapq
import math
import re
import zlib
from collections import Counter

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(x: bytes | str) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def shingles(text, size):
    w = SPACED.findall((text or "").translate(FOLD))
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def near(docs: dict, size: int) -> dict:
    """id -> (n_shingles, component_id)."""
    sets = {i: shingles(t, size) for i, t in docs.items()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[:n]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if 5 * small >= 4 * large:
                common = len(sets[a] & sets[b])
                if 100 * common >= 80 * (small + large - common):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def repeats(docs: dict, length: int = 400) -> dict:
    """id -> (n_bytes, n_removed, n_spans, kept bytes)."""
    data = {i: (t or "").encode() for i, t in docs.items()}
    seen = Counter(b[j : j + length] for b in data.values() for j in range(len(b) - length + 1))
    out = {}
    for i, b in data.items():
        spans = []
        for j in range(len(b) - length + 1):
            if seen[b[j : j + length]] > 1:
                if spans and j <= spans[-1][1]:
                    spans[-1][1] = j + length
                else:
                    spans.append([j, j + length])
        edges = [0, *[x for s in spans for x in s], len(b)]
        kept = b"".join(b[x:y] for x, y in zip(edges[::2], edges[1::2]))
        out[i] = (len(b), len(b) - len(kept), len(spans), kept)
    return out


def leaks(docs: dict, items: dict, window: int = 10) -> dict:
    """id -> (n_words, n_hit, sorted item ids)."""
    windows: dict = {}
    for i, text in items.items():
        w = ALNUM.findall((text or "").translate(FOLD))
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add(str(i))
    sizes = {len(k) for k in windows}
    out = {}
    for i, text in docs.items():
        w, hit, ids = ALNUM.findall((text or "").translate(FOLD)), set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if (k := tuple(w[j : j + n])) in windows:
                    hit |= set(range(j, j + n))
                    ids |= windows[k]
        out[i] = (len(w), len(hit), sorted(ids))
    return out


SECRETS = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile("[0-9a-f]+"), 0, 16),
)


def secrets(text) -> list[tuple[int, int, str]]:
    out = []
    for k, (name, pattern, group, least) in enumerate(SECRETS):
        out += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return sorted(out)


def line_metrics(text) -> tuple:
    text = text or ""
    w = SPACED.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), failed


def payload(html) -> tuple[int, str]:
    b = (html or "").encode()
    return len(b), base64.b32encode(hashlib.sha1(b).digest()).decode()


def ranking(docs: list, items: list, k: int = 50) -> dict:
    """(item, text) -> [(rank, doc_id, score)] of (id, text) pairs."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    said = [(i, Counter(term.findall((t or "").translate(FOLD)))) for i, t in docs]
    total = sum(sum(c.values()) for _, c in said)
    n_docs = sum(bool(c) for _, c in said)
    df = Counter(w for _, c in said for w in c)
    out = {}
    for item in set(items):
        asked, found = set(term.findall((item[1] or "").translate(FOLD))), []
        for i, c in said:
            score = 0
            for w in asked & set(c):
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                m = 50 + 50 * sum(c.values()) * n_docs // total
                score += weight * (1_000_000_000 * c[w] // (1000 * c[w] + 20 * m))
            if score > 0:
                found.append((-score, (i is not None, i or 0), i))
        out[item] = [(r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found)[:k])]
    return out


def damage(rows: list) -> list:
    """(conv, turn, role, text) after the planted faults."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def repair(rows: list) -> tuple:
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired turns) of one conversation's (turn, role, text).

    All edits are tried in order of cost and then of their letters.
    """
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    known = {t for t, _, _ in rows if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    onward = {"": "u", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, said = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        name = {"u": "user", "a": "assistant"}[onward[state]]
        heapq.heappush(heap, (cost + 3, audit + "I", i, onward[state], (*said, (name, ""))))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, said))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] == "truncated" else 0
                heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, onward[state], (*said, (name, text))))
                if role[:1] == onward[state] or (state, role[:1]) == ("", "s"):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*said, (role, text))))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, list(said))
