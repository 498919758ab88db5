"""Rows of SQL dumps: CREATE TABLE and INSERT statements, cut and read in parallel.

A dump is read in splits. In the first scan each split tells, for every state of the
lexer that it may begin in (between tokens, in one of three kinds of quotes, in a
comment), the state behind it, and what statement is open there. In the last scan each
split reads its own statements and the tuples of a statement that began before, so
that even one INSERT over the whole file is worked on by all tasks. The few tuples that
splits share are put together from their parts.

Tuples of plain values are matched and cut in runs. They are kept some at a time in one
row until the statements that cannot be read are known.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.plans.shared import scratch_path, settle
from sightline.sources.split_text import in_order, located, stretches

DIALECTS = ("standard", "mysql")
BETWEEN, SINGLE, DOUBLE, TICK, COMMENT = range(5)
OPENERS = {b"'": SINGLE, b'"': DOUBLE, b"`": TICK, b"/": COMMENT}
CLOSERS = {SINGLE: b"'", DOUBLE: b'"', TICK: b"`", COMMENT: b"*/"}
#: Bytes of an open statement that are handed on to the next split. A longer one without VALUES is no INSERT of rows.
HEADER = 1 << 16
#: Tuples that are kept in one row, and about how many bytes of them.
TOGETHER, TOGETHER_BYTES = 64, 1 << 14
#: MySQL's escapes in strings; before any other character the backslash is dropped.
ESCAPES = {"0": "\0", "b": "\b", "n": "\n", "r": "\r", "t": "\t", "Z": "\x1a", "%": "\\%", "_": "\\_"}
SILENT = ("BEGIN", "COMMIT", "SET", "USE", "LOCK", "UNLOCK", "PRAGMA", "START")
CONSTRAINTS = ("PRIMARY", "FOREIGN", "UNIQUE", "CONSTRAINT", "CHECK", "KEY", "INDEX")
INSERT = re.compile(rb"\s*INSERT\s+(?:OR\s+\w+\s+|IGNORE\s+|LOW_PRIORITY\s+|DELAYED\s+|HIGH_PRIORITY\s+)*INTO\b", re.I)


class Lexer:
    """Tokens of one dialect: ``standard`` takes a backslash as plain text, ``mysql`` as an escape, and # as a comment."""

    def __init__(self, dialect: str = "standard"):
        if dialect not in DIALECTS:
            raise ValueError(f"dialect must be one of {', '.join(DIALECTS)}")
        self.dialect = dialect
        mysql = dialect == "mysql"
        single, double = (rb"(?:[^'\\]++|\\.|'')*+'", rb'(?:[^"\\]++|\\.|"")*+"') if mysql else (rb"(?:[^']++|'')*+'", rb'(?:[^"]++|"")*+"')
        tick, comment = rb"[^`]*+`", rb"(?:[^*]++|\*(?!/))*+\*/"
        line = rb"--[^\n]*+|#[^\n]*+" if mysql else rb"--[^\n]*+"
        strings = rb"'%b|\"%b|`%b" % (single, double, tick)
        special = rb"'\"`/#-" if mysql else rb"'\"`/-"
        self._close = {s: re.compile(p, re.S).match for s, p in ((SINGLE, single), (DOUBLE, double), (TICK, tick), (COMMENT, comment))}
        skipped = rb"%b|%b|/\*%b" % (strings, line, comment)
        self._code = re.compile(rb"(?:[^%b]++|%b|/(?!\*)|-(?!-))*+" % (special, skipped), re.S).match
        self._marks = re.compile(marks := rb"%b|[;()]|\bVALUES\b|['\"`]|/\*" % skipped, re.S | re.I).finditer
        flat = rb"\((?:[^();%b]++|%b|/(?!\*)|-(?!-))*+\)" % (special, skipped)
        self._flat = re.compile(flat, re.S).match
        # From one flat pair of parentheses on, all that leaves the depth as it was.
        self._sums = re.compile(rb"%b(?:[^();%b]++|%b|/(?!\*)|-(?!-)|%b)*+|%b" % (flat, special, skipped, flat, marks), re.S | re.I).finditer
        ended = rb"(?:[^;%b]++|%b|/(?!\*)|-(?!-))*+;" % (special, skipped)
        self.whole = re.compile(rb"(?:%b)*+" % ended, re.S).match
        self.ended = re.compile(ended, re.S).findall
        # A string, or a word that is one token but for a sign; more is left to ``tuple``.
        word = rb"[+-]?+(?![0-9.]+[eE][0-9]+\b[^\s,)])[^\s'\"`(),;/#+-]++"
        plain = rb"\(\s*+(?:'%b|%b)\s*+(?:,\s*+(?:'%b|%b)\s*+)*+\)" % (single, word, single, word)
        self.run = re.compile(rb"(?:[\s,]*+%b)*+" % plain, re.S).match
        self._cells = re.compile((rb"[(\s,]*+(?:'(%b)'|(%b))\s*+([,)])" % (single[:-1], word)).decode(), re.S | re.A).findall
        self._gap = re.compile(rb"(?:[\s,]++|%b|/\*%b)*+" % (line, comment), re.S).match
        self.tokens = re.compile(rb"%b|%b|/\*%b|[(),;]|[0-9.]+[eE][+-]?[0-9]+\b|[^\s'\"`(),;/-]+|[^\s]" % (strings, line, comment), re.S).finditer

    def begin(self, text: bytes, state: int) -> int | None:
        """Where the text is between tokens for the first time; None if nowhere."""
        if state == BETWEEN:
            return 0
        end = self._close[state](text) if CLOSERS[state] in text else None
        return None if end is None else end.end()

    def after(self, text: bytes, state: int) -> int:
        """The lexer's state behind the text."""
        at = self.begin(text, state)
        if at is None:
            return state
        end = self._code(text, at).end()
        return BETWEEN if end == len(text) else OPENERS[text[end : end + 1]]

    def marks(self, text: bytes, state: int, at: int = 0, runs: bool = False) -> Iterator[tuple[bytes, int, int]]:
        """(mark, begin, end) of semicolons, parentheses and VALUES in code, then (b"open", place, state) if the text ends inside of something.

        With ``runs``, pairs of parentheses without others inside are left out.
        """
        if state != BETWEEN:
            end = self._close[state](text, at)
            if end is None:
                yield b"open", at, state
                return
            at = end.end()
        for found in (self._sums if runs else self._marks)(text, at):
            run = len(found[0]) > 1 and found[0][:1] == b"("
            inside = (found,) if not run else self._marks(text, found.start(), found.end()) if b"VALUES" in found[0].upper() else ()
            for m in inside:
                t = m[0]
                if len(t) == 1 and t in b";()":
                    yield t, m.start(), m.end()
                elif t in (b"'", b'"', b"`", b"/*"):
                    yield b"open", m.start(), OPENERS[t[:1]]
                    return
                elif len(t) == 6 and t[:1] in b"vV":
                    yield b"VALUES", m.start(), m.end()

    def bare(self, text: bytes) -> bytes:
        """Text without comments."""
        return b" ".join(m[0] for m in self.tokens(text) if not m[0].startswith((b"--", b"/*")) and not (self.dialect == "mysql" and m[0][:1] == b"#"))

    def name(self, token: str) -> str:
        return token.strip('`"').split(".")[-1].strip('`"')

    def value(self, parts: list[str]) -> str | None:
        """The text of one value; an unquoted NULL is null."""
        if len(parts) == 1 and parts[0][:1] in "'\"":
            quote, inner = parts[0][0], parts[0][1:-1]
            if self.dialect == "mysql":
                return re.sub(rf"\\(.)|{quote}{quote}", lambda m: ESCAPES.get(m[1], m[1]) if m[1] else quote, inner, flags=re.S)
            return inner.replace(quote * 2, quote)
        text = " ".join(parts) if len(parts) > 1 and parts[0] not in "+-" else "".join(parts)
        return None if text.upper() == "NULL" or not parts else text

    def words(self, text: bytes) -> list[str]:
        found = (m[0] for m in self.tokens(text))
        return [t.decode("utf-8", "replace") for t in found if t[:2] not in (b"--", b"/*") and not (self.dialect == "mysql" and t[:1] == b"#")]

    def tuple(self, text: bytes) -> list[str | None]:
        """The values between the parentheses of a tuple."""
        out: list[list[str]] = [[]]
        depth = 0
        for t in self.words(text)[1:-1]:
            depth += (t == "(") - (t == ")")
            if t == "," and depth == 0:
                out.append([])
            else:
                out[-1].append(t)
        return [self.value(v) for v in out]

    def plain(self, text: bytes) -> list[list[str | None]]:
        """The values of each tuple of a run."""
        decoded = text.decode("utf-8", "replace")
        found = self._cells(decoded)
        if self.dialect == "mysql" and "\\" in decoded:
            found = [(self.value([f"'{s}'"]) if "\\" in s or "'" in s else s, w, end) for s, w, end in found]
        elif "''" in decoded:
            found = [(s.replace("''", "'"), w, end) for s, w, end in found]
        cells = [s if not w else None if w.upper() == "NULL" else w for s, w, _ in found]
        ends = [i for i, x in enumerate(found, 1) if x[2] == ")"]
        return [cells[a:b] for a, b in zip([0, *ends], ends)]

    def insert(self, header: bytes) -> tuple[str, list[str] | None] | None:
        """Table and columns of what stands in front of a statement's tuples."""
        words = self.words(header)
        at = next((i for i, t in enumerate(words) if t.upper() == "INTO"), None)
        if at is None or len(words) < at + 3 or not INSERT.match(self.bare(header)):
            return None
        rest = words[at + 2 : -1]
        while rest[:1] == ["."] and len(rest) > 1:
            words[at + 1], rest = rest[1], rest[2:]
        if rest and (rest[0] != "(" or rest[-1] != ")" or "(" in rest[1:]):
            return None
        return self.name(words[at + 1]), [self.name(t) for t in rest[1:-1] if t != ","] if rest else None

    def created(self, statement: bytes) -> tuple[str, list[str]] | None:
        """Table and columns of a CREATE TABLE statement."""
        words = self.words(statement)
        upper = [t.upper() for t in words[:6]]
        if upper[:1] != ["CREATE"] or "TABLE" not in upper or "(" not in words:
            return None
        at, depth, columns, fresh = words.index("("), 0, [], True
        for t in words[at:]:
            if depth == 1 and fresh and t not in "(),":
                columns.append(t)
                fresh = False
            depth += (t == "(") - (t == ")")
            fresh = fresh or (depth == 1 and t == ",")
            if depth == 0:
                break
        return self.name(words[at - 1]).lower(), [self.name(c) for c in columns if c.upper() not in CONSTRAINTS]


# ---- what is open behind a split ----------------------------------------------------


class Summary:
    """What a split does to the statement that is open where it begins."""

    def __init__(self, lexer: Lexer, state: int):
        self.lexer, self.state = lexer, state
        self.statements = self.depth = self.low = 0
        self.header, self.rows = b"", False

    def feed(self, text: bytes) -> None:
        at, state, begun = 0, BETWEEN, self.lexer.begin(text, self.state)
        if begun is None:
            state = self.state
        else:  # what stands in front of the last semicolon is over
            end = self.lexer.whole(text, begun).end()
            if end > begun:
                self.statements += len(self.lexer.ended(text, begun, end))
                self.depth = self.low = 0
                self.header, self.rows, at, begun = b"", False, end, end
            for mark, begin, end in self.lexer.marks(text, BETWEEN, begun, runs=True):
                if mark == b"open":
                    state = end
                elif mark == b"VALUES":
                    if not self.rows:
                        self.header, self.rows = (self.header + text[at:end])[: HEADER + 1], True
                else:
                    self.depth += 1 if mark == b"(" else -1
                    self.low = min(self.low, self.depth)
        if not self.rows:
            self.header = (self.header + text[at:])[: HEADER + 1]
        self.state = state

    def row(self) -> dict:
        return {"statements": self.statements, "depth": self.depth, "low": self.low, "header": self.header, "rows": self.rows}


CONTEXT = "state: int, depth: int, header: binary, rows: boolean, began: bigint, no: bigint, tuple_from: bigint, last: boolean"


def contexts(spark: SparkSession, path: str, lexer: Lexer) -> dict:
    """{(file, start): what is open where the split begins}, for splits that begin inside a statement or end a file inside one."""
    facts = "sums array<struct<statements: bigint, depth: int, low: int, header: binary, rows: boolean>>"
    kept = pa.struct([("statements", pa.int64()), ("depth", pa.int32()), ("low", pa.int32()), ("header", pa.binary()), ("rows", pa.bool_())])

    def surveyed(states: dict | None):
        """Sums of a split that begins between tokens and of one that begins in a string, or twice those of the state it is known to begin in."""

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict = {}
            for file, start, rows in stretches(batches):
                if (file, start) not in found:
                    begins = (BETWEEN, SINGLE) if states is None else (states.get((file, start), BETWEEN),)
                    found[file, start] = ([Summary(lexer, s) for s in begins], list(range(5)))
                summaries, behind = found[file, start]
                text = b"\n".join(rows.column(0).to_pylist()) + b"\n"
                if states is None:
                    behind[2:] = [lexer.after(text, s) for s in behind[2:]]
                for i, summary in enumerate(summaries):
                    summary.feed(text)
                    behind[i] = summary.state
            out = [{"file": f, "start": s, "behind": b, "sums": [x.row() for x in (x[0], x[-1])]} for (f, s), (x, b) in found.items()]
            kinds = [("file", pa.string()), ("start", pa.int64()), ("behind", pa.list_(pa.int32())), ("sums", pa.list_(kept))]
            yield pa.RecordBatch.from_pylist(out, pa.schema(kinds))

        return sums

    def lexed(state: dict, split: dict) -> tuple[dict | None, dict]:
        now = state["state"]
        return ({"state": now} if now else None), {"state": split["behind"][now]}

    def opened(state: dict, split: dict) -> tuple[dict | None, dict]:
        inside_now = bool(state["state"] or lexer.bare(state["header"]).strip())
        if not inside_now:  # a statement that follows is the split's own
            state = dict(state, header=b"", began=split["start"], no=0)
        told = {k: state[k] for k in ("state", "depth", "header", "rows", "began", "no", "tuple_from")}
        now = state["state"]
        behind = split["behind"][0 if again else now]
        split = split | split["sums"][min(now, SINGLE)]
        after = dict(state, state=behind)
        if split["statements"]:
            after |= {"depth": split["depth"], "header": split["header"], "rows": split["rows"], "began": split["start"], "no": split["statements"]}
            here = True
        else:
            here = state["depth"] + split["low"] <= 0
            after["depth"] += split["depth"]
            if not state["rows"]:
                after |= {"header": (state["header"] + split["header"])[: HEADER + 1], "rows": split["rows"]}
        after["tuple_from"] = None
        if after["depth"] > 0:
            after["tuple_from"] = split["start"] if here or state["tuple_from"] is None else state["tuple_from"]
        unfinished = split["last"] and bool(lexer.bare(after["header"]).strip())
        return ({**told, "last": split["last"]} if inside_now or unfinished else None), after

    kind = f"file string, start bigint, behind array<int>, {facts}"
    first = located(spark, path).mapInArrow(surveyed(None), kind).persist()  # one row a split
    try:
        states = {(r["file"], r["start"]): r["state"] for r in in_order(first, ["behind"], lambda: {"state": BETWEEN}, lexed, "state: int")}
        again = any(s > SINGLE for s in states.values())
        summed = first
        if again:  # some splits begin in other quotes or a comment: what they hold is summed up again from there
            summed = located(spark, path).mapInArrow(surveyed(states), kind)
        begin = lambda: {"state": BETWEEN, "depth": 0, "header": b"", "rows": False, "began": 0, "no": 0, "tuple_from": None}
        return {(r["file"], r["start"]): r.asDict() for r in in_order(summed, ["behind", "sums"], begin, opened, CONTEXT)}
    finally:
        first.unpersist()


# ---- rows ---------------------------------------------------------------------------


class Reader:
    """The statements and tuples of one split, fed with its text piece by piece.

    ``rows`` collects (kind, statement's split, number, table, names, tuples, rest);
    kinds are row, create and bad. ``parts`` collects the parts of tuples that other splits share.
    """

    def __init__(self, lexer: Lexer, start: int, context: dict | None):
        self.lexer, self.start, self.rows, self.parts = lexer, start, [], []
        self.context = c = context or {"state": BETWEEN, "depth": 0, "header": b"", "rows": False, "began": start, "no": 0, "tuple_from": None, "last": False}
        self.id, self.no = (c["began"], c["no"]), 0
        self.rest, self.state, self.depth, self.table = b"", BETWEEN, 0, None
        if c["rows"]:
            self.table = lexer.insert(c["header"])
            self.mode = "skip" if self.table is None else "shared" if c["tuple_from"] is not None else "tuples"
            self.state, self.depth = c["state"], c["depth"]
            self.seen = c["header"] if self.table is None else None
            if self.mode == "tuples" and self.state == COMMENT:
                self.rest = b"/*"
            elif self.mode == "tuples" and self.state != BETWEEN:  # quotes behind the tuples
                self.mode, self.seen = "skip", b""
        elif len(c["header"]) > HEADER:
            self.mode, self.state, self.seen = "skip", c["state"], c["header"]
        else:
            self.mode, self.rest, self.seen = "head", c["header"], None
        self.piece, self.singly = b"", 0

    def _next(self) -> None:
        self.no += 1
        self.id, self.mode, self.table, self.seen = (self.start, self.no), "head", None, None

    def _bad(self, text: bytes) -> None:
        told = " ".join(self.lexer.words(text[: 2 * HEADER]))[:200]
        self.rows.append(("bad", *self.id, None, None, None, told))

    def _other(self, text: bytes) -> None:
        """A statement that is no INSERT of tuples."""
        words = self.lexer.words(text[:4096])
        if not words:
            return
        made = self.lexer.created(text)
        if made is not None:
            self.rows.append(("create", *self.id, made[0], made[1], None, None))
        elif words[0].upper() not in (*SILENT, "CREATE"):
            self._bad(text)

    def _tuple(self, text: bytes) -> None:
        cells = self.lexer.tuple(text)
        table, names = self.table
        if names is not None and len(names) != len(cells):
            self._bad(text)
        else:
            self.rows.append(("row", *self.id, table, names, [cells], None))

    def _run(self, text: bytes) -> bool:
        """Plain tuples, some to a row; False if one has the wrong length."""
        tuples = self.lexer.plain(text)
        table, names = self.table
        if names is not None and any(len(t) != len(names) for t in tuples):
            return False
        step = max(1, min(TOGETHER, TOGETHER_BYTES * len(tuples) // len(text)))
        for _, same in groupby(tuples, len):
            listed = list(same)
            self.rows += [("row", *self.id, table, names, listed[i : i + step], None) for i in range(0, len(listed), step)]
        return True

    def feed(self, text: bytes) -> None:
        text, at, self.rest, self.singly = self.rest + text, 0, b"", 0
        while at is not None:
            at = getattr(self, "_" + self.mode)(text, at)

    def _head(self, text: bytes, at: int) -> int | None:
        """From a statement's beginning to its tuples or its end."""
        for mark, begin, end in self.lexer.marks(text, BETWEEN, at):
            if mark == b";":
                self._other(text[at:begin])
                self._next()
                return end
            if mark == b"VALUES":
                self.table = self.lexer.insert(text[at:end])
                if self.table is not None:
                    self.mode = "tuples"
                    return end
        self.rest = text[at:]
        return None

    def _tuples(self, text: bytes, at: int) -> int | None:
        if at >= self.singly:
            end = self.lexer.run(text, at).end()
            if end > at and self._run(text[at:end]):
                return end
            self.singly = end  # up to there, one tuple at a time
        at = self.lexer._gap(text, at).end()
        mark = text[at : at + 1]
        if mark == b";":
            self._next()
            return at + 1
        if mark == b"(":
            flat = self.lexer._flat(text, at)
            end = flat.end() if flat else self._closing(text, at, BETWEEN, 0)
            if end is None:
                self.rest = text[at:]
                return None
            self._tuple(text[at:end])
            return end
        if not mark or text[at : at + 2] == b"/*":
            self.rest = text[at:]
            return None
        self.mode, self.seen, self.state = "skip", text[at : at + HEADER], BETWEEN
        return at

    def _closing(self, text: bytes, at: int, state: int, depth: int) -> int | None:
        """Where the parentheses open at ``at`` are closed; None if they are not."""
        for mark, begin, end in self.lexer.marks(text, state, at):
            if mark == b"open":
                self.state = end
                self.depth = depth
                return None
            depth += (mark == b"(") - (mark == b")")
            if depth <= 0 and mark == b")":
                return end
        self.state, self.depth = BETWEEN, depth
        return None

    def _shared(self, text: bytes, at: int) -> int | None:
        """The rest of a tuple that began in an earlier split."""
        end = self._closing(text, at, self.state, self.depth)
        self.piece += text[at:end]
        self.rest = b""
        if end is None:
            return None
        self._part(self.context["tuple_from"])
        self.mode = "tuples"
        return end

    def _part(self, began: int) -> None:
        table, names = self.table
        self.parts.append((began, self.start, *self.id, table, names, self.piece))
        self.piece = b""

    def _skip(self, text: bytes, at: int) -> int | None:
        """To the end of a statement that cannot be read."""
        state, self.rest = BETWEEN, b""
        for mark, begin, end in self.lexer.marks(text, self.state, at):
            if mark == b";":
                self._unread()
                self.state = BETWEEN
                self._next()
                return end
            if mark == b"open":
                state = end
                if state != self.state or begin != at:
                    self.rest = text[begin:]
                    state = BETWEEN
        self.state = state
        return None

    def _unread(self) -> None:
        """A skipped statement is over."""
        if self.table is None and not INSERT.match(self.lexer.bare(self.seen)):
            self._other(self.seen)
        else:
            self._bad(self.seen)

    def finish(self) -> None:
        """The split's end: what is open goes to other splits, or ends with the file."""
        if self.piece:
            self._part(self.context["tuple_from"])
        elif self.mode == "tuples" and self.rest[:1] == b"(":
            if self.context["last"]:
                self._bad(self.rest)
            else:
                self.piece = self.rest
                self._part(self.start)
        if self.context["last"]:
            if self.mode == "head":
                opened = [m for m in self.lexer.marks(self.rest, BETWEEN) if m[0] == b"open"]
                self._bad(self.rest) if opened and opened[0][2] != COMMENT else self._other(self.rest)
            elif self.mode == "skip":
                self._unread()
        elif self.mode == "skip" and self.table is not None:  # other splits may take what follows for tuples
            self._bad(self.seen)


FOUND = [("kind", pa.string()), ("began", pa.int64()), ("no", pa.int64()), ("table_name", pa.string()), ("names", pa.list_(pa.string())),
         ("tuples", pa.list_(pa.list_(pa.string()))), ("rest", pa.string()), ("tuple_from", pa.int64()), ("start", pa.int64()), ("part", pa.binary()),
         ("width", pa.int32()), ("n", pa.int32()), ("file", pa.string())]
FOUND_DDL = """kind string, began bigint, no bigint, table_name string, names array<string>, tuples array<array<string>>, rest string,
    tuple_from bigint, start bigint, part binary, width int, n int, file string"""


def _told(reader: Reader, file: str) -> pa.RecordBatch:
    """What a reader has collected, which it then forgets; n tuples of ``width`` values to a row."""
    out = [(*r, None, None, None, len(r[5][0]) if r[5] else None, len(r[5] or ()), file) for r in reader.rows]
    out += [("part", *p[2:6], None, None, p[0], p[1], p[6], None, 0, file) for p in reader.parts]
    reader.rows.clear()
    reader.parts.clear()
    columns = zip(*out) if out else [()] * len(FOUND)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, FOUND)], [name for name, _ in FOUND])


def stored(spark: SparkSession, path: str, lexer: Lexer) -> DataFrame:
    """Tuples, created tables and statements that cannot be read, each with its statement (file, began, no), written once to shared storage."""
    known = contexts(spark, path, lexer)
    folder = scratch_path(spark, "dump")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reader = None, None
        for file, start, lines in chain(stretches(batches), [(None, None, None)]):
            if (file, start) != key:
                if reader is not None:
                    reader.finish()
                    yield _told(reader, key[0])
                key = (file, start)
                reader = None if file is None else Reader(lexer, start, known.get(key))
            if reader is None:
                continue
            for low in range(0, lines.num_rows, 2000):
                reader.feed(b"\n".join(lines.column(0).slice(low, 2000).to_pylist()) + b"\n")
                yield _told(reader, file)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                reader = Reader(lexer, r["began"], None)
                reader.id, reader.table, reader.mode = (r["began"], r["no"]), (r["table_name"], r["names"]), "tuples"
                text = b"".join(p["part"] for p in r["parts"])
                reader.feed(text)
                if reader.rest.strip() or reader.mode != "tuples":  # the file ends inside it, or it is no tuple
                    reader._bad(text)
                yield _told(reader, r["file"])

    located(spark, path).mapInArrow(read, FOUND_DDL).write.parquet(f"{folder}/whole")
    whole = spark.read.schema(FOUND_DDL).parquet(f"{folder}/whole")
    if not any(c["tuple_from"] is not None for c in known.values()):
        return whole.where("kind <> 'part'")
    first = F.sort_array(F.collect_list(F.struct("start", "part"))).alias("parts")
    joined = whole.where("kind = 'part'").groupBy("file", "tuple_from", "began", "no", "table_name", "names").agg(first)
    joined.select("file", "began", "no", "table_name", "names", "parts").mapInArrow(parse, FOUND_DDL).write.parquet(f"{folder}/joined")
    return spark.read.schema(FOUND_DDL).parquet(f"{folder}/whole", f"{folder}/joined").where("kind <> 'part'")


def units(spark: SparkSession, path: str, lexer: Lexer) -> DataFrame:
    """``stored`` with a row for each tuple."""
    return stored(spark, path, lexer).select("kind", "file", "began", "no", "table_name", "names", F.explode_outer("tuples").alias("cells"), "rest")


def dump_runs(spark: SparkSession, path: str, dialect: str = "standard") -> DataFrame:
    """``dump_rows`` with several tuples of a table to a row: table_name, names, n, width, tuples, rest."""
    found = stored(spark, path, Lexer(dialect))
    statement = ["file", "began", "no"]
    rows = found.where("kind = 'row'")
    created = found.where("kind = 'create'").groupBy(F.col("table_name").alias("created")).agg(F.min_by("names", F.struct(*statement)).alias("columns"))
    settled, fits = settle(created)
    rows = rows.join(F.broadcast(settled) if fits else settled, F.lower("table_name") == F.col("created"), "left")
    rows = rows.withColumn("names", F.coalesce("names", "columns")).drop("created", "columns")
    failed = found.where("kind = 'bad'").select(*statement, "rest")
    odd = rows.where(F.col("names").isNotNull() & (F.size("names") != F.col("width")))
    if not odd.isEmpty():
        told = F.transform("tuples", lambda t: F.array_join(F.transform(t, lambda c: F.coalesce(c, F.lit("NULL"))), ", ").substr(1, 200))
        failed = failed.unionByName(odd.select(*statement, F.array_max(told).alias("rest")))
    failed = failed.groupBy(*statement).agg(F.max("rest").alias("rest"))
    settled, fits = settle(failed)
    good = rows.join(F.broadcast(settled.select(*statement)) if fits else settled.select(*statement), statement, "left_anti")
    columns = [("table_name", "string"), ("names", "array<string>"), ("n", "int"), ("width", "int"), ("tuples", "array<array<string>>")]
    good = good.select(*[name for name, _ in columns], F.lit(None).cast("string").alias("rest"))
    return good.unionByName(settled.select(*[F.lit(None).cast(kind).alias(name) for name, kind in columns], "rest"))


def dump_rows(spark: SparkSession, path: str, dialect: str = "standard") -> DataFrame:
    """One row per value tuple of INSERT statements: table_name, names, cells; per other statement, ``rest``.

    Quoted values may hold anything, doubled quotes included; with ``dialect="mysql"``
    backslashes escape and are decoded. cells are the values' texts; an unquoted NULL is null.
    names is null where a statement has no column list, unless the files create the
    table. ``rest`` holds the beginning of what is neither INSERT, CREATE, comment nor
    transaction keyword; a statement with a tuple of the wrong length or with
    anything behind its tuples is left out whole. The rows found are written once to shared storage.
    """
    return dump_runs(spark, path, dialect).select("table_name", "names", F.explode_outer("tuples").alias("cells"), "rest")
