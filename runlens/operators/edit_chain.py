"""Sequences of edits of documents, each applied to the text the one before it
left (F11-F13, W09 in turn).

Edits of one document depend on each other, those of different documents do
not.  Documents and edits are dealt by path and sorted by (path, seq), and one
pass over a sorted partition folds them: it holds the text of one document and
its history, and rows come in Arrow batches, so a document with any number of
edits is never gathered.  The history holds for each edit only what undoing it
takes (where, how much to drop, what to put back), not the text before, and the
text is held in pieces, so an edit does not copy all of it.

The text after every edit is a different matter: n edits of a text that they
make longer have versions of n * n characters.  Where all versions are asked for,
paths that have many bytes of them are folded first without writing a version
down: what comes out is how each edit changes the text and, now and then, the
text.  From one such text to the next is a segment, and segments are dealt to
tasks that make the versions.

The fold decides, and cuts out and numbers the lines to show; errors and
messages are written by Spark from what it found."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .docedit import MAX_RESPONSE_LEN, MSG, SNIPPET_LINES, TRUNCATED_MESSAGE

# Messages of the checks made before an edit.
CHECKS = {
    "missing": "The path %s does not exist. Please provide a valid path.",
    "unknown": "Unrecognized command %s. The allowed commands for the str_replace_based_edit_tool tool are: view, create, str_replace, insert, undo_edit",
    "no_old_str": "Parameter `old_str` is required for command: str_replace",
    "no_line": "Parameter `insert_line` is required for command: insert",
    "no_new_str": "Parameter `new_str` is required for command: insert",
    "no_text": "Parameter `file_text` is required for command: create",
}
EDIT_COLUMNS = {"seq": "long", "command": "string", "old": "string", "new": "string", "line": "long", "text": "string"}
FOUND = ("path string, seq long, command string, old string, line long, status string, lines array<long>, "
         "first long, shown string, depth long, last boolean, content string")
SEGMENTS = ("path string, segment long, nth long, seq long, command string, old string, line long, status string, lines array<long>, "
            "first long, shown string, depth long, last boolean, base binary, at long, drop long, put binary")
TYPES = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
PIECE = 32 << 10  # bytes of a piece of a text, about
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
MANY_BYTES = 64 << 20  # of versions of a path; beyond, they are made by tasks of their own
SEGMENT_BYTES, SEGMENT_VERSIONS, VERSION_COST = 64 << 20, 2048, 16 << 10  # least bytes and versions of a segment; what a version counts beside its bytes
FOLDERS, MAKERS, MOST_TASKS = 4, 32, 4096  # tasks a core that fold such paths, and that make their versions
WHOLE = -1  # where an edit that gives a text anew changes it


class Text:
    """A text as UTF-8 in pieces, each with its number of line feeds: a change
    copies the pieces it is in and passes over the others."""

    def __init__(self, data: bytes):
        self.pieces = [data[k:k + PIECE] for k in range(0, len(data), PIECE)] or [b""]
        self.feeds = [x.count(b"\n") for x in self.pieces]
        self.size, self.lines, self.tabs = len(data), sum(self.feeds) + 1, b"\t" in data
        self.hashed: str | None = None

    def whole(self) -> bytes:
        return b"".join(self.pieces)

    def digest(self) -> str:
        if self.hashed is None:
            md5 = hashlib.md5(usedforsecurity=False)
            for x in self.pieces:
                md5.update(x)
            self.hashed = md5.hexdigest()
        return self.hashed

    def start(self, line: int) -> int:
        """Where a line begins, the first being 0."""
        before = 0
        for x, feeds in zip(self.pieces, self.feeds):
            if line <= feeds:
                return before + sum(len(y) + 1 for y in x.split(b"\n", line)[:line])
            line -= feeds
            before += len(x)
        raise IndexError(line)

    def shown(self, start: int = 0, end: int | None = None) -> str:
        """What is between two places, no more than the tool may show and one
        character."""
        most = 4 * (MAX_RESPONSE_LEN + 1)  # a character has four bytes at most
        end = min(self.size if end is None else end, start + most)
        out, before = [], 0
        for x in self.pieces:
            if before >= end:
                break
            if before + len(x) > start:
                out.append(x[max(0, start - before):end - before])
            before += len(x)
        return b"".join(out).decode("utf-8", "ignore")[:MAX_RESPONSE_LEN + 1]  # the last character may be cut

    def splice(self, at: int, drop: int, put: bytes) -> bytes:
        """Replaces ``drop`` bytes at ``at`` by ``put``, and returns them."""
        k = before = 0
        while before + len(self.pieces[k]) < at:
            before += len(self.pieces[k])
            k += 1
        upto, end = k + 1, before + len(self.pieces[k])
        while end < at + drop:
            end += len(self.pieces[upto])
            upto += 1
        own = b"".join(self.pieces[k:upto])
        dropped, made = own[at - before:at - before + drop], b"".join((own[:at - before], put, own[at - before + drop:]))
        more = put.count(b"\n") - dropped.count(b"\n")
        if len(made) <= 2 * PIECE and (made or len(self.pieces) == upto - k):
            self.pieces[k:upto], self.feeds[k:upto] = [made], [sum(self.feeds[k:upto]) + more]
        else:
            self.pieces[k:upto] = parts = [made[x:x + PIECE] for x in range(0, len(made), PIECE)]
            self.feeds[k:upto] = [x.count(b"\n") for x in parts]
        self.size, self.lines, self.hashed = self.size + len(put) - drop, self.lines + more, None
        return dropped


class Document:
    """One document while its edits are folded.  ``change`` is what the last
    edit did to the text: (at, drop, put) in bytes, (WHOLE, 0, None) if the text
    is another one altogether, None if it is as it was."""

    def __init__(self, text: str | None):
        self.now = None if text is None else Text(text.encode())
        self.history, self.change = [], None

    @property
    def text(self) -> str | None:
        return None if self.now is None else self.now.whole().decode()

    def version(self, digest: bool) -> str | None:
        return self.text if self.now is None or not digest else self.now.digest()

    def _expanded(self) -> Text:
        return Text(self.text.expandtabs().encode()) if self.now.tabs else self.now

    def _splice(self, before: Text, at: int, drop: int, put: bytes) -> None:
        """``before`` with ``drop`` bytes at ``at`` replaced by ``put``; none of
        them has tabs."""
        self.change = (at, drop, put) if before is self.now else (WHOLE, 0, None)
        self.now, hashed = before, before.hashed
        self.history.append((at, len(put), before.splice(at, drop, put), hashed))

    def _around(self, line: int, added: int) -> str:
        upto = line + added + SNIPPET_LINES
        return self.now.shown(self.now.start(max(0, line - SNIPPET_LINES)), self.now.start(upto) - 1 if upto < self.now.lines else None)

    def replace(self, old: str, new: str | None):
        text, old, new = self._expanded(), old.expandtabs().encode(), (new or "").expandtabs().encode()
        before = text.whole()
        found = before.count(old)
        if found != 1:
            lines = [k for k, x in enumerate(before.split(b"\n"), 1) if old in x] if found else []
            return ("not_unique" if found else "not_found"), lines, None, None
        at = before.index(old)
        line = before.count(b"\n", 0, at)
        self._splice(text, at, len(old), new)
        return "replaced", [], max(0, line - SNIPPET_LINES) + 1, self._around(line, new.count(b"\n") + 1)

    def insert(self, line: int, new: str):
        text, new = self._expanded(), new.expandtabs().encode()
        if not 0 <= line <= text.lines:
            return "bad_insert", [text.lines], None, None
        if line == text.lines:
            self._splice(text, text.size, 0, b"\n" + new)
        else:
            self._splice(text, text.start(line), 0, new + b"\n")
        return "inserted", [], max(1, line - SNIPPET_LINES + 1), self._around(line, new.count(b"\n") + 1)

    def create(self, text: str):
        self.now, self.change = Text(text.encode()), (WHOLE, 0, None)
        self.history.append((0, None, text.encode(), None))  # undone, a new file is as it was created
        return "created", [], None, None

    def undo(self):
        if not self.history:
            return "no_history", [], None, None
        at, drop, put, hashed = self.history.pop()
        if drop is None:
            self.now, self.change = Text(put), (WHOLE, 0, None)
        else:
            self.now.splice(at, drop, put)
            self.now.hashed, self.change = hashed, (at, drop, put)
        return "undone", [], 1, self.now.shown()

    def apply(self, command, old, new, line, text):
        """(status, lines, first line shown, text shown) of one edit."""
        known = ("view", "create", "str_replace", "insert", "undo_edit")
        self.change = None
        if self.now is None and command != "create":
            return "missing", [], None, None
        if self.now is not None and command == "create":
            return "exists", [], None, None
        if command not in known:
            return "unknown", [], None, None
        for field, value, wanted in (("no_text", text, "create"), ("no_old_str", old, "str_replace"), ("no_line", line, "insert"), ("no_new_str", new, "insert")):
            if command == wanted and value is None:
                return field, [], None, None
        return {"view": lambda: ("viewed", [], 1, self.now.shown()), "create": lambda: self.create(text), "str_replace": lambda: self.replace(old, new),
                "insert": lambda: self.insert(line, new), "undo_edit": self.undo}[command]()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _batches(rows: Iterator[tuple[int, tuple]], schema: str) -> Iterator[pa.RecordBatch]:
    """Batches out of (bytes, row)."""
    names, types = zip(*((x.split()[0], TYPES[x.split()[1]]) for x in schema.split(", ")))
    out, held = [], 0
    batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=list(names))
    for size, row in rows:
        out.append(row)
        held += size
        if len(out) >= BATCH_ROWS or held > BATCH_BYTES:
            yield batch_of()
            out, held = [], 0
    if out:
        yield batch_of()


def _in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(document, path, whether it is its path's last, edit) for each edit out of
    rows sorted by path, documents first."""
    rows = _rows(batches)
    state, path, row = None, None, next(rows, None)
    while row is not None:
        at, is_edit, content, *edit = row
        if state is None or at != path:
            state, path = Document(None), at
        row = next(rows, None)
        if is_edit:
            yield state, path, row is None or row[0] != path, edit
        elif state.now is None:
            state.now = Text(content.encode())


def _numbered(shown: str | None, first: int | None) -> str | None:
    """``shown`` as the tool prints it: cut, tabs expanded, lines numbered.
    Tabs are left only in what ``undo_edit`` and ``create`` put back."""
    def expanded(line: str) -> str:  # a tab is counted from the start of its line, as by docedit.expand_tabs
        *heads, out = line.split("\t")
        before = ""
        for x in heads:
            before += x
            before += " " * (8 - len(before) % 8)
        return before + out

    if shown is None:
        return None
    if len(shown) > MAX_RESPONSE_LEN:
        shown = shown[:MAX_RESPONSE_LEN] + TRUNCATED_MESSAGE
    lines = shown.split("\n")
    if "\t" in shown:
        lines = map(expanded, lines)
    return "\n".join([f"{k:6d}\t{x}" for k, x in enumerate(lines, first)])


def _fold(batches: Iterator[pa.RecordBatch], every: bool, digest: bool) -> Iterator[pa.RecordBatch]:
    """One row for each edit."""
    def rows() -> Iterator[tuple[int, tuple]]:
        for state, path, last, (seq, command, old, new, line, text) in _in_turn(batches):
            status, lines, first, shown = state.apply(command, old, new, line, text)
            version, shown = state.version(digest) if every or last else None, _numbered(shown, first)
            yield len(version or "") + len(shown or ""), (path, seq, command, old, line, status, lines, first, shown, len(state.history), last, version)
    return _batches(rows(), FOUND)


def _segments(batches: Iterator[pa.RecordBatch], least_bytes: int, least_versions: int) -> Iterator[pa.RecordBatch]:
    """One row for each edit, with its change in place of the version and of
    what shows it; the first of a segment has the text before it (``base``)."""
    def rows() -> Iterator[tuple[int, tuple]]:
        own, segment, nth, spent = None, 0, 0, 0
        for state, path, last, (seq, command, old, new, line, text) in _in_turn(batches):
            size = state.now.size if state.now else 0
            begins = state is not own or spent > max(least_bytes, least_versions * size)
            if state is not own:
                own, segment, nth = state, 0, 0
            base = None
            if begins:
                segment, spent, base = segment + 1, 0, state.now and state.now.whole()
            status, lines, first, shown = state.apply(command, old, new, line, text)
            at, drop, put = state.change or (None, None, None)
            put = state.now.whole() if at == WHOLE else put
            shown = None if status in ("undone", "viewed") else shown
            nth, spent = nth + 1, spent + VERSION_COST + (state.now.size if state.now else 0)
            yield (len(base or b"") + len(put or b"") + len(shown or ""),
                   (path, segment, nth, seq, command, old, line, status, lines, first, shown, len(state.history), last, base, at, drop, put))
    return _batches(rows(), SEGMENTS)


def _made(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    """The rows of :func:`_fold`, all with their version, out of whole segments."""
    def rows() -> Iterator[tuple[int, tuple]]:
        own, text, before = None, None, []
        for path, segment, _, seq, command, old, line, status, lines, first, shown, depth, last, base, at, drop, put in _rows(batches):
            if (path, segment) != own:
                own, text, before = (path, segment), None if base is None else Text(base), []
            # the digests of the segment's texts that an undo may go back to
            hashed = before.pop() if status == "undone" and before else None
            if status in ("replaced", "inserted", "created"):
                before.append(None if at == WHOLE else text.hashed)
            if at == WHOLE:
                text = Text(put)
            elif at is not None:
                text.splice(at, drop, put)
                text.hashed = hashed
            shown = _numbered(text.shown() if status in ("undone", "viewed") else shown, first)
            version = None if text is None else text.digest() if digest else text.whole().decode()
            yield len(version or "") + len(shown or ""), (path, seq, command, old, line, status, lines, first, shown, depth, last, version)
    return _batches(rows(), FOUND)


def _message() -> Column:
    path = F.coalesce(F.col("path"), F.lit("None"))
    of = lambda what: F.concat(F.format_string(MSG["cat_n"], what), F.col("shown"), F.lit("\n"))
    edited = F.format_string(MSG["edited"], path)
    return (F.when(F.col("status") == "replaced", F.concat(edited, of(F.format_string(MSG["snippet_of"], path)), F.lit(MSG["review"])))
            .when(F.col("status") == "inserted", F.concat(edited, of(F.lit(MSG["snippet_edited"])), F.lit(MSG["review_insert"])))
            .when(F.col("status") == "viewed", of(path))
            .when(F.col("status") == "undone", F.concat(F.format_string(MSG["undone"], path), of(path)))
            .when(F.col("status") == "created", F.format_string(MSG["created"], path)))


def _error() -> Column:
    path = F.coalesce(F.col("path"), F.lit("None"))
    status = F.col("status")
    out = (F.when(status == "not_found", F.format_string(MSG["not_found"], F.col("old"), path))
           .when(status == "not_unique", F.format_string(MSG["not_unique"], F.col("old"), F.array_join(F.col("lines").cast("array<string>"), ", ")))
           .when(status == "bad_insert", F.format_string(MSG["bad_insert"], F.col("line"), F.element_at("lines", 1)))
           .when(status == "exists", F.format_string(MSG["exists"], path))
           .when(status == "no_history", F.format_string(MSG["no_history"], path))
           .when(status == "missing", F.format_string(CHECKS["missing"], path))
           .when(status == "unknown", F.format_string(CHECKS["unknown"], F.coalesce(F.col("command"), F.lit("None")))))
    for name in ("no_old_str", "no_line", "no_new_str", "no_text"):
        out = out.when(status == name, F.lit(CHECKS[name]))
    return out


def _many(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(many): paths whose versions may have over MANY_BYTES, as many times the
    text and all that is added to it as there are edits."""
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0)).cast("double")
    parts = asked.select(F.col("path").alias("many"), F.lit(1).alias("n"), (size("new") + size("text")).alias("size")).unionByName(
        docs.select(F.col("path").alias("many"), F.lit(0).alias("n"), size("content").alias("size")))
    return parts.groupBy("many").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).where(F.col("n") * F.col("size") > MANY_BYTES).select("many")


def edit_sequence(docs: DataFrame, edits: DataFrame, versions: bool = False, digest: bool = False) -> DataFrame:
    """Apply ``edits`` (path, seq, command, old, new, line, text; columns of a
    command that is never used may be missing) to ``docs`` (path, content),
    those of one path in order of seq.

    Commands are ``create`` (text), ``str_replace`` (old, new), ``insert``
    (line, new), ``undo_edit`` and ``view`` (which edits nothing).  A failed edit has an ``error`` and leaves
    document and history as they are; an applied one has a ``message``.  Undoing
    takes back the last edit not yet undone; like the tool's, the text it puts
    back has its tabs expanded, and undoing a creation leaves the file.

    One row an edit: path, seq, command, error, message, depth (edits that can
    be undone after it), last (of its path) and content: the text after the
    edit on a path's last row, null where there is none; with ``versions`` on
    every row.  With ``digest`` there is content_md5, the MD5 of that text, in
    its place: a version is hashed where it is made and goes no further.  Equal
    seq go by command, old, new, line, text.  Of documents
    with one path the least content counts; a null path names no document.
    Empty tables give empty tables, documents without edits no rows."""
    for name, kind in EDIT_COLUMNS.items():
        if name not in edits.columns:
            edits = edits.withColumn(name, F.lit(None).cast(kind))
    asked = edits.select(F.col("path").cast("string").alias("path"), *[F.col(c).cast(t).alias(c) for c, t in EDIT_COLUMNS.items()])
    docs = docs.select(F.col("path").cast("string").alias("path"), "content")  # nothing else, whatever its name
    order = list(EDIT_COLUMNS)
    by = ["path", "is_edit", *order, "content"]
    cores, least = docs.sparkSession.sparkContext.defaultParallelism, (SEGMENT_BYTES, SEGMENT_VERSIONS)

    def in_order(docs: DataFrame, asked: DataFrame, *tasks: int) -> DataFrame:
        rows = asked.select("path", F.lit(True).alias("is_edit"), F.lit(None).cast("string").alias("content"), *order)
        own = docs.join(asked.select("path").distinct(), "path", "left_semi")
        held = own.select("path", F.lit(False).alias("is_edit"), F.coalesce("content", F.lit("")).alias("content"),
                          *[F.lit(None).cast(EDIT_COLUMNS[c]).alias(c) for c in order])
        return rows.unionByName(held).repartition(*tasks, "path").sortWithinPartitions(*by)

    def folded(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(lambda batches: _fold(batches, versions, digest), FOUND)

    many = cut(_many(docs, asked), "edited") if versions else None
    if many is None or many.isEmpty():
        found = folded(in_order(docs, asked))
    else:
        of = lambda df, how: df.join(many, F.col("path").eqNullSafe(F.col("many")), how)
        # by number, which adaptive execution keeps: the rows are few bytes
        segments = (in_order(of(docs, "left_semi"), of(asked, "left_semi"), min(MOST_TASKS, FOLDERS * cores))
                    .mapInArrow(lambda batches: _segments(batches, *least), SEGMENTS))
        made = (segments.repartition(min(MOST_TASKS, MAKERS * cores), "path", "segment").sortWithinPartitions("path", "segment", "nth")
                .mapInArrow(lambda batches: _made(batches, digest), FOUND))
        found = folded(in_order(of(docs, "left_anti"), of(asked, "left_anti"))).unionByName(made)
    return found.select("path", "seq", "command", _error().alias("error"), _message().alias("message"), "depth", "last",
                        F.col("content").alias("content_md5" if digest else "content"))


def edited_documents(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, content, edits, failed, depth) after all ``edits``: documents
    without any stay as they are, created ones are added; a path whose edits
    all failed for want of a document gives no row."""
    done = edit_sequence(docs, edits)
    by = done.groupBy("path").agg(F.count(F.when(F.col("error").isNull(), 1)).alias("edits"), F.count("error").alias("failed"),
                                  F.max(F.when(F.col("last"), F.struct("depth", "content"))).alias("end"))
    none = F.lit(0).cast("long")
    rest = docs.select(F.col("path").cast("string").alias("path"), "content").join(edits.select(F.col("path").cast("string").alias("path")).distinct(), "path", "left_anti")
    return (by.where(F.col("end.content").isNotNull()).select("path", "end.content", "edits", "failed", "end.depth")
            .unionByName(rest.select("path", "content", none.alias("edits"), none.alias("failed"), none.alias("depth"))))
