"""Code symbol index: parents by span containment (J10), exact-name lookup
(P11), Python symbol extraction (X02), source-file scan, visibility filter,
language map and snapshot fingerprints (S06, P10, A10).
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, ship_package
from ..sources.named import list_files, read_listed

# File extension -> language of the symbol extractor.
EXTENSION_LANGUAGE = {
    ".py": "python", ".java": "java", ".cpp": "cpp", ".hpp": "cpp", ".c++": "cpp", ".cxx": "cpp",
    ".cc": "cpp", ".c": "c", ".h": "c", ".ts": "typescript", ".tsx": "typescript",
    ".js": "javascript", ".jsx": "javascript",
}
LINE_BUCKET = 64
BLOCK = 16  # buckets of lines whose spans are solved together
BLOCK_ROWS = 1 << 15  # rows of whole blocks that are solved at a time
FOUND = T.StructType([T.StructField(f"{k}_{n}", t) for k in "fc" for n, t in (("name", T.StringType()), ("start", T.LongType()), ("end", T.LongType()))])
FILE_SLOTS = 1 << 16  # files with containers over several blocks are told by a hash of so many values


# -- J10 ---------------------------------------------------------------------
def dyadic_ranges(low: Column, high: Column) -> Column:
    """The fewest ranges [index * 2^level, (index + 1) * 2^level) that make up
    ``low`` .. ``high`` (longs, both included), as array<struct<level, index>>:
    at most two of a level, 2 log2 of the length in all."""
    def at(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        first = F.call_function("shiftright", low + size - 1, level)
        end = F.call_function("shiftright", high + 1, level)
        node = lambda index: F.struct(level.alias("level"), index.alias("index"))
        own = F.array(F.when((first < end) & (first % 2 == 1), node(first)), F.when((first < end) & (end % 2 == 1), node(end - 1)))
        return F.filter(own, lambda x: x.isNotNull())

    one = F.array(F.struct(F.lit(0).alias("level"), low.alias("index")))
    return F.when(low == high, one).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), _top_level(low, high)), at)))


def _top_level(low: Column, high: Column) -> Column:
    """No larger dyadic range lies in ``low`` .. ``high``."""
    return F.floor(F.log2((high - low).cast("double") + 1.5)).cast("int")


def enclosing_symbol(spans: DataFrame, rule: str = "python", bucket: int = LINE_BUCKET,
                     functions: DataFrame | None = None) -> DataFrame:
    """Parent of every function span by containment inside its file.

    ``spans``: file_path, sid (unique per file), name, kind
    (function/class), start_line, end_line.  A span contains another when it
    starts no later and ends no earlier (and is a different span); the
    innermost container is the one starting last (then ending first, then
    lowest sid).  ``rule="python"``: with innermost function f and class c,
    f inside c gives ``parent_function=f``, otherwise ``parent_class=c``;
    with one of them, that one.  ``rule="nearest_class"`` (Java, C++,
    TS, JS methods): innermost class only.  ``rule="none"`` (C): no parent.

    ``functions`` limits the work to some of the functions of ``spans``; the
    plan is that of :func:`with_parents`."""
    keep = ["file_path", "sid", "name", "start_line", "end_line"]
    if rule == "none":
        fn = spans.where(F.col("kind") == "function") if functions is None else functions
        return fn.select(*keep, F.lit(None).cast("string").alias("parent_function"),
                         F.lit(None).cast("string").alias("parent_class"))
    seen = ["file_path", "sid", "name", "kind", "start_line", "end_line"]
    spans = spans.select(*seen)
    if functions is None:
        rows = with_parents(spans, rule, bucket).where(F.col("kind") == "function")
    else:
        wanted = functions.select(*[F.lit("function").alias(c) if c == "kind" else F.col(c) for c in seen])
        both = spans.withColumn("_asks", F.lit(False)).unionByName(wanted.withColumn("_asks", F.lit(True))).withColumn("_holds_", ~F.col("_asks"))
        rows = with_parents(both, rule, bucket, "_asks", "_holds_", "_asks").where("_asks")
    whole = F.col("file_path").isNotNull() & F.col("start_line").isNotNull() & F.col("end_line").isNotNull()
    return rows.where(whole).select(*keep, "parent_function", "parent_class")


def with_parents(spans: DataFrame, rule: str = "python", bucket: int = LINE_BUCKET, asks: str | None = None,
                 holds: str | None = None, kept: str | None = None) -> DataFrame:
    """``spans`` with parent_function and parent_class, null for what does not
    ask.  Boolean columns tell which rows ask for their parents (default: the
    functions), which are containers and which are wanted back (default: all);
    some of the containers come back besides.

    Spans are dealt once, by file and block of ``BLOCK`` buckets of lines, and
    each block is solved by itself (:func:`_innermost`): a container that starts
    in a function's block starts after all that come into it from earlier
    blocks.  The spans with their parents are written once.  Only where some
    container goes over the end of its block, functions that miss a parent are
    joined with these containers, on (file_path, level, index): a container's
    further blocks are made up of dyadic ranges (:func:`dyadic_ranges`), at most
    2 log2 of them however long it is, and a function probes the levels there
    are.  So even one huge file is spread over many tasks and join keys."""
    spark = spans.sparkSession
    ship_package(spark)
    size = BLOCK * bucket
    block = F.floor(F.col("start_line") / size).cast("bigint")
    last = F.greatest(block, F.floor(F.col("end_line") / size).cast("bigint"))
    kid = (F.col("kind") == "function") if asks is None else F.col(asks)
    rows = (spans.withColumn("_block", block).withColumn("_kid", F.coalesce(kid, F.lit(False)))
            .withColumn("_holds", F.coalesce(F.col(holds), F.lit(False)) if holds else F.lit(True)))
    schema = T.StructType([*rows.schema.fields, *FOUND.fields])
    rows = rows.repartition("file_path", "_block").sortWithinPartitions("file_path", "_block").mapInArrow(_innermost(bucket), schema)
    over = F.coalesce(F.col("_holds") & (last > F.col("_block")), F.lit(False))
    rows = cut(rows.where(F.col(kept) | over) if kept else rows, "spans")
    crossing = rows.where(over & F.col("sid").isNotNull() & F.col("file_path").isNotNull() & F.col("kind").isin("function", "class"))
    if not crossing.isEmpty():
        rows = _across(rows, crossing, block, last, bucket)
    f, c = F.col("f_start").isNotNull(), F.col("c_start").isNotNull()
    if rule == "nearest_class":
        pf, pc = F.lit(None).cast("string"), F.col("c_name")
    else:
        f_in_c = (F.col("f_start") >= F.col("c_start")) & (F.col("f_end") <= F.col("c_end"))
        pf = F.when(f & c, F.when(f_in_c, F.col("f_name"))).otherwise(F.col("f_name"))
        pc = F.when(f & c, F.when(~f_in_c, F.col("c_name"))).otherwise(F.col("c_name"))
    return rows.select(*spans.columns, pf.alias("parent_function"), pc.alias("parent_class"))


def _across(rows: DataFrame, crossing: DataFrame, block: Column, last: Column, bucket: int) -> DataFrame:
    """``rows`` with the parents that start in an earlier block filled in.  Of
    equal containers the one of the lowest id does; a table of at most
    ``FILE_SLOTS`` levels tells which files have any."""
    equal = Window.partitionBy("file_path", "kind", "start_line", "end_line").orderBy("sid")
    slot = F.pmod(F.xxhash64("file_path"), F.lit(FILE_SLOTS)).alias("_slot")
    levels = crossing.groupBy(slot).agg(F.max(_top_level(block + 1, last)).alias("_levels"))
    rows = rows.select("*", slot).join(F.broadcast(levels), "_slot", "left").drop("_slot")
    misses = F.coalesce(F.col("_kid") & F.col("_levels").isNotNull() & F.col("sid").isNotNull() & F.col("end_line").isNotNull() & (F.col("f_start").isNull() | F.col("c_start").isNull()), F.lit(False))
    open_ = rows.where(misses)
    parents = (crossing.withColumn("_nth", F.row_number().over(equal)).where("_nth = 1")
               .select("file_path", F.col("name").alias("p_name"), F.col("kind").alias("p_kind"), F.col("start_line").alias("p_start"), F.col("end_line").alias("p_end"),
                       F.col("sid").alias("p_sid"), F.explode(dyadic_ranges(block + 1, last)).alias("r")).select("*", "r.level", "r.index").drop("r"))
    kids = (open_.select("file_path", "sid", "start_line", "end_line", "_block", F.explode(F.sequence(F.lit(0), "_levels")).alias("level"))
            .withColumn("index", F.call_function("shiftright", F.col("_block"), F.col("level"))))
    same_bucket = F.floor(F.col("start_line") / bucket) <= F.floor(F.col("p_end") / bucket)
    pairs = kids.join(parents, ["file_path", "level", "index"]).where((F.col("p_end") >= F.col("end_line")) & ((F.col("end_line") >= F.col("start_line")) | same_bucket))
    rank = F.struct(F.col("p_start"), -F.col("p_end"), -F.col("p_sid"))
    info = F.struct(F.col("p_name").alias("name"), F.col("p_start").alias("s"), F.col("p_end").alias("e"))
    is_f, is_c = F.col("p_kind") == "function", F.col("p_kind") == "class"
    best = pairs.groupBy("file_path", "sid", "start_line", "end_line").agg(
        F.max_by(F.when(is_f, info), F.when(is_f, rank)).alias("_f"), F.max_by(F.when(is_c, info), F.when(is_c, rank)).alias("_c"))
    got = open_.join(best, ["file_path", "sid", "start_line", "end_line"], "left")
    for k in "fc":
        own = F.col(f"{k}_start").isNotNull()
        got = got.withColumns({f"{k}_{x}": F.when(own, F.col(f"{k}_{x}")).otherwise(F.col(f"_{k}")[y]) for x, y in (("name", "name"), ("start", "s"), ("end", "e"))})
    return rows.where(~misses).drop("_levels").unionByName(got.drop("_levels", "_f", "_c"))


def _innermost(bucket: int):
    """Spans sorted by file and block -> the same rows with the innermost
    function and class of their block that contain them, for rows with ``_kid``."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, enough = [], 0, BLOCK_ROWS
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < enough:
                continue
            table = pa.Table.from_batches(held)
            cut_at = int(np.flatnonzero(_starts(table))[-1])  # the last block may go on
            if cut_at:
                yield from _solved(table.slice(0, cut_at), bucket).to_batches()
            held, n = table.slice(cut_at).to_batches(), n - cut_at
            enough = max(BLOCK_ROWS, 2 * n)
        if n:
            yield from _solved(pa.Table.from_batches(held), bucket).to_batches()
    return each


def _starts(table: pa.Table) -> np.ndarray:
    """Where a file or block begins."""
    file = np.asarray(table.column("file_path").combine_chunks().dictionary_encode().indices.fill_null(-1))
    block = np.asarray(table.column("_block").fill_null(0))
    return np.r_[True, (file[1:] != file[:-1]) | (block[1:] != block[:-1])]


def _solved(table: pa.Table, bucket: int) -> pa.Table:
    """Rows are ranked by start, then by end from the last, then by id from the
    largest, as containers are preferred; equal spans make up one run.  A row's
    parent is the lowest other id of its run, or else the nearest run before it
    that ends no earlier."""
    group = np.cumsum(_starts(table))
    numbers = lambda c: np.asarray(table.column(c).cast(pa.int64()).fill_null(0))
    flags = lambda c: np.asarray(table.column(c).fill_null(False))
    start, end, sid = numbers("start_line"), numbers("end_line"), numbers("sid")
    whole = np.logical_and.reduce([np.asarray(table.column(c).is_valid()) for c in ("file_path", "start_line", "end_line", "sid")])
    kid, holds = flags("_kid") & whole, flags("_holds") & whole
    order = np.lexsort((-sid, -end, start, group))
    g, s, e = group[order], start[order], end[order]
    first = np.r_[True, (g[1:] != g[:-1]) | (s[1:] != s[:-1]) | (e[1:] != e[:-1])]
    run = np.cumsum(first) - 1
    at = np.flatnonzero(first)
    g, s, e = g[at], s[at], e[at]
    kids = np.flatnonzero(kid[order])
    asked, own = np.unique(run[kids]), sid[order][kids]
    out = table
    for k, kind in (("f", "function"), ("c", "class")):
        is_kind = np.asarray(pc.equal(table.column("kind"), kind).fill_null(False)) & holds
        rows = np.flatnonzero(is_kind[order])
        lowest, second = np.full(len(at), -1), np.full(len(at), -1)
        lowest[run[rows]] = rows  # the last of a run stays
        twin = np.flatnonzero(run[rows[1:]] == run[rows[:-1]]) if len(rows) else rows
        second[run[rows[twin]]] = rows[twin]
        behind = _nearest(np.unique(run[rows]), asked, g, s, e, bucket)
        parent = np.full(table.num_rows, -1)
        if len(rows):
            up = np.full(len(at), -1)
            up[asked] = np.where(behind >= 0, lowest[behind], -1)
            ids = sid[order]
            a, b = lowest[run[kids]], second[run[kids]]
            pick = np.where((a >= 0) & (ids[a] != own), a, np.where((b >= 0) & (ids[b] != own), b, up[run[kids]]))
            parent[order[kids]] = np.where(pick >= 0, order[pick], -1)
        taken = pa.array(parent, mask=parent < 0)
        for name, column, kind_of in (("name", "name", pa.string()), ("start", "start_line", pa.int64()), ("end", "end_line", pa.int64())):
            out = out.append_column(f"{k}_{name}", table.column(column).take(taken).cast(kind_of))
    return out


def _nearest(holders: np.ndarray, asked: np.ndarray, g: np.ndarray, s: np.ndarray, e: np.ndarray, bucket: int) -> np.ndarray:
    """For each run of ``asked`` the nearest run of ``holders`` before it, of its
    block, that ends no earlier, or -1.  A malformed span (end before start)
    covers the bucket of its start, and is covered by what reaches its bucket."""
    out = np.full(len(asked), -1)
    todo, step = np.arange(len(asked)), np.searchsorted(holders, asked) - 1
    while len(todo):
        ok = step >= 0
        todo, step = todo[ok], step[ok]
        r, h = asked[todo], holders[step]
        ok = g[r] == g[h]
        todo, step, r, h = todo[ok], step[ok], r[ok], h[ok]
        hit = (e[h] >= e[r]) & ((e[r] >= s[r]) | (s[r] // bucket <= np.maximum(s[h], e[h]) // bucket))
        out[todo[hit]] = h[hit]
        todo, step = todo[~hit], step[~hit] - 1
    return out


# -- P11 ---------------------------------------------------------------------
def symbol_lookup(functions: DataFrame, classes: DataFrame, lookups: DataFrame) -> DataFrame:
    """Exact-name lookups ``(identifier, entry_type)``: ``function`` =
    functions without a parent class (nested functions count),
    ``class_method`` = functions with one, with it in ``parent_class``;
    ``class`` = the class table, with its ``fields`` and ``methods``."""
    fl = lookups.where(F.col("entry_type").isin("function", "class_method"))
    none = F.lit(None).cast("string")
    f = functions.select(F.col("name").alias("identifier"), "file_path", "start_line", "end_line",
                         F.when(F.col("parent_class").isNull(), "function").otherwise("class_method")
                         .alias("entry_type"), "parent_class", none.alias("fields"), none.alias("methods"))
    c = classes.select(F.col("name").alias("identifier"), "file_path", "start_line", "end_line",
                       F.lit("class").alias("entry_type"), none.alias("parent_class"),
                       *[(F.col(x) if x in classes.columns else none).alias(x) for x in ("fields", "methods")])
    return (fl.join(f, ["identifier", "entry_type"])
            .unionByName(lookups.where(F.col("entry_type") == "class").join(c, ["identifier", "entry_type"])))


def lookup_in_spans(spans: DataFrame, lookups: DataFrame, rule: str = "python") -> DataFrame:
    """:func:`symbol_lookup` straight from spans: only functions that some
    lookup names get their parents."""
    names = lookups.where(F.col("entry_type").isin("function", "class_method")).select(F.col("identifier").alias("name")).distinct()
    wanted = spans.where(F.col("kind") == "function").join(names, "name", "left_semi")
    found = enclosing_symbol(spans, rule, functions=wanted)
    return symbol_lookup(found, spans.where(F.col("kind") == "class"), lookups)


# -- X02 ---------------------------------------------------------------------
SYMBOL_SCHEMA = ("file_path string, kind string, name string, start_line bigint, end_line bigint, "
                 "body string, methods string, error string")


def _params_text(lines: list[str], node) -> str:
    """The parameter list of a def as written, brackets included."""
    text = "\n".join(lines[node.lineno - 1:node.body[0].lineno])
    i = text.find("(", text.find("def ") + 4)
    depth, quote = 0, None
    for j in range(i, len(text)):
        ch = text[j]
        if quote:
            if ch == quote and text[j - 1] != "\\":
                quote = None
        elif ch in "'\"":
            quote = ch
        elif ch in "([{":
            depth += 1
        elif ch in ")]}":
            depth -= 1
            if depth == 0:
                return text[i:j + 1]
    return "()"


def _symbols_of(path: str, src: str) -> list[dict]:
    try:
        tree = ast.parse(src)
    except (SyntaxError, ValueError) as e:
        return [dict(file_path=path, kind="error", name=None, start_line=None, end_line=None,
                     body=None, methods=None, error=f"{type(e).__name__}: {e}")]
    lines = src.split("\n")
    out = []

    def seg(n) -> str:
        # the definition itself (decorator lines are not part of it)
        return "\n".join(lines[n.lineno - 1:n.end_lineno])

    for n in ast.walk(tree):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append(dict(file_path=path, kind="function", name=n.name, start_line=n.lineno,
                            end_line=n.end_lineno, body=seg(n), methods=None, error=None))
        elif isinstance(n, ast.ClassDef):
            ms = []
            for ch in n.body:
                if isinstance(ch, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    # a decorated method reports no return type (the wrapper node has none)
                    ret = (f" -> {ast.get_source_segment(src, ch.returns)}"
                           if ch.returns and not ch.decorator_list else "")
                    ms.append(f"- {ch.name}{_params_text(lines, ch)}{ret}")
            out.append(dict(file_path=path, kind="class", name=n.name, start_line=n.lineno,
                            end_line=n.end_lineno, body=seg(n), methods="\n".join(ms) or None, error=None))
    return out


def extract_symbols(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Python source rows -> function and class rows (1-based lines, class
    method signatures ``- name(params) -> ret``); an unparsable file gives
    one error row.  Runs per partition with the stdlib parser; feed the
    result to :func:`enclosing_symbol` for parents."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for p, s in zip(pdf[path], pdf[content]) for r in _symbols_of(p, s or "")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SYMBOL_SCHEMA.split(", ")])

    return files.select(path, content).mapInPandas(run, SYMBOL_SCHEMA)


# -- S06 / P10 ---------------------------------------------------------------
def language_of(path: Column) -> Column:
    ext = F.regexp_extract(path, r"(\.[^./]+)$", 1)
    m = F.create_map(*[x for k, v in EXTENSION_LANGUAGE.items() for x in (F.lit(k), F.lit(v))])
    return F.element_at(m, ext)


def visible(path: Column) -> Column:
    """Not hidden: the file name does not start with ``.`` and no directory
    under the root does."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return ~F.startswith(name, F.lit(".")) & ~F.contains(path, F.lit("/."))


def visible_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Hidden files and directories excluded, known extensions only, with
    their language."""
    return (files.withColumn("language", language_of(F.col(path)))
            .where(visible(F.col(path)) & F.col("language").isNotNull()))


def scan_source_files(spark, root: str, max_bytes: int = 1 << 30, listing: str = "spark") -> DataFrame:
    """Recursive scan of a source tree as (path, mtime, size, content).
    Files without a known extension are left out of the listing and files over
    ``max_bytes`` are skipped by their length, so neither is ever opened
    (:func:`oversized_files` lists the latter).

    Spark's own listing passes over names that begin with ``_``, so it has no
    ``__init__.py``; ``listing="tasks"`` (:mod:`runlens.sources.named`) has them,
    and deals the files to tasks by size."""
    if listing == "tasks":
        listed = visible_files(list_files(spark, root).where(F.col("size") <= max_bytes))
        read = read_listed(listed.select("path", "size", "mtime"))
        return visible_files(read.select("path", F.unix_timestamp("mtime").cast("bigint").alias("mtime"), "size", F.col("content").cast("string").alias("content")))
    raw = _source_listing(spark, root).where(F.col("length") <= max_bytes)
    df = raw.select(F.col("path"), F.unix_timestamp("modificationTime").cast("bigint").alias("mtime"),
                    F.col("length").alias("size"),
                    F.col("content").cast("string").alias("content"))
    return visible_files(df)


def _source_listing(spark, root: str) -> DataFrame:
    glob = "*{" + ",".join(EXTENSION_LANGUAGE) + "}"
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)


def oversized_files(spark, root: str, max_bytes: int = 1 << 30) -> DataFrame:
    """What ``scan_source_files`` skips: (path, size), contents not read."""
    return visible_files(_source_listing(spark, root).where(F.col("length") > max_bytes).select("path", F.col("length").alias("size")))


# -- A10 ---------------------------------------------------------------------
def snapshot_fingerprint(files: DataFrame, root: str = "root") -> DataFrame:
    """Order-independent content fingerprint of each file set from (path,
    mtime, size): the sum of two 60-bit slices of each entry's md5 plus the
    entry count.  It is a partial aggregate, so no file list is ever
    gathered in one place; any added, removed or changed entry changes it."""
    h = F.md5(F.concat_ws("|", F.col("path"), F.col("mtime").cast("string"), F.col("size").cast("string")))
    hi = F.conv(F.substring(h, 1, 15), 16, 10).cast("decimal(20,0)")
    lo = F.conv(F.substring(h, 16, 15), 16, 10).cast("decimal(20,0)")
    g = files.groupBy(root).agg(F.count(F.lit(1)).alias("files"), F.sum(hi).alias("_hi"),
                                F.sum(lo).alias("_lo"))
    return g.select(root, "files", F.concat_ws("-", F.col("files").cast("string"), F.col("_hi").cast("string"),
                                               F.col("_lo").cast("string")).alias("fingerprint"))


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files of ``new`` whose (path, mtime, size) is not in ``old``: the
    ones to re-extract."""
    k = ["path", "mtime", "size"]
    return new.join(old.select(*k), k, "left_anti")


def snapshot_key(commit: Column, status_text: Column, fingerprint: Column) -> Column:
    """Rebuild key of a source tree: ``git-clean-<commit>`` when the working
    tree is clean, ``git-dirty-<commit>-<md5(status)[:8]>`` when not, and
    ``metadata-<fingerprint>`` without git (commit null)."""
    dirty = F.coalesce(F.length(F.trim(status_text)), F.lit(0)) > 0
    return (F.when(commit.isNull(), F.concat(F.lit("metadata-"), fingerprint))
            .when(~dirty, F.concat(F.lit("git-clean-"), commit))
            .otherwise(F.concat(F.lit("git-dirty-"), commit, F.lit("-"), F.substring(F.md5(status_text), 1, 8))))


def output_digest(text: Column) -> Column:
    """sha256 of a run's output (UTF-8), to tell whether two runs printed the same."""
    return F.sha2(text, 256)


def refresh_symbol_index(index: DataFrame, old_files: DataFrame, new_files: DataFrame) -> DataFrame:
    """Rebuild only what changed: symbols of files whose (path, mtime, size)
    changed or that are new are extracted again, symbols of removed files
    are dropped, and the rest of ``index`` is kept as is."""
    changed = changed_files(old_files, new_files)
    gone = old_files.select("path").join(new_files.select("path"), "path", "left_anti")
    stale = changed.select("path").unionByName(gone).withColumnRenamed("path", "file_path")
    kept = index.join(stale, "file_path", "left_anti")
    return kept.unionByName(extract_symbols(changed), allowMissingColumns=True)
