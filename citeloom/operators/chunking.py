"""Files to addressable chunks: windows, paragraphs, Markdown sections, code symbols.

Input: id, file_path, content. Output columns: see ``CHUNK``. Offsets count
characters. Prose and windows are built-in functions; only code, whose grammar
needs a parser, goes through Python.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.config import SETTINGS
from citeloom.functions.text import trimmed
from citeloom.operators import typescript

CHUNK = ("id", "file_path", "symbol", "parent", "language", "byte_start", "byte_end", "content", "content_hash")
STEP = SETTINGS.window - SETTINGS.overlap


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def _windows(start: Column, end: Column) -> Column:
    """(s, e) windows of a span: one if it fits, else overlapping ones, the last ending with the span."""
    size = end - start
    starts = F.filter(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(STEP)), lambda s: (s == 0) | (s < size - SETTINGS.overlap))
    spans = F.transform(starts, lambda s: F.struct((start + s).alias("s"), F.least(start + s + SETTINGS.window, end).alias("e")))
    return F.filter(spans, lambda w: w["e"] > w["s"])


def _chunks(spans: DataFrame, language: Column) -> DataFrame:
    """Rows with content, symbol, parent and a column ``w`` of windows, as chunks."""
    each = spans.withColumn("w", F.explode("w"))
    body = F.substring(F.col("content"), F.col("w.s") + 1, F.col("w.e") - F.col("w.s"))
    return each.select(
        "id", "file_path", "symbol", "parent", language.alias("language"),
        F.col("w.s").cast("int").alias("byte_start"), F.col("w.e").cast("int").alias("byte_end"), body.alias("content"), F.sha2(body, 256).alias("content_hash"),
    )


def windows(files: DataFrame) -> DataFrame:
    """Overlapping windows of files of no known kind."""
    ext = extension(F.col("file_path"))
    none = F.lit(None).cast("string")
    spans = files.withColumns({"symbol": none, "parent": none, "w": _windows(F.lit(0), F.length("content"))})
    return _chunks(spans, F.concat(F.lit("unknown("), F.when(ext == "", "no-ext").otherwise(ext), F.lit(")")))


def paragraphs(files: DataFrame) -> DataFrame:
    """Paragraphs merged in order up to a soft size, oversized groups in windows."""
    parts = F.regexp_extract_all("content", F.lit(r"(?s)(.*?\n\s*\n|.+$)"), 1)
    lengths = F.transform(F.filter(parts, lambda p: p != ""), F.length)
    start = F.struct(F.lit(0).alias("g"), F.lit(0).alias("c"), F.array().cast("array<struct<s:int,e:int>>").alias("o"))

    def step(state: Column, n: Column) -> Column:
        end = state["c"] + n
        full = (state["c"] > state["g"]) & (end - state["g"] > SETTINGS.paragraph_group)
        closed = F.array_append(state["o"], F.struct(state["g"].alias("s"), state["c"].alias("e")))
        return F.struct(F.when(full, state["c"]).otherwise(state["g"]).alias("g"), end.alias("c"), F.when(full, closed).otherwise(state["o"]).alias("o"))

    size = F.length("content")
    groups = F.aggregate(lengths, start, step, lambda s: F.when(size > s["g"], F.array_append(s["o"], F.struct(s["g"].alias("s"), size.alias("e")))).otherwise(s["o"]))
    none = F.lit(None).cast("string")
    spans = files.withColumns({"symbol": none, "parent": none, "w": F.flatten(F.transform(groups, lambda g: _windows(g["s"], g["e"])))})
    return _chunks(spans, F.lit("text"))


# Fixed value: the form of a heading line.
HEADING = r"^(#{1,6})[ \t]+([^\n]+?)[ \t]*$"


def headings(files: DataFrame) -> DataFrame:
    """(id, file_path, content, nth, at, depth, title): headings outside fenced code, with where they begin."""
    lines = files.select("id", "file_path", "content", F.posexplode(F.split("content", "\n")).alias("n", "line"))
    order = Window.partitionBy("id").orderBy("n")
    fence = F.regexp_replace("line", r"^\s+", "").rlike(r"^(`{3,}|~{3,})")
    lines = lines.withColumns({
        "at": F.coalesce(F.sum(F.length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "fences": F.sum(fence.cast("int")).over(order),
        "fence": fence,
    })
    title = trimmed(F.regexp_replace(F.regexp_extract("line", HEADING, 2), r"[ \t]+#+[ \t]*$", ""))
    found = lines.filter(~F.col("fence") & (F.col("fences") % 2 == 0) & F.col("line").rlike(HEADING)).withColumn("title", title).filter("title != ''")
    return found.select("id", "file_path", "content", "n", "at", F.length(F.regexp_extract("line", HEADING, 1)).alias("depth"), "title")


def markdown(files: DataFrame) -> DataFrame:
    """Sections by heading, with the title of the nearest heading above of smaller depth as parent."""
    found = headings(files).select("id", "n", "at", "depth", "title")
    order = Window.partitionBy("id").orderBy("n")
    # The last heading of each smaller depth so far; the nearest of them is the parent.
    above = [F.last(F.when(F.col("depth") <= d, F.struct("n", "title")), True).over(order.rowsBetween(Window.unboundedPreceding, -1)) for d in range(1, 6)]
    parent = F.when(F.col("depth") == 1, F.lit(None).cast("string"))
    for d in range(2, 7):
        parent = parent.when(F.col("depth") == d, above[d - 2]["title"])
    sections = found.select("id", "at", F.lead("at").over(order).alias("next"), "title", parent.alias("parent"), F.first("at").over(order).alias("first"))
    titled = files.join(sections, "id").select("id", "file_path", "content", F.col("title").alias("symbol"), "parent", F.col("at").alias("s"), F.coalesce("next", F.length("content")).alias("e"))
    starts = sections.groupBy("id").agg(F.min("first").alias("first"))
    none = F.lit(None).cast("string")
    rest = files.join(starts, "id", "left").withColumn("e", F.coalesce("first", F.length("content")))
    lead = rest.select("id", "file_path", "content", none.alias("symbol"), none.alias("parent"), F.lit(0).cast("bigint").alias("s"), F.col("e").cast("bigint").alias("e"))
    spans = titled.unionByName(lead).withColumn("w", _windows(F.col("s"), F.col("e")))
    return _chunks(spans, F.lit("markdown"))


Symbol = tuple[str, str | None, int, int]


def python_symbols(source: str) -> list[Symbol]:
    """Functions and classes in order, each with its nearest enclosing class; ranges leave decorators out."""
    starts = [0]
    for line in source.splitlines(keepends=True):
        starts.append(starts[-1] + len(line))

    def place(line: int, column: int) -> int:
        text = source[starts[line - 1] : starts[line]]
        return starts[line - 1] + len(text.encode()[:column].decode(errors="ignore"))

    found: list[Symbol] = []

    def visit(node: ast.AST, owner: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            inside = owner
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                found.append((child.name, owner, place(child.lineno, child.col_offset), place(child.end_lineno, child.end_col_offset)))
                inside = child.name if isinstance(child, ast.ClassDef) else owner
            visit(child, inside)

    visit(ast.parse(source), None)
    return found


@dataclass(frozen=True)
class Plugin:
    """A language: the extensions of its files, and what finds the symbols of a source."""

    language: str
    extensions: tuple[str, ...]
    parse: Callable[[str, str], list[Symbol]]  # of the source and the file's lower-case extension


PLUGINS = (
    Plugin("python", (".py",), lambda source, _: python_symbols(source)),
    Plugin("typescript", (".ts", ".tsx"), lambda source, ext: typescript.symbols(source, ext == ".tsx")),
)


def _extensions(plugins: tuple[Plugin, ...]) -> list[str]:
    return [e for p in plugins for e in p.extensions]


def symbols(files: DataFrame, plugins: tuple[Plugin, ...] = PLUGINS) -> DataFrame:
    """Chunks of source files by symbol; a file that does not parse, or has no symbol, is cut in windows.

    The parser of a language sees one file at a time; everything else is in Spark.
    """
    known = {e: p for p in plugins for e in p.extensions}
    symbol = pa.list_(pa.struct([("symbol", pa.string()), ("parent", pa.string()), ("s", pa.int32()), ("e", pa.int32())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for ext, content in zip(batch.column("ext").to_pylist(), batch.column("content").to_pylist()):
                try:
                    found = known[ext].parse(content, ext)
                except (SyntaxError, ValueError, RecursionError):
                    found = []
                made.append([dict(zip(("symbol", "parent", "s", "e"), f)) for f in found])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, symbol)], names=[*batch.schema.names, "found"])

    ext = extension(F.col("file_path"))
    coded = files.select("id", "file_path", "content", ext.alias("ext")).filter(F.col("ext").isin(*known) & F.col("content").isNotNull())
    id_type = files.schema["id"].dataType.simpleString()
    parsed = coded.mapInArrow(each, f"id {id_type}, file_path string, content string, ext string, found array<struct<symbol:string,parent:string,s:int,e:int>>")
    language = F.element_at(F.create_map(*[F.lit(x) for e, p in known.items() for x in (e, p.language)]), F.col("ext"))
    spans = parsed.select("id", "file_path", "content", language.alias("language"), F.explode_outer("found").alias("f"))
    whole = F.when(F.col("f").isNotNull(), F.array(F.struct(F.col("f.s").alias("s"), F.col("f.e").alias("e")))).otherwise(_windows(F.lit(0), F.length("content")))
    return _chunks(spans.select("id", "file_path", "content", "language", F.col("f.symbol").alias("symbol"), F.col("f.parent").alias("parent"), whole.alias("w")), F.col("language"))


def chunk_files(files: DataFrame, code: bool = True, plugins: tuple[Plugin, ...] = PLUGINS) -> DataFrame:
    """Every file by the chunker of its extension; files with a NUL are binary and give none."""
    ext = extension(F.col("file_path"))
    good = files.select("id", "file_path", "content").filter(F.col("content").isNotNull() & (F.instr("content", "\0") == 0))
    prose, marked, coded = ext.isin(".txt", ".rst", ".adoc"), ext.isin(".md", ".mdx", ".markdown"), ext.isin(*_extensions(plugins))
    out = paragraphs(good.filter(prose)).unionByName(markdown(good.filter(marked))).unionByName(windows(good.filter(~prose & ~marked & ~coded)))
    return out.unionByName(symbols(good.filter(coded), plugins)) if code else out


def doc_sections(files: DataFrame) -> DataFrame:
    """Decision drafts of documents: one per second-level heading, or one of the whole file without any."""
    lines = files.select("id", "file_path", "content", F.posexplode(F.split("content", r"\r?\n")).alias("n", "line"))
    title = trimmed(F.regexp_replace(F.regexp_extract("line", r"^##[ \t]+([^\n]+?)[ \t]*$", 1), r"[ \t]+#+[ \t]*$", ""))
    order = Window.partitionBy("id").orderBy("n")
    lines = lines.withColumn("title", F.when(title != "", title)).withColumn("section", F.count("title").over(order))
    has = F.max("section").over(Window.partitionBy("id"))
    lines = lines.withColumn("sections", has).filter((F.col("section") > 0) | (F.col("sections") == 0))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    grouped = lines.groupBy("id", "file_path", "section").agg(F.first("title", True).alias("title"), F.min("n").alias("n"), body.alias("body"))
    summary = trimmed(F.col("body"))
    cut = F.when(F.length(summary) > SETTINGS.summary_chars, F.concat(F.substring(summary, 1, SETTINGS.summary_chars - 1), F.lit("…"))).otherwise(summary)
    stem = F.regexp_replace(F.regexp_extract("file_path", r"([^/]*)$", 1), r"(?i)\.md$", "")
    drafts = grouped.withColumn("summary", cut).filter("summary != ''")
    nth = F.row_number().over(Window.partitionBy("id").orderBy("section"))
    drafts = drafts.withColumn("nth", nth).filter(F.col("nth") <= SETTINGS.sections_per_file)
    return drafts.select("id", "file_path", F.coalesce(F.substring("title", 1, SETTINGS.topic_chars), stem).alias("topic"), "summary", (F.col("n") + 1).alias("start_line"))
