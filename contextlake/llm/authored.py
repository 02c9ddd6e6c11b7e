"""Source files that nobody in the project wrote: generated, minified or vendored files and data saved as code.

Method: each chunk of a file is lexed (strings, comments, numbers, names, marks) and re-emitted in a canonical form with
one statement a line and every name, number and string replaced by a sign for its kind. The original layout is held
against it: many statements to a line mark minified code, a form that repeats itself without variation marks generated
code, and literals that outweigh everything else mark data. A generator's notice in a comment at the head of a chunk,
and the places and names that generators use, lower the bar for generated code but never decide alone. Copies of
third-party code are known by their place or by a notice in the comment that a file starts with, lock files by their
name.

Scale: a chunk becomes one narrow row of counts in Python, in Arrow batches; counts are summed by file with map-side
combining, so a file that holds a tenth of all chunks is never gathered anywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contextlake.session import spread

#: Lines at the head of a chunk in which a notice counts.
HEAD_LINES = 6

#: Directories that package managers and projects use for copies of third-party code.
VENDOR_DIRS = ["vendor", "_vendor", "vendored", "third_party", "third-party", "thirdparty", "node_modules", "bower_components", "site-packages"]
#: Directories that hold such copies, one folder each, where they stand beside the project's own sources; beneath
#: these they may as well be the project's own.
SIDE_DIRS, SOURCE_DIRS = ["external", "extern", "deps"], ["src", "lib", "app", "source", "sources", "test", "tests"]
#: Directories that build tools write generated sources to.
GENERATED_DIRS = ["__generated__", "generated", "generated-sources", "autogen", "gen"]
#: Endings of names that generators, bundlers and package managers give.
GENERATED_NAME = r"(\.(generated|g|gen|pb|pb2|designer)\.[a-z]+|_pb2?(_grpc)?\.[a-z]+|_generated\.[a-z]+)$"
MINIFIED_NAME = r"([.-]min\.(js|css)|\.bundle\.js)$"
LOCK_NAME = r"(^|/)([^/]*[-.]lock\.(json|ya?ml)|[^/]+\.lock|go\.sum|npm-shrinkwrap\.json)$"
#: Extensions of texts and settings, which no layout tells apart from generated ones.
TEXT_NAME = r"\.(md|txt|rst|json|ya?ml|toml|ini|cfg|csv|html?|xml)$"

#: Statements to a line, and characters to a line, from which on code is minified.
MINIFIED_STATEMENTS, MINIFIED_WIDTH = 6.0, 150.0
#: The share of code characters in literals from which on a file is data.
DATA_SHARE = 0.7
#: Distinct runs of three line forms to a line up to which code is generated: on its own, from so many lines on; and
#: with a notice, place or name that says so. Fewer lines repeat themselves by chance, so they say nothing on their own.
UNIFORM, UNIFORM_LINES, UNIFORM_BACKED = 0.42, 20, 0.55

_STRING = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`")
_COMMENT = re.compile(r"//[^\n]*|/\*.*?\*/|^[ \t]*#(?!\[|!)[^\n]*", re.S | re.M)
_NUMBER = re.compile(r"\b\d[\w.]*")
_NAME = re.compile(r"[A-Za-z_$][\w$]*")
_BLANK = re.compile(r"[ \t\r\f\v]+")
_BREAK = re.compile(r"[;{}]")
#: Lines that say nothing about who wrote a file, as they are alike in any: imports,
_IMPORT = re.compile(r"^[ \t]*(?:import|from|use|mod|package|#include|(?:const|let|var) [^=\n]+ = require)\b[^\n]*", re.M)
#: and, in canonical form, bare declarations of fields.
_FIELD = re.compile(r"[i?:<>,;\[\]&*|.]*")
#: A generator's notice, in the languages that such notices are written in.
_NOTICE = re.compile(
    r"^(?:/\*+|//+|#+|\*|<!--|--|;+)[^\n]*(?:auto-?matically (?:written|generated|created|produced)|auto-?generated|@generated|\bgenerated (?:by|from|at|with|using|code|file)\b|machine[ -]generated"
    r"|do not (?:edit|modify|change)|(?:edits|changes) will be (?:lost|overwritten)|compiler output|(?:maschinell|automatisch) (?:erzeugt|erstellt|generiert)|nicht (?:bearbeiten|ändern)"
    r"|généré (?:par|automatiquement)|ne pas (?:modifier|éditer)|generado (?:por|automáticamente)|no (?:editar|modificar)|gerado (?:por|automaticamente)|não (?:editar|edite|modificar)|自動生成|자동 ?생성)",
    re.I | re.M,
)

#: The comment that a text starts with, and the marks at the start of its lines.
_LEAD = re.compile(r"(?:\s*(?:/\*.*?\*/|<!--.*?-->|//[^\n]*|--[^\n]*|#(?!\[|[ \t]*(?:include|define|if|ifdef|ifndef|pragma|import|region)\b)[^\n]*))+", re.S)
_MARKS = re.compile(r"^[ \t]*(?:/\*+!?|//+!?|#+!?|\*+/?|<!--+|--+)?[ \t]*", re.M)
#: A notice in it that the file is a copy of third-party code: a statement of origin, or a banner of name, version, copyright and licence.
_FOREIGN = re.compile(
    r"^(?:this (?:file|code|module) (?:is|was) )?(?:vendored (?:from|copy of)\b|(?:a )?bundled copy of \S+[^\n]*\d+\.\d+|(?:copied|imported|taken) (?:verbatim|unchanged|unmodified|as is) from\b)"
    r"|^third[- ]party: *\S+ v?\d+\.\d+|^third[- ]party\b[^\n]*\bimported as[- ]is\b"
    r"|^[@\w][\w@./-]*(?: [\w.-]+)?,? v?\d+(?:\.\d+)+\b(?=.{0,400}?(?:\(c\)|©|copyright))(?=.{0,600}?\blicen[cs]ed?\b)",
    re.I | re.M | re.S,
)

COUNTS = ["chars", "layout", "lines", "statements", "literal", "code", "forms", "notice", "foreign", "widest"]


def lex_counts(text: str) -> tuple[int, ...]:
    """Counts of one chunk: characters, lines with code, those that could tell who wrote them, statements, characters in literals and of code without
    blanks, distinct runs of three line forms, whether it starts with a generator's notice, or with one of third-party code, widest line; and a hash of its form."""
    notice = int(bool(_NOTICE.search("\n".join(text.split("\n", HEAD_LINES)[:HEAD_LINES]))))
    lead = _LEAD.match(text)
    foreign = int(bool(lead and _FOREIGN.search(_MARKS.sub("", lead.group()))))
    bare, n_strings = _STRING.subn("\x01", text)
    in_strings = len(text) - len(bare) - n_strings
    bare = _COMMENT.sub("", bare)
    code = sum(map(len, bare.split())) + in_strings
    solid = _BLANK.sub("", _IMPORT.sub("\x03", bare))
    form, n_numbers = _NUMBER.subn("\x02", solid)
    in_numbers = len(solid) - len(form) + n_numbers
    layout = [r for r in _NAME.sub("i", form).split("\n") if r]
    statements = max(len(layout), sum(len(_BREAK.findall(r)) for r in layout))
    rows = [r for r in layout if r != "\x03" and not _FIELD.fullmatch(r)]
    runs = set(zip(rows, rows[1:], rows[2:])) if len(rows) > 2 else {tuple(rows)}
    widest = max(map(len, text.split("\n")))
    return (len(text), len(layout), len(rows), statements, in_strings + in_numbers, code, len(runs) if rows else 0, notice, foreign, widest, xxhash.xxh3_64_intdigest("\n".join(rows)) - (1 << 63))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """Rows (file_id, chunk_id, line, counts of ``lex_counts``, form) of the chunks with content; nothing is shuffled.

    line is the line that the chunk starts with, 1 at least, or a very large number where none is known.
    """
    names = ["file_id", "chunk_id", "line", *COUNTS, "form"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [lex_counts(t) for t in batch.column(3).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names[3:])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *(pa.array(c, pa.int64()) for c in columns)], names=names)

    known = F.col("start_line").cast("bigint") if "start_line" in chunks.columns else F.lit(None)
    line = F.coalesce(F.greatest(known, F.lit(1)), F.lit(1 << 40)).cast("bigint")
    source = chunks.filter(F.length("content") > 0).select(F.col("file_id").cast("bigint"), F.col("chunk_id").cast("bigint"), line.alias("line"), "content")
    return spread(source).mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def file_counts(chunks: DataFrame) -> DataFrame:
    """The counts of each file_id: sums over its chunks, each chunk_id once; the widest line; the forms of equal chunk
    forms once; foreign of the chunks at its start only."""
    once = chunk_counts(chunks).groupBy("file_id", "chunk_id").agg(F.min("line").alias("line"), *[F.max(c).alias(c) for c in [*COUNTS, "form"]])
    sums = [F.sum(c).alias(c) for c in COUNTS if c not in ("forms", "foreign", "widest")]
    start = F.min(F.struct("line", (-F.col("foreign")).alias("minus"))).alias("start")
    by_form = once.groupBy("file_id", "form").agg(*sums, F.max("forms").alias("forms"), F.max("widest").alias("widest"), start)
    by_file = by_form.groupBy("file_id").agg(*sums, F.sum("forms").alias("forms"), F.max("widest").alias("widest"), F.min("start").alias("start"))
    return by_file.withColumn("foreign", -F.col("start.minus")).drop("start")


def _clean_path(path: str = "path") -> Column:
    return F.regexp_replace(F.replace(F.col(path), F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def _inside(path: Column, names: list[str]) -> Column:
    """Whether one of the directories of ``path`` has one of the names."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, names)))


def _beside(path: Column) -> Column:
    """Whether ``path`` leads through one of ``SIDE_DIRS``, and a folder in it, without one of ``SOURCE_DIRS`` before."""
    return path.rlike(rf"^(?:(?!(?:{'|'.join(SOURCE_DIRS)})/)[^/]+/)*(?:{'|'.join(SIDE_DIRS)})/[^/]+/.")


def file_origins(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows (file_id, path, origin) of all files: origin is vendored, lock, minified, data, generated or authored.

    Of a file_id with several rows the latest by indexed_at counts. Files without content are judged by place and name
    alone. Chunks of unknown files and chunks without content give nothing; a null path matches no place or name.
    """
    latest = Window.partitionBy("file_id").orderBy(F.col("indexed_at").desc_nulls_last(), F.col("path").asc_nulls_last())
    named = files.filter("file_id is not null").withColumn("rn", F.row_number().over(latest)).filter("rn = 1").select("file_id", F.coalesce(_clean_path(), F.lit("")).alias("path"))
    every = named.join(file_counts(chunks), "file_id", "left")

    where = F.lower("path")
    code, lines = ~where.rlike(TEXT_NAME), F.greatest(F.coalesce("lines", F.lit(0)), F.lit(1))
    repeat = F.coalesce(F.col("forms"), F.lit(0)) / lines
    empty = F.coalesce("chars", F.lit(0)) == 0
    backed = (F.coalesce("notice", F.lit(0)) > 0) | _inside(where, GENERATED_DIRS) | where.rlike(GENERATED_NAME)
    layout = F.greatest("layout", F.lit(1))
    dense = (F.col("statements") / layout >= MINIFIED_STATEMENTS) & (F.col("chars") / layout >= MINIFIED_WIDTH)
    origin = (
        F.when(_inside(where, VENDOR_DIRS) | _beside(where) | (code & (F.coalesce("foreign", F.lit(0)) > 0)), "vendored")
        .when(where.rlike(LOCK_NAME), "lock")
        .when(code & (dense | (empty & where.rlike(MINIFIED_NAME))), "minified")
        .when(code & (F.col("literal") / F.greatest("code", F.lit(1)) >= DATA_SHARE), "data")
        .when(code & ((backed & (repeat <= UNIFORM_BACKED)) | ((repeat <= UNIFORM) & (lines >= UNIFORM_LINES))), "generated")
        .otherwise("authored")
    )
    return every.select("file_id", "path", origin.alias("origin"))


def foreign_files(origins: DataFrame) -> DataFrame:
    """The file_ids of all files that nobody in the project wrote."""
    return origins.filter(F.col("origin") != "authored").select("file_id")
