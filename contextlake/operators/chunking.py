"""Splitting source files into chunks: functions, classes and the like, and what is left between them.

The rules are line-oriented and know nothing of strings and comments. A line opens a block if a pattern of its
language matches and the block spans at least three lines; brace languages end a block where the braces close, Python
where the indent falls back. Large containers give way to their members.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextlake.session import spread

#: File extensions and their families.
FAMILY = {"js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "ts": "ts", "tsx": "ts", "mts": "ts", "py": "py", "rs": "rs", "go": "go", "java": "java"}
#: What opens a block in each family, in order of precedence; group 1 is the name.
BLOCKS = {
    "js": [("function", r"(?:export\s+)?(?:async\s+)?function\s+(\w+)"), ("class", r"(?:export\s+)?class\s+(\w+)"), ("arrow", r"(?:export\s+)?(?:const|let|var)\s+(\w+)\s*="), ("method", r"\s+(?:async\s+)?(\w+)\s*\([^)]*\)\s*\{")],
    "ts": [
        ("function", r"(?:export\s+)?(?:async\s+)?function\s+(\w+)"),
        ("class", r"(?:export\s+)?class\s+(\w+)"),
        ("interface", r"(?:export\s+)?interface\s+(\w+)"),
        ("type", r"(?:export\s+)?type\s+(\w+)"),
        ("arrow", r"(?:export\s+)?(?:const|let|var)\s+(\w+)\s*[=:]"),
        ("method", r"\s+(?:async\s+)?(\w+)\s*\([^)]*\)\s*[:{]"),
    ],
    "py": [("function", r"(?:async\s+)?def\s+(\w+)"), ("class", r"class\s+(\w+)")],
    "rs": [("function", r"(?:pub\s+)?(?:async\s+)?fn\s+(\w+)"), ("struct", r"(?:pub\s+)?struct\s+(\w+)"), ("enum", r"(?:pub\s+)?enum\s+(\w+)"), ("impl", r"impl(?:<[^>]+>)?\s+(\w+)"), ("trait", r"(?:pub\s+)?trait\s+(\w+)")],
    "go": [("function", r"func\s+(?:\([^)]+\)\s+)?(\w+)"), ("struct", r"type\s+(\w+)\s+struct"), ("interface", r"type\s+(\w+)\s+interface")],
    "java": [
        ("class", r"(?:public\s+|private\s+|protected\s+)?(?:abstract\s+|final\s+)?class\s+(\w+)"),
        ("interface", r"(?:public\s+|private\s+|protected\s+)?interface\s+(\w+)"),
        ("enum", r"(?:public\s+|private\s+|protected\s+)?enum\s+(\w+)"),
        ("method", r"\s+(?:public\s+|private\s+|protected\s+)?(?:static\s+)?(?:synchronized\s+)?(?:final\s+)?(?:abstract\s+)?(?:\w+(?:<[^>]+>)?\s+)(\w+)\s*\("),
        ("annotation", r"(?:public\s+)?@interface\s+(\w+)"),
    ],
}
#: Containers that are split when they exceed so many tokens, and the kinds of their members.
CONTAINERS, MEMBERS, CONTAINER_TOKENS = ("class", "struct", "impl"), ("method", "function"), 500
#: A rest is kept above so many characters and tokens.
REST_CHARS, REST_TOKENS = 50, 30
#: Fixed value: lines that a block has at least.
BLOCK_LINES = 3
CHARS_PER_TOKEN = 3.5
_OPENERS = {family: [(kind, re.compile(p, re.ASCII)) for kind, p in rules] for family, rules in BLOCKS.items()}

CHUNK_SCHEMA = "file_id bigint, chunk_type string, name string, start_line int, end_line int, content string, token_count bigint"


class Chunk(NamedTuple):
    kind: str
    name: str | None
    start: int
    end: int
    content: str


def tokens_of(text: str, chars_per_token: float = CHARS_PER_TOKEN) -> int:
    """Tokens of a text by its length, rounded up."""
    return math.ceil(len(text) / chars_per_token)


def brace_end(lines: list[str], start: int) -> int:
    """The line on which the braces opened from ``start`` on are closed; the last line if they never are."""
    depth, opened = 0, False
    for at in range(start, len(lines)):
        opened = opened or "{" in lines[at]
        depth += lines[at].count("{") - lines[at].count("}")
        if opened and depth <= 0:
            return at
    return len(lines) - 1


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip())


def indent_end(lines: list[str], start: int) -> int:
    """The line before the next non-blank one that is indented no deeper than ``start``."""
    after = (at for at in range(start + 1, len(lines)) if lines[at].strip() and _indent(lines[at]) <= _indent(lines[start]))
    return next(after, len(lines)) - 1


class _File:
    def __init__(self, content: str, family: str, chars_per_token: float = CHARS_PER_TOKEN):
        self.lines, self.family, self.chars_per_token = content.split("\n"), family, chars_per_token
        self.used = [False] * len(self.lines)

    def text(self, start: int, end: int) -> str:
        return "\n".join(self.lines[start : end + 1])

    def opened(self, at: int, last: int, kinds: tuple[str, ...] | None = None) -> tuple[str, str, int] | None:
        """Kind, name and last line of the block that opens on a line, within ``last``."""
        for kind, pattern in _OPENERS[self.family]:
            if kinds and kind not in kinds:
                continue
            if match := pattern.match(self.lines[at]):
                end = min(last, (indent_end if self.family == "py" else brace_end)(self.lines, at))
                if end - at + 1 >= BLOCK_LINES:
                    return kind, match[1], end
        return None

    def rest(self, start: int, end: int, kind: str = "module", name: str | None = None, whole: bool = False) -> Iterator[Chunk]:
        """The unused lines of a range, as one chunk if ``whole``, else one for each run of them."""
        free = [at for at in range(start, end + 1) if not self.used[at]]
        runs: list[list[int]] = []
        for at in free:
            if runs and (whole or at == runs[-1][-1] + 1):
                runs[-1].append(at)
            else:
                runs.append([at])
        for run in runs:
            text = "\n".join(self.lines[at] for at in run).strip()
            if len(text) > REST_CHARS and tokens_of(text, self.chars_per_token) > REST_TOKENS:
                yield Chunk(kind, name, (start if whole else run[0]) + 1, (end if whole else run[-1]) + 1, text)

    def use(self, start: int, end: int) -> None:
        self.used[start : end + 1] = [True] * (end - start + 1)

    def members(self, start: int, end: int) -> list[Chunk]:
        found, at = [], start + 1
        while at <= end:
            if not self.used[at] and (block := self.opened(at, end, MEMBERS)):
                kind, name, last = block
                found.append(Chunk(kind, name, at + 1, last + 1, self.text(at, last)))
                self.use(at, last)
                at = last
            at += 1
        return found

    def chunks(self) -> list[Chunk]:
        found: list[Chunk] = []
        last = len(self.lines) - 1
        for at in range(len(self.lines)):
            if self.used[at] or not (block := self.opened(at, last)):
                continue
            kind, name, end = block
            whole = Chunk(kind, name, at + 1, end + 1, self.text(at, end))
            parts = self.members(at, end) if kind in CONTAINERS and tokens_of(whole.content, self.chars_per_token) > CONTAINER_TOKENS else []
            found += [*parts, *self.rest(at, end, kind, name, whole=True)] if parts else [whole]
            self.use(at, end)
        return found


def chunk_code(content: str, language: str, chars_per_token: float = CHARS_PER_TOKEN) -> list[Chunk]:
    """The chunks of a file by start line; one for the whole file if its language is unknown or nothing else comes out."""
    whole = [Chunk("module", None, 1, content.count("\n") + 1, content)]
    family = FAMILY.get(language.lower())
    if not family:
        return whole
    file = _File(content, family, chars_per_token)
    found = file.chunks()
    found += file.rest(0, len(file.lines) - 1)
    return sorted(found, key=lambda c: c.start) or whole


def chunk_files(sources: DataFrame, id_col: str = "file_id", language: str = "language", content: str = "content", chars_per_token: float = CHARS_PER_TOKEN) -> DataFrame:
    """Chunks (``CHUNK_SCHEMA``) of the files of ``sources``, a file at a time in Arrow batches, nothing shuffled.

    A null language counts as unknown; files with null or empty content have no chunk.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, c.kind, c.name, c.start, c.end, c.content, tokens_of(c.content, chars_per_token)) for i, lang, text in zip(batch["i"], batch["l"], batch["c"], strict=True) for c in chunk_code(text, lang, chars_per_token)]
            yield pd.DataFrame(rows, columns=["file_id", "chunk_type", "name", "start_line", "end_line", "content", "token_count"])

    source = sources.filter(F.length(content) > 0).select(F.col(id_col).cast("bigint").alias("i"), F.coalesce(F.col(language), F.lit("")).alias("l"), F.col(content).alias("c"))
    return spread(source).mapInPandas(run, CHUNK_SCHEMA)
