"""Ignore patterns: translation to one regular expression that runs on the JVM side."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """The regular expression of a glob, for a case-insensitive match of a whole relative path.

    ``**/`` stands for any directories or none, ``**`` for anything, ``*`` and ``?`` don't cross a slash, a dot is a
    dot; other marks keep their meaning as a regular expression. A leading slash is dropped, a trailing one takes all
    beneath. Patterns hold from the root, but those starting with ``*.`` at any depth.
    """
    body = pattern.removeprefix("/")
    if body.endswith("/"):
        body += "**"
    out, at = [], 0
    while at < len(body):
        for sign, regex in (("**/", "(?:.*/)?"), ("**", ".*"), ("*", "[^/]*"), ("?", "[^/]"), (".", r"\.")):
            if body.startswith(sign, at):
                out.append(regex)
                at += len(sign)
                break
        else:
            out.append(body[at])
            at += 1
    return ("^(?:.*/)?" if body.startswith("*.") else "^") + "".join(out) + "$"


def read_ignore_file(path: str | Path) -> list[str]:
    """The patterns of an ignore file; blank lines, comments and negations are skipped, a missing file has none."""
    try:
        lines = Path(path).read_text(encoding="utf-8").splitlines()
    except OSError:
        return []
    return [s for s in map(str.strip, lines) if s and s[0] not in "#!"]


def ignored(path: Column, patterns: Iterable[str]) -> Column:
    """Whether ``path`` matches one of the patterns; false for a null path."""
    joined = "|".join(glob_regex(p) for p in patterns)
    if not joined:
        return F.lit(False)
    return F.coalesce(F.replace(path, F.lit("\\"), F.lit("/")).rlike(f"(?i){joined}"), F.lit(False))


def matches_filter(path: Column, pattern: str) -> Column:
    """The looser filter of file lists: ``*`` anything, ``?`` any one character, found anywhere, in any case."""
    return path.rlike("(?i)" + pattern.replace("*", ".*").replace("?", "."))


#: Directories that a quick scan never enters.
SKIPPED_DIRS = ["node_modules", ".git", ".hg", ".svn", "dist", "build", "target", ".next", "__pycache__", ".venv", "venv", ".idea", ".vscode", "coverage"]


def quick_scan_keeps(path: Column, size: Column, extensions: Iterable[str], texts: Iterable[str], most_bytes: int) -> Column:
    """The rules of the quick scan: a known extension, a size above 0 and within the limit, no directory of
    ``SKIPPED_DIRS``, and none of ``texts`` anywhere in the path, as it is written. False for a null path or size."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.split(plain, "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    known = F.lower(F.regexp_extract(plain, r"\.([^./]*)$", 1)).isin([e.lower() for e in extensions])
    kept = known & (size > 0) & (size <= most_bytes) & ~F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED_DIRS)))
    for text in texts:
        kept = kept & ~plain.contains(text)
    return F.coalesce(kept, F.lit(False))
