"""The import graph: extraction of specifiers, resolution to files, and walks over the edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextlake.functions.paths import dirname, normal_path
from contextlake.operators.orphans import resolve_relative, salted_left_join
from contextlake.session import cut

#: What an import looks like in each family of languages, in order of precedence; group 1 is the target.
#: Word characters are spelt out, as the SQL that the queries are held against reads the same patterns.
IMPORT_PATTERNS = {
    "js": [r"""import\s+(?:[A-Za-z0-9_{}\s,*]+\s+from\s+)?['"]([^'"]+)['"]""", r"""require\s*\(\s*['"]([^'"]+)['"]\s*\)""", r"""import\s*\(\s*['"]([^'"]+)['"]\s*\)"""],
    "py": [r"from\s+([A-Za-z0-9_.]+)\s+import", r"(?m)^import\s+([A-Za-z0-9_.]+)"],
    "rs": [r"use\s+(crate::[A-Za-z0-9_:]+)", r"mod\s+([A-Za-z0-9_]+)\s*;"],
    "go": [r"""import\s+(?:\(\s*)?["']([^"']+)["']"""],
    "java": [r"import\s+(?:static\s+)?([A-Za-z0-9_.]+\.[A-Z][A-Za-z0-9_]*)", r"import\s+(?:static\s+)?([A-Za-z0-9_.]+)\.\*"],
}
#: What stands in every text that a pattern of the family matches, so that most texts needn't be searched.
IMPORT_WORDS = {"js": ["import", "require"], "py": ["import"], "rs": ["crate::", "mod"], "go": ["import"], "java": ["import"]}
#: The family of each file extension.
FAMILIES = {"js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "ts": "js", "tsx": "js", "py": "py", "rs": "rs", "go": "go", "java": "java"}


def _relative(target: Column) -> Column:
    return target.startswith("./") | target.startswith("../")


def _family(language: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair]), F.lower(language))


def dep_type(target: Column, language: Column) -> Column:
    """import, use, mod or external, by language and form of the target."""
    family = _family(language)
    return F.when(family.isin("py", "go", "java"), "import").when(family == "rs", F.when(target.startswith("crate::"), "use").otherwise("mod")).when(_relative(target), "import").otherwise("external")


def found_targets(content: Column) -> Column:
    """The distinct non-empty import targets of a text in each family of languages: a map from family to targets."""
    every = {}
    for family, patterns in IMPORT_PATTERNS.items():
        worth = reduce(lambda a, b: a | b, [content.contains(w) for w in IMPORT_WORDS[family]])
        every[family] = F.when(worth, F.concat(*[F.regexp_extract_all(content, F.lit(p), F.lit(1)) for p in patterns])).otherwise(F.array().cast("array<string>"))
    return F.map_filter(F.create_map(*[x for f, found in every.items() for x in (F.lit(f), F.filter(F.array_distinct(found), lambda t: t != ""))]), lambda _, t: F.size(t) > 0)


def typed_imports(targets: DataFrame, id_col: str, language: str = "language") -> DataFrame:
    """Rows (id, position, target_path, dep_type) for ``targets`` (id, language, targets: array)."""
    each = targets.select(F.col(id_col), F.col(language).alias("_language"), F.posexplode("targets").alias("position", "target_path"))
    return each.select(id_col, F.col("position").cast("bigint").alias("position"), "target_path", dep_type(F.col("target_path"), F.col("_language")).alias("dep_type"))


def extract_imports(sources: DataFrame, id_col: str = "file_id", language: str = "language", content: str = "content") -> DataFrame:
    """Rows (id, position, target_path, dep_type): the distinct imports of each source, the first of equal ones.

    Sources that are null or of another language give none. All on the JVM side.
    """
    found = F.array().cast("array<string>")
    for name, patterns in IMPORT_PATTERNS.items():
        every = F.concat(*[F.regexp_extract_all(F.col(content), F.lit(p), F.lit(1)) for p in patterns])
        found = F.when(_family(F.col(language)) == name, every).otherwise(found)
    return typed_imports(sources.select(id_col, language, F.filter(F.array_distinct(found), lambda x: x != "").alias("targets")), id_col, language)


def extract_chunk_imports(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Rows (chunk_id, position, target_path, dep_type) for chunks (chunk_id, file_id, content) whose language stands in
    ``files`` (file_id, language).

    Texts are reduced to their targets in all families where they are read, so no text is shuffled; rows that repeat a
    chunk_id count once.
    """
    made = chunks.filter("chunk_id is not null").select("chunk_id", "file_id", F.map_entries(found_targets(F.col("content"))).alias("found")).filter(F.size("found") > 0)
    made = made.groupBy("chunk_id").agg(F.min("file_id").alias("file_id"), F.min("found").alias("found")).join(files.select("file_id", "language"), "file_id")
    return typed_imports(made.select("chunk_id", "language", F.map_from_entries("found")[_family(F.col("language"))].alias("targets")), "chunk_id")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports`` (from_path, target_path) with target_file_id: of relative targets the first candidate that exists,
    else null. ``files`` needs file_id, path and indexed_at with normal paths."""
    based = cut(imports.withColumn("base", F.when(_relative(F.col("target_path")), normal_path(F.concat(dirname(F.col("from_path")), F.lit("/"), F.col("target_path"))))))
    found = salted_left_join(based, resolve_relative(based, files), "base", ["from_path", "target_path"])
    return found.select(*imports.columns, F.col("found_id").alias("target_file_id"))


def edges(dependencies: DataFrame) -> DataFrame:
    """Each (source_file_id, target_path) once; of several rows the one with the greatest target id."""
    return dependencies.groupBy("source_file_id", "target_path").agg(F.max("target_file_id").alias("target_file_id"), F.max("dep_type").alias("dep_type"))


def direct_dependencies(deps: DataFrame, files: DataFrame) -> DataFrame:
    """Every edge with its target's path, null where there is none."""
    return deps.join(files.select(F.col("file_id").alias("target_file_id"), F.col("path").alias("resolved_path")), "target_file_id", "left").select("source_file_id", "target_path", "target_file_id", "resolved_path", "dep_type")


def reverse_dependencies(deps: DataFrame, files: DataFrame) -> DataFrame:
    """Every resolved edge with its source's path."""
    known = deps.filter("target_file_id is not null").join(files.select(F.col("file_id").alias("source_file_id"), F.col("path").alias("source_path")), "source_file_id")
    return known.select("target_file_id", "source_file_id", "source_path", "target_path", "dep_type")


def reached(deps: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """Rows (file_id, depth): what can be reached from ``roots`` (file_id) in at most ``max_depth`` steps, at its least
    depth; a round of joins on distinct nodes for each step, and lineage cut after each."""
    seen = roots.select("file_id").distinct().withColumn("depth", F.lit(0).cast("bigint"))
    steps = deps.filter("target_file_id is not null").select(F.col("source_file_id").alias("file_id"), "target_file_id").distinct()
    front = seen
    for depth in range(1, max_depth + 1):
        front = steps.join(front.select("file_id"), "file_id", "left_semi").select(F.col("target_file_id").alias("file_id")).distinct().join(seen, "file_id", "left_anti").withColumn("depth", F.lit(depth).cast("bigint"))
        seen = seen.unionByName(front)
        if depth < max_depth:
            front, seen = cut(front), cut(seen)
    return seen


def transitive_dependencies(deps: DataFrame, roots: DataFrame, max_depth: int = 2) -> DataFrame:
    """All edges that leave a node reached in fewer than ``max_depth`` steps, with depth = the node's + 1.

    Edges back to visited nodes and edges without a target are among them. None if max_depth is 0 or less.
    """
    if max_depth <= 0:
        return deps.select("source_file_id", "target_path", "target_file_id", F.lit(0).cast("bigint").alias("depth")).filter(F.lit(False))
    nodes = reached(deps, roots, max_depth - 1)
    out = deps.join(nodes.withColumnRenamed("file_id", "source_file_id"), "source_file_id")
    return out.select("source_file_id", "target_path", "target_file_id", (F.col("depth") + 1).alias("depth"))


def dependency_chunks(walked: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks of all files that a walk's edges lead to."""
    targets = walked.filter("target_file_id is not null").select(F.col("target_file_id").alias("file_id")).distinct()
    return chunks.join(targets, "file_id", "left_semi")
