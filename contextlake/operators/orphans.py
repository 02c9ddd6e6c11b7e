"""References to records that don't exist, that were removed, or that came later.

Method: the keys of parents and children are put into one long table of tagged rows and combined by parent table and
key; keys without a parent's flag are the missing ones. That is done for the ids that references hold, against files
and removed files, and for the paths that relative references may mean, against the paths of files. Faults are summed
by parent table, kind and period. Combining is map-side, so a key that holds a third of all references is one row for
each task, and only keys go through the shuffle.

Scale: what a reference needs to know of its key comes back by joins whose one side is a table of distinct keys. At most
``1 / HOT_SHARE`` keys hold more than that share of the rows; these alone are salted, rows by a hash of their other
fields, keys by repetition. Rows without a key meet nothing and are spread over all partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextlake.functions.paths import dirname, normal_path
from contextlake.session import cut

#: The share of all references from which on a key is hot, and the parts that its references are dealt to.
HOT_SHARE, SALTS = 0.001, 64

#: What a relative import may leave off, by falling precedence.
IMPORT_ENDINGS = ["", ".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs", ".java", "/index.js", "/index.ts", "/index.jsx", "/index.tsx", "/index.mjs"]


def hot_keys(rows: DataFrame, key: str, share: float = HOT_SHARE) -> list:
    """The keys that more than ``share`` of the rows with a key hold; at most ``1 / share`` of them."""
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    hot = counts.crossJoin(F.broadcast(counts.agg(F.sum("_n").alias("_all")))).filter(F.col("_n") > F.greatest(F.lit(1), F.col("_all") * share))
    return [r[0] for r in hot.select(key).collect()]


def salted_left_join(rows: DataFrame, keys: DataFrame, key: str, spread_by: list[str], hot: list | None = None, salts: int = SALTS) -> DataFrame:
    """``rows`` with the columns of ``keys`` (one row for each ``key``), null where there is none.

    ``hot`` lists the keys that many rows share, ``hot_keys`` by default, and is short by its definition. Rows with a
    null key stand by themselves, wherever a hash of ``spread_by`` puts them.
    """
    hot = hot_keys(rows, key) if hot is None else hot
    anywhere, none, is_hot = F.xxhash64(*spread_by), F.lit(0).cast("bigint"), F.col(key).isin(hot) if hot else F.lit(False)
    salt = F.when(F.col(key).isNull(), anywhere).when(is_hot, F.pmod(anywhere, F.lit(salts))).otherwise(none)
    copies = F.explode(F.when(is_hot, F.sequence(none, none + (salts - 1))).otherwise(F.array(none))) if hot else none
    return rows.withColumn("_salt", salt).join(keys.withColumn("_salt", copies), [key, "_salt"], "left").drop("_salt")


def key_flags(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Combine tagged keys: ``children`` (parent_table, key), ``parents`` (parent_table, key, flag, id, at).

    Rows (parent_table, key, n_children, flags, parent): the number of references, which parents know the key, and
    (id, at) of the parent with the smallest id; null where no parent has one.
    """
    nothing = [F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("timestamp").alias("at")]
    long = children.select("parent_table", "key", F.lit(1).cast("bigint").alias("n"), F.lit(0).alias("flag"), *nothing)
    long = long.unionByName(parents.select("parent_table", "key", F.lit(0).cast("bigint").alias("n"), F.col("flag").cast("int").alias("flag"), F.col("id").cast("bigint").alias("id"), F.col("at").cast("timestamp").alias("at")))
    return long.groupBy("parent_table", "key").agg(F.sum("n").alias("n_children"), F.bit_or("flag").alias("flags"), F.min_by(F.struct("id", "at"), "id").alias("parent"))


_FILE, _REMOVED = 1, 2
#: The parent tables of references by id and by path.
_BY_ID, _BY_PATH = "files", "files.path"


def _latest_files(files: DataFrame) -> DataFrame:
    """(file_id, path, indexed_at), one row for each file: the latest indexing run's path."""
    row = F.struct(F.col("indexed_at").isNotNull(), F.col("indexed_at"), F.col("path"))
    return files.filter("file_id is not null").groupBy("file_id").agg(F.max_by("path", row).alias("path"), F.max("indexed_at").alias("indexed_at"))


def resolve_relative(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Rows (base, found_id, found_at) of the bases in ``imports`` (base) that lead to a file.

    A base is a normalised path without what ``IMPORT_ENDINGS`` add; the first ending that a file has wins. Of equal
    file paths the smallest file_id counts.
    """
    bases = imports.select("base").dropna().distinct()
    candidates = bases.select("base", F.posexplode(F.array(*map(F.lit, IMPORT_ENDINGS))).alias("rank", "ending")).select("base", "rank", F.concat("base", "ending").alias("key"))
    paths = files.filter("path is not null").select(F.lit(_BY_PATH).alias("parent_table"), F.col("path").alias("key"), F.lit(_FILE).alias("flag"), F.col("file_id").alias("id"), F.col("indexed_at").alias("at"))
    there = key_flags(candidates.select(F.lit(_BY_PATH).alias("parent_table"), "key"), paths).filter((F.col("n_children") > 0) & (F.col("flags") != 0))
    return candidates.join(there.select("key", "parent"), "key").groupBy("base").agg(F.min_by("parent", "rank").alias("file")).select("base", F.col("file.id").alias("found_id"), F.col("file.at").alias("found_at"))


def faulty_references(dependencies: DataFrame, files: DataFrame, removed_files: DataFrame) -> DataFrame:
    """Rows (source_file_id, target_path, kind, parent_table, period) of the references at fault, each (source, path) once.

    kind is the first that holds: source_missing; for a target id that isn't among the files target_removed or
    target_missing; for a relative path without a target id path_missing or target_late. parent_table is where the
    reference leads: files by their id, or files.path. period is the month of the source file's indexed_at, null if the
    source is missing or has none. Rows with a null source_file_id count as source_missing; other null targets, also
    null target_paths, are at no fault. Of several target ids of one reference the smallest non-null one counts. Dirty
    paths are compared in normal form; a source without a path counts as one at the root.
    """
    refs = dependencies.groupBy("source_file_id", "target_path").agg(F.min("target_file_id").alias("target_file_id"))
    latest = cut(_latest_files(files).withColumn("path", normal_path(F.col("path"))))

    child = lambda c: dependencies.filter(F.col(c).isNotNull()).select(F.lit(_BY_ID).alias("parent_table"), F.col(c).alias("key"))
    file_keys = latest.select(F.lit(_BY_ID).alias("parent_table"), F.col("file_id").alias("key"), F.lit(_FILE).alias("flag"), F.col("file_id").alias("id"), F.col("indexed_at").alias("at"))
    gone = removed_files.filter("file_id is not null").select(F.lit(_BY_ID).alias("parent_table"), F.col("file_id").alias("key"), F.lit(_REMOVED).alias("flag"), F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("timestamp").alias("at"))
    flags = key_flags(child("source_file_id").unionByName(child("target_file_id")), file_keys.unionByName(gone)).filter("n_children > 0")
    flags = cut(flags.select("key", "n_children", "flags"), all=F.sum("n_children"))
    hot = [r.key for r in flags.filter(F.col("n_children") > max(1, (flags.observed["all"] or 0) * HOT_SHARE)).select("key").collect()]
    lacking = flags.filter(F.col("flags").bitwiseAND(_FILE) == 0)

    by_source = lacking.select(F.col("key").alias("source_file_id"), F.lit(True).alias("lost"))
    known = salted_left_join(refs, by_source, "source_file_id", ["target_path"], hot).withColumn("lost", F.col("lost").isNotNull() | F.col("source_file_id").isNull())
    by_target = lacking.select(F.col("key").alias("target_file_id"), F.col("flags").alias("target_flags"))
    known = salted_left_join(known, by_target, "target_file_id", ["source_file_id", "target_path"], hot)
    relative = F.col("target_file_id").isNull() & F.col("target_path").rlike(r"^\.\.?/")
    # Only these can be at fault, and only these need to know their source.
    asked = known.filter(F.col("lost") | F.col("target_flags").isNotNull() | relative)
    sources = latest.select(F.col("file_id").alias("source_file_id"), F.col("path").alias("source_path"), F.col("indexed_at").cast("timestamp").alias("source_at"))
    asked = salted_left_join(asked, sources, "source_file_id", ["target_path"], hot)
    base = normal_path(F.concat(dirname(F.coalesce("source_path", F.lit(""))), F.lit("/"), F.col("target_path")))
    asked = cut(asked.withColumn("base", F.when(relative & ~F.col("lost"), base)))
    every = salted_left_join(asked, resolve_relative(asked, latest), "base", ["source_file_id", "target_path"])
    kind = (
        F.when(F.col("lost"), "source_missing")
        .when(F.col("target_flags").bitwiseAND(_REMOVED) != 0, "target_removed")
        .when(F.col("target_flags").isNotNull(), "target_missing")
        .when(F.col("base").isNotNull() & F.col("found_id").isNull(), "path_missing")
        .when(F.col("base").isNotNull() & (F.col("found_at") > F.col("source_at")), "target_late")
    )
    where = F.when(F.col("base").isNotNull(), _BY_PATH).otherwise(_BY_ID)
    return every.select("source_file_id", "target_path", kind.alias("kind"), where.alias("parent_table"), F.trunc(F.col("source_at").cast("date"), "month").alias("period")).filter("kind is not null")


def fault_report(faults: DataFrame) -> DataFrame:
    """Rows (parent_table, kind, period, n): the faults of each parent table, kind and month; a null period is one of its
    own."""
    return faults.groupBy("parent_table", "kind", "period").agg(F.count("*").alias("n"))
