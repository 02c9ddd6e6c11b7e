"""Snapshots of the stored tables: a catalogue of the folders that held them."""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contextlake.operators.search import like_all
from contextlake.storage import Folder

CATALOGUE = "snapshots.json"
#: Fixed values of the retention.
MAX_SNAPSHOTS, MAX_AGE_DAYS = 10, 30


def snapshot_list(catalogue: DataFrame) -> DataFrame:
    """The snapshots with their size in MB, in the order they were made."""
    return catalogue.select("id", "label", "trigger", "created_at", "file_count", "chunk_count", F.round(F.col("size_bytes") / 1048576.0, 2).alias("size_mb"))


def expired(catalogue: DataFrame, now: datetime.datetime, max_age_days: int = MAX_AGE_DAYS, max_count: int = MAX_SNAPSHOTS) -> DataFrame:
    """The snapshots to remove: older than ``max_age_days``, then the oldest beyond ``max_count``."""
    old = F.col("created_at") < F.lit(now - datetime.timedelta(days=max_age_days))
    newest = Window.partitionBy(old).orderBy(F.col("created_at").desc(), F.col("id").desc())
    return catalogue.withColumn("old", old).withColumn("rn", F.row_number().over(newest)).filter(F.col("old") | (F.col("rn") > max_count)).drop("old", "rn")


def search_snapshot(chunks: DataFrame, snapshot_id: str, query: str, limit: int = 10, keep: Sequence[str] | None = None) -> DataFrame:
    """The chunks of a snapshot that hold every word of the query, with the snapshot's id; none for a blank query."""
    found = like_all(chunks, strip_text(query), limit, keep=keep).orderBy("chunk_id")
    return found.withColumn("backup_id", F.lit(snapshot_id))


def strip_text(query: str | None) -> str:
    """A literal query without outer blanks; empty for none."""
    return (query or "").strip()


class SnapshotStore:
    """Snapshots of an engine's tables. Tables are folders that never change once written, so a snapshot is an entry of
    the catalogue that names the folders of each table; nothing is copied. The catalogue is one small JSON file that is
    replaced as a whole."""

    def __init__(self, folder: Folder):
        self.folder = folder

    def entries(self) -> list[dict]:
        """The catalogue; empty if there is none or it can't be read."""
        try:
            return json.loads(self.folder.read_text(CATALOGUE) or "[]")
        except ValueError:
            return []

    def create(self, tables: Mapping[str, list[str]], file_count: int, chunk_count: int, label: str | None = None, trigger: str = "manual", now: datetime.datetime | None = None) -> dict:
        """Note the folders of all tables; ids are times, with a suffix where two meet."""
        now = now or datetime.datetime.now()
        name, taken = now.strftime("%Y-%m-%d_%H%M%S"), {e["id"] for e in self.entries()}
        ident = next(i for n in range(len(taken) + 1) if (i := name + (f"_{n}" if n else "")) not in taken)
        size = sum(self.folder.size(f) for folders in tables.values() for f in folders)
        entry = {"id": ident, "filename": ident, "label": label, "trigger": trigger, "created_at": now.isoformat(), "file_count": file_count, "chunk_count": chunk_count, "size_bytes": size, "tables": dict(tables)}
        self.folder.write_text(CATALOGUE, json.dumps([*self.entries(), entry], indent=1))
        return entry

    def find(self, ident: str | None = None) -> dict:
        """A snapshot's entry, the last one without an id."""
        entries = self.entries()
        found = next((e for e in entries if e["id"] == ident), None) if ident else entries[-1] if entries else None
        if not found or not all(self.folder.exists(f) for folders in found["tables"].values() for f in folders):
            raise ValueError(f"no such snapshot: {ident}" if ident else "there is no snapshot")
        return found

    def held(self) -> set[str]:
        """The folders that any snapshot names."""
        return {f for e in self.entries() for folders in e["tables"].values() for f in folders}

    def frame(self, spark: SparkSession) -> DataFrame:
        """The catalogue as a table."""
        schema = "id string, filename string, label string, trigger string, created_at timestamp, file_count long, chunk_count long, size_bytes long"
        rows = [{**e, "created_at": datetime.datetime.fromisoformat(e["created_at"])} for e in self.entries()]
        return spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)

    def gc(self, max_age_days: int = MAX_AGE_DAYS, max_count: int = MAX_SNAPSHOTS, now: datetime.datetime | None = None, live: Iterable[str] = ()) -> int:
        """Remove expired snapshots, and the folders that neither a kept one nor ``live`` names; the number of snapshots."""
        limit = ((now or datetime.datetime.now()) - datetime.timedelta(days=max_age_days)).isoformat()
        entries, before = self.entries(), self.held()
        young = [e for e in entries if e["created_at"] >= limit]
        kept = sorted(young, key=lambda e: (e["created_at"], e["id"]))[-max_count:] if max_count > 0 else []
        names = {e["id"] for e in kept}
        self.folder.write_text(CATALOGUE, json.dumps([e for e in entries if e["id"] in names], indent=1))
        for path in before - self.held() - set(live):
            self.folder.delete(path)
        return len(entries) - len(kept)

    def export_to(self, target: Folder | None) -> str | None:
        """Write the last snapshot's tables, by Spark, and the catalogue to another folder; the snapshot's path there,
        None without a folder or a snapshot."""
        if target is None or not self.entries():
            return None
        last = self.find()
        for name, folders in last["tables"].items():
            self.folder.spark.read.parquet(*map(self.folder.path, folders)).write.mode("overwrite").parquet(target.path(f"{last['id']}/{name}"))
        target.write_text(CATALOGUE, json.dumps(self.entries(), indent=1))
        return target.path(last["id"])
