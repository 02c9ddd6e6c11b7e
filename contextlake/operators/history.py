"""The history of searches: a short list with a JSON form that survives restarts."""

from __future__ import annotations

import datetime
import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from contextlake.schema import HISTORY
from contextlake.storage import Folder

STATE_VERSION, STATE_FILE = 1, "state.json"


class SearchHistory:
    """The last ``cap`` searches, in memory of the driver; bounded by the cap."""

    def __init__(self, cap: int = 100, enabled: bool = True):
        self.cap, self.enabled, self.items = cap, enabled, []
        self._seq = 0

    def record(self, query: str | None, result_count: int, now: datetime.datetime | None = None) -> None:
        """Note a search; blank queries aren't noted."""
        text = query.strip() if isinstance(query, str) else ""
        if not self.enabled or not text:
            return
        self._seq += 1
        self.items = [*self.items, {"seq": self._seq, "query": text, "timestamp": (now or datetime.datetime.now(datetime.timezone.utc)).isoformat(), "result_count": int(result_count)}][-self.cap :]

    def recent(self, limit: int = 10) -> list[str]:
        """The last different queries, newest first, in their newest spelling."""
        found: dict[str, str] = {}
        for item in reversed(self.items):
            found.setdefault(item["query"].strip().lower(), item["query"])
        return list(found.values())[: max(0, limit)]

    def frame(self, spark: SparkSession) -> DataFrame:
        """The history as a table."""
        return spark.createDataFrame([(i["seq"], i["query"], datetime.datetime.fromisoformat(i["timestamp"]), i["result_count"]) for i in self.items], HISTORY)

    def export_state(self, hot_files: list[str] | None = None, **notes: Any) -> dict[str, Any]:
        """All that is saved: the history, the files accessed most, and ``notes`` such as counts."""
        return {"version": STATE_VERSION, "saved_at": datetime.datetime.now(datetime.timezone.utc).isoformat(), **notes, "hot_files": list(hot_files or []), "history": self.items}

    def save(self, folder: Folder, name: str = STATE_FILE, hot_files: list[str] | None = None, **notes: Any) -> None:
        """Write the state as a whole."""
        folder.write_text(name, json.dumps(self.export_state(hot_files, **notes)))

    def load(self, folder: Folder, name: str = STATE_FILE) -> dict[str, Any] | None:
        """Read a state; None, and no change, if it is missing, broken or of another version. Entries whose fields
        have other types are left out."""
        try:
            state = json.loads(folder.read_text(name) or "")
        except ValueError:
            return None
        if not isinstance(state, dict) or state.get("version") != STATE_VERSION or not isinstance(state.get("saved_at"), str) or not isinstance(state.get("history"), list):
            return None
        types = {"query": str, "timestamp": str, "result_count": int}
        good = [i for i in state["history"] if isinstance(i, dict) and all(isinstance(i.get(k), t) for k, t in types.items())]
        self.items = [{**i, "seq": n} for n, i in enumerate(good, 1)][-self.cap :]
        self._seq = self.items[-1]["seq"] if self.items else 0
        return state
