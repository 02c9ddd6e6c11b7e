"""Embedders: anything that turns a list of texts into vectors may be plugged in."""

from __future__ import annotations

import json
import math
import re
import urllib.request
from collections.abc import Iterator, Mapping, Sequence
from typing import Any, Protocol

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextlake.functions.text import embedding_text
from contextlake.sources.model import current_chunks


class Embedder(Protocol):
    """What an embedder must offer; it is sent to the executors, so it must be picklable."""

    model: str

    def available(self) -> bool: ...

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """A deterministic embedder that needs no model: words are hashed to signed places, vectors have length 1."""

    def __init__(self, dimensions: int = 64):
        self.dimensions, self.model = dimensions, f"hashing-{dimensions}"

    def available(self) -> bool:
        return True

    def embed(self, text: str) -> list[float]:
        """The vector of a text; empty for a text without words."""
        vector = [0.0] * self.dimensions
        for word in re.findall(r"\w+", text.lower()):
            value = xxhash.xxh3_64_intdigest(word)
            vector[value % self.dimensions] += 1.0 if value >> 63 else -1.0
        norm = math.sqrt(sum(v * v for v in vector))
        return [v / norm for v in vector] if norm else []

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]:
        return [self.embed(t) for t in texts]


class HttpEmbedder:
    """Vectors of a model behind an HTTP service: one text for each request, to the paths of ``API`` in turn."""

    #: The paths of the two forms of the interface, and the field that each takes the text in.
    API = (("/api/embeddings", "prompt"), ("/api/embed", "input"))
    #: The characters of a text that are sent, and the seconds that an answer may take.
    MOST_CHARS, TIMEOUT = 2000, 30

    def __init__(self, model: str, endpoint: str):
        self.model, self.endpoint = model, endpoint.rstrip("/")
        self.dimensions: int | None = None
        self._available: bool | None = None

    def available(self) -> bool:
        """Whether the service gives vectors; asked once, until ``reset``."""
        if self._available is None:
            self._available = bool(self.embed("test"))
        return self._available

    def reset(self) -> None:
        """Forget what ``available`` found."""
        self._available = self.dimensions = None

    def _post(self, path: str, body: dict) -> dict:
        request = urllib.request.Request(self.endpoint + path, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.TIMEOUT) as answer:
            return json.loads(answer.read())

    def embed(self, text: str) -> list[float]:
        """The vector of a text; empty for a blank text, and where neither path gives one."""
        if not text or not text.strip():
            return []
        for path, field in self.API:
            try:
                answer = self._post(path, {"model": self.model, field: text[: self.MOST_CHARS]})
            except (OSError, ValueError):
                continue
            several = answer.get("embeddings") if isinstance(answer, dict) else None
            vector = answer.get("embedding") if isinstance(answer, dict) else None
            vector = vector if isinstance(vector, list) else several[0] if isinstance(several, list) and several else None
            if isinstance(vector, list):
                self.dimensions = len(vector)
                return vector
        return []

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]:
        return [self.embed(t) for t in texts]


def make_embedder(settings: Mapping[str, Any]) -> Embedder | None:
    """The embedder that the settings name; None where embedding is off."""
    if not settings.get("enabled"):
        return None
    if settings.get("provider", "hashing") == "hashing":
        return HashingEmbedder()
    return HttpEmbedder(settings["model"], settings["endpoint"])


def embed_column(embedder: Embedder, text: Column) -> Column:
    """The vector of each text, in Arrow batches; null texts count as empty. A batch that fails is tried text by text, and
    texts that fail have an empty vector."""

    def alone(text: str) -> list[float]:
        try:
            return embedder.embed_batch([text])[0]
        except Exception:  # noqa: BLE001
            return []

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = part.fillna("").tolist()
            try:
                vectors = embedder.embed_batch(texts)
            except Exception:  # noqa: BLE001
                vectors = [alone(t) for t in texts]
            yield pd.Series(vectors, index=part.index, dtype=object)

    return run(text)


def unembedded(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """The chunks that have no vector."""
    return chunks.join(vectors.select("chunk_id"), "chunk_id", "left_anti")


def embed_new(chunks: DataFrame, vectors: DataFrame, embedder: Embedder) -> DataFrame:
    """Rows (chunk_id, embedding, model) of the chunks without a vector, each id once; an empty vector stands for one that
    could not be made. Contents are cut to what is embedded before they are shuffled."""
    texts = current_chunks(chunks, embedding_text(F.col("name"), F.col("chunk_type"), F.col("content")).alias("text"))
    made = unembedded(texts, vectors).select("chunk_id", embed_column(embedder, F.col("text")).alias("embedding"))
    return made.withColumn("model", F.lit(embedder.model))
