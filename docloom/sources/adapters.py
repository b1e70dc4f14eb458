"""Services outside the engine, as small protocols with deterministic stand-ins."""

from __future__ import annotations

import hashlib
import json
import urllib.parse
import urllib.request
import uuid
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.config import EngineConfig
from docloom.functions.text import FIELD_LIMITS, trim_to_words


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class LanguageModel(Protocol):
    def generate(self, prompt: str) -> str: ...


class ExternalSearch(Protocol):
    def search(self, query: str, k: int) -> list[dict]: ...


class PageExtractor(Protocol):
    def pages(self, content: bytes) -> list[str]: ...


class HashEmbedder:
    """Unit vectors from hashed words: equal texts get equal vectors, shared words bring texts closer."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for row, text in zip(out, texts, strict=True):
            for word in (text or "").lower().split():
                h = int.from_bytes(hashlib.sha256(word.encode()).digest()[:8], "little")
                row[h % self.size] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


class EchoModel:
    """A draft from the prompt alone."""

    def generate(self, prompt: str) -> str:
        return "Draft " + hashlib.sha256(prompt.encode()).hexdigest()[:16]


class VaryingModel:
    """Another draft each time it is asked, as a sampling model gives; all of one length."""

    def generate(self, prompt: str) -> str:
        return "Draft " + uuid.uuid4().hex[:16]


class HttpModel:
    """POST {base}/generate with a prompt; the answer's text."""

    def __init__(self, config: EngineConfig):
        config.assert_internal()
        self.config = config

    def generate(self, prompt: str) -> str:
        body = json.dumps({"prompt": prompt, "max_tokens": self.config.max_tokens, "temperature": self.config.temperature}).encode()
        request = urllib.request.Request(f"{self.config.service_url}/generate", body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=30) as answer:
            return json.load(answer).get("text", "")


class NoSearch:
    """External search switched off."""

    def search(self, query: str, k: int) -> list[dict]:
        return []


class HttpSearch:
    """GET {base}?q=&k= with a list of items as answer."""

    def __init__(self, base: str):
        self.base = base

    def search(self, query: str, k: int) -> list[dict]:
        with urllib.request.urlopen(f"{self.base}?{urllib.parse.urlencode({'q': query, 'k': k})}", timeout=10) as answer:
            return json.load(answer).get("items", [])[:k]


class PlainPages:
    """Pages of plain text, split at form feeds."""

    def pages(self, content: bytes) -> list[str]:
        return content.decode("utf-8", "replace").split("\f")


def embed(df: DataFrame, embedder: Embedder, text: str = "text", column: str = "embedding") -> DataFrame:
    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(embedder.embed(texts.fillna("").tolist()).astype(np.float32)))

    return df.withColumn(column, run(F.col(text)))


def generate(prompts: DataFrame, model: LanguageModel, config: EngineConfig | None = None, column: str = "prompt") -> DataFrame:
    """prompts with draft, trimmed to the most words."""
    config = config or EngineConfig()

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(model.generate)

    return prompts.withColumn("draft", trim_to_words(run(F.col(column)), config.max_words))


def search(gated: DataFrame, engine: ExternalSearch, k: int = 3, ttl_seconds: int = 600) -> DataFrame:
    """gated(query_id, abstract, now) -> (query_id, ord, title, url, text, expires_at): fields cut to their limits.
    Only questions that the gate lets out should come here; what is stored of them goes after their time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(q, i, *(str(item.get(f, ""))[:n] for f, n in FIELD_LIMITS.items()), now) for q, a, now in zip(frame["query_id"], frame["abstract"], frame["now"], strict=True) for i, item in enumerate(engine.search(a, k)[:k])]
            yield pd.DataFrame(rows, columns=["query_id", "ord", "title", "url", "text", "now"])

    out = gated.select("query_id", "abstract", "now").mapInPandas(run, f"query_id {dict(gated.dtypes)['query_id']}, ord int, title string, url string, text string, now timestamp")
    return out.withColumn("expires_at", F.col("now") + F.expr(f"INTERVAL {ttl_seconds} SECONDS")).drop("now")


def extract_pages(files: DataFrame, extractor: PageExtractor, fallback: PageExtractor | None = None) -> DataFrame:
    """files(path, content) -> (file_name, page_no, text). If all pages are blank or the extractor fails, the fallback
    starts over; blank pages of the first try aren't kept beside its own."""

    def read(content: bytes) -> list[str]:
        try:
            pages = extractor.pages(content)
        except Exception:
            pages = []
        if fallback is not None and not any(p.strip() for p in pages):
            pages = fallback.pages(content)
        return pages

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(path, n, text) for path, content in zip(frame["path"], frame["content"], strict=True) for n, text in enumerate(read(content), 1)]
            yield pd.DataFrame(rows, columns=["file_name", "page_no", "text"])

    return files.select("path", "content").mapInPandas(run, "file_name string, page_no int, text string")
