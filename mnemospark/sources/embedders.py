"""Embedding connectors: an interface, a deterministic local one, and HTTP ones behind a breaker."""

from __future__ import annotations

import hashlib
import importlib.util
import json
import os
import time
import urllib.request
from collections import deque
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Embedder(Protocol):
    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Counts of hashed words at length one; the same on every machine, for tests and work without a network."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dims))
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                out[i, int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % self.dims] += 1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0).tolist()


class Breaker:
    """Refuses calls while the failures of the last `window` seconds are `most` or more; older ones are forgotten, so it closes by itself."""

    def __init__(self, most: int = 5, window: float = 60, clock: Callable[[], float] = time.monotonic):
        self.most, self.window, self.clock = most, window, clock
        self.times: deque[float] = deque(maxlen=most)

    def check(self) -> None:
        if len(self.times) == self.most and self.clock() - self.times[0] < self.window:
            raise ConnectionError("the embedding service failed too often; not asked for now")

    def note(self, ok: bool) -> None:
        """An answer wipes the slate."""
        if ok:
            self.times.clear()
        else:
            self.times.append(self.clock())


class HttpEmbedder:
    """A service that takes JSON with a model and texts; `form` says how: openai and voyage answer with data[].embedding in order of index, ollama with embeddings[]."""

    FORMS = {"openai": "/embeddings", "voyage": "/embeddings", "ollama": "/api/embed"}

    def __init__(self, url: str, model: str, key: str | None = None, form: str = "openai", dims: int | None = None, attempts: int = 3, send: Callable[[urllib.request.Request], bytes] | None = None, wait: Callable[[float], None] = time.sleep):
        path = self.FORMS[form]
        self.url = url if url.endswith(path) else url.rstrip("/") + path
        self.model, self.key, self.form, self.dims, self.attempts, self.wait = model, key, form, dims, attempts, wait
        self.send = send or (lambda r: urllib.request.urlopen(r, timeout=60).read())
        self.breaker = Breaker()

    def request(self, texts: list[str]) -> urllib.request.Request:
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        body: dict = {"model": self.model, "input": texts}
        if self.dims and self.form == "openai":
            body["dimensions"] = self.dims
        if self.form == "voyage":
            body["input_type"] = "document"
        return urllib.request.Request(self.url, json.dumps(body).encode(), head)

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        """Vectors in the order of the texts; tried again after 1, 2, 4 ... seconds."""
        for n in range(self.attempts):
            self.breaker.check()
            try:
                got = json.loads(self.send(self.request(texts)))
            except OSError:
                self.breaker.note(False)
                if n + 1 == self.attempts:
                    raise
                self.wait(2.0**n)
                continue
            self.breaker.note(True)
            return got["embeddings"] if "embeddings" in got else [d["embedding"] for d in sorted(got["data"], key=lambda d: d.get("index", 0))]
        raise AssertionError


class LocalEmbedder:
    """A model of the sentence-transformers library on the worker itself, loaded once; an ImportError where the library is missing."""

    def __init__(self, model: str = "all-MiniLM-L6-v2", load: Callable[[str], object] | None = None):
        if load is None:
            from sentence_transformers import SentenceTransformer as load  # noqa: N813
        self.loaded = load(model)

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [list(map(float, v)) for v in self.loaded.encode(texts)]


def _http(form: str, url: str, model: str) -> Callable[..., Embedder]:
    return lambda **o: HttpEmbedder(**{"url": url, "model": model, "form": form} | o)


REGISTRY: dict[str, Callable[..., Embedder]] = {
    "hash": HashEmbedder, "local": LocalEmbedder, "http": HttpEmbedder, "ollama": _http("ollama", "http://localhost:11434", "nomic-embed-text"), "openai": _http("openai", "https://api.openai.com/v1", "text-embedding-3-small"),
    "anthropic": _http("voyage", "https://api.voyageai.com/v1", "voyage-3"),
}


def detect(probes: list[tuple[str, Callable[[], bool]]]) -> str:
    """The first kind whose probe holds; probes that fail count as no."""
    for kind, there in probes:
        try:
            if there():
                return kind
        except (OSError, ImportError):
            continue
    raise RuntimeError("no embedding provider found; name one of " + ", ".join(sorted(REGISTRY)))


def usual_probes() -> list[tuple[str, Callable[[], bool]]]:
    """A local service, then a local library, then a key of a remote one."""
    return [
        ("ollama", lambda: urllib.request.urlopen("http://localhost:11434/api/tags", timeout=2).status == 200),
        ("local", lambda: importlib.util.find_spec("sentence_transformers") is not None),
        ("openai", lambda: bool(os.environ.get("OPENAI_API_KEY"))),
    ]


def make_embedder(kind: str = "hash", probes: list[tuple[str, Callable[[], bool]]] | None = None, **options) -> Embedder:
    kind = detect(probes or usual_probes()) if kind == "auto" else kind
    if kind not in REGISTRY:
        raise ValueError(f"unknown embedder {kind!r}; known: auto, {', '.join(sorted(REGISTRY))}")
    if kind == "openai" and "key" not in options and os.environ.get("OPENAI_API_KEY"):
        options["key"] = os.environ["OPENAI_API_KEY"]
    return REGISTRY[kind](**options)


def embed(text: Column, make: Callable[[], Embedder]) -> Column:
    """Vectors of a text column: one client per task, a request per Arrow batch. Null texts give null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = make()
        for s in batches:
            known = s.notna()
            out = pd.Series([None] * len(s), dtype=object)
            if known.any():
                out[known.to_numpy()] = pd.Series(client.embed_batch(s[known].tolist()), index=out.index[known.to_numpy()])
            yield out

    return F.pandas_udf(run, "array<float>")(text)
