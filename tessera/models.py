"""Model calls behind one interface, with a deterministic stand-in that needs no network."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Column


class Provider(Protocol):
    def ping(self) -> bool: ...
    def embed(self, texts: list[str]) -> list[list[float] | None]: ...
    def generate(self, prompts: list[str]) -> list[str]: ...


class HashProvider:
    """Embeddings from hashed words; answers that repeat the start of the prompt."""

    def __init__(self, width: int = 64):
        self.width = width

    def ping(self) -> bool:
        return True

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        out = []
        for t in texts:
            v = [0.0] * self.width
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % self.width] += 1.0 if h >> 63 else -1.0
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n else None)
        return out

    def generate(self, prompts: list[str]) -> list[str]:
        return [f"SUMMARY: {' '.join(p.split()[:12])}\nOPEN: —" for p in prompts]


def apply(df: DataFrame, key: str, text: str, provider: Provider, task: str = "generate", retries: int = 3) -> DataFrame:
    """(key, result, error) of a task, a batch at a time in every partition; a failing batch is tried again, row by row last."""
    kind = "array<double>" if task == "embed" else "string"
    result = pa.list_(pa.float64()) if task == "embed" else pa.string()

    def one_by_one(call, texts: list[str]) -> Iterator[tuple]:
        for t in texts:
            try:
                yield call([t])[0], None
            except Exception as e:
                yield None, repr(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = getattr(provider, task)
        for b in batches:
            texts, pairs = [t or "" for t in b.column(1).to_pylist()], None
            for _ in range(retries):
                try:
                    pairs = [(r, None) for r in call(texts)]
                    break
                except Exception:
                    continue
            pairs = list(one_by_one(call, texts)) if pairs is None else pairs
            results, errors = zip(*pairs, strict=True) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(results, result), pa.array(errors, pa.string())], [key, "result", "error"])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, result {kind}, error string")


def thread_text(df: DataFrame, key: str, order: list[str], text: str, each: int = 600, most: int = 6000, mark: str = " […]", separator: str = "\n---\n") -> DataFrame:
    """(key, n, thread): a thread's texts in order, each cut and marked, joined, and cut again."""
    cut = lambda c, n: F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, text))).alias("x"))
    joined: Column = F.array_join(F.transform("x", lambda s: cut(s[text], each)), separator)
    return rows.select(key, F.size("x").alias("n"), cut(joined, most).alias("thread"))
