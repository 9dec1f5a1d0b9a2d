"""What lives outside: encoder, generator, translator and judge, each behind a small interface with an offline default."""

from __future__ import annotations

import json
import os
import time
import urllib.request
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.config import DEFAULT, Config
from lodestone.functions.images import black_png, is_image
from lodestone.functions.text import has_chinese, without_label
from lodestone.operators.context import SYSTEM, judgement
from lodestone.session import importable, stored


class Embedder(Protocol):
    dim: int

    def encode_texts(self, texts: list[str | None]) -> np.ndarray: ...


class ImageEmbedder(Protocol):
    dim: int

    def encode_images(self, contents: list[bytes]) -> np.ndarray: ...


class TextGenerator(Protocol):
    def generate(self, prompts: list[str]) -> list[tuple[str, str]]: ...


class Translator(Protocol):
    def translate(self, texts: list[str]) -> list[str]: ...


class Judge(Protocol):
    def grade(self, prompts: list[str]) -> list[str]: ...


class SameText:
    """A translator that leaves texts as they are."""

    def translate(self, texts: list[str]) -> list[str]:
        return list(texts)


class HashingEmbedder:
    """Feature hashing of words, unit length: deterministic, needs no model. An empty text is the zero vector."""

    def __init__(self, dim: int = 64, max_tokens: int | None = 77):
        self.dim, self.max_tokens = dim, max_tokens

    def encode_texts(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in (text or "").lower().split()[: self.max_tokens]:
                h = xxhash.xxh64_intdigest(word)
                row[h % self.dim] += 1.0 if h >> 63 else -1.0
        return out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-10)


class HashingImageEmbedder:
    """Feature hashing of runs of four bytes, unit length: equal files have equal vectors, and that is all it knows."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode_images(self, contents: list[bytes]) -> np.ndarray:
        out = np.zeros((len(contents), self.dim), np.float32)
        for row, content in zip(out, contents, strict=True):
            raw = np.frombuffer(content + bytes(-len(content) % 4), "<u4").astype(np.uint64)
            mixed = raw * np.uint64(0x9E3779B97F4A7C15)
            slots, signs = (mixed >> np.uint64(32)) % np.uint64(self.dim), np.where(mixed >> np.uint64(63), 1.0, -1.0)
            row += np.bincount(slots.astype(np.int64), signs, self.dim)
        return out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-10)


def encoder(config: Config = DEFAULT) -> HashingEmbedder:
    """The encoder that the settings name; only the one that needs no model is built in."""
    if config.encoder_model != "hashing":
        raise ValueError(f"no encoder {config.encoder_model!r} is built in: pass an Embedder")
    return HashingEmbedder()


class HttpGenerator:
    """A chat endpoint of the usual form. A failure is a status of its own with its reason, never an answer.

    The key is sent with every call; where it isn't given, each process takes it from LLM_API_KEY in its own environment, so
    that it travels in no plan. ``budget`` is how many seconds a batch of prompts may take: what is left then isn't asked.
    """

    def __init__(self, url: str, model: str, system: str = SYSTEM, timeout: float = 60.0, attempts: int = 2, max_tokens: int = 512, temperature: float = 0.7, key: str | None = None, budget: float = 3600.0):
        self.url, self.model, self.system = url.rstrip("/"), model, system
        self.key, self.budget = key, budget
        self.timeout, self.attempts, self.max_tokens, self.temperature = timeout, attempts, max_tokens, temperature

    def _call(self, path: str, body: dict | None = None) -> dict:
        data = None if body is None else json.dumps(body).encode()
        key = self.key or os.environ.get("LLM_API_KEY", "")
        headers = {"Content-Type": "application/json", **({"Authorization": f"Bearer {key}"} if key else {})}
        request = urllib.request.Request(f"{self.url}/{path}", data, headers)  # noqa: S310
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:  # noqa: S310
            return json.load(reply)

    def connected(self) -> bool:
        """Whether the endpoint answers and knows the model."""
        try:
            return self.model in [m.get("id") for m in self._call("models").get("data", [])]
        except (OSError, ValueError):
            return False

    def generate(self, prompts: list[str]) -> list[tuple[str, str]]:
        until, out = time.monotonic() + self.budget, []
        for prompt in prompts:
            out.append(self._one(prompt) if time.monotonic() < until else ("error", "out of time"))
        return out

    def _one(self, prompt: str) -> tuple[str, str]:
        messages = [{"role": "system", "content": self.system}, {"role": "user", "content": prompt}]
        reason = ""
        for _ in range(self.attempts):
            try:
                reply = self._call("chat/completions", {"model": self.model, "messages": messages, "max_tokens": self.max_tokens, "temperature": self.temperature})
                said = (reply["choices"][0]["message"]["content"] or "").strip()
                return ("ok", said) if said else ("empty", "")
            except (OSError, ValueError, KeyError, IndexError, TypeError) as e:
                reason = f"{type(e).__name__}: {e}"
        return "error", reason


def generator(config: Config = DEFAULT):
    """The endpoint that the settings name, or the template where they name none."""
    return HttpGenerator(config.generator_url, config.generator_model) if config.generator_url else TemplateGenerator()


class TemplateGenerator:
    """Answers with the first line of the context. Every answer has a status, so a failure is never taken for one."""

    def generate(self, prompts: list[str]) -> list[tuple[str, str]]:
        found = (next((line for line in p.splitlines() if line.startswith("[")), "") for p in prompts)
        return [("ok", f"Best match: {line}") if line else ("empty", "") for line in found]


def embedded_images(df: DataFrame, embedder: ImageEmbedder, key: str, content_col: str = "content", batch: int = 64) -> DataFrame:
    """key, embedding, replaced: of every picture; one that is null or no picture is replaced by a black one."""
    importable(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), F.col(content_col).alias("content"))
    black = black_png()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                contents = part["content"].to_pylist()
                bad = [not is_image(c) for c in contents]
                found = embedder.encode_images([black if gone else c for gone, c in zip(bad, contents, strict=True)])
                yield pa.RecordBatch.from_arrays([part["key"], pa.array(list(found), pa.list_(pa.float32())), pa.array(bad, pa.bool_())], ["key", "embedding", "replaced"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, embedding array<float>, replaced boolean").withColumnRenamed("key", key)


def embedded(df: DataFrame, embedder: Embedder, text_col: str, key: str, batch: int = 64) -> DataFrame:
    """key, embedding of every row, in batches on the executors."""
    importable(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                yield pa.RecordBatch.from_arrays([part["key"], pa.array(list(embedder.encode_texts(part["text"].to_pylist())), pa.list_(pa.float32()))], ["key", "embedding"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, embedding array<float>").withColumnRenamed("key", key)


def _mapped(df: DataFrame, key: str, value: str, out: str, call, batch: int) -> DataFrame:
    """key and out: what ``call`` makes of the values, a batch at a time on the executors."""
    importable(df.sparkSession)
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(value).alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                yield pa.RecordBatch.from_arrays([part["key"], pa.array(call([v or "" for v in part["value"].to_pylist()]), pa.string())], ["key", "out"])

    return rows.mapInArrow(run, "key bigint, out string").withColumnsRenamed({"key": key, "out": out})


def translated(queries: DataFrame, translator: Translator, batch: int = 16) -> DataFrame:
    """The queries with ``text`` in English: only those with Chinese characters are sent, and an empty reply keeps the text."""
    sent = _mapped(queries.where(has_chinese(F.col("text"))), "q_id", "text", "reply", translator.translate, batch)
    new = F.coalesce(F.nullif(without_label(F.col("reply")), F.lit("")), F.col("text"))
    return queries.join(sent, "q_id", "left").withColumn("text", new).drop("reply")


def graded(answers: DataFrame, judge: Judge, batch: int = 16) -> DataFrame:
    """q_id, relevance, accuracy, usefulness, comment for (q_id, prompt, answer): an empty answer is graded 1 unasked."""
    empty = F.coalesce(F.trim("answer"), F.lit("")).isin("", "(none)")
    asked = _mapped(answers.where(~empty), "q_id", "prompt", "reply", judge.grade, batch).select("q_id", judgement(F.col("reply")).alias("g")).select("q_id", "g.*")
    least = answers.where(empty).select("q_id", *[F.lit(1).alias(c) for c in ("relevance", "accuracy", "usefulness")], F.lit("no answer").alias("comment"))
    return asked.unionByName(least)


def answered(prompts: DataFrame, generator: TextGenerator, batch: int = 16) -> DataFrame:
    """q_id, status, answer for prompts (q_id, prompt)."""
    return _said(prompts.select(F.col("q_id").cast("long").alias("q_id"), "prompt"), generator, batch)


def _said(prompts: DataFrame, generator: TextGenerator, batch: int) -> DataFrame:
    """The first column with status and answer, for rows of a key and a prompt."""
    importable(prompts.sparkSession)
    key = prompts.schema[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                said = generator.generate([p or "" for p in part["prompt"].to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s for s, _ in said], pa.string()), pa.array([a for _, a in said], pa.string())], [key.name, "status", "answer"])

    return prompts.mapInArrow(run, f"{key.name} {key.dataType.simpleString()}, status string, answer string")


#: Prompts whose replies are written at once.
CHUNK = 10_000
REPLIES = "prompt_sha256 string, status string, answer string"


def answered_once(prompts: DataFrame, generator: TextGenerator, path: str, batch: int = 16) -> DataFrame:
    """q_id, status, answer as of ``answered``, from a table of replies at ``path`` that outlives the session.

    Equal prompts are asked once. Replies are written in chunks by a hash of the prompt, so a job that breaks off, or is run
    again, asks only what no chunk has yet. Failures are written too and asked again by the next call.
    """
    spark = prompts.sparkSession
    spark.createDataFrame([], REPLIES).write.mode("ignore").parquet(path)
    keyed = prompts.select("q_id", F.coalesce("prompt", F.lit("")).alias("prompt")).withColumn("prompt_sha256", F.sha2("prompt", 256))
    known = spark.read.schema(REPLIES).parquet(path).where("status <> 'error'").select("prompt_sha256")
    left = stored(keyed.select("prompt_sha256", "prompt").dropDuplicates(["prompt_sha256"]).join(known, "prompt_sha256", "left_anti"))
    chunks = -(-left.count() // CHUNK)
    for i in range(chunks):
        _said(left.where(F.pmod(F.xxhash64("prompt_sha256"), F.lit(chunks)) == i), generator, batch).write.mode("append").parquet(path)
    best = F.max_by(F.struct("status", "answer"), F.col("status") != "error").alias("reply")
    replies = spark.read.schema(REPLIES).parquet(path).groupBy("prompt_sha256").agg(best)
    return keyed.join(replies, "prompt_sha256").select("q_id", "reply.status", "reply.answer")
