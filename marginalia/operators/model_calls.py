"""Batched model calls: embeddings and chat as plain Python callables.

A model is a callable on a list of texts. It runs inside tasks on Arrow batches, so the number of
partitions of the calling stage is the number of concurrent callers. Rows are called once per task
attempt; cut the lineage after a call (``session.cut_lineage``) before branching on its result.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.config import CallLimits, Settings
from marginalia.functions.rows import explode_array
from marginalia.functions.tokens import TokenizerFactory, count_tokens
from marginalia.operators.numbered import parse_numbered
from marginalia.operators.prompts import (
    DOC_CONTEXT_SYSTEM_PROMPT,
    ENTITY_CONTEXT_SYSTEM_PROMPT,
    doc_context_prompt,
    entity_batch_prompt,
    entity_section,
)


class EmbeddingModel(Protocol):
    def __call__(self, texts: Sequence[str]) -> np.ndarray: ...


class ChatModel(Protocol):
    def __call__(self, systems: Sequence[str], prompts: Sequence[str]) -> list[str]: ...


#: Words whose slots a model remembers.
MOST_WORDS = 200_000


class HashedWords:
    """Deterministic offline embedding: hashed word counts on the unit sphere."""

    in_task = True

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim
        self._slots: dict[str, int] = {}

    def _slot(self, word: str) -> int:
        if word not in self._slots:
            if len(self._slots) >= MOST_WORDS:
                self._slots.clear()
            self._slots[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.dim
        return self._slots[word]

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        result = np.zeros((len(texts), self.dim))
        for row, text in enumerate(texts):
            slots = [self._slot(word) for word in re.findall(r"\w+", text.lower())]
            counts = np.bincount(slots, minlength=self.dim) if slots else np.zeros(self.dim)
            norm = np.sqrt(float(np.dot(counts, counts)))
            result[row] = counts / norm if norm else counts
        return result.astype(np.float32)


class TemplateChat:
    """Deterministic offline chat model: answers with the first words of the prompt's last lines."""

    in_task = True

    def __init__(self, words: int = 12) -> None:
        self.words = words

    def __call__(self, systems: Sequence[str], prompts: Sequence[str]) -> list[str]:
        return [" ".join(prompt.split()[: self.words]) for prompt in prompts]


def call_with_retries(call: Callable[[], object], retries: int, wait: float = 1.0) -> object:
    for attempt in range(retries + 1):
        try:
            return call()
        except Exception:
            if attempt == retries:
                raise
            time.sleep(wait * 2**attempt)
    raise AssertionError("unreachable")


class Pace:
    """Waits of one lane, so that all lanes together stay below the limits of an endpoint."""

    def __init__(
        self,
        limits: CallLimits,
        clock: Callable[[], float] = time.monotonic,
        sleep: Callable[[float], None] = time.sleep,
    ) -> None:
        share = 60.0 * limits.concurrency
        self.request_seconds = share / limits.requests_per_minute if limits.paced else 0.0
        self.token_seconds = share / limits.tokens_per_minute if limits.paced else 0.0
        self.clock, self.sleep, self.free_at = clock, sleep, 0.0

    def wait(self, texts: Sequence[str]) -> None:
        """Wait for the next request; ``texts`` are what it sends, at one token per four characters."""
        if not self.request_seconds:
            return
        now = self.clock()
        if self.free_at > now:
            self.sleep(self.free_at - now)
        tokens = sum(-(-len(text) // 4) for text in texts)
        self.free_at = max(now, self.free_at) + max(self.request_seconds, tokens * self.token_seconds)


def held_limits(limits: CallLimits, model: object) -> CallLimits:
    """The limits of calls to ``model``: a model inside the task has no endpoint to spare."""
    return replace(limits, paced=limits.paced and not getattr(model, "in_task", False))


def in_lanes(df: DataFrame, limits: CallLimits, model: object = None) -> DataFrame:
    """Rows in as many partitions as there may be calls at once, if the limits are to be held."""
    return df.repartition(limits.concurrency) if held_limits(limits, model).paced else df


def _batches(total: int, size: int) -> Iterator[slice]:
    for at in range(0, total, size):
        yield slice(at, at + size)


def _texts(column: pa.Array, part: slice) -> list[str]:
    """The texts of one request; no others of the batch are Python strings meanwhile."""
    return ["" if text is None else text for text in column[part].to_pylist()]


def _calls(name: str, results: pa.Array, errors: list) -> pa.Array:
    return pa.StructArray.from_arrays([results, pa.array(errors, pa.string())], names=[name, "error"])


def embed_texts(
    text: Column, model: EmbeddingModel, limits: CallLimits | None = None, wait: float = 1.0
) -> Column:
    """Struct (embedding, error) of a text column; requests hold twice the configured batch size."""
    limits = held_limits(limits or CallLimits(), model)
    size, retries = limits.batch_size * 2, limits.retries

    @F.arrow_udf("embedding array<float>, error string")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pace = Pace(limits)
        for texts in batches:
            done = []
            for part in _batches(len(texts), size):
                chunk = _texts(texts, part)

                def call():
                    pace.wait(chunk)
                    return model(chunk)

                try:
                    found = np.asarray(call_with_retries(call, retries, wait), np.float32)
                    if len(found) != len(chunk):
                        raise ValueError(f"{len(found)} vectors for {len(chunk)} texts")
                    vectors: list = list(found)
                    errors: list = [None] * len(chunk)
                except Exception as error:  # the row carries its failure
                    vectors = [None] * len(chunk)
                    errors = [str(error) or type(error).__name__] * len(chunk)
                done.append(_calls("embedding", pa.array(vectors, pa.list_(pa.float32())), errors))
            yield pa.concat_arrays(done or [_calls("embedding", pa.array([], pa.list_(pa.float32())), [])])

    return embed(text)


def embed_chunks(
    df: DataFrame,
    model: EmbeddingModel,
    text_col: str = "contextual_text",
    limits: CallLimits | None = None,
    keep_errors: bool = False,
) -> DataFrame:
    """Add ``embedding``; with ``keep_errors`` also ``error``, else a failed call fails the job."""
    limits = limits or CallLimits()
    called = in_lanes(df, limits, model).withColumn("_call", embed_texts(F.col(text_col), model, limits))
    if keep_errors:
        return called.select(*df.columns, "_call.embedding", "_call.error")
    checked = F.when(
        F.col("_call.error").isNotNull(), F.raise_error(F.concat(F.lit("embedding failed: "), "_call.error"))
    ).otherwise(F.col("_call.embedding"))
    return called.withColumn("embedding", checked).drop("_call")


def chat_texts(
    system: Column, prompt: Column, model: ChatModel, limits: CallLimits | None = None, wait: float = 1.0
) -> Column:
    """Struct (answer, error) of one chat call per row."""
    limits = held_limits(limits or Settings().chat, model)
    size, retries = max(1, limits.batch_size), limits.retries

    @F.arrow_udf("answer string, error string")
    def chat(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        pace = Pace(limits)
        for systems, prompts in batches:
            done = []
            for part in _batches(len(prompts), size):
                asked = _texts(systems, part), _texts(prompts, part)

                def call():
                    pace.wait([*asked[0], *asked[1]])
                    return model(*asked)

                try:
                    found = list(call_with_retries(call, retries, wait))
                    if len(found) != len(asked[1]):
                        raise ValueError(f"{len(found)} answers for {len(asked[1])} prompts")
                    answers: list = found
                    errors: list = [None] * len(found)
                except Exception as error:  # the row carries its failure
                    answers = [None] * len(asked[1])
                    errors = [str(error) or type(error).__name__] * len(asked[1])
                done.append(_calls("answer", pa.array(answers, pa.string()), errors))
            yield pa.concat_arrays(done or [_calls("answer", pa.array([], pa.string()), [])])

    return chat(system, prompt)


def _checked(call: str) -> Column:
    return F.when(
        F.col(f"{call}.error").isNotNull(), F.raise_error(F.concat(F.lit("call failed: "), F.col(f"{call}.error")))
    ).otherwise(F.col(f"{call}.answer"))


def contextual_text(source_type: Column, header: Column, content: Column) -> Column:
    """Header and content of a chunk. Docs are joined by ``---`` alone, code by lines."""
    clean = F.trim(F.coalesce(header, F.lit("")))
    return F.when(source_type == "doc", F.concat(clean, F.lit("---"), content)).otherwise(
        F.when(clean == "", content).otherwise(F.concat(clean, F.lit("\n---\n"), content))
    )


def doc_context(chunks: DataFrame, documents: DataFrame, model: ChatModel, limits: CallLimits | None = None) -> DataFrame:
    """Add ``header`` to documentation chunks: one call per chunk, with its whole document.

    A document meets its chunks as one row; the prompts, each with the whole document, are made in the task
    that calls the model and are never moved.
    """
    gathered = chunks.groupBy("filepath").agg(F.collect_list(F.struct(*chunks.columns)).alias("_chunks"))
    asked = gathered.join(documents.select("filepath", F.col("content").alias("_document")), "filepath")
    limits = limits or Settings().chat
    rows = in_lanes(asked, limits, model).select("_document", F.explode("_chunks").alias("_chunk"))
    prompt = doc_context_prompt(F.col("_chunk.content"), F.col("_document"))
    called = rows.withColumn("_call", chat_texts(F.lit(DOC_CONTEXT_SYSTEM_PROMPT), prompt, model, limits))
    return called.select("_chunk.*", F.trim(_checked("_call")).alias("header"))


def entity_context(
    chunks: DataFrame, files: DataFrame, model: ChatModel, batch: int = 5, limits: CallLimits | None = None
) -> DataFrame:
    """Add ``header`` to code chunks: one call per batch of chunks of one file.

    ``chunks`` has filepath, chunk_id, entity_type, name, parent_context, doc, content, start_line
    and end_line; ``files`` has filepath, content and imports. A group is one batch, never a file.
    """
    order = Window.partitionBy("filepath").orderBy("chunk_id")
    entity = F.struct(
        "chunk_id", "entity_type", "name", "parent_context", "doc", F.col("content").alias("code"), "start_line", "end_line"
    )
    batches = (
        chunks.withColumn("_batch", F.floor((F.row_number().over(order) - 1) / batch))
        .groupBy("filepath", "_batch")
        .agg(F.array_sort(F.collect_list(entity)).alias("_entities"))
        .join(files.select("filepath", F.col("content").alias("_document"), "imports"), "filepath")
    )
    sections = F.transform("_entities", lambda e, i: entity_section(i + 1, e))
    prompt = entity_batch_prompt(sections, F.col("filepath"), F.col("imports"), F.col("_document"))
    limits = limits or Settings().chat
    called = (
        in_lanes(batches.withColumn("_prompt", prompt), limits, model)
        .withColumn("_call", chat_texts(F.lit(ENTITY_CONTEXT_SYSTEM_PROMPT), F.col("_prompt"), model, limits))
        .withColumn("_answer", _checked("_call"))
        .withColumn("_headers", parse_numbered(F.col("_answer"), F.size("_entities")))
    )
    headers = explode_array(called, ["filepath", "_entities", "_headers"], F.col("_entities"), "_i", "_e").select(
        "filepath", F.col("_e.chunk_id").alias("chunk_id"), F.trim(F.get("_headers", F.col("_i"))).alias("header")
    )
    return chunks.join(headers, ["filepath", "chunk_id"])


def estimate_call_tokens(
    system: Column,
    prompt: Column,
    kind: str,
    max_output_tokens: int | None = None,
    tokenizer: TokenizerFactory | None = None,
) -> Column:
    """Tokens to reserve for a call: texts plus the output allowance of its kind."""
    if kind == "entity":
        allowance = max_output_tokens if max_output_tokens is not None else 500
    elif kind == "doc":
        allowance = min(250, max_output_tokens if max_output_tokens is not None else 250)
    elif kind == "answer":
        allowance = max_output_tokens if max_output_tokens is not None else 2000
    else:
        raise ValueError(f"unknown kind of call: {kind}")
    return count_tokens(system, tokenizer) + count_tokens(prompt, tokenizer) + F.lit(allowance)


def plan_requests(
    df: DataFrame,
    requests_per_minute: int,
    tokens_per_minute: int,
    lanes: int,
    batch: int = 1,
    order_col: str = "id",
    tokens_col: str = "tokens",
    block: int = 100_000,
) -> DataFrame:
    """Minute slot of each request batch under a request and a token budget.

    A lane (id modulo ``lanes``) is one concurrent caller with its share of both budgets. Within a
    lane batches are sent in order, and a batch goes to the slot where the requests and the tokens
    so far, itself included, fit. The running sums go over blocks of ``block`` ids first and over
    the few block totals then, so no task holds a whole lane.
    """
    request_cap = max(1, requests_per_minute // lanes)
    token_cap = max(1, tokens_per_minute // lanes)
    keys = ["lane", "block"]
    in_block = Window.partitionBy(*keys)
    batches = (
        df.select(
            F.pmod(F.col(order_col), F.lit(lanes)).cast("int").alias("lane"),
            F.floor(F.col(order_col) / block).alias("block"),
            order_col,
            tokens_col,
        )
        .withColumn("batch", F.floor((F.row_number().over(in_block.orderBy(order_col)) - 1) / batch))
        .groupBy(*keys, "batch")
        .agg(
            F.count("*").alias("items"),
            # A single request never reserves more than the whole budget.
            F.least(F.sum(tokens_col), F.lit(token_cap)).alias("tokens"),
        )
    )
    totals = batches.groupBy(*keys).agg(F.sum("tokens").alias("_t"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("lane").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_tokens_before"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_batches_before"),
    )
    running = in_block.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    return (
        batches.withColumn("_used", F.sum("tokens").over(running))
        .join(offsets, keys)
        .withColumn("_used", F.col("_used") + F.col("_tokens_before"))
        .withColumn("_sent", F.col("batch") + F.col("_batches_before"))
        .withColumn(
            "slot",
            F.greatest(F.floor((F.col("_used") - 1) / token_cap), F.floor(F.col("_sent") / request_cap)),
        )
        .select(*keys, "batch", "items", "tokens", "slot")
    )
