"""Questions to answers over a store, as tables."""

from __future__ import annotations

import warnings

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.config import CallLimits, SearchDefaults, Settings
from marginalia.functions.text import trim_space
from marginalia.operators.hybrid import build_sources, hybrid_search, map_cited_sources, with_chunks
from marginalia.operators.keywords import keyword_search
from marginalia.operators.model_calls import ChatModel, EmbeddingModel, chat_texts, embed_chunks, in_lanes
from marginalia.operators.prompts import build_prompt
from marginalia.operators.vectors import vector_search
from marginalia.session import cut_lineage

NO_CONTEXT_ANSWER = "I could not find relevant context to answer that question."
ANSWER_SCHEMA = (
    "sources array<struct<filepath:string,chunkTitle:string,url:string>>, answer string"
)


def retrieval_params(questions: DataFrame, defaults: SearchDefaults | None = None) -> DataFrame:
    """Fill match_count, similarity_threshold, keyword_match_count and hybrid per question: the
    request's value, else the default; the keyword count falls back to the match count."""
    defaults = defaults or SearchDefaults()

    def asked(name: str, kind: str) -> Column:
        return (F.col(name) if name in questions.columns else F.lit(None)).cast(kind)

    count = F.coalesce(asked("match_count", "int"), F.lit(defaults.match_count))
    return (
        questions.withColumn("match_count", count)
        .withColumn(
            "similarity_threshold",
            F.coalesce(asked("similarity_threshold", "double"), F.lit(defaults.similarity_threshold)),
        )
        .withColumn(
            "keyword_match_count",
            F.coalesce(
                asked("keyword_match_count", "int"),
                F.lit(defaults.keyword_match_count).cast("int"),
                F.col("match_count"),
            ),
        )
        .withColumn("hybrid", F.coalesce(asked("hybrid", "boolean"), F.lit(defaults.hybrid)))
    )


def retrieve(
    questions: DataFrame,
    store: DataFrame,
    embed: EmbeddingModel,
    postings: DataFrame | None = None,
    vocabulary: DataFrame | None = None,
    defaults: SearchDefaults | None = None,
) -> DataFrame:
    """Ranked hits (query_id, rank, id, similarity, keyword_rank) of every question.

    Without postings, and with a warning where the keyword search fails, hits are those of the vectors.
    """
    asked = retrieval_params(questions, defaults).withColumn("question", trim_space(F.col("question")))
    # The vectors are used by a bounded broadcast and must not be asked for twice.
    vectors = cut_lineage(embed_chunks(asked, embed, "question").withColumnRenamed("embedding", "query_embedding"))
    similar = vector_search(store, vectors)
    if postings is None:
        similar = similar.withColumn("keyword_rank", F.lit(None).cast("double"))
        return similar.select("query_id", F.col("vector_rank").alias("rank"), "id", "similarity", "keyword_rank")
    words = vectors.filter("hybrid").select("query_id", F.col("question").alias("query"), "keyword_match_count")
    try:
        # Evaluated here, so that a failure is met here.
        found = cut_lineage(keyword_search(postings, words, vocabulary=vocabulary))
    except (PySparkException, Py4JJavaError) as error:  # the search failed as a job; the vectors still answer
        warnings.warn(f"keyword search failed, vectors alone are used: {error}", stacklevel=2)
        found = keyword_search(postings.limit(0), words.limit(0))
    limits = vectors.select("query_id", "match_count")
    # Both lists hold at most k rows per question; the limit is applied on the merged ranks.
    merged = hybrid_search(similar, found, k=F.lit(2**31 - 1))
    return merged.join(limits, "query_id").filter(F.col("rank") <= F.col("match_count")).drop("match_count")


def answer_fallback(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Every question gets an answer; without hits it is a fixed sentence without sources."""
    return questions.select("query_id").join(answers, "query_id", "left").select(
        "query_id",
        F.coalesce("answer", F.lit(NO_CONTEXT_ANSWER)).alias("answer"),
    )


def parse_answers(raw: DataFrame) -> DataFrame:
    """Rows (query_id, raw) to (query_id, answer, cited): structured answers of a chat model.
    A text that is no such structure is taken as the answer."""
    parsed = F.from_json("raw", ANSWER_SCHEMA)
    return raw.withColumn("_parsed", parsed).select(
        "query_id",
        F.coalesce("_parsed.answer", "raw").alias("answer"),
        F.coalesce("_parsed.sources", F.array().cast("array<struct<filepath:string,chunkTitle:string,url:string>>")).alias("cited"),
    )


def cited_rows(answers: DataFrame) -> DataFrame:
    return answers.select("query_id", F.posexplode("cited").alias("cite_no", "_c")).select(
        "query_id", "cite_no", F.col("_c.filepath").alias("filepath"), F.col("_c.chunkTitle").alias("chunk_title")
    )


def answer(
    questions: DataFrame,
    store: DataFrame,
    chat: ChatModel,
    embed: EmbeddingModel,
    postings: DataFrame | None = None,
    vocabulary: DataFrame | None = None,
    system: str | None = None,
    defaults: SearchDefaults | None = None,
    limits: CallLimits | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(answers, sources): one answer per non-blank question, and the chunks it cites."""
    asked = questions.filter(trim_space(F.col("question")) != "")
    hits = cut_lineage(with_chunks(retrieve(asked, store, embed, postings, vocabulary, defaults), store))
    with_hits = asked.join(hits.select("query_id").distinct(), "query_id", "left_semi")
    prompts = build_prompt(with_hits, hits, system)
    limits = limits or Settings().chat
    called = cut_lineage(
        in_lanes(prompts, limits, chat).withColumn("_call", chat_texts(F.col("system"), F.col("prompt"), chat, limits)).select(
            "query_id", "_call.answer", "_call.error"
        )
    )
    answers = parse_answers(called.select("query_id", F.col("answer").alias("raw")))
    sources = build_sources(map_cited_sources(cited_rows(answers), hits))
    full = answer_fallback(asked, answers).join(called.select("query_id", "error"), "query_id", "left")
    return full, sources


def response_record(answers: DataFrame, model: str = "marginalia", now: Column | None = None) -> DataFrame:
    """Chat-completion shaped JSON per answer."""
    created = F.unix_timestamp(F.current_timestamp() if now is None else now)
    message = F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content"))
    record = F.struct(
        F.concat(F.lit("chatcmpl-"), F.col("query_id").cast("string")).alias("id"),
        F.lit("chat.completion").alias("object"),
        created.alias("created"),
        F.lit(model).alias("model"),
        F.array(
            F.struct(F.lit(0).alias("index"), message.alias("message"), F.lit("stop").alias("finish_reason"))
        ).alias("choices"),
        F.struct(
            F.lit(0).alias("prompt_tokens"), F.lit(0).alias("completion_tokens"), F.lit(0).alias("total_tokens")
        ).alias("usage"),
    )
    return answers.select("query_id", F.to_json(record).alias("record"))
