"""Checked queries: questions, prompts, answers, model calls, change events."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.config import CallLimits, SearchDefaults
from marginalia.functions.text import message_text
from marginalia.operators.answers import (
    NO_CONTEXT_ANSWER,
    answer,
    answer_fallback,
    cited_rows,
    parse_answers,
    response_record,
    retrieval_params,
    retrieve,
)
from marginalia.operators.conversations import (
    COMPLEX_WORDS,
    DETAILED_WORDS,
    answer_deltas,
    classify_questions,
    question_of_conversation,
)
from marginalia.operators.hybrid import with_chunks
from marginalia.operators.model_calls import (
    HashedWords,
    chat_texts,
    contextual_text,
    doc_context,
    entity_context,
    estimate_call_tokens,
    in_lanes,
    plan_requests,
)
from marginalia.operators.prompts import (
    COMPLEX_GUIDANCE,
    DEFAULT_SYSTEM_PROMPT,
    DETAILED_GUIDANCE,
    DOC_CONTEXT_SYSTEM_PROMPT,
    SELECTION_RULES,
    build_prompt,
    context_blocks,
    doc_context_prompt,
    focused_context,
)
from marginalia.operators.vectors import vector_search
from marginalia.plans.catalog import checked
from marginalia.operators.split import split_texts
from marginalia.plans.checked_chunks import PACK_SQL
from marginalia.plans.checked_code import _LINES_SQL, _ts_files
from marginalia.plans.checked_search import _DOC_HITS_SQL, _embedded_questions, _embedded_store
from marginalia.operators.keywords import build_postings
from marginalia.plans.derived import (
    POSTINGS_SQL,
    STORE_SQL,
    WORDS_SQL,
    hashed_sql,
    store,
    table,
    texts,
    word_queries,
)
from marginalia.operators.entities import extract_entities, file_outline
from marginalia.operators.entity_chunks import chunk_entities
from marginalia.streaming.streams import change_events, changed_repos, source_events

_QUESTIONS_SQL = """
questions as (
  select conv_id, arg_max(text, turn) filter (where role = 'user') as question,
    arg_min(text, turn) filter (where role = 'system') as system_prompt
  from conversations group by conv_id having trim(coalesce(arg_max(text, turn) filter (where role = 'user'), '')) <> '')
"""


@checked(f"with {_QUESTIONS_SQL} select conv_id, question, system_prompt from questions")
def last_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return question_of_conversation(table(spark, sf_dir, "conversations"))


@checked(
    """select conv_id, turn, case when role = 'user' then text || role when role = 'system' then '' else text end as message
    from conversations"""
)
def message_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    parts = F.when(
        F.col("role") == "user",
        F.array(part("text", F.col("text")), part("image", F.lit("x")), part("text", F.lit(None)), part("text", F.col("role"))),
    ).when(F.col("role") == "system", F.array(part("image", F.lit("y"))))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", message_text(F.col("text"), parts).alias("message")
    )


def _any_sql(column: str, groups: Sequence[str]) -> str:
    return "(" + " or ".join(f"regexp_matches({column}, '(?i){g}')" for g in groups) + ")"


@checked(
    f"""select conv_id, turn, {_any_sql('text', COMPLEX_WORDS)} as is_complex,
      length(trim(text)) > 500 or {_any_sql('text', DETAILED_WORDS)} as is_detailed
    from conversations where role = 'user'"""
)
def question_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return classify_questions(asked, "text").select("conv_id", "turn", "is_complex", "is_detailed")


@checked(
    """select conv_id as query_id, coalesce(case when n % 2 = 0 then n end, 10)::integer as match_count,
      case when n > 4 then 0.5 else 0.2 end::double as similarity_threshold,
      coalesce(case when n % 2 = 0 then n end, 10)::integer as keyword_match_count, n <> 3 as hybrid
    from (select conv_id, count(*) as n from conversations group by 1)"""
)
def retrieval_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    asked = turns.select(
        F.col("conv_id").alias("query_id"),
        F.when(F.col("n") % 2 == 0, F.col("n")).alias("match_count"),
        F.when(F.col("n") > 4, 0.5).alias("similarity_threshold"),
        F.when(F.col("n") == 3, False).alias("hybrid"),
    )
    return retrieval_params(asked, SearchDefaults(keyword_match_count=None)).select(
        "query_id", "match_count", "similarity_threshold", "keyword_match_count", "hybrid"
    )


_CONTEXT_SQL = f"""
{_DOC_HITS_SQL},
shown as (
  select *, 'Source ' || rank || ': ' || filepath || '#' || chunk_id || ' (' || chunk_title || ')' || chr(10) || trim(contextual_text) as block,
    rank || '. filepath: "' || filepath || '", chunkTitle: "' || chunk_title || '"' as listed
  from doc_hits join store using (id)),
contexts as (
  select query_id, count(*)::integer as sources, string_agg(block, chr(10) || chr(10) order by rank) || chr(10) || chr(10) || '---' || chr(10) || chr(10)
    || '{SELECTION_RULES}' || chr(10) || chr(10) || 'Available sources:' || chr(10) || string_agg(listed, chr(10) order by rank) as context
  from shown group by 1)
"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_search(_embedded_store(spark, sf_dir), _embedded_questions(spark, sf_dir), k=5, threshold=0.5)
    return with_chunks(found.withColumnRenamed("vector_rank", "rank"), store(spark, sf_dir))


@checked(f"with {_CONTEXT_SQL} select query_id, sources, context from contexts")
def prompt_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_blocks(_hits(spark, sf_dir))


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@checked(
    f"""with {_CONTEXT_SQL}
    select item_id as query_id, {_lit(DEFAULT_SYSTEM_PROMPT)} as system, concat_ws(chr(10) || chr(10),
      case when context is not null then 'Use the provided context to inform your response.' end, context,
      case when length(trim(text)) > 500 or {_any_sql('text', DETAILED_WORDS)} then {_lit(DETAILED_GUIDANCE)} end,
      case when {_any_sql('text', COMPLEX_WORDS)} then {_lit(COMPLEX_GUIDANCE)} end,
      'User Request: ' || trim(text), 'Answer:') as prompt
    from benchmark left join contexts on query_id = item_id"""
)
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return build_prompt(questions, _hits(spark, sf_dir))


@checked(
    f"""with {_QUESTIONS_SQL} select conv_id as query_id, coalesce(system_prompt, {_lit(NO_CONTEXT_ANSWER)}) as answer from questions"""
)
def fallback_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = question_of_conversation(table(spark, sf_dir, "conversations")).withColumnRenamed("conv_id", "query_id")
    known = asked.filter(F.col("system_prompt").isNotNull())
    return answer_fallback(asked, known.select("query_id", F.col("system_prompt").alias("answer")))


class CitingChat:
    """Answers with the request itself and cites the first available source in upper case."""

    in_task = True

    def __call__(self, systems: Sequence[str], prompts_: Sequence[str]) -> list[str]:
        answers = []
        for prompt in prompts_:
            request = prompt.rsplit("User Request: ", 1)[1].rsplit("\n\nAnswer:", 1)[0]
            first = prompt.rsplit("Available sources:\n", 1)[1].split("\n", 1)[0]
            filepath = first.split('filepath: "', 1)[1].split('"', 1)[0]
            title = first.split('chunkTitle: "', 1)[1].split('"', 1)[0]
            cited = [{"filepath": filepath, "chunkTitle": title.upper()}, {"filepath": "none.mdx", "chunkTitle": ""}]
            answers.append(json.dumps({"sources": cited, "answer": f"re: {request}"}))
        return answers


def _answered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return answer(
        questions,
        _embedded_store(spark, sf_dir),
        CitingChat(),
        HashedWords(64),
        defaults=SearchDefaults(match_count=5, similarity_threshold=0.5),
    )


@checked(
    f"""with {_DOC_HITS_SQL} select item_id as query_id,
      case when item_id in (select query_id from doc_hits) then 're: ' || trim(text) else {_lit(NO_CONTEXT_ANSWER)} end as answer, null::varchar as error
    from benchmark"""
)
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answered(spark, sf_dir)[0]


@checked(
    f"""with {_DOC_HITS_SQL} select query_id, rank, filepath, chunk_title, final_url from doc_hits join store using (id) where rank = 1"""
)
def answer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = _answered(spark, sf_dir)[1]
    return sources.select("query_id", "rank", "filepath", "chunk_title", "final_url")


# Every question brings its own limits; every second one asks for words too.
@checked(
    f"""with {STORE_SQL}, {POSTINGS_SQL}, {WORDS_SQL},
    {hashed_sql("d", "store", "id", "contextual_text")},
    {hashed_sql("q", "words", "query_id", "t1")},
    norms as (select id, sqrt(sum(v * v)) as n from d_vectors group by 1),
    qnorms as (select id, sqrt(sum(v * v)) as n from q_vectors group by 1),
    asked as (
      select query_id, t1, 3 + query_id % 4 as most, ((1 + query_id % 3) / 10.0)::double as floor, 2 + query_id % 5 as most_words,
        query_id % 2 = 0 as hybrid from words),
    scores as (
      select q.id as query_id, d.id, round(sum(q.v * d.v) / (any_value(qn.n) * any_value(dn.n)), 12) as similarity
      from q_vectors q join d_vectors d using (slot) join norms dn on dn.id = d.id join qnorms qn on qn.id = q.id group by 1, 2),
    vector_hits as (
      select query_id, id, similarity, row_number() over (partition by query_id order by similarity desc, id) as vector_rank
      from scores join asked using (query_id) where similarity >= floor qualify vector_rank <= most),
    word_ranks as (
      select query_id, id, any_value(most_words) as most_words, round(sum(weight), 9) as keyword_rank
      from postings join asked on term = t1 where hybrid group by 1, 2),
    word_hits as (
      select *, row_number() over (partition by query_id order by keyword_rank desc, id) as keyword_order
      from word_ranks qualify keyword_order <= most_words),
    merged as (
      select coalesce(v.query_id, k.query_id) as query_id, coalesce(v.id, k.id) as id, similarity, keyword_rank, vector_rank, keyword_order
      from vector_hits v full join word_hits k on v.query_id = k.query_id and v.id = k.id)
    select query_id, row_number() over (partition by query_id order by similarity desc nulls last, keyword_rank desc nulls last,
        vector_rank nulls last, keyword_order nulls last)::integer as rank, id, round(similarity, 6) as similarity,
      round(keyword_rank, 6) as keyword_rank
    from merged join asked using (query_id) qualify rank <= most"""
)
def retrieved_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.col("query_id")
    questions = word_queries(spark, sf_dir, "%1$s").select(
        "query_id",
        F.col("query").alias("question"),
        (item % 4 + 3).alias("match_count"),
        ((item % 3 + 1) / 10.0).alias("similarity_threshold"),
        (item % 5 + 2).alias("keyword_match_count"),
        (item % 2 == 0).alias("hybrid"),
    )
    postings = build_postings(store(spark, sf_dir), english=False)
    hits = retrieve(questions, _embedded_store(spark, sf_dir), HashedWords(64), postings)
    return hits.withColumns({"similarity": F.round("similarity", 6), "keyword_rank": F.round("keyword_rank", 6)})


@checked(
    """select conv_id as query_id, '{"id":"chatcmpl-' || conv_id || '","object":"chat.completion","created":1704067200,"model":"m","choices":[{"index":0,"message":{"role":"assistant","content":"'
      || n || ' turns"},"finish_reason":"stop"}],"usage":{"prompt_tokens":0,"completion_tokens":0,"total_tokens":0}}' as record
    from (select conv_id, count(*) as n from conversations group by 1)"""
)
def response_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    answers = turns.select(F.col("conv_id").alias("query_id"), F.concat("n", F.lit(" turns")).alias("answer"))
    return response_record(answers, "m", F.lit("2024-01-01T00:00:00Z").cast("timestamp"))


# Partial answers: each assistant text grows in four steps, the third of which adds nothing.
@checked(
    """with said as (select conv_id * 1000 + turn as answer_id, text, length(text) as n from conversations where role = 'assistant'),
    steps as (
      select answer_id, 1 as seq, substr(text, 1, n // 3) as delta from said
      union all select answer_id, 2, substr(text, n // 3 + 1, n // 2 - n // 3) from said
      union all select answer_id, 4, substr(text, n // 2 + 1) from said)
    select answer_id, seq::bigint as seq, delta from steps where delta <> ''"""
)
def text_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    n = F.length("text")
    steps = F.array(F.floor(n / 3), F.floor(n / 2), F.floor(n / 2), n.cast("long"))
    partials = said.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), "text", F.posexplode(steps).alias("i", "until")
    ).select(
        "answer_id",
        (F.col("i") + 1).cast("long").alias("seq"),
        F.substring(F.col("text"), F.lit(1), F.col("until").cast("int")).alias("answer"),
    )
    return answer_deltas(partials)


@checked(
    """with said as (select conv_id, turn, role, text from conversations)
    select conv_id as answer_id, min(turn) as seq, role as filepath, 't' as "chunkTitle", null::varchar as url from said group by conv_id, role"""
)
def first_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.struct(
        F.col("role").alias("filepath"), F.lit("t").alias("chunkTitle"), F.lit(None).cast("string").alias("url")
    )
    partials = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("answer_id"), F.col("turn").alias("seq"), F.array(source, source).alias("sources")
    )
    return source_events(partials)


@checked(
    """select doc_id, case when lang = 'en' then source || '---' || text when lang = 'fr' then text
      else source || chr(10) || '---' || chr(10) || text end as contextual_text,
      'Full file context:' || chr(10) || trim(source) || chr(10) || chr(10) || 'Focused chunk:' || chr(10) || lang as focused
    from documents"""
)
def contextual_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kind = F.when(F.col("lang") == "en", "doc").otherwise("code")
    header = F.when(F.col("lang") == "fr", "  ").otherwise(F.concat(F.lit(" "), "source", F.lit(" ")))
    return docs.select(
        "doc_id",
        contextual_text(kind, header, F.col("text")).alias("contextual_text"),
        focused_context(F.col("lang"), F.concat(F.lit(" "), "source")).alias("focused"),
    )


# Characters of the prompt around document and passage.
CONTEXT_LIMIT = 400
_FRAME = len("<document>\n\n</document>\nPassage to place:\n<passage>\n\n</passage>")
_CALL_TOKENS = (
    f"ceil(length({_lit(DOC_CONTEXT_SYSTEM_PROMPT)}) / 4.0) + ceil((length(text) * 2 + {_FRAME}) / 4.0) + 250"
)
_CALL_TOKENS_SQL = f"calls as (select doc_id as id, ({_CALL_TOKENS})::integer as tokens from documents)"


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = doc_context_prompt(F.col("text"), F.col("text"))
    return texts(spark, sf_dir).select(
        F.col("doc_id").alias("id"),
        estimate_call_tokens(F.lit(DOC_CONTEXT_SYSTEM_PROMPT), prompt, "doc").alias("tokens"),
    )


@checked(f"with {_CALL_TOKENS_SQL} select id, tokens from calls")
def call_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir)


@checked(
    f"""with {_CALL_TOKENS_SQL},
    rowed as (select id % 4 as lane, id // 100 as block, tokens, (row_number() over (partition by id % 4, id // 100 order by id) - 1) // 3 as batch from calls),
    batches as (select lane, block, batch, count(*) as items, least(sum(tokens), 22500) as tokens from rowed group by all),
    used as (select *, sum(tokens) over w as used, row_number() over w - 1 as sent from batches
      window w as (partition by lane order by block, batch rows unbounded preceding))
    select lane::integer as lane, block, batch, items, tokens::bigint as tokens, greatest((used - 1) // 22500, sent // 5)::bigint as slot from used"""
)
def request_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_requests(_calls(spark, sf_dir), 20, 90_000, lanes=4, batch=3, block=100)


class LengthChat:
    """Answers with the length of each prompt; a batch of entities gets a numbered list that tells how
    many entities and imports its prompt holds."""

    in_task = True

    def __call__(self, systems: Sequence[str], prompts_: Sequence[str]) -> list[str]:
        answers = []
        for prompt in prompts_:
            count = len(re.findall(r"(?m)^\d+\. \w+ .* from line \d+ to \d+$", prompt))
            imports = prompt.partition("It imports:\n")[2].partition("\nDeclarations")[0].count("import ")
            listed = "\n".join(f"{i + 1}. item {i + 1} of {count}, {imports} imports" for i in range(count))
            answers.append(listed or f" {len(prompt)} characters ")
        return answers


# The documents' own chunks at a small limit: lines of a document are packed as ``split_texts`` packs them.
@checked(
    f"""with recursive texts as (
      select doc_id as key, text, {CONTEXT_LIMIT} as lim, {CONTEXT_LIMIT} as total from documents),
    {PACK_SQL},
    cut as (select key, part, text from parts union all select key, 0, text from texts where ceil(length(text) / 4.0) <= total)
    select key as doc_id, part::integer as part, (length(d.text) + length(cut.text) + {_FRAME}) || ' characters' as header
    from cut join documents d on d.doc_id = key"""
)
def document_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk of every document is placed in the whole document."""
    docs = texts(spark, sf_dir).select("doc_id", F.col("doc_id").cast("string").alias("filepath"), "text")
    split = split_texts(docs.withColumn("_texts", F.array("text")), "_texts", F.lit(CONTEXT_LIMIT))
    whole = F.array(F.struct(F.col("text"), F.lit(0).alias("first"), F.lit(0).alias("last")))
    parts = F.coalesce(F.get("parts", F.lit(0)), whole)
    chunks = split.select("doc_id", "filepath", F.posexplode(parts).alias("part", "_part")).select(
        "doc_id", "filepath", "part", F.col("_part.text").alias("content")
    )
    documents = docs.select("filepath", F.col("text").alias("content"))
    return doc_context(chunks, documents, LengthChat(), CallLimits(batch_size=16)).select("doc_id", "part", "header")


@checked(
    f"""with {_LINES_SQL}, numbered as (select source || '/c' || doc_id || '.ts' as filepath, len(l) + 1 as n, unnest(range(0, len(l) + 1)) as i from docs)
    select filepath, i::integer as chunk_id, 'item ' || (i % 5 + 1) || ' of ' || least(5, n - i // 5 * 5) || ', 13 imports' as header from numbered"""
)
def entity_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All imports of a file reach the prompt."""
    more = "".join(f'import {{ y{i} }} from "./y{i}";\n' for i in range(12))
    files = _ts_files(spark, sf_dir).withColumn("content", F.concat(F.lit(more), "content"))
    chunks = chunk_entities(extract_entities(files), 1_000_000).withColumnRenamed("chunk_index", "chunk_id")
    described = entity_context(chunks, files.join(file_outline(files), "filepath"), LengthChat(), limits=CallLimits(batch_size=16))
    return described.select("filepath", "chunk_id", "header")


class FragileChat:
    """Fails on texts of src3."""

    in_task = True

    def __call__(self, systems: Sequence[str], prompts_: Sequence[str]) -> list[str]:
        if any(text.startswith("src3 ") for text in prompts_):
            raise ValueError("refused")
        return [str(len(text)) for text in prompts_]


@checked("select doc_id as id, case when source = 'src3' then 'refused' end as error from documents")
def call_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A failing call marks its own rows only, after its retries."""
    docs = texts(spark, sf_dir).select(F.col("doc_id").alias("id"), F.concat_ws(" ", "source", "text").alias("text"))
    # One row per request, so that no other row shares a failing request.
    limits = CallLimits(batch_size=1, retries=1)
    called = docs.withColumn("_c", chat_texts(F.lit(""), F.col("text"), FragileChat(), limits, wait=0.0))
    return called.select("id", "_c.error")


class FlakyChat:
    """Refuses every request once."""

    def __init__(self) -> None:
        self.refused: set[str] = set()

    def __call__(self, systems: Sequence[str], prompts_: Sequence[str]) -> list[str]:
        if prompts_[0] not in self.refused:
            self.refused.add(prompts_[0])
            raise ValueError("busy")
        return [str(len(text)) for text in prompts_]


@checked("select doc_id as id, length(text)::varchar as answer, null::varchar as error from documents")
def retried_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call that succeeds after a retry counts like any other, in paced lanes too."""
    docs = texts(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    limits = CallLimits(
        batch_size=50, retries=1, paced=True, concurrency=4, requests_per_minute=10**6, tokens_per_minute=10**9
    )
    called = in_lanes(docs, limits).withColumn("_c", chat_texts(F.lit(""), F.col("text"), FlakyChat(), limits, wait=0.0))
    return called.select("id", "_c.answer", "_c.error")


@checked("select event_type || ':' || user_id as label, count(*) as events from events where event_type <> 'view' group by 1")
def change_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views stand for pings."""
    events = table(spark, sf_dir, "events").select(
        F.when(F.col("event_type") == "view", "ping").otherwise(F.col("event_type")).alias("kind"),
        F.col("user_id").cast("string").alias("repo"),
    )
    labelled = change_events(events).withColumn("label", F.concat_ws(":", "kind", "repo"))
    return labelled.groupBy("label").agg(F.count("trigger").alias("events"))


@checked("select user_id::varchar as repo, count(*) as events from events where event_type <> 'view' group by 1")
def changed_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        F.when(F.col("event_type") == "view", "ping").otherwise(F.col("event_type")).alias("kind"),
        F.col("user_id").cast("string").alias("repo"),
    )
    return changed_repos(events)


@checked(f"with {_QUESTIONS_SQL} select conv_id as query_id, question as answer, 'f' as filepath from questions")
def structured_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that come as JSON are read back into answer and sources."""
    asked = question_of_conversation(table(spark, sf_dir, "conversations"))
    sources = F.array(
        F.struct(F.lit("f").alias("filepath"), F.lit("t").alias("chunkTitle"), F.lit("u").alias("url"))
    )
    raw = asked.select(
        F.col("conv_id").alias("query_id"),
        F.to_json(F.struct(sources.alias("sources"), F.col("question").alias("answer"))).alias("raw"),
    )
    answers = parse_answers(raw)
    return answers.join(cited_rows(answers), "query_id").select("query_id", "answer", "filepath")
