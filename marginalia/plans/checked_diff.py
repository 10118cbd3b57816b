"""Checked queries: diff of a crawl against the store, and the states that follow from it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators.diff import (
    build_target,
    classify_chunks,
    find_orphans,
    find_stranded,
    ids_to_delete,
    in_repos,
    lookup_by_checksum,
    moves_of,
    run_stats,
)
from marginalia.functions.text import content_checksum
from marginalia.operators.state import (
    apply_moves,
    delete_by_ids,
    delete_missing,
    location_conflicts,
    next_state,
    reorder_chunks,
    upsert_chunks,
)
from marginalia.plans.catalog import checked
from marginalia.plans.derived import CRAWL_SQL, REPOS_SQL, STORE_SQL, crawl, repos, store, table
from marginalia.session import cut_lineage, ensure_checkpoint_dir
from marginalia.sources.store import ChunkStore

_TARGET_SQL = f"""
{STORE_SQL}, {CRAWL_SQL}, {REPOS_SQL},
target as (
  select checksum, arg_max(filepath, seq) as filepath, arg_max(chunk_id, seq) as chunk_id,
    arg_max(source_type, seq) as source_type, arg_max(github_url, seq) as github_url, min(seq) as first_seq
  from crawl group by checksum)
"""
_CLASSIFIED_SQL = f"""
{_TARGET_SQL},
candidates as (
  select t.*, s.id, s.source_type as stored_type,
    coalesce(not prefix(s.filepath, '__moving__') and s.filepath = t.filepath and s.chunk_id = t.chunk_id, false) as in_place,
    coalesce(prefix(s.filepath, '__moving__'), false) as parked
  from (select *, row_number() over (partition by filepath, chunk_id, source_type order by first_seq) as n from target) t
  left join store s using (checksum) where t.n = 1),
classified as (
  select checksum, filepath, chunk_id, source_type, github_url, id as existing_id,
    case when id is null then 'new' when in_place and stored_type = source_type then 'unchanged' else 'moved' end as action
  from candidates
  qualify row_number() over (partition by checksum order by in_place desc, parked desc, id) = 1)
"""
_MOVED_SQL = f"""
{_CLASSIFIED_SQL},
moves as (
  select existing_id as id, filepath, chunk_id, source_type, github_url from classified where action = 'moved'),
resolved as (
  select m.id, m.chunk_id, m.source_type,
    case when h.held is null and m.n = 1 then m.filepath else '__moving__' || m.id end as filepath,
    case when h.held is null and m.n = 1 then m.github_url end as github_url
  from (select *, row_number() over (partition by filepath, chunk_id order by id) as n from moves) m
  left join (select filepath, chunk_id, true as held from store where id not in (select id from moves)) h using (filepath, chunk_id)),
moved as (
  select s.id, s.content, s.checksum, coalesce(r.filepath, s.filepath) as filepath, coalesce(r.chunk_id, s.chunk_id) as chunk_id,
    coalesce(r.source_type, s.source_type) as source_type, coalesce(r.github_url, s.github_url) as github_url
  from store s left join resolved r using (id)),
orphans as (
  select id from moved
  where regexp_extract(github_url, '^(https://github.com/[^/]+/[^/]+/blob/[^/]+/)', 1) in (select repo_base from repos)
    and (checksum not in (select checksum from target)
      or string_split(github_url, '#')[1] not in (select string_split(github_url, '#')[1] from target))),
stranded as (
  select id from moved where prefix(filepath, '__moving__') and checksum not in (select checksum from target)
    and regexp_extract(github_url, 'github.com/([^/]+/[^/]+)', 1) in (select repo from repos)),
deletes as (select id from orphans union select id from stranded)
"""


def _target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_target(crawl(spark, sf_dir))


@checked(f"with {_TARGET_SQL} select checksum, filepath, chunk_id, source_type, github_url, first_seq from target")
def target_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _target(spark, sf_dir).select(
        "checksum", "filepath", "chunk_id", "source_type", "github_url", F.col("first_seq.seq").alias("first_seq")
    )


@checked(
    f"""with {_TARGET_SQL} select checksum, count(*) as stored, min(id) as first_id from store
    where checksum in (select checksum from target) group by 1"""
)
def checksum_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookup_by_checksum(_target(spark, sf_dir), store(spark, sf_dir))
    return found.groupBy("checksum").agg(F.count("*").alias("stored"), F.min("id").alias("first_id"))


@checked(f"with {_CLASSIFIED_SQL} select checksum, filepath, chunk_id, existing_id, action from classified")
def chunk_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_chunks(_target(spark, sf_dir), store(spark, sf_dir)).select(
        "checksum", "filepath", "chunk_id", "existing_id", "action"
    )


_NARROW = ["id", "checksum", "filepath", "chunk_id", "source_type", "github_url"]


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The diff, computed once: several branches read it."""
    return cut_lineage(classify_chunks(_target(spark, sf_dir), store(spark, sf_dir)))


def _moved(spark: SparkSession, sf_dir: str, classified: DataFrame) -> DataFrame:
    return apply_moves(store(spark, sf_dir).select(*_NARROW), moves_of(classified))


def _deletes(spark: SparkSession, sf_dir: str, classified: DataFrame) -> DataFrame:
    moved, scope = _moved(spark, sf_dir, classified), repos(spark, sf_dir)
    target = _target(spark, sf_dir)
    return ids_to_delete(find_orphans(moved, target, scope), find_stranded(moved, target, scope))


@checked(f"with {_MOVED_SQL} select id, filepath, chunk_id, source_type, github_url from moved")
def moved_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moved(spark, sf_dir, _classified(spark, sf_dir)).drop("checksum")


@checked(
    f"""with {_TARGET_SQL} select id, github_url from store
    where regexp_extract(github_url, '^(https://github.com/[^/]+/[^/]+/blob/[^/]+/)', 1) in (select repo_base from repos)"""
)
def repo_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_repos(store(spark, sf_dir).select("id", "github_url"), repos(spark, sf_dir)).select("id", "github_url")


@checked(f"with {_MOVED_SQL} select id from orphans")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = _moved(spark, sf_dir, _classified(spark, sf_dir))
    return find_orphans(moved, _target(spark, sf_dir), repos(spark, sf_dir))


@checked(
    f"""with {_TARGET_SQL} select id from store where prefix(filepath, '__moving__')
      and checksum not in (select checksum from target where prefix(filepath, 'bench/'))
      and regexp_extract(github_url, 'github.com/([^/]+/[^/]+)', 1) in (select repo from repos)"""
)
def stranded(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Against a crawl that holds only the benchmark files, every parked row is stranded.
    bench = _target(spark, sf_dir).filter(F.col("filepath").startswith("bench/"))
    return find_stranded(store(spark, sf_dir), bench, repos(spark, sf_dir))


@checked(f"with {_MOVED_SQL} select id from deletes")
def delete_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deletes(spark, sf_dir, _classified(spark, sf_dir))


@checked(f"with {_MOVED_SQL} select id, checksum, filepath from store where id not in (select id from deletes)")
def kept_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    deletes = _deletes(spark, sf_dir, _classified(spark, sf_dir))
    return delete_by_ids(store(spark, sf_dir).select("id", "checksum", "filepath"), deletes)


def _new_rows(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "filepath",
        "chunk_id",
        "content",
        F.concat(F.lit("new---"), "content").alias("contextual_text"),
        "checksum",
        F.lit("new").alias("chunk_title"),
        "source_type",
        "github_url",
    )


# Upsert of the whole crawl: unmoved documents are overwritten, the others are inserted.
@checked(
    f"""with {_TARGET_SQL},
    merged as (select coalesce(c.filepath, s.filepath) as filepath, coalesce(c.content, s.content) as content,
        s.id, c.seq is not null as is_new
      from store s full join crawl c using (filepath, chunk_id))
    select filepath, content, case when is_new then 'new' else 'old' end as origin, id as old_id from merged"""
)
def upsert_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store(spark, sf_dir)
    state = upsert_chunks(stored, _new_rows(crawl(spark, sf_dir)), F.lit("2024-02-01").cast("timestamp"))
    old = stored.agg(F.max("id")).first()[0]
    return state.select(
        "filepath",
        "content",
        F.when(F.col("chunk_title") == "new", "new").otherwise("old").alias("origin"),
        F.when(F.col("id") <= old, F.col("id")).alias("old_id"),
    )


# Rows that the crawl overwrites keep the time they were made; untouched ones keep both times.
@checked(
    f"""with {_TARGET_SQL}
    select coalesce(c.filepath, s.filepath) as filepath,
      case when s.id is null then '2024-02-01' else '2024-01-01' end as created,
      case when c.seq is null then '2024-01-01' else '2024-02-01' end as updated
    from store s full join crawl c using (filepath, chunk_id)"""
)
def timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = upsert_chunks(
        store(spark, sf_dir), _new_rows(crawl(spark, sf_dir)), F.lit("2024-02-01").cast("timestamp")
    )
    day = lambda name: F.date_format(name, "yyyy-MM-dd")
    return state.select("filepath", day("created_at").alias("created"), day("updated_at").alias("updated"))


@checked(
    f"""with {_MOVED_SQL} select m.id, case when m.filepath = s.filepath and m.chunk_id = s.chunk_id
        and m.source_type = s.source_type and m.github_url is not distinct from s.github_url then '2024-01-01' else '2024-02-01' end as updated
    from moved m join store s using (id)"""
)
def moved_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = moves_of(_classified(spark, sf_dir))
    moved = apply_moves(store(spark, sf_dir), moves, F.lit("2024-02-01").cast("timestamp"))
    return moved.select("id", F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


# Two versions: the second one replaces the buckets that hold German documents, a third lays all out
# anew in other buckets. Read are the current state, one file by its path, and rows by their checksum.
@checked(
    f"""with {STORE_SQL} select 'all' as part, id, filepath, checksum,
      case when contextual_text like 'de---%' then 'again' else chunk_title end as chunk_title from store
    union all
    select 'file', id, filepath, checksum, case when contextual_text like 'de---%' then 'again' else chunk_title end from store
    where filepath = 'src0/0.mdx'
    union all
    select 'checksums', id, filepath, checksum, case when contextual_text like 'de---%' then 'again' else chunk_title end from store
    where checksum in (select sha256(text) from documents where lang = 'fr')"""
)
def store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store(spark, sf_dir)
    root = f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
    chunks = ChunkStore(spark, root, buckets=16)
    chunks.write(rows)
    german = F.col("contextual_text").startswith("de---")
    buckets = chunks.buckets_of(rows.filter(german).select("filepath"))
    again = chunks.read(buckets=buckets).withColumn(
        "chunk_title", F.when(german, "again").otherwise(F.col("chunk_title"))
    )
    chunks.write(cut_lineage(again), buckets)
    wider = ChunkStore(spark, root, buckets=32)
    wider.write(cut_lineage(wider.read()))
    french = table(spark, sf_dir, "documents").filter("lang = 'fr'").select(content_checksum(F.col("text")).alias("checksum"))
    parts = {"all": wider.read(), "file": wider.read_file("src0/0.mdx"), "checksums": wider.read_checksums(french)}
    shown = [
        part.select(F.lit(name).alias("part"), "id", "filepath", "checksum", "chunk_title") for name, part in parts.items()
    ]
    return shown[0].unionByName(shown[1]).unionByName(shown[2])


@checked(
    f"""with {_MOVED_SQL},
    kept as (select m.filepath, m.checksum, m.source_type from moved m where id not in (select id from deletes)),
    fresh as (select c.filepath, c.checksum, c.source_type from classified c where action = 'new')
    select filepath, checksum, source_type from fresh
    union all select * from kept where filepath not in (select filepath from fresh)"""
)
def next_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    classified = _classified(spark, sf_dir)
    deletes = cut_lineage(_deletes(spark, sf_dir, classified))
    wanted = classified.filter(F.col("action") == "new").select("checksum", "filepath")
    new = _new_rows(crawl(spark, sf_dir).join(wanted, ["checksum", "filepath"], "left_semi"))
    state = next_state(store(spark, sf_dir), moves_of(classified), deletes, new)
    return state.select("filepath", "checksum", "source_type")


@checked(
    f"""with {STORE_SQL} select id, filepath, chunk_id from store
    where not (filepath in (select source || '/' || doc_id || '.mdx' from documents where lang = 'en')
      and filepath not in (select source || '/' || d.doc_id || '.mdx' from documents d join labels l on d.doc_id = l.doc_id))"""
)
def deleted_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".mdx")).alias("filepath")
    )
    labelled = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    valid = labelled.select("filepath", F.lit(0).alias("chunk_id"))
    narrow = store(spark, sf_dir).select("id", "filepath", "chunk_id")
    return delete_missing(narrow, docs.filter(F.col("lang") == "en"), valid)


@checked(
    f"""with {STORE_SQL} select s.id, s.filepath, coalesce(l.quality + 10 * l.toxic + 1, s.chunk_id)::integer as chunk_id
    from store s left join labels l on l.doc_id = s.id"""
)
def reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), (F.col("quality") + 10 * F.col("toxic") + 1).alias("chunk_id")
    )
    return reorder_chunks(store(spark, sf_dir).select("id", "filepath", "chunk_id"), updates)


@checked("select source as filepath, 0 as chunk_id, count(*) as \"rows\" from documents group by 1 having count(*) > 1")
def location_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    crowded = table(spark, sf_dir, "documents").select(F.col("source").alias("filepath"), F.lit(0).alias("chunk_id"))
    return location_conflicts(crowded)


@checked(
    f"""with {_MOVED_SQL}
    select (select count(distinct filepath) from crawl) as processed_documents,
      (select count(*) from documents where lang = 'es') as skipped_documents,
      (select count(*) from classified where action = 'new') as upserted_chunks,
      (select count(*) from classified where action = 'moved') as moved_chunks,
      (select count(*) from deletes) as deleted_chunks"""
)
def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = crawl(spark, sf_dir)
    classified = _classified(spark, sf_dir)
    # The Spanish documents of the crawl hold nothing.
    empty = table(spark, sf_dir, "documents").filter(F.col("lang") == "es")
    documents = chunks.select("filepath").unionByName(empty.select(F.concat(F.lit("empty/"), "doc_id").alias("filepath")))
    return run_stats(documents, chunks, classified, _deletes(spark, sf_dir, classified))
