"""Checked queries: paths, URLs, titles, types and scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.config import DEFAULT_EXCLUDE_PATTERNS
from marginalia.functions.links import append_slug, citation_url, docs_url, heading_slug, resolve_links
from marginalia.functions.paths import (
    classify_documents,
    encode_path,
    in_scope,
    is_excluded,
    is_included,
    join_paths,
    normalize_path,
    parse_repo_url,
    relative_path,
    repo_of_url,
    source_url,
    strip_fragment,
)
from marginalia.functions.text import (
    WRAPPING_PAIRS,
    clean_title,
    content_checksum,
    language_of_path,
    normalize_source_type,
)
from marginalia.functions.tokens import count_tokens, embedding_token_limit, sanitize_special_tokens
from marginalia.operators.diff import documents_per_type
from marginalia.plans.catalog import checked
from marginalia.plans.derived import ORG, repos, table, texts
from marginalia.sources.corpus import scan_corpus, skipped_repos
from marginalia.sources.pages import page_title

# White space that titles are trimmed of, as RE2 knows it.
SPACE_SQL = "\\s\\p{Z}\\x{FEFF}"

# Files of a mixed repository: the extension follows the language, the folder the source.
_FILES_SQL = """
files as (
  select doc_id, 'https://github.com/acme/' || source as repo_url, text as content,
    case when source = 'src3' then 'docs/latest/' when source = 'src4' then 'docs/test/' else 'docs/' end || 'f' || doc_id ||
    case when lang = 'en' then '.mdx' when lang = 'fr' and source = 'src5' then '.d.ts'
         when lang = 'fr' and source = 'src6' then '.test.ts' when lang = 'fr' then '.TS'
         when lang = 'de' then '_test.py' else '.rs' end as path
  from documents)
"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = (
        F.when(F.col("source") == "src3", "docs/latest/").when(F.col("source") == "src4", "docs/test/").otherwise("docs/")
    )
    ending = (
        F.when(F.col("lang") == "en", ".mdx")
        .when((F.col("lang") == "fr") & (F.col("source") == "src5"), ".d.ts")
        .when((F.col("lang") == "fr") & (F.col("source") == "src6"), ".test.ts")
        .when(F.col("lang") == "fr", ".TS")
        .when(F.col("lang") == "de", "_test.py")
        .otherwise(".rs")
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit(f"{ORG}/"), "source").alias("repo_url"),
        F.col("text").alias("content"),
        F.concat(folder, F.lit("f"), F.col("doc_id").cast("string"), ending).alias("path"),
    )


_TYPE_SQL = """
case when lower(path) like '%.mdx' then 'mdx'
     when lower(path) like '%.d.ts' then null
     when lower(path) like '%.ts' or lower(path) like '%.tsx' then 'typescript'
     when lower(path) like '%.py' then 'python' when lower(path) like '%.rs' then 'rust' end
"""


@checked(f"with {_FILES_SQL} select doc_id, path, {_TYPE_SQL} as type from files where {_TYPE_SQL} is not null")
def classified_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_documents(_files(spark, sf_dir)).select("doc_id", "path", "type")


@checked(
    f"""with {_FILES_SQL} select {_TYPE_SQL} as type, count(*) as documents
    from files where {_TYPE_SQL} is not null group by 1"""
)
def documents_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_per_type(classify_documents(_files(spark, sf_dir)))


def _excluded_sql(path: str, patterns: list[str]) -> str:
    name = f"regexp_extract({path}, '[^/]*$')"
    tests = []
    for p in dict.fromkeys(patterns):
        if p.startswith("*"):
            tests.append(f"suffix({name}, '{p[1:]}') or suffix({path}, '{p[1:]}')")
        elif p.endswith("*"):
            tests.append(f"prefix({name}, '{p[:-1]}') or contains({path}, '{p[:-1]}')")
        else:
            tests.append(f"{name} = '{p}' or contains({path}, '{p}')")
    return "(" + " or ".join(tests) + ")"


_INCLUDED_SQL = """(path = 'docs/latest' or prefix(path, 'docs/latest/') or prefix(path, 'latest/') or path = 'latest'
  or path = 'docs/docs' or prefix(path, 'docs/docs/') or prefix(path, 'docs/') or path = 'docs')"""


@checked(
    f"""with {_FILES_SQL} select doc_id, {_excluded_sql('path', [*DEFAULT_EXCLUDE_PATTERNS, 'f1*'])} as excluded,
      {_INCLUDED_SQL} as included, prefix(path, 'docs/latest/') as scoped,
      case when prefix(path, 'docs/latest/') then substr(path, 13) else path end as relative
    from files"""
)
def path_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    patterns = F.array(*[F.lit(p) for p in (*DEFAULT_EXCLUDE_PATTERNS, "f1*")])
    return _files(spark, sf_dir).select(
        "doc_id",
        is_excluded(path, patterns).alias("excluded"),
        is_included(path, "docs", ["latest", "docs"]).alias("included"),
        in_scope(path, "docs/latest").alias("scoped"),
        relative_path("docs/latest", path).alias("relative"),
    )


_SCAN_EXCLUDES = [*DEFAULT_EXCLUDE_PATTERNS, "latest/"]


@checked(
    f"""with {_FILES_SQL}, typed as (select *, {_TYPE_SQL} as type from files)
    select type, path, substr(path, 6) as relative_path, sha1(content) as sha,
      strlen(content) as size, repo_url || '/blob/main/' || path as source_url
    from typed where type is not null and repo_url <> 'https://github.com/acme/src9'
      and (type = 'mdx' or not {_excluded_sql('path', _SCAN_EXCLUDES)})"""
)
def scanned_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = repos(spark, sf_dir).withColumn("directory", F.lit("docs"))
    none = F.lit(None).cast("array<string>")
    both = listed.withColumn("kind", F.explode(F.array(F.lit("docs"), F.lit("code")))).select(
        "repo_url",
        "kind",
        "directory",
        none.alias("include_directories"),
        F.array(F.lit("latest/")).alias("exclude_patterns"),
        F.lit(None).cast("string").alias("base_url"),
        F.lit(None).cast("string").alias("content_path"),
        "branch",
    )
    return scan_corpus(_files(spark, sf_dir), both).select(
        "type", "path", "relative_path", "sha", "size", "source_url"
    )


_ENCODE = "replace(replace(replace(replace(replace(url_encode({0}), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*')"


def _encode_sql(value: str) -> str:
    return _ENCODE.format(value)


_SPACED = """' docs / ' || regexp_replace(html, '(?s).*<title>([^<]*)</title>.*', '\\1') || ' (a)//b!* '"""
_PARTS_SQL = f"""
parts as (
  select page_id, list_filter(list_transform(string_split({_SPACED}, '/'), lambda x: trim(x)), lambda x: x <> '') as segments
  from pages)
"""


@checked(
    f"""with {_PARTS_SQL}
    select page_id, case when list_contains(segments, '.') or list_contains(segments, '..') then null
        else array_to_string(segments, '/') end as normal,
      case when list_contains(segments, '.') or list_contains(segments, '..') then null
        else 'base/' || array_to_string(segments, '/') || '/x.mdx' end as joined,
      array_to_string(list_transform(segments, lambda x: {_encode_sql('x')}), '/') as encoded
    from parts"""
)
def path_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", "(?s)<title>([^<]*)</title>", 1)
    raw = F.concat(F.lit(" docs / "), title, F.lit(" (a)//b!* "))
    pages = table(spark, sf_dir, "pages").withColumn("raw", raw)
    return pages.select(
        "page_id",
        normalize_path(F.col("raw")).alias("normal"),
        join_paths("base/", None, F.col("raw"), "x.mdx").alias("joined"),
        encode_path(normalize_path(F.col("raw"))).alias("encoded"),
    )


# Repository URLs made from page URLs: some with a branch, some on another host, some too short.
_REPO_URL_SQL = """
urls as (
  select page_id, case
      when contains(url, '.example.com') then 'https://github.com/' || regexp_extract(url, '//([^/]+)/', 1) || '/site.git/tree/v1/docs/' || page_id
      when contains(url, '.example.net') then 'https://www.github.com/acme/p' || page_id || '/extra/path'
      when contains(url, '.example.org') then 'https://github.com/only'
      else url end as url
  from pages),
split as (
  select *, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as host,
    list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '') as s
  from urls),
judged as (
  select *, case when not suffix(host, 'github.com') then 'unsupported host'
    when len(s) < 2 then 'owner and repository required' end as error, s[3] in ('tree', 'blob') as q from split)
"""


@checked(
    f"""with {_REPO_URL_SQL}
    select page_id, case when error is null then s[1] end as owner,
      case when error is null then regexp_replace(s[2], '\\.git$', '') end as repo,
      case when error is null then case when q then coalesce(s[4], 'main') else 'main' end end as branch,
      case when error is null then array_to_string(case when q then s[5:] else s[3:] end, '/') end as path,
      error,
      case when error is null then 'https://github.com/' || s[1] || '/' || regexp_replace(s[2], '\\.git$', '') || '/blob/'
        || (case when q then coalesce(s[4], 'main') else 'main' end) || '/a%20b/' || page_id || '.mdx' end as file_url
    from judged"""
)
def repo_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    url, number = F.col("url"), F.col("page_id").cast("string")
    host = F.regexp_extract(url, "//([^/]+)/", 1)
    made = (
        F.when(url.contains(".example.com"), F.concat(F.lit("https://github.com/"), host, F.lit("/site.git/tree/v1/docs/"), number))
        .when(url.contains(".example.net"), F.concat(F.lit("https://www.github.com/acme/p"), number, F.lit("/extra/path")))
        .when(url.contains(".example.org"), F.lit("https://github.com/only"))
        .otherwise(url)
    )
    parsed = table(spark, sf_dir, "pages").select("page_id", parse_repo_url(made).alias("r"))
    return parsed.select(
        "page_id",
        "r.*",
        source_url(F.col("r.owner"), F.col("r.repo"), F.col("r.branch"), F.concat(F.lit("a b/"), "page_id", F.lit(".mdx"))).alias(
            "file_url"
        ),
    )


_TITLE_SQL = """trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(
  regexp_extract(html, '(?i)<title>([^<]*)</title>', 1), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
  '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g'))"""


def _slug_sql(value: str) -> str:
    return f"replace(regexp_replace(lower(trim({value})), '[^\\p{{L}}\\p{{Nl}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}\\- ]', '', 'g'), ' ', '-')"


def _clean_sql(value: str) -> str:
    """Strip spaces and every wrapping pair at most once, in the order of the pairs."""
    quoted = lambda text: text.replace("'", "''")
    result = f"regexp_replace({value}, '^[{SPACE_SQL}]+|[{SPACE_SQL}]+$', '', 'g')"
    for start, end in WRAPPING_PAIRS:
        pattern = f"(?s)^{quoted(start)}[{SPACE_SQL}]*(.*?)[{SPACE_SQL}]*{quoted(end)}$"
        result = f"regexp_replace({result}, '{pattern}', '\\1')"
    return result


# Every fourth title comes without quotes, the others are wrapped once more.
_WRAPPED_SQL = """case page_id % 4 when 0 then title when 1 then ' "(' || title || ')" ' when 2 then '[' || title || ']' else '“ ' || title || '”' end"""


@checked(
    f"""with t as (select page_id, url, {_TITLE_SQL} as title from pages)
    select page_id, {_WRAPPED_SQL} as wrapped, {_clean_sql(_WRAPPED_SQL)} as cleaned, {_slug_sql('title')} as slug,
      case when contains(url, '#') or {_slug_sql('title')} = '' then url else url || '#' || {_slug_sql('title')} end as linked,
      string_split(url, '#')[1] as bare
    from t"""
)
def title_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", page_title(F.col("html")).alias("title"))
    slug = heading_slug(F.col("title"))
    kind, title = F.col("page_id") % 4, F.col("title")
    wrapped = (
        F.when(kind == 0, title)
        .when(kind == 1, F.concat(F.lit(' "('), title, F.lit(')" ')))
        .when(kind == 2, F.concat(F.lit("["), title, F.lit("]")))
        .otherwise(F.concat(F.lit("“ "), title, F.lit("”")))
    )
    return pages.select(
        "page_id",
        wrapped.alias("wrapped"),
        clean_title(wrapped).alias("cleaned"),
        slug.alias("slug"),
        append_slug(F.col("url"), slug).alias("linked"),
        strip_fragment(F.col("url")).alias("bare"),
    )


_LINKS_SQL = """
base as (
  select doc_id, source, lang,
    case when source = 'src1' then 'content/docs/' else 'guide/' end || source || '/' ||
      case when lang = 'en' then 'a b' || doc_id || '.mdx' when lang = 'fr' then 'index.md' else doc_id || '.ts' end as filepath,
    'https://github.com/acme/' || source || '/blob/main/' || doc_id as url, 'The "' || lang || '" part' as title
  from documents),
linked as (
  select *, url || '#the-' || lang || '-part' as github_url,
    case when lang = 'en' then 'https://docs.acme.dev/' || case when source = 'src1' then '' else 'guide/' end || source || '/a%20b' || doc_id || '#the-' || lang || '-part'
         when lang = 'fr' then 'https://docs.acme.dev/' || case when source = 'src1' then '' else 'guide/' end || source || '#the-' || lang || '-part' end as docs_url
  from base)
"""


@checked(
    f"""with {_LINKS_SQL}
    select doc_id, github_url, docs_url, case when lang in ('en', 'fr') then docs_url else github_url end as final_url,
      case when lang in ('en', 'fr') then docs_url else url || '#L' || doc_id || case when source = 'src2' then '' else '-L' || (doc_id + 4) end end as cite_url
    from linked"""
)
def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("doc_id").cast("string")
    files = table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        F.concat(
            F.when(F.col("source") == "src1", "content/docs/").otherwise("guide/"),
            "source",
            F.lit("/"),
            F.when(F.col("lang") == "en", F.concat(F.lit("a b"), number, F.lit(".mdx")))
            .when(F.col("lang") == "fr", "index.md")
            .otherwise(F.concat(number, F.lit(".ts"))),
        ).alias("filepath"),
        F.concat(F.lit(f"{ORG}/"), "source", F.lit("/blob/main/"), number).alias("url"),
        F.concat(F.lit('The "'), "lang", F.lit('" part')).alias("title"),
    )
    linked = resolve_links(files, "https://docs.acme.dev/", title_col="title", source_url_col="url")
    end = F.when(F.col("source") == "src2", F.col("doc_id")).otherwise(F.col("doc_id") + 4)
    return linked.select(
        "doc_id",
        "github_url",
        "docs_url",
        "final_url",
        citation_url(
            F.col("filepath"),
            F.lit(None).cast("string"),
            F.col("github_url"),
            F.col("docs_url"),
            F.col("final_url"),
            F.col("doc_id"),
            end,
        ).alias("cite_url"),
    )


@checked(
    """select page_id, 'https://docs.acme.dev/' || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*/?([^?#]*)', 1), '/+$', '') as page_url
    from pages"""
)
def docs_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_extract("url", "\\A[a-z]+://[^/?#]*/?([^?#]*)", 1), "/+\\z", "")
    pages = table(spark, sf_dir, "pages").withColumn("filepath", F.concat(F.lit("content/docs/"), path, F.lit(".mdx")))
    return pages.select("page_id", docs_url(F.col("filepath"), "https://docs.acme.dev/").alias("page_url"))


@checked("select doc_id, sha256(text) as checksum from documents")
def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", content_checksum(F.col("text")).alias("checksum"))


@checked(
    """select doc_id, ceil(length(text) / 4.0)::integer as tokens,
      ceil((length(text) + length('&lt;&#124;endoftext&#124;&gt;')) / 4.0)::integer as marked_tokens
    from documents"""
)
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = sanitize_special_tokens(F.concat("text", F.lit("<|endoftext|>")))
    return texts(spark, sf_dir).select(
        "doc_id", count_tokens(F.col("text")).alias("tokens"), count_tokens(marked).alias("marked_tokens")
    )


@checked(
    """select doc_id, case lang when 'en' then 'doc' when 'fr' then 'code' when 'de' then 'code' end as source_type,
      case lang when 'en' then 'typescript' when 'fr' then 'javascript' when 'de' then 'cpp' else 'rust' end as language,
      'acme/' || source as repo
    from documents"""
)
def type_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lang = F.col("lang")
    stored = F.when(lang == "en", "mdx").when(lang == "fr", "python").when(lang == "de", "code").otherwise("other")
    path = F.concat(
        F.lit("a/"), F.when(lang == "en", "x.md").when(lang == "fr", "x.JSX").when(lang == "de", "x.cc").otherwise("x.rs")
    )
    url = F.concat(F.lit(f"{ORG}/"), "source", F.lit("/blob/main/x"))
    return docs.select(
        "doc_id",
        normalize_source_type(stored).alias("source_type"),
        language_of_path(path).alias("language"),
        repo_of_url(url).alias("repo"),
    )


@checked(
    """select doc_id, case when n_chars > 4000 then n_chars else case lang when 'fr' then 100 else 8192 end end::integer as token_limit
    from documents"""
)
def token_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(F.col("lang") == "fr", " Small-Model-v2 ").when(F.col("lang") == "en", "text-embedding-3-small").otherwise("x").alias(
            "model"
        ),
        F.when(F.col("n_chars") > 4000, F.col("n_chars").cast("double")).alias("explicit"),
    )
    limits = (("small-model", 100), ("text-embedding-3-small", 8192))
    return embedding_token_limit(docs, "model", "explicit", limits).select("doc_id", "token_limit")


@checked(
    """with repos as (
      select distinct source, case doc_id % 4 when 0 then 'https://github.com/acme/' || source when 1 then 'https://example.org/acme/' || source
        when 2 then 'https://github.com/' || source else source end as repo_url,
        case when lang = 'en' then 'docs' else 'code' end as kind from documents)
    select distinct repo_url, kind, case when starts_with(repo_url, 'src') then 'invalid url'
      when starts_with(repo_url, 'https://example') then 'unsupported host' else 'owner and repository required' end as error
    from repos where not starts_with(repo_url, 'https://github.com/acme/')"""
)
def skipped_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("doc_id") % 4
    url = (
        F.when(kind == 0, F.concat(F.lit("https://github.com/acme/"), "source"))
        .when(kind == 1, F.concat(F.lit("https://example.org/acme/"), "source"))
        .when(kind == 2, F.concat(F.lit("https://github.com/"), "source"))
        .otherwise(F.col("source"))
    )
    docs = table(spark, sf_dir, "documents")
    return skipped_repos(
        docs.select(url.alias("repo_url"), F.when(F.col("lang") == "en", "docs").otherwise("code").alias("kind"))
    )
