"""Schemas of the tables this package reads and writes."""

from pyspark.sql import types as T

STORE = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("content", T.StringType(), False),
        T.StructField("contextual_text", T.StringType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType(), False), True),
        T.StructField("filepath", T.StringType(), False),
        T.StructField("chunk_id", T.IntegerType(), False),
        T.StructField("chunk_title", T.StringType(), False),
        T.StructField("checksum", T.StringType(), False),
        T.StructField("github_url", T.StringType(), True),
        T.StructField("docs_url", T.StringType(), True),
        T.StructField("final_url", T.StringType(), True),
        T.StructField("source_type", T.StringType(), False),
        T.StructField("entity_type", T.StringType(), True),
        T.StructField("start_line", T.IntegerType(), True),
        T.StructField("end_line", T.IntegerType(), True),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("updated_at", T.TimestampType(), False),
    ]
)

# Columns that an upsert overwrites on a (filepath, chunk_id) conflict.
UPSERT_COLUMNS = (
    "content",
    "contextual_text",
    "embedding",
    "chunk_title",
    "checksum",
    "github_url",
    "docs_url",
    "final_url",
    "source_type",
    "entity_type",
    "start_line",
    "end_line",
)

CORPUS = T.StructType(
    [
        T.StructField("type", T.StringType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("relative_path", T.StringType(), False),
        T.StructField("content", T.StringType(), False),
        T.StructField("sha", T.StringType(), True),
        T.StructField("size", T.LongType(), True),
        T.StructField("source_url", T.StringType(), True),
        T.StructField("repo_url", T.StringType(), True),
    ]
)

REPOS = T.StructType(
    [
        T.StructField("repo_url", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("directory", T.StringType(), True),
        T.StructField("include_directories", T.ArrayType(T.StringType()), True),
        T.StructField("exclude_patterns", T.ArrayType(T.StringType()), True),
        T.StructField("base_url", T.StringType(), True),
        T.StructField("content_path", T.StringType(), True),
        T.StructField("branch", T.StringType(), True),
    ]
)

ENTITY = T.StructType(
    [
        T.StructField("filepath", T.StringType(), False),
        T.StructField("entity_no", T.IntegerType(), False),
        T.StructField("entity_type", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("qualified_name", T.StringType(), False),
        T.StructField("code", T.StringType(), False),
        T.StructField("parent_context", T.StringType(), True),
        T.StructField("start_line", T.IntegerType(), False),
        T.StructField("end_line", T.IntegerType(), False),
        T.StructField("is_exported", T.BooleanType(), False),
        T.StructField("doc", T.StringType(), True),
        T.StructField("parameters", T.StringType(), True),
        T.StructField("return_type", T.StringType(), True),
        # Whether the file could be read to its end; if not, it is one entity as a whole.
        T.StructField("is_balanced", T.BooleanType(), True),
    ]
)
