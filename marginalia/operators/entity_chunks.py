"""Code entities as chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.rows import explode_array, one_row
from marginalia.functions.text import content_checksum
from marginalia.functions.tokens import TokenizerFactory, count_tokens
from marginalia.operators.split import split_texts

# Entity types of all languages -> the common types of chunks.
UNIFIED_TYPES = {
    "module": "variable",
    "mod": "variable",
    "const": "variable",
    "static": "variable",
    "associated_const": "variable",
    "struct": "class",
    "trait": "class",
    "impl": "class",
    "union": "class",
    "type_alias": "type",
    "associated_type": "type",
    "enum_variant": "enum",
    "macro": "function",
}
# Order of the groups in a file summary.
SUMMARY_ORDER = ("interface", "type", "enum", "class", "function", "method", "variable")


def unify_entity_type(entity_type: Column) -> Column:
    result = F.when(entity_type.isNull(), None)
    for common in dict.fromkeys(UNIFIED_TYPES.values()):
        own = [name for name, unified in UNIFIED_TYPES.items() if unified == common]
        result = result.when(entity_type.isin(own), common)
    return result.otherwise(entity_type)


def chunk_entities(
    entities: DataFrame, limit: int, tokenizer: TokenizerFactory | None = None
) -> DataFrame:
    """Chunks of code entities: whole ones within the limit, numbered parts of the others.

    A part begins with a header that names its entity and its type; the header counts against the
    limit. ``base_name`` keeps the entity's name, ``chunk_index`` numbers the chunks of a file.
    """
    header = F.concat(
        F.lit("// Entity: "),
        F.col("qualified_name"),
        F.lit("\n// "),
        F.col("entity_type"),
        F.lit("\n// ... (continued)\n"),
    )
    sized = entities.withColumn("_header", header).withColumn("_texts", F.array("code"))
    budget = F.greatest(F.lit(limit) - count_tokens(F.col("_header"), tokenizer), F.lit(1))
    split = split_texts(
        sized.withColumn("_budget", budget),
        "_texts",
        F.col("_budget"),
        total_limit=F.lit(limit),
        tokenizer=tokenizer,
    ).withColumn("_parts", F.get("parts", F.lit(0)))
    # One part means that nothing but blank lines would go: the entity stays whole.
    split = split.withColumn("_split", F.coalesce(F.size("_parts") > 1, F.lit(False)))
    whole = F.array(F.struct(F.col("code").alias("text"), F.lit(0).alias("first"), F.lit(0).alias("last")))
    kept = ["filepath", "entity_no", "entity_type", "name", "qualified_name", "parent_context", "is_exported", "doc"]
    rows = explode_array(
        split.withColumn("_total", F.when(F.col("_split"), F.size("_parts"))),
        [*kept, "start_line", "end_line", "_header", "_split", "_total"],
        F.when(F.col("_split"), F.col("_parts")).otherwise(whole),
        "_i",
        "_part",
    )
    number = F.when(F.col("_split"), F.col("_i") + 1)
    content = F.when(F.col("_split"), F.concat("_header", "_part.text")).otherwise(F.col("_part.text"))
    order = Window.partitionBy("filepath").orderBy("entity_no", "_i")
    return (
        rows.withColumn("content", content)
        .withColumn("chunk_index", F.row_number().over(order) - 1)
        .select(
            "filepath",
            "chunk_index",
            F.when(F.col("_split"), F.concat("qualified_name", F.lit("_part"), number.cast("string")))
            .otherwise(F.col("qualified_name"))
            .alias("qualified_name"),
            F.col("qualified_name").alias("base_name"),
            "name",
            unify_entity_type(F.col("entity_type")).alias("entity_type"),
            "content",
            content_checksum(F.col("content")).alias("checksum"),
            "parent_context",
            F.when(F.col("_split"), F.col("start_line") + F.col("_part.first"))
            .otherwise(F.col("start_line"))
            .alias("start_line"),
            F.when(F.col("_split"), F.col("start_line") + F.col("_part.last"))
            .otherwise(F.col("end_line"))
            .alias("end_line"),
            "is_exported",
            F.when(~F.col("_split") | (F.col("_i") == 0), F.col("doc")).alias("doc"),
            number.alias("part_number"),
            F.col("_total").alias("total_parts"),
        )
    )


def flatten_file_chunks(chunks: DataFrame, outline: DataFrame) -> DataFrame:
    """Chunks with the imports and the module documentation of their file."""
    return chunks.join(outline.select("filepath", "imports", "module_doc"), "filepath", "left")


def attach_parent(chunks: DataFrame, entities: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with their whole document, its further columns, and the entity they are a part of."""
    entity = entities.select(
        "filepath",
        F.col("qualified_name").alias("base_name"),
        F.col("name").alias("entity_name"),
        F.col("parameters"),
        F.col("return_type"),
    ).dropDuplicates(["filepath", "base_name"])
    document = documents.withColumnRenamed("content", "document")
    return chunks.join(entity, ["filepath", "base_name"], "left").join(document, "filepath", "left")


def chunking_stats(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """One row: files, entities, chunks, split entities and chunks per file."""
    first = F.coalesce(F.col("part_number"), F.lit(1)) == 1
    counted = chunks.agg(
        F.count_if(first).alias("entities"),
        F.count("*").alias("chunks"),
        F.count_if(first & (F.col("total_parts") > 1)).alias("split_entities"),
    )
    stats = one_row(files.agg(F.count("*").alias("files")), counted)
    return stats.withColumn(
        "chunks_per_file", F.coalesce(F.try_divide(F.col("chunks"), F.col("files")), F.lit(0.0))
    )


def entity_type_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("entity_type").agg(F.count("*").alias("chunks"))


def file_summary(entities: DataFrame, outline: DataFrame) -> DataFrame:
    """Text outline per file: its imports, then its entities by type."""
    place = F.array_position(F.array(*[F.lit(t) for t in SUMMARY_ORDER]), F.col("entity_type"))
    line = F.concat(
        F.lit("  "),
        F.when(F.col("is_exported"), F.lit("export ")).otherwise(""),
        F.col("qualified_name"),
        F.coalesce("parameters", F.lit("")),
        F.coalesce(F.concat(F.lit(": "), F.col("return_type")), F.lit("")),
    )
    groups = (
        entities.withColumn("_place", place)
        .filter(F.col("_place") > 0)
        .groupBy("filepath", "_place", "entity_type")
        .agg(F.array_sort(F.collect_list(F.struct("entity_no", line.alias("line")))).alias("_lines"))
        .withColumn(
            "text",
            F.concat(
                F.initcap("entity_type"),
                F.lit("s:\n"),
                F.array_join(F.transform("_lines", lambda x: x["line"]), "\n"),
            ),
        )
        .groupBy("filepath")
        .agg(F.array_sort(F.collect_list(F.struct("_place", "text"))).alias("_groups"))
    )
    imports = F.when(
        F.size("imports") > 0,
        F.concat(F.lit("Imports:\n"), F.array_join(F.transform("imports", lambda i: F.concat(F.lit("  "), i)), "\n")),
    )
    return outline.join(groups, "filepath", "left").select(
        "filepath",
        F.concat_ws(
            "\n\n", imports, F.array_join(F.transform("_groups", lambda g: g["text"]), "\n\n")
        ).alias("summary"),
    )
