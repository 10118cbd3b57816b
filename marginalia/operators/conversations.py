"""Questions out of conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import trim_space

# Words that mark a complex request.
COMPLEX_WORDS = (
    "multiple|several|various",
    "step|steps|process|workflow",
    "table|reference|quick reference",
    "constraint|requirement|must|should",
    "input|output|party|parties",
    "build|create|implement|generate",
)
# Words that mark a detailed specification, and the length that does.
DETAILED_WORDS = (
    "specification|spec|requirements|constraints|gotchas",
    "address|policy|id|name|value|parameter",
)
DETAILED_LENGTH = 500


def question_of_conversation(
    turns: DataFrame, key: str = "conv_id", order: str = "turn", text: Column | None = None
) -> DataFrame:
    """Per conversation the last user message and the first system message; without a user text
    there is no row. A plain aggregate: long conversations are reduced on the map side."""
    text = F.col("text") if text is None else text
    user = F.when(F.col("role") == "user", F.col(order))
    system = F.when(F.col("role") == "system", F.col(order))
    return (
        turns.groupBy(key)
        .agg(F.max_by(text, user).alias("question"), F.min_by(text, system).alias("system_prompt"))
        .filter(F.coalesce(trim_space(F.col("question")), F.lit("")) != "")
    )


def is_complex(question: Column) -> Column:
    hit = F.lit(False)
    for words in COMPLEX_WORDS:
        hit = hit | question.rlike(f"(?i){words}")
    return hit


def is_detailed(question: Column) -> Column:
    hit = F.length(question) > DETAILED_LENGTH
    for words in DETAILED_WORDS:
        hit = hit | question.rlike(f"(?i){words}")
    return hit


def classify_questions(df: DataFrame, question_col: str = "question") -> DataFrame:
    question = trim_space(F.col(question_col))
    return df.withColumn("is_complex", is_complex(question)).withColumn("is_detailed", is_detailed(question))


def answer_deltas(partials: DataFrame) -> DataFrame:
    """Text deltas of growing answers: rows (answer_id, seq, answer) to (answer_id, seq, delta).

    A partial that is equal to the one before adds nothing and gives no row.
    """
    order = Window.partitionBy("answer_id").orderBy("seq")
    filled = partials.filter(F.coalesce(F.col("answer"), F.lit("")) != "")
    before = F.lag("answer").over(order)
    return (
        filled.withColumn("_before", before)
        .filter(F.col("_before").isNull() | (F.col("_before") != F.col("answer")))
        .withColumn(
            "delta",
            F.substring(F.col("answer"), F.coalesce(F.length("_before"), F.lit(0)) + 1, F.length("answer")),
        )
        .filter(F.col("delta") != "")
        .select("answer_id", "seq", "delta")
    )
