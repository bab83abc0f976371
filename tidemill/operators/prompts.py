"""Prompt and correction texts for a table of tasks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from tidemill.functions.fixed import (
    CORRECTION_RULES,
    FORMAT_RULES,
    NO_CODE_ERRORS,
    NO_SCHEMA,
    NOT_A_DAG,
    PLACEHOLDER_ADVICE,
    STRATEGY_HINTS,
)
from tidemill.operators.classify import classify

MAX_CORRECTIONS = 2


def _lookup(key: Column, table: Mapping[str, str]) -> Column:
    """The entry for ``key``, null if there is none."""
    value = F.lit(None).cast("string")
    for name, text in table.items():
        value = F.when(key == name, F.lit(text)).otherwise(value)
    return value


def schema_section(source_tables: Column, blocks: Mapping[str, str]) -> Column:
    """The texts of the tables a task names (all tables when it names none by null).

    ``blocks`` holds one short text per table of the catalog; it travels with
    the plan, so the tasks are neither joined nor shuffled.
    """
    if not blocks:
        return F.lit(NO_SCHEMA)
    everything = "\n".join(blocks[name] for name in sorted(blocks))
    lookup = F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair])
    named = F.array_compact(F.transform(source_tables, lambda name: F.element_at(lookup, name)))
    text = F.when(source_tables.isNull(), F.lit(everything)).otherwise(F.array_join(named, "\n"))
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(NO_SCHEMA))


def prompts(tasks: DataFrame, blocks: Mapping[str, str], classify_all: bool = False) -> DataFrame:
    """(id, prompt) for tasks with id, description, output_format, source_tables.

    Sections are joined by blank lines; the pattern section goes to SQL tasks
    only unless ``classify_all``.
    """
    known = classify(tasks)
    hint = _lookup(F.col("strategy"), STRATEGY_HINTS)
    pattern = F.concat(
        F.lit("Detected ETL pattern: "), F.col("pattern"),
        F.lit("\nLoad strategy: "), F.col("strategy"),
        F.lit("\nPattern description: "), F.col("pattern_description"),
        F.coalesce(F.concat(F.lit("\nImplementation hint: "), hint), F.lit("")),
        F.coalesce(F.concat(F.lit("\nTarget table hint from the task: "), F.col("target_hint")), F.lit("")),
    )
    if not classify_all:
        pattern = F.when(F.col("output_format") == "sql", pattern)
    text = F.concat_ws(
        "\n\n",
        F.concat(F.lit("Task description:\n"), F.col("description")),
        F.concat(F.lit("Database schema:\n"), schema_section(F.col("source_tables"), blocks)),
        F.concat(F.lit("Required output format: "), F.col("output_format")),
        pattern,
        _lookup(F.col("output_format"), FORMAT_RULES),
    )
    return known.select("id", text.alias("prompt"))


def correction_text(code: Column, error: Column, output_format: Column) -> Column:
    """The request to fix ``code``, with the rules of its format."""
    advice = F.when(
        (output_format == "sql") & error.contains("placeholders or bind parameters"), F.lit(PLACEHOLDER_ADVICE)
    )
    shown = F.when((output_format == "airflow_dag") & (code == ""), F.lit("# No DAG code")).otherwise(code)
    return F.concat(
        F.lit("The following code has an error. Fix it and return the full corrected code.\n\nOriginal code:\n"), F.coalesce(shown, F.lit("")),
        F.lit("\n\nError: "), F.coalesce(error, F.lit("")),
        F.coalesce(_lookup(output_format, CORRECTION_RULES), F.lit("")),
        F.coalesce(advice, F.lit("")),
    )


def correction_round(attempts: DataFrame, limit: int = MAX_CORRECTIONS) -> DataFrame:
    """Adds state (accepted, retry, failed), next_attempt, prompt and final_error.

    ``attempts`` has output_format, code, extracted, valid, error, attempts.
    Invalid results are tried again while ``attempts <= limit``.  A response
    without code is final at once, but for the first answer of a DAG task.
    One run of this projection is one round; the answers come back as the next
    table of attempts.
    """
    fmt = F.col("output_format")
    no_code = ~F.col("extracted") & ~((fmt == "airflow_dag") & (F.col("attempts") == 1))
    state = (
        F.when(no_code, "failed")
        .when(F.col("extracted") & F.col("valid"), "accepted")
        .when(F.col("attempts") <= limit, "retry")
        .otherwise("failed")
    )
    error = F.when(F.col("extracted"), F.col("error")).otherwise(F.lit(NOT_A_DAG))
    staged = attempts.withColumn("state", state)
    retry = F.col("state") == "retry"
    return staged.select(
        "*",
        F.when(retry, F.col("attempts") + 1).alias("next_attempt"),
        F.when(retry, correction_text(F.col("code"), error, fmt)).alias("prompt"),
        F.when(F.col("state") == "failed", F.when(no_code, _lookup(fmt, NO_CODE_ERRORS)).otherwise(error)).alias(
            "final_error"
        ),
    )
