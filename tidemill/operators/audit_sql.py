"""Audit of SQL texts: placeholders, kinds of statements, tables used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemill.functions import fixed
from tidemill.operators.findings import evaluate, finding, tests


# -- scripts of statements: script_steps(script_id, step, statement) ----------


def without_literals(sql: Column) -> Column:
    """Text without quoted strings and without the colons of ``::`` casts."""
    return F.replace(F.regexp_replace(sql, "'[^']*'", "''"), F.lit("::"), F.lit(" "))


def has_placeholder(sql: Column, literal: bool = False) -> Column:
    """Bind placeholders in the text; ``literal`` also counts look-alikes in quoted strings and casts."""
    pattern = "|".join(fixed.PLACEHOLDERS)
    anywhere = sql.rlike(pattern)
    # A placeholder outside strings is one anywhere: the second look is for few texts only.
    return anywhere if literal else anywhere & without_literals(sql).rlike(pattern)


def placeholders(steps: DataFrame, literal: bool = False) -> DataFrame:
    """One finding per script with a placeholder in any statement."""
    per_script = steps.groupBy("script_id").agg(F.bool_or(has_placeholder(F.col("statement"), literal)).alias("hit"))
    return per_script.filter("hit").select(
        *finding(F.col("script_id"), "placeholders", "logic", F.lit(fixed.PLACEHOLDER_ERROR))
    )


_FIRST_WORD = r"(?s)^\s*(?:--[^\n]*\n\s*|/\*.*?\*/\s*)*([A-Za-z]+)"


_COMMENTS_AND_STRINGS = r"(?s)--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"[^\"]*\""
_PARENTHESES_AND_VERBS = r"[()]|\b(?:SELECT|INSERT|UPDATE|DELETE|MERGE)\b"


def _tokens(statement: Column) -> Column:
    """Parentheses and verbs of a statement, comments and strings left out."""
    bare = F.upper(F.regexp_replace(statement, _COMMENTS_AND_STRINGS, " "))
    return F.regexp_extract_all(bare, F.lit(_PARENTHESES_AND_VERBS), F.lit(0))


def _led_to(tokens: Column) -> Column:
    """The verb a WITH list leads to: the first one outside parentheses, counted at any depth; null without a list."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("string").alias("verb"))

    def read(state: Column, token: Column) -> Column:
        opened = F.when(token == "(", 1).when(token == ")", -1).otherwise(0)
        verb = (state["depth"] == 0) & ~token.isin("(", ")")
        return F.struct((state["depth"] + opened).alias("depth"), F.coalesce(state["verb"], F.when(verb, token)).alias("verb"))

    return F.aggregate(tokens, start, read, lambda state: F.coalesce(state["verb"], F.lit("SELECT")))


def statement_kind(statement: Column) -> Column:
    """The kind of one statement as an expression; ``statement_kinds`` is the faster form for tables."""
    word = F.upper(F.regexp_extract(statement, _FIRST_WORD, 1))
    kind = F.coalesce(_led_to(F.when(word == "WITH", _tokens(statement))), word)
    return F.when(kind.isin(*fixed.STATEMENT_KINDS), kind).otherwise("UNKNOWN")


def statement_kinds(steps: DataFrame) -> DataFrame:
    """The kind by the first word after comments; after a WITH list, by the verb it leads to.

    Word, verb and kind are columns of their own, one after the other: conditions share no
    expressions, so a verb named twice would be looked for twice.
    """
    statement = F.col("statement")
    worded = steps.select("script_id", "step", "statement", F.regexp_extract(statement, _FIRST_WORD, 1).alias("first"))
    worded = worded.select("script_id", "step", "statement", F.upper("first").alias("word"))
    tokens = F.when(F.col("word") == "WITH", _tokens(statement))
    verbs = worded.select("script_id", "step", "word", tokens.alias("tokens"))
    verbs = verbs.select("script_id", "step", "word", _led_to(F.col("tokens")).alias("verb"))
    kinds = verbs.select("script_id", "step", F.coalesce("verb", "word").alias("kind"))
    known = F.when(F.col("kind").isin(*fixed.STATEMENT_KINDS), F.col("kind")).otherwise("UNKNOWN")
    return kinds.select("script_id", "step", known.alias("kind"))


def materializing(scripts: DataFrame, steps: DataFrame) -> DataFrame:
    """Findings for scripts that are empty, only select, or change nothing.

    ``scripts(script_id)`` names all scripts, so that empty ones are seen.
    Statements of blanks alone are not counted.
    """
    kind = F.col("kind")
    filled = steps.filter(F.col("statement").rlike(r"\S"))
    per_script = statement_kinds(filled).groupBy("script_id").agg(
        F.bool_and(kind == "SELECT").alias("only_select"), F.bool_or(kind.isin(*fixed.MATERIALIZING)).alias("changes")
    )
    judged = scripts.select("script_id").join(per_script, "script_id", "left")
    number = (
        F.when(F.col("changes").isNull(), F.lit("empty"))
        .when(F.col("only_select"), F.lit("select_only"))
        .when(~F.col("changes"), F.lit("not_materializing"))
    )
    parts = {
        "empty": ("syntax", fixed.EMPTY_SCRIPT),
        "select_only": ("logic", fixed.SELECT_ONLY),
        "not_materializing": ("logic", fixed.NOT_MATERIALIZING),
    }
    rows = [
        F.when(number == check, F.struct(*finding(F.col("script_id"), check, stage, F.lit(message))))
        for check, (stage, message) in parts.items()
    ]
    return judged.select(F.coalesce(*rows).alias("f")).filter("f IS NOT NULL").select("f.*")


# Which check speaks for a script that fails several.
_VERDICT_ORDER = ("empty", "placeholders", "select_only", "not_materializing")


def script_verdicts(scripts: DataFrame, steps: DataFrame, literal: bool = False) -> DataFrame:
    """(script_id, valid, stage, error): one row per script, with the first check it fails.

    ``scripts(script_id)`` names all scripts, each once; those without a statement are empty. Every check is an
    aggregate per script, so no script's statements need to meet in one place.
    """
    found = materializing(scripts, steps).unionByName(placeholders(steps, literal))
    rank = F.array_position(F.array(*map(F.lit, _VERDICT_ORDER)), F.col("check_name"))
    first = found.groupBy(F.col("id").alias("_failed")).agg(F.min(F.struct(rank.alias("rank"), "stage", "message")).alias("first"))
    judged = scripts.select("script_id").join(first, F.col("script_id") == F.col("_failed"), "left")
    return judged.select(
        "script_id",
        F.col("first").isNull().alias("valid"),
        F.col("first.stage").alias("stage"),
        F.col("first.message").alias("error"),
    )


# -- tables used by tasks: dag_tasks(dag_id, task_id, operator, sql_text) -------


def normal_identifier(name: Column) -> Column:
    return F.lower(F.btrim(F.btrim(name), F.lit('"')))


def _matches(sql: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(sql, F.lit("(?i)" + pattern), F.lit(group))


def sql_tasks(tasks: DataFrame) -> DataFrame:
    """Tasks that run SQL in the database."""
    return tasks.filter((F.col("operator") == "PostgresOperator") & (F.col("task_id") != "") & (F.col("sql_text") != ""))


def table_refs(tasks: DataFrame) -> DataFrame:
    """Lineage: (dag_id, task_id, table_name), once per task and table read or written."""
    names = F.explode(F.array_distinct(_matches(F.col("sql_text"), fixed.TABLE_USE)))
    return (
        sql_tasks(tasks)
        .select("dag_id", "task_id", names.alias("n"))
        .select("dag_id", "task_id", normal_identifier(F.col("n")).alias("table_name"))
        .distinct()
    )


def temp_tables(tasks: DataFrame) -> DataFrame:
    """(dag_id, task_id, table_name) of temporary tables a task creates."""
    names = F.explode(F.array_distinct(_matches(F.col("sql_text"), fixed.TEMP_TABLE)))
    return (
        sql_tasks(tasks)
        .select("dag_id", "task_id", names.alias("n"))
        .select("dag_id", "task_id", normal_identifier(F.col("n")).alias("table_name"))
        .distinct()
    )


def cross_task_temp(tasks: DataFrame) -> DataFrame:
    """(dag_id, consumer, table_name, producers, producer): temporary tables of another task of the DAG.

    One row per consumer and table, with the number of other tasks that create
    it and one of these: the producers of a table are reduced to one row before
    the join, so it never pairs all tasks that share a name.  What a task reads
    and what it creates is found in one scan.
    """

    def marked(pattern: str, made: bool) -> Column:
        names = F.array_distinct(_matches(F.col("sql_text"), pattern))
        return F.transform(names, lambda n: F.struct(normal_identifier(n).alias("table_name"), F.lit(made).alias("made")))

    named = sql_tasks(tasks).select(
        "dag_id", "task_id", F.inline(F.concat(marked(fixed.TABLE_USE, False), marked(fixed.TEMP_TABLE, True)))
    )
    per_task = named.groupBy("dag_id", "task_id", "table_name").agg(
        F.bool_or("made").alias("made"), F.bool_or(~F.col("made")).alias("used")
    )
    makers = per_task.filter("made").groupBy("dag_id", "table_name").agg(
        F.count(F.lit(1)).alias("makers"), F.min("task_id").alias("first_maker"), F.max("task_id").alias("last_maker")
    )
    consumers = per_task.filter("used").withColumnRenamed("task_id", "consumer")
    others = F.col("makers") - F.col("made").cast("int")
    other = F.when(F.col("first_maker") != F.col("consumer"), F.col("first_maker")).otherwise(F.col("last_maker"))
    return consumers.join(makers, ["dag_id", "table_name"]).filter(others > 0).select(
        "dag_id", "consumer", "table_name", others.alias("producers"), other.alias("producer")
    )


def shared_temp_producers(tasks: DataFrame) -> DataFrame:
    """(dag_id, table_name, producer): every task that creates a temporary table which another task of the DAG reads.

    Together with ``cross_task_temp`` these rows name all producers of all consumers, without pairing them:
    readers of a table are counted before the join.
    """
    used = table_refs(tasks)
    readers = used.groupBy("dag_id", "table_name").agg(
        F.count(F.lit(1)).alias("readers"), F.min("task_id").alias("first_reader")
    )
    others = (F.col("readers") > 1) | (F.col("first_reader") != F.col("producer"))
    return (
        temp_tables(tasks)
        .withColumnRenamed("task_id", "producer")
        .join(readers, ["dag_id", "table_name"])
        .filter(others)
        .select("dag_id", "table_name", "producer")
    )


def cross_task_temp_findings(tasks: DataFrame) -> DataFrame:
    message = F.concat(
        F.lit("Task '"), F.col("consumer"), F.lit("' reads temporary table(s) ['"), F.col("table_name"),
        F.lit("'] created in task '"), F.col("producer"),
        F.lit("'. Temporary tables are session-scoped and cannot be shared across separate Airflow tasks."),
    )
    return cross_task_temp(tasks).select(
        *finding(F.col("dag_id"), "cross_task_temp", "runtime", message, F.concat_ws(" ", "producer", "consumer", "table_name"))
    )


def schema_references(tasks: DataFrame, schema: str, extra_ctes: bool = True) -> DataFrame:
    """(dag_id, task_id, position, operation, identifier, problem) of table names outside ``schema``.

    ``problem`` is ``other schema`` or ``no schema``.  Names of common table
    expressions, ``excluded`` and names that start with ``temp_`` or ``tmp_``
    need none.  With ``extra_ctes`` every expression of a WITH list is known,
    else only the first.  All is found inside the text: no join.
    """
    sql = F.col("sql_text")
    first = _matches(sql, r"\bwith\s+([a-zA-Z_][a-zA-Z0-9_]*)\s+as\b")
    more = _matches(sql, r",\s*([a-zA-Z_][a-zA-Z0-9_]*)\s+as\s*\(")
    ctes = F.transform(F.concat(first, more) if extra_ctes else first, normal_identifier)
    refs = F.arrays_zip(
        _matches(sql, fixed.TABLE_REFERENCE, 1).alias("operation"), _matches(sql, fixed.TABLE_REFERENCE, 2).alias("identifier")
    )
    rows = sql_tasks(tasks).select("dag_id", "task_id", ctes.alias("ctes"), F.posexplode(refs).alias("position", "ref"))
    name = normal_identifier(F.col("ref.identifier"))
    exempt = F.array_contains("ctes", name) | (name == "excluded") | name.startswith("temp_") | name.startswith("tmp_")
    named = F.when(name.contains("."), F.substring_index(name, ".", 1))
    problem = F.when(named.isNotNull(), F.when(named != schema.lower(), "other schema")).when(~exempt, "no schema")
    return rows.select(
        "dag_id", "task_id", "position", F.lower("ref.operation").alias("operation"),
        F.col("ref.identifier").alias("identifier"), named.alias("schema_name"), problem.alias("problem"),
    ).filter("problem IS NOT NULL")


def schema_findings(tasks: DataFrame, schema: str) -> DataFrame:
    start = [F.lit("Task '"), F.col("task_id"), F.lit("' uses table '"), F.col("identifier"), F.lit("' in "), F.col("operation")]
    other = F.concat(*start, F.lit(" with schema '"), F.col("schema_name"), F.lit(f"'. Expected schema '{schema}'."))
    none = F.concat(
        *start, F.lit(f" without schema qualification. Use explicit names like '{schema}."), F.col("identifier"), F.lit("'.")
    )
    item = F.concat_ws(" ", "task_id", F.lpad(F.col("position").cast("string"), 6, "0"))
    message = F.when(F.col("problem") == "other schema", other).otherwise(none)
    return schema_references(tasks, schema).select(
        *finding(F.col("dag_id"), "schema_qualified", "logic", message, item)
    )


# -- scripts in Python: scripts(script_id, language, code) -------------------------


def data_reads(scripts: DataFrame) -> DataFrame:
    """Findings for scripts that read no data."""
    code = F.lower("code")
    reads = F.lit(False)
    for token in fixed.DATA_READS:
        reads = reads | code.contains(token.lower())
    return evaluate(scripts, "script_id", tests("data_reads", "logic", [(~reads, fixed.NO_DATA_READ)]))
