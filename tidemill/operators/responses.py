"""Code in model responses: fenced blocks and the modules they import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemill.functions.text import strip_blanks

# Languages in the order they are looked for, and the shape of a tagged block.
FALLBACK_LANGUAGES = ("sql", "python", "yaml")
_ANY_BLOCK = r"(?s)```([a-zA-Z0-9_+-]+)\s*(.*?)```"


def _block(language: str, legacy: bool) -> str:
    return r"(?s)```" + language + (r"\s*" if legacy else r"\s+") + r"(.*?)```"


def code_block(response: Column, language: str, legacy: bool = False) -> Column:
    """The first block tagged ``language``, without surrounding blanks; null if there is none, '' if it is empty.

    The tag must end where the name ends; ``legacy`` also takes ``sqlite`` for
    ``sql`` with the rest of the tag as code.
    """
    pattern = _block(language, legacy)
    return F.when(response.rlike(pattern), strip_blanks(F.regexp_extract(response, pattern, 1)))


def parse(responses: DataFrame, legacy: bool = False) -> DataFrame:
    """Adds code, language and success.

    The block of ``expected_language`` (sql or python) is taken, else the first
    one of sql, python, yaml, else the first with any tag.
    """
    text = F.col("response")
    blocks = {lang: code_block(text, lang, legacy) for lang in FALLBACK_LANGUAGES}
    found = responses.select("*", *[blocks[lang].alias(f"_{lang}") for lang in FALLBACK_LANGUAGES])
    expected = F.lit(None).cast("string")
    for lang in FALLBACK_LANGUAGES:
        expected = F.when(F.col("expected_language") == lang, F.col(f"_{lang}")).otherwise(expected)
    tagged = text.rlike(_ANY_BLOCK)
    language = F.when(expected.isNotNull(), F.col("expected_language"))
    for lang in FALLBACK_LANGUAGES:
        language = F.coalesce(language, F.when(F.col(f"_{lang}").isNotNull(), F.lit(lang)))
    language = F.coalesce(language, F.when(tagged, F.regexp_extract(text, _ANY_BLOCK, 1)))
    code = F.coalesce(
        expected,
        *[F.col(f"_{lang}") for lang in FALLBACK_LANGUAGES],
        F.when(tagged, strip_blanks(F.regexp_extract(text, _ANY_BLOCK, 2))),
    )
    return found.select(
        *responses.columns,
        F.coalesce(code, F.lit("")).alias("code"),
        F.coalesce(language, F.lit("")).alias("language"),
        code.isNotNull().alias("success"),
    )


def imported_modules(code: Column) -> Column:
    """Modules named by the unindented imports of a script, in order, repeats included.

    ``import a, b as c`` names a and b; ``from m import x`` names m.
    """
    lines = F.regexp_extract_all(code, F.lit(r"(?md)^(?:import|from)[ \t]+\S[^\n]*"), F.lit(0))

    def modules(line: Column) -> Column:
        rest = F.regexp_replace(line, r"^(import|from)[ \t]+", "")
        named = F.when(line.startswith("from"), F.array(rest)).otherwise(F.split(rest, ","))
        return F.filter(F.transform(named, lambda m: F.regexp_extract(m, r"^\s*([^\s,;#]+)", 1)), lambda m: m != "")

    return F.flatten(F.transform(lines, modules))


def module_counts(scripts: DataFrame) -> DataFrame:
    """(module, scripts): in how many scripts a module is imported."""
    named = scripts.select(F.explode(F.array_distinct(imported_modules(F.col("code")))).alias("module"))
    return named.groupBy("module").agg(F.count(F.lit(1)).alias("scripts"))
