"""Which ETL pattern a task description asks for.

Everything is one projection per row: the rules are literals in the plan, so
no table is joined and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemill.functions.fixed import DEFAULT_RULE, RULES, TARGET_PATTERNS, TARGET_WORDS


def _contains(text: Column, keyword: str, whole_words: bool) -> Column:
    if whole_words:
        return text.rlike(r"(?U)(?<!\w)" + keyword.replace("+", r"\+") + r"(?!\w)")
    return text.contains(keyword)


def _flag(rule_no: int, keyword_no: int) -> str:
    return f"_k{rule_no}_{keyword_no}"


def _with_flags(tasks: DataFrame, kept: list[str], text_col: str, whole_words: bool) -> DataFrame:
    """``kept`` columns, the lower-case text and one flag per keyword, in one compiled projection.

    Two thirds of the keywords are Cyrillic words with single blanks between
    them.  They are looked for in a copy of the text in which whatever lies
    between Cyrillic passages is a single bar, which leaves little to search in
    texts of other alphabets and cannot hide or make a match.
    """
    lowered = tasks.select(*kept, F.lower(text_col).alias("_text"))
    passages = F.col("_text") if whole_words else F.regexp_replace("_text", "[^а-яё ][^а-яё]*", "|")
    lowered = lowered.select("*", passages.alias("_cyrillic"))
    flags = [
        _contains(F.col("_text" if keyword.isascii() else "_cyrillic"), keyword, whole_words).alias(_flag(number, k))
        for number, rule in enumerate(RULES, start=1)
        for k, keyword in enumerate(rule[3])
    ]
    return lowered.select("*", *flags)


def _rule_scores() -> Column:
    """array<struct<rule_no, pattern, strategy, description, score, keywords>> from the flags, one entry per rule."""
    entries = []
    for number, (pattern, strategy, description, keywords) in enumerate(RULES, start=1):
        flags = [F.col(_flag(number, k)) for k in range(len(keywords))]
        score = sum((f.cast("int") for f in flags), F.lit(0))
        found = F.array_compact(F.array(*[F.when(f, F.lit(k)) for f, k in zip(flags, keywords)]))
        entries.append(
            F.struct(
                F.lit(number).alias("rule_no"),
                F.lit(pattern).alias("pattern"),
                F.lit(strategy).alias("strategy"),
                F.lit(description).alias("description"),
                score.alias("score"),
                found.alias("keywords"),
            )
        )
    return F.array(*entries)


def scores(tasks: DataFrame, id_col: str = "id", text_col: str = "description", whole_words: bool = False) -> DataFrame:
    """One row per description and rule with at least one keyword.

    A score is the number of keywords found anywhere in the text, whatever its
    case; ``whole_words`` does not count parts of words.
    """
    flagged = _with_flags(tasks, [id_col], text_col, whole_words)
    return flagged.select(id_col, F.inline(_rule_scores())).filter("score > 0")


def target_hint(text: Column) -> Column:
    """The target table named in lower-case ``text``, or null.

    A pattern is tried only where one of the words it begins with occurs: most
    texts hold none, and looking for a word is much cheaper than a pattern.
    """
    hints = []
    for pattern, words in zip(TARGET_PATTERNS, TARGET_WORDS):
        possible = F.lit(False)
        for word in words:
            possible = possible | text.contains(word)
        hints.append(F.when(possible, F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))))
    return F.coalesce(*hints)


def classify(
    tasks: DataFrame, id_col: str = "id", text_col: str = "description", whole_words: bool = False
) -> DataFrame:
    """Adds pattern, strategy, pattern_description, keywords and target_hint to each description."""
    scored = _with_flags(tasks, tasks.columns, text_col, whole_words).select(
        *tasks.columns, "_text", _rule_scores().alias("_rules")
    )
    ranked = F.transform(
        F.col("_rules"), lambda r: F.struct(r.getField("score").alias("score"), (-r.getField("rule_no")).alias("first"), r.alias("rule"))
    )
    best = scored.select("*", F.array_max(ranked).alias("_best")).select(
        "*", F.when(F.col("_best.score") > 0, F.col("_best.rule")).alias("_rule")
    )
    pattern, strategy, description = (F.lit(v) for v in DEFAULT_RULE)
    return best.select(
        *tasks.columns,
        F.coalesce("_rule.pattern", pattern).alias("pattern"),
        F.coalesce("_rule.strategy", strategy).alias("strategy"),
        F.coalesce("_rule.description", description).alias("pattern_description"),
        F.coalesce("_rule.keywords", F.array().cast("array<string>")).alias("keywords"),
        target_hint(F.col("_text")).alias("target_hint"),
    )
