"""Quality of repositories and files, complexity and difficulty."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.config import QUALITY_WEIGHTS
from siltstone.operators.cleaning import base_name

# Comment prefixes by language, files that mark a project's structure.
COMMENT_PREFIXES = {
    "python": "#", "bash": "#", "yaml": "#", "sql": "--", "javascript": "//", "typescript": "//", "rust": "//", "go": "//", "cpp": "//", "java": "//", "css": "/*",
}
STRUCTURE_MARKERS = ("readme", "license", "pyproject.toml", "setup.py", "package.json", "cargo.toml", "go.mod", "pom.xml", "build.gradle", "cmakelists.txt", "makefile", "dockerfile")
BRACKET_LANGUAGES = ("javascript", "typescript", "rust", "go", "cpp", "java", "json", "css")


def is_test_path(path: Column) -> Column:
    b, p = F.lower(base_name(path)), F.lower(path)
    return b.startswith("test_") | b.endswith("_test.py") | b.rlike(r"\.(test|spec)\.") | b.contains("_test.go") | p.rlike("/tests?/") | b.endswith("test.java")


def stripped_lines(text: Column) -> Column:
    """Non-blank lines without the white space around them."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def comment_ratio(language: Column, text: Column) -> Column:
    prefix = None
    for lang, p in COMMENT_PREFIXES.items():
        prefix = F.when(language == lang, F.lit(p)) if prefix is None else prefix.when(language == lang, F.lit(p))
    lines = stripped_lines(text)
    hits = F.size(F.filter(lines, lambda x: F.startswith(x, prefix)))
    return F.when(prefix.isNull() | (F.size(lines) == 0), F.lit(0.0)).otherwise(hits / F.size(lines))


def has_docstring(language: Column, text: Column) -> Column:
    return F.when(language == "python", text.contains('"""') | text.contains("'''")).otherwise(text.contains("/**") | (comment_ratio(language, text) > 0.02))


def syntax_valid(language: Column, text: Column) -> Column:
    """True or false where the language can be judged, else NULL."""

    @F.pandas_udf("boolean")
    def exact(langs: pd.Series, texts: pd.Series) -> pd.Series:
        from siltstone.functions.python_code import balanced, compiles

        return pd.Series([None if t is None else compiles(t) if g == "python" else balanced(t) for g, t in zip(langs, texts, strict=True)], dtype=object)

    judged = (language == "python") | language.isin(*BRACKET_LANGUAGES)
    return F.when(judged & text.isNotNull(), exact(language, F.when(judged, text)))


def _code(language: Column) -> Column:
    return language.isin(*COMMENT_PREFIXES, "html")


def _count(text: Column, word: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)


def repository_signals(files: DataFrame, syntax: bool = True) -> DataFrame:
    """``repository`` and the eight signals, from ``files(repository, path, language, content, size, hash)``.

    One projection per file and one aggregation by repository; only the syntax signal needs Python
    (``syntax=False`` leaves it at its neutral value).
    """
    lang, text, path = F.col("language"), F.col("content"), F.col("path")
    code = _code(lang) & (F.coalesce(F.length(text), F.lit(0)) > 0)
    b = F.lower(base_name(path))
    lines = F.split(text, "\n")
    defs = _count(text, "def ") + _count(text, "function ") + _count(text, "fn ")
    mean_len = F.size(stripped_lines(text)) / F.greatest(F.lit(1), defs)
    f = files.select(
        "repository",
        F.when(code, F.lit(1)).alias("code"),
        (F.when(code, syntax_valid(lang, text)).cast("double") if syntax else F.lit(None).cast("double")).alias("syntax"),
        b.startswith("readme").alias("readme"),
        F.when(code, has_docstring(lang, text).cast("double")).alias("doc"),
        is_test_path(path).cast("int").alias("test"),
        F.array_compact(F.array(*(F.when(b.startswith(m), F.lit(m)) for m in STRUCTURE_MARKERS))).alias("marks"),
        (path.contains("/src/") | path.contains("/lib/") | path.startswith("src/") | path.startswith("lib/")).alias("src"),
        F.when(code, comment_ratio(lang, text)).alias("comment"),
        F.when(code, F.when(mean_len <= 40, F.lit(1.0)).otherwise(F.greatest(F.lit(0.2), 40.0 / mean_len))).alias("health"),
        F.when(code, F.size(F.filter(lines, lambda x: F.length(x) <= 120))).alias("good"),
        F.when(code, F.size(lines)).alias("lines"),
        F.when(code, (F.col("size") < 200_000).cast("double")).alias("small"),
        F.nullif("hash", F.lit("")).alias("hash"),
    )
    g = f.groupBy("repository").agg(
        F.count("code").alias("code"),
        F.avg("syntax").alias("syntax"),
        F.bool_or("readme").alias("readme"),
        F.avg("doc").alias("doc"),
        F.sum("test").alias("tests"),
        *(F.max(F.array_contains("marks", m).cast("int")).alias(f"m{i}") for i, m in enumerate(STRUCTURE_MARKERS)),
        F.bool_or("src").alias("src"),
        F.avg("comment").alias("comment"),
        F.avg("health").alias("health"),
        F.sum("good").alias("good"),
        F.sum("lines").alias("lines"),
        F.avg("small").alias("small"),
        F.count("hash").alias("hashes"),
        F.count_distinct("hash").alias("distinct"),
    )
    have = sum((F.col(f"m{i}") for i in range(len(STRUCTURE_MARKERS))), F.lit(0))
    r = lambda c: F.round(c, 4)
    return g.select(
        "repository",
        r(F.coalesce("syntax", F.lit(0.7))).alias("syntax_validity"),
        r(F.when(F.col("readme"), 0.5).otherwise(0.0) + 0.5 * F.coalesce("doc", F.lit(0.0))).alias("documentation"),
        r(F.when(F.col("tests") > 0, F.least(F.lit(1.0), F.col("tests") / F.greatest(F.lit(1), F.col("code")) * 3.0)).otherwise(0.0)).alias("tests"),
        r(F.least(F.lit(1.0), have / 4.0 + F.when(F.col("src"), 0.2).otherwise(0.0))).alias("structure"),
        r(F.least(F.lit(1.0), F.coalesce("comment", F.lit(0.0)) / 0.20)).alias("comments"),
        r(F.coalesce("health", F.lit(0.7))).alias("complexity"),
        r(F.when(F.col("code") > 0, 0.5 * F.col("good") / F.greatest(F.lit(1), F.col("lines")) + 0.5 * F.col("small")).otherwise(0.5)).alias("maintainability"),
        r(F.when(F.col("hashes") > 0, F.col("distinct") / F.col("hashes")).otherwise(1.0)).alias("duplicate_ratio"),
    )


def quality_score(weights: dict[str, float] | None = None, prefix: str = "") -> Column:
    """0 to 100 from the eight signal columns."""
    w = weights or QUALITY_WEIGHTS
    total = sum((F.coalesce(F.col(prefix + k), F.lit(0.0)) * v for k, v in w.items()), F.lit(0.0))
    return F.round(100.0 * total / sum(w.values()), 2)


def file_quality(files: DataFrame) -> DataFrame:
    """``files(text, language, has_readme, has_license)`` with code signals, ``quality`` 0-100, and lines.

    Python's syntax tree gives the signals of Python files in one Arrow pass.
    """
    from siltstone.functions.python_code import SIGNAL_SCHEMA

    @F.pandas_udf(SIGNAL_SCHEMA)
    def tree(texts: pd.Series) -> pd.DataFrame:
        from siltstone.functions.python_code import signals

        return pd.DataFrame([signals(t) for t in texts], columns=[x.split()[0] for x in SIGNAL_SCHEMA.split(", ")])

    python = F.col("language") == "python"
    df = files.withColumn("s", tree(F.when(python, F.col("text"))))
    body = F.regexp_replace(F.col("text"), r"\r\n|[\r\x0b\x0c\x1c-\x1e\x85  ]", "\n")
    lines = F.split(F.regexp_replace(body, r"\n\z", ""), "\n")
    n = F.size(lines)
    chars = F.aggregate(lines, F.lit(0), lambda acc, x: acc + F.length(x))
    df = df.withColumn("n_lines", n).withColumn("comment_lines", F.size(F.filter(lines, lambda x: x.rlike(r"(?U)^\s*#"))))
    mean, long = chars / n, F.size(F.filter(lines, lambda x: F.length(x) > 120))
    readable = F.greatest(F.lit(0.0), 100 - F.when(mean > 100, F.least(F.lit(40.0), (mean - 100) * 0.5)).otherwise(0.0) - F.least(F.lit(30.0), long / n * 100))
    comments = F.least(F.lit(100.0), F.col("comment_lines") / n * 500)
    typed = F.when(F.col("s.total_args") > 0, F.col("s.typed_args") / F.col("s.total_args") * 100).otherwise(0.0)
    per_function = F.col("s.branches") / F.greatest(F.lit(1), F.col("s.functions"))
    score = (
        0.22 * readable
        + 0.18 * F.when(python, F.greatest(F.lit(0.0), 100 - F.abs(per_function - 3) * 12)).otherwise(70.0)
        + 0.12 * comments
        + 0.15 * F.when(python, typed).otherwise(50.0)
        + 0.13 * F.when(python & F.col("s.has_tests"), 100.0).otherwise(0.0)
        + 0.10 * F.when(F.col("has_readme"), 100.0).otherwise(0.0)
        + 0.10 * F.when(F.col("has_license"), 100.0).otherwise(0.0)
    )
    return df.withColumn("quality", F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))).cast("int")).withColumn("imports", F.slice("s.imports", 1, 32))


def complexity(n_tokens: Column, s: str = "s.", imports: str = "imports") -> Column:
    c = lambda k: F.coalesce(F.col(s + k), F.lit(0))
    return 1.6 * c("ast_depth") + 0.8 * F.coalesce(F.col(s + "cyclomatic"), F.lit(1)) + 0.5 * F.coalesce(F.size(imports), F.lit(0)) + 2.0 * c("classes") + 1.2 * c("async") + c("functions") + n_tokens / 600.0


def difficulty(score: Column) -> Column:
    return F.when(score < 8, F.lit("easy")).when(score < 22, F.lit("medium")).otherwise(F.lit("hard"))


def difficulty_rank(d: Column) -> Column:
    return F.when(d == "easy", 0).when(d == "hard", 2).otherwise(1)
