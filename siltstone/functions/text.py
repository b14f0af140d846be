"""Column expressions shared by the operators: repositories, splits, languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language of a file extension.
EXTENSION_LANGUAGE = {
    "py": "python", "js": "javascript", "ts": "typescript", "go": "go", "rs": "rust", "java": "java",
    "cpp": "cpp", "cc": "cpp", "sh": "bash", "sql": "sql", "json": "json", "yaml": "yaml",
    "md": "markdown", "css": "css",
}


def canonical_repository(c: Column) -> Column:
    """``owner/name``: lower case, no blanks around, no host prefix, ``.git`` suffix or last slash."""
    c = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    c = F.regexp_replace(c, r"^[a-z][a-z0-9+.-]*://[^/]*/", "")
    return F.regexp_replace(c, r"(?:\.git|/|\s)+$", "")


def canonical_split(c: Column) -> Column:
    """Lower-cased, trimmed split; ``val``/``valid`` mean validation; empty is NULL."""
    c = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(c.isin("val", "valid"), F.lit("validation")).when(c == "", F.lit(None)).otherwise(c)


def canonical_language(language: Column, path: Column) -> Column:
    """Stated language, else the one of the path's extension, else NULL."""
    low = F.lower(F.trim(language))
    stated = F.when(low.isin("", "unknown"), F.lit(None)).otherwise(low)
    name = F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    guess = None
    for e, lang in EXTENSION_LANGUAGE.items():
        guess = F.when(ext == e, F.lit(lang)) if guess is None else guess.when(ext == e, F.lit(lang))
    return F.coalesce(stated, guess)
