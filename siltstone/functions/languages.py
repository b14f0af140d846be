"""Language of a file by its name, extension and first bytes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by extension and by file name.
EXTENSIONS = {
    ".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript",
    ".tsx": "typescript", ".rs": "rust", ".go": "go", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp", ".h": "cpp", ".c": "cpp",
    ".java": "java", ".sh": "bash", ".bash": "bash", ".sql": "sql", ".html": "html", ".htm": "html", ".css": "css", ".scss": "css", ".sass": "css",
    ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".md": "markdown", ".markdown": "markdown",
}
NAMES = {"dockerfile": "dockerfile", "makefile": "bash", "pkgbuild": "bash", ".bashrc": "bash", ".zshrc": "bash"}
DATASET_EXTENSIONS = {
    ".py": "python", ".md": "markdown", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".sh": "bash", ".bash": "bash", ".txt": "text",
    ".cfg": "ini", ".ini": "ini",
}
PRIORITY = ("python", "javascript", "typescript", "rust", "go", "cpp", "java", "bash", "sql", "html", "css", "json", "yaml", "dockerfile", "markdown")


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for x in chain.from_iterable(table.items())))[key]


def detect(path: Column, content: Column | None = None) -> Column:
    base = F.lower(F.substring_index(path, "/", -1))
    ext = F.regexp_extract(base, r"(\.[^.]*)$", 1)
    found = F.coalesce(_lookup(NAMES, base), F.when(base.startswith("dockerfile"), F.lit("dockerfile")), _lookup(EXTENSIONS, ext))
    if content is not None:
        head = F.ltrim(F.substring(content, 1, 200))
        opening = F.substring(head, 1, 40)
        found = F.coalesce(found, F.when(head.startswith("#!") & (opening.contains("bash") | opening.contains("/sh")), F.lit("bash")))
    return F.coalesce(found, F.lit("unknown"))


def detect_dataset(path: Column, text: Column) -> Column:
    """As :func:`detect`, for the dataset builder: JSON must parse, else it is text."""
    base = F.lower(F.substring_index(path, "/", -1))
    ext = F.regexp_extract(base, r"[^.](\.[^.]*)$", 1)
    by_ext = _lookup(DATASET_EXTENSIONS, ext)
    head = F.substring(F.regexp_replace(text, r"^(?U)\s+", ""), 1, 200)
    script = head.startswith("#!")
    return (
        F.when((base == "dockerfile") | base.endswith(".dockerfile"), F.lit("dockerfile"))
        .when(by_ext == "json", F.when(F.try_parse_json(text).isNotNull(), F.lit("json")).otherwise(F.lit("text")))
        .when(by_ext.isNotNull(), by_ext)
        .when(script & head.contains("python"), F.lit("python"))
        .when(script & (head.contains("bash") | head.contains("/sh")), F.lit("bash"))
        .when(F.upper(head).startswith("FROM ") & text.contains("\n"), F.lit("dockerfile"))
        .otherwise(F.lit("unknown"))
    )


def annotate(language: Column, path: Column, content: Column | None = None) -> Column:
    return F.when(F.coalesce(language, F.lit("")).isin("", "unknown"), detect(path, content)).otherwise(language)


def is_priority(language: Column) -> Column:
    return language.isin(*PRIORITY)
