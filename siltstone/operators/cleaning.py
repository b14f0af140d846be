"""File-level cleaning as one ordered CASE: the first rule that holds names the drop reason."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Folders of third-party, build and cache files; lock files; generator notices.
VENDOR_SEGMENTS = (
    "node_modules", "vendor", "third_party", "thirdparty", "bower_components", "dist", "build", "out", "target", ".git", ".svn", ".hg", "venv", ".venv",
    "env", ".env", "__pycache__", "site-packages", ".mypy_cache", ".pytest_cache", ".cache", ".tox", ".next", ".nuxt", "coverage", ".gradle", ".idea",
    ".vscode", "Pods", "DerivedData", "bin", "obj",
)
LOCKFILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Pipfile.lock", "Cargo.lock", "go.sum", "Gemfile.lock", "composer.lock", "flake.lock", "bun.lockb")
GENERATED_MARKERS = ("do not edit", "@generated", "autogenerated", "auto-generated", "generated by", "this file was automatically generated", "code generated by", "@nocheck", "this file is generated")
DATASET_VENDOR_SEGMENTS = (
    "node_modules", "vendor", "third_party", "thirdparty", "dist", "build", ".git", ".svn", "venv", ".venv", "env", "__pycache__", "site-packages",
    ".mypy_cache", ".pytest_cache", "target", "bower_components", ".tox",
)
DATASET_GENERATED_MARKERS = GENERATED_MARKERS[:7]
ALLOWED_EXTENSIONS = (".py", ".md", ".json", ".yaml", ".yml", ".toml", ".sh", ".bash", ".txt", ".cfg", ".ini", ".dockerfile")

# Secrets: name -> pattern; group 1, where there is one, is what is kept before the secret.
SECRET_PATTERNS = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----",
    "aws_key": r"\bA(?:KIA|SIA)[0-9A-Z]{16}\b",
    "vendor_token": r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abpr]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})",
    "assignment": r"((?i:api[_-]?key|secret|token|passw(?:or)?d|pwd)[\"']?\s*[:=]\s*[\"'])[A-Za-z0-9_+/=.-]{12,}",
}


def segments(path: Column) -> Column:
    return F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda s: s != "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)


def is_vendor(path: Column, names=VENDOR_SEGMENTS) -> Column:
    return F.arrays_overlap(segments(path), F.array(*map(F.lit, names)))


def is_lockfile(path: Column) -> Column:
    return F.coalesce(F.try_element_at(segments(path), F.lit(-1)).isin(*LOCKFILES), F.lit(False))


def is_binary(content: Column) -> Column:
    """A NUL anywhere, or over 30 % of the first 4096 bytes outside printable ASCII and white space."""
    raw = content.cast("binary")
    latin = F.decode(F.substring(raw, 1, 4096), "ISO-8859-1")
    odd = F.length(F.regexp_replace(latin, r"[\x20-\x7E\n\r\t\f\x08]", ""))
    seen = F.least(F.octet_length(raw), F.lit(4096))
    return (seen > 0) & ((F.instr(F.decode(raw, "ISO-8859-1"), "\x00") > 0) | (odd / seen > 0.30))


def is_corrupted(content: Column) -> Column:
    return ~F.is_valid_utf8(content.cast("string"))


def is_minified(path: Column, text: Column, max_line: int = 1000) -> Column:
    longest = F.array_max(F.transform(F.split(text, "\n"), F.length))
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.lower(base_name(path)).contains(".min.") | ((longest > max_line) & ((newlines / F.greatest(F.length(text), F.lit(1)) < 0.01) | (longest > 4 * max_line)))


def is_generated(text: Column, markers=GENERATED_MARKERS, head: int = 2000) -> Column:
    low = F.lower(F.substring(text, 1, head))
    out = F.lit(False)
    for m in markers:
        out = out | low.contains(m)
    return out


def is_notebook(path: Column) -> Column:
    return F.lower(path).endswith(".ipynb")


def count_secrets(text: Column) -> Column:
    out = F.lit(0)
    for p in SECRET_PATTERNS.values():
        out = out + F.regexp_count(text, F.lit(p))
    return out


def redact_secrets(text: Column) -> Column:
    for name, p in SECRET_PATTERNS.items():
        text = F.regexp_replace(text, p, "$1REDACTED" if name == "assignment" else "REDACTED")
    return text


def strip_notebook(text: str) -> str:
    """Outputs emptied and execution counts removed; text that is no notebook stays as it is."""
    try:
        book = json.loads(text)
    except ValueError:
        return text
    if not isinstance(book, dict) or not isinstance(book.get("cells"), list):
        return text
    for cell in book["cells"]:
        if isinstance(cell, dict) and cell.get("cell_type") == "code":
            cell["outputs"], cell["execution_count"] = [], None
    return json.dumps(book, indent=1, ensure_ascii=False)


def _strip_udf():
    @F.pandas_udf("string")
    def strip(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else strip_notebook(t) for t in texts], dtype=object)

    return strip


def clean(files: DataFrame, *, max_bytes: int = 1 << 20, min_bytes: int = 16, max_line: int = 1000, strip_secrets: bool = True, drop_secret_files: bool = False, notebooks: bool = True) -> DataFrame:
    """``files(path, content)`` with ``reason``, the cleaned ``text``, ``secrets_redacted``, ``transformed``.

    Reasons in order: vendor, lockfile, too_large, binary, encoding, too_small, minified, generated,
    secret. Path and size come first, so content is looked at only where they do not settle it.
    """
    raw = F.col("content").cast("string")
    size = F.octet_length("content")
    # Python can't take text that is no UTF-8; such a file is dropped as encoding anyway.
    book = F.when(is_notebook(F.col("path")) & F.is_valid_utf8(raw), raw)
    text = F.coalesce(_strip_udf()(book), raw) if notebooks else raw
    df = files.withColumn("_text", text)
    t = F.col("_text")
    found = count_secrets(t)
    reason = (
        F.when(is_vendor(F.col("path")), F.lit("vendor"))
        .when(is_lockfile(F.col("path")), F.lit("lockfile"))
        .when(size > max_bytes, F.lit("too_large"))
        .when(is_binary(F.col("content")), F.lit("binary"))
        .when(is_corrupted(F.col("content")), F.lit("encoding"))
        .when(F.octet_length(t) < min_bytes, F.lit("too_small"))
        .when(is_minified(F.col("path"), t, max_line), F.lit("minified"))
        .when(is_generated(t), F.lit("generated"))
        .when(found > 0, F.lit("secret") if drop_secret_files else F.lit(""))
        .otherwise(F.lit(""))
    )
    df = df.withColumn("reason", F.when(F.col("content").isNull(), F.lit("encoding")).otherwise(reason)).withColumn(
        "secrets_redacted", F.when(F.col("reason") == "", found).otherwise(F.lit(0)) if strip_secrets else F.lit(0)
    )
    cleaned = F.when(F.col("secrets_redacted") > 0, redact_secrets(t)).otherwise(t)
    return df.withColumn("text", F.when(F.col("reason") == "", cleaned)).withColumn("transformed", (F.col("reason") == "") & ~F.col("text").eqNullSafe(raw)).drop("_text")


def dataset_clean(files: DataFrame, dedup: bool = True) -> DataFrame:
    """``files(ord, path, content)`` with ``reason``: vendor, binary, non_utf8, empty, generated, duplicate."""
    raw = F.col("content").cast("string")
    reason = (
        F.when(is_vendor(F.col("path"), DATASET_VENDOR_SEGMENTS), F.lit("vendor"))
        .when(is_binary(F.col("content")), F.lit("binary"))
        .when(is_corrupted(F.col("content")) | F.col("content").isNull(), F.lit("non_utf8"))
        .when(F.length(F.regexp_replace(raw, r"(?U)\s", "")) == 0, F.lit("empty"))
        .when(is_generated(raw, DATASET_GENERATED_MARKERS), F.lit("generated"))
        .otherwise(F.lit(""))
    )
    df = files.withColumn("reason", reason)
    if not dedup:
        return df
    df = df.withColumn("_h", F.when(F.col("reason") == "", F.sha2(F.col("content").cast("binary"), 256)))
    first = df.where("_h IS NOT NULL").groupBy("_h").agg(F.min("ord").alias("_first"))
    df = df.join(first, "_h", "left")
    return df.withColumn("reason", F.when(F.col("_first") < F.col("ord"), F.lit("duplicate")).otherwise(F.col("reason"))).drop("_h", "_first")


def validate(files: DataFrame, *, min_bytes: int = 8, max_bytes: int = 1 << 20, extensions=ALLOWED_EXTENSIONS) -> DataFrame:
    """``files(path, text, language)`` with ``reason``: size, extension, language, syntax."""

    @F.pandas_udf("boolean")
    def compiles(texts: pd.Series) -> pd.Series:
        from siltstone.functions.python_code import compiles as ok

        return pd.Series([t is not None and ok(t) for t in texts])

    name = F.lower(base_name(F.col("path")))
    ext = F.regexp_extract(name, r"[^.](\.[^.]+)$", 1)
    size = F.octet_length("text")
    plain = (
        F.when((size < min_bytes) | (size > max_bytes) | size.isNull(), F.lit("size"))
        .when((ext != "") & ~ext.isin(*extensions), F.lit("extension"))
        .when(F.col("language") == "unknown", F.lit("language"))
        .otherwise(F.lit(""))
    )
    df = files.withColumn("reason", plain)
    python = (F.col("reason") == "") & (F.col("language") == "python")
    valid = F.when(python, compiles(F.when(python, F.col("text")))).otherwise(F.lit(True))
    return df.withColumn("reason", F.when(valid, F.col("reason")).otherwise(F.lit("syntax")))


def size_filter(size: Column, floor: int, cap: int) -> Column:
    return F.when(size > cap, F.lit("too_large")).when(size < floor, F.lit("too_small")).otherwise(F.lit(""))


def first_text_files(files: DataFrame, limit: int = 50) -> DataFrame:
    """The first ``limit`` decodable files of each repository by ``ord`` (what a licence probe reads)."""
    w = Window.partitionBy("repository").orderBy("ord")
    # Ranked by keys alone; a repository may hold any share of the rows, whose contents stay where they are.
    readable = files.where(F.col("content").isNotNull() & ~is_corrupted(F.col("content"))).select("repository", "ord")
    first = readable.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).select("ord")
    return files.join(first, "ord", "left_semi")
