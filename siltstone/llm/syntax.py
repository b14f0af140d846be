"""Problem 3: source files that do not parse in their language.

Each text becomes a stream of token classes of its language (comments and the inside of strings are
one token, so markers and brackets in them never count), and a memoised parser with derivatives
reads the stream: an empty derivative names the exact failing token, an end expression that does not
accept the empty text names a truncation. Python and JSON files that the parser turns down are then
put to the exact check of their language, which settles grammar the parser does not know.

NULL texts and languages without a grammar (markdown, css, text, unknown) are never cases; an empty
text is valid wherever the language lets it be (not in JSON or Go). Texts are read whole.
"""

from __future__ import annotations

import json
import sys
import warnings

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import canonical_language, canonical_repository
from siltstone.llm.grammars import language
from siltstone.session import spread

CHECKED = ("python", "javascript", "typescript", "go", "rust", "java", "cpp", "bash", "sql", "json", "yaml")


#: Depth of derivatives, which grows with the open ends that a text chains (frames of Python, not of C).
RECURSION = 1_000_000


def _exactly_valid(text: str, lang: str) -> bool:
    try:
        if lang == "python":
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                compile(text, "file", "exec", dont_inherit=True)
            return True
        if lang == "json":
            json.loads(text)
            return True
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return False


def check_syntax(text: str | None, lang: str | None) -> tuple[bool, str | None, int | None]:
    """``(valid, failure, token)``: failure is ``token`` or ``truncated``; token is the failing index."""
    if text is None or lang not in CHECKED:
        return True, None, None
    text = text.removeprefix("﻿")
    if sys.getrecursionlimit() < RECURSION:
        sys.setrecursionlimit(RECURSION)
    how, at = language(lang).check(text)
    if how == "ok" or _exactly_valid(text, lang):
        return True, None, None
    return False, "truncated" if how == "end" else "token", at


def syntax_failures(records: DataFrame) -> DataFrame:
    """``ord, repository, lang, failure, token`` of every record that does not parse."""

    @F.pandas_udf("valid boolean, failure string, token int")
    def check(texts: pd.Series, langs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([check_syntax(t, g) for t, g in zip(texts, langs, strict=True)], columns=["valid", "failure", "token"]).astype({"token": "Int32"})

    r = _with_language(records).where(F.col("lang").isin(*CHECKED) & F.col("text").isNotNull())
    r = spread(r.select("ord", "repo", "lang", "text")).select("ord", "repo", "lang", check("text", "lang").alias("c"))
    return r.where("NOT c.valid").select("ord", canonical_repository(F.col("repo")).alias("repository"), "lang", "c.failure", "c.token")


def _with_language(records: DataFrame) -> DataFrame:
    lang = canonical_language(F.col("language"), F.col("path"))
    return records.select("ord", "repo", "text", lang.alias("lang"))


def syntax_rates(records: DataFrame) -> DataFrame:
    """``repository, lang, files, invalid, rate`` over the records whose language is checked."""
    bad = syntax_failures(records).groupBy("repository", "lang").agg(F.count(F.lit(1)).alias("invalid"))
    every = (
        _with_language(records)
        .where(F.col("lang").isin(*CHECKED) & F.col("text").isNotNull())
        .groupBy(canonical_repository(F.col("repo")).alias("repository"), "lang")
        .agg(F.count(F.lit(1)).alias("files"))
    )
    n = F.coalesce("invalid", F.lit(0))
    return every.join(bad, ["repository", "lang"], "left").select("repository", "lang", "files", n.alias("invalid"), F.round(n / F.col("files"), 6).alias("rate"))
