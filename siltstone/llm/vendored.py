"""Problem 4: generated, minified or vendored source files and data blobs saved as code.

Copies are found by winnowing: every ``GRAM`` normalised tokens in row are hashed, and the smallest
hash of each ``WINDOW`` in row is kept as a fingerprint (a text too short for one window is one
fingerprint as a whole). A source file most of whose fingerprints recur in repositories of many
unrelated owners is a copy. Owners are counted over all source files, marked or not, exactly: no
sketch, no cap, hot fingerprints salted.

Beside it stand the signs that a single file carries (``marked``, a query of its own): folders of
third parties, lock files, names that generators give, the notice of a generator or of an upstream
at the head of the file, the shape of minified text, and literal data that makes up most of a file.

NULL and empty texts can still be flagged by their path; NULL paths by their text. Prose (markdown,
plain text, licence files) is no source and a text of fewer than ``GRAM`` tokens has no fingerprint;
both carry signs only. Notices below the head, or inside strings, are none. Repeated rows are
flagged alike; they count for one owner.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import canonical_language, canonical_repository
from siltstone.llm.words import hash_words, run_hashes, words
from siltstone.session import materialize, spread

GRAM, WINDOW = 20, 16
MIN_OWNERS, MIN_SHARE = 6, 0.8
SALTS = 16
PROSE = ("markdown", "text")
CODE = frozenset("python javascript typescript go rust java cpp bash sql css".split())

# Folders of third-party code, lock files, names that generators give.
_FOLDER = re.compile(r"(?:^|/)(?:vendor|_vendor|third[_-]party|thirdparty|3rdparty|node_modules|bower_components|site-packages|jspm_packages|external_libs|deps/[^/]*-\d[\w.]*)/", re.I)
_LOCK = re.compile(r"(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.ya?ml|poetry\.lock|pipfile\.lock|cargo\.lock|composer\.lock|gemfile\.lock|go\.sum|uv\.lock|bun\.lockb?|flake\.lock|mix\.lock|pubspec\.lock)$", re.I)
_MADE_NAME = re.compile(r"(?:_pb2(?:_grpc)?\.pyi?|_pb\.(?:js|ts|d\.ts)|\.pb\.(?:go|cc|h|cpp|rs|swift)|OuterClass\.java|\.generated\.\w+|\.gen\.\w+|_gen\.\w+|\.g\.(?:dart|cs)|\.designer\.cs|_generated\.\w+)$")
_SMALL_NAME = re.compile(r"\.(?:min|bundle|chunk)\.(?:js|css|mjs|cjs)$", re.I)
_MADE_NOTICE = re.compile(
    r"(?i)^(?:code generated by .{1,80} do not edit|auto-?generated file\b|<auto-?generated\b|this file (?:was|is) (?:made by \S+-gen\b|(?:auto(?:matically)?[- ]?)?generated\b)|machine[- ]written by\b"
    r"|@generated\b|automatically generated (?:from|by)\b|auto-?generated (?:from|by)\b|generated (?:by|from|with) \S+.{0,60}(?:do not|don't|not) (?:edit|modify)|do not edit\b.{0,40}(?:generated|this file)|this is a generated file)"
)
_COPY_NOTICE = re.compile(r"(?i)^(?:vendored (?:from|copy of)\b|bundled third[- ]party copy\b|third[- ]party copy of\b|(?:copied|imported|taken) verbatim from\b|upstream copy of\b|[\w@./-]+ v?\d+\.\d+[\w.+-]*\s*(?:[|·*-]\s*)?(?:\(c\)|©|copyright|licen[cs]ed?\b)|[^\n]*\bfetched from (?:the )?\S+ project\b)")
_LICENSE_NAME = re.compile(r"(?:^|/)(?:(?:un)?licen[cs]e|copying|notice|copyright)(?:[.-][^/]*)?$", re.I)
_COMMENT = re.compile(r"^\s*(?:#|//|/\*|\*|--|;|<!--|\"\"\"|''')")
_DATA = re.compile(r"0x[0-9A-Fa-f]{1,16}\b|(?<![\w.])-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?(?![\w.])|[\"'][A-Za-z0-9+/=\\x]{40,}[\"']")
_SPACE = re.compile(r"\s+")
_BLOCKS = {"/*": "*/", "<!--": "-->"}


def head(text: str) -> tuple[list[str], int]:
    """The comment lines in front of the first line of code, and where that line starts."""
    close, at, said = None, 0, []
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line, here = text[at:end], at
        at = end + 1
        if not line.strip() or line.startswith(("#!", "<<<<<<<", "=======", ">>>>>>>")):
            continue
        if close is None and not _COMMENT.match(line):
            if line.startswith(("package ", "'use strict'", '"use strict"', "<?")):
                continue
            return said, here
        said.append(line)
        # Whether a block stays open at the end of the line: blocks may close and open again on it.
        to, start = 0, line.lstrip()
        if close is None:
            close = next((c for o, c in _BLOCKS.items() if start.startswith(o)), None)
            to = len(line) - len(start) + 2
        while close and (stop := line.find(close, to)) >= 0:
            rest = line[stop + len(close) :].lstrip()
            to = len(line) - len(rest) + 2
            close = next((c for o, c in _BLOCKS.items() if rest.startswith(o)), None)
    return said, len(text)


def head_notice(text: str) -> str | None:
    """``generated`` or ``vendored`` if a comment line in front of the first line of code says so."""
    for line in head(text)[0]:
        said = re.sub(r"^[\s#/*;!\"'-]+", "", line).strip()
        if _MADE_NOTICE.match(said):
            return "generated"
        if _COPY_NOTICE.match(said):
            return "vendored"
    return None


def signs(path: str | None, text: str | None, language: str | None) -> str | None:
    """The reason that a single file's path or text gives, or None."""
    p = (path or "").replace("\\", "/")
    if _LOCK.search(p):
        return "generated"
    if _FOLDER.search(p):
        return "vendored"
    if _MADE_NAME.search(p):
        return "generated"
    if _SMALL_NAME.search(p):
        return "minified"
    if not text:
        return None
    if (n := head_notice(text)) is not None:
        return n
    if language in CODE:
        body = len(_SPACE.sub("", text))
        if body < 120:
            return None
        lines = text.count("\n") + 1
        if language in ("javascript", "typescript", "css"):
            code = re.sub(r"/\*[\s\S]*?\*/", "", text)
            rows = [x for x in code.split("\n") if x.strip()]
            if rows and max(map(len, rows)) > 300 and sum(map(len, rows)) / len(rows) > 90 and (len(code) - len(_SPACE.sub("", code))) / max(1, len(code)) < 0.12:
                return "minified"
        if lines >= 2 and (text.count("0x") > 20 or sum(map(text.count, "0123456789")) > 0.12 * body):
            data = sum(m.end() - m.start() for m in _DATA.finditer(text))
            marks = text.count(",") + text.count("[") + text.count("]") + text.count("{") + text.count("}") + text.count("+")
            if (data + marks) >= 0.7 * body and data >= 0.45 * body:
                return "data"
    return None


def winnow(text: str | None) -> np.ndarray:
    """Fingerprints of the text's tokens: the least hash of each window of grams.

    The comment at the head is left out, as licence headers recur everywhere. ``GRAM`` is the length
    under which runs of tokens are noise. A text that fills no window is one fingerprint as a whole;
    one of fewer than ``GRAM`` tokens has none.
    """
    w = hash_words(words(text[head(text)[1] :]) if text else [])
    h = run_hashes(w, GRAM)
    if len(h) < WINDOW:
        return run_hashes(w, len(w)) if len(h) else h
    view = np.lib.stride_tricks.sliding_window_view(h, WINDOW)
    return np.unique(view.min(axis=1))


def _source(path: str | None, language: str | None) -> bool:
    return language is not None and language not in PROSE and not _LICENSE_NAME.search((path or "").replace("\\", "/"))


def _scan(records: DataFrame) -> DataFrame:
    """``ord, owner, reason, f``: the signs and fingerprints of each file, in one pass over the texts."""

    @F.pandas_udf("reason string, f array<long>")
    def scan(paths: pd.Series, texts: pd.Series, langs: pd.Series) -> pd.DataFrame:
        rows = []
        for p, t, g in zip(paths, texts, langs, strict=True):
            rows.append((signs(p, t, g), winnow(t).view(np.int64) if _source(p, g) else []))
        return pd.DataFrame(rows, columns=["reason", "f"])

    lang = canonical_language(F.col("language"), F.col("path"))
    r = spread(records.select("ord", "repo", "path", "text", lang.alias("lang")))
    owner = F.xxhash64(F.substring_index(canonical_repository(F.col("repo")), "/", 1))
    return r.select("ord", owner.alias("owner"), scan("path", "text", "lang").alias("s")).select("ord", "owner", "s.reason", "s.f")


def _copies(files: DataFrame, min_owners: int, min_share: float) -> DataFrame:
    """``ord`` of the files of ``_scan`` most of whose fingerprints recur for many owners."""
    fps = files.select("owner", F.explode("f").alias("f"))
    # Equal pairs combine before the shuffle, so a hot fingerprint costs one row a task and owner.
    owners = fps.distinct().groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    recurring = materialize(owners.where(F.col("n") >= min_owners).select("f"), "recurring")
    salted = recurring.select("f", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    parts = files.select("ord", F.size("f").alias("n"), F.pmod(F.hash("ord"), F.lit(SALTS)).alias("salt"), F.explode("f").alias("f"))
    hits = parts.join(salted, ["f", "salt"]).groupBy("ord").agg(F.count(F.lit(1)).alias("hit"), F.max("n").alias("n"))
    return hits.where(F.col("hit") >= min_share * F.col("n")).select("ord")


def copied_files(records: DataFrame, *, min_owners: int = MIN_OWNERS, min_share: float = MIN_SHARE) -> DataFrame:
    """``ord``: files that are copies by their recurring fingerprints alone, whatever their signs."""
    return _copies(materialize(_scan(records), "fingerprints"), min_owners, min_share)


def marked_files(records: DataFrame) -> DataFrame:
    """``ord, reason``: files that carry a sign themselves."""
    return _scan(records).where("reason IS NOT NULL").select("ord", "reason")


def not_handwritten(records: DataFrame, *, min_owners: int = MIN_OWNERS, min_share: float = MIN_SHARE) -> DataFrame:
    """``ord, reason``: files that were not written by hand (generated, vendored, minified, data)."""
    files = materialize(_scan(records), "fingerprints")
    copies = _copies(files, min_owners, min_share).withColumn("copied", F.lit(True))
    found = files.select("ord", "reason").join(copies, "ord", "left").where("reason IS NOT NULL OR copied")
    return found.select("ord", F.coalesce("reason", F.lit("vendored")).alias("reason"))


def handwritten_report(records: DataFrame) -> DataFrame:
    """``reason, files, bytes``: what is left out, and the hand-written rest (``handwritten``)."""
    flagged = not_handwritten(records)
    r = records.select("ord", F.octet_length("text").alias("b")).join(flagged, "ord", "left")
    return r.groupBy(F.coalesce("reason", F.lit("handwritten")).alias("reason")).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"))
