"""Problem 6: the licence of each file and repository.

Notice templates with optional (``[...]``), replaceable (``<<...>>``) and repeated sections are
compiled into backtracking grammars (regular expressions matched completely). A file's licence comes
from its licence text, a readme's licence section, the licence field of a manifest, an SPDX tag, or
a notice or ``__license__`` in the comment at its head, whose text must match a template as a whole;
remarks elsewhere state nothing. The standard texts and notices of the common public licences are
templates over words, so wrapping, quotes and comment marks do not count. Names of licences are
parsed by grammars as well: family, clauses, version and "only" or "or later" in any of their common
spellings, and SPDX expressions with AND, OR and WITH. A file may state several licences; the result
is then an expression.

A repository's licences are those stated in its records, by its ``license`` and by its staged
hints; more than one is a CONFLICT, none is UNKNOWN.

NULL and empty texts, and terms that name no licence, state none. Several spellings of a repository
are one. Repeated rows change nothing. Texts of any length: the comment at the head is read to its
end, a licence file whole. ``p6_found`` keeps to the identifiers that it is asked for.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import canonical_repository
from siltstone.session import spread

# SPDX identifiers and the spellings of their names, as templates.
NAMES: tuple[tuple[str, str], ...] = (
    ("MIT", "[the ]mit[ license][ terms]|[the ]expat license"),
    ("Apache-2.0", "[the ]apache[ software][ license][ version] 2[.0]|version 2[.0] of the apache license|asl 2.0"),
    ("BSD-3-Clause", "[the ][new |revised |modified ]bsd[ license] (3|three)[ ]clause[s][ license]|[the ](3|three) clause[s] bsd[ license]|[the ](new|revised|modified) bsd[ license][ bsd 3 clause]"),
    ("BSD-2-Clause", "[the ][simplified |freebsd ]bsd[ license] (2|two)[ ]clause[s][ license]|[the ](2|two) clause[s] bsd[ license]|[the ](simplified|freebsd) bsd[ license][ bsd 2 clause]"),
    ("ISC", "[the ]isc[ license][ terms]"),
    ("MPL-2.0", "[the ]mpl[ version][ ]2.0|[the ]mozilla public license[ version][ ]2.0|version 2[.0] of the mozilla public license"),
    ("AGPL-3.0-only", "[the ][gnu ](agpl|affero general public license)[ license][ version][ ]3[.0][ only]"),
    ("LGPL-2.1-or-later", "[the ][gnu ](lgpl|lesser general public license)[ license][ version][ ]2.1( or later|+| or any later version| or newer)"),
    ("GPL-3.0-or-later", "[the ][gnu ](gpl|general public license)[ license][ version][ ]3[.0]( or later|+| or any later version| or newer)"),
    ("GPL-3.0-only", "[the ][gnu ](gpl|general public license)[ license][ version][ ]3[.0][ only]"),
    ("GPL-2.0-only", "[the ][gnu ](gpl|general public license)[ license][ version][ ]2[.0][ only]"),
    ("Unlicense", "[the ]unlicense[ license][ public domain]"),
)
# The identifiers of p6_found, and further SPDX identifiers that stand for themselves.
ASKED = tuple(spdx for spdx, _ in NAMES)
FURTHER = (
    "0BSD", "AFL-3.0", "AGPL-3.0-or-later", "Apache-1.1", "Artistic-2.0", "BSD-3-Clause-Clear", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "ECL-2.0", "EPL-2.0", "EUPL-1.2",
    "GPL-2.0-or-later", "LGPL-2.0-or-later", "LGPL-2.1-only", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT-0", "MPL-1.1", "MS-PL", "NCSA", "OFL-1.1", "PostgreSQL", "PSF-2.0", "Python-2.0", "Unicode-3.0", "WTFPL", "Zlib",
)
# Old identifiers without "only" (fixed values).
_PLAIN_GNU = re.compile(r"(?:A|L)?GPL-\d\.\d")
SILENT = frozenset({"", "unknown", "noassertion", "none", "null", "n/a"})

# Templates of statements; <<l>> is the licence's name, <<x>> any words.
COPYRIGHT = "[[Copyright ][(c) ]<<y>> <<x>>[.] ]"
NOTICES = (
    COPYRIGHT + "SPDX-License-Identifier: <<l>>",
    COPYRIGHT + "[@]License: <<l>>[.]",
    COPYRIGHT + "This (file|code|work|program|software|module|project) (may be used and passed on|is (released|distributed|licensed|made available|published|offered)) under [the terms of ]<<l>>[. <<x>>][.]",
    COPYRIGHT + "You are free to use, alter and share this work if you keep to <<l>>[. <<x>>][.]",
    "[<<x>> ](Licensed|Released|Distributed|Published) under [the terms of ]<<l>>[. <<x>>][.]",
    COPYRIGHT + "You get this project under <<l>>[. <<x>>][.]",
    COPYRIGHT + "<<l>>; see the notice in <<x>>[.]",
)
LICENSE_TEXTS = (
    "<<l>> [Copyright ][(c) ]<<y>> <<x>> Anybody who gets a copy of this work may use it, <<x>>",
    COPYRIGHT + "This whole repository is offered to you under <<l>> and under no other terms. <<x>>",
    "<<l>> 1. You may <<x>>",
    "<<l>>[.]",
) + NOTICES
README_LINES = ("License: <<l>>[ · <<x>>]", "License: <<l>>[ | <<x>>]", "License: <<l>>[ - <<x>>]", "(Licensed|Released|Distributed) under <<l>>[.]")


# Standard texts and notices over words in lower case: ``[...]`` optional, ``(a|b)`` choice, ``<<x>>`` up to 40 words of any kind.
_GRANT = "permission is hereby granted free of charge to any person [or organization] obtaining a copy of (this software|this [<<x>> ]software|the software|<<x>>)"
_BSD = "redistribution and use [of this software ][of <<x>> ]in source and binary forms with or without modification are permitted provided that the following conditions are met <<x>>redistributions of source code must retain the (above|original|<<x>>) copyright notice <<x>>"
STANDARD = (
    ("MIT", _GRANT + " <<x>>to deal in the (software|materials|<<x>>) without restriction <<x>>to use copy modify merge publish distribute sublicense and or sell copies <<x>>the above copyright notice"),
    ("MIT", "permission is hereby granted free of charge <<x>>to deal in the <<x>>without restriction [<<x>>]subject to the following conditions the above copyright notice and this permission notice"),
    ("MIT-0", _GRANT + " <<x>>to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is"),
    ("BSD-3-Clause", _BSD + "<<x>><<x>>(neither the names? of|the names? of|neither <<x>>nor the names) <<x>>(may|be) (not be |)used to endorse or promote products"),
    ("BSD-2-Clause", _BSD + "redistributions in binary form must reproduce the above copyright notice <<x>>(this software is provided|the software is provided)"),
    ("ISC", "permission to use copy modify and (or )distribute this software (and its documentation |)for any purpose with or without fee is hereby granted [free of charge ]provided that the (above )copyright notice"),
    ("0BSD", "permission to use copy modify and (or )distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("Apache-2.0", "apache license version 2 0 january 2004 <<x>>terms and conditions for use reproduction and distribution 1 definitions"),
    ("Apache-2.0", "licensed under the apache license version 2 0 (the license |)<<x>>you may not use (this|these) (file|files|work|software|project|<<x>>) except in compliance with the license <<x>>you may obtain a copy"),
    ("MPL-2.0", "mozilla public license version 2 0 [<<x>>]1 definitions"),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file"),
    ("GPL-3.0-only", "gnu general public license version 3 29 june 2007 <<x>>preamble"),
    ("GPL-2.0-only", "gnu general public license version 2 june 1991 <<x>>preamble"),
    ("AGPL-3.0-only", "gnu affero general public license version 3 19 november 2007 <<x>>preamble"),
    ("LGPL-2.1-or-later", "gnu lesser general public license version 2 1 february 1999 <<x>>preamble"),
    ("LGPL-3.0-only", "gnu lesser general public license version 3 29 june 2007 <<x>>this version of the gnu lesser general public license"),
    ("Unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("Zlib", "this software is provided as is without any express or implied warranty <<x>><<x>>permission is granted to anyone to use this software for any purpose <<x>><<x>>altered source versions must be plainly marked"),
    ("BSL-1.0", "boost software license version 1 0 [<<x>>]permission is hereby granted free of charge"),
    ("BSL-1.0", "distributed under the boost software license version 1 0"),
    ("CC0-1.0", "cc0 1 0 universal <<x>>"),
    ("Python-2.0", "python software foundation license version 2 <<x>>this license agreement is between the python software foundation"),
    ("OFL-1.1", "sil open font license version 1 1 <<x>>preamble"),
    ("EPL-2.0", "eclipse public license v 2 0 <<x>>1 definitions"),
    ("Artistic-2.0", "artistic license 2 0 <<x>>preamble"),
    ("Unicode-3.0", "unicode license v3 <<x>>copyright and permission notice"),
    ("NCSA", "permission is hereby granted free of charge <<x>>deal with the software without restriction <<x>>redistributions of source code must retain"),
    ("PostgreSQL", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
)
# Words without which no standard text can match; the GNU notices are put together by rule below.
_STANDARD_HINT = re.compile(r"(?i)permission\s|redistributi|apache\s+licen|mozilla\s|general\s+public|\bmpl\b|unencumbered|boost\s+software|cc0|software\s+foundation|open\s+font|eclipse\s+public|artistic\s+licen|unicode\s+licen|without\s+any\s+express")


def _word_template(t: str) -> re.Pattern:
    out = []
    for part in re.split(r"(<<x>>|[\[\]()|?]| +)", t):
        if part == "<<x>>":
            out.append(r"(?:\w+ ){0,40}?")
        elif part == "[":
            out.append("(?:")
        elif part == "]":
            out.append(")?")
        elif part == "(":
            out.append("(?:")
        elif part and part[0] == " ":
            out.append(" ?" if out and out[-1].endswith((")?", "}?", ")")) else " ")
        elif part:
            out.append(part)
    return re.compile(r"\b" + "".join(out).replace(" ?(?:\\w+ )", "(?: |\\b)(?:\\w+ )"))


def _gnu_notices():
    """The notices of the GNU licences: family and version as parameters, "or later" as an optional section."""
    for family, words, versions in (("GPL", "general public license", "123"), ("LGPL", "(?:lesser|library) general public license", ("2", "2 1", "3")), ("AGPL", "affero general public license", "3")):
        for v in versions:
            spdx = f"{family}-{v.replace(' ', '.')}{'' if ' ' in v else '.0'}"
            named = rf"under the terms (?:and conditions )?of the gnu {words} (?:(?:gpl|lgpl|agpl|the license) )?(?:version {v}(?: 0)? )?(?:\w+ )?as published by (?:the )?free software foundation (?:inc )?"
            yield spdx, re.compile(rf"{named}(?P<only>(?:either |in |at )?(?:version {v}(?: 0)?\b(?! \d\b))?(?: of the license)?)(?P<later> ?(?:or )?(?:at your option )?(?:any )?(?:later|newer) version| or later)?"), rf"version {v}"


_STANDARD = [(spdx, _word_template(t)) for spdx, t in STANDARD]
_GNU_NOTICES = list(_gnu_notices())
_WORD = re.compile(r"[^\W_]+")


def standard_licenses(text: str) -> list[str]:
    """The licences whose standard text or notice stands in ``text``, in order of place."""
    if not _STANDARD_HINT.search(text):
        return []
    low = " ".join(_WORD.findall(text.lower())) + " "
    found: dict[str, int] = {}
    for spdx, p in _STANDARD:
        if spdx not in found and (m := p.search(low)):
            found[spdx] = m.start()
    for spdx, p, version in _GNU_NOTICES:
        for m in p.finditer(low):
            if version + " " in m.group() + " " and not re.search(rf"{version} \d\b(?<! 0)", m.group()):
                name = spdx + ("-or-later" if m.group("later") else "-only")
                found.setdefault(name, m.start())
    if "BSD-3-Clause" in found:
        found.pop("BSD-2-Clause", None)
    if "MIT-0" in found or "NCSA" in found:
        found.pop("MIT", None)
    for family in ("GPL", "LGPL", "AGPL"):  # the appendix of a licence text holds its own notice
        full = [x for x in found if x.startswith(family + "-")]
        if len(full) > 1:
            first = min(full, key=found.__getitem__)
            for x in full:
                if x != first and x.split("-")[1] == first.split("-")[1]:
                    del found[x]
    if len(low) > 20_000 and (gnu := [x for x in found if x.startswith(("LGPL-2.1", "AGPL"))]):
        for x in [x for x in found if x.startswith("GPL-") and found[x] > found[gnu[0]]]:
            del found[x]
    return sorted(found, key=found.__getitem__)


_TOKEN = re.compile(r"\(|\)|[^\s()]+")


def spdx_expression(text: str) -> str | None:
    """A valid SPDX expression in plain form, or None: identifiers with AND, OR, WITH and brackets."""
    toks = _TOKEN.findall(text)
    at = 0

    def term():
        nonlocal at
        if at < len(toks) and toks[at] == "(":
            at += 1
            inner = whole()
            if inner is None or at >= len(toks) or toks[at] != ")":
                return None
            at += 1
            return inner if inner[0] == 1 else (0, f"({inner[1]})")
        if at >= len(toks) or toks[at].upper() in ("AND", "OR", "WITH", ")"):
            return None
        name = identifier(toks[at])
        at += 1
        if name and at + 1 < len(toks) and toks[at].upper() == "WITH":
            name += f" WITH {toks[at + 1]}"
            at += 2
        return (1, name) if name else None

    def whole():
        nonlocal at
        left = term()
        if left is None:
            return None
        simple, out = left
        while at < len(toks) and toks[at].upper() in ("AND", "OR"):
            op = toks[at].upper()
            at += 1
            right = term()
            if right is None:
                return None
            simple, out = 0, f"{out} {op} {right[1]}"
        return simple, out

    got = whole()
    return got[1] if got and at == len(toks) else None


_IDS = {x.lower(): x for x in (*ASKED, *FURTHER)}


def identifier(name: str) -> str | None:
    """An SPDX identifier in its own spelling, old forms (``GPL-2.0``, ``GPL-2.0+``) in the new one."""
    low = name.lower()
    if low in _IDS:
        return _IDS[low]
    plus = low.endswith("+")
    if _PLAIN_GNU.fullmatch(low.rstrip("+").upper()):
        return _IDS.get(low.rstrip("+") + ("-or-later" if plus else "-only"))
    return None


def compile_template(template: str) -> re.Pattern:
    """A template as a backtracking grammar: ``[...]`` optional, ``(a|b)`` choice, ``<<v>>`` replaceable."""
    out, names = [], 0
    for part in re.split(r"(<<\w>>|[\[\]()|]|\s+)", template):
        if part == "<<l>>":
            out.append(rf"(?P<l{names}>[A-Za-z(](?:[^\n.;·|]|\.(?=\d)){{1,90}}?)")
            names += 1
        elif part == "<<x>>":
            out.append(r"\S[\s\S]*?")
        elif part == "<<y>>":
            out.append(r"\d{4}(?:\s*[-–,]\s*\d{4})*")
        elif part == "[":
            out.append("(?:")
        elif part == "]":
            out.append(")?")
        elif part == "(":
            out.append("(?:")
        elif part in ("|", ")"):
            out.append(part)
        elif part.isspace():
            out.append(r"\s+")
        elif part:
            out.append(re.escape(part))
    return re.compile("".join(out), re.I)


def _template(t: str) -> re.Pattern:
    t = t.replace("(c)", "\x01")
    p = compile_template(t)
    return re.compile(p.pattern.replace(re.escape("\x01"), r"(?:\(c\)|©)").replace("\x01", r"(?:\(c\)|©)"), re.I)


_NAMES = [(spdx, [compile_template(x) for x in re.split(r"\|(?![^\[(]*[\])])", t)]) for spdx, t in NAMES]
_NOTICES, _LICENSE_TEXTS, _README = [_template(t) for t in NOTICES], [_template(t) for t in LICENSE_TEXTS], [_template(t) for t in README_LINES]
_SPDX_OF: dict[str, str | None] = {}


def spdx_of(name: str | None) -> str | None:
    """The identifier of a freely spelled licence name, or None if it is none of the known."""
    if name is None:
        return None
    if name in _SPDX_OF:
        return _SPDX_OF[name]
    n = name.strip().strip("\"'`").lower().replace("licence", "license")
    n = re.sub(r"(?<=\d)\s*\+", "+", re.sub(r"[()\[\],;_/-]+", " ", n))
    n = re.sub(r"\b(v|version|ver\.?)\s*(?=\d)", "version ", re.sub(r"(gpl|mpl|apache|license)(v?)(?=\d)", r"\1 \2", n))
    n = re.sub(r"\s+", " ", n).strip(" .")
    found = None
    if n not in SILENT:
        for spdx, patterns in _NAMES:
            if any(p.fullmatch(n) for p in patterns):
                found = spdx
                break
        else:
            found = identifier(name.strip()) or spdx_expression(name.strip().rstrip("."))
    if len(_SPDX_OF) > 50_000:
        _SPDX_OF.clear()
    _SPDX_OF[name] = found
    return found


def _match(patterns: list[re.Pattern], text: str) -> str | None:
    for p in patterns:
        if m := p.fullmatch(text):
            for k, v in m.groupdict().items():
                if v and k.startswith("l") and (s := spdx_of(v)):
                    return s
    return None


_MARK = re.compile(r"^\s*(?:#+!?|//+!?|/\*+!?|\*+/?|--+|;+|\"\"\"|'''|<!--)\s?|\s*(?:\*+/|-->|\"\"\"|''')\s*$")
_COMMENT = re.compile(r"^\s*(?:#|//|/\*|\*|--|;|<!--)")
_CONFLICT = re.compile(r"^(?:<{7}|={7}|>{7}|\|{7})")
_HINT = re.compile(r"licen[cs]|spdx|free to use|terms|unlicense|under |passed on", re.I)
_DUNDER = re.compile(r"^[ \t]*__license__[ \t]*[=: ]+[\"']?([^\"'\r\n]+)[\"']?", re.M)
_MANIFEST = {
    "package.json": re.compile(r"\"license\"\s*[:= ]*\s*\"([^\"\n]+)\"?"),
    "setup.py": re.compile(r"^[ \t]*license\s*[= ]+\s*[\"']?([^\"'\n,]+)", re.M),
    "setup.cfg": re.compile(r"^license\s*=\s*(.+)$", re.M),
    "pyproject.toml": re.compile(r"^license\s*=\s*(?:\{\s*text\s*=\s*)?[\"']([^\"'\n]+)[\"']", re.M),
    "cargo.toml": re.compile(r"^license\s*=\s*\"([^\"\n]+)\"", re.M),
}
_LICENSE_FILE = re.compile(r"(?:un)?licen[cs]e|copying|notice", re.I)
#: Longest statement of a notice, its replaceable rest aside (a copyright line and a name), in characters.
STATEMENT = 500
_CODE = re.compile(r"^\s*(?:async\s+def|def|class)\b", re.M)


def head_comment(text: str) -> list[list[str]]:
    """Blocks of comment lines, marks removed, before the first line of code."""
    blocks: list[list[str]] = [[]]
    inside = False
    at = n = 0
    while at <= len(text):
        end = text.find("\n", at)
        line = text[at : len(text) if end < 0 else end]
        at += len(line) + 1
        n += 1
        s = line.strip()
        if _CONFLICT.match(s):  # a marker does not end the comment around it
            continue
        if not s or (n == 1 and s.startswith("#!")):
            if not inside:
                blocks.append([])
            continue
        if not inside and not _COMMENT.match(line):
            if s.startswith(("__license__", "<?php", "package ", "'use strict'", '"use strict"')):
                continue
            break
        if "/*" in s:
            inside = True
        blocks[-1].append(_MARK.sub("", _MARK.sub("", s)).strip())
        if "*/" in s:
            inside = False
            blocks.append([])
    return [b for b in blocks if b]


def file_license(path: str | None, text: str | None) -> str | None:
    """The licence that a file's text states, as an SPDX identifier."""
    if not text:
        return None
    base = (path or "").replace("\\", "/").rsplit("/", 1)[-1].lower()
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if _LICENSE_FILE.match(base.rsplit(".", 1)[0]) and not base.endswith((".py", ".js", ".ts", ".go", ".rs", ".java", ".cpp", ".cc", ".sh", ".sql")):
        return _match(_LICENSE_TEXTS, " ".join(text.split())) or _all(standard_licenses(text))
    if base.startswith("readme"):
        return _readme(text)
    if base in _MANIFEST and (m := _MANIFEST[base].search(text)) and (s := spdx_of(m.group(1))):
        return s
    if not _HINT.search(text):
        return None
    for block in head_comment(text):
        joined = "\n".join(block)
        if not _HINT.search(joined):
            continue
        for i in range(len(block)):
            j, size = i, 0
            while j < len(block) and (size <= STATEMENT or j < i + 8):
                size += len(block[j]) + 1
                j += 1
            for k in ([len(block)] if j < len(block) else []) + list(range(j, i, -1)):
                part = " ".join(x for x in block[i:k] if x)
                if _HINT.search(part) and (s := _match(_NOTICES, part)):
                    return s
        if found := standard_licenses(joined):
            return _all(found)
    m = _DUNDER.search(text)
    code = _CODE.search(text)
    return spdx_of(m.group(1).strip()) if m and (code is None or m.start() < code.start()) else None


def _all(found: list[str]) -> str | None:
    return " AND ".join(sorted(found)) if found else None


def _readme(text: str) -> str | None:
    found = None
    for sec in re.split(r"(?m)^(?=#+ |-{3,}\s*$)", text):
        lines = [x.strip() for x in sec.strip().split("\n")]
        title = re.sub(r"[#*:\s]+", " ", lines[0]).strip().lower() if lines else ""
        if lines and lines[0].startswith("#") and re.fullmatch(r"(?:\d+\.? )?(?:licen[cs](?:e|ing|e and copyright)|copyright(?: and licen[cs]e)?|legal)", title):
            body = " ".join(" ".join(lines[1:]).split())
            found = found or _match(_NOTICES, body) or _match(_LICENSE_TEXTS, body) or _all(standard_licenses(body))
        else:
            for x in lines:
                if x[:7].lower() in ("license", "licence") or x[:5].lower() in ("relea", "distr"):
                    found = found or _match(_README, re.sub(r"(?i)^licence", "License", x))
    return found


def file_licenses(records: DataFrame) -> DataFrame:
    """``ord, repository, spdx``: one row for each record whose text states its licence."""

    @F.pandas_udf("string")
    def scan(paths: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([file_license(p, t) for p, t in zip(paths, texts, strict=True)], dtype=object)

    r = spread(records.select("ord", "repo", "path", "text"))
    return r.select("ord", canonical_repository(F.col("repo")).alias("repository"), scan("path", "text").alias("spdx")).where("spdx IS NOT NULL")


def repository_licenses(records: DataFrame, repos: DataFrame, staged: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """``repository, licenses, n_files, recorded, hinted`` of every repository of ``repos``."""
    @F.pandas_udf("string")
    def name_to_spdx(names: pd.Series) -> pd.Series:
        return pd.Series([spdx_of(n) for n in names], dtype=object)

    stated = (files if files is not None else file_licenses(records)).groupBy("repository", "spdx").agg(F.count(F.lit(1)).alias("n"))
    stated = stated.select("repository", "spdx", "n", F.lit("file").alias("by"))

    def named(df: DataFrame, repo: str, col: str, by: str) -> DataFrame:
        d = df.select(canonical_repository(F.col(repo)).alias("repository"), F.trim(F.col(col)).alias("name")).distinct()
        return d.select("repository", name_to_spdx("name").alias("spdx"), F.lit(0).cast("long").alias("n"), F.lit(by).alias("by")).where("spdx IS NOT NULL")

    every = repos.select(canonical_repository(F.col("repository")).alias("repository")).where("repository <> ''").distinct()
    facts = stated.unionByName(named(repos, "repository", "license", "record")).unionByName(named(staged, "repo", "license_hint", "hint"))
    per = facts.groupBy("repository").agg(
        F.sort_array(F.collect_set("spdx")).alias("licenses"),
        F.sum("n").alias("n_files"),
        F.min(F.when(F.col("by") == "record", F.col("spdx"))).alias("recorded"),
        F.min(F.when(F.col("by") == "hint", F.col("spdx"))).alias("hinted"),
    )
    return every.join(per, "repository", "left")


def licenses_found(records: DataFrame, repos: DataFrame, staged: DataFrame) -> DataFrame:
    """``unit, item_key, spdx``: the files' licences, and the repositories in conflict or unknown."""
    from siltstone.session import materialize

    asked = F.col("spdx").isin(*ASKED)
    files = materialize(file_licenses(records).where(asked), "file-licenses")
    per = repository_licenses(records, repos, staged, files)
    n = F.coalesce(F.size("licenses"), F.lit(0))
    flagged = per.where((n < 1) | (n > 1)).select(F.lit("repo").alias("unit"), F.col("repository").alias("item_key"), F.when(n > 1, F.lit("CONFLICT")).otherwise(F.lit("UNKNOWN")).alias("spdx"))
    return files.select(F.lit("file").alias("unit"), F.col("ord").cast("string").alias("item_key"), "spdx").unionByName(flagged)


def repository_report(records: DataFrame, repos: DataFrame, staged: DataFrame) -> DataFrame:
    """``repository, license, status, licenses, recorded, hinted, n_files`` of every repository."""
    per = repository_licenses(records, repos, staged)
    n = F.coalesce(F.size("licenses"), F.lit(0))
    return per.select(
        "repository",
        F.when(n == 1, F.element_at("licenses", 1)).alias("license"),
        F.when(n == 1, F.lit("OK")).when(n > 1, F.lit("CONFLICT")).otherwise(F.lit("UNKNOWN")).alias("status"),
        "licenses",
        "recorded",
        "hinted",
        F.coalesce("n_files", F.lit(0)).alias("n_files"),
    )
