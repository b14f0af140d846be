"""Licence of a text, a file and a repository; the licence policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.config import ALLOWED_LICENSES
from siltstone.operators.cleaning import base_name, first_text_files

# Phrases that name a licence (all must occur), more specific ones first; classes.
PHRASES = (
    ("Apache-2.0", ("apache license", r"version 2\.0")),
    ("MPL-2.0", ("mozilla public license", r"version 2\.0")),
    ("AGPL-3.0-or-later", ("gnu affero general public license", "version 3")),
    ("LGPL-3.0-or-later", ("gnu lesser general public license", "version 3")),
    ("LGPL-2.1-or-later", ("gnu lesser general public license", r"version 2\.1")),
    ("GPL-3.0-or-later", ("gnu general public license", "version 3")),
    ("GPL-2.0-or-later", ("gnu general public license", "version 2")),
    ("BSD-3-Clause", ("redistribution and use", "neither the name")),
    ("BSD-2-Clause", ("redistribution and use in source and binary forms",)),
    ("ISC", ("permission to use, copy, modify, and(/or)? distribute",)),
    ("Unlicense", ("this is free and unencumbered software released into the public domain",)),
    ("0BSD", ("permission to use, copy, modify, and/or distribute this software for any",)),
    ("Zlib", (r"this software is provided ['\"]as-is['\"]", "altered source versions")),
    ("MIT", ("permission is hereby granted, free of charge",)),
)
PERMISSIVE = (
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-3-Clause-Clear", "ISC", "0BSD", "Unlicense", "Zlib", "MPL-2.0", "BSL-1.0", "Python-2.0",
    "Apache-1.1", "PostgreSQL", "NCSA", "MIT-0",
)
COPYLEFT = (
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "AGPL-3.0-only", "AGPL-3.0-or-later", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "AGPL-3.0", "EUPL-1.2", "CC-BY-SA-4.0",
)
LICENSE_NAMES = ("license", "license.txt", "license.md", "license-mit", "copying", "copying.txt", "unlicense", "licence", "licence.txt")
SNIFFED = ("mit license", "apache license", "bsd ", "mozilla public", "gnu general public", "isc license", "the unlicense")
UNKNOWN = "UNKNOWN"
TAG = r"SPDX-License-Identifier:\s*([A-Za-z0-9.\-+]+)"


def spdx_tag(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, TAG, 1), F.lit(""))


def _says(low: Column, phrase: str) -> Column:
    """A phrase without pattern signs is a plain search, far cheaper than a regular expression."""
    plain = phrase.replace("\\.", ".")
    return low.contains(plain) if plain.replace(".", "").replace(",", "").replace("/", "").replace(" ", "").isalnum() and ".*" not in phrase else low.rlike(phrase)


def _rule(low: Column) -> Column:
    rule = None
    for spdx, phrases in PHRASES:
        cond = F.lit(True)
        for p in phrases:
            cond = cond & _says(low, p)
        rule = F.when(cond, F.lit(spdx)) if rule is None else rule.when(cond, F.lit(spdx))
    return rule


def text_license(text: Column) -> Column:
    # As a lambda's argument the lower-cased text is made once, not anew for every phrase.
    low = F.regexp_replace(F.lower(text), r"(?U)\s+", " ")
    return F.coalesce(spdx_tag(text), F.element_at(F.transform(F.array(low), _rule), 1), F.lit(UNKNOWN))


def license_class(spdx: Column) -> Column:
    return F.when(spdx.isin(*PERMISSIVE), F.lit("permissive")).when(spdx.isin(*COPYLEFT), F.lit("copyleft")).otherwise(F.lit("unknown"))


def is_allowed(spdx: Column, allowed=ALLOWED_LICENSES, allow_unknown: bool = False, allow_copyleft: bool = False) -> Column:
    listed = spdx.isin(*allowed) if allowed else F.lit(False)
    kind = license_class(spdx)
    return listed | F.when(kind == "permissive", F.lit(not allowed)).when(kind == "copyleft", F.lit(allow_copyleft)).otherwise(F.lit(allow_unknown))


def repository_license(files: DataFrame, limit: int = 50) -> DataFrame:
    """``repository, license``: the first licence file that says something, else the first SPDX tag."""
    probe = first_text_files(files, limit).select("repository", "ord", F.lower(base_name(F.col("path"))).alias("b"), F.col("content").cast("string").alias("t"))
    named = F.when(F.col("b").isin(*LICENSE_NAMES) | F.col("b").startswith("license"), F.nullif(text_license(F.col("t")), F.lit(UNKNOWN)))
    found = probe.select("repository", "ord", named.alias("named"), spdx_tag(F.col("t")).alias("tag"))
    per = found.groupBy("repository").agg(
        F.min_by("named", F.when(F.col("named").isNotNull(), F.col("ord"))).alias("named"), F.min_by("tag", F.when(F.col("tag").isNotNull(), F.col("ord"))).alias("tag")
    )
    return per.select("repository", F.coalesce("named", "tag", F.lit(UNKNOWN)).alias("license"))


def repository_info(files: DataFrame) -> DataFrame:
    """``repository, has_readme, has_license, license, folders``: what the file names of a repository say."""
    b = F.lower(base_name(F.col("path")))
    lic = b.startswith("license") | b.startswith("licence") | (b == "copying")
    head = F.lower(F.substring(F.col("content").cast("string"), 1, 800))
    label = None
    for s in SNIFFED:
        word = s.strip().split(" license")[0].upper()
        label = F.when(head.contains(s), F.lit(word)) if label is None else label.when(head.contains(s), F.lit(word))
    df = files.select("repository", "ord", b.startswith("readme").alias("r"), lic.alias("l"), F.when(lic, label.otherwise(F.lit("custom"))).alias("s"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("d"))
    return df.groupBy("repository").agg(
        F.bool_or("r").alias("has_readme"),
        F.bool_or("l").alias("has_license"),
        F.max_by("s", F.when(F.col("l"), F.col("ord"))).alias("license"),
        F.count_distinct(F.nullif("d", F.lit(""))).alias("folders"),
    )
