"""Source lists, source kinds and the ingestion of staged folders."""

from __future__ import annotations

import glob
import importlib
import os
import urllib.request
import zipfile
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import EXTENSION_LANGUAGE
from siltstone.operators.ordering import global_positions
from siltstone.schemas import SOURCE_CATEGORIES, SOURCE_FIELDS, SOURCE_KINDS, SOURCES

TEXT_FIELDS = ("content", "code", "func_code_string", "whole_func_string", "text", "source", "body")
PRUNED = ("node_modules", "vendor", "third_party", ".git", ".venv", "venv", "__pycache__")


@dataclass(frozen=True)
class Source:
    id: str
    kind: str
    location: str
    license_hint: str = ""
    languages: tuple = ()
    category: str = "code"
    ref: str = "HEAD"
    subpath: str = ""
    enabled: bool = True

    def __post_init__(self):
        if self.kind not in SOURCE_KINDS:
            raise ValueError(f"unknown kind {self.kind}")
        if self.category not in SOURCE_CATEGORIES:
            raise ValueError(f"unknown category {self.category}")


@dataclass
class SourceList:
    sources: list[Source] = field(default_factory=list)

    def add(self, source: Source) -> None:
        self.sources.append(source)

    def enabled(self) -> list[Source]:
        return [s for s in self.sources if s.enabled]

    def by_kind(self, kind: str) -> list[Source]:
        return [s for s in self.sources if s.kind == kind]

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(list(s.languages) if f == "languages" else getattr(s, f) for f in SOURCE_FIELDS) for s in self.sources], SOURCES)

    @classmethod
    def from_rows(cls, rows) -> SourceList:
        return cls([Source(**{k: (tuple(v or ()) if k == "languages" else v) for k, v in r.items() if k in SOURCE_FIELDS and v is not None}) for r in rows])


# The starting catalogue (id, kind, location, licence hint, language, category, enabled).
CATALOGUE = """
gh:pallets/click                        github       pallets/click                            BSD-3-Clause  python      code      yes
gh:psf/requests                         github       psf/requests                             Apache-2.0    python      code      yes
gh:expressjs/express                    github       expressjs/express                        MIT           javascript  code      yes
gh:microsoft/TypeScript-Node-Starter    github       microsoft/TypeScript-Node-Starter        MIT           typescript  examples  yes
gh:BurntSushi/ripgrep                   github       BurntSushi/ripgrep                       MIT           rust        code      yes
gh:spf13/cobra                          github       spf13/cobra                              Apache-2.0    go          code      yes
gh:google/googletest                    github       google/googletest                        BSD-3-Clause  cpp         tests     yes
gh:google/gson                          github       google/gson                              Apache-2.0    java        code      yes
hf:code-search-net-python               huggingface  code_search_net                          MIT           python      code      no
docs:python-tutorial                    http         https://docs.python.org/3/tutorial/      Python-2.0    markdown    tutorial  no
"""


def default_sources() -> SourceList:
    rows = (line.split() for line in CATALOGUE.strip().splitlines())
    return SourceList([Source(i, k, at, lic, (lang,), cat, enabled=on == "yes") for i, k, at, lic, lang, cat, on in rows])


class SourceError(Exception):
    """A source that can't be staged; ingestion goes on with the others."""


def stage_local(source: Source, stage: str) -> str:
    root = os.path.abspath(os.path.join(source.location, source.subpath or ""))
    if not os.path.isdir(root):
        raise SourceError(f"no folder {root}")
    return root


def stage_zip(archive: str, source: Source, stage: str) -> str:
    """Unpack an archive of a repository: its top folder is dropped, only ``subpath`` is kept."""
    target = os.path.join(stage, source.id.replace("/", "__").replace(":", "_"))
    with zipfile.ZipFile(archive) as z:
        for name in z.namelist():
            rel = name.partition("/")[2]
            safe = [p for p in rel.split("/") if p not in ("", ".", "..")]
            if not safe or name.endswith("/") or (source.subpath and not rel.startswith(source.subpath.rstrip("/") + "/")):
                continue
            out = os.path.join(target, *safe)
            os.makedirs(os.path.dirname(out), exist_ok=True)
            with open(out, "wb") as f:
                f.write(z.read(name))
    if not os.path.isdir(target):
        raise SourceError(f"nothing to unpack in {archive}")
    return target


def stage_github(source: Source, stage: str, base: str = "https://codeload.github.com") -> str:
    os.makedirs(stage, exist_ok=True)
    archive = os.path.join(stage, source.id.replace("/", "__").replace(":", "_") + ".zip")
    try:
        urllib.request.urlretrieve(f"{base}/{source.location}/zip/{source.ref}", archive)
    except OSError as e:
        raise SourceError(str(e)) from e
    return stage_zip(archive, source, stage)


def stage_http(source: Source, stage: str) -> str:
    target = os.path.join(stage, source.id.replace("/", "__").replace(":", "_"))
    try:
        with urllib.request.urlopen(source.location, timeout=30) as r:
            kind, data = r.headers.get("Content-Type", ""), r.read()
    except OSError as e:
        raise SourceError(str(e)) from e
    ext = ".html" if "html" in kind else ".md" if "markdown" in kind else ".txt"
    os.makedirs(target, exist_ok=True)
    with open(os.path.join(target, "page" + ext), "wb") as f:
        f.write(data)
    return target


#: Rows of a dataset that are staged at most (the reference limit of this source kind).
DATASET_ROWS = 5000
_EXTENSION_OF = {v: k for k, v in reversed(EXTENSION_LANGUAGE.items())}


def _module(name: str):
    try:
        return importlib.import_module(name)
    except ImportError:
        return None


def stage_dataset(source: Source, stage: str, load=None) -> str:
    """A dataset of the public hub as one file a row, named ``example_000000.ext`` in the order of the rows.

    ``load(location)`` gives the rows as dictionaries; without it the optional ``datasets`` package does.
    """
    if load is None:
        hub = _module("datasets")
        if hub is None:
            raise SourceError("the datasets package is not installed")
        load = lambda location: hub.load_dataset(location, split="train", streaming=True)
    target = os.path.join(stage, source.id.replace("/", "_").replace(":", "_"))
    os.makedirs(target, exist_ok=True)
    ext = _EXTENSION_OF.get(source.languages[0] if source.languages else "python", "txt")
    n = 0
    for row in load(source.location):
        text = next((row[f] for f in TEXT_FIELDS if row.get(f)), None)
        if isinstance(text, str) and text.strip():
            with open(os.path.join(target, f"example_{n:06d}.{ext}"), "w", encoding="utf-8", newline="") as f:
                f.write(text)
            n += 1
            if n == DATASET_ROWS:
                break
    if not n:
        raise SourceError(f"no text in {source.location}")
    return target


STAGERS = {"local": stage_local, "github": stage_github, "http": stage_http, "huggingface": stage_dataset}


def available(kind: str) -> bool:
    """Whether a source kind can be staged here: the hub needs an optional package, the others nothing."""
    return kind in STAGERS and (kind != "huggingface" or _module("datasets") is not None)


#: Bytes of files that one batch of a scan holds.
SCAN_BATCH = 32 << 20
_SCANNED = "repository string, source string, license_hint string, path string, content binary, size long"


def _entries(root: str, inside: str | None = None):
    """Path below ``root`` and place of every regular file, whatever its name; links are left out.

    ``inside`` restricts the walk to one entry of ``root``. Roots with a scheme go through Arrow's file systems.
    """
    if "://" in root and not root.startswith("file://"):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        at = f"{base}/{inside}" if inside else base
        info = system.get_file_info(at)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
        for f in found:
            if f.type == fs.FileType.File:
                yield f.path[len(base) :].lstrip("/"), (system, f.path)
        return
    base = os.path.abspath(root.removeprefix("file://"))
    todo = [os.path.join(base, inside) if inside else base]
    while todo:
        at = todo.pop()
        if os.path.islink(at) and at != base:
            continue
        if os.path.isfile(at):
            yield os.path.relpath(at, base).replace(os.sep, "/"), (None, at)
        elif os.path.isdir(at):
            todo += sorted((e.path for e in os.scandir(at)), reverse=True)


def _top(root: str) -> list[str]:
    if "://" in root and not root.startswith("file://"):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        return sorted(f.base_name for f in system.get_file_info(fs.FileSelector(base)))
    return sorted(os.listdir(os.path.abspath(root.removeprefix("file://"))))


def scan_folders(spark: SparkSession, roots: list[tuple[str, str, str, str]]) -> DataFrame:
    """``repository, source, license_hint, path, content, size`` of all files of ``(repository, root, source, hint)``.

    One scan for any number of roots, which executors list and read in parallel: tasks take the
    entries at the top of the roots, walk them, and give their files in batches of bounded size.
    Every regular file counts, whatever its name (Spark's own listing hides names that start with
    ``_`` or ``.``); symbolic links do not, and files that can't be read are left out.
    """

    def top(batches):
        for pdf in batches:
            rows = [(r.repository, r.root, r.source, r.hint, e) for r in pdf.itertuples() for e in _top(r.root)]
            yield pd.DataFrame(rows, columns=["repository", "root", "source", "hint", "entry"])

    def read(batches):
        rows, held = [], 0
        columns = ["repository", "source", "license_hint", "path", "content", "size"]
        for pdf in batches:
            for r in pdf.itertuples():
                for path, (system, full) in _entries(r.root, r.entry):
                    try:
                        with open(full, "rb") if system is None else system.open_input_stream(full) as f:
                            data = f.read()
                    except OSError:
                        continue
                    rows.append((r.repository, r.source, r.hint, path, data, len(data)))
                    held += len(data)
                    if held >= SCAN_BATCH:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
        yield pd.DataFrame(rows, columns=columns)

    want = spark.sparkContext.defaultParallelism
    given = spark.createDataFrame(roots, "repository string, root string, source string, hint string")
    tops = given.repartition(min(max(1, len(roots)), want), "root").mapInPandas(top, "repository string, root string, source string, hint string, entry string")
    return tops.repartition(want, "root", "entry").mapInPandas(read, _SCANNED)


def scan_folder(spark: SparkSession, root: str, repository: str, source: str = "local") -> DataFrame:
    """``repository, source, path, content, size`` of all files below ``root``."""
    return scan_folders(spark, [(repository, root, source, "")]).drop("license_hint")


def with_ord(files: DataFrame) -> DataFrame:
    """``ord``: the place of a file by repository and path."""
    return global_positions(files, [F.col("repository"), F.col("path")], narrow=True).withColumnRenamed("pos", "ord")


def ingest(spark: SparkSession, sources: SourceList, stage: str) -> DataFrame:
    """Files of all enabled sources that can be staged, in one scan; the others are left out."""
    roots = []
    for s in sources.enabled():
        if not available(s.kind):
            continue
        try:
            root = STAGERS[s.kind](s, stage)
        except SourceError:
            continue
        roots.append((os.path.basename(root.rstrip("/")) if s.kind == "local" else s.location, root, s.kind, s.license_hint or ""))
    if not roots:
        raise SourceError("no source could be staged")
    return with_ord(scan_folders(spark, roots))


def discover(root: str) -> list[tuple[str, str]]:
    """``(repository, folder)``: each subfolder that is no third-party folder; loose files make the root one too."""
    if not os.path.isdir(root):
        raise SourceError(f"no folder {root}")
    subs = sorted(d for d in os.listdir(root) if os.path.isdir(os.path.join(root, d)) and d not in PRUNED)
    loose = any(os.path.isfile(os.path.join(root, f)) for f in os.listdir(root))
    found = [(d, os.path.join(root, d)) for d in subs]
    return ([(os.path.basename(os.path.abspath(root)), os.path.abspath(root))] if loose or not found else []) + found


def dataset_texts(df: DataFrame, limit: int | None = 5000, fields=TEXT_FIELDS) -> DataFrame:
    """``text``: the first of the known text columns that is not blank, at most ``limit`` rows."""
    cols = [F.nullif(F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", ""), F.lit("")) for c in fields if c in df.columns]
    if not cols:
        raise SourceError("no text column")
    keep = [F.col(c) for c in fields if c in df.columns]
    first = None
    for raw, clean in zip(keep, cols, strict=True):
        first = F.when(clean.isNotNull(), raw) if first is None else first.when(clean.isNotNull(), raw)
    out = df.select(first.alias("text")).where("text IS NOT NULL")
    return out.limit(limit) if limit else out


def tokenizer_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """``text`` of the four JSONL formats (instruction, reasoning, fim, chat) that are there."""
    join = lambda *c: F.concat_ws("\n", *(F.coalesce(F.col(x), F.lit("")) for x in c))
    forms = {
        "instruction": ("instruction string, output string", join("instruction", "output")),
        "reasoning": ("problem string, reasoning string, solution string, tests array<string>", F.concat_ws("\n", join("problem", "reasoning", "solution"), F.array_join(F.coalesce("tests", F.array().cast("array<string>")), "\n"))),
        "fim": ("psm string", F.coalesce("psm", F.lit(""))),
        "chat": ("messages array<struct<role: string, content: string>>", F.array_join(F.transform(F.coalesce("messages", F.array().cast("array<struct<role: string, content: string>>")), lambda m: F.coalesce(m["content"], F.lit(""))), "\n")),
    }
    out = None
    for name, (schema, text) in forms.items():
        path = os.path.join(folder, name + ".jsonl")
        if os.path.exists(path):
            if name in ("instruction", "reasoning"):
                text = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
            df = spark.read.schema(schema).json(path).select(text.alias("text"))
            out = df if out is None else out.unionByName(df)
    return spark.createDataFrame([], "text string") if out is None else out


def text_files(spark: SparkSession, pattern: str) -> DataFrame:
    """``ord, path, text`` of the files of a glob (``**`` for any depth), in the order of their paths; blank ones left out."""
    found = sorted(f for f in glob.glob(pattern, recursive=True) if os.path.isfile(f))

    def read(batches):
        for pdf in batches:
            texts = []
            for p in pdf["path"]:
                with open(p, encoding="utf-8", errors="replace") as f:
                    texts.append(f.read())
            yield pdf.assign(text=texts)

    df = spark.createDataFrame(list(enumerate(found)), "ord long, path string")
    df = df.repartition(max(1, min(len(found), spark.sparkContext.defaultParallelism)), "path").mapInPandas(read, "ord long, path string, text string")
    return df.where(F.regexp_replace("text", r"(?U)\s", "") != "")
