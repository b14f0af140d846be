"""Named queries of sources, sinks, pipelines and what needs Python, on whole tables or small fixtures.

A fixture's SQL is a list of literal rows that were worked out by hand or with the standard library,
so that it does not share code with the operators. Tables are written to and read back from the
session's shared folder.
"""

from __future__ import annotations

import json
import os
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.config import CorpusConfig, DatasetConfig
from siltstone.functions import bpe, python_code
from siltstone.operators import chunking, cleaning, components, dedup, ordering, quality, splitting, tasks
from siltstone.plans import corpus as corpus_plan
from siltstone.plans import dataset as dataset_plan
from siltstone.plans import queries as q
from siltstone.plans import report
from siltstone.session import scratch_dir, table
from siltstone.sources import registry, shards, store

query, CORPUS = q.query, q.CORPUS


def folder(spark: SparkSession, label: str) -> str:
    """A fresh folder that all executors share."""
    path = f"{scratch_dir(spark).removeprefix('file:').rstrip('/')}/{label}-{uuid.uuid4().hex}"
    os.makedirs(path, exist_ok=True)
    return path


def put(root: str, files: dict[str, str | bytes]) -> str:
    for path, body in files.items():
        target = os.path.join(root, path)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(target, "wb") as f:
            f.write(body if isinstance(body, bytes) else body.encode())
    return root


def facts(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame([(str(a), str(b)) for a, b in rows], "item string, value string")


def literal(*rows) -> str:
    text = lambda v: "'" + str(v).replace("'", "''") + "'"
    return f"SELECT item, value FROM (VALUES {', '.join(f'({text(a)}, {text(b)})' for a, b in rows)}) t(item, value)"


# --- sources ---------------------------------------------------------------------------------------
@query(literal(("__init__.py", 6), (".github/w.yml", 3), ("_private/deep/.keep", 0), ("_private/x.py", 5), ("a.py", 5), ("b c.py", 9), ("empty", 0)))
def repository_scan(spark, sf_dir):
    """Every regular file, whatever its name; symbolic links are left out."""
    root = put(folder(spark, "scan"), {"a.py": "x = 1", "__init__.py": "y = 22", "_private/x.py": "z = 3", "_private/deep/.keep": b"", ".github/w.yml": "a:\n", "b c.py": "é = 'ü'", "empty": b""})
    os.symlink(os.path.join(root, "a.py"), os.path.join(root, "link.py"))
    os.symlink(os.path.join(root, "_private"), os.path.join(root, "linked"))
    return registry.scan_folder(spark, root, "r").select(F.col("path").alias("item"), F.col("size").cast("string").alias("value"))


@query(literal(
    ("local local/src a.py", "x = 1"), ("github o/n src/b.py", "y = 2"), ("http page page.html", "<p>hi</p>"), ("huggingface hub example_000000.go", "package a"), ("huggingface hub example_000001.go", "package b"),
    ("missing folder", "SourceError"), ("no dataset text", "SourceError"), ("available local github http", "True"), ("available ftp", "False"), ("ingested", "local/src"),
))
def staged_sources(spark, sf_dir):
    """The four source kinds staged from local stand-ins, what can't be staged, and the union of what can."""
    base = folder(spark, "stage")
    put(base, {"src/a.py": "x = 1", "page.html": "<p>hi</p>"})
    os.makedirs(f"{base}/hub/o/n/zip")
    with zipfile.ZipFile(f"{base}/hub/o/n/zip/HEAD", "w") as z:
        z.writestr("n-main/src/b.py", "y = 2")
        z.writestr("n-main/docs/c.md", "text")
        z.writestr("n-main/../../evil.py", "z")
    rows = [{"content": " ", "code": "package a"}, {"other": "x"}, {"content": "package b"}]
    got = [
        ("local/src", registry.stage_local(registry.Source("s", "local", base, subpath="src"), base), "local", ""),
        ("o/n", registry.stage_github(registry.Source("gh:o/n", "github", "o/n", subpath="src"), f"{base}/st", base=f"file://{base}/hub"), "github", ""),
        ("page", registry.stage_http(registry.Source("p", "http", f"file://{base}/page.html"), f"{base}/st"), "http", ""),
        ("hub", registry.stage_dataset(registry.Source("d", "huggingface", "x", languages=("go",)), f"{base}/st", load=lambda at: [{k: v for k, v in r.items() if v.strip()} for r in rows]), "huggingface", ""),
    ]
    out = registry.scan_folders(spark, got).select(F.concat_ws(" ", "source", "repository", "path").alias("item"), F.col("content").cast("string").alias("value"))
    said = []
    for name, call in (("missing folder", lambda: registry.stage_local(registry.Source("m", "local", base + "/none"), base)), ("no dataset text", lambda: registry.stage_dataset(registry.Source("e", "huggingface", "x"), f"{base}/st", load=lambda at: []))):
        try:
            said.append((name, call()))
        except registry.SourceError as e:
            said.append((name, type(e).__name__))
    said += [("available local github http", all(map(registry.available, ("local", "github", "http")))), ("available ftp", registry.available("ftp"))]
    listed = registry.SourceList([registry.Source("a", "local", base + "/src"), registry.Source("b", "local", base + "/none"), registry.Source("c", "local", base, enabled=False)])
    said += [("ingested", "local/" + r.repository) for r in registry.ingest(spark, listed, base).select("repository").distinct().collect()]
    return out.unionByName(facts(spark, said))


@query("""SELECT * FROM (VALUES ('code', 7, 6), ('examples', 1, 1), ('tests', 1, 1), ('tutorial', 1, 0)) t(category, n, enabled)""")
def source_catalogue(spark, sf_dir):
    d = registry.default_sources().to_df(spark)
    return d.groupBy("category").agg(F.count(F.lit(1)).cast("int").alias("n"), F.count_if("enabled").cast("int").alias("enabled"))


@query(literal(("flat", "flat"), ("multi", "a,b"), ("mixed", "mixed,lib"), ("none", "SourceError")))
def discovered_layouts(spark, sf_dir):
    """Loose files, a folder of repositories, both; third-party folders are no repository."""
    base = put(folder(spark, "layout"), {"flat/a.py": "x", "multi/a/x.py": "x", "multi/b/y.py": "y", "mixed/a.py": "x", "mixed/lib/b.py": "y", "mixed/node_modules/c.js": "z"})
    rows = []
    for name in ("flat", "multi", "mixed", "none"):
        try:
            rows.append((name, ",".join(n for n, _ in registry.discover(os.path.join(base, name)))))
        except registry.SourceError as e:
            rows.append((name, type(e).__name__))
    return facts(spark, rows)


@query(literal(("0", "do\ndone"), ("1", "hi\nyo"), ("2", "p"), ("3", "p\nr\ns\nt1\nt2")))
def tokenizer_texts(spark, sf_dir):
    rows = {"chat": {"messages": [{"role": "u", "content": "hi"}, {"role": "a", "content": "yo"}]}, "fim": {"psm": "p"}, "instruction": {"instruction": "do", "output": "done"}, "reasoning": {"problem": "p", "reasoning": "r", "solution": "s", "tests": ["t1", "t2"]}}
    root = put(folder(spark, "texts"), {f"{k}.jsonl": json.dumps(v) + "\n\n" for k, v in rows.items()})
    return facts(spark, enumerate(sorted(r.text for r in registry.tokenizer_corpus(spark, root).collect())))


@query(literal(("0", "_first.txt=one"), ("2", "b/c/deep.txt=three"), ("3", "b/two.txt=two")))
def text_scan(spark, sf_dir):
    """Sorted by path, at any depth, blank files left out but counted in the order."""
    root = put(folder(spark, "glob"), {"b/two.txt": "two", "_first.txt": "one", "b/c/deep.txt": "three", "a-blank.txt": " \n", "skip.md": "no"})
    d = registry.text_files(spark, f"{root}/**/*.txt")
    return d.select(F.col("ord").cast("string").alias("item"), F.concat(F.substring("path", len(root) + 2, 99), F.lit("="), F.col("text")).alias("value"))


@query(literal(("evals", 2), ("others", 2), ("best perplexity", "1.648721"), ("last step", 4)))
def train_log(spark, sf_dir):
    """Metrics appended line by line and read back by kind."""
    path = os.path.join(folder(spark, "log"), "metrics.jsonl")
    store.append_log(path, 1, {"loss": 2.0})
    store.append_log(path, 2, {"val_loss": 1.0}, "eval")
    store.append_log(path, 3, {"val_loss": 0.5}, "eval")
    store.append_log(path, 4, {"loss": 1.0})
    evals, rest = store.read_train_log(spark, path)
    return facts(spark, [("evals", evals.count()), ("others", rest.count()), ("best perplexity", f"{store.best_perplexity(evals).first()[0]:.6f}"), ("last step", rest.agg(F.max("step")).first()[0])])


# --- stores over whole tables ------------------------------------------------------------------------
def _kept(spark, sf_dir):
    d = table(spark, sf_dir, "files").select("ord", F.coalesce("drop_reason", F.lit("")).alias("drop_reason"))
    return q.corpus(spark, sf_dir).join(d, "ord").withColumns({"quality_score": F.lit(0.0), "file_quality": F.lit(0.0), "created_at": F.lit("")})


KEPT = CORPUS.rstrip() + ", kept AS (SELECT c.* FROM corpus c JOIN files f ON c.ord = f.ord WHERE coalesce(f.drop_reason, '') = '')"


@query(f"WITH {KEPT} SELECT language, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(length(content)) AS BIGINT) AS chars FROM kept GROUP BY language")
def record_store(spark, sf_dir):
    """Kept records written as JSON lines and read back strictly."""
    at = folder(spark, "records") + "/store"
    store.write_records(_kept(spark, sf_dir).drop("ord"), at)
    return store.read_records(spark, at).groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.sum(F.length("content")).alias("chars"))


@query(f"WITH {KEPT} SELECT split, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM kept GROUP BY split")
def split_export(spark, sf_dir):
    at = folder(spark, "split") + "/out"
    counts = store.write_by_split(_kept(spark, sf_dir).select("split", "path", "size", "drop_reason", "content"), at)
    back = spark.read.json(at).groupBy("split").agg(F.sum("size").alias("bytes"))
    return counts.join(back, "split").select("split", "n", "bytes")


@query(f"WITH {KEPT} SELECT repository, count(*) AS n, bit_xor(('0x' || substring(hash, 1, 15))::BIGINT) AS hashes FROM kept GROUP BY repository")
def parquet_export(spark, sf_dir):
    at = folder(spark, "parquet") + "/out"
    store.write_parquet(_kept(spark, sf_dir), at)
    d = spark.read.parquet(at)
    assert d.columns == sorted(d.columns)
    return d.groupBy("repository").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.conv(F.substring("hash", 1, 15), 16, 10).cast("long")).alias("hashes"))


_SAFE = "array_to_string(list_filter(string_split(replace({}, '\\', '/'), '/'), lambda p: p NOT IN ('', '.', '..')), '/')"


@query(f"""WITH {KEPT}, t AS (SELECT DISTINCT coalesce(nullif(split, ''), 'none') || '/' || {_SAFE.format("repository")} || '/' || {_SAFE.format("path")} AS path FROM kept)
SELECT string_split(path, '/')[1] AS split, count(*) AS n FROM t GROUP BY 1""")
def raw_export(spark, sf_dir):
    """The raw tree written, and what a scan finds there."""
    at = folder(spark, "raw")
    store.write_raw(_kept(spark, sf_dir), at)
    return registry.scan_folder(spark, at, "raw").groupBy(F.substring_index("path", "/", 1).alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT split, count(*) AS n, CAST(sum(n_files) AS BIGINT) AS files, CAST(sum(list_sum(map_values(languages))) AS BIGINT) AS by_language, round(sum(coalesce(signals.comments, 0)), 4) AS comments FROM repos WHERE split IS NOT NULL GROUP BY split")
def repository_store(spark, sf_dir):
    at = folder(spark, "repos") + "/store"
    r = table(spark, sf_dir, "repos").where("split IS NOT NULL")
    s = r.schema["signals"].dataType.fieldNames()
    r = r.withColumn("signals", F.struct(*(F.col(f"signals.{n}").alias("syntax_validity" if n == "syntax" else n) for n in s)))
    store.write_repos(r, at)
    total = F.aggregate(F.map_values("languages"), F.lit(0).cast("long"), lambda a, v: a + v)
    return store.read_repos(spark, at).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("n_files").alias("files"), F.sum(total).alias("by_language"), F.round(F.sum(F.coalesce("signals.comments", F.lit(0.0))), 4).alias("comments"))


@query(f"WITH {CORPUS} SELECT language, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars FROM corpus WHERE content <> '' GROUP BY language")
def task_export(spark, sf_dir):
    at = folder(spark, "tasks") + "/out"
    store.write_tasks(tasks.next_token(q.corpus(spark, sf_dir)), at)
    d = spark.read.schema("task string, text string, language string").json(at)
    return d.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def _sharded(spark, sf_dir):
    at = folder(spark, "shards")
    c = table(spark, sf_dir, "chunks").select("chunk_id", "token_ids", F.struct("n_pad").alias("m"))
    rows = shards.write_shards(c, at, seq_len=q.SEQ, vocab_size=65536, shard_max_bytes=q.SHARD_BYTES, meta="m")
    return at, shards.manifest(rows, at, seq_len=q.SEQ, vocab_size=65536)


@query("SELECT row_number() OVER (ORDER BY chunk_id) - 1 AS idx, sha256(array_to_string(token_ids, ',')) AS ids, n_pad FROM chunks")
def shard_roundtrip(spark, sf_dir):
    """Chunks written as binary shards, and the shards read as one dataset with their meta."""
    at, _ = _sharded(spark, sf_dir)
    d = shards.read_shards(spark, at)
    return d.select("idx", F.sha2(F.array_join("token_ids", ","), 256).alias("ids"), F.get_json_object("meta", "$.n_pad").cast("int").alias("n_pad"))


@query(f"""WITH c AS (SELECT (row_number() OVER (ORDER BY chunk_id) - 1) // {-(-q.SHARD_BYTES // (q.SEQ * 2))} AS s FROM chunks)
SELECT printf('shard_%05d.rds', CAST(s AS INT)) AS file, count(*) AS chunks, count(*) * {q.SEQ} AS tokens, true AS in_manifest, true AS ok FROM c GROUP BY s""")
def shard_manifest(spark, sf_dir):
    """The manifest's shards, and the checksum of each file as the executors read it."""
    at, m = _sharded(spark, sf_dir)
    rows = spark.createDataFrame([(s["file"], s["chunks"], s["tokens"], s["checksum_ok"]) for s in m["shards"]], "file string, chunks long, tokens long, in_manifest boolean")
    return rows.join(shards.verify_shards(spark, at), "file")


@query("""WITH c AS (SELECT row_number() OVER (ORDER BY chunk_id) - 1 AS idx, count(*) OVER () AS n, token_ids FROM chunks)
SELECT idx, sha256(array_to_string(token_ids, ',')) AS ids FROM c WHERE idx IN (0, 7, n - 1, n - 3)""")
def shard_seek(spark, sf_dir):
    """Single chunks, also from the end, read from their shard alone."""
    at, _ = _sharded(spark, sf_dir)
    out = None
    for i in (0, 7, -1, -3, 10**9):
        d = shards.seek_chunk(spark, at, i)
        out = d if out is None else out.unionByName(d)
    return out.select("idx", F.sha2(F.array_join("token_ids", ","), 256).alias("ids"))


# --- cleaning and validation on fixtures --------------------------------------------------------------
BOOK = {"cells": [{"cell_type": "code", "source": "x", "outputs": [{"text": "1"}], "execution_count": 3}, {"cell_type": "markdown", "source": "é"}]}


@query(literal(
    ("vendor/a.py", "vendor|0|"), ("yarn.lock", "lockfile|0|"), ("bad.py", "encoding|0|"), ("nul.py", "binary|0|"), ("short.py", "too_small|0|"), ("x.min.js", "minified|0|"), ("gen.py", "generated|0|"),
    ("ok.py", "|0|value = compute(1)\n"), ("secret.py", '|1|api_key = "REDACTED"\n'), ("list.ipynb", "|0|[1, 2, 3, 4, 5, 6]"), ("odd.IPYNB", "|0|{not a notebook at all"),
    ("book.ipynb", "|0|" + json.dumps({"cells": [{"cell_type": "code", "source": "x", "outputs": [], "execution_count": None}, {"cell_type": "markdown", "source": "é"}]}, indent=1, ensure_ascii=False)),
))
def clean_rules(spark, sf_dir):
    """Every rule of cleaning in its order, with bad UTF-8, notebooks and redaction."""
    rows = [("vendor/a.py", b"x = 1\n" * 9), ("yarn.lock", b"x" * 40), ("bad.py", b"value = '\xc3\x28 broken'\n"), ("nul.py", b"abc\x00" * 9), ("short.py", b"x = 1"), ("x.min.js", b"var a = 1; var b = 2;"), ("gen.py", b"# Code generated by x\nx = 1\n"), ("ok.py", b"value = compute(1)\n"),
            ("secret.py", b'api_key = "Zx81kq0PpL22mm"\n'), ("list.ipynb", b"[1, 2, 3, 4, 5, 6]"), ("odd.IPYNB", b"{not a notebook at all"), ("book.ipynb", json.dumps(BOOK, ensure_ascii=False).encode())]
    d = spark.createDataFrame([(p, bytearray(b)) for p, b in rows], "path string, content binary")
    c = cleaning.clean(d)
    return c.select(F.col("path").alias("item"), F.concat_ws("|", "reason", F.col("secrets_redacted").cast("string"), F.coalesce("text", F.lit(""))).alias("value"))


@query(literal(("a.py", ""), ("b.py", "syntax"), ("c.py", "size"), ("d.rs", "extension"), ("LICENSE", "language"), ("e.json", ""), ("Dockerfile", ""), ("f.py", "syntax")))
def validation_rules(spark, sf_dir):
    rows = [("a.py", "def f():\n    return 1\n", "python"), ("b.py", "def f(:\n    return\n", "python"), ("c.py", "x = 1", "python"), ("d.rs", "fn main() {}", "rust"), ("LICENSE", "some licence text", "unknown"), ("e.json", '{"a": [1, 2]}', "json"), ("Dockerfile", "FROM scratch", "dockerfile"), ("f.py", "print 'two'\n\n", "python")]
    return cleaning.validate(spark.createDataFrame(rows, "path string, text string, language string")).select(F.col("path").alias("item"), F.col("reason").alias("value"))


@query(literal(("a", "python"), ("b", "go"), ("c", "python"), ("d", "javascript")))
def annotated_languages(spark, sf_dir):
    """A language is set only where there is none."""
    from siltstone.functions import languages

    rows = [("a", "", "x.py"), ("b", "go", "x.py"), ("c", "unknown", "y.py"), ("d", None, "z.js")]
    d = spark.createDataFrame(rows, "item string, language string, path string").withColumn("content", F.lit(""))
    return d.select("item", languages.annotate(F.col("language"), F.col("path"), F.col("content")).alias("value"))


@query(literal(("a.json", "json"), ("bad.json", "text"), ("run", "python"), ("go", "bash"), ("x", "dockerfile"), ("m.md", "markdown"), ("none", "unknown")))
def dataset_languages(spark, sf_dir):
    from siltstone.functions import languages

    rows = [("a.json", '{"a": 1}'), ("bad.json", "{a: "), ("run", "#!/usr/bin/env python3\nx = 1\n"), ("go", "#!/bin/bash\nls\n"), ("x", "FROM scratch\nRUN ls\n"), ("m.md", "# a"), ("none", "words")]
    return spark.createDataFrame(rows, "item string, content string").select("item", languages.detect_dataset(F.col("item"), F.col("content")).alias("value"))


# --- near duplicates ---------------------------------------------------------------------------------
BASE_TEXT = "def add(a, b):\n    return a + b\n" + "\n".join(f"value_{i} = compute({i * 37}, {i * 91})" for i in range(40))


@query(literal(
    ("hash of 'hello'", 0xA7B6EDA801E5347D), ("hash of 'a b'", 0xbb37dea5c027f928), ("grams of '  a  b '", 1), ("grams of 'abcdef'", 2), ("first permutations of 'hello'", "[555892909868921993, 1667678729606765966]"), ("blank", "[0, 0]"),
))
def minhash_values(spark, sf_dir):
    """BLAKE2b-64 of a shingle, big-endian, and (2i+1)h + i^2 + 7 modulo 2^61 - 1, worked out with Python's integers."""
    one = lambda t: int(dedup._base_hashes(t, "blake2b")[0])
    grams = lambda t: len(dedup._base_hashes(t, "blake2b"))
    d = spark.createDataFrame([("first permutations of 'hello'", "hello"), ("blank", " \n")], "item string, t string")
    sig = d.select("item", F.concat(F.lit("["), F.array_join(dedup.minhash_column(F.col("t"), 2), ", "), F.lit("]")).alias("value"))
    return sig.unionByName(facts(spark, [("hash of 'hello'", one("hello")), ("hash of 'a b'", one("a b")), ("grams of '  a  b '", grams("  a  b ")), ("grams of 'abcdef'", grams("abcdef"))]))


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(1 AS BIGINT)), (2, 1), (3, 3), (4, 1), (5, 5), (6, 5)) t(ord, \"group\")")
def near_duplicate_fixture(spark, sf_dir):
    """A text, its edit of one character, another text, a copy with other blanks, and two blank texts that are alike."""
    rows = [(1, BASE_TEXT), (2, BASE_TEXT.replace("add", "sum", 1)), (3, "\n".join(f"other line {i * i} of words" for i in range(60))), (4, BASE_TEXT.replace("\n", "\n\n")), (5, ""), (6, " \n ")]
    return dedup.near_duplicate_groups(spark.createDataFrame(rows, "ord long, content string"), threshold=0.7)


@query(literal(("equal", 1.0), ("half", 0.5), ("lengths differ", 0.0), ("empty", 0.0)))
def signature_similarities(spark, sf_dir):
    rows = [("equal", [1, 2], [1, 2]), ("half", [1, 2], [1, 3]), ("lengths differ", [1], [1, 2]), ("empty", [], [])]
    d = spark.createDataFrame(rows, "item string, a array<long>, b array<long>")
    return d.select("item", dedup.signature_similarity(F.col("a"), F.col("b")).cast("string").alias("value"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey % 499 AS a, l_partkey % 997 + 1000 AS b FROM lineitem WHERE l_linenumber = 1 AND l_quantity < 2),
 both_ways AS (SELECT a AS u, b AS v FROM e UNION ALL SELECT b, a FROM e), r(u, v) AS (SELECT u, u FROM both_ways UNION SELECT r.u, b.v FROM r JOIN both_ways b ON r.v = b.u)
SELECT CAST(u AS BIGINT) AS node, CAST(min(v) AS BIGINT) AS component FROM r GROUP BY u""")
def connected_groups(spark, sf_dir):
    """Components of a graph made from order lines."""
    li = table(spark, sf_dir, "lineitem").where("l_linenumber = 1 AND l_quantity < 2")
    return components.connected_components(li.select((F.col("l_orderkey") % 499).alias("u"), (F.col("l_partkey") % 997 + 1000).alias("v")))


# --- quality -----------------------------------------------------------------------------------------
SOURCE = '"""Module."""\nimport os\nimport sys\n\n\nclass A:\n    async def g(self, x: int) -> int:\n        """Doubles."""\n        return await h(x)\n\n\ndef add(a: int, b):\n    # a comment\n    if a > b and b:\n        return a\n    return a + b\n'


@query(literal(("functions", 2), ("classes", 1), ("typed_args", 2), ("total_args", 4), ("branches", 2), ("has_tests", "false"), ("imports", "os,sys"), ("cyclomatic", 3), ("async", 2), ("broken", "0,0,1")))
def python_signals(spark, sf_dir):
    """Counts of the syntax tree; text that does not parse has none."""
    s = dict(zip((x.split()[0] for x in python_code.SIGNAL_SCHEMA.split(", ")), python_code.signals(SOURCE), strict=True))
    bad = python_code.signals("def f(:\n")
    rows = [(k, s[k]) for k in ("functions", "classes", "typed_args", "total_args", "branches", "cyclomatic", "async")] + [("has_tests", str(s["has_tests"]).lower()), ("imports", ",".join(s["imports"])), ("broken", f"{bad[0]},{bad[1]},{bad[8]}")]
    return facts(spark, rows)


@query(literal(("python ok", "true"), ("python bad", "false"), ("go ok", "true"), ("go bad", "false"), ("crossed", "false"), ("bash", "NULL"), ("null", "NULL")))
def syntax_states(spark, sf_dir):
    rows = [("python ok", "python", "x = 1"), ("python bad", "python", "x ="), ("go ok", "go", "func f() { a[0] = (1) }"), ("go bad", "go", "func f() { a[0] = (1 }"), ("crossed", "rust", "([)]"), ("bash", "bash", "if ("), ("null", "python", None)]
    d = spark.createDataFrame(rows, "item string, language string, t string")
    return d.select("item", F.coalesce(quality.syntax_valid(F.col("language"), F.col("t")).cast("string"), F.lit("NULL")).alias("value"))


@query(literal(("python", "0.5|true"), ("sql", "0.25|true"), ("css", "1.0|true"), ("json", "0.0|false"), ("blank", "0.0|false"), ("javascript", "0.0|true")))
def comment_signals(spark, sf_dir):
    """Share of comment lines by language, and whether a file is documented."""
    rows = [("python", "python", '# a\nx = 1\n\n   # b\n"""doc"""\n'), ("sql", "sql", "-- a\nSELECT 1;\nSELECT 2;\nSELECT 3;"), ("css", "css", "/* a */\n"), ("json", "json", "{}"), ("blank", "python", " \n"), ("javascript", "javascript", "x();\n/** doc */\n")]
    d = spark.createDataFrame(rows, "item string, language string, t string")
    return d.select("item", F.concat_ws("|", F.round(quality.comment_ratio(F.col("language"), F.col("t")), 4).cast("string"), quality.has_docstring(F.col("language"), F.col("t")).cast("string")).alias("value"))


def _small_repos(spark):
    base = {"mod.py": SOURCE, "test_mod.py": "import mod\n\n\ndef test_add():\n    assert mod.add(1, 2) == 3\n", "README.md": "# Project\n\nWhat it does and why.\n"}
    rows = [("alpha", p, {"py": "python", "md": "markdown"}[p.rsplit(".", 1)[1]], t) for p, t in base.items()] + [("beta", "lib/x.go", "go", "package a\n// note\nfunc f() {}\n"), ("beta", "lib/y.go", "go", "package a\n// note\nfunc f() {}\n"), ("gamma", "notes.txt", "text", "words")]
    d = spark.createDataFrame(rows, "repository string, path string, language string, content string")
    return d.withColumn("hash", F.sha2("content", 256)).withColumn("size", F.octet_length("content").cast("long"))


@query("""SELECT * FROM (VALUES ('alpha', CAST(1 AS DOUBLE), CAST(0.75 AS DOUBLE), CAST(1 AS DOUBLE), CAST(0.25 AS DOUBLE), CAST(0.2083 AS DOUBLE), CAST(1 AS DOUBLE), CAST(1 AS DOUBLE), CAST(1 AS DOUBLE)), ('beta', 1.0, 0.5, 0.0, 0.2, 1.0, 1.0, 1.0, 0.5), ('gamma', 0.7, 0.0, 0.0, 0.0, 0.0, 0.7, 0.5, 1.0))
 t(repository, syntax_validity, documentation, tests, structure, comments, complexity, maintainability, duplicate_ratio)""")
def repo_signal_fixture(spark, sf_dir):
    s = quality.repository_signals(_small_repos(spark))
    return s.select("repository", *(F.col(c).cast("double").alias(c) for c in s.columns if c != "repository"))


@query("SELECT * FROM (VALUES ('alpha', CAST(79.33 AS DOUBLE)), ('beta', 64.9), ('gamma', 33.4)) t(repository, score)")
def repo_score_table(spark, sf_dir):
    """Repositories by score, the best first."""
    s = quality.repository_signals(_small_repos(spark)).withColumn("score", quality.quality_score())
    return s.select("repository", F.col("score").cast("double").alias("score")).orderBy(F.desc("score"))


@query(literal(("a", "35.75|hard"), ("b", "7.8|easy"), ("c", "8.0|medium"), ("d", "22.0|hard")))
def complexity_scores(spark, sf_dir):
    """1.6 depth + 0.8 cyclomatic + 0.5 imports + 2 classes + 1.2 async + functions + tokens / 600."""
    rows = [("a", 7, 3, ["x", "y"], 1, 2, 2, 8850), ("b", 3, 1, [], 1, 0, 0, 120), ("c", 3, 1, [], 1, 0, 0, 240), ("d", 10, 5, [], 1, 0, 0, 0)]
    d = spark.createDataFrame(rows, "item string, ast_depth int, cyclomatic int, imports array<string>, classes int, `async` int, functions int, n int")
    d = d.select("item", "imports", "n", F.struct("ast_depth", "cyclomatic", "classes", "async", "functions").alias("s"))
    c = F.round(quality.complexity(F.col("n")), 2)
    return d.select("item", F.concat_ws("|", c.cast("string"), quality.difficulty(c)).alias("value"))


@query(literal(("module", "67|16|1|os,sys"), ("empty", "34|1|0|"), ("wide", "27|1|0|")))
def file_quality_fixture(spark, sf_dir):
    rows = [("module", SOURCE, "python", True, True), ("empty", "", "python", False, False), ("wide", "x" * 200 + "\n", "text", False, False)]
    d = quality.file_quality(spark.createDataFrame(rows, "item string, text string, language string, has_readme boolean, has_license boolean"))
    return d.select("item", F.concat_ws("|", F.col("quality").cast("string"), F.col("n_lines").cast("string"), F.col("comment_lines").cast("string"), F.array_join("imports", ",")).alias("value"))


# --- tasks -------------------------------------------------------------------------------------------
FUNCTIONS = 'class A:\n    def one(self,\n            x):\n        """Adds one."""\n        y = x\n\n        return y + 1 + 2 + 3 + 4 + 5\n\n    def two(self):\n        \'\'\'Many\n        lines.\'\'\'\n        return 2\n\nasync def three():\n    pass\n\ndef four(): pass\n'


@query(literal(
    ("one", '        """Adds one."""\n        y = x\n\n        return y + 1 + 2 + 3 + 4 + 5|Adds one.'),
    ("two", "        '''Many\n        lines.'''\n        return 2|Many\n        lines."), ("four", "|"),
))
def python_functions(spark, sf_dir):
    """Functions by indentation with their bodies and docstrings."""
    return facts(spark, [(n, f"{body}|{doc}") for n, _, body, _, doc in python_code.functions(FUNCTIONS)])


def _function_files(spark):
    rows = [(1, "r", "a.py", "python", FUNCTIONS), (2, "r", "b.go", "go", FUNCTIONS), (3, "r", "c.py", "python", "x = 1\n"), (4, "r", "d.py", "python", None)]
    return spark.createDataFrame(rows, "ord long, repository string, path string, language string, content string").withColumns({"split": F.lit("train"), "license": F.lit("MIT")})


@query(literal(
    ("docstring_to_code 0", '\n    def two(self):\n    """Many\n        lines."""=>        \'\'\'Many\n        lines.\'\'\'\n        return 2'),
    ("docstring_to_code 1", '    def one(self,\n            x):\n    """Adds one."""=>        """Adds one."""\n        y = x\n\n        return y + 1 + 2 + 3 + 4 + 5'),
    ("code_to_explanation 0", "def one(self,\n            x):\n        \n        y = x\n\n        return y + 1 + 2 + 3 + 4 + 5=>Adds one."),
    ("code_to_explanation 1", "def two(self):\n        '''Many\n        lines.'''\n        return 2=>Many\n        lines."),
))
def function_tasks(spark, sf_dir):
    rows = []
    for build in (tasks.docstring_to_code, tasks.code_to_explanation):
        rows += [(f"{r.task} {i}", f"{r.input}=>{r.target}") for i, r in enumerate(sorted(build(_function_files(spark)).collect(), key=lambda r: r.input))]
    return facts(spark, rows)


@query("SELECT * FROM (VALUES (CAST(5 AS BIGINT), 'pkg/calc.py', 'def t(): pass # last'), (6, 'pkg/io.py', 'def t_io(): pass')) t(ord, path, target)")
def unit_test_fixture(spark, sf_dir):
    """Sources beside the tests that their names point to; of equal names the last one counts."""
    rows = [(1, "pkg/calc.py", "x = 1"), (2, "tests/test_calc.py", "def t(): pass # first"), (3, "spec/test_calc.py", "def t(): pass # last"), (4, "tests/io_test.py", "def t_io(): pass"), (5, "pkg/calc.py", "x = 2"), (6, "pkg/io.py", "y = 1"), (7, "pkg/free.py", "z = 1")]
    d = spark.createDataFrame(rows, "ord long, path string, content string").withColumns({k: F.lit(v) for k, v in {"language": "python", "repository": "r", "split": "train", "license": "MIT"}.items()})
    u = tasks.unit_tests(d)
    return u.join(d.select("ord", "path", "content"), (u["path"] == d["path"]) & u["input"].endswith(d["content"])).select("ord", u["path"], "target")


EXAMPLE = {"task": "t", "input": "é", "target": "", "text": "a\"b", "language": "go", "repository": "r", "path": "p", "split": "train", "license": "MIT"}


@query("SELECT sha256('{\"input\": \"\\u00e9\", \"language\": \"go\", \"license\": \"MIT\", \"path\": \"p\", \"repository\": \"r\", \"split\": \"train\", \"target\": \"\", \"task\": \"t\", \"text\": \"a\\\"b\"}') AS key")
def example_keys(spark, sf_dir):
    """The hash of an example's JSON with sorted keys and escaped letters, in whose order examples are taken."""
    return spark.createDataFrame([tuple(EXAMPLE.values())], list(EXAMPLE)).select(tasks.example_key().alias("key"))


@query(literal(("next_token", "5"), ("completion", "5"), ("capped next_token", "2"), ("capped completion", "2"), ("within budget", "6"), ("all within budget", "12")))
def task_mix_fixture(spark, sf_dir):
    """Equal shares of two tasks, the cap on examples, and the budget of characters."""
    rows = [(i, f"f{i}.py", f"value_{i} = compute({i}) + other({i}) + more_of_it({i})\n" * (1 if i else 150)) for i in range(6)]
    d = spark.createDataFrame(rows, "ord long, path string, content string").withColumns({k: F.lit(v) for k, v in {"language": "python", "repository": "r", "split": "train", "license": "MIT"}.items()}).withColumn("hash", F.sha2("content", 256))
    share = {"next_token": 0.5, "completion": 0.5, "fim": 0.0}
    count = lambda x: {r.task: r["count"] for r in x.groupBy("task").count().collect()}
    whole, capped = count(tasks.task_mix(d, share)), count(tasks.task_mix(d, share, max_examples=4))
    every = tasks.candidates(d, share, budget=1 << 30)
    return facts(spark, [*whole.items(), *((f"capped {k}", v) for k, v in capped.items()), ("within budget", tasks.candidates(d, {"next_token": 1.0}, budget=10_000).count()), ("all within budget", every.count())])


@query(literal(("train", 0.5), ("test", 0.25), ("dev", 0.25), ("zero", "ValueError"), ("negative", "ValueError")))
def ratio_rules(spark, sf_dir):
    from siltstone.config import normalize

    rows = list(normalize({"train": 2, "test": 1, "dev": 1}).items())
    for name, bad in (("zero", {"a": 0.0}), ("negative", {"a": 2.0, "b": -1.0})):
        try:
            rows.append((name, normalize(bad)))
        except ValueError as e:
            rows.append((name, type(e).__name__))
    return facts(spark, rows)


@query(literal(("python shuffle of 8, seed 3", "[0, 5, 7, 2, 1, 6, 4, 3]"), ("held out of 200", 4), ("held out of 10", 1), ("held out of 0", 0), ("same again", "True")))
def seeded_orders(spark, sf_dir):
    """The generator's own order for short lists, and a seeded hold-out of a share, at least one row."""
    out = lambda n: splitting.holdout(spark.range(n).withColumnRenamed("id", "idx"), 0.02).where("is_val")
    again = sorted(r.idx for r in out(200).collect()) == sorted(r.idx for r in out(200).collect())
    return facts(spark, [("python shuffle of 8, seed 3", splitting.shuffled_indices(8, 3)), *((f"held out of {n}", out(n).count()) for n in (200, 10, 0)), ("same again", again)])


@query("""SELECT chunk_id, row_number() OVER (ORDER BY CASE meta.difficulty WHEN 'easy' THEN 0 WHEN 'hard' THEN 2 ELSE 1 END, chunk_id) - 1 AS pos FROM chunks""")
def train_order(spark, sf_dir):
    """Chunks from easy to hard, in their own order within a difficulty; unknown ones count as medium."""
    c = table(spark, sf_dir, "chunks").select("chunk_id", "meta.difficulty")
    return ordering.global_positions(c, [F.coalesce(quality.difficulty_rank(F.col("difficulty")), F.lit(1)), F.col("chunk_id")]).select("chunk_id", "pos")


@query(f"""WITH t AS (SELECT ord, token_ids, len(token_ids) AS n FROM records WHERE len(token_ids) > 0), p AS (SELECT *, coalesce(sum(n) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM t),
 f AS (SELECT s + i - 1 AS g, token_ids[i] AS id FROM (SELECT s, token_ids, unnest(range(1, n + 1)) AS i FROM p)),
 k AS (SELECT CASE WHEN count(*) >= {q.SEQ} THEN (count(*) - {q.SEQ}) // 448 + 1 ELSE 0 END AS whole, count(*) AS total FROM f),
 c AS (SELECT unnest(range(0, CAST(whole + CASE WHEN total - whole * 448 > 0 THEN 1 ELSE 0 END AS BIGINT))) AS chunk_id FROM k),
 j AS (SELECT c.chunk_id, g, id FROM c JOIN f ON g >= c.chunk_id * 448 AND g < c.chunk_id * 448 + {q.SEQ})
SELECT chunk_id, count(*) AS n_ids, CAST(sum((g - chunk_id * 448 + 1) * id) AS BIGINT) AS weighted FROM j GROUP BY chunk_id""")
def pack_overlapping(spark, sf_dir):
    """Chunks that share 64 ids with the one before."""
    r = table(spark, sf_dir, "records").select("ord", "token_ids")
    c = chunking.pack_stream(r, [F.col("ord")], seq_len=q.SEQ, overlap=64, pad=0)
    ids = F.slice("token_ids", F.lit(1), F.lit(q.SEQ) - F.col("n_pad"))
    weighted = F.aggregate(F.transform(ids, lambda x, i: (i + 1).cast("long") * x), F.lit(0).cast("long"), lambda a, v: a + v)
    return c.select("chunk_id", F.size(ids).cast("long").alias("n_ids"), weighted.alias("weighted"))


# --- tokenizer ---------------------------------------------------------------------------------------
LINES = ["low low low lower", "lowest newer newer", "é low"]


@query(literal(
    ("merges", "[(108, 111), (256, 119)]"), ("pieces of x1  y", "x|1| | y"), ("low", "[257]"), ("decoded", "low é <|end|> x"), ("special", "[258]"), ("again", "[258]"), ("size", 259), ("unknown id", "ValueError"), ("bad bytes", "�"), ("reloaded", "True"), ("hash differs by version", "True"),
))
def bpe_fixture(spark, sf_dir):
    """Two merges learnt by hand: l+o (7 times, the first of equals), then lo+w; specials, decoding, saving."""
    d = spark.createDataFrame(list(enumerate(LINES)), "ord long, text string")
    t = bpe.train(d, 258)
    t.add_specials(("<|end|>",))
    before = t.specials["<|end|>"]
    t.add_specials(("<|end|>",))
    path = os.path.join(folder(spark, "bpe"), "tok.json")
    t.save(path)
    back = bpe.Bpe.load(path)
    try:
        t.decode([99_999])
        unknown = "none"
    except ValueError as e:
        unknown = type(e).__name__
    text = "low é <|end|> x"
    ids = [r[0] for r in d.limit(0).select(bpe.encode_column(t, d)).collect()]
    rows = [("merges", list(t.merges)), ("pieces of x1  y", "|".join(bpe._SPLIT.findall("x1  y"))), ("low", t.encode("low")), ("decoded", t.decode(t.encode(text))), ("special", [before]), ("again", t.encode("<|end|>")), ("size", t.vocab_size), ("unknown id", unknown), ("bad bytes", t.decode([0xC3])),
            ("reloaded", back.encode(text) == t.encode(text) and back.merges == t.merges and not ids), ("hash differs by version", t.fingerprint(1) == back.fingerprint(1) != t.fingerprint(2))]
    return facts(spark, rows)


@query("""SELECT doc_id, sha256(array_to_string([258] || list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::INT) || [256], ',')) AS ids, strlen(text) + 2 AS n FROM documents WHERE text <> ''""")
def encoded_records(spark, sf_dir):
    """Byte ids between the opening and closing id."""
    d = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", "text")
    ids = dataset_plan._ids(d, None, DatasetConfig())
    return d.select("doc_id", F.sha2(F.array_join(ids, ","), 256).alias("ids"), F.size(ids).cast("long").alias("n"))


@query("""WITH w AS (SELECT unnest(regexp_extract_all(text, ' ?[A-Za-z]+| ?[0-9]+')) AS p FROM documents WHERE NOT contains(text, '''')) SELECT p AS piece, count(*) AS n FROM w GROUP BY p""")
def counted_pieces(spark, sf_dir):
    """Words and numbers among the pre-tokens, with the blank before them; documents with an apostrophe are left to the model in the tests."""
    d = table(spark, sf_dir, "documents").where(~F.col("text").contains("'")).select(F.col("doc_id").alias("ord"), "text")
    return bpe.pieces_of(d).where(F.col("piece").rlike("[A-Za-z0-9]")).select("piece", "n")


# --- pipelines on fixtures -----------------------------------------------------------------------------
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy"
GPL = "GNU General Public License\nVersion 3, 29 June 2007"


def _tree(spark) -> str:
    base = {"mod.py": SOURCE, "pkg/__init__.py": '"""The package of {}."""\nfrom mod import add\n', "test_mod.py": "import mod\n\n\ndef test_add():\n    assert mod.add(1, 2) == 3  # {}\n", "README.md": "# {}\n\nWhat it does and why.\n"}
    files: dict[str, str | bytes] = {}
    for repo, law in (("alpha", MIT), ("beta", MIT), ("gplrepo", GPL)):
        files |= {f"{repo}/{p}": t.replace("{}", repo).replace("Module", f"Module {repo}") for p, t in base.items()} | {f"{repo}/LICENSE-TEXT": law}
    return put(folder(spark, "tree"), files | {"alpha/node_modules/x.js": "var x = 1; // vendored", "alpha/b.bin": b"\0\1" * 20, "beta/copy.py": files["alpha/mod.py"]})


def _ingested(spark, cfg):
    root = _tree(spark)
    listed = registry.SourceList([registry.Source(n, "local", r) for n, r in registry.discover(root)] + [registry.Source("gone", "local", root + "/missing")])
    return corpus_plan.ingest(registry.ingest(spark, listed, root), cfg, "2024-01-01")


@query(literal(
    ("alpha/LICENSE-TEXT", "MIT|"), ("alpha/README.md", "MIT|"), ("alpha/mod.py", "MIT|"), ("alpha/pkg/__init__.py", "MIT|"), ("alpha/test_mod.py", "MIT|"), ("alpha/node_modules/x.js", "MIT|vendor"), ("alpha/b.bin", "MIT|binary"),
    ("beta/LICENSE-TEXT", "MIT|duplicate_file"), ("beta/README.md", "MIT|"), ("beta/copy.py", "MIT|duplicate_file"), ("beta/mod.py", "MIT|"), ("beta/pkg/__init__.py", "MIT|"), ("beta/test_mod.py", "MIT|"),
    ("gplrepo/LICENSE-TEXT", "GPL-3.0-or-later|license"), ("gplrepo/README.md", "GPL-3.0-or-later|license"), ("gplrepo/mod.py", "GPL-3.0-or-later|license"), ("gplrepo/pkg/__init__.py", "GPL-3.0-or-later|license"), ("gplrepo/test_mod.py", "GPL-3.0-or-later|license"),
))
def corpus_fixture(spark, sf_dir):
    """Three repositories through ingestion and the corpus pipeline: licence and reason of every file."""
    cfg = CorpusConfig(min_quality=0, dedup_near=False)
    got = corpus_plan.process(_ingested(spark, cfg), cfg).all_files
    return got.select(F.concat_ws("/", "repository", "path").alias("item"), F.concat_ws("|", "license", "drop_reason").alias("value"))


@query(literal(("files", 9), ("repositories", "alpha,beta"), ("MIT", 9), ("histogram", 2), ("rankings", 2), ("vendor", 1), ("duplicate_file", 2), ("low quality", "low_quality"), ("flags", "warn,bad"), ("html", "True")))
def corpus_report_fixture(spark, sf_dir):
    """The report of the corpus fixture, a pipeline whose quality nobody reaches, and the health flags."""
    cfg = CorpusConfig(min_quality=0, dedup_near=False)
    files = _ingested(spark, cfg)
    got = corpus_plan.process(files, cfg)
    r = report.corpus_report(got.files, got.repos, got.drops)
    strict = corpus_plan.process(files, CorpusConfig(min_quality=101.0, dedup_near=False))
    low = {x.drop_reason for x in strict.drops.collect()} & {"low_quality"}
    out = folder(spark, "report")
    paths = report.write_report(r, out)
    flags = report.health_flags({"packing_efficiency_pct": 80.0, "files_kept": 0, "chunk_duplicate_pct": 0.0, "avg_quality": 50})
    rows = [("files", r["dataset_size"]["files"]), ("repositories", ",".join(sorted(x["repository"] for x in r["repository_rankings"]))), ("MIT", r["license_distribution"]["MIT"]), ("histogram", sum(r["quality_histogram"])), ("rankings", len(r["repository_rankings"])),
            ("vendor", r["drop_reasons"]["vendor"]), ("duplicate_file", r["duplicate_statistics"]["duplicate_file"]), ("low quality", ",".join(low)), ("flags", ",".join(k for k, _ in flags)), ("html", all(os.path.getsize(p) > 0 for p in paths))]
    return facts(spark, rows)


def _dataset_tree(spark) -> str:
    long = "def f{0}(values: list) -> int:\n    total = 0\n    for value in values:\n        total += value * {0}\n    return total\n"
    return put(folder(spark, "data"), {"r/mod.py": SOURCE, "r/dup.py": SOURCE, "r/test_mod.py": "def test_a():\n    assert 1 + 1 == 2\n", "r/engine.py": "".join(long.format(i) for i in range(4)), "r/proto_pb2.py": "# Code generated by x\nx = 1\n", "r/broken.py": "def f(:\n    x\n", "r/empty.py": " \n",
                                     "r/README.md": "# Title\n\nWords.\n", "r/config.json": '{"a": [1, 2]}\n', "r/Dockerfile": "FROM scratch\n", "r/LICENSE": "short licence text\n", "r/node_modules/junk.py": "x = 1\n" * 9, "r/blob.bin": b"\0\1" * 9})


@query(literal(
    ("binary", 1), ("duplicate", 1), ("empty", 1), ("generated", 1), ("language", 1), ("syntax", 1), ("vendor", 1), ("kept code", "r/Dockerfile,r/README.md,r/config.json,r/dup.py,r/engine.py,r/test_mod.py"), ("tokens fit", "True"), ("fim paths", "True"), ("lock", "[]"), ("other lock", "True"), ("empty", "EmptyDatasetError"),
    ("shards", "True"), ("compression", "True"), ("run", "tokenizer"), ("snapshot", "64"), ("by split", "train"), ("no quality", "EmptyDatasetError"),
))
def dataset_fixture(spark, sf_dir):
    """One repository through the dataset pipeline: drops, kept files, shards, lock, report, exports."""
    root = _dataset_tree(spark)
    cfg = DatasetConfig(seq_len=64, vocab_size=bpe.BYTE_VOCAB, shard_max_bytes=640, min_file_bytes=8)
    raw = registry.with_ord(registry.scan_folder(spark, f"{root}/r", "r")).withColumnRenamed("repository", "repo")
    got = dataset_plan.build(raw, cfg)
    out = folder(spark, "dataset")
    m = dataset_plan.write(got, out, cfg, now="2024-01-01T00:00:00", source_root=root)
    kept = sorted(f"{r.repo}/{r.path}" for r in got.records.where("kind = 'code'").select("repo", "path").collect())
    fim = [r.path for r in got.records.where("kind = 'fim'").select("path").collect()]
    p = got.packing.first()

    def fails(call):
        try:
            call()
        except dataset_plan.EmptyDatasetError as e:
            return type(e).__name__
        return "none"

    split = raw.withColumnRenamed("repo", "repository").withColumns({"split": F.lit("train"), "drop_reason": F.lit("")}).withColumn("content", F.when(~F.col("path").contains("blob"), F.col("content").cast("string")))
    by = dataset_plan.export_by_split(split, folder(spark, "by-split"), cfg)
    lock = m["lock"]
    rows = [*((r.reason, r.n) for r in got.drops.collect()), ("kept code", ",".join(kept)), ("tokens fit", p.real_tokens + p.pad_tokens == p.capacity_tokens), ("fim paths", bool(fim) and all("#fim" in x for x in fim)), ("lock", dataset_plan.verify_lock(lock, cfg, None)),
            ("other lock", {"seed", "config.seq_len"} <= set(dataset_plan.verify_lock(lock, DatasetConfig(seq_len=65, seed=1), None))), ("empty", fails(lambda: dataset_plan.build(raw.where("path = 'blob.bin'"), cfg))), ("shards", m["n_shards"] > 1 and all(s["checksum_ok"] for s in m["shards"])),
            ("compression", m["stats"]["compression_ratio"] == round(m["stats"]["raw_bytes"] / (p.real_tokens * 2), 3)), ("run", "tokenizer" if dataset_plan.experiment_metadata("x", m, seed=1)["tokenizer_hash"] == dataset_plan.tokenizer_hash(None) else "none"), ("snapshot", lock["config"]["seq_len"]), ("by split", ",".join(by)),
            ("no quality", fails(lambda: dataset_plan.build(raw, DatasetConfig(seq_len=64, vocab_size=bpe.BYTE_VOCAB, min_quality=101))))]
    return facts(spark, rows)


@query(literal(("a.py#fim0", "True"), ("a.py#fim1", "True"), ("shares", "True"), ("other language", 0)))
def fim_fixture(spark, sf_dir):
    """Functions in prefix-suffix-middle form: the parts make the function again, the middle lies where it must."""
    code = "".join(f"def f{i}(values):\n    total = {i}\n    for value in values:\n        total += value\n    return total\n\n\n" for i in range(2))
    d = spark.createDataFrame([(1, "r", "a.py", "python", code), (2, "r", "b.go", "go", code)], "ord long, repo string, path string, language string, text string")
    rows, inside = [], True
    for r in tasks.fim_records(d, rate=1.0).collect():
        head, _, rest = r.text.partition(python_code.SUFFIX)
        tail, _, middle = rest.partition(python_code.MIDDLE)
        whole = head.removeprefix(python_code.PREFIX) + middle + tail
        n, a = len(whole), len(head) - len(python_code.PREFIX)
        inside &= int(0.2 * n) <= a <= int(0.5 * n) and 1 <= len(middle) <= int(0.4 * n) + 1
        rows.append((r.path, whole in code and r.sub_ord == int(r.path[-1]) + 1))
    return facts(spark, [*rows, ("shares", inside), ("other language", sum(p.startswith("b") for p, _ in rows))])
