import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from siltstone import cli
from siltstone.config import CorpusConfig, DatasetConfig
from siltstone.functions import bpe
from siltstone.operators import quality
from siltstone.plans import corpus, dataset, report
from siltstone.sources import registry, shards, store
from siltstone.streaming import stateful

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy"
GPL = "GNU General Public License\nVersion 3, 29 June 2007"
MOD = '"""Module."""\nimport os\n\n\ndef add(a: int, b: int) -> int:\n    """Adds."""\n    # a comment\n    if a > b:\n        return a\n    return a + b\n'


def write(root, files):
    for path, body in files.items():
        target = os.path.join(root, path)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(target, "wb") as f:
            f.write(body if isinstance(body, bytes) else body.encode())


@pytest.fixture
def tree(tmp_path):
    root = str(tmp_path / "in")
    base = {"mod.py": MOD, "test_mod.py": "import mod\n\n\ndef test_add():\n    assert mod.add(1, 2) == 3\n", "README.md": "# Project\n\nWhat it does and why.\n"}
    write(root, {f"alpha/{k}": v.replace("Module", "Alpha") for k, v in base.items()} | {"alpha/LICENSE": MIT, "alpha/node_modules/x.js": "var x = 1; // vendored", "alpha/b.bin": b"\0\1" * 20, "alpha/pkg/__init__.py": "from mod import add  # of the package\n", "alpha/.github/x.yml": "on: [push, pull_request]\n"})
    os.symlink(os.path.join(root, "alpha/mod.py"), os.path.join(root, "alpha/link.py"))
    write(root, {f"beta/{k}": v.replace("Module", "Beta module").replace("a + b", "b + a") for k, v in base.items()} | {"beta/LICENSE": MIT, "beta/util.py": "def util(value):\n    return value * 2\n"})
    write(root, {f"gplrepo/{k}": v + "# gpl\n" for k, v in base.items()} | {"gplrepo/LICENSE": GPL})
    return root


def test_corpus_pipeline(spark, tree, tmp_path):
    sources = registry.SourceList([registry.Source(id=n, kind="local", location=r) for n, r in registry.discover(tree)])
    sources.add(registry.Source(id="gone", kind="local", location=tree + "/missing"))
    sources.add(registry.Source(id="off", kind="local", location=tree, enabled=False))
    raw = registry.ingest(spark, sources, str(tmp_path / "stage"))
    cfg = CorpusConfig(min_quality=0, split_ratios={"train": 0.8, "validation": 0.1, "test": 0.1})
    got = corpus.process(corpus.ingest(raw, cfg, "2024-01-01"), cfg)
    drops = {r.drop_reason: r.n for r in got.drops.collect()}
    assert drops["vendor"] >= 1 and drops["binary"] >= 1 and drops["license"] >= 3
    files = got.files.collect()
    assert {"pkg/__init__.py", ".github/x.yml"} <= {f.path for f in files} and "link.py" not in {f.path for f in got.all_files.collect()}
    assert {f.repository for f in files} == {"alpha", "beta"} and all(f.drop_reason == "" and f.created_at == "2024-01-01" for f in files)
    assert len({f.hash for f in files}) == len(files)
    repos = {r.repository: r for r in got.repos.collect()}
    assert 20 < repos["alpha"].quality_score <= 100 and repos["beta"].n_files == sum(f.repository == "beta" for f in files)
    assert sum(repos["beta"].languages.values()) == repos["beta"].n_files
    r = report.corpus_report(got.files, got.repos, got.drops)
    assert r["dataset_size"]["files"] == len(files) and sum(r["quality_histogram"]) == 2
    paths = report.write_report(r, str(tmp_path / "rep"))
    assert all(os.path.getsize(p) for p in paths)
    strict = corpus.process(corpus.ingest(raw, cfg), CorpusConfig(min_quality=101.0))
    assert strict.files.count() == 0 and "low_quality" in {x.drop_reason for x in strict.drops.collect()}


def test_stores(spark, tmp_path):
    rows = [("r", "a/../b.py", "train", "", "x = 1", 1), ("r", "c.py", "test", "", "é", 2), ("r", "d.py", "train", "vendor", "z", 3)]
    df = spark.createDataFrame(rows, "repository string, path string, split string, drop_reason string, content string, size bigint")
    store.write_records(df, str(tmp_path / "rec"))
    back = store.read_records(spark, str(tmp_path / "rec"))
    assert back.count() == 2 and {r.content for r in back.collect()} == {"x = 1", "é"}
    assert store.read_records(spark, str(tmp_path / "none")).count() == 0
    assert {r.split: r.n for r in store.write_by_split(df, str(tmp_path / "split")).collect()} == {"train": 1, "test": 1}
    store.write_parquet(df, str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq")).columns == sorted(df.columns)
    assert store.write_raw(df, str(tmp_path / "raw")) == 2 and (tmp_path / "raw/train/r/a/b.py").read_text() == "x = 1"
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/x.json").write_text("{broken\n")
    with pytest.raises(Exception):
        store.read_records(spark, str(tmp_path / "bad")).collect()


def test_dataset_pipeline(spark, tree, tmp_path):
    raw = None
    for name, root in registry.discover(tree):
        d = registry.scan_folder(spark, root, name)
        raw = d if raw is None else raw.unionByName(d)
    raw = registry.with_ord(raw).withColumnRenamed("repository", "repo")
    cfg = DatasetConfig(seq_len=64, vocab_size=bpe.BYTE_VOCAB, shard_max_bytes=640)
    result = dataset.build(raw, cfg)
    p = result.packing.first()
    assert p.real_tokens + p.pad_tokens == p.capacity_tokens
    kinds = {r.kind for r in result.records.collect()}
    assert kinds == {"code", "fim"}
    out = str(tmp_path / "out")
    m = dataset.write(result, out, cfg, now="2024-01-01T00:00:00")
    assert m["n_shards"] > 1 and all(s["checksum_ok"] for s in m["shards"]) and m["lock"]["creation_time"] == "2024-01-01T00:00:00"
    assert os.path.exists(os.path.join(out, "report.html"))
    back = shards.read_shards(spark, out)
    assert [r.token_ids for r in back.orderBy("idx").collect()] == [r.token_ids for r in result.chunks.orderBy("chunk_id").collect()]
    assert shards.verify_shards(spark, out).where("NOT ok").count() == 0
    first = os.path.join(out, m["shards"][0]["file"])
    s = shards.Shard(first)
    assert len(s) == m["shards"][0]["chunks"] and list(s[-1]) == list(s[len(s) - 1]) and s.metadata(0) == {}
    data = bytearray(open(first, "rb").read())
    data[80] ^= 1
    open(first, "wb").write(bytes(data))
    assert not shards.Shard(first).verify() and shards.verify_shards(spark, out).where("NOT ok").count() == 1
    assert dataset.verify_lock(m["lock"], cfg, None) == []
    assert set(dataset.verify_lock(m["lock"], DatasetConfig(seq_len=65, seed=1), None)) >= {"seed", "config.seq_len"}
    with pytest.raises(dataset.EmptyDatasetError):
        dataset.build(raw.where("path = 'b.bin'"), cfg)


def test_shard_rejects(tmp_path):
    (tmp_path / "x.rds").write_bytes(b"nothing of the kind" * 10)
    with pytest.raises(ValueError):
        shards.Shard(str(tmp_path / "x.rds"))
    with pytest.raises(ValueError):
        shards.write_shard(str(tmp_path / "y.rds"), [([70000], {})], seq_len=1, vocab_size=300)


def test_layouts_and_sources(tmp_path):
    write(str(tmp_path / "flat"), {"a.py": "x"})
    write(str(tmp_path / "mixed"), {"a.py": "x", "lib/b.py": "y", "node_modules/c.js": "z"})
    assert [n for n, _ in registry.discover(str(tmp_path / "flat"))] == ["flat"]
    assert [n for n, _ in registry.discover(str(tmp_path / "mixed"))] == ["mixed", "lib"]
    with pytest.raises(registry.SourceError):
        registry.discover(str(tmp_path / "none"))
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("top-main/src/a.py", "x")
        z.writestr("top-main/docs/b.md", "y")
        z.writestr("top-main/../../evil", "e")
    root = registry.stage_zip(str(tmp_path / "z.zip"), registry.Source(id="gh:o/n", kind="github", location="o/n", subpath="src"), str(tmp_path / "st"))
    assert [f for _, _, fs in os.walk(root) for f in fs] == ["a.py"]
    with pytest.raises(ValueError):
        registry.Source(id="x", kind="ftp", location="y")
    rows = registry.SourceList.from_rows([{"id": "a", "kind": "http", "location": "u", "extra": 1, "languages": ["go"]}])
    assert rows.by_kind("http")[0].languages == ("go",) and rows.enabled()


def test_text_sources(spark, tmp_path):
    df = spark.createDataFrame([(" ", "code1"), ("c", None), (None, None)], "content string, code string")
    assert [r.text for r in registry.dataset_texts(df).collect()] == ["code1", "c"]
    (tmp_path / "chat.jsonl").write_text(json.dumps({"messages": [{"role": "u", "content": "hi"}, {"role": "a", "content": "yo"}]}) + "\n")
    (tmp_path / "fim.jsonl").write_text(json.dumps({"psm": "p"}) + "\n\n")
    (tmp_path / "instruction.jsonl").write_text(json.dumps({"instruction": "do", "output": "done"}) + "\n")
    (tmp_path / "reasoning.jsonl").write_text(json.dumps({"problem": "p", "reasoning": "r", "solution": "s", "tests": ["t1", "t2"]}) + "\n")
    assert {r.text for r in registry.tokenizer_corpus(spark, str(tmp_path)).collect()} == {"hi\nyo", "p", "do\ndone", "p\nr\ns\nt1\nt2"}
    (tmp_path / "a.txt").write_text("text")
    (tmp_path / "b.txt").write_text("  \n")
    assert [r.text for r in registry.text_files(spark, str(tmp_path / "*.txt")).collect()] == ["text"]


def test_train_log_and_catalogue(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"step": 1, "kind": "train", "loss": 2.0}\n{"step": 2, "kind": "eval", "val_loss": 1.0}\n{"step": 3, "kind": "eval", "val_loss": 0.5}\n{"step": 4, "loss": 1.0}\n')
    evals, rest = store.read_train_log(spark, str(tmp_path / "log.jsonl"))
    assert evals.count() == 2 and rest.count() == 2 and abs(store.best_perplexity(evals).first()[0] - 1.6487212707) < 1e-9
    found = registry.default_sources()
    assert len(found.sources) == 10 and len(found.enabled()) == 8 and found.to_df(spark).count() == 10
    assert dataset.experiment_metadata("r", {"lock": {"tokenizer_hash": "h"}}, seed=3)["tokenizer_hash"] == "h"


def test_scratch_tables_can_be_deleted(spark):
    from siltstone.session import clean_scratch, materialize

    df = materialize(spark.range(3), "gone")
    path = df.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and clean_scratch(spark) >= 1 and not os.path.exists(path)


def test_file_quality(spark):
    rows = [(MOD, "python", True, True), ("", "python", False, False), ("x" * 200 + "\n", "text", False, False)]
    got = quality.file_quality(spark.createDataFrame(rows, "text string, language string, has_readme boolean, has_license boolean")).collect()
    assert got[0].quality > got[1].quality and got[0].comment_lines == 1 and got[0].n_lines == 10 and got[1].n_lines == 1 and got[0].imports == ["os"]
    d = spark.createDataFrame([(7.9,), (8.0,), (22.0,)], "s double").select(quality.difficulty(F.col("s"))).collect()
    assert [r[0] for r in d] == ["easy", "medium", "hard"]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([(1, "a", [1, 2, 3], "x"), (2, "a", [4, 5], "x"), (3, "b", [9], "")], "ord long, lane string, token_ids array<int>, reason string").write.parquet(src)
    stream = spark.readStream.schema("ord long, lane string, token_ids array<int>, reason string").parquet(src)
    q = stateful.pack_stream(stream, "lane", 2).writeStream.format("memory").queryName("packed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.lane, r.chunk_no, r.token_ids) for r in spark.sql("select * from packed order by 1, 2").collect()] == [("a", 0, [1, 2]), ("a", 1, [3, 4])]
    q = stateful.reason_counts(stream, "reason").writeStream.format("memory").queryName("reasons").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.reason: r.n for r in spark.sql("select * from reasons").collect()} == {"x": 2, "": 1}
    q = stateful.write_batches(stateful.dedup_stream(stream.select("reason"), ["reason"]), str(tmp_path / "o"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2
    e = stateful.EarlyStopping(2)
    assert [e.update(v) for v in (3, 2, 2.5, 2.1)] == [False, False, False, True]


def test_windowed_stream(spark, tmp_path):
    spark.sql("select timestamp_ntz'2024-01-01 00:10:00' ts, 'a' k union all select timestamp_ntz'2024-01-01 00:50:00', 'a' union all select timestamp_ntz'2024-01-01 09:00:00', 'a'").write.parquet(str(tmp_path / "e"))
    s = stateful.event_time(spark.readStream.schema("ts timestamp_ntz, k string").parquet(str(tmp_path / "e")))
    q = stateful.windowed_counts(s, "ts", "k").writeStream.format("memory").queryName("win").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.n for r in spark.sql("select * from win").collect()} == {2}


def test_command_line(spark, tree, tmp_path, monkeypatch):
    monkeypatch.setattr("siltstone.session.local_session", lambda *a, **k: spark)
    assert cli.main(["corpus-build", tree, str(tmp_path / "c"), "--min-quality", "0"]) == 0
    assert json.load(open(tmp_path / "c/report.json"))["dataset_size"]["files"] > 0
    assert cli.main(["dataset-build", tree, str(tmp_path / "d"), "--seq-len", "64", "--vocab-size", "259"]) == 0
    assert cli.main(["dataset-verify", str(tmp_path / "d")]) == 0
    for how in ("raw", "jsonl", "parquet", "rds"):
        assert cli.main(["corpus-export", str(tmp_path / "c"), str(tmp_path / ("x" + how)), "--format", how, "--seq-len", "64", "--vocab-size", "259"]) == 0
    assert cli.main(["corpus-stats", str(tmp_path / "c")]) == 0 and cli.main(["corpus-score", tree, str(tmp_path / "s"), "--json"]) == 0 and cli.main(["corpus-clean", tree, str(tmp_path / "k")]) == 0
    assert cli.main(["dataset-show", str(tmp_path / "d"), "--stats"]) == 0 and cli.main(["dataset-show", str(tmp_path / "d"), "--chunk", "-1"]) == 0 and cli.main(["dataset-show", str(tmp_path / "d"), "--chunk", "99999"]) == 1
    (tmp_path / "src.json").write_text(json.dumps([{"id": "a", "kind": "local", "location": tree}, {"id": "b", "kind": "local", "location": tree + "/none"}]))
    assert cli.main(["corpus-download", str(tmp_path / "src.json"), str(tmp_path / "st")]) == 0
    write(str(tmp_path / "e"), {"r/x.bin": b"\0"})
    assert cli.main(["dataset-build", str(tmp_path / "e"), str(tmp_path / "f")]) == 2


def test_scan_needs_one_plan_for_many_folders(spark, tmp_path):
    for i in range(40):
        write(str(tmp_path), {f"r{i}/_{i}.py": "x", f"r{i}/a/__init__.py": "y"})
    d = registry.scan_folders(spark, [(f"r{i}", str(tmp_path / f"r{i}"), "local", "MIT") for i in range(40)])
    assert d.count() == 80 and {r.license_hint for r in d.collect()} == {"MIT"}
    assert d._jdf.queryExecution().toString().count("Union") == 0
    with pytest.raises(registry.SourceError):
        registry.ingest(spark, registry.SourceList([registry.Source("a", "local", str(tmp_path / "none"))]), str(tmp_path))
