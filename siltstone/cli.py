"""Command line: ``python -m siltstone.cli corpus|dataset|tokenizer ...``."""

from __future__ import annotations

import argparse
import json
import os
import sys


def _files(spark, args):
    from siltstone.sources.registry import Source, SourceList, discover, ingest

    found = [Source(id=name, kind="local", location=root) for name, root in discover(args.input)]
    return ingest(spark, SourceList(found), args.output)


def _config(kind, args):
    given = json.load(open(args.config, encoding="utf-8")) if getattr(args, "config", None) else {}
    return kind.from_dict(given | {k: v for k, v in vars(args).items() if v is not None})


def corpus_build(spark, args) -> int:
    from siltstone.config import CorpusConfig
    from siltstone.operators.tasks import task_mix
    from siltstone.plans import corpus, report
    from siltstone.sources import store

    cfg = _config(CorpusConfig, args)
    result = corpus.process(corpus.ingest(_files(spark, args), cfg, args.created_at or ""), cfg)
    store.write_records(result.files, os.path.join(args.output, "records"))
    store.write_repos(result.repos, os.path.join(args.output, "repos"))
    examples = None
    if args.tasks:
        examples = task_mix(result.files, cfg.task_ratios, budget=cfg.seq_char_budget, fim_rate=cfg.fim_rate)
        store.write_tasks(examples, os.path.join(args.output, "tasks"))
    paths = report.write_report(report.corpus_report(result.files, result.repos, result.drops, examples, cfg.name, cfg.version), args.output)
    print(*paths)
    return 0


def dataset_build(spark, args) -> int:
    from siltstone.config import DatasetConfig
    from siltstone.functions.bpe import Bpe
    from siltstone.plans import dataset

    cfg = _config(DatasetConfig, args)
    tok = Bpe.load(args.tokenizer) if args.tokenizer else None
    raw = _files(spark, args).withColumnRenamed("repository", "repo")
    try:
        m = dataset.write(dataset.build(raw, cfg, tok), args.output, cfg, tok, source_root=args.input)
    except dataset.EmptyDatasetError as e:
        print(e, file=sys.stderr)
        return 2
    print(json.dumps({k: m[k] for k in ("n_shards", "seq_len", "vocab_size")}))
    return 0


def corpus_download(spark, args) -> int:
    from siltstone.sources import registry

    rows = json.load(open(args.input, encoding="utf-8"))
    found = registry.SourceList.from_rows(rows).enabled()
    staged = 0
    for s in found:
        try:
            print(s.id, registry.STAGERS[s.kind](s, args.output))
            staged += 1
        except (registry.SourceError, KeyError) as e:
            print(s.id, "left out:", e)
    print(f"{staged} of {len(found)} staged")
    return 0


def corpus_clean(spark, args) -> int:
    from pyspark.sql import functions as F

    from siltstone.config import CorpusConfig
    from siltstone.operators.ordering import count_by
    from siltstone.plans import corpus
    from siltstone.sources import store

    files = corpus.ingest(_files(spark, args), _config(CorpusConfig, args))
    print(store.write_raw(files.withColumn("split", F.lit("train")), os.path.join(args.output, "raw")), "files kept")
    for r in count_by(files.where("drop_reason <> ''"), "drop_reason").collect():
        print(r.drop_reason, r.n)
    return 0


def corpus_score(spark, args) -> int:
    from pyspark.sql import functions as F

    from siltstone.config import CorpusConfig
    from siltstone.functions import languages
    from siltstone.operators import quality
    from siltstone.plans import corpus

    files = corpus.ingest(_files(spark, args), _config(CorpusConfig, args)).where("drop_reason = ''")
    files = files.withColumn("language", languages.annotate(F.col("language"), F.col("path"), F.col("content")))
    scored = quality.repository_signals(files).withColumn("quality_score", quality.quality_score())
    for r in scored.orderBy(F.desc("quality_score"), "repository").toLocalIterator():
        print(json.dumps(r.asDict()) if args.json else f"{r.quality_score:6.2f}  {r.repository}")
    return 0


def corpus_stats(spark, args) -> int:
    from siltstone.plans import report
    from siltstone.sources import store

    r = report.corpus_report(store.read_records(spark, os.path.join(args.input, "records")), store.read_repos(spark, os.path.join(args.input, "repos")))
    print(json.dumps({k: r[k] for k in ("dataset_size", "language_distribution", "license_distribution", "split_distribution")}, indent=1))
    return 0


def corpus_export(spark, args) -> int:
    from siltstone.config import DatasetConfig
    from siltstone.functions.bpe import Bpe
    from siltstone.operators.ordering import global_positions
    from siltstone.plans import dataset
    from siltstone.sources import store

    files = store.read_records(spark, os.path.join(args.input, "records"))
    if args.format == "raw":
        print(store.write_raw(files, args.output))
    elif args.format == "jsonl":
        print({r.split: r.n for r in store.write_by_split(files, args.output).collect()})
    elif args.format == "parquet":
        store.write_parquet(files, os.path.join(args.output, "corpus.parquet"))
    else:
        files = global_positions(files, [files["repository"], files["path"]]).withColumnRenamed("pos", "ord")
        print(list(dataset.export_by_split(files, args.output, _config(DatasetConfig, args), Bpe.load(args.tokenizer) if args.tokenizer else None)))
    return 0


def dataset_show(spark, args) -> int:
    from siltstone.sources.shards import chunk_at, read_manifest, read_shards

    m = read_manifest(args.input)
    if args.chunk is not None:
        row = chunk_at(read_shards(spark, args.input), args.chunk).first()
        print(row.token_ids if row else "no such chunk")
        return 0 if row else 1
    print(json.dumps(m["stats"] if args.stats else {k: v for k, v in m.items() if k != "stats"}, indent=1))
    return 0


def dataset_verify(spark, args) -> int:
    from siltstone.sources.shards import verify_shards

    bad = verify_shards(spark, args.input).where("NOT ok").collect()
    print(*(r["file"] for r in bad), sep="\n")
    return 1 if bad else 0


def tokenizer_train(spark, args) -> int:
    from pyspark.sql import functions as F

    from siltstone.functions import bpe
    from siltstone.operators.ordering import global_positions
    from siltstone.sources.registry import text_files, tokenizer_corpus

    texts = tokenizer_corpus(spark, args.input) if os.path.isdir(args.input) else text_files(spark, args.input).select("text")
    texts = global_positions(texts, [F.col("text")]).withColumnRenamed("pos", "ord")
    bpe.train(texts, args.vocab_size or 32768, specials=bpe.SPECIALS).save(args.output)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siltstone")
    sub = p.add_subparsers(required=True)

    def command(name, run, *options):
        c = sub.add_parser(name)
        c.add_argument("input")
        c.add_argument("output", nargs="?", default=".")
        for o, kw in options:
            c.add_argument(o, **kw)
        c.set_defaults(run=run)

    number = lambda o: (o, {"type": int})
    command("corpus-build", corpus_build, ("--config", {}), ("--created-at", {}), ("--tasks", {"action": "store_true"}), ("--min-quality", {"type": float, "dest": "min_quality"}), number("--seed"))
    command("dataset-build", dataset_build, ("--config", {}), ("--tokenizer", {}), number("--seq-len"), number("--overlap"), number("--shard-max-bytes"), number("--vocab-size"))
    command("corpus-download", corpus_download)
    command("corpus-clean", corpus_clean, ("--config", {}))
    command("corpus-score", corpus_score, ("--config", {}), ("--json", {"action": "store_true"}))
    command("corpus-stats", corpus_stats)
    command("corpus-export", corpus_export, ("--format", {"choices": ["raw", "jsonl", "parquet", "rds"], "default": "jsonl"}), ("--tokenizer", {}), number("--seq-len"), number("--vocab-size"))
    command("dataset-show", dataset_show, number("--chunk"), ("--stats", {"action": "store_true"}))
    command("dataset-verify", dataset_verify)
    command("tokenizer-train", tokenizer_train, number("--vocab-size"))
    return p


def main(argv: list[str] | None = None) -> int:
    from siltstone.session import local_session, ship

    args = parser().parse_args(argv)
    spark = local_session()
    ship(spark)
    return args.run(spark, args)


if __name__ == "__main__":
    sys.exit(main())
