"""Binary token shards: a writer task per shard, a Spark data source to read them, checks, manifest.

Layout (little endian): a 64-byte header, the ids as unsigned 16 or 32 bit, an index of (offset u64,
length u32), the chunks' meta as JSON behind its length, and a footer of a SHA-256 over all before it.
"""

from __future__ import annotations

import glob
import hashlib
import json
import os
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siltstone.operators.chunking import shard_of
from siltstone.operators.ordering import global_positions

# Magic words, the header's fields and its padded size.
MAGIC, FOOTER = b"RDS1", b"RDSE"
HEADER, HEADER_SIZE = "<4sHHIIBBIQQQQ", 64
INDEX = "<QI"


class ShardWriter:
    """A shard written as its chunks come; only the index and the meta are held in memory."""

    def __init__(self, path: str, *, seq_len: int, vocab_size: int, version: int = 1, tokenizer_version: int = 1):
        self.path, self.head = path, (version, tokenizer_version, vocab_size, seq_len)
        self.kind = np.dtype("<u4") if vocab_size > 65536 else np.dtype("<u2")
        self.index, self.meta, self.at = [], [], HEADER_SIZE
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        self.file = open(path, "wb+")
        self.file.write(b"\0" * HEADER_SIZE)

    def add(self, ids, meta: dict) -> None:
        ids = np.asarray(ids, dtype=np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() > np.iinfo(self.kind).max):
            raise ValueError("an id does not fit the shard's width")
        self.index.append(struct.pack(INDEX, self.at, len(ids)))
        self.meta.append(meta)
        self.at += self.file.write(ids.astype(self.kind).tobytes())

    def close(self) -> dict:
        """Index, meta, header and checksum; returns file name, chunks, ids and checksum."""
        words = json.dumps(self.meta, ensure_ascii=False).encode()
        table = b"".join(self.index)
        meta_at = self.at + len(table)
        footer_at = meta_at + 8 + len(words)
        version, tokenizer_version, vocab_size, seq_len = self.head
        head = struct.pack(HEADER, MAGIC, version, tokenizer_version, vocab_size, seq_len, int(self.kind.itemsize == 4), 0, len(self.index), HEADER_SIZE, self.at, meta_at, footer_at)
        self.file.write(table + struct.pack("<Q", len(words)) + words)
        self.file.seek(0)
        self.file.write(head.ljust(HEADER_SIZE, b"\0"))
        self.file.seek(0)
        digest = hashlib.sha256()
        while block := self.file.read(1 << 20):
            digest.update(block)
        self.file.write(digest.digest() + FOOTER)
        self.file.close()
        return {"file": os.path.basename(self.path), "chunks": len(self.index), "tokens": (self.at - HEADER_SIZE) // self.kind.itemsize, "sha256": digest.hexdigest()}


def write_shard(path: str, chunks: list[tuple[np.ndarray, dict]], **head) -> dict:
    w = ShardWriter(path, **head)
    for ids, m in chunks:
        w.add(ids, m)
    return w.close()


class Shard:
    """A shard file; chunks are read through a memory map."""

    def __init__(self, path: str):
        self.path = path
        with open(path, "rb") as f:
            raw = f.read(HEADER_SIZE)
        if len(raw) < HEADER_SIZE or raw[:3] != MAGIC[:3]:
            raise ValueError(f"{path} is no shard")
        parser = PARSERS.get(struct.unpack("<H", raw[4:6])[0])
        if parser is None:
            raise ValueError(f"unknown version of {path}")
        parser(self, raw)

    def _read_v1(self, raw: bytes) -> None:
        _, self.version, self.tokenizer_version, self.vocab_size, self.seq_len, wide, _, self.n, self.data_at, self.index_at, self.meta_at, self.footer_at = struct.unpack(HEADER, raw[: struct.calcsize(HEADER)])
        self.kind = np.dtype("<u4") if wide else np.dtype("<u2")
        self.map = np.memmap(self.path, dtype=np.uint8, mode="r")
        size = struct.calcsize(INDEX)
        table = bytes(self.map[self.index_at : self.index_at + self.n * size])
        self.index = [struct.unpack_from(INDEX, table, i * size) for i in range(self.n)]

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> np.ndarray:
        if not -self.n <= i < self.n:
            raise IndexError(i)
        at, n = self.index[i]
        return np.frombuffer(self.map, dtype=self.kind, count=n, offset=at)

    def metadata(self, i: int | None = None):
        n = struct.unpack("<Q", bytes(self.map[self.meta_at : self.meta_at + 8]))[0]
        meta = json.loads(bytes(self.map[self.meta_at + 8 : self.meta_at + 8 + n]))
        return meta if i is None else meta[i]

    def verify(self) -> bool:
        digest = hashlib.sha256()
        for a in range(0, self.footer_at, 1 << 20):
            digest.update(bytes(self.map[a : min(a + (1 << 20), self.footer_at)]))
        return bytes(self.map[self.footer_at : self.footer_at + 32]) == digest.digest()


PARSERS = {1: Shard._read_v1}


class ShardReader(DataSourceReader):
    def __init__(self, options):
        self.paths = sorted(glob.glob(os.path.join(options["path"], "*.rds"))) if os.path.isdir(options["path"]) else sorted(glob.glob(options["path"]))

    def partitions(self):
        return [InputPartition((i, p)) for i, p in enumerate(self.paths)] or [InputPartition((0, None))]

    def read(self, partition):
        i, path = partition.value
        if path is None:
            return
        s = Shard(path)
        meta = s.metadata()
        for j in range(len(s)):
            yield i, j, [int(x) for x in s[j]], json.dumps(meta[j], ensure_ascii=False)


class ShardSource(DataSource):
    """``spark.read.format("rds").load(folder)``: one partition per shard."""

    @classmethod
    def name(cls):
        return "rds"

    def schema(self):
        return "shard int, local_idx int, token_ids array<int>, meta string"

    def reader(self, schema):
        return ShardReader(self.options)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """``idx, shard, local_idx, token_ids, meta`` of all shards of a folder as one dataset."""
    spark.dataSource.register(ShardSource)
    df = spark.read.format("rds").load(folder)
    return global_positions(df, [F.col("shard"), F.col("local_idx")]).withColumnRenamed("pos", "idx")


def write_shards(chunks: DataFrame, folder: str, *, seq_len: int, vocab_size: int, shard_max_bytes: int = 1 << 30, tokenizer_version: int = 1, meta: str | None = None) -> DataFrame:
    """Write ``chunks(chunk_id, token_ids)`` as shards below a shared folder, a shard within one task.

    The rows of a shard come sorted and are written as they come, so a task holds a batch of chunks
    and not the shard. Returns ``file, chunks, tokens, sha256, ok`` by shard; ``ok`` is the check of
    the file read back. A task that is run again writes its files anew.
    """
    itemsize = 2 if vocab_size <= 65536 else 4
    ranked = global_positions(chunks, [F.col("chunk_id")])
    ranked = ranked.withColumn("shard_id", shard_of(F.col("pos"), seq_len=seq_len, itemsize=itemsize, shard_max_bytes=shard_max_bytes))
    ranked = ranked.select("shard_id", "pos", "token_ids", (F.to_json(meta) if meta else F.lit("{}")).alias("meta"))

    def write(batches):
        shard, w, rows = None, None, []

        def done():
            return w.close() | {"ok": Shard(w.path).verify()}

        for pdf in batches:
            for i, ids, m in zip(pdf["shard_id"], pdf["token_ids"], pdf["meta"], strict=True):
                if i != shard:
                    if w:
                        rows.append(done())
                    shard = i
                    w = ShardWriter(os.path.join(folder, f"shard_{int(i):05d}.rds"), seq_len=seq_len, vocab_size=vocab_size, tokenizer_version=tokenizer_version)
                w.add(ids, json.loads(m))
        if w:
            rows.append(done())
        yield pd.DataFrame(rows, columns=["file", "chunks", "tokens", "sha256", "ok"])

    return ranked.repartition("shard_id").sortWithinPartitions("shard_id", "pos").mapInPandas(write, "file string, chunks long, tokens long, sha256 string, ok boolean")


def manifest(shards: DataFrame, folder: str, *, seq_len: int, vocab_size: int, tokenizer_version: int = 1, stats: dict | None = None, lock: dict | None = None) -> dict:
    """Write ``manifest.json`` beside the shards from their rows (one small row per shard)."""
    rows = sorted((r.asDict() for r in shards.collect()), key=lambda r: r["file"])
    out = {
        "format": "rds", "rds_version": 1, "tokenizer_version": tokenizer_version, "vocab_size": vocab_size, "seq_len": seq_len, "dtype": "uint16" if vocab_size <= 65536 else "uint32", "n_shards": len(rows),
        "shards": [{"file": r["file"], "chunks": r["chunks"], "checksum_ok": r["ok"], "tokens": r["tokens"]} for r in rows], "lock": lock or {}, "stats": stats or {},
    }
    with open(os.path.join(folder, "manifest.json"), "w", encoding="utf-8") as f:
        json.dump(out, f, indent=1, ensure_ascii=False)
    return out


def verify_shards(spark: SparkSession, folder: str) -> DataFrame:
    """``file, ok``: the checksum of every shard, read by the executors."""
    body = F.expr("substring(content, 1, length - 36)")
    footer = F.expr("hex(substring(content, length - 35, 32))")
    df = spark.read.format("binaryFile").load(os.path.join(folder, "*.rds"))
    return df.select(F.element_at(F.split("path", "/"), -1).alias("file"), (F.upper(F.sha2(body, 256)) == footer).alias("ok"))


def chunk_at(dataset: DataFrame, idx: int) -> DataFrame:
    """The chunk of one index; negative ones count from the end. A filter, not a seek."""
    if idx >= 0:
        return dataset.where(F.col("idx") == idx)
    last = dataset.agg(F.max("idx").alias("last"))
    return dataset.join(last, dataset["idx"] == last["last"] + 1 + idx).drop("last")


def seek_chunk(spark: SparkSession, folder: str, idx: int) -> DataFrame:
    """``idx, shard, local_idx, token_ids`` of one chunk (negative: from the end), read from its shard alone.

    The manifest tells which shard holds it and the shard's index where its ids are, so nothing else
    is read; an index out of range gives no row.
    """
    sizes = [(s["file"], s["chunks"]) for s in read_manifest(folder)["shards"]]
    total = sum(n for _, n in sizes)
    at = idx + total if idx < 0 else idx
    rows, base = [], 0
    for shard, (name, n) in enumerate(sizes):
        if base <= at < base + n:
            rows.append((at, shard, at - base, [int(x) for x in Shard(os.path.join(folder, name))[at - base]]))
        base += n
    return spark.createDataFrame(rows, "idx long, shard int, local_idx int, token_ids array<int>")


def read_manifest(folder: str) -> dict:
    with open(os.path.join(folder, "manifest.json"), encoding="utf-8") as f:
        return json.load(f)
