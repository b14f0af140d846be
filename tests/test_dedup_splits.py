import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.operators import dedup, splitting
from siltstone.operators.components import connected_components
from siltstone.operators.ordering import global_positions, rank_by_hash


def test_first_wins(spark):
    df = spark.createDataFrame([(1, "h"), (2, "h"), (3, "k"), (4, ""), (5, ""), (6, None)], "ord long, hash string")
    assert {r.ord for r in dedup.mark_first_wins(df, "hash").where("duplicate").collect()} == {2}
    assert dedup.mark_first_wins(df.limit(0), "hash").count() == 0


def test_duplicate_repositories(spark):
    rows = [("a", "1"), ("a", "2"), ("b", "2"), ("b", "1"), ("b", "1"), ("c", "3")]
    got = {r.repository: r.keep for r in dedup.duplicate_repositories(spark.createDataFrame(rows, "repository string, hash string")).collect()}
    assert got == {"a": True, "b": False, "c": True}


def test_signature_of_large_repositories(spark):
    """One form at every size: the hash of all sorted hashes, streamed."""
    rows = [(r, hashlib.sha256(str(i).encode()).hexdigest()) for r, n in (("a", 40), ("b", 40), ("c", 41), ("large", 20_000)) for i in range(n)]
    df = spark.createDataFrame(rows, "repository string, hash string")
    got = {r.repository: r.signature for r in dedup.repository_signatures(df).collect()}
    assert got == {k: hashlib.sha256("\n".join(sorted(h for r, h in rows if r == k)).encode()).hexdigest() for k in got} and len(got) == 4
    assert got["a"] == got["b"] != got["c"]


def _plain_minhash(text, perms=64):
    p, s = (1 << 61) - 1, " ".join(text.split())
    grams = {s[i : i + 5] for i in range(max(1, len(s) - 4))} if s else set()
    hs = [int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "big") for g in grams]
    return [min(((2 * i + 1) * h + i * i + 7) % p for h in hs) for i in range(perms)] if hs else [0] * perms


@settings(max_examples=30, deadline=None)
@given(st.text(max_size=200))
def test_minhash_equals_plain_arithmetic(text):
    text = text.encode("utf-8", "ignore").decode()
    assert dedup.minhash(text) == _plain_minhash(text)


def test_near_duplicates(spark):
    base = " ".join(f"word{i} stays here" for i in range(80))
    rows = [(1, base), (2, base.replace("word40", "wurd40")), (3, "something else entirely, " * 30), (4, base), (5, ""), (6, None), (7, " ")]
    got = {r.ord: r.group for r in dedup.near_duplicate_groups(spark.createDataFrame(rows, "ord long, content string"), threshold=0.7).collect()}
    assert got[2] == 1 and got[4] == 1 and got[3] == 3 and got[6] == 5 and got[7] == 5
    assert dedup.near_duplicates(spark.createDataFrame([], "ord long, content string")).count() == 0


def test_components_against_union_find(spark):
    random.seed(5)
    edges = [(random.randrange(120), random.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
    assert connected_components(spark.createDataFrame([(None, 1)], "u long, v long")).count() == 0


def test_chunk_duplicates(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, [1, 2]), (3, [12])], "chunk_id long, token_ids array<int>")
    assert [r.duplicate for r in dedup.mark_duplicate_chunks(df).orderBy("chunk_id").collect()] == [False, True, False]


def test_fraction_equals_python(spark):
    keys = ["a", "owner/name", "é"]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(splitting.fraction(F.col("k"), 7)).collect()]
    assert got == [int.from_bytes(hashlib.sha256(f"7:{k}".encode()).digest()[:8], "big") / 2**64 for k in keys]


def test_split_of_a_repository_is_one(spark):
    df = spark.createDataFrame([(f"r{i % 40}",) for i in range(200)], "repository string").withColumn("split", splitting.assign_split(F.col("repository"), {"train": 0.8, "validation": 0.1, "test": 0.1}))
    assert splitting.leaking(df).count() == 0 and df.select("split").distinct().count() > 1
    with pytest.raises(ValueError):
        splitting.assign_split(F.col("repository"), {"train": 0.0})


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.sampled_from("abcd"), st.integers(0, 60), min_size=1), st.lists(st.floats(0.01, 1), min_size=4, max_size=4))
def test_largest_total_equals_search(avail, shares):
    ratios = {k: v / sum(shares) for k, v in zip("abcd", shares, strict=True)}
    bound = 2 * sum(avail.values()) + 1
    want = max(n for n in range(bound + 1) if all(int(r * n) <= avail.get(k, 0) for k, r in ratios.items()))
    assert splitting.largest_total(avail, ratios, bound) == want


def test_language_balance(spark):
    rows = [(i, "python" if i < 10 else "go", hashlib.sha256(str(i).encode()).hexdigest(), "r", f"p{i}") for i in range(12)]
    df = spark.createDataFrame(rows, "ord long, language string, hash string, repository string, path string")
    got = Counter(r.language for r in splitting.balance_languages(df, {"python": 0.5, "go": 0.5}).collect())
    assert got["python"] == got["go"] == 2
    assert splitting.balance_languages(df, {"rust": 1.0}).count() == 12


def test_rank_and_positions_match_windows(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("h"), F.xxhash64("id").alias("x"), (F.col("id") % 7).alias("w"))
    for key in ("h", "x"):
        ranked = {(r.g, r.id): r._rank for r in rank_by_hash(df, "g", key, tie="id").collect()}
        rows = df.collect()
        for g in range(3):
            mine = sorted((r for r in rows if r.g == g), key=lambda r: (r[key], r.id))
            assert all(ranked[g, r.id] == i for i, r in enumerate(mine))
    got = global_positions(df, [-F.col("w"), F.col("id")], "w")
    want, run = {}, 0
    for i, r in enumerate(sorted(df.collect(), key=lambda r: (-r.w, r.id))):
        want[r.id] = (i, run)
        run += r.w
    assert {r.id: (r.pos, r.start) for r in got.collect()} == want


def test_holdout_and_slices(spark):
    df = spark.range(101).withColumnRenamed("id", "idx")
    assert splitting.holdout(df, 0.1).where("is_val").count() == 10 and splitting.holdout(df.limit(3), 0.02).where("is_val").count() == 1
    parts = [set(r[0] for r in df.where(splitting.worker_slice(F.col("idx"), 3, w)).collect()) for w in range(3)]
    assert set.union(*parts) == set(range(101)) and sum(map(len, parts)) == 101
    want = list(range(9))
    random.Random(4).shuffle(want)
    assert splitting.shuffled_indices(9, 4) == want
