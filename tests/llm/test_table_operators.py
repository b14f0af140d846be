import os
import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import encode, leakage, overlap, packing, splits
from siltstone.llm import queries as Q
from siltstone.llm.words import hash_words, run_hashes, words

WORD = re.compile(r"[A-Za-z0-9_]+")
VOCAB = os.path.exists(encode.DEFAULT_PATH)


# --- splits -----------------------------------------------------------------------------------------
def split_tables(spark):
    files = [("A/x", "train"), ("a/x.git", "Test "), ("https://h.example/a/y/", None), ("b/z", "train"), ("c/q", "val"), ("d/w", "train"), ("e/v", ""), (None, "train"), (" ", "test"), ("f/u", "train"), ("F/u", "TRAIN")]
    repos = [("b/z", "train"), ("d/w", "valid"), ("lone", "train")]
    staged = [("b/z", "/s/1"), ("c/q", "/s/1/"), ("e/v", "/s/2"), ("f/u", "/s/2"), (None, "/s/1"), ("d/w", None), ("d/w", "")]
    mk = lambda rows, s: spark.createDataFrame([(*r, "x") for r in rows], s + ", owner string")
    return mk(files, "repository string, split string"), mk(repos, "repository string, split string"), mk(staged, "repo string, root string")


def test_leaking_groups(spark):
    got = {r.repository for r in splits.leaking_repositories(*split_tables(spark)).collect()}
    assert got == {"a/x", "a/y", "b/z", "c/q", "d/w"}


def test_groups_stay_whole_and_near_the_quotas(spark):
    random.seed(1)
    files = [(f"o{random.randrange(60)}/r{random.randrange(3)}", random.choice(["train", "validation", "test", None])) for _ in range(1500)]
    files = spark.createDataFrame(files + [("big/one", "train")] * 500, "repository string, split string")
    repos = spark.createDataFrame([], "repository string, split string")
    staged = spark.createDataFrame([("o1/r0", "/r"), ("o2/r1", "/r"), ("o2/r0", "/s"), ("o3/r0", "/s/")], "repo string, root string")
    got = splits.assign_splits(files, repos, staged, {"train": 0.6, "validation": 0.2, "test": 0.2}).collect()
    assert len(got) == files.select("repository").distinct().count()
    assert len({(r.component, r.split) for r in got}) == len({r.component for r in got})
    assert len({r.component for r in got if r.repository.split("/")[0] in ("o1", "o2", "o3")}) == 1
    n = Counter()
    size = Counter(r.repository for r in files.collect())
    for r in got:
        n[r.split] += size[r.repository]
    assert abs(n["train"] - 1200) <= 60 and abs(n["validation"] - 400) <= 60
    again = splits.assign_splits(files, repos, staged, {"train": 0.6, "validation": 0.2, "test": 0.2}).collect()
    assert sorted(got) == sorted(again)


def test_large_groups_count_with_all_their_rows(spark):
    names = F.when(F.col("id") < 8191, "big/one").otherwise(F.concat(F.lit("o"), F.floor((F.col("id") - 8191) / 100).cast("string"), F.lit("/r")))
    files = spark.range(8191 + 33_000).select(names.alias("repository"), F.lit("train").alias("split"))
    none = spark.createDataFrame([], "repository string, split string, repo string, root string")
    n = {r.split: r.n_rows for r in splits.split_report(files, none.select("repository", "split"), none.select("repo", "root")).collect()}
    assert sum(n.values()) == 41_191 and all(abs(n[s] - 41_191 * q) <= 100 for s, q in splits.RATIOS.items())


def test_split_edges(spark):
    f, r, s = (t.limit(0) for t in split_tables(spark))
    assert splits.leaking_repositories(f, r, s).count() == 0
    with pytest.raises(ValueError):
        splits.allocate([(1, "train", 1)], {"train": 0.0})


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.sampled_from(["", "train", "validation", "test"]), st.integers(1, 20)), min_size=1, max_size=12, unique_by=lambda b: b[:2]))
def test_allocation_uses_every_component(bundles):
    out = splits.allocate(bundles, splits.RATIOS)
    assert all(sum(out[s, k].values()) == n for s, k, n in bundles)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.tuples(*[st.integers(0, 5)] * 3)), min_size=1, max_size=8), st.tuples(*[st.integers(0, 9)] * 3))
def test_transport_is_a_min_cost_flow(sources, quota):
    supply, costs, over = [n for n, _ in sources], [c for _, c in sources], 4
    got = splits.transport(supply, costs, list(quota), over)
    assert [sum(f) for f in got] == supply
    price = sum(x * c for f, cs in zip(got, costs, strict=True) for x, c in zip(f, cs, strict=True))
    price += over * sum(max(0, sum(f[s] for f in got) - quota[s]) for s in range(3))
    n, total = len(supply), sum(supply)
    arcs = [(0, 2 + i, supply[i], 0) for i in range(n)] + [(2 + i, 2 + n + s, supply[i], costs[i][s]) for i in range(n) for s in range(3)]
    arcs += [a for s in range(3) for a in ((2 + n + s, 1, quota[s], 0), (2 + n + s, 1, total, over))]
    flow = splits.min_cost_flow(n + 5, arcs, 0, 1)
    assert price == sum(f * a[3] for f, a in zip(flow, arcs, strict=True))


def test_min_cost_flow():
    flow = splits.min_cost_flow(4, [(0, 1, 3, 0), (0, 2, 2, 0), (1, 2, 2, 1), (1, 3, 2, 4), (2, 3, 4, 1)], 0, 3)
    assert flow[3] + flow[4] == 5 and flow[4] == 4


# --- overlap ----------------------------------------------------------------------------------------
def jaccard(a, b, k=5):
    f = lambda t: {tuple(x) for w in [[x.lower() for x in WORD.findall(t)]] for x in zip(*(w[i:] for i in range(k)))}
    a, b = f(a), f(b)
    return len(a & b) / len(a | b)


def overlap_tables(spark):
    random.seed(2)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(60):
        base = [random.choice(vocab) for _ in range(random.randrange(28, 120))]
        texts.append(" ".join(base))
        for _ in range(random.randrange(3)):
            t = list(base)
            for _ in range(random.randrange(7)):
                t[random.randrange(len(t))] = random.choice(vocab).upper()
            texts.append("; ".join(t))
    texts += [texts[0]] * 20 + [None, "", "short text"]
    rec, files = [], []
    for i, t in enumerate(texts):
        rec.append((i, t, random.choice(["python", "Go ", "markdown", None]) if i % 9 == 0 else "python", f"p{i}.py", "x"))
        files.append((i, random.choice(["train", "Train", "validation", "test", "val", None, ""]), "github"))
    return spark.createDataFrame(rec, "ord long, text string, language string, path string, split string"), spark.createDataFrame(files, "ord long, split string, source string"), rec, files


def test_pairs_equal_brute_force(spark):
    records, files, rec, fil = overlap_tables(spark)
    got = {(r.ord_a, r.ord_b) for r in overlap.pairs_found(records, files).collect()}
    side = {o: {"train": 0, "validation": 1, "val": 1, "test": 1}.get((s or "").strip().lower()) for o, s, _ in fil}
    live = [(o, t) for o, t, g, _, _ in rec if t and len(WORD.findall(t)) >= 30 and (g is None or g.strip().lower() in overlap.LANGUAGES) and side[o] is not None]
    want = {(min(a, b), max(a, b)) for a, t in live for b, u in live if side[a] == 0 and side[b] == 1 and jaccard(t, u) >= 0.7}
    assert got == want and len(want) > 20
    rep = overlap.overlap_report(records, files).collect()
    assert sum(r.pairs for r in rep) == len(want)
    assert overlap.pairs_found(records.limit(0), files).count() == 0


def test_run_hashes_follow_words():
    a, b = hash_words(words("Alpha beta gamma delta")), hash_words(words("x alpha BETA, gamma! delta y"))
    assert run_hashes(a, 4)[0] in run_hashes(b, 4) and len(run_hashes(a, 5)) == 0 and words(None) == []


# --- packing ----------------------------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80), st.integers(10, 50))
def test_patterns_hold_the_histogram(lengths, capacity):
    hist = Counter(min(n, capacity) for n in lengths)
    out, bins = Counter(), 0
    for pattern, times in packing.pack_histogram(dict(hist), capacity):
        assert sum(n * k for n, k in pattern) <= capacity
        bins += times
        for n, k in pattern:
            out[n] += k * times
    total = sum(n * c for n, c in hist.items())
    assert out == hist and -(-total // capacity) <= bins <= max(1, 2 * -(-total // capacity))


def test_local_search_empties_bins():
    assert len(packing.local_search([[6, 2], [5, 3, 1], [4, 4], [3, 2]], 10)) == 3
    assert packing.local_search([], 10) == []


def test_all_underfull_bins_are_searched(monkeypatch):
    monkeypatch.setattr(packing, "SEARCH_BINS", 40)
    hist = {4: 100, 3: 200}  # first-fit decreasing: 117 bins of 10, the bound: 100
    out = packing.pack_histogram(hist, 10)
    held = Counter()
    for pattern, times in out:
        for n, k in pattern:
            held[n] += k * times
    assert held == hist and sum(times for _, times in out) <= 104


def test_pack_frames(spark):
    random.seed(3)
    rows = [(i, [i % 100] * random.choice([0, 1, 5, 5, 5, 17, 33, 64, 65, 200]), "x") for i in range(800)] + [(900, None, "x"), (901, [1] * 128, "x")]
    df = spark.createDataFrame(rows, "ord long, token_ids array<int>, length string")
    p = packing.pack(df, capacity=64).collect()
    bins, spans = defaultdict(list), defaultdict(list)
    for r in p:
        assert r.length <= 64
        bins[r.chunk_id].append((r.place, r.place + r.length))
        spans[r.item_id].append((r.start, r.length))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x[1] == y[0] for x, y in zip(b, b[1:], strict=False)) and b[-1][1] <= 64
    ids = {i: len(x or []) for i, x, _ in rows}
    for i, s in spans.items():
        s.sort()
        assert sum(n for _, n in s) == ids[i] and (len(s) == 1 or ids[i] > 64) and s[0][0] == 0
    assert set(spans) == {i for i, n in ids.items() if n}
    rep = packing.pack_report(packing.pack(df, capacity=64), 64).first()
    assert rep.chunks <= 1.02 * rep.least_chunks and rep.fullest <= 64
    chunks = packing.fill_chunks(df, packing.pack(df, capacity=64), capacity=64, pad=-1).collect()
    assert sum(x != -1 for r in chunks for x in r.token_ids) == sum(ids.values()) and all(len(r.token_ids) == 64 for r in chunks)
    assert packing.pack(df.limit(0)).count() == 0


# --- encoding ---------------------------------------------------------------------------------------
@pytest.mark.skipif(not VOCAB, reason="no vocabulary here")
def test_encoding_equals_the_public_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    tokens = encode.read_ranks(encode.DEFAULT_PATH)
    ref = tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    texts = ["", None, " ", "Hello  world\r\n\tx", "<|endoftext|> ordinary", "naïve 日本語 🚀🚀 ½ © 　", "it's we'll I'D", "a" * 20_000, "x1y22z333 ___ --", "\x00\x1c odd  "]
    rows = encode.encode_corpus(spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, ids string")).orderBy("doc_id").collect()
    assert [r.ids for r in rows] == [ref.encode_ordinary(t) if t else [] for t in texts]
    back = encode.decode_corpus(spark.createDataFrame([(r.doc_id, r.ids) for r in rows], "doc_id long, ids array<int>")).orderBy("doc_id").collect()
    assert [r.text for r in back] == [t or "" for t in texts]


@pytest.mark.skipif(not VOCAB, reason="no vocabulary here")
@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_encoding_round_trip(text):
    text = text.encode("utf-8", "ignore").decode()
    if "e" not in CACHE:
        t = encode.read_ranks(encode.DEFAULT_PATH)
        CACHE["e"] = encode.PieceEncoder(encode.model_bytes(t), len(t))
    assert CACHE["e"].decode(CACHE["e"].encode(text)) == text


CACHE: dict = {}


def test_missing_vocabulary():
    with pytest.raises(FileNotFoundError):
        encode.tokenizer_path("/none/such")


# --- leaks ------------------------------------------------------------------------------------------
def leak_brute(docs, items, w=20, c=2):
    out = set()
    for d, t in docs:
        a = [x.lower() for x in WORD.findall(t or "")]
        for i, u in items:
            b = [x.lower() for x in WORD.findall(u or "")]
            if any(sum(x != y for x, y in zip(a[p : p + w], b[q : q + w], strict=True)) <= c for p in range(len(a) - w + 1) for q in range(len(b) - w + 1)):
                out.add((d, i))
    return out


def test_leaks_equal_brute_force(spark):
    random.seed(4)
    vocab = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(random.choice(vocab) for _ in range(random.choice([15, 20, 30, 40])))) for i in range(12)] + [(50, None), (51, "")]
    docs = [(0, None), (1, ""), (2, "v1 v2")]
    for d in range(3, 60):
        t = [random.choice(vocab) for _ in range(random.randrange(40))]
        src = WORD.findall(random.choice(items[:12])[1])
        a = random.randrange(max(1, len(src) - 18))
        piece = src[a : a + random.choice([17, 19, 20, 21, 25])]
        for _ in range(random.randrange(5)):
            piece[random.randrange(len(piece))] = random.choice(vocab)
        docs.append((d, "> " + "\n> ".join(t + [x.upper() + "," for x in piece] + t[:3])))
    docs.append((3, docs[3][1]))
    df = spark.createDataFrame([(*r, "z") for r in docs], "doc_id long, text string, item_id string")
    it = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(df, it).collect()}
    assert got == leak_brute(docs, items) and len(got) > 5
    assert {(r.doc_id, r.item_id) for r in leakage.find_leaks(df, it, block=3).collect()} == got
    assert leakage.find_leaks(df, it.limit(0)).count() == 0 and leakage.find_leaks(df.limit(0), it).count() == 0
    clean = leakage.remove_leaks(df.where("doc_id <> 3"), leakage.find_leaks(df.where("doc_id <> 3"), it))
    left = spark.createDataFrame([(r.doc_id, r.clean_text) for r in clean.collect()], "doc_id long, text string")
    assert leakage.find_leaks(left, it).count() < len(got) / 4


# --- queries ----------------------------------------------------------------------------------------
SF = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": {"repository"}, "p2_found": {"ord_a", "ord_b"}, "p3_found": {"ord"}, "p4_found": {"ord"}, "p5_found": {"ord", "line_no"}, "p6_found": {"unit", "item_key", "spdx"}, "p8_ids": {"doc_id", "ids"}, "p9_found": {"doc_id", "item_id"},
    "p10_found": {"doc_id", "kind", "line_no"},
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_queries(spark, name):
    df = Q.queries()[name](spark, SF)
    if name in COLUMNS:
        assert set(df.columns) == COLUMNS[name]
        assert df.select([F.col(c).cast("string") for c in df.columns]).distinct().count() == df.count() > 0
    else:
        assert df.count() >= 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    df = Q.queries()[name](spark, SF)
    cur = con.execute(Q.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(cur.fetchall()) and set(names) == set(df.columns)
