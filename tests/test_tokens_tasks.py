import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import bpe
from siltstone.operators import chunking, tasks
from siltstone.operators.splitting import pick


def records(spark, lists):
    rows = [(i, x, "medium", 50, "r", f"p{i:03d}") for i, x in enumerate(lists)]
    return spark.createDataFrame(rows, "ord long, token_ids array<int>, difficulty string, quality int, repo string, path string")


def plain_chunks(lists, seq, overlap, pad=0):
    buf, out = [x for l in lists for x in (l or [])], []
    while len(buf) >= seq:
        out.append(buf[:seq])
        buf = buf[seq - overlap :]
    return out + ([buf + [pad] * (seq - len(buf))] if buf else [])


@pytest.mark.parametrize(("seq", "overlap"), [(8, 0), (8, 3), (5, 4)])
def test_pack_stream(spark, seq, overlap):
    random.seed(seq * 10 + overlap)
    lists = [[random.randrange(99) for _ in range(random.choice([0, 1, 3, 9, 30]))] for _ in range(25)] + [None]
    got = chunking.pack_stream(records(spark, lists), seq_len=seq, overlap=overlap, pad=7).orderBy("chunk_id").collect()
    want = plain_chunks(lists, seq, overlap, 7)
    assert [r.token_ids for r in got] == want
    lengths = chunking.pack_stream(records(spark, lists), seq_len=seq, overlap=overlap, lengths_only=True).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.n_pad, r.first) for r in lengths] == [(r.chunk_id, r.n_pad, r.first) for r in got]


def test_pack_stream_edges(spark):
    assert chunking.pack_stream(records(spark, [[], None]), seq_len=4).count() == 0
    with pytest.raises(ValueError):
        chunking.pack_stream(records(spark, [[1]]), seq_len=4, overlap=4)
    s = chunking.packing_stats(chunking.pack_stream(records(spark, [[1] * 6]), seq_len=4), 4).first()
    assert (s.total_chunks, s.capacity_tokens, s.real_tokens, s.pad_tokens, s.padding_pct) == (2, 8, 6, 2, 25.0)
    assert chunking.packing_stats(chunking.pack_stream(records(spark, []), seq_len=4), 4).first().padding_pct == 0.0


def test_curriculum_order(spark):
    rows = [(0, [1], "hard", 90, "r", "a"), (1, [1], "easy", 10, "r", "b"), (2, [1], "easy", 20, "r", "c"), (3, [1], "odd", 99, "r", "d")]
    df = spark.createDataFrame(rows, "ord long, token_ids array<int>, difficulty string, quality int, repo string, path string")
    assert [r.ord for r in chunking.curriculum_order(df).orderBy("pos").collect()] == [2, 1, 3, 0]


def plain_bpe(texts, n):
    words = [list(p.encode()) for t in texts for p in bpe._SPLIT.findall(t)]
    merges = []
    for m in range(n):
        counts = {}
        for w in words:
            for p in zip(w, w[1:], strict=False):
                counts[p] = counts.get(p, 0) + 1
        if not counts or max(counts.values()) < 2:
            break
        best = max(counts, key=counts.get)
        merges.append(best)
        new = []
        for w in words:
            out, i = [], 0
            while i < len(w):
                if i + 1 < len(w) and (w[i], w[i + 1]) == best:
                    out.append(256 + m)
                    i += 2
                else:
                    out.append(w[i])
                    i += 1
            new.append(out)
        words = new
    return merges


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab c\nd1", max_size=30), max_size=6))
def test_merges_equal_the_plain_loop(texts):
    seen = {}
    for o, t in enumerate(texts):
        for i, p in enumerate(bpe._SPLIT.findall(t)):
            n, first = seen.get(p, (0, (o, i)))
            seen[p] = (n + 1, first)
    got = bpe.learn_merges([(p.encode(), n, f) for p, (n, f) in seen.items()], 12)
    assert got == plain_bpe(texts, 12)


def test_train_round_trip(spark, tmp_path):
    lines = ["def add(a, b):", "    return a + b", "class Foo(Bar):", "for i in range(10):"] * 5
    df = spark.createDataFrame(list(enumerate(lines)) + [(99, None), (100, "")], "ord long, text string")
    t = bpe.train(df, 300, specials=("<|endoftext|>", "<|pad|>"))
    assert list(t.merges) == plain_bpe(lines, 44)
    for s in ["def add(a, b):", "héllo 🚀 <|endoftext|> x", "", "\x1c odd"]:
        assert t.decode(t.encode(s)) == s
    assert len(t.encode("<|endoftext|>")) == 1 and t.vocab_size == 256 + len(t.merges) + 2
    t.save(str(tmp_path / "t.json"))
    again = bpe.Bpe.load(str(tmp_path / "t.json"))
    assert again.encode("return a + b") == t.encode("return a + b") and again.fingerprint() == t.fingerprint()
    with pytest.raises(ValueError):
        t.decode([10**6])
    got = df.select("text", bpe.encode_column(t, df, bos=1, eos=2).alias("x")).collect()
    assert all(r.x is None if r.text is None else r.x == [1, *t.encode(r.text), 2] for r in got)


def test_byte_ids_and_pairs(spark):
    df = spark.createDataFrame([(1, "é🚀a"), (2, ""), (3, None)], "ord long, text string")
    assert [r[0] for r in df.orderBy("ord").select(bpe.byte_ids(F.col("text"))).collect()] == [list("é🚀a".encode()), [], None]
    pairs = {(r.a, r.b): r.n for r in bpe.pair_counts(spark.createDataFrame([(1, "aab aab")], "ord long, text string")).collect()}
    assert pairs == {(97, 97): 2, (97, 98): 2, (32, 97): 1}


def test_shift_metrics_and_rate(spark):
    x, y = chunking.shifted(F.col("t"))
    r = spark.createDataFrame([([1, 2, 3],), ([],)], "t array<int>").select(x.alias("x"), y.alias("y")).collect()
    assert (r[0].x, r[0].y, r[1].x, r[1].y) == ([1, 2], [2, 3], [], [])
    log = spark.createDataFrame([(i, 1.0 if i <= 10 else 50.0, 10, 2.0) for i in range(1, 21)], "step long, loss double, tokens long, seconds double")
    m = chunking.train_metrics(log, 10).orderBy("block").collect()
    assert m[0].avg_loss == 1.0 and abs(m[1].perplexity - 2.718281828**20) / m[1].perplexity < 1e-6 and m[0].tokens_per_second == 5.0
    lr = [r[0] for r in spark.createDataFrame([(0,), (9,), (10,), (110,)], "s int").select(chunking.learning_rate(F.col("s"), 10, 110, 1.0)).collect()]
    assert lr[0] == 0.1 and lr[1] == 1.0 and abs(lr[2] - 1.0) < 1e-9 and abs(lr[3]) < 1e-9


def corpus(spark, contents, language="python", paths=None):
    rows = [(i, "r", (paths or {}).get(i, f"m{i}.py"), language, "train", "MIT", hashlib.sha256(c.encode()).hexdigest() if c else "", c) for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, "ord long, repository string, path string, language string, split string, license string, hash string, content string")


CODE = 'def f(a, b):\n    """Adds two numbers."""\n    total = a + b\n    if total == 3 and a < b:\n        return total\n    return None\n\n\nvalue_of_things = f(1, 2)\n'


def test_file_builders(spark):
    files = corpus(spark, [CODE, "tiny", None, ""])
    one = lambda d: [r for r in d.collect()]
    assert len(one(tasks.next_token(files))) == 2
    c = one(tasks.completion(files))[0]
    assert c.input + c.target == CODE
    e = one(tasks.editing(files))[0]
    line = int(e.input.split("line ")[2].split(".")[0] if "line " in e.input.split("\n")[0] and e.input.count("line ") > 2 else e.input.split(" at line ")[1].split(".")[0])
    rest = e.input.split("\n\n", 1)[1].split("\n")
    assert CODE.split("\n")[line - 1].strip() == e.target and rest == CODE.split("\n")[: line - 1] + CODE.split("\n")[line:]
    b = one(tasks.bug_fixing(files))[0]
    assert "a - b" in b.input and b.target == CODE
    r = one(tasks.refactoring(files))[0]
    assert r.input.endswith("value_of_things = f(1, 2)\n") or "  \n" in r.input
    f = one(tasks.fim(files, rate=1.0))[0]
    prefix, rest = f.text.removeprefix("<|fim_prefix|>").split("<|fim_suffix|>")
    suffix, middle = rest.split("<|fim_middle|>")
    assert prefix + middle + suffix == CODE and middle == f.target
    d = one(tasks.docstring_to_code(files))[0]
    assert d.input.endswith('"""Adds two numbers."""') and "total" in d.target
    x = one(tasks.code_to_explanation(files))[0]
    assert x.target == "Adds two numbers." and '"""' not in x.input


def test_repository_builders(spark):
    files = corpus(spark, ["# Read me first", CODE, "import m1\nassert m1.f(1, 2) == 3\n"], paths={0: "README.md", 1: "util.py", 2: "test_util.py"})
    files = files.withColumn("language", F.when(F.col("ord") == 0, "markdown").otherwise("python"))
    assert tasks.unit_tests(files).collect()[0].target.startswith("import m1")
    r = tasks.readme_to_code(files).collect()
    assert len(r) == 1 and "Read me first" in r[0].input
    assert tasks.readme_to_code(files.where("ord > 0")).count() == 0


def test_task_mix_keeps_ratios(spark):
    files = corpus(spark, [CODE + f"# file {i} of them\n" for i in range(6)])
    got = {r.task: r["count"] for r in tasks.task_mix(files, {"next_token": 0.5, "completion": 0.5}).groupBy("task").count().collect()}
    assert got == {"next_token": 6, "completion": 6}
    assert tasks.task_mix(files, {"next_token": 0.5, "completion": 0.5}, max_examples=4).count() == 4
    assert tasks.task_mix(files.limit(0), {"next_token": 1.0}).count() == 0
    assert tasks.candidates(files, {"next_token": 1.0}, budget=10).count() == 0


def test_pick_equals_python(spark):
    df = spark.createDataFrame([(7, "k"), (1000, "key"), (0, "z")], "n int, k string")
    want = [int.from_bytes(hashlib.sha256(k.encode()).digest()[:8], "big") % n if n else 0 for n, k in ((7, "k"), (1000, "key"), (0, "z"))]
    assert [r[0] for r in df.select(pick(F.col("n"), F.col("k"))).collect()] == want


def test_fim_records(spark):
    df = spark.createDataFrame([(1, "r", "a.py", "python", CODE * 1), (2, "r", "b.go", "go", CODE), (3, "r", "c.py", "python", "def f(:")], "ord long, repo string, path string, language string, text string")
    got = tasks.fim_records(df, rate=1.0).collect()
    assert [r.path for r in got] == ["a.py#fim0"] and got[0].kind == "fim"
    assert tasks.fim_records(df, rate=1.0).collect() == got
