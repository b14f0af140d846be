"""Training tasks derived from files and repositories."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.config import TASK_RATIOS, normalize
from siltstone.functions.python_code import MIDDLE, PREFIX, SUFFIX
from siltstone.operators.splitting import largest_total, pick, take_by_hash

# Operator pairs of a planted bug, the first one present is used.
MUTATIONS = (("+", "-"), ("-", "+"), ("==", "!="), ("<", ">"), (" and ", " or "), (" or ", " and "))
_META = ("language", "repository", "path", "split", "license")


def _example(df: DataFrame, task: str, *, input: Column | None = None, target: Column | None = None, text: Column | None = None) -> DataFrame:
    c = lambda x, n: (F.lit("") if x is None else x).alias(n)
    return df.select(F.lit(task).alias("task"), c(input, "input"), c(target, "target"), c(text, "text"), *_META)


def _nonempty(files: DataFrame, least: int = 1) -> DataFrame:
    return files.where(F.length("content") >= least)


def next_token(files: DataFrame) -> DataFrame:
    return _example(_nonempty(files), "next_token", text=F.col("content"))


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def fim(files: DataFrame, rate: float = 0.5) -> DataFrame:
    """A middle span of about a quarter, placed by the file's hash, for the share ``rate`` of the files."""
    f = _nonempty(files, 60).where(pick(F.lit(1000), F.concat("hash", F.lit("fim"))) / 1000.0 <= rate)
    n = F.length("content")
    f = f.withColumn("_a", (F.floor(n / 4) + pick(F.greatest(F.lit(1), F.floor(n / 8)), F.col("hash"))).cast("int"))
    f = f.withColumn("_b", F.least(n, F.col("_a") + F.greatest(F.lit(8), F.floor(n / 4))).cast("int"))
    s = F.col("content")
    middle = F.substring(s, F.col("_a") + 1, F.col("_b") - F.col("_a"))
    head = F.concat(F.lit(PREFIX), F.substring(s, F.lit(1), F.col("_a")), F.lit(SUFFIX), F.substring(s, F.col("_b") + 1, n), F.lit(MIDDLE))
    f = f.where(_trim(middle) != "")
    return _example(f, "fim", input=head, target=middle, text=F.concat(head, middle))


def completion(files: DataFrame) -> DataFrame:
    s, cut = F.col("content"), F.floor(F.length("content") / 2).cast("int")
    return _example(_nonempty(files, 40), "completion", input=F.substring(s, F.lit(1), cut), target=F.substring(s, cut + 1, F.length(s)))


def editing(files: DataFrame) -> DataFrame:
    """One line of more than five characters taken out, chosen by the file's hash."""
    f = files.where(F.col("content").isNotNull()).withColumn("_l", F.split("content", "\n"))
    f = f.withColumn("_i", F.filter(F.transform("_l", lambda x, i: F.when(F.length(_trim(x)) > 5, i)), lambda i: i.isNotNull())).where(F.size("_i") >= 4)
    f = f.withColumn("_v", F.element_at("_i", pick(F.size("_i"), F.concat("hash", F.lit("edit"))) + 1))
    # Slices, not a filter: an expression captured by a lambda would be computed anew for every line.
    rest = F.array_join(F.concat(F.slice("_l", F.lit(1), F.col("_v")), F.slice("_l", F.col("_v") + 2, F.size("_l"))), "\n")
    ask = F.concat(F.lit("Restore the missing line at line "), (F.col("_v") + 1).cast("string"), F.lit(".\n\n"), rest)
    return _example(f, "editing", input=ask, target=_trim(F.element_at("_l", F.col("_v") + 1)))


def bug_fixing(files: DataFrame) -> DataFrame:
    s, bad = F.col("content"), None
    for a, b in MUTATIONS:
        at = F.instr(s, a)
        new = F.concat(F.substring(s, F.lit(1), at - 1), F.lit(b), F.substring(s, at + len(a), F.length(s)))
        bad = F.when(at > 0, new) if bad is None else bad.when(at > 0, new)
    f = _nonempty(files, 40).withColumn("_bad", bad).where("_bad IS NOT NULL")
    return _example(f, "bug_fixing", input=F.concat(F.lit("Fix the bug in this code:\n\n"), F.col("_bad")), target=s)


def refactoring(files: DataFrame) -> DataFrame:
    s = F.col("content")
    messy = F.array_join(F.transform(F.split(s, "\n"), lambda x, i: F.concat(F.regexp_replace(x, r"(?U)\s+$", ""), F.when(i % 5 == 0, "  ").otherwise(""))), "\n")
    f = _nonempty(files, 60).withColumn("_m", messy).where("_m <> content")
    return _example(f, "refactoring", input=F.concat(F.lit("Refactor and clean up this code:\n\n"), F.col("_m")), target=s)


def _functions(files: DataFrame) -> DataFrame:
    @F.pandas_udf("array<struct<name: string, header: string, body: string, full: string, doc: string>>")
    def find(texts: pd.Series) -> pd.Series:
        from siltstone.functions.python_code import functions

        return pd.Series([functions(t) for t in texts], dtype=object)

    return _nonempty(files.where("language = 'python'")).select(*_META, F.explode(find("content")).alias("f")).where("f.doc <> ''")


def docstring_to_code(files: DataFrame) -> DataFrame:
    f = _functions(files).where(F.length("f.body") > F.length("f.doc") + 20)
    return _example(f, "docstring_to_code", input=F.concat("f.header", F.lit('\n    """'), "f.doc", F.lit('"""')), target=F.col("f.body"))


def code_to_explanation(files: DataFrame) -> DataFrame:
    f, quoted = _functions(files), F.concat(F.lit('"""'), F.col("f.doc"), F.lit('"""'))
    at = F.instr(F.col("f.full"), quoted)
    without = F.when(at > 0, F.concat(F.substring("f.full", F.lit(1), at - 1), F.substring("f.full", at + F.length(quoted), F.length("f.full")))).otherwise(F.col("f.full"))
    return _example(f, "code_to_explanation", input=_trim(without), target=F.col("f.doc"))


def readme_to_code(files: DataFrame) -> DataFrame:
    """The first readme of each repository with one of its code files, chosen by the readme's hash.

    The chosen file is found by its number within (repository, hash bucket), so no repository is
    gathered in one task.
    """
    from siltstone.operators.ordering import global_positions

    base = F.lower(F.substring_index("path", "/", -1))
    live = _nonempty(files)
    readme = live.where(base.startswith("readme")).groupBy("repository").agg(F.min_by(F.struct(F.col("content").alias("c"), F.col("hash").alias("h")), "ord").alias("r"))
    code = live.where(F.col("language").isin("python", "javascript", "typescript", "go", "rust"))
    counted = readme.join(code.groupBy("repository").agg(F.count(F.lit(1)).alias("n")), "repository").withColumn("want", pick(F.col("n"), F.col("r.h")))
    numbered = global_positions(code.select("repository", "ord"), [F.col("repository"), F.col("ord")])
    first = numbered.groupBy("repository").agg(F.min("pos").alias("p0"))
    chosen = counted.join(first, "repository").select("r", (F.col("p0") + F.col("want")).alias("pos")).join(numbered, "pos").select("ord", "r")
    f = code.join(chosen, "ord")
    return _example(f, "readme_to_code", input=F.concat(F.lit("Based on this README, write a module:\n\n"), F.substring("r.c", 1, 1500)), target=F.col("content"))


def unit_tests(files: DataFrame) -> DataFrame:
    """Source files with the test file that their name points to; the last file of a name counts."""
    live = _nonempty(files).withColumn("_b", F.substring_index("path", "/", -1)).withColumn("_p", F.lower("path"))
    test = live.where(F.col("_p").contains("test") | F.col("_p").contains("spec")).groupBy("repository", "_b").agg(F.max_by("content", "ord").alias("t"))
    base = F.replace(F.replace(F.replace(F.col("_b"), F.lit("test_"), F.lit("")), F.lit("_test"), F.lit("")), F.lit("spec_"), F.lit(""))
    test = test.select("repository", base.alias("_b"), "t")
    src = live.where(~F.col("_p").contains("test") & (F.col("language") == "python"))
    last = src.groupBy("repository", "_b").agg(F.max("ord").alias("ord"))
    src = src.join(last.select("ord"), "ord", "left_semi")
    f = src.join(test, ["repository", "_b"])
    return _example(f, "unit_test_generation", input=F.concat(F.lit("Write unit tests for this code:\n\n"), F.col("content")), target=F.col("t"))


BUILDERS = {
    "next_token": next_token, "fim": fim, "completion": completion, "editing": editing, "docstring_to_code": docstring_to_code, "code_to_explanation": code_to_explanation,
    "bug_fixing": bug_fixing, "refactoring": refactoring, "readme_to_code": readme_to_code, "unit_test_generation": unit_tests,
}


def within_budget(budget: int) -> Column:
    return F.length("text") + F.length("input") + F.length("target") <= budget


def example_key() -> Column:
    """SHA-256 of the example as JSON with sorted keys; the order in which examples are taken."""
    names = sorted(("task", "input", "target", "text", *_META))

    @F.pandas_udf("string")
    def key(*columns: pd.Series) -> pd.Series:
        return pd.Series([hashlib.sha256(json.dumps(dict(zip(names, v, strict=True))).encode()).hexdigest() for v in zip(*columns, strict=True)], dtype=object)

    return key(*names)


def candidates(files: DataFrame, ratios: dict[str, float] | None = None, *, budget: int = 4000, fim_rate: float = 0.5) -> DataFrame:
    """All examples of the tasks with a share, within the budget of characters."""
    out = None
    for task, share in (ratios or TASK_RATIOS).items():
        if share > 0:
            d = fim(files, fim_rate) if task == "fim" else BUILDERS[task](files)
            out = d if out is None else out.unionByName(d)
    return out.where(within_budget(budget))


def task_mix(files: DataFrame, ratios: dict[str, float] | None = None, *, budget: int = 4000, fim_rate: float = 0.5, max_examples: int | None = None) -> DataFrame:
    """The largest set of examples in the given ratios, taken of each task in the order of the key."""
    from siltstone.session import materialize

    r = normalize({k: v for k, v in (ratios or TASK_RATIOS).items() if v > 0})
    cand = materialize(candidates(files, r, budget=budget, fim_rate=fim_rate), "candidates")
    have = {x[0]: x[1] for x in cand.groupBy("task").count().collect()}
    if not have:
        return cand.where("false")
    n = largest_total(have, r, 2 * (sum(have.values()) + 1))
    if max_examples:
        n = min(n, max_examples)
    return take_by_hash(cand, "task", {k: int(v * n) for k, v in r.items()}, example_key())


def fim_records(records: DataFrame, *, rate: float = 0.5, min_chars: int = 60, seed: int = 1234) -> DataFrame:
    """Rows of the functions of Python files in prefix-suffix-middle form, right after their parent."""

    @F.pandas_udf("array<string>")
    def build(paths: pd.Series, texts: pd.Series) -> pd.Series:
        from siltstone.functions.python_code import fim_texts

        return pd.Series([fim_texts(p or "", t, rate=rate, min_chars=min_chars, seed=seed) if t is not None else [] for p, t in zip(paths, texts, strict=True)], dtype=object)

    f = records.where("language = 'python'").select("ord", "repo", "path", "language", F.posexplode(build("path", "text")).alias("i", "text"))
    return f.select("ord", (F.col("i") + 1).alias("sub_ord"), "repo", F.concat("path", F.lit("#fim"), F.col("i").cast("string")).alias("path"), "language", "text", F.lit("fim").alias("kind"))
