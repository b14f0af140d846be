"""Named queries of the general operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.config import ALLOWED_LICENSES, TASK_RATIOS
from siltstone.functions import bpe, languages
from siltstone.operators import chunking, cleaning, dedup, licensing, ordering, quality, splitting, tasks
from siltstone.session import ship, spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SEQ, SHARD_BYTES = 512, 64 * 1024


def query(sql: str | None = None):
    def wrap(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql.strip()
        return f

    return wrap


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the corpus with their text, as the operators expect them."""
    r = spread(table(spark, sf_dir, "records").select("ord", "path", F.col("text").alias("content")).where("content IS NOT NULL"))
    word = lambda c, d: F.coalesce(F.nullif(F.lower(F.trim(c)), F.lit("")), F.lit(d))
    f = table(spark, sf_dir, "files").select(
        "ord",
        F.lower(F.trim("repository")).alias("repository"),
        F.coalesce("source", F.lit("local")).alias("source"),
        F.coalesce(F.nullif("license", F.lit("")), F.lit("UNKNOWN")).alias("license"),
        word("language", "unknown").alias("language"),
        word("split", "train").alias("split"),
    )
    c = r.join(f, "ord")
    return c.withColumn("hash", F.sha2("content", 256)).withColumn("size", F.octet_length("content").cast("long"))


CORPUS = """
corpus AS (
  SELECT r.ord, lower(trim(f.repository, ' ')) AS repository, r.path, coalesce(f.source, 'local') AS source,
         coalesce(nullif(f.license, ''), 'UNKNOWN') AS license, coalesce(nullif(lower(trim(f.language, ' ')), ''), 'unknown') AS language,
         coalesce(nullif(lower(trim(f.split, ' ')), ''), 'train') AS split, sha256(r.text) AS hash, CAST(strlen(r.text) AS BIGINT) AS size, r.text AS content
  FROM records r JOIN files f ON r.ord = f.ord WHERE r.text IS NOT NULL)
"""
BASE = "array_extract(string_split(replace(path, '\\', '/'), '/'), -1)"


@query("""
WITH d AS (SELECT doc_id, coalesce(lower(lang), 'unknown') AS language, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents WHERE text IS NOT NULL AND text <> '')
SELECT language, count(*) AS n FROM d WHERE n = 1 GROUP BY language""")
def language_distribution(spark, sf_dir):
    """Languages of the distinct documents (exact duplicates: the first one counts)."""
    d = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.coalesce(F.lower("lang"), F.lit("unknown")).alias("language"), F.sha2("text", 256).alias("h"))
    return ordering.count_by(d.groupBy("h").agg(F.min_by("language", "doc_id").alias("language")), "language")


@query(f"""
WITH {CORPUS} SELECT ord, row_number() OVER (PARTITION BY hash ORDER BY ord) > 1 AS duplicate FROM corpus""")
def exact_dedup(spark, sf_dir):
    return dedup.mark_first_wins(corpus(spark, sf_dir).select("ord", "hash"), "hash").select("ord", "duplicate")


_PRINTABLE = "len(list_filter(regexp_extract_all(substring(hex(encode(content)), 1, 8192), '..'), lambda x: (x >= '20' AND x <= '7E') OR x IN ('08', '09', '0A', '0C', '0D')))"
_VENDOR = ", ".join(f"'{s}'" for s in cleaning.VENDOR_SEGMENTS)
_GENERATED = " OR ".join(f"contains(lower(substring(content, 1, 2000)), '{m}')" for m in cleaning.GENERATED_MARKERS)
_LONGEST = "list_max(list_transform(string_split(content, chr(10)), lambda x: length(x)))"
_NEWLINES = "(length(content) - length(replace(content, chr(10), '')))"
_CLEAN = f"""
CASE WHEN len(list_intersect(string_split(replace(path, '\\', '/'), '/'), [{_VENDOR}])) > 0 THEN 'vendor'
     WHEN {BASE} IN ({", ".join(f"'{s}'" for s in cleaning.LOCKFILES)}) THEN 'lockfile'
     WHEN size > 1048576 THEN 'too_large'
     WHEN size > 0 AND (contains(content, chr(0)) OR (least(size, 4096) - {_PRINTABLE}) / least(size, 4096) > 0.3) THEN 'binary'
     WHEN size < 16 THEN 'too_small'
     WHEN contains(lower({BASE}), '.min.') OR ({_LONGEST} > 1000 AND ({_NEWLINES} / greatest(length(content), 1) < 0.01 OR {_LONGEST} > 4000)) THEN 'minified'
     WHEN {_GENERATED} THEN 'generated' ELSE '' END"""


@query(f"WITH {CORPUS} SELECT reason, count(*) AS n FROM (SELECT {_CLEAN} AS reason FROM corpus) GROUP BY reason")
def clean_reasons(spark, sf_dir):
    c = cleaning.clean(corpus(spark, sf_dir).withColumn("content", F.col("content").cast("binary")), notebooks=False)
    return c.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CORPUS} SELECT ord, size < 200 OR size > 20000 AS dropped, CASE WHEN size > 20000 THEN 'too_large' WHEN size < 200 THEN 'too_small' ELSE '' END AS reason FROM corpus")
def size_filter(spark, sf_dir):
    c = corpus(spark, sf_dir).select("ord", cleaning.size_filter(F.col("size"), 200, 20000).alias("reason"))
    return c.select("ord", (F.col("reason") != "").alias("dropped"), "reason")


_SECRETS = list(cleaning.SECRET_PATTERNS.items())
_REDACTED = "content"
for _name, _p in _SECRETS:
    _REDACTED = "regexp_replace({}, '{}', '{}', 'g')".format(_REDACTED, _p.replace("'", "''"), r"\1REDACTED" if _name == "assignment" else "REDACTED")
_COUNTED = " + ".join("len(regexp_extract_all(content, '{}'))".format(p.replace("'", "''")) for _, p in _SECRETS)


@query(f"WITH {CORPUS} SELECT ord, CAST({_COUNTED} AS INT) AS secrets, sha256({_REDACTED}) AS redacted_hash FROM corpus")
def secret_redact(spark, sf_dir):
    t = F.col("content")
    return corpus(spark, sf_dir).select("ord", cleaning.count_secrets(t).alias("secrets"), F.sha2(cleaning.redact_secrets(t), 256).alias("redacted_hash"))


@query(f"""WITH {CORPUS}, c AS (SELECT ord, path, content, size, sha256(content) AS h,
 CASE WHEN len(list_intersect(string_split(replace(path, '\\', '/'), '/'), [{", ".join(f"'{s}'" for s in cleaning.DATASET_VENDOR_SEGMENTS)}])) > 0 THEN 'vendor'
      WHEN size > 0 AND (contains(content, chr(0)) OR (least(size, 4096) - {_PRINTABLE}) / least(size, 4096) > 0.3) THEN 'binary'
      WHEN regexp_replace(content, '\\s', '', 'g') = '' THEN 'empty'
      WHEN {" OR ".join(f"contains(lower(substring(content, 1, 2000)), '{m}')" for m in cleaning.DATASET_GENERATED_MARKERS)} THEN 'generated' ELSE '' END AS reason FROM corpus),
 d AS (SELECT ord, CASE WHEN reason = '' AND ord > min(CASE WHEN reason = '' THEN ord END) OVER (PARTITION BY h) THEN 'duplicate' ELSE reason END AS reason FROM c)
SELECT reason, count(*) AS n FROM d GROUP BY reason""")
def dataset_clean_reasons(spark, sf_dir):
    c = cleaning.dataset_clean(corpus(spark, sf_dir))
    return c.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query()
def dataset_validate_reasons(spark, sf_dir):
    """Python's own compiler decides on syntax, so there is no SQL."""
    c = corpus(spark, sf_dir).select("path", F.col("content").alias("text"), "language")
    return cleaning.validate(c).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _sql_license(text: str) -> str:
    low = f"regexp_replace(lower({text}), '\\s+', ' ', 'g')"
    rules = " ".join("WHEN {} THEN '{}'".format(" AND ".join("regexp_matches({}, '{}')".format(low, p.replace("'", "''")) for p in ps), s) for s, ps in licensing.PHRASES)
    return f"coalesce(nullif(regexp_extract({text}, '{licensing.TAG}', 1), ''), CASE {rules} END, 'UNKNOWN')"


@query(f"WITH {CORPUS} SELECT ord, {_sql_license('content')} AS spdx FROM corpus")
def license_detect(spark, sf_dir):
    return corpus(spark, sf_dir).select("ord", licensing.text_license(F.col("content")).alias("spdx"))


@query(f"""WITH {CORPUS}, l AS (SELECT license, CASE WHEN license IN ({", ".join(f"'{s}'" for s in licensing.PERMISSIVE)}) THEN 'permissive'
 WHEN license IN ({", ".join(f"'{s}'" for s in licensing.COPYLEFT)}) THEN 'copyleft' ELSE 'unknown' END AS class FROM corpus)
SELECT license, class, license IN ({", ".join(f"'{s}'" for s in ALLOWED_LICENSES)}) AS allowed, count(*) AS n FROM l GROUP BY license, class""")
def license_policy(spark, sf_dir):
    c = corpus(spark, sf_dir).select("license", licensing.license_class(F.col("license")).alias("class"), licensing.is_allowed(F.col("license")).alias("allowed"))
    return c.groupBy("license", "class", "allowed").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CORPUS}, p AS (SELECT *, row_number() OVER (PARTITION BY repository ORDER BY ord) AS n FROM corpus),
 f AS (SELECT repository, ord, CASE WHEN lower({BASE}) IN ('copying', 'copying.txt', 'unlicense', 'licence', 'licence.txt') OR starts_with(lower({BASE}), 'license') THEN nullif({_sql_license("content")}, 'UNKNOWN') END AS named,
       nullif(regexp_extract(content, '{licensing.TAG}', 1), '') AS tag FROM p WHERE n <= 50)
SELECT repository, coalesce(arg_min(named, ord) FILTER (named IS NOT NULL), arg_min(tag, ord) FILTER (tag IS NOT NULL), 'UNKNOWN') AS license FROM f GROUP BY repository""")
def repository_license(spark, sf_dir):
    return licensing.repository_license(corpus(spark, sf_dir))


_LICENSE_FILE = f"(starts_with(lower({BASE}), 'license') OR starts_with(lower({BASE}), 'licence') OR lower({BASE}) = 'copying')"
_SNIFF = " ".join(f"WHEN contains(lower(substring(content, 1, 800)), '{s}') THEN '{s.strip().split(' license')[0].upper()}'" for s in licensing.SNIFFED)


@query(f"""WITH {CORPUS} SELECT repository, bool_or(starts_with(lower({BASE}), 'readme')) AS has_readme, bool_or({_LICENSE_FILE}) AS has_license,
 arg_max(CASE {_SNIFF} ELSE 'custom' END, ord) FILTER ({_LICENSE_FILE}) AS license, count(DISTINCT nullif(regexp_extract(path, '^(.*)/[^/]*$', 1), '')) AS folders
FROM corpus GROUP BY repository""")
def repository_info(spark, sf_dir):
    return licensing.repository_info(corpus(spark, sf_dir))


_EXT = "regexp_extract(lower(array_extract(string_split(path, '/'), -1)), '(\\.[^.]*)$', 1)"
_NAME = "lower(array_extract(string_split(path, '/'), -1))"


def _sql_map(table: dict[str, str], key: str) -> str:
    return "CASE {} {} END".format(key, " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()))


@query(f"""WITH {CORPUS} SELECT ord, coalesce({_sql_map(languages.NAMES, _NAME)}, CASE WHEN starts_with({_NAME}, 'dockerfile') THEN 'dockerfile' END, {_sql_map(languages.EXTENSIONS, _EXT)},
 CASE WHEN starts_with(ltrim(substring(content, 1, 200), ' '), '#!') AND (contains(substring(ltrim(substring(content, 1, 200), ' '), 1, 40), 'bash') OR contains(substring(ltrim(substring(content, 1, 200), ' '), 1, 40), '/sh')) THEN 'bash' END, 'unknown') AS detected
FROM corpus""")
def language_detect(spark, sf_dir):
    return corpus(spark, sf_dir).select("ord", languages.detect(F.col("path"), F.col("content")).alias("detected"))


@query()
def language_detect_dataset(spark, sf_dir):
    """JSON has to parse by Spark's parser, whose edge cases SQL engines differ on."""
    return corpus(spark, sf_dir).select("ord", languages.detect_dataset(F.col("path"), F.col("content")).alias("detected"))


_PRIORITY = ", ".join(f"'{s}'" for s in languages.PRIORITY)


@query(f"WITH {CORPUS} SELECT language, language IN ({_PRIORITY}) AS priority, count(*) AS n FROM corpus GROUP BY language")
def language_filter(spark, sf_dir):
    c = corpus(spark, sf_dir).select("language", languages.is_priority(F.col("language")).alias("priority"))
    return c.groupBy("language", "priority").agg(F.count(F.lit(1)).alias("n"))


_FRACTION = "(('0x' || substring(sha256('20241:' || repository), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0)"
_ASSIGN = f"CASE WHEN {_FRACTION} < 0.98 THEN 'train' WHEN {_FRACTION} < 0.98 + 0.01 THEN 'validation' ELSE 'test' END"


@query(f"WITH {CORPUS} SELECT DISTINCT repository, {_ASSIGN} AS split FROM corpus")
def split_assign(spark, sf_dir):
    return corpus(spark, sf_dir).select("repository").distinct().select("repository", splitting.assign_split(F.col("repository")).alias("split"))


@query(f"""WITH {CORPUS}, s AS (SELECT {_ASSIGN} AS split FROM corpus) SELECT v.split, count(s.split) AS n
FROM (VALUES ('train'), ('validation'), ('test')) v(split) LEFT JOIN s ON s.split = v.split GROUP BY v.split""")
def split_counts(spark, sf_dir):
    c = corpus(spark, sf_dir).select(splitting.assign_split(F.col("repository")).alias("split")).groupBy("split").agg(F.count(F.lit(1)).alias("c"))
    every = spark.createDataFrame([("train",), ("validation",), ("test",)], "split string")
    return every.join(c, "split", "left").select("split", F.coalesce("c", F.lit(0)).alias("n"))


@query(f"WITH {CORPUS} SELECT repository FROM corpus GROUP BY repository HAVING count(DISTINCT split) > 1")
def split_leakage(spark, sf_dir):
    return splitting.leaking(corpus(spark, sf_dir))


@query(f"""WITH {CORPUS}, s AS (SELECT repository, sha256(string_agg(hash, chr(10) ORDER BY hash)) AS signature FROM (SELECT DISTINCT repository, hash FROM corpus) GROUP BY repository)
SELECT repository, signature, repository = min(repository) OVER (PARTITION BY signature) AS keep FROM s""")
def repo_signature(spark, sf_dir):
    return dedup.duplicate_repositories(corpus(spark, sf_dir))


@query(f"""WITH {CORPUS} SELECT repository, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS n_bytes, count(DISTINCT language) AS n_languages, arg_min(source, ord) AS source, arg_min(license, ord) AS license, arg_min(split, ord) AS split
FROM corpus GROUP BY repository""")
def repo_rollup(spark, sf_dir):
    return repository_rollup(corpus(spark, sf_dir)).select("repository", "n_files", "n_bytes", F.size("languages").cast("long").alias("n_languages"), "source", "license", "split")


def repository_rollup(files: DataFrame) -> DataFrame:
    """Files, bytes, languages, and the first source, licence and split of each repository."""
    by = files.groupBy("repository", "language").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"), F.min(F.struct("ord", "source", "license", "split")).alias("first"))
    g = by.groupBy("repository").agg(F.sum("n").alias("n_files"), F.sum("b").alias("n_bytes"), F.map_from_entries(F.collect_list(F.struct("language", "n"))).alias("languages"), F.min("first").alias("first"))
    return g.select("repository", "n_files", "n_bytes", "languages", "first.source", "first.license", "first.split")


_BALANCE = {"python": 0.5, "go": 0.3, "java": 0.2}
_WANT = ", ".join(f"('{k}', {v})" for k, v in _BALANCE.items())


@query(f"""WITH {CORPUS}, w(language, r) AS (VALUES {_WANT}), a AS (SELECT w.language, CAST(r AS DOUBLE) AS r, count(c.ord) AS n FROM w LEFT JOIN corpus c ON c.language = w.language GROUP BY ALL),
 t AS (SELECT max(x) AS total FROM range(0, 200000) g(x) WHERE NOT EXISTS (SELECT 1 FROM a WHERE floor(a.r * x) > a.n)),
 k AS (SELECT c.ord, c.language, row_number() OVER (PARTITION BY c.language ORDER BY hash, ord) AS i, floor(a.r * t.total) AS take FROM corpus c JOIN a ON a.language = c.language, t)
SELECT ord, language FROM k WHERE i <= take""")
def language_balance(spark, sf_dir):
    return splitting.balance_languages(corpus(spark, sf_dir), _BALANCE).select("ord", "language")


_TASK = "language, repository, path, split, license"


@query(f"WITH {CORPUS} SELECT 'next_token' AS task, '' AS input, '' AS target, content AS text, {_TASK} FROM corpus WHERE content <> ''")
def next_token_examples(spark, sf_dir):
    return tasks.next_token(corpus(spark, sf_dir))


_PICK = "CAST((('0x' || substring(sha256({key}), 1, 16))::UBIGINT % CAST({n} AS UBIGINT)) AS BIGINT)"


@query(f"""WITH {CORPUS}, a AS (SELECT *, length(content) // 4 + {_PICK.format(key="hash", n="greatest(1, length(content) // 8)")} AS a FROM corpus
  WHERE length(content) >= 60 AND {_PICK.format(key="hash || 'fim'", n="1000")} / 1000.0 <= 0.5),
 b AS (SELECT *, least(length(content), a + greatest(8, length(content) // 4)) AS b FROM a),
 m AS (SELECT *, substring(content, a + 1, b - a) AS mid, '<|fim_prefix|>' || substring(content, 1, a) || '<|fim_suffix|>' || substring(content, b + 1) || '<|fim_middle|>' AS head FROM b)
SELECT 'fim' AS task, head AS input, mid AS target, head || mid AS text, {_TASK} FROM m WHERE regexp_replace(mid, '\\s', '', 'g') <> ''""")
def fim_examples(spark, sf_dir):
    return tasks.fim(corpus(spark, sf_dir))


@query(f"""WITH {CORPUS} SELECT 'completion' AS task, substring(content, 1, length(content) // 2) AS input, substring(content, length(content) // 2 + 1) AS target, '' AS text, {_TASK}
FROM corpus WHERE length(content) >= 40""")
def completion_examples(spark, sf_dir):
    return tasks.completion(corpus(spark, sf_dir))


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@query(f"""WITH {CORPUS}, l AS (SELECT *, string_split(content, chr(10)) AS l FROM corpus),
 i AS (SELECT *, list_filter(range(1, len(l) + 1), lambda i: length({_STRIP.format("l[i]")}) > 5) AS i FROM l),
 v AS (SELECT *, i[{_PICK.format(key="hash || 'edit'", n="len(i)")} + 1] AS v FROM i WHERE len(i) >= 4)
SELECT 'editing' AS task, 'Restore the missing line at line ' || v || '.' || chr(10) || chr(10) || array_to_string(l[1:v-1] || l[v+1:], chr(10)) AS input, {_STRIP.format("l[v]")} AS target, '' AS text, {_TASK} FROM v""")
def editing_examples(spark, sf_dir):
    return tasks.editing(corpus(spark, sf_dir))


_MUTANT = " ".join(f"WHEN contains(content, '{a}') THEN substring(content, 1, instr(content, '{a}') - 1) || '{b}' || substring(content, instr(content, '{a}') + {len(a)})" for a, b in tasks.MUTATIONS)


@query(f"""WITH {CORPUS}, m AS (SELECT *, CASE {_MUTANT} END AS bad FROM corpus WHERE length(content) >= 40)
SELECT 'bug_fixing' AS task, 'Fix the bug in this code:' || chr(10) || chr(10) || bad AS input, content AS target, '' AS text, {_TASK} FROM m WHERE bad IS NOT NULL""")
def bug_fixing_examples(spark, sf_dir):
    return tasks.bug_fixing(corpus(spark, sf_dir))


@query(f"""WITH {CORPUS}, m AS (SELECT *, array_to_string(list_transform(string_split(content, chr(10)), lambda x, i: regexp_replace(x, '\\s+$', '') || CASE WHEN (i - 1) % 5 = 0 THEN '  ' ELSE '' END), chr(10)) AS messy
 FROM corpus WHERE length(content) >= 60)
SELECT 'refactoring' AS task, 'Refactor and clean up this code:' || chr(10) || chr(10) || messy AS input, content AS target, '' AS text, {_TASK} FROM m WHERE messy <> content""")
def refactoring_examples(spark, sf_dir):
    return tasks.refactoring(corpus(spark, sf_dir))


@query()
def docstring_to_code_examples(spark, sf_dir):
    return tasks.docstring_to_code(corpus(spark, sf_dir))


@query()
def code_to_explanation_examples(spark, sf_dir):
    return tasks.code_to_explanation(corpus(spark, sf_dir))


_LASTNAME = "array_extract(string_split(path, '/'), -1)"


@query(f"""WITH {CORPUS}, live AS (SELECT * FROM corpus WHERE content <> ''),
 readme AS (SELECT repository, arg_min(content, ord) AS c, arg_min(hash, ord) AS h FROM live WHERE starts_with(lower({_LASTNAME}), 'readme') GROUP BY repository),
 code AS (SELECT *, row_number() OVER (PARTITION BY repository ORDER BY ord) AS i, count(*) OVER (PARTITION BY repository) AS n FROM live WHERE language IN ('python', 'javascript', 'typescript', 'go', 'rust'))
SELECT 'readme_to_code' AS task, 'Based on this README, write a module:' || chr(10) || chr(10) || substring(c, 1, 1500) AS input, content AS target, '' AS text, language, code.repository, path, split, license
FROM code JOIN readme ON code.repository = readme.repository WHERE i = {_PICK.format(key="h", n="n")} + 1""")
def readme_to_code_examples(spark, sf_dir):
    return tasks.readme_to_code(corpus(spark, sf_dir))


@query(f"""WITH {CORPUS}, live AS (SELECT *, {_LASTNAME} AS b, lower(path) AS p FROM corpus WHERE content <> ''),
 test AS (SELECT repository, b, arg_max(content, ord) AS t FROM live WHERE contains(p, 'test') OR contains(p, 'spec') GROUP BY repository, b),
 src AS (SELECT *, row_number() OVER (PARTITION BY repository, b ORDER BY ord DESC) AS i FROM live WHERE NOT contains(p, 'test') AND language = 'python')
SELECT 'unit_test_generation' AS task, 'Write unit tests for this code:' || chr(10) || chr(10) || content AS input, t AS target, '' AS text, language, src.repository, path, split, license
FROM src JOIN test ON src.repository = test.repository AND src.b = replace(replace(replace(test.b, 'test_', ''), '_test', ''), 'spec_', '') WHERE i = 1""")
def unit_test_examples(spark, sf_dir):
    return tasks.unit_tests(corpus(spark, sf_dir))


@query()
def task_mix(spark, sf_dir):
    """Counts by task of the mixed set; two of its ten builders need Python."""
    share = {k: v for k, v in TASK_RATIOS.items() if k not in ("unit_test_generation", "readme_to_code")}
    return tasks.task_mix(corpus(spark, sf_dir), share).groupBy("task").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CORPUS}, c AS (SELECT ord, repository, path, size, hash, {BASE} AS b0 FROM corpus), d AS (SELECT *, lower(b0) AS b, lower(path) AS p FROM c)
SELECT repository, round(CASE WHEN bool_or(starts_with(b, 'readme')) THEN 1.0 ELSE 0.0 END, 4) AS readme,
 sum(CASE WHEN starts_with(b, 'test_') OR ends_with(b, '_test.py') OR regexp_matches(b, '\\.(test|spec)\\.') OR contains(b, '_test.go') OR regexp_matches(p, '/tests?/') OR ends_with(b, 'test.java') THEN 1 ELSE 0 END)::BIGINT AS n_tests,
 round(count(DISTINCT hash) / count(hash), 4) AS duplicate_ratio FROM d GROUP BY repository""")
def repo_signals_native(spark, sf_dir):
    c = corpus(spark, sf_dir)
    b = F.lower(cleaning.base_name(F.col("path")))
    g = c.groupBy("repository").agg(F.max(b.startswith("readme").cast("double")).alias("readme"), F.sum(quality.is_test_path(F.col("path")).cast("long")).alias("n_tests"), (F.count_distinct("hash") / F.count("hash")).alias("d"))
    return g.select("repository", F.round("readme", 4).alias("readme"), "n_tests", F.round("d", 4).alias("duplicate_ratio"))


@query()
def repo_signals(spark, sf_dir):
    s = quality.repository_signals(corpus(spark, sf_dir))
    return s.withColumn("quality_score", quality.quality_score())


@query()
def file_scores(spark, sf_dir):
    """Quality, complexity and difficulty of every file; the syntax tree is Python's."""
    c = corpus(spark, sf_dir).select("ord", "repository", "path", F.col("content").alias("text"), "language", "size")
    info = licensing.repository_info(corpus(spark, sf_dir)).select("repository", "has_readme", "has_license")
    f = quality.file_quality(c.join(info, "repository"))
    score = quality.complexity(F.col("size"))
    return f.select("ord", "quality", "n_lines", "comment_lines", F.round(score, 2).alias("complexity"), quality.difficulty(score).alias("difficulty"))


@query("""WITH r AS (SELECT quality_score AS s FROM repos WHERE quality_score IS NOT NULL)
SELECT CAST(b AS INT) AS bin, count(s) AS n FROM range(0, 10) g(b) LEFT JOIN r ON least(9, floor(s / 10)) = b GROUP BY b""")
def quality_histogram(spark, sf_dir):
    r = table(spark, sf_dir, "repos").where("quality_score IS NOT NULL AND NOT isnan(quality_score)").select(F.least(F.lit(9), F.floor(F.col("quality_score") / 10)).cast("int").alias("bin"))
    c = r.groupBy("bin").agg(F.count(F.lit(1)).alias("c"))
    return spark.range(10).select(F.col("id").cast("int").alias("bin")).join(c, "bin", "left").select("bin", F.coalesce("c", F.lit(0)).alias("n"))


@query("SELECT repository, quality_score FROM (SELECT DISTINCT repository, quality_score FROM repos WHERE quality_score IS NOT NULL) ORDER BY quality_score DESC, repository LIMIT 100")
def rankings_topk(spark, sf_dir):
    return ordering.top_rankings(table(spark, sf_dir, "repos").where("quality_score IS NOT NULL").select("repository", "quality_score").distinct())


@query("WITH r AS (SELECT drop_reason AS reason FROM files WHERE drop_reason <> '') SELECT reason, count(*) AS n FROM r GROUP BY reason")
def drop_report(spark, sf_dir):
    return ordering.count_by(table(spark, sf_dir, "files").where("drop_reason <> ''").withColumnRenamed("drop_reason", "reason"), "reason")


@query()
def minhash_near_dup(spark, sf_dir):
    """Near-duplicate files beside the first of their group, with groups of the distinct texts."""
    c = corpus(spark, sf_dir).select("ord", "content")
    return dedup.near_duplicates(c).select("ord", F.col("group").alias("kept"))


_TOKENS = "WITH t AS (SELECT ord, token_ids, len(token_ids) AS n, difficulty, quality, repo, path FROM records WHERE len(token_ids) > 0)"
_RANK = "CASE difficulty WHEN 'easy' THEN 0 WHEN 'hard' THEN 2 ELSE 1 END"


@query(f"{_TOKENS} SELECT ord, row_number() OVER (ORDER BY {_RANK}, -quality NULLS FIRST, repo NULLS FIRST, path NULLS FIRST, ord) - 1 AS pos FROM t")
def curriculum_order(spark, sf_dir):
    return chunking.curriculum_order(_token_records(spark, sf_dir)).select("ord", "pos")


def _token_records(spark, sf_dir):
    return table(spark, sf_dir, "records").where(F.size("token_ids") > 0).select("ord", "token_ids", "difficulty", "quality", "repo", "path")


_PACK = f"""{_TOKENS}, p AS (SELECT ord, n, coalesce(sum(n) OVER (ORDER BY {_RANK}, -quality NULLS FIRST, repo NULLS FIRST, path NULLS FIRST, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM t),
 c AS (SELECT ord, s, s + n AS e, unnest(range(CAST(s // {SEQ} AS BIGINT), CAST((s + n - 1) // {SEQ} AS BIGINT) + 1)) AS chunk_id FROM p)"""


@query(f"{_PACK} SELECT chunk_id, CAST({SEQ} - sum(least(e, (chunk_id + 1) * {SEQ}) - greatest(s, chunk_id * {SEQ})) AS INT) AS n_pad, arg_min(ord, greatest(s, chunk_id * {SEQ})) AS first FROM c GROUP BY chunk_id")
def pack_chunks(spark, sf_dir):
    return chunking.pack_stream(_token_records(spark, sf_dir), seq_len=SEQ, lengths_only=True)


@query(f"""{_TOKENS}, f AS (SELECT ord, unnest(token_ids) AS id, generate_subscripts(token_ids, 1) AS i, {_RANK} AS k, quality, repo, path FROM t),
 g AS (SELECT id, row_number() OVER (ORDER BY k, -quality NULLS FIRST, repo NULLS FIRST, path NULLS FIRST, ord, i) - 1 AS g FROM f),
 c AS (SELECT g // {SEQ} AS chunk_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY g) AS ids, count(*) AS n FROM g GROUP BY 1)
SELECT CAST(chunk_id AS BIGINT) AS chunk_id, sha256(ids || repeat(',0', CAST({SEQ} - n AS BIGINT))) AS ids_hash FROM c""")
def pack_tokens(spark, sf_dir):
    """The ids of the chunks themselves, compared by their hash."""
    c = chunking.pack_stream(_token_records(spark, sf_dir), seq_len=SEQ)
    return c.select("chunk_id", F.sha2(F.array_join("token_ids", ","), 256).alias("ids_hash"))


@query(f"""{_PACK}, k AS (SELECT chunk_id, {SEQ} - sum(least(e, (chunk_id + 1) * {SEQ}) - greatest(s, chunk_id * {SEQ})) AS pad FROM c GROUP BY chunk_id)
SELECT count(*) AS total_chunks, count(*) * {SEQ} AS capacity_tokens, CAST(count(*) * {SEQ} - sum(pad) AS BIGINT) AS real_tokens, CAST(sum(pad) AS BIGINT) AS pad_tokens, round(100 * sum(pad) / (count(*) * {SEQ}), 3) AS padding_pct,
 round(100 * (count(*) * {SEQ} - sum(pad)) / (count(*) * {SEQ}), 2) AS packing_efficiency_pct, round((count(*) * {SEQ} - sum(pad)) / count(*), 1) AS avg_context_usage FROM k""")
def packing_stats(spark, sf_dir):
    return chunking.packing_stats(chunking.pack_stream(_token_records(spark, sf_dir), seq_len=SEQ, lengths_only=True), SEQ)


@query("SELECT chunk_id, row_number() OVER (PARTITION BY token_ids ORDER BY chunk_id) > 1 AS duplicate FROM chunks")
def chunk_dedup(spark, sf_dir):
    return dedup.mark_duplicate_chunks(table(spark, sf_dir, "chunks").select("chunk_id", "token_ids")).select("chunk_id", "duplicate")


@query(f"SELECT chunk_id, CAST((row_number() OVER (ORDER BY chunk_id) - 1) // {-(-SHARD_BYTES // (SEQ * 2))} AS INT) AS shard_id FROM chunks")
def shard_assign(spark, sf_dir):
    c = ordering.global_positions(table(spark, sf_dir, "chunks").select("chunk_id"), [F.col("chunk_id")])
    return c.select("chunk_id", chunking.shard_of(F.col("pos"), seq_len=SEQ, itemsize=2, shard_max_bytes=SHARD_BYTES).alias("shard_id"))


@query("SELECT chunk_id, len(token_ids[1:len(token_ids)-1]) AS n_input, array_to_string(token_ids[2:len(token_ids)], ',') AS target FROM chunks")
def lm_shift(spark, sf_dir):
    x, y = chunking.shifted(F.col("token_ids"))
    return table(spark, sf_dir, "chunks").select("chunk_id", F.size(x).cast("long").alias("n_input"), F.array_join(y, ",").alias("target"))


@query("SELECT difficulty, count(c.chunk_id) AS n FROM (VALUES ('easy'), ('medium'), ('hard')) v(difficulty) LEFT JOIN (SELECT chunk_id, coalesce(meta.difficulty, 'medium') AS d FROM chunks) c ON c.d = v.difficulty GROUP BY difficulty")
def difficulty_histogram(spark, sf_dir):
    c = table(spark, sf_dir, "chunks").groupBy(F.coalesce("meta.difficulty", F.lit("medium")).alias("difficulty")).agg(F.count(F.lit(1)).alias("c"))
    return spark.createDataFrame([("easy",), ("medium",), ("hard",)], "difficulty string").join(c, "difficulty", "left").select("difficulty", F.coalesce("c", F.lit(0)).alias("n"))


@query("SELECT chunk_id, (row_number() OVER (ORDER BY chunk_id) - 1) % 3 AS worker FROM chunks")
def worker_slice(spark, sf_dir):
    c = ordering.global_positions(table(spark, sf_dir, "chunks").select("chunk_id"), [F.col("chunk_id")])
    out = None
    for w in range(3):
        part = c.where(splitting.worker_slice(F.col("pos"), 3, w)).select("chunk_id", F.lit(w).cast("long").alias("worker"))
        out = part if out is None else out.unionByName(part)
    return out


@query()
def holdout_split(spark, sf_dir):
    """The seeded order is by Spark's own hash, which SQL engines do not share."""
    return splitting.holdout(table(spark, sf_dir, "chunks").select(F.col("chunk_id").alias("idx")), 0.02)


@query("SELECT doc_id, CAST(strlen(text) AS INT) AS n, CAST(CASE WHEN text <> '' THEN list_sum(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::INT)) ELSE 0 END AS BIGINT) AS total FROM documents WHERE text IS NOT NULL")
def byte_tokenize(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text")).select("doc_id", bpe.byte_ids(F.col("text")).alias("x"))
    return d.select("doc_id", F.size("x").alias("n"), F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@query()
def bpe_pairs_top(spark, sf_dir):
    """The hundred most frequent byte pairs; RE2 has no look-ahead for the pre-token pattern."""
    d = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "text"))
    return bpe.pair_counts(d).orderBy(F.desc("n"), "a", "b").limit(100)


@query()
def bpe_train_encode(spark, sf_dir):
    """A tokenizer of 400 ids trained on all documents, and the length of each document in its ids."""
    d = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "text")).where("text IS NOT NULL")
    t = bpe.train(d, 400, specials=("<|endoftext|>",))
    return d.select(F.col("ord").alias("doc_id"), F.size(bpe.encode_column(t, d)).alias("n_ids"))


@query("""WITH m AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS step, abs(value) / 100.0 AS loss FROM events)
SELECT CAST((step - 1) // 100 AS BIGINT) AS block, round(avg(loss), 6) AS avg_loss, round(exp(least(20.0, avg(loss))), 4) AS perplexity FROM m GROUP BY 1""")
def train_metrics(spark, sf_dir):
    e = ordering.global_positions(table(spark, sf_dir, "events").select("event_id", "value"), [F.col("event_id")])
    log = e.select((F.col("pos") + 1).alias("step"), (F.abs("value") / 100.0).alias("loss"), F.lit(1).alias("tokens"), F.lit(1.0).alias("seconds"))
    m = chunking.train_metrics(log, 100)
    return m.select("block", F.round("avg_loss", 6).alias("avg_loss"), F.round("perplexity", 4).alias("perplexity"))


@query("SELECT kind, count(*) AS n, count(*) FILTER (enabled) AS enabled FROM sources GROUP BY kind")
def source_list(spark, sf_dir):
    return table(spark, sf_dir, "sources").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("enabled").alias("enabled"))


@query(f"WITH {CORPUS} SELECT ord, path, hash FROM corpus ORDER BY hash, ord LIMIT 100")
def top_by_hash(spark, sf_dir):
    return corpus(spark, sf_dir).select("ord", "path", "hash").orderBy("hash", "ord").limit(100)


@query("""WITH r AS (SELECT coalesce(nullif(lower(trim(repository, ' ')), ''), '') AS repository, quality_score FROM repos), q AS (SELECT repository, max(quality_score) AS q FROM r GROUP BY repository)
SELECT f.ord, q.q < 40 AS low FROM files f JOIN q ON lower(trim(f.repository, ' ')) = q.repository WHERE q.q IS NOT NULL""")
def repo_quality_filter(spark, sf_dir):
    """Files of repositories under the least quality."""
    key = F.lower(F.trim("repository"))
    q = table(spark, sf_dir, "repos").groupBy(key.alias("repository")).agg(F.max("quality_score").alias("q")).where("q IS NOT NULL")
    return table(spark, sf_dir, "files").select("ord", key.alias("repository")).join(q, "repository").select("ord", (F.col("q") < 40).alias("low"))


@query("""SELECT count(*) AS files_kept, CAST(sum(len(token_ids)) AS BIGINT) AS total_tokens, CAST(max(len(token_ids)) AS BIGINT) AS longest_sequence, round(sum(len(token_ids)) / count(*), 2) AS avg_tokens_per_file,
 round(sum(coalesce(quality, 0)) / count(*), 2) AS avg_quality, round(sum(coalesce(meta.functions, 0)) / count(*), 2) AS avg_functions, round(sum(coalesce(meta.comment_lines, 0)) / count(*), 2) AS avg_comments, CAST(sum(strlen(text)) AS BIGINT) AS raw_bytes
FROM records WHERE len(token_ids) > 0 AND text IS NOT NULL""")
def dataset_stats(spark, sf_dir):
    r = table(spark, sf_dir, "records").where(F.size("token_ids") > 0).where("text IS NOT NULL").select(
        F.size("token_ids").cast("long").alias("n_tokens"), "quality", F.col("meta.functions").alias("functions"), F.size(F.coalesce("meta.imports", F.array().cast("array<string>"))).alias("n_imports"),
        F.col("meta.comment_lines").alias("comment_lines"), F.octet_length("text").cast("long").alias("raw_bytes"),
    )
    return chunking.dataset_stats(r).drop("avg_imports")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    """The events as a stream, its first row of each user and type, written by micro-batch."""
    import uuid

    from siltstone.session import scratch_dir
    from siltstone.streaming import stateful

    path = f"{sf_dir}/events.parquet"
    # As a pattern, so that the table may be one file or a folder of files.
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path[:-1] + "[t]").select("user_id", "event_type")
    out = f"{scratch_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    stateful.write_batches(stateful.dedup_stream(events, ["user_id", "event_type"]), f"{out}/rows", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("user_id", "event_type")


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def event_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"), F.count_distinct("user_id").alias("users"))


@query()
def corpus_build(spark, sf_dir):
    """The whole corpus pipeline over the corpus: how many files each stage lets go."""
    from siltstone.plans.corpus import process

    return process(corpus(spark, sf_dir)).all_files.groupBy("drop_reason").agg(F.count(F.lit(1)).alias("n"))


@query()
def dataset_build(spark, sf_dir):
    """The whole dataset pipeline with byte ids: the statistics of its chunks."""
    from siltstone.config import DatasetConfig
    from siltstone.plans.dataset import build

    c = corpus(spark, sf_dir).select("ord", F.col("repository").alias("repo"), "path", F.col("content").cast("binary").alias("content"))
    return build(c, DatasetConfig(seq_len=1024, vocab_size=bpe.BYTE_VOCAB)).packing


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def pricing_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n")
    )


@query("""SELECT n_name, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderstatus = 'F' GROUP BY n_name""")
def orders_by_nation(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey", "o_totalprice")
    per = o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = per.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("t"), 2).alias("total"))


from siltstone.plans import checks  # noqa: E402, F401  registers its queries


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
