"""Problem 2: the same or near-same records across splits.

An exact prefix-filter bipartite join. Each text is its set of 5-word shingles; equal texts (by word
sequence) are one content, so a group of copies of any size is joined once and expanded at the end.
Shingles are ordered from the rarest of all splits, counted over all texts in a sketch whose size
follows the number of distinct shingles up to a bound (any order is exact, a good one prunes), so that
what training texts share, such as licence headers, comes last. Two sets of Jaccard similarity t share a
shingle among the first n - ceil(t n) + 1 of both, so evaluation prefixes are indexed and training
prefixes probe them, with length and position filters; what remains is verified on the full sets.

Texts that are NULL or under ``min_words`` words, rows of other languages and rows without a split
take no part. Rows repeated under a new ``ord`` are rows of their own. Empty tables give no pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import canonical_language, canonical_split
from siltstone.llm.words import hash_words, run_hashes, words
from siltstone.session import materialize, spread

LANGUAGES = ("python", "javascript", "typescript", "go", "rust", "java", "cpp", "bash", "sql")
SHINGLE = 5
MIN_WORDS = 30
SIMILARITY = 0.7
#: Cells of the sketches by the number of distinct entries, a byte a cell: 64 MB at most are broadcast whatever the size of the corpus.
LEAST_BITS, MOST_BITS = 20, 26
CELLS_PER_ENTRY = 2
SKETCH_PARTS = 32
#: Postings of training texts from which a shingle is split over salts.
HOT_POSTINGS = 50_000
SALTS = 32


def content_keys(records: DataFrame, files: DataFrame, languages=LANGUAGES, min_words: int = MIN_WORDS) -> DataFrame:
    """``ord, k1, k2, is_eval, source``: rows that take part, keyed by their word sequence."""

    @F.pandas_udf("n int, k1 long, k2 long")
    def key(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            ws = words(t)
            x = xxhash.xxh3_128(hash_words(ws).tobytes()).intdigest() if len(ws) >= min_words else 1 << 127
            rows.append((len(ws), (x >> 64) - (1 << 63), (x & ((1 << 64) - 1)) - (1 << 63)))
        return pd.DataFrame(rows, columns=["n", "k1", "k2"])

    lang = canonical_language(F.col("language"), F.col("path"))
    rec = records.select("ord", "text", lang.alias("lang")).where(F.col("lang").isin(*languages))
    rec = spread(rec.select("ord", "text")).select("ord", key("text").alias("k")).where(F.col("k.n") >= min_words).select("ord", "k.k1", "k.k2")
    side = files.select("ord", canonical_split(F.col("split")).alias("split"), "source").where(F.col("split").isin("train", "validation", "test"))
    return rec.join(side, "ord").select("ord", "k1", "k2", "split", "source", (F.col("split") != "train").alias("is_eval"))


def sketch_bits(distinct: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, CELLS_PER_ENTRY * distinct)))))


def _sketch(entries: DataFrame, bits: int | None = None) -> tuple[np.ndarray, int]:
    """Saturating counts by cell of the numbers ``h``, and the bits of a cell.

    Counts by cell combine before the shuffle and are never more than the cells; each part of the
    table, of at most ``2^bits / SKETCH_PARTS`` cells, is packed by one task, whatever the input.
    """
    if bits is None:
        bits = sketch_bits(entries.agg(F.approx_count_distinct("h", 0.05)).first()[0])
    size = 1 << bits
    step = size // SKETCH_PARTS
    cell = F.col("h").bitwiseAND(F.lit(size - 1))
    counts = entries.groupBy(cell.alias("cell")).agg(F.least(F.count(F.lit(1)), F.lit(255)).cast("int").alias("n"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["cell"].iloc[0]) // step
        cells = np.zeros(step, dtype=np.uint8)
        cells[pdf["cell"].to_numpy() - part * step] = pdf["n"].to_numpy()
        return pd.DataFrame({"part": [part], "counts": [cells.tobytes()]})

    out = np.zeros(size, dtype=np.uint8)
    for r in counts.groupBy(F.floor(F.col("cell") / step)).applyInPandas(pack, "part int, counts binary").collect():
        out[r["part"] * step : (r["part"] + 1) * step] = np.frombuffer(r["counts"], dtype=np.uint8)
    return out, bits


def _total_order(sets: DataFrame):
    """Broadcast counts by cell over all texts, of the shingles that evaluation texts have; others are 0.

    Only training shingles whose cell an evaluation text fills can match, so only they are counted.
    """
    counts, bits = _sketch(sets.where("is_eval").select(F.explode("s").alias("h")))
    context = sets.sparkSession.sparkContext
    filled = context.broadcast(np.packbits(counts > 0))
    mask = np.uint64((1 << bits) - 1)

    @F.pandas_udf("array<long>")
    def shared(col: pd.Series) -> pd.Series:
        seen, out = filled.value, []
        for s in col:
            cell = (np.asarray(s, dtype=np.int64).view(np.uint64) & mask).astype(np.int64)
            out.append(cell[((seen[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1).astype(bool)])
        return pd.Series(out, dtype=object)

    train, _ = _sketch(sets.where("NOT is_eval").select(F.explode(shared("s")).alias("h")), bits)
    return context.broadcast(np.minimum(counts.astype(np.uint16) + train, 255).astype(np.uint8)), mask


def _matched(e: DataFrame, t: DataFrame) -> DataFrame:
    """``e`` joined with ``t`` on ``h``; a shingle of very many training texts is split over salts.

    Hot shingles are at most ``rows / HOT_POSTINGS``, counted with a combined aggregation.
    """
    hot = materialize(t.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT_POSTINGS).select("h", F.lit(True).alias("hot")), "hot-shingles")
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    es = e.join(hot, "h", "left").withColumn("salt", F.explode(salts)).drop("hot")
    ts = t.join(hot, "h", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.hash("t"), F.lit(SALTS))).otherwise(F.lit(0))).drop("hot")
    return es.join(ts, ["h", "salt"])


def near_contents(sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``e, t``: ids of evaluation and training contents (``id, is_eval, is_train, s``) that are near-same."""
    sketch, mask = _total_order(sets)

    @F.pandas_udf("array<struct<h: long, p: int>>")
    def prefix(col: pd.Series, only_hits: pd.Series) -> pd.Series:
        counts, out = sketch.value, []
        for s, probing in zip(col, only_hits, strict=True):
            h = np.asarray(s, dtype=np.int64)
            n = len(h)
            c = counts[(h.view(np.uint64) & mask).astype(np.int64)]
            order = np.lexsort((h, c))[: n - math.ceil(similarity * n - 1e-9) + 1]
            if probing:  # a shingle of no evaluation text can't match
                pos = np.flatnonzero(c[order] > 0)
            else:
                pos = np.arange(len(order))
            out.append([(int(x), int(p)) for x, p in zip(h[order[pos]], pos, strict=True)])
        return pd.Series(out, dtype=object)

    post = sets.select("id", "is_eval", "is_train", F.size("s").alias("n"), prefix("s", ~F.col("is_eval")).alias("p")).select(
        "id", "is_eval", "is_train", "n", F.explode("p").alias("p")
    )
    post = materialize(post.select("id", "is_eval", "is_train", "n", "p.h", "p.p"), "postings")
    e = post.where("is_eval").select(F.col("id").alias("e"), F.col("n").alias("ne"), "h", F.col("p").alias("pe"))
    t = post.where("is_train").select(F.col("id").alias("t"), F.col("n").alias("nt"), "h", F.col("p").alias("pt"))
    need = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("ne") + F.col("nt")) - 1e-6)
    cand = (
        _matched(e, t)
        .where((F.col("e") != F.col("t")) & (F.col("ne") >= similarity * F.col("nt") - 1e-6) & (F.col("nt") >= similarity * F.col("ne") - 1e-6))
        .where(1 + F.least(F.col("ne") - F.col("pe") - 1, F.col("nt") - F.col("pt") - 1) + F.least("pe", "pt") >= need)
        .select("e", "t")
        .distinct()
    )
    cand = materialize(cand, "candidates")
    # Only sets of candidates go on: a filter of bounded size on their ids spares the rest the shuffle.
    ids = cand.select(F.explode(F.array("e", "t")).alias("id")).distinct().select(F.xxhash64("id").alias("h"))
    listed, wbits = _sketch(ids)
    wanted = sets.sparkSession.sparkContext.broadcast(listed > 0)
    wmask = np.uint64((1 << wbits) - 1)

    @F.pandas_udf("boolean")
    def may_match(h: pd.Series) -> pd.Series:
        return pd.Series(wanted.value[(h.to_numpy(dtype=np.int64).view(np.uint64) & wmask).astype(np.int64)])

    sets = sets.where(may_match(F.xxhash64("id")))
    es = sets.where("is_eval").select(F.col("id").alias("e"), F.col("s").alias("se"))
    ts = sets.where("is_train").select(F.col("id").alias("t"), F.col("s").alias("st"))
    common = F.size(F.array_intersect("se", "st"))
    return cand.join(es, "e").join(ts, "t").where(common >= similarity * (F.size("se") + F.size("st") - common) - 1e-9).select("e", "t")


def _overlapping(records: DataFrame, files: DataFrame, similarity: float = SIMILARITY, min_words: int = MIN_WORDS, languages=LANGUAGES) -> tuple[DataFrame, DataFrame]:
    """``e, t``: overlapping contents, and ``id, ord, is_eval, split, source``: the records of each content."""
    keys = materialize(content_keys(records, files, languages, min_words), "contents")
    reps = keys.groupBy("k1", "k2").agg(F.min("ord").alias("id"), F.bool_or("is_eval").alias("is_eval"), F.bool_or(~F.col("is_eval")).alias("is_train"))
    member = materialize(keys.join(reps.select("k1", "k2", "id"), ["k1", "k2"]).drop("k1", "k2"), "members")

    @F.pandas_udf("array<long>")
    def shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(run_hashes(hash_words(words(t)), SHINGLE)).view(np.int64) for t in texts], dtype=object)

    chosen = reps.select(F.col("id").alias("ord"), "is_eval", "is_train")
    sets = materialize(records.select("ord", "text").join(chosen, "ord").select(F.col("ord").alias("id"), "is_eval", "is_train", shingles("text").alias("s")), "shingles")
    pairs = near_contents(sets, similarity)
    same = sets.where("is_eval AND is_train").select(F.col("id").alias("e"), F.col("id").alias("t"))
    return pairs.unionAll(same), member


def cross_split_pairs(records: DataFrame, files: DataFrame, **options) -> DataFrame:
    """``eval_ord, train_ord, eval_split, eval_source, train_source``: all cross-split overlaps."""
    pairs, member = _overlapping(records, files, **options)
    ev = member.where("is_eval").select(F.col("id").alias("e"), F.col("ord").alias("eval_ord"), F.col("split").alias("eval_split"), F.col("source").alias("eval_source"))
    tr = member.where("NOT is_eval").select(F.col("id").alias("t"), F.col("ord").alias("train_ord"), F.col("source").alias("train_source"))
    return pairs.join(ev, "e").join(tr, "t").select("eval_ord", "train_ord", "eval_split", "eval_source", "train_source")


def pairs_found(records: DataFrame, files: DataFrame, **options) -> DataFrame:
    """``ord_a < ord_b`` of each overlap."""
    p = cross_split_pairs(records, files, **options)
    return p.select(F.least("eval_ord", "train_ord").alias("ord_a"), F.greatest("eval_ord", "train_ord").alias("ord_b"))


def overlap_report(records: DataFrame, files: DataFrame, **options) -> DataFrame:
    """``split, source, pairs, records``: overlaps with training by evaluation split and source.

    Contents are counted and multiplied; no pair of records is made.
    """
    pairs, member = _overlapping(records, files, **options)
    copies = member.where("NOT is_eval").groupBy(F.col("id").alias("t")).agg(F.count(F.lit(1)).alias("copies"))
    per = pairs.join(copies, "t").groupBy(F.col("e").alias("id")).agg(F.sum("copies").alias("n"))
    return member.where("is_eval").join(per, "id").groupBy("split", "source").agg(F.sum("n").alias("pairs"), F.count(F.lit(1)).alias("records"))
