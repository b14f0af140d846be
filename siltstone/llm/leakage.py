"""Problem 9: passages of evaluation items inside training documents.

A broadcast hash set of the items' normalised word n-grams is scanned by every document's word
windows; each hit is verified along its diagonal (item word i against document word i + d), and a
pair counts if some ``window`` words in row differ in at most ``changed`` places. The seed length is
the longest run that such a window must hold unchanged (pigeonhole), so the scan loses nothing.

NULL, empty and short texts leak nothing; repeated documents each get their rows; no items give no
rows. The items are read in blocks of a bounded number, so the broadcast never grows with the data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.words import WORD, hash_words, run_hashes, words

ITEM_BLOCK = 20_000
WINDOW = 20
CHANGED = 2

_SPAN = T.ArrayType(
    T.StructType([T.StructField("item_id", T.LongType()), T.StructField("first_word", T.IntegerType()), T.StructField("last_word", T.IntegerType())])
)


class ItemIndex:
    """Sorted seed hashes of a block of items with their (item, position) postings."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW, changed: int = CHANGED):
        self.window, self.changed = window, changed
        self.seed = (window - changed) // (changed + 1)
        self.ids, self.hashes = [], []
        seeds, where = [], []
        for item_id, text in items:
            h = hash_words(words(text))
            if item_id is None or len(h) < window:
                continue
            r = run_hashes(h, self.seed)
            seeds.append(r)
            where.append(np.stack([np.full(len(r), len(self.ids)), np.arange(len(r))], axis=1))
            self.ids.append(item_id)
            self.hashes.append(h)
        if seeds:
            allseeds, allwhere = np.concatenate(seeds), np.concatenate(where)
            order = np.argsort(allseeds, kind="stable")
            allseeds, self.where = allseeds[order], allwhere[order]
            self.keys, self.start = np.unique(allseeds, return_index=True)
            self.stop = np.append(self.start[1:], len(allseeds))
        else:
            self.keys = np.empty(0, dtype=np.uint64)

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """``(item_id, first_word, last_word)`` of each matching stretch, words of the document."""
        if not len(self.keys):
            return []
        h = hash_words(words(text))
        if len(h) < self.window:
            return []
        runs = run_hashes(h, self.seed)
        at = np.searchsorted(self.keys, runs)
        at[at == len(self.keys)] = 0
        hit = np.flatnonzero(self.keys[at] == runs)
        diagonals = set()
        for p in hit:
            k = at[p]
            for item, pos in self.where[self.start[k] : self.stop[k]]:
                diagonals.add((int(item), int(p) - int(pos)))
        out: dict[int, list[tuple[int, int]]] = {}
        w = self.window
        for item, d in diagonals:
            ih = self.hashes[item]
            lo, hi = max(0, -d), min(len(ih), len(h) - d)
            if hi - lo < w:
                continue
            same = np.concatenate([[0], np.cumsum(ih[lo:hi] == h[lo + d : hi + d])])
            good = np.flatnonzero(same[w:] - same[:-w] >= w - self.changed)
            if len(good):
                cut = np.flatnonzero(np.diff(good) > w)
                for a, b in zip(good[np.append(0, cut + 1)], good[np.append(cut, len(good) - 1)], strict=True):
                    out.setdefault(item, []).append((int(a) + lo + d, int(b) + lo + d + w - 1))
        return [(self.ids[i], a, b) for i in sorted(out) for a, b in sorted(set(out[i]))]


def _blocks(items: DataFrame, size: int):
    """Items in blocks of ``size``, ordered by id; the driver holds one block at a time."""
    block: list[tuple[int, str | None]] = []
    for r in items.orderBy("item_id").toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def _scan(index):
    @F.pandas_udf(_SPAN)
    def scan(texts: pd.Series) -> pd.Series:
        ix = index.value
        return pd.Series([ix.spans(t) for t in texts], dtype=object)

    return scan


def find_leaks(documents: DataFrame, items: DataFrame, *, window: int = WINDOW, changed: int = CHANGED, block: int = ITEM_BLOCK) -> DataFrame:
    """``doc_id, item_id, first_word, last_word``: every stretch of an item found in a document."""
    docs = documents.select("doc_id", "text")
    out = None
    for part in _blocks(items.select("item_id", "text"), block):
        index = docs.sparkSession.sparkContext.broadcast(ItemIndex(part, window, changed))

        hits = docs.select("doc_id", F.explode(_scan(index)("text")).alias("s")).select("doc_id", "s.*")
        out = hits if out is None else out.unionAll(hits)
    if out is None:
        return docs.where("false").select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("first_word"), F.lit(0).alias("last_word"))
    return out


def remove_leaks(documents: DataFrame, leaks: DataFrame) -> DataFrame:
    """``doc_id, clean_text, removed_words``: the text of each leaking document without its spans."""
    spans = leaks.groupBy("doc_id").agg(F.collect_set(F.struct("first_word", "last_word")).alias("spans"))

    @F.pandas_udf("clean_text string, removed_words int")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for t, ss in zip(texts, spans, strict=True):
            places = [m.span() for m in WORD.finditer(t)]
            keep, last, gone = [], 0, set()
            for s in sorted((s["first_word"], s["last_word"]) for s in ss):
                gone.update(range(s[0], s[1] + 1))
            for i in sorted(gone):
                if i - 1 not in gone:
                    keep.append(t[last : places[i][0]])
                last = places[i][1]
            rows.append(("".join(keep) + t[last:], len(gone)))
        return pd.DataFrame(rows, columns=["clean_text", "removed_words"])

    joined = documents.select("doc_id", "text").join(spans, "doc_id")
    return joined.select("doc_id", cut("text", "spans").alias("c")).select("doc_id", "c.*")
