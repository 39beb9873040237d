"""Corpus documents that contain passages of held-out test items.

Rare n-grams seed the search: an n-gram that one item alone has is a seed, wording that
several items share is none. The n-grams of all documents meet the seeds in one join
(broadcast only if the seeds are measured small). Seeds of
an item must stand as far from each other in the document as in the item, but for a few
words. Two are enough if one is rare in the corpus. Common phrases that one item has by
accident stand all over a corpus, and so do passages that were copied often; where all
seeds are common, several must agree. These counts are combined
before the shuffle. Documents that pass are aligned with the item word by word
(Smith-Waterman), which carries a passage over words that were replaced, dropped or added.
Alignments run in blocks of an item around seeds, so their memory depends on neither length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typegraph.plans.joins import checked_broadcast
from typegraph.plans.scratch import Scratch

#: Words of a seed; a run between two replaced words must hold one.
SEED_WORDS = 3
#: A seed is common if it stands more often than once in so many documents, and more often than COMMON_LEAST.
COMMON_PART, COMMON_LEAST = 1000, 20
#: Seeds that must agree where all are common.
COMMON_SEEDS = 5
#: Words by which the distance of two seeds may differ between document and item.
DRIFT = 16
#: Words of an item that are aligned at once.
BLOCK_WORDS = 256
MATCH, MISMATCH, GAP = 2, -1, -3
#: Part of the aligned words that must be equal.
LEAST_EQUAL = 0.65


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits; empty for a null text."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda w: w != "")


def grams_of(words: Column, n: int = SEED_WORDS) -> Column:
    """Hashes of the n-grams, in order; empty if there are fewer words."""

    def grams(ws: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(ws) - (n - 1))
        return F.when(
            F.size(ws) >= n, F.transform(at, lambda i: F.xxhash64(*[F.element_at(ws, i + k) for k in range(n)]))
        ).otherwise(F.array().cast("array<bigint>"))

    # the words are bound to a lambda variable, so they are split once and not for every n-gram
    return F.flatten(F.transform(F.array(words), grams))


def best_alignment(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int, int, np.ndarray]:
    """Best local alignment: score, first and last item word, text range, equal words.

    Returns (score, i0, i1, j_pack, equal) where equal flags the item words that meet an
    equal text word and j_pack is j0 * len + j1.
    """
    n, m = len(item), len(text)
    h = np.zeros((n + 1, m + 1), dtype=np.int32)
    slope = -GAP * np.arange(m + 1, dtype=np.int32)
    for i in range(1, n + 1):
        row = np.maximum(h[i - 1] + GAP, 0)
        diag = h[i - 1, :-1] + np.where(text == item[i - 1], MATCH, MISMATCH)
        row[1:] = np.maximum(row[1:], diag)
        h[i] = np.maximum.accumulate(row + slope) - slope
    i1, j1 = np.unravel_index(int(h.argmax()), h.shape)
    score = int(h[i1, j1])
    i, j = int(i1), int(j1)
    equal = np.zeros(n, dtype=bool)
    while i > 0 and j > 0 and h[i, j] > 0:
        same = text[j - 1] == item[i - 1]
        if h[i, j] == h[i - 1, j - 1] + (MATCH if same else MISMATCH):
            equal[i - 1] = same
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return score, i, int(i1) - 1, j * (m + 1) + int(j1), equal


def _spans(hits: list[int], before: int, behind: int, longest: int) -> list[tuple[int, int]]:
    """Ranges around hits; a range longer than ``longest`` is cut into overlapping ones that
    hold every stretch of ``before + behind`` words."""
    merged: list[list[int]] = []
    for j in hits:
        if merged and j - before <= merged[-1][1]:
            merged[-1][1] = j + behind
        else:
            merged.append([max(0, j - before), j + behind])
    out = []
    for a, b in merged:
        step = longest - before - behind
        out += [(x, min(b, x + longest)) for x in range(a, max(a + 1, b - before - behind), step)]
    return out


def leaks(item: list[str], own: list[bool], text: list[str], least_words: int, block: int = BLOCK_WORDS) -> bool:
    """Whether the text holds ``least_words`` consecutive words of the item.

    own[k] tells that the item alone has the n-gram at its word k. The item is taken in
    blocks that overlap by half, so one of them holds ``least_words`` of any passage, and
    the text in windows around the block's seeds.
    """
    n = SEED_WORDS
    code = {w: k for k, w in enumerate(dict.fromkeys(item))}
    words = np.array([code[w] for w in item], dtype=np.int32)
    full = np.fromiter((code.get(w, -1) for w in text), dtype=np.int32, count=len(text))
    if len(words) < n or len(full) < n:
        return False
    # n-grams of both as one number each
    base = np.int64(len(code) + 2)
    pack = lambda x: ((x[:-2].astype(np.int64) + 2) * base + x[1:-1] + 2) * base + x[2:] + 2
    seeds, grams = pack(words), pack(full)
    grams[(full[:-2] < 0) | (full[1:-1] < 0) | (full[2:] < 0)] = -1
    own_at = np.array(own[: len(seeds)], dtype=bool)
    block = max(block, 2 * least_words)
    least = int(least_words * (LEAST_EQUAL * MATCH + (1 - LEAST_EQUAL) * MISMATCH))
    starts = range(0, max(1, len(words) - block // 2), block // 2)
    for first in starts:
        part_words = words[first : first + block]
        alone_at = own_at[first : first + block - n + 1]
        hits = np.nonzero(np.isin(grams, seeds[first : first + block - n + 1][alone_at]))[0].tolist()
        if len(hits) < 2:
            continue
        reach = len(part_words) + 8
        for a, b in _spans(hits, reach, reach, 4 * reach):
            if _passage(part_words, alone_at, full[a:b].copy(), least_words, least):
                return True
    return False


def _passage(words: np.ndarray, alone_at: np.ndarray, text: np.ndarray, least_words: int, least: int) -> bool:
    """Whether some alignment of the two is long, equal and own enough."""
    n = SEED_WORDS
    while True:
        score, i0, i1, pack, equal = best_alignment(words, text)
        if score < least:
            return False
        span = i1 - i0 + 1
        alone = [k for k in range(i0, min(i1 + 1, len(alone_at))) if alone_at[k] and equal[k : k + n].all()]
        if span >= least_words and equal.sum() >= LEAST_EQUAL * span and alone and alone[-1] - alone[0] >= n:
            return True
        j0, j1 = divmod(pack, len(text) + 1)
        text[j0:j1] = -1  # look for another passage


def candidates(docs: DataFrame, seeds: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, item_id) with seeds of the item in places that agree.

    docs: (doc_id, text); seeds: (gram, item_id, k). The offset between the places of a
    seed in document and item falls into two overlapping windows; offsets that differ by
    up to DRIFT share one. A window passes with two seeds that do not overlap, of which
    one is rare in the corpus, or with COMMON_SEEDS seeds of any frequency, as a passage
    that was copied often has. Only numbers are kept of a window, so hot items and
    phrases are combined before the shuffle.
    """
    grams = docs.select("doc_id", F.posexplode(grams_of(words_of(F.col("text")))).alias("p", "gram"))
    hits = scratch.save(grams.join(checked_broadcast(seeds), "gram").select("doc_id", "item_id", "gram", "k", "p"))
    n = docs.agg(F.count("*")).head()[0]
    often = hits.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > max(COMMON_LEAST, n // COMMON_PART))
    often = often.select("gram", F.lit(1).alias("common"))
    w = F.floor((F.col("p") - F.col("k")) / DRIFT)
    at = hits.join(checked_broadcast(often), "gram", "left").select(
        "doc_id", "item_id", "k", F.coalesce("common", F.lit(0)).alias("common"), F.explode(F.array(w, w + 1)).alias("w")
    )
    pairs = at.groupBy("doc_id", "item_id", "w").agg(
        F.min("k").alias("a"), F.max("k").alias("b"), F.min("common").alias("common"), F.count("*").alias("n")
    )
    enough = (F.col("b") - F.col("a") >= SEED_WORDS) & ((F.col("common") == 0) | (F.col("n") >= COMMON_SEEDS))
    return pairs.filter(enough).select("doc_id", "item_id").distinct()


def contaminated(
    docs: DataFrame, items: DataFrame, spark: SparkSession, least_words: int = 20,
) -> DataFrame:
    """(doc_id, item_id) of the documents that hold passages of items.

    docs: (doc_id, text); items: (item_id, text). Words are compared by letters and
    digits, without case. Null, empty and short texts hold nothing; repeated rows give one
    row; items alike in all words share all wording and so leak nowhere.
    """
    scratch = Scratch(spark, "contamination")
    it = items.select(F.col("item_id"), words_of(F.col("text")).alias("item")).filter("item_id is not null").distinct()
    it = it.withColumn("grams", grams_of(F.col("item")))
    each = it.select("item_id", F.posexplode("grams").alias("k", "gram"))
    owners = each.groupBy("gram").agg(F.count_distinct("item_id").alias("owners"))
    marked = scratch.save(each.join(owners, "gram"))
    seeds = scratch.save(marked.filter("owners = 1").select("gram", "item_id", "k"))
    own = marked.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("k", (F.col("owners") == 1).alias("o")))).alias("s"))
    known = scratch.save(
        it.join(own, "item_id").select("item_id", "item", F.transform("s", lambda x: x["o"]).alias("own"))
    )
    text = docs.select("doc_id", F.col("text").alias("text"))
    pairs = scratch.save(candidates(text, seeds, scratch))
    rows = text.join(pairs, "doc_id").select("doc_id", "item_id", words_of(F.col("text")).alias("words"))
    rows = rows.join(checked_broadcast(known), "item_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = [leaks(list(i), list(o), list(w), least_words) for i, o, w in zip(b["item"], b["own"], b["words"])]
            yield b.loc[keep, ["doc_id", "item_id"]]

    return rows.select("doc_id", "item_id", "item", "own", "words").mapInPandas(run, "doc_id bigint, item_id bigint").distinct()
