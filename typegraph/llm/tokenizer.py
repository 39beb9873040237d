"""Byte-level BPE over a corpus by an index of pair occurrences.

Texts are split by the vocabulary's pattern, and each different piece that a task meets is
encoded once. A partition is taken in slices of rows; the new pieces of a slice lie in one
array, and an index maps each rank to the positions where its pair stands. Ranks are taken in ascending order from a heap; a rank's merge is applied
at all its positions at once, and only the lists of the pairs to the left and right of
them change. No row leaves its partition.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

#: Fixed value: the pattern that goes with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where the vocabularies of public tokenizers lie, unless another folder is named.
FOLDER = "/opt/tokenizers"
#: Rows of a slice. Larger ones save nothing: 500 to 4000 rows take the same time, 10,000 a sixth more.
SLICE_ROWS = 1000
#: Different pieces a worker remembers; beyond that it forgets all, which costs time only.
REMEMBERED = 400_000


def read_ranks(name: str = "byte_bpe_50k", folder: str = FOLDER) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file. The number of tokens bounds its size."""
    with open(os.path.join(folder, name + ".tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairIndexEncoder:
    """Encodes texts; keeps the pieces it has seen."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.text = {r: t for t, r in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.first = np.full((256, 256), -1, dtype=np.int64)  # ranks of pairs of bytes
        for t, r in ranks.items():
            if len(t) == 2:
                self.first[t[0], t[1]] = r
        self.pairs: dict[tuple[int, int], int] = {}
        self.known: dict[str, list[int]] = {}

    def _rank(self, a: int, b: int) -> int:
        r = self.pairs.get((a, b))
        if r is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            r = self.pairs[a, b] = self.ranks.get(self.text[a] + self.text[b], -1)
        return r

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each of the pieces (none empty)."""
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        ends = np.cumsum(lengths + 1)  # position of the gap behind each piece, counted from 1
        raw = np.frombuffer(b"\0".join(pieces) + b"\0", dtype=np.uint8)
        gaps = ends - 1
        ids = self.byte[raw]
        ids[gaps] = -1
        pair = np.full(len(raw), -1, dtype=np.int64)
        pair[:-1] = self.first[raw[:-1], raw[1:]]
        pair[gaps] = -1
        pair[gaps[lengths > 0] - 1] = -1
        at = np.nonzero(pair >= 0)[0]
        order = at[np.argsort(pair[at], kind="stable")]
        ranks, cut = np.unique(pair[order], return_index=True)
        index = dict(zip(ranks.tolist(), (x.tolist() for x in np.split(order, cut[1:])))) if len(at) else {}
        sym = ids.tolist()
        after = list(range(1, len(sym) + 1))
        before = list(range(-1, len(sym) - 1))
        heap = list(index)
        heapq.heapify(heap)
        rank_of, text = self._rank, self.text
        while heap:
            r = heapq.heappop(heap)
            places = index.pop(r, None)
            if places is None:
                continue
            places.sort()
            want = text[r]
            for i in places:
                a = sym[i]
                if a < 0:
                    continue
                j = after[i]
                b = sym[j]
                if b < 0 or rank_of(a, b) != r or len(text[a]) + len(text[b]) != len(want):
                    continue
                sym[i], sym[j] = r, -2
                k = after[j]
                after[i] = k
                before[k] = i
                c = sym[k]
                if c >= 0:
                    n = rank_of(r, c)
                    if n >= 0:
                        if n in index:
                            index[n].append(i)
                        else:
                            index[n] = [i]
                            heapq.heappush(heap, n)
                h = before[i]
                if h >= 0 and sym[h] >= 0:
                    n = rank_of(sym[h], r)
                    if n >= 0:
                        if n in index:
                            index[n].append(h)
                        else:
                            index[n] = [h]
                            heapq.heappush(heap, n)
        out, start = [], 0
        for gap in gaps.tolist():
            out.append([x for x in sym[start:gap] if x >= 0])
            start = gap + 1
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of the texts; a null or empty text has none."""
        split, known = self.split, self.known
        pieces = [split(t) if t else [] for t in texts]
        new = {p for ps in pieces for p in ps if p not in known}
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = {p for ps in pieces for p in ps}
        todo = sorted(new)
        if todo:
            known.update(zip(todo, self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in todo])))
        flat: list[int] = []
        offsets = [0]
        for ps in pieces:
            for p in ps:
                flat += known[p]
            offsets.append(len(flat))
        return np.array(offsets, dtype=np.int32), np.array(flat, dtype=np.int32)


def encode_corpus(
    docs: DataFrame, spark: SparkSession, id_col: str = "doc_id", text_col: str = "text",
    vocabulary: str = "byte_bpe_50k", folder: str = FOLDER,
) -> DataFrame:
    """(doc_id, ids) of every row, without special tokens.

    Strings that look like special tokens are ordinary text. An empty and a null text
    give an empty list. Other columns are not read; an empty table gives no rows. The
    vocabulary (its file bounds its size) goes to the executors once.
    """
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PairIndexEncoder(ranks.value)
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = texts.slice(at, SLICE_ROWS).to_pylist()
                offsets, ids = encoder.encode(part)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, SLICE_ROWS), lists], names=["doc_id", "ids"])

    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, ids array<int>")
