"""Severity of abusive, hateful or sexual content by cumulative-link regression.

A text is cut into sentences and clauses; each gives sparse binary features: its words and
word pairs after spelling tricks are undone (look-alike letters and digits, stretched or
spaced letters, invisible characters), and single consonant skeletons of words, their pairs
and triples (which survive masked vowels). Words inside quotation marks are features of
their own, so wording that is quoted to report it weighs by itself. No word list is used:
what counts is learned from the raters' labels.

One weight vector and ordered thresholds give P(grade > k) = sigmoid(w.x - t_k) for the
grades 0 (no rater objects), 1 (some do), 2 (most do). Labels belong to documents, so the
segment that scores highest stands for a labelled document, and fitting alternates
between choosing it and fitting the weights. Fitting takes a bounded number of labelled
documents; scoring reads every document once, without a shuffle.

Features are made in bulk: one regular expression cuts a slice of texts into tokens, each
different token is read once, and all pairs, triples and sums are array operations over the
different segments of the slice.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fitted on at most so many labelled documents, those with the smallest hash of doc_id.
FIT_DOCUMENTS = 20_000
#: A text counts as offending from this probability of a grade above 0; the best of those tried in cross-validation on the
#: labels by the mean of recall and precision.
OFFENDING = 0.25
#: Hash buckets of features.
BUCKETS = 1 << 19
GRADES = 3
#: Characters of texts whose features are made at once; a longer text is cut at a sentence's end.
SLICE_CHARS = 1_000_000
#: Different tokens a worker remembers; beyond that it forgets all, which costs time only.
REMEMBERED = 300_000

_LOOKALIKE = str.maketrans(
    {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "к": "k",
     "м": "m", "н": "h", "т": "t", "в": "b", "α": "a", "ο": "o", "ε": "e", "ι": "i", "ν": "v", "ρ": "p", "τ": "t", "κ": "k"}
)
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"})
_QUOTES = r"\"[^\"\n]{1,120}\"|(?<!\w)'[^'\n]{1,120}'(?!\w)|“[^”\n]{1,120}”|«[^»\n]{1,120}»|„[^“\n]{1,120}“"
_WORD = r"[^\W_]+(?:[@$!*][^\W_]+)*"
_SPACED = r"(?<!\w)(?:[^\W\d_][ \-*._]){3,}[^\W\d_](?!\w)"
_TOKEN = re.compile(rf"`[^`\n]*`|{_QUOTES}|{_SPACED}|{_WORD}|[.!?]+(?=\s)|[\r\n]+|[,;:](?=\s)")
_WORDS = re.compile(rf"{_SPACED}|{_WORD}")
_IDENTIFIER = re.compile(r"[A-Z]\w*[a-z]\w*[A-Z]\w*")
_RUN = re.compile(r"(\w)\1+")
_VOWEL = re.compile(r"[aeiouy0-9*@$!]+")
_SEPARATOR = re.compile(r"[ \-*._]")
_MOJIBAKE = re.compile(r"[ÃÂ][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]")
_END = re.compile(r"[.!?]\s|[\r\n]")
_SENTENCE, _CLAUSE, _PLAIN, _QUOTE = 0, 1, 2, 3


class _Fold(dict):
    """Code point to its letters without accents; invisible characters vanish."""

    def __missing__(self, point: int) -> str:
        parts = unicodedata.normalize("NFKD", chr(point))
        out = "".join(c for c in parts if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
        self[point] = out
        return out


_FOLD = _Fold()


def plain_spelling(text: str) -> str:
    """Text without invisible characters, mis-decoding and accents."""
    if text.isascii():
        return text
    if _MOJIBAKE.search(text):
        try:
            text = text.encode("cp1252").decode("utf-8")
        except UnicodeError:
            pass
    return text.translate(_FOLD)


def plain_word(token: str) -> str:
    """A word in lower case with its spelling tricks undone; numbers are 9, identifiers xid."""
    if len(token) > 6 and _SEPARATOR.match(token, 1):
        spaced, token = token[1] == " ", _SEPARATOR.sub("", token)
        if spaced and token[0] in "aA" and len(token) > 4:
            token = token[1:]  # a leading article
    if token.isdigit():
        return "9"
    if _IDENTIFIER.fullmatch(token):
        return "xid"
    w = token.lower()
    if not w.isalpha():
        w = w.translate(_LEET)
    if not w.isascii():
        w = w.translate(_LOOKALIKE)
    return _RUN.sub(r"\1", w)


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _mix(salt: int, *parts: np.ndarray) -> np.ndarray:
    """Feature hash of aligned columns of word hashes."""
    h = np.full(len(parts[0]), np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64)))
    for p in parts:
        h = (h ^ p) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


_LEFT, _RIGHT = np.uint64(_hash("<")), np.uint64(_hash(">"))


class _Tokens(dict):
    """Token to its number; what is known of it stands in growing columns."""

    def __init__(self) -> None:
        super().__init__()
        self.kind: list[int] = []
        self.word: list[int] = []
        self.bone: list[int] = []
        self.long: list[bool] = []
        self.quoted: dict[int, np.ndarray] = {}
        self.tables = [np.zeros(0, dtype=d) for d in (np.int8, np.uint64, np.uint64, bool)]
        for mark in ("\n", ",", "`"):
            self[mark]

    def columns(self) -> list[np.ndarray]:
        """kind, word, bone and long as arrays."""
        lists = (self.kind, self.word, self.bone, self.long)
        self.tables = [np.concatenate([t, np.array(x[len(t) :], dtype=t.dtype)]) for t, x in zip(self.tables, lists)]
        return self.tables

    def __missing__(self, token: str) -> int:
        c, n = token[0], len(self.kind)
        kind, word = _PLAIN, ""
        if c in ".!?\r\n":
            kind = _SENTENCE
        elif c in ",;:":
            kind = _CLAUSE
        elif c in "\"'“«„":
            kind, word = _QUOTE, "qq"
            inner = sorted({plain_word(w) for w in _WORDS.findall(token)})
            self.quoted[n] = _mix(6, np.array([_hash(w) for w in inner], dtype=np.uint64))
        else:
            word = "xid" if c == "`" else plain_word(token)
        bone = _VOWEL.sub("", word) or "-"
        self.kind.append(kind)
        self.word.append(_hash(word))
        self.bone.append(_hash(bone))
        self.long.append(len(bone) >= 3)
        self[token] = n
        return n


@dataclass
class Segments:
    """Different sentences and clauses of some texts: features by segment, and their use."""

    seg: np.ndarray  # segment of each feature, ascending
    bucket: np.ndarray  # its bucket; a segment has a bucket once
    n: int  # number of segments
    text: np.ndarray  # text of each use
    use: np.ndarray  # segment of each use

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Sum of the weights of each segment."""
        return np.bincount(self.seg, weights=weights[self.bucket], minlength=self.n)


def _pieces(text: str) -> Iterator[str]:
    """A text in pieces that end where a sentence does."""
    at = 0
    while len(text) - at > SLICE_CHARS:
        m = _END.search(text, at + SLICE_CHARS)
        if m is None:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:] if at else text


def segments(texts: list[tuple[int, str]], known: _Tokens) -> Segments:
    """The segments of numbered texts. A sentence of several clauses counts as a whole and
    clause by clause, so an insult behind a long harmless clause is not outweighed by it."""
    if len(known) > REMEMBERED:
        known.clear()
        known.__init__()
    codes: list[int] = []
    stop, ends = known["\n"], []
    find = _TOKEN.findall
    for _, t in texts:
        codes += [known[x] for x in find(plain_spelling(t))]
        codes.append(stop)
        ends.append(len(codes))
    code = np.array(codes, dtype=np.int64)
    kinds, words, bones, longs = known.columns()
    kind = kinds[code]
    doc = np.repeat(np.array([k for k, _ in texts], dtype=np.int64), np.diff([0, *ends]))
    at = np.nonzero(kind >= _PLAIN)[0]
    sentence = np.cumsum(kind == _SENTENCE)[at]
    clause = np.cumsum(kind <= _CLAUSE)[at]
    none = np.zeros(0, dtype=np.int64)
    if not len(at):
        return Segments(none, none, 0, none, none)
    several = np.zeros(int(sentence[-1]) + 1, dtype=bool)
    several[sentence[1:][(sentence[1:] == sentence[:-1]) & (clause[1:] != clause[:-1])]] = True
    again = several[sentence]
    where = np.concatenate([at, at[again]])
    label = np.concatenate([sentence, clause[again] + int(sentence[-1]) + 1])
    first = np.concatenate([[True], label[1:] != label[:-1]])
    start = np.nonzero(first)[0]
    seg = np.cumsum(first) - 1
    word = words[code[where]]
    # segments alike in all words are one; the words of a quotation count as the quotation's own text
    name = np.where(kind[where] == _QUOTE, _mix(9, code[where].astype(np.uint64)), word)
    place = (np.arange(len(where)) - start[seg]).astype(np.uint64)
    whole = np.add.reduceat(_mix(7, name, place), start)
    order = np.argsort(whole, kind="stable")
    fresh = np.concatenate([[True], whole[order][1:] != whole[order][:-1]])
    one = order[fresh]
    use = np.empty(len(start), dtype=np.int64)
    use[order] = np.cumsum(fresh) - 1
    text = doc[where[start]]
    keep = np.zeros(len(start), dtype=bool)
    keep[one] = True
    number = np.full(len(start), -1, dtype=np.int64)
    number[one] = np.arange(len(one))
    chosen = keep[seg]
    where, word, seg = where[chosen], word[chosen], number[seg[chosen]]
    bone, long = bones[code[where]], longs[code[where]]
    two = seg[1:] == seg[:-1]
    three = two[1:] & two[:-1]
    first = np.concatenate([[True], ~two])
    last = np.concatenate([~two, [True]])
    rows = [seg, seg[1:][two], seg[first], seg[last], seg[1:][two], seg[2:][three], seg[long]]
    hashes = [
        _mix(1, word), _mix(2, word[:-1][two], word[1:][two]),
        _mix(2, np.full(first.sum(), _LEFT), word[first]), _mix(2, word[last], np.full(last.sum(), _RIGHT)),
        _mix(3, bone[:-1][two], bone[1:][two]), _mix(4, bone[:-2][three], bone[1:-1][three], bone[2:][three]), _mix(5, bone[long]),
    ]
    for p in np.nonzero(kind[where] == _QUOTE)[0].tolist():
        inner = known.quoted[int(code[where[p]])]
        rows.append(np.full(len(inner), seg[p]))
        hashes.append(inner)
    bucket = (np.concatenate(hashes) >> np.uint64(40)).astype(np.int64) % BUCKETS
    both = np.sort(np.concatenate(rows) * BUCKETS + bucket)
    both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    return Segments(both // BUCKETS, both % BUCKETS, len(one), text, use)


@dataclass
class OrdinalModel:
    """Shared weights and ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, one row per score."""
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds[None, :], -40, 40)))


def fit_ordinal(
    seg: np.ndarray, bucket: np.ndarray, grades: np.ndarray, cost: np.ndarray, start: OrdinalModel | None = None,
    ridge: float = 0.01, steps: int = 120, rate: float = 0.3,
) -> OrdinalModel:
    """Maximum a-posteriori fit by full-batch Adam; deterministic.

    seg and bucket are the features, seg being a row of grades and cost.
    """
    used, flat = np.unique(bucket, return_inverse=True)
    n = len(grades)
    w = np.zeros(len(used)) if start is None else start.weights[used].copy()
    t = np.array([0.5, 1.0]) if start is None else start.thresholds.copy()
    p = np.concatenate([w, [t[0], np.log(max(t[1] - t[0], 1e-3))]])
    m, v = np.zeros_like(p), np.zeros_like(p)
    total = cost.sum() or 1.0
    for k in range(1, steps + 1):
        w, t0, gap = p[:-2], p[-2], np.exp(np.clip(p[-1], -6, 3))
        z = np.bincount(seg, weights=w[flat], minlength=n)
        a0, a1 = 1 / (1 + np.exp(-np.clip(z - t0, -40, 40))), 1 / (1 + np.exp(-np.clip(z - t0 - gap, -40, 40)))
        mid = np.maximum(a0 - a1, 1e-9)
        # derivatives of the negative log-likelihood by z - t_0 and z - t_1
        d0 = np.where(grades == 0, a0, np.where(grades == 1, -a0 * (1 - a0) / mid, 0.0)) * cost
        d1 = np.where(grades == 2, a1 - 1, np.where(grades == 1, a1 * (1 - a1) / mid, 0.0)) * cost
        g = np.zeros_like(p)
        g[:-2] = np.bincount(flat, weights=(d0 + d1)[seg], minlength=len(used)) / total * 20 + ridge * w
        g[-2] = -(d0 + d1).sum() / total * 20
        g[-1] = -d1.sum() * gap / total * 20
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        p = p - rate * (1 - k / (steps + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)
    weights = np.zeros(BUCKETS)
    weights[used] = p[:-2]
    return OrdinalModel(weights, np.array([p[-2], p[-2] + np.exp(np.clip(p[-1], -6, 3))]))


#: Steps of the fit in each round of choosing the segments that stand for documents.
STEPS = (80, 40, 40)


def fit_documents(texts: list[str | None], grades: list[int], votes: list[int]) -> OrdinalModel:
    """Fit from labelled documents: grade and number of votes of each."""
    s = segments([(k, t) for k, t in enumerate(texts) if t], _Tokens())
    if not s.n:
        return OrdinalModel(np.zeros(BUCKETS), np.array([1.0, 2.0]))
    y, weight = np.array(grades), np.minimum(np.array(votes, dtype=float), 3.0) / 2
    pairs = np.unique(s.text * s.n + s.use)  # a segment counts once in a document
    text, use = pairs // s.n, pairs % s.n
    # first guess: how much more often a feature stands in objected documents
    order = np.argsort(s.seg, kind="stable")
    begin = np.searchsorted(s.seg[order], np.arange(s.n + 1))
    size = np.diff(begin)[use]
    feature = s.bucket[order][np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - begin[use], size)]
    seen = np.unique(np.repeat(text, size) * BUCKETS + feature)
    grade_of, feature = y[seen // BUCKETS], seen % BUCKETS
    with_ = np.bincount(feature[grade_of == 2], minlength=BUCKETS)
    without = np.bincount(feature[grade_of == 0], minlength=BUCKETS)
    odds = np.log((with_ + 0.1) / ((y == 2).sum() + 1)) - np.log((without + 0.1) / ((y == 0).sum() + 1))
    model = OrdinalModel(np.where((with_ >= 2) & (odds > 0), odds, 0), np.array([0.5, 1.0]))
    # a feature of one document alone says nothing of others
    often = np.bincount(feature, minlength=BUCKETS) >= 2
    kept = often[s.bucket]
    seg, bucket = s.seg[kept], s.bucket[kept]
    # harmless documents: each different segment once, with the votes of all its documents
    calm = y[text] == 0
    calm_cost = np.bincount(use[calm], weights=weight[text[calm]], minlength=s.n)
    objected = np.nonzero(~calm)[0]
    for k, steps in enumerate(STEPS):
        z = s.scores(model.weights)[use[objected]]
        best = objected[np.lexsort((-z, text[objected]))]
        best = best[np.concatenate([[True], text[best][1:] != text[best][:-1]])] if len(best) else best
        # rows: the calm segments, then one row for each (segment, grade) that stands for documents
        stands = use[best] * GRADES + y[text[best]]
        rows, row_of = np.unique(stands, return_inverse=True)
        cost = np.bincount(row_of, weights=weight[text[best]] * np.where(y[text[best]] == 2, 1.0, 0.5), minlength=len(rows))
        calm_rows = np.nonzero(calm_cost)[0]
        number = np.full(s.n, -1, dtype=np.int64)
        number[calm_rows] = np.arange(len(calm_rows))
        calm_kept = number[seg] >= 0
        parts = [(number[seg[calm_kept]], bucket[calm_kept])]
        low, high = np.searchsorted(seg, rows // GRADES), np.searchsorted(seg, rows // GRADES, side="right")
        size = high - low
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - low, size)
        parts.append((np.repeat(np.arange(len(rows)) + len(calm_rows), size), bucket[at]))
        model = fit_ordinal(
            np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts]),
            np.concatenate([np.zeros(len(calm_rows), dtype=np.int64), rows % GRADES]), np.concatenate([calm_cost[calm_rows], cost]),
            None if k == 0 else model, steps=steps,
        )
    return model


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, grade, votes): the votes of all raters, in grades."""
    v = labels.filter("abusive is not null and doc_id is not null").select("doc_id", "rater", "abusive").distinct()
    v = v.groupBy("doc_id").agg(F.count("*").alias("votes"), F.sum((F.col("abusive") > 0).cast("int")).alias("against"))
    share = F.col("against") / F.col("votes")
    v = v.withColumn("grade", F.when(share == 0, 0).when(share <= 0.5, 1).otherwise(2))
    return docs.select("doc_id", "text").join(v, "doc_id")


def fit(docs: DataFrame, labels: DataFrame, limit: int = FIT_DOCUMENTS) -> OrdinalModel:
    """The model of the labelled documents, at most ``limit`` of them."""
    rows = labelled(docs, labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    pdf = rows.select("doc_id", "text", "grade", "votes").toPandas()
    return fit_documents(pdf["text"].tolist(), pdf["grade"].tolist(), pdf["votes"].tolist())


def score_texts(texts: list[str | None], model: OrdinalModel, known: _Tokens | None = None) -> np.ndarray:
    """Highest segment score of each text; minus infinity without a word."""
    known = _Tokens() if known is None else known
    out = np.full(len(texts), -np.inf)
    part: list[tuple[int, str]] = []
    chars = 0

    def close() -> None:
        s = segments(part, known)
        if s.n:
            np.maximum.at(out, s.text, s.scores(model.weights)[s.use])

    for k, t in enumerate(texts):
        for piece in _pieces(t) if t else ():
            part.append((k, piece))
            chars += len(piece)
            if chars >= SLICE_CHARS:
                close()
                part, chars = [], 0
    if part:
        close()
    return out


def severity(docs: DataFrame, model: OrdinalModel, spark: SparkSession) -> DataFrame:
    """(doc_id, source, severity, p_offending) of every row.

    severity is the expected grade, 0 to 2; p_offending is P(grade > 0). A null, empty or wordless text scores 0.
    Without labels nothing scores above the thresholds' start. Rows are not merged.
    """
    shared = spark.sparkContext.broadcast(model)  # BUCKETS weights

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, m = _Tokens(), shared.value
        for b in batches:
            z = score_texts(b["text"].tolist(), m, known)
            above = np.where(np.isfinite(z)[:, None], m.above(np.maximum(z, -1e6)), 0.0)
            yield pd.DataFrame(
                {"doc_id": b["doc_id"], "source": b["source"], "severity": above.sum(axis=1), "p_offending": above[:, 0]}
            )

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")
    )
    return rows.mapInPandas(run, "doc_id bigint, source string, severity double, p_offending double")
