"""The text operators: exact encodings, brute-force alignment, layouts, held-out accuracy."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from typegraph.llm import abuse
from typegraph.llm.abuse import BUCKETS, OFFENDING, OrdinalModel, fit, fit_documents, fit_ordinal, score_texts, segments, severity
from typegraph.llm.contamination import best_alignment, candidates, contaminated, grams_of, leaks, words_of
from typegraph.llm.layout import layout
from typegraph.llm.source_origin import source_origin, verdicts
from typegraph.llm.tokenizer import FOLDER, PATTERN, PairIndexEncoder, encode_corpus, read_ranks
from typegraph.plans.scratch import Scratch

ODD = ["", None, " ", "\n\n \n x", "don't we'll I'VE", "aaaaaaaaaaaaaaaaa", "<|endoftext|> is text", "日本語 مرحبا Ω≈ç√ 🏴󠁧󠁢󠁳󠁣󠁴󠁿", "a\x00b\x1c\x1d\x85​﻿", "x" * 20_000, "1234567 12 3", "\t\t  a \r\n b  "]


@pytest.fixture(scope="module")
def encoder():
    return PairIndexEncoder(read_ranks())


def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(), special_tokens={})


def ids_of(encoder, texts):
    offsets, ids = encoder.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


def test_encoding_is_exact(encoder):
    rnd = random.Random(7)
    alphabet = "abcdefgh ABC  \n.,'s{}()_0123ßéñ漢字🙂"
    texts = ODD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(400))) for _ in range(300)]
    want = reference()
    assert ids_of(encoder, texts) == [want.encode_ordinary(t) if t else [] for t in texts]


def test_round_trip(encoder):
    back = {r: t for t, r in read_ranks().items()}
    for t, ids in zip(ODD, ids_of(encoder, ODD)):
        assert b"".join(back[i] for i in ids).decode() == (t or "")


def test_forgetting_changes_nothing(monkeypatch):
    import typegraph.llm.tokenizer as tk

    monkeypatch.setattr(tk, "REMEMBERED", 3)
    e = PairIndexEncoder(read_ranks())
    want = reference()
    for t in ("one two three four five", "two six seven", "one two"):
        assert ids_of(e, [t]) == [want.encode_ordinary(t)]


def test_encode_corpus(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r["doc_id"]: r["ids"] for r in encode_corpus(df, spark, folder=FOLDER).collect()}
    want = reference()
    assert got == {k: want.encode_ordinary(t) if t else [] for k, t in enumerate(ODD)}
    assert encode_corpus(df.limit(0), spark).count() == 0


# ---- passages of test items


def brute_alignment(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 3, h[i][j - 1] - 3)
    return max(map(max, h))


def test_alignment_brute():
    rnd = random.Random(2)
    for _ in range(60):
        a = [rnd.randrange(6) for _ in range(rnd.randrange(1, 25))]
        b = [rnd.randrange(6) for _ in range(rnd.randrange(1, 40))]
        assert best_alignment(np.array(a), np.array(b))[0] == brute_alignment(a, b)


ITEM = [f"w{k}" for k in range(60)]
OWN = [True] * 58


@pytest.mark.parametrize(
    "text,found",
    [
        (ITEM[10:30], True),
        (ITEM[10:29], False),
        (["x"] * 40 + ITEM[5:26] + ["y"] * 5000, True),
        ([w if k % 6 else "other" for k, w in enumerate(ITEM[3:30])], True),
        (ITEM[10:24] + ["x"] * 30 + ITEM[24:36], False),
        (sorted(ITEM[10:40], key=lambda w: hash(w) % 97), False),
        (ITEM[0:12] + ["z"] * 9 + ITEM[30:42] + ["z"] * 9 + ITEM[12:34], True),
        ([], False),
        (["x"], False),
    ],
)
def test_leaks(text, found):
    assert leaks(ITEM, OWN, text, 20) is found


def test_contaminated(spark):
    shared = " ".join(f"s{k}" for k in range(30))
    items = [(1, shared + " " + " ".join(f"a{k}" for k in range(50))), (2, shared + " " + " ".join(f"b{k}" for k in range(50))), (3, None), (4, ""), (5, "too short"), (6, "same words here again"), (7, "same words here again"), (None, "x")]
    docs = [
        (1, "Intro. " + " ".join(f"A{k}," for k in range(10, 35))), (1, "Intro. " + " ".join(f"A{k}," for k in range(10, 35))),
        (2, shared), (3, None), (4, ""), (5, " ".join(f"b{k}" for k in range(19))),
        (6, "-".join(f"b{k}" if k % 7 else "swapped" for k in range(40))), (7, " ".join(f"a{k} b{k}" for k in range(50))),
        (8, " ".join(f"a{k}" for k in range(25)) + " and " + " ".join(f"b{k}" for k in range(25))), (9, "same words here again " * 10),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(9)).withColumn("words", F.lit("x"))
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = sorted(tuple(r) for r in contaminated(d, i, spark).collect())
    assert got == [(1, 1), (6, 2), (8, 1), (8, 2)]
    assert contaminated(d.limit(0), i, spark).count() == 0
    assert contaminated(d, i.limit(0), spark).count() == 0


def test_blocks_of_long_items():
    item = [f"v{k}" for k in range(1000)]
    own = [True] * 998
    for first in range(0, 980, 37):
        assert leaks(item, own, ["x"] * 9 + item[first : first + 20] + ["y"] * 9, 20)
        assert not leaks(item, own, ["x"] * 9 + item[first : first + 17] + ["y"] * 9, 20)
    assert leaks(item, own, item, 20) and not leaks(item, [False] * 998, item, 20)


def test_memory_does_not_follow_the_text():
    import tracemalloc

    rnd = random.Random(8)
    peaks = []
    for n in (100_000, 1_000_000):
        text = [rnd.choice(ITEM) for _ in range(n)]
        full = [w for k in range(0, n, 500) for w in (ITEM[7:11] + text[k : k + 496])]
        tracemalloc.start()
        leaks(ITEM, OWN, full[:n], 20)
        peaks.append(tracemalloc.get_traced_memory()[1] / n)
        tracemalloc.stop()
    assert peaks[1] < 1.2 * peaks[0] < 200  # bytes a word: the codes of the text, no matrix over it


def test_common_phrases_make_few_candidates(spark):
    """Each item owns many phrases by accident that stand in nearly all documents."""
    rnd = random.Random(9)
    phrases = [[f"p{k}a", f"p{k}b", f"p{k}c", f"p{k}d"][: 3 + k % 2] for k in range(300)]
    items, docs, true = [], [], set()
    for i in range(30):
        mine = phrases[10 * i : 10 * i + 10]
        items.append((i, [w for p in mine for w in [*p, *(f"i{i}w{rnd.randrange(10**6)}" for _ in range(5))]]))
    for d in range(120):
        words = [w for p in rnd.sample(phrases, 150) for w in [*p, f"f{rnd.randrange(10**6)}"]]
        if d % 10 == 0:
            i = rnd.randrange(30)
            at = rnd.randrange(len(items[i][1]) - 30)
            words[200:200] = items[i][1][at : at + 30]
            true.add((d, i))
        docs.append((d, words))
    frame = lambda rows, c: spark.createDataFrame([(k, " ".join(w)) for k, w in rows], f"{c} long, text string")
    df, it = frame(docs, "doc_id"), frame(items, "item_id")
    assert {tuple(r) for r in contaminated(df, it, spark).collect()} == true
    seeds = it.select("item_id", F.posexplode(grams_of(words_of(F.col("text")))).alias("k", "gram"))
    found = {tuple(r) for r in candidates(df, seeds, Scratch(spark, "test")).collect()}
    at_will = sum(len({w for w in words} & set(item)) >= 6 for _, words in docs for _, item in items)
    assert true <= found and at_will > 3000 and len(found) < 0.05 * at_will


# ---- origins of source files

HAND = """using System;
namespace Acme.Shop.Orders;
// the numbers below are generated by the database, do not set them by hand
public class OrderPlanner%d
{
    private readonly IClock _clock;
    public OrderPlanner%d(IClock clock) { _clock = clock; }
    public int Plan(int orderId)
    {
        if (orderId < 0) throw new ArgumentException("order " + orderId);
        var limit = _clock.Now.AddDays(-%d);
        return limit.Day > 3 ? orderId : 0;
    }
}
"""
GENERATED = "namespace Acme.Shop\n{\n  partial class Form\n  {\n    void Init()\n    {\n" + "".join(
    f'      this.box{k}.Location = new Point({k}, {k * 7});\n      this.box{k}.Name = "box{k}";\n' for k in range(30)
) + "    }\n  }\n}\n"
MINIFIED = "!function(e,t){" + "".join(f'if(!q[{k}])throw Error("e{k}");for(var o={k};o--;)jo(o<<6);' for k in range(60)) + "}();"
DATA = "namespace Acme.Shop;\npublic static class T\n{\n  public static int[] V = {\n" + "\n".join("    " + ", ".join(str(k * 7919 % 99991) for k in range(r, r + 12)) + "," for r in range(40)) + "\n  };\n}\n"
EMITTER = 'namespace Acme.Shop;\npublic class Emitter\n{\n    public string Head(string name)\n    {\n        var s = "// <auto-generated/>";\n        return s + name.Trim();\n    }\n    public int N => 3;\n    public void Go(int k) { if (k > N) Call(k); else Stop(); }\n}\n'
TWICE = HAND.replace("Plan", "Twice") % (1, 1, 1) + "".join(f"class T{k} {{ int Go{k}(int a) {{ return a * {k} + other.Count; }} }}\n" for k in range(6))
LIB = "using System;\nnamespace Fern.Core\n{\n" + "".join(
    f"  public class Fern{k}\n  {{\n    public int Get{k}(int a) {{ var row{k} = a * {k} + offset; return row{k} > limit ? row{k} : a; }}\n  }}\n" for k in range(8)
) + "}\n"


def test_verdicts():
    flags = lambda c: verdicts("repos/r/src/Acme.Shop/A.cs", c)[2:5]  # noqa: E731 (minified, generated, data)
    assert flags(HAND % (1, 1, 1)) == (False, False, False) and flags(EMITTER) == (False, False, False)
    assert flags(GENERATED)[1] and flags(MINIFIED)[0] and flags(DATA)[2]
    assert flags("﻿/*! x */\r\n" + MINIFIED)[0]
    for odd in (None, "", " \n", "\x00", "{" * 5000, '"', "/*", "é" * 100_000, "#", "//", ")" * 9 + ";", "\udc80 x"):
        verdicts("x", odd)


@pytest.mark.parametrize("path", ["a/vendor/x-1.0/A.cs", "a/obj/X.g.cs", "a/js/x.min.js", "A.cs", ""])
@pytest.mark.parametrize("head", ["", "// <auto-generated/> do not edit\n", "// Licensed to the Fern Foundation\n"])
def test_paths_and_heads_do_not_count(path, head):
    assert verdicts(path, head + HAND % (1, 1, 1))[2:5] == (False, False, False)
    assert verdicts(path, None)[2:] == (False, False, False, None, [])


def test_layout_ignores_form():
    a, b = layout("int a = 1; // x\nint b = 2;"), layout("/* y */int a=1;\r\n\r\n   int b\n=2;")
    assert a.canonical == b.canonical and a.statements == b.statements == 2 and layout("").lines == 0


def test_source_origin(spark):
    rows = [(f"repos/r{k}/src/Acme.Shop/Orders/OrderPlanner{k}.cs", HAND % (k, k, k * 13)) for k in range(8)]
    rows += [
        ("repos/a/src/Acme.Shop/Form.cs", GENERATED), ("repos/a/src/Acme.Shop/app.js", MINIFIED), ("repos/a/src/Acme.Shop/T.cs", DATA),
        ("repos/a/src/Acme.Shop/Emitter.cs", EMITTER), ("repos/a/src/Acme.Shop/Util/Fern1.cs", LIB),
        ("repos/b/src/Beta.Web/Util/Fern2.cs", "// ours\n" + LIB), ("repos/c/src/Gamma.Api/Util/Helper.cs", LIB.replace("Fern.Core", "Gamma.Api").replace("Get3", "Fetch3")),
        ("repos/d/src/Delta.Job/vendor/Fern7.cs", None), ("repos/d/src/Delta.Job/Util/Own.cs", " \n"), (None, LIB),
        ("repos/e/src/Eta.Web/A.cs", TWICE), ("repos/e/src/Eta.Web/Moved/A.cs", TWICE),
    ]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "file_path string, code string").withColumn("project", F.lit(1)).withColumn("known", F.lit("x"))
    got = {r[0]: r[1] for r in source_origin(df, spark).collect()}
    want = {p: "hand" for p, _ in rows if p}
    want |= {"repos/a/src/Acme.Shop/Form.cs": "generated", "repos/a/src/Acme.Shop/app.js": "minified", "repos/a/src/Acme.Shop/T.cs": "data"}
    want |= dict.fromkeys(["repos/a/src/Acme.Shop/Util/Fern1.cs", "repos/b/src/Beta.Web/Util/Fern2.cs", "repos/c/src/Gamma.Api/Util/Helper.cs"], "vendored")
    assert got == want
    assert source_origin(df.limit(0), spark).count() == 0


# ---- abusive content


@pytest.mark.parametrize(
    "plain,tricked",
    [
        ("you are an idiot", "y0u 4r3 4n 1d10t"), ("you are an idiot", "yoouuu areee an idiiiot"), ("you are an idiot", "YOU ARE AN IDIOT"),
        ("you are an idiot", "you are an i d i o t"), ("you are an idiot", "you are an i-d-i-o-t"), ("you are an idiot", "y​ou a​re an idi­ot"),
        ("you are an idiot", "уоu аrе аn іdіоt"), ("eres inútil", "eres inutil"), ("eres inútil", "eres inÃºtil"),
    ],
)
def test_spelling_tricks(plain, tricked):
    a, b = bag(plain), bag(tricked)
    assert len(a & b) >= 0.6 * len(a)


def bag(*texts):
    return set(segments(list(enumerate(texts)), abuse._Tokens()).bucket.tolist())


def test_quotes_are_features_of_their_own():
    assert not bag('the word "moron" here') >= bag("the word moron here")


def brute_features(words):
    """Names of the features of one segment without quotations."""
    bones = [re.sub("[aeiouy0-9*@$!]+", "", w) or "-" for w in words]
    out = {("w", w) for w in words} | {("b", a, b) for a, b in zip(["<", *words], [*words, ">"])}
    out |= {("s2", a, b) for a, b in zip(bones, bones[1:])} | {("s3", *t) for t in zip(bones, bones[1:], bones[2:])}
    return out | {("s1", b) for b in bones if len(b) >= 3}


def test_features_brute():
    rnd = random.Random(5)
    words = ["moron", "the", "a", "stale", "cache", "go", "eat"]
    for _ in range(40):
        sentence = [[rnd.choice(words) for _ in range(rnd.randrange(1, 6))] for _ in range(rnd.randrange(1, 4))]
        text = ", ".join(" ".join(c) for c in sentence)
        s = segments([(0, text), (1, text)], abuse._Tokens())
        parts = {tuple(w for c in sentence for w in c)} | ({tuple(c) for c in sentence} if len(sentence) > 1 else set())
        assert s.n == len(parts) and len(s.use) == 2 * (1 + (len(sentence) if len(sentence) > 1 else 0))
        sizes = sorted(len(brute_features(p)) for p in parts)
        assert sorted(np.bincount(s.seg, minlength=s.n).tolist()) == sizes  # no buckets meet among so few


def test_long_texts_are_cut_at_sentences(monkeypatch):
    rnd = np.random.default_rng(1)
    m = OrdinalModel(rnd.normal(size=BUCKETS), np.array([1.0, 2.0]))
    texts = ["You are late. The cache is slow, so wait.\n" * 30 + "Only this differs!", None, "", "word " * 400, "x"]
    want = score_texts(texts, m)
    monkeypatch.setattr(abuse, "SLICE_CHARS", 50)
    monkeypatch.setattr(abuse, "REMEMBERED", 3)
    assert np.allclose(score_texts(texts, m), want) and np.isinf(want[1]) and np.isinf(want[2])


def test_ordinal_fit_recovers_order():
    rnd = np.random.default_rng(0)
    bucket, grades = [], []
    for _ in range(600):
        k = int(rnd.integers(0, 3))
        bucket += [k, int(10 + rnd.integers(0, 5))]
        grades.append(k if rnd.random() > 0.05 else int(rnd.integers(0, 3)))
    m = fit_ordinal(np.repeat(np.arange(600), 2), np.array(bucket), np.array(grades), np.ones(600))
    z = m.weights[:3]
    assert z[0] < z[1] < z[2] and m.thresholds[0] < m.thresholds[1]
    above = m.above(z)
    assert above[0, 0] < 0.5 < above[1, 0] and above[1, 1] < 0.5 < above[2, 1]


def corpus(rnd, n):
    nouns, adj = ["cache", "parser", "rank", "index", "hub", "route"], ["stale", "slow", "nested", "cyclic"]
    bad = ["You are a {i}, and everybody knows it.", "Shut up, you {i}.", "Only a {i} would merge this.", "I hope you starve, {i}."]
    insult = ["moron", "idiot", "clown", "parasite", "liar"]
    fine = ['Posts with words such as "{i}" are hidden by the filter.', "Kill the {a} worker and reap its children.", "The {a} {n} is garbage collected."]
    out = []
    for k in range(n):
        s = [f"The {rnd.choice(adj)} {rnd.choice(nouns)} costs {rnd.randrange(99)} percent." for _ in range(rnd.randrange(1, 4))]
        g = int(rnd.random() < 0.3)
        if g or rnd.random() < 0.4:
            s.insert(rnd.randrange(len(s) + 1), rnd.choice(bad if g else fine).format(i=rnd.choice(insult), a=rnd.choice(adj), n=rnd.choice(nouns)))
        out.append((" ".join(s), g))
    return out


def test_held_out_accuracy():
    rnd = random.Random(3)
    train, test = corpus(rnd, 500), corpus(rnd, 300)
    m = fit_documents([t for t, _ in train], [2 * (g if rnd.random() > 0.05 else 1 - g) for _, g in train], [1] * len(train))
    found = m.above(score_texts([t for t, _ in test], m))[:, 0] >= OFFENDING
    assert (found == np.array([bool(g) for _, g in test])).sum() >= 0.95 * len(test)


def test_held_out_labels(spark):
    """Five folds over the labelled documents of sf0.1, with the threshold that is shipped."""
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "doc_labels"))
    rows = abuse.labelled(docs.dropDuplicates(["doc_id"]), labels).orderBy("doc_id").collect()
    fold = np.random.default_rng(1).integers(0, 5, len(rows))
    found, true = np.zeros(len(rows), dtype=bool), np.array([r["grade"] == 2 for r in rows])
    for k in range(5):
        train = [r for r, f in zip(rows, fold) if f != k]
        m = fit_documents([r["text"] for r in train], [r["grade"] for r in train], [r["votes"] for r in train])
        z = score_texts([r["text"] for r, f in zip(rows, fold) if f == k], m)
        found[fold == k] = np.where(np.isfinite(z), m.above(np.maximum(z, -1e6))[:, 0] >= OFFENDING, False)
    assert (found & true).sum() >= 0.6 * true.sum() and (found & true).sum() >= 0.8 * found.sum()


def test_severity_edges(spark):
    rnd = random.Random(4)
    rows = [(k, t, "s", g) for k, (t, g) in enumerate(corpus(rnd, 120))] + [(900, None, None, 0), (901, "", "s", 0), (902, " \n", "s", 0), (903, "!!! 🙂", "s", 0), (904, "word " * 50_000, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, g int").withColumn("severity", F.lit("clash"))
    labels = docs.select("doc_id", F.lit("r").alias("rater"), F.col("g").alias("abusive")).union(docs.select("doc_id", F.lit("q"), F.lit(None).cast("int")))
    labels = labels.union(labels)
    got = {r["doc_id"]: r for r in severity(docs, fit(docs, labels), spark).collect()}
    assert len(got) == len(rows) and all(got[k]["severity"] == 0 for k in (900, 901, 902, 903))
    assert all(0 <= r["severity"] <= 2 for r in got.values())
    empty = fit(docs, labels.limit(0))
    assert isinstance(empty, OrdinalModel) and len(empty.weights) == BUCKETS
    assert severity(docs, empty, spark).filter(F.col("p_offending") > 0.3).count() == 0
    assert severity(docs.limit(0), empty, spark).count() == 0


def test_queries_over_small_tables(spark):
    from typegraph.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    found = QUERIES["p2_found"](spark, d)
    assert [c for c, _ in found.dtypes] == ["file_path"] and found.count() > 0
    ids = QUERIES["p6_ids"](spark, d)
    assert ids.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert ids.count() == spark.read.parquet(d + "/documents.parquet").count()
    assert QUERIES["p7_found"](spark, d).dtypes == [("doc_id", "bigint"), ("item_id", "bigint")]
    assert QUERIES["p8_found"](spark, d).dtypes == [("doc_id", "bigint")]
    assert re.match("doc_id", QUERIES["p8_scores"](spark, d).columns[0])
