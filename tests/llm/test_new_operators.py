"""The filter audit, exact top-k search and spelling variants against brute force."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from daytrace.llm import htmltext, interaction, spelling, topk

DOCS = "doc_id long, text string, lang string, source string, part string, word string, n long, shard long"
LABELS = "doc_id long, quality int, toxic int, fails string"


def docs_of(spark, rows):
    """(doc_id, text, lang); the other columns clash with names that operators use."""
    return spark.createDataFrame([(i, t, lang, "s", "p", "w", 1, 2) for i, t, lang in rows], DOCS)


def audited(rows, labels):
    first = {}
    for i, t, _ in rows:
        t, i = t or "", math.inf if i is None else i
        first[t] = min(first.get(t, math.inf), i)
    marks = defaultdict(lambda: [False, False])
    for i, q, t in labels:
        marks[i][0] |= q == 1
        marks[i][1] |= t == 1
    items = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": (math.inf if i is None else i) > first[t]}
        items.append((lang or "", {k for k, v in fails.items() if v}, *(marks[i] if i is not None else (False, False))))
    out = {}
    for part in {x[0] for x in items}:
        own = [x for x in items if x[0] == part]
        removed_by = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                removed_by[f] += len(gone)
                left = [x for x in left if f not in x[1]]
                out[part, order, step] = [len(left), len(gone), sum(f in x[1] and bool(x[1] & set(order[: step - 1])) for x in own), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed_by[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda: rng.choice(["alpha", "beta", "Gamma", "été", "x#y", "漢字", "DELTA"]) + str(rng.randrange(90))
    texts = [" ".join(word() for _ in range(rng.choice([1, 20, 199, 200, 201, 400]))) for _ in range(40)]
    texts += ["", "   \n", None, "A" * 3 + "b" * 97, "A" * 4 + "b" * 96, "a a b c", " ".join(f"w{i % 110}" for i in range(220)), " ".join(f"w{i % 109}" for i in range(220)), "nbsp joined word"]
    rows = [(i, t, rng.choice(["en", "de", None, ""])) for i, t in enumerate(texts)]
    rows += [(1000 + i, rng.choice(texts), rng.choice(["en", "de"])) for i in range(30)] + [rows[3], rows[3], (None, texts[0], "en"), (None, "of no other", "de"), (5000, " ".join(f"v{i}" for i in range(30_000)), "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 45, 2)] + [(0, 1, 1), (0, 0, 0), (1005, 1, 0)]
    y = spark.createDataFrame([(*x, "z") for x in labels], LABELS)
    want = audited(rows, labels)
    for size in (1 << 24, 2000):  # many small shards must agree on the ids
        monkeypatch.setattr(interaction, "SHARD_BYTES", size)
        got = interaction.audit(docs_of(spark, rows), y).collect()
        assert {(r.part, r.filter_order, r.step): tuple(r)[3:10] for r in got} == want and len(got) == len(want) == 3 * 600
    assert interaction.audit(docs_of(spark, rows).limit(0), y).count() == 0


def test_matrix_is_the_counts_of_words(spark, monkeypatch):
    monkeypatch.setattr(interaction, "SHARD_BYTES", 12)
    texts = ["a b a", "b c", "", "c c c d", "e a"] * 3
    d = docs_of(spark, [(i, t, "en") for i, t in enumerate(texts)]).coalesce(2)
    m = interaction.matrix(d).collect()
    names = {r["id"]: bytes(r["word"]).decode() for r in interaction.dictionary(d).collect()}
    assert len(m) > 2 and sorted(names.values()) == list("abcde")
    for r in m:
        ends, ids, n = (interaction.unpack(r[c], np.int64) for c in ("indptr", "indices", "data"))
        for k, doc in enumerate(r["doc_ids"]):
            assert {names[i]: c for i, c in zip(ids[ends[k] : ends[k + 1]], n[ends[k] : ends[k + 1]], strict=True)} == Counter(texts[doc].split())


def best(rows, every, k):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, x in ok:
        if q % every == 0:
            scores = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in itertools.zip_longest(x, y, fillvalue=0)))), i) for i, y in ok if i != q)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["spread", "clustered", "ties", "odd", "huge"])
def test_top_k(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "SHARD", 600)
    monkeypatch.setattr(topk, "BLOCK", 5)
    monkeypatch.setattr(topk, "LEAF", 8)
    rng = np.random.default_rng(3)
    n, width = 400, 8
    v = rng.normal(size=(n, width))
    if kind == "clustered":
        v = np.repeat(rng.normal(size=(20, width)) * 5, 20, 0) + v * 0.05
    if kind == "ties":  # a third of all rows are one vector
        v = np.round(v)
        v[: n // 3] = 1
        v = v[rng.permutation(n)]
    rows = [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(v)]
    if kind == "odd":
        rows = rows[:60] + [(100, None), (110, [1.0, None]), (120, [math.nan] * 8), (130, [math.inf] * 8), (None, [1.0] * 8), (140, [2.0, 1.0]), (141, []), (150, []), (160, [0.5] * 12), *[rows[20]] * 2]
    if kind == "huge":
        rows = [(i, [x * 1e6 for x in r]) for i, r in rows[:80]]
    df = spark.createDataFrame([(i, r, 1, 2) for i, r in rows], "vec_id long, embedding array<float>, label int, score int").repartition(3)
    if kind == "odd":  # rows that share an id aren't neighbours of each other
        df, rows = df.dropDuplicates(["vec_id"]), list({i: (i, r) for i, r in rows}.values())
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, 10, groups=4)
    assert sorted(map(tuple, got.collect())) == best([(r.vec_id, r.embedding) for r in df.collect()], 10, 10)


def test_top_k_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (100, [2.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 100 == 0).collect())) == [(0, 1, 100, 2 << 20), (100, 1, 0, 2 << 20)]
    assert topk.top_k(df.limit(1), F.col("vec_id") % 100 == 0).count() == 0 and topk.top_k(df.limit(0), F.col("vec_id") >= 0).count() == 0


def grouped(rows):
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    near = {w: [o for o in words if spelling.near(w.encode("latin-1"), o.encode("latin-1"))] for w in words}
    form = {}
    for w, n in words.items():
        top = min(near[w], key=lambda o: (-words[o], o), default=None)
        form[w] = top if top is not None and words[top] >= 10 * n else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] is not None else None))
    return out


def test_a_damaged_stream_has_no_digests(spark):
    from daytrace.llm import flac

    streams = flac.media(docs_of(spark, [(1, "a text", "en"), (2, "another one " * 30, "en"), (3, "", "en")]))
    whole = {r.doc_id: r for r in flac.stream_digests(streams).collect()}
    assert all(r.error is None and r.payload_bytes % 64 == 0 for r in whole.values()) and len(whole) == 3
    cut = streams.withColumn("media", F.when(F.col("doc_id") == 2, F.expr("substring(media, 1, octet_length(media) - 7)")).otherwise(F.col("media")))
    got = {r.doc_id: r for r in flac.stream_digests(cut).collect()}
    assert got[2].error and got[2].payload_sha256 is None and got[2].media_bytes == whole[2].media_bytes - 7
    assert got[1] == whole[1] and got[3] == whole[3]


def test_near_is_one_edit():
    for a, b, want in (("abc", "abc", False), ("abc", "abd", True), ("abc", "ab", True), ("abc", "xabc", True), ("abc", "acb", False), ("abc", "bcd", False), ("aab", "ab", True), ("", "a", True), ("", "", False)):
        assert spelling.near(a.encode(), b.encode()) == want == spelling.near(b.encode(), a.encode())


@pytest.mark.parametrize("limits", [(20_000, 16, 256), (5, 1, 0)])
def test_spelling_variants(spark, monkeypatch, limits):
    for name, value in zip(("SHARD_WORDS", "LEAF", "LARGE"), limits, strict=True):
        monkeypatch.setattr(spelling, name, value)
    rng = random.Random(6)
    letters = "abcdeéstz÷"
    base = ["".join(rng.choice(letters) for _ in range(rng.choice([7, 8, 9, 12]))) for _ in range(25)] + ["aaaaaaa", "aaaaaaaa", "abababab", "babababa", "z" * 60, "z" * 61, "a" + "z" * 60]
    text = []
    for w in base:
        text += [w] * rng.choice([2, 30, 300, 3000])
        for _ in range(4):
            i = rng.randrange(len(w))
            v = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :], w.upper(), w.title()])
            text += [v] * rng.choice([1, 2, 3, 30])
    rng.shuffle(text)
    rows = [(i, rng.choice([" ", "-", "ß漢", "1"]).join(text[a : a + 40])) for i, a in enumerate(range(0, len(text), 40))] + [(None, " ".join(base)), (7, None), (8, ""), (9, "a" * 100_000), (9, "a" * 100_000)]
    rows += [(50_000, " ".join(text)), rows[0], rows[0]]
    got = spelling.variants(docs_of(spark, [(i, t, "en") for i, t in rows]).repartition(3)).collect()
    want = grouped(rows)
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 60
    assert sum(r.form is not None for r in got) > 10 and any(r.root not in (r.form, r.word) for r in got)


def test_spelling_of_nothing(spark):
    assert spelling.variants(docs_of(spark, [(1, "a short text", "en")])).count() == 0
    assert spelling.variants(docs_of(spark, [(1, "a", "en")]).limit(0)).count() == 0


@pytest.mark.parametrize("pages", [1, 8, 60])
def test_articles_keep_text_whose_classes_only_resemble_furniture(spark, pages):
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice("one two three four five six seven eight nine ten".split()) + str(rng.randrange(99)) for _ in range(n))
    rows, want = [], {}
    shapes = (
        ('<article><h1>{0}</h1><p>{1}</p><div class="related-work"><p>{2}</p></div></article>', "{0}\n{1}\n{2}"),
        ('<article><p>{0}</p><section id="side-effects"><p>{1}</p></section><div class="share-prices">{2}</div></article>', "{0}\n{1}\n{2}"),
        ('<div class="login-guide"><article><p>{0}</p><p>{1}</p></article></div>', "{0}\n{1}"),
        ('<div class="post"><header><h1>{0}</h1></header><p>{1}</p><div class="comment-list">{2}</div></div>', "{0}\n{1}"),
    )
    for k, (shape, text) in enumerate(shapes):
        for i in range(pages):
            parts = [prose(9), prose(80), prose(30)]
            page = '<html><body><header class="site-header">Site</header><nav class="site-nav"><a href="/">Home</a></nav>' + shape.format(*parts) + '<div class="cookie-banner">We use cookies</div><footer>End</footer></body></html>'
            rows.append((k * 1000 + i, f"http://host{k}.example/{i}", page))
            want[k * 1000 + i] = text.format(*parts)
    got = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == want
