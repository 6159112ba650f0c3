"""Operators against brute force, on small tables with nulls, empty and very long texts, ties, repeats, extra columns."""

import functools
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from daytrace.llm import decontaminate, flac, graph, htmltext, langid, linededup, lm, minhash, mixing, quality, toxicity

from . import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, size string, score string, key string"


def frame(spark, rows):
    """rows: (doc_id, text) and perhaps lang and source; the other columns clash with names that operators use."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", len(r[1] or ""), "x", "y", "z", "k") for r in rows]
    return spark.createDataFrame(full, DOCS)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.paretovariate(0.7)) % vocabulary}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    base = [prose(rng, rng.choice([3, 8, 30, 120, 300])) for _ in range(40)]
    rows = [*base, "", "   \n\t", None, "One", "one two three four", prose(rng, 20_000)]
    for t in base[:12]:  # exact copies, and copies with a few words changed
        w = t.split()
        rows.append(t)
        for _ in range(3):
            v = list(w)
            for _ in range(max(1, len(v) // 60)):
                v[rng.randrange(len(v))] = f"new{rng.random()}"
            rows.append(" ".join(v))
    return list(enumerate(rows))


def test_near_duplicates(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, texts)).collect()}
    assert got == brute.components(texts)


def family(rng, base, edits, n):
    """Variants of a text, each with so many words of its own."""
    out = []
    for _ in range(n):
        w = base.split()
        for at in rng.sample(range(len(w)), edits):
            w[at] = f"own{rng.getrandbits(40)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_among_many_that_look_alike(spark):
    """Pairs of one template all lie close to 0.75 on either side: a link may rank behind many that are none."""
    rng = random.Random(3)
    rows = list(enumerate(t for _ in range(6) for t in family(rng, prose(rng, 400, 5000), 7, 40)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute.components(rows)


def bridged(rng, n, apart, mark):
    """Two components, of which only the last members link: they differ at the places `apart`, their variants in the word at `mark` too."""
    def other(w, places):
        return [f"own{rng.getrandbits(40)}" if i in places else x for i, x in enumerate(w)]

    a = [f"w{rng.getrandbits(40)}" for _ in range(n)]
    b = other(a, apart)
    return [" ".join(w) for x in (a, b) for w in (*[other(x, [mark]) for _ in range(4)], x)]


def test_near_duplicates_of_components_bridged_by_one_pair(spark):
    """The bridging pairs have similarities of 0.756 and 0.778, and some of them agree in fewer than 0.7 of their bins."""
    rng = random.Random(5)
    shapes = [(36, [32], 0), (40, [20], 0), (400, range(15, 390, 35), 200)]
    rows = list(enumerate(t for shape in shapes for _ in range(30) for t in bridged(rng, *shape)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute.components(rows)


def test_near_duplicates_in_buckets_of_many_parts(spark, monkeypatch):
    """Few members link with their bucket's centre, and parts of 4 members keep most links apart."""
    monkeypatch.setattr(minhash, "PART", 4)
    rng = random.Random(3)
    rows = list(enumerate(t for _ in range(3) for t in family(rng, prose(rng, 400, 5000), 7, 40)))
    rows += [(1000 + i, t) for i, t in enumerate(t for _ in range(4) for t in bridged(rng, 400, range(15, 390, 35), 200))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute.components(rows)
    monkeypatch.setattr(minhash, "PART_SHINGLES", 1000)
    again = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert again == got


def test_near_duplicates_of_nulls_repeats_and_nothing(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "A b c d E f"), (2, None), (3, ""), (4, "a b")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(5, 2, 5, True), (5, 2, 5, True), (None, 2, 5, False), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True)], key=str)
    assert minhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0
    kept = minhash.deduplicate(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5, 5]


def test_components_of_chains_and_stars(spark):
    links = [(i + 1, i) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 160)}


def test_densified_bins_keep_the_similarity():
    rng = np.random.default_rng(1)
    for n in (20, 100, 2000):
        both, a, b = (rng.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) for k in (n, n // 6, n // 6))
        x, y = np.unique(np.concatenate([both, a])), np.unique(np.concatenate([both, b]))
        share = (minhash.bins(x) == minhash.bins(y)).mean()
        assert abs(share - 0.75) < 5 * (0.19 / min(n, 128)) ** 0.5


def test_language_model(spark, texts):
    of = F.when(F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)), F.lit(-1)) == 2, lm.HELD).when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 5, lm.TUNE).otherwise(lm.TRAIN)
    s = lm.score(frame(spark, texts), of)
    want = brute.base_scores(texts, lambda d: brute.fold(d, 7) == 2)
    got = s.scores.collect()
    assert len(got) == len(texts)
    for r in got:
        n, known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, s.total) == (n, known, total) and r.base_score == pytest.approx(base, rel=1e-9)
        assert np.isfinite(r.score) and r.score < 0
    assert np.allclose(s.weights.sum(1), 1)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    # the model itself, from its definition
    tokens = {d: [w.encode() for w in brute.words(t)] + [b" "] for d, t in texts}
    from collections import Counter

    one, two = Counter(), Counter()
    for d, t in tokens.items():
        if brute.fold(d, 7) != 2:
            one.update(t)
            two.update(zip([b" ", *t[:-1]], t, strict=True))
    for r in got[::7]:
        t, total = tokens[r.doc_id], 0.0
        for v, w in zip([b" ", *t[:-1]], t, strict=True):
            c = one[v]
            x = s.weights[int(np.log2(c)) + 1 if c else 0]
            total += np.log10(x[0] * two[v, w] / max(c, 1) + x[1] * one[w] / s.total + x[2] / (s.types + 1))
        assert r.score == pytest.approx(total, rel=1e-9)


def test_language_model_without_training_rows(spark):
    s = lm.score(frame(spark, [(1, "a b"), (None, None)]), F.lit(lm.HELD))
    assert {(r.doc_id, r.n_tokens, r.n_known) for r in s.scores.collect()} == {(1, 3, 0), (None, 1, 0)} and s.total == 0
    assert lm.score(frame(spark, [(1, "a")]).limit(0), F.lit(lm.TRAIN)).scores.count() == 0


def test_weights_by_expectation_maximisation_raise_the_likelihood():
    cells = np.array([(3, 10.0, 0.5, 0.01), (3, 5.0, 0.0, 0.02), (9, 20.0, 0.2, 0.1)])
    like = lambda w: sum(n * np.log(w[int(b)] @ [p, q, 1 / 101]) for b, n, p, q in cells)
    last = -np.inf
    for k in (0, 1, 3, 60):
        now = like(lm.fit_weights(cells, 100, rounds=k))
        assert now >= last - 1e-3
        last = now


def test_decontamination(spark, texts):
    rng = random.Random(2)
    items = [(i, prose(rng, 25)) for i in range(5)] + [(7, "Two, words!"), (8, "?!"), (9, None), (None, prose(rng, 12)), (3, prose(rng, 25))]
    docs = [*texts[:20], (900, "x y " + items[0][1].upper() + " z"), (901, items[1][1]), (902, "two words two words"), (903, f"{items[8][1]} {items[2][1][10:]}"), (901, items[1][1]), (None, items[2][1]), (904, items[5][1] * 3)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    a = decontaminate.annotate(frame(spark, docs), bench)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in a.collect()), key=str)
    want = sorted(brute.contamination(docs, items), key=str)
    assert got == want and sum(w[2] > 0 for w in want) >= 6
    clean = decontaminate.decontaminate(frame(spark, docs), bench)
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted((w[0] for w in want if not w[2]), key=str)
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(frame(spark, docs), bench, remove="spans").collect()}
    assert cut[902] == "" and cut[900] == "x y z" and cut[0] == texts[0][1]
    assert decontaminate.annotate(frame(spark, docs), bench.limit(0)).filter("n_hit > 0").count() == 0
    spans = decontaminate.decontaminate(frame(spark, [(1, "-- Keep This, (and) " + items[0][1].title() + "! Then More.")]), bench, remove="spans").first().text
    assert spans == "-- Keep This, (and) Then More."
    key = lambda df: sorted(map(str, df.collect()))
    big = decontaminate.hits(frame(spark, docs), bench, most_bytes=0)
    assert key(big) == key(decontaminate.hits(frame(spark, docs).dropDuplicates(["doc_id", "text"]), bench))


def test_columns_whose_names_hold_dots(spark):
    docs = frame(spark, [(1, "a b c d e f g h i j k"), (2, "x")]).withColumn("meta.lang", F.lit("q")).withColumn("d", F.lit(1))
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    for out in (decontaminate.decontaminate(docs, bench, remove="spans"), decontaminate.decontaminate(docs, bench), mixing.mix(docs), linededup.deduplicate(docs), minhash.deduplicate(docs)):
        assert out.columns == docs.columns and {r["meta.lang"] for r in out.collect()} <= {"q"}


def test_mixing(spark, texts):
    rng = random.Random(4)
    rows = [(d, t, "en", rng.choice(["b", "a", None, "tiny", "Z"])) for d, t in texts] + [(None, "x y z", "en", "a"), (5000, None, "en", "empty")]
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(brute.words(r[1]))
    want = brute.targets(sizes)
    docs = frame(spark, rows)
    got = mixing.with_copies(docs).collect()
    assert len(got) == len(rows)
    by_id = {r[0]: r for r in rows}
    for r in got:
        assert r.target == pytest.approx(want[by_id[r.doc_id][3]]) and 0 <= r.copies <= 2
        assert r.copies in (int(r.target / max(r.source_size, 1)), int(r.target / max(r.source_size, 1)) + 1)
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)
    assert sorted(map(str, mixing.with_copies(docs).collect())) == sorted(map(str, got))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 20), "en", f"s{i % 3}") for i in range(3000)]
    got = mixing.with_copies(frame(spark, rows)).groupBy("target").agg(F.sum(F.col("size") * F.col("copies")).alias("taken")).collect()
    assert all(abs(r.taken - r.target) < 0.08 * r.target for r in got)


def test_patience_and_blocks():
    assert linededup.patience(list("abcd"), list("xbcy")) == [(1, 1, 2)]
    assert linededup.patience(list("aXbYc"), list("aZbc")) == [(0, 0, 1), (2, 2, 1), (4, 3, 1)]
    assert linededup.patience([], list("a")) == [] and linededup.patience(list("ab"), list("ab")) == [(0, 0, 2)]
    rng = random.Random(8)
    passage = ". ".join(prose(rng, 12, 10_000) for _ in range(6)) + "."
    a, b = f"own words of a {passage} more of a.", f"other start {passage} and its end"
    (block,) = linededup.common_blocks(a, b)
    w = b.split()
    assert " ".join(w[slice(*block)]) == passage
    assert linededup.common_blocks("all different here.", b) == []


def test_line_dedup(spark):
    rng = random.Random(9)
    passage = ". ".join(prose(rng, 13, 9999) for _ in range(6)) + "."
    own = [". ".join(prose(rng, 9, 9999) for _ in range(5)) + "." for _ in range(8)]
    rows = [(1, f"{own[0]}\n{passage}"), (2, f"{own[1]} glued {passage} {own[2]}"), (3, own[3]), (4, own[3]), (5, None), (6, ""), (7, f"All rights reserved.\n{own[4]}"), (8, f"All rights reserved.\n{own[5]}"), (None, f"{passage}\n{own[6]}"), (2, f"{own[1]} glued {passage} {own[2]}")]
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in linededup.deduplicated(docs).collect()}
    assert got[1].text == rows[0][1] and got[7].text == rows[6][1] and got[8].text == rows[7][1] and got[3].text == own[3]
    assert got[2].text == f"{own[1]} glued {own[2]}" and got[2]["__blocks"] == 1
    assert got[None].text == own[6] and got[4].text == "" and got[5].text is None
    out = linededup.deduplicate(docs)
    assert out.columns == docs.columns and sorted((r.doc_id for r in out.collect()), key=str) == sorted([1, 2, 2, 3, 5, 6, 7, 8, None], key=str)
    assert all(r.n_chars == len(r.text or "") for r in out.collect())
    assert linededup.deduplicate(docs.limit(0)).count() == 0


def test_line_dedup_finds_blocks_whose_lines_have_different_first_holders(spark):
    a, b = (" ".join(f"{k}{i}" for i in range(10)) + "." for k in "ab")
    rows = [(1, f"own one.\n{a}"), (2, f"own two.\n{b}"), (3, f"{a}\n{b}\nthird."), (4, f"fourth.\n{a}\n{b}")]
    for n in (1, 40):  # rare lines, and lines of too many texts to be rare
        more = rows + [(10 + i, f"{rows[i % 3][1]}\nown {i}.") for i in range(n)]
        got = {r.doc_id: r.text for r in linededup.deduplicated(frame(spark, more)).collect()}
        assert got[3] == rows[2][1] and got[4] == "fourth."


@pytest.mark.parametrize("rare", [2, 1000])
def test_line_dedup_against_all_pairs(spark, monkeypatch, rare):
    monkeypatch.setattr(linededup, "RARE", rare)
    rng = random.Random(31)
    pool = [prose(rng, rng.choice([1, 2, 5, 9, 14, 30]), 9999).replace(".", "") + rng.choice([".", "!", ""]) for _ in range(120)]
    rows = []
    for i in range(150):
        at = rng.randrange(100)
        lines = pool[at : at + rng.randrange(1, 9)] + [prose(rng, 7, 9999) + "." for _ in range(rng.randrange(3))] + pool[rng.randrange(100) :][: rng.randrange(4)]
        rows.append((i, "\n".join(lines)))
    rows += [(200, rows[3][1]), (3, rows[3][1]), (201, "short copy"), (202, "short copy"), (203, None), (None, rows[7][1] + "\nmore"), (None, ""), (204, "\n".join(pool) * 20)]
    want = brute.line_dedup(rows)
    got = {(r.doc_id, r.before): r for r in linededup.deduplicated(frame(spark, rows).withColumn("before", F.col("text"))).collect()}
    assert all(got[k]["__removed"] <= n for k, n in want.items())  # nothing is deleted that no pair has in common
    removed, total = (sum(n for k, n in x.items() if k[0] != 204) for x in ({k: r["__removed"] for k, r in got.items()}, want))
    assert removed == total if rare == 1000 else removed >= 0.97 * total
    assert sum(n > 0 for n in want.values()) > 50
    assert not brute.repeated_lines(rows, {k: r.text for k, r in got.items()})


def labelled(rng, n):
    rows, labels = [], []
    for i in range(n):
        toxic, junk = rng.random() < 0.3, rng.random() < 0.3
        w = prose(rng, rng.choice([10, 60, 200]), 300).split()
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["badword", "worsting", f"slur{rng.randrange(99)}"]))
        if junk:
            w = [x + rng.choice(["$$$", "%%%"]) for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, int(not junk), int(toxic)))
    return rows, labels


def test_classifiers(spark):
    rows, labels = labelled(random.Random(11), 400)
    more = [(1000, ""), (1001, None), (None, "some words"), (1002, "word " * 30_000), (3, rows[3][1])]
    docs, marks = frame(spark, rows + more), spark.createDataFrame([*labels, (None, 1, 1), (77_777, None, None)], "doc_id long, quality int, toxic int")
    for classify, n, rest, column, least in ((quality.classify, 5, 0, 1, 0.93), (toxicity.classify, 3, 1, 2, 0.85)):
        classify = functools.partial(classify, **({"rounds": 4, "budget": 3000} if column == 2 else {}))
        got = classify(docs, marks, most=150).collect()
        assert len(got) == len(rows) + len(more) and all(0 <= r.score <= 1 for r in got)
        assert all(r.held_out == (brute.fold(r.doc_id, n) == rest) for r in got)
        want = {r[0]: r[column] for r in labels}
        held = [(r.predicted, want[r.doc_id]) for r in got if r.held_out and r.doc_id in want]
        assert np.mean([p == y for p, y in held]) >= least
        same = [r.score for r in got if r.doc_id == 3]
        assert len(same) == 2 and same[0] == pytest.approx(same[1], abs=1e-5)  # sums in other batches round otherwise
        again = {r.doc_id: r.score for r in classify(docs, marks, most=150).collect()}
        assert all(again[r.doc_id] == pytest.approx(r.score, abs=1e-5) for r in got)
        assert classify(docs, marks.limit(0)).count() == len(rows) + len(more)
        assert classify(docs.limit(0), marks).count() == 0


def test_small_draws_train_like_large_ones(spark, monkeypatch):
    """One network, whatever the draw; its cut lies low in a gap that no row of the draw is in."""
    draws = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels, **more: draws.append((len(texts), more)) or toxicity.Network(np.random.default_rng(1)))
    for n in (20, 1200):
        docs = frame(spark, [(i, f"word{i}") for i in range(2 * n)])
        assert toxicity.classify(docs, spark.createDataFrame([(i, i % 2) for i in range(2 * n)], "doc_id long, toxic int")).count() == 2 * n
    assert [more for _, more in draws] == [{}, {}] and draws[0][0] < 100 < 1000 < draws[1][0]
    net = toxicity.Network(np.random.default_rng(1))
    monkeypatch.setattr(net, "logits", lambda texts: np.array([8.0, 7.0, -5.0, -6.0]))
    toxicity._calibrate(net, [b""] * 4, np.array([1, 1, 0, 0], np.float32))
    assert net.slope * -2 + net.shift == pytest.approx(np.log(toxicity.CUT / (1 - toxicity.CUT)))


def test_batched_scores_equal_plain_ones():
    """Forward passes of one text at a time, against the ones that tasks run over many."""
    rng = random.Random(5)
    texts = [prose(rng, n).encode() for n in (1, 2, 47, 48, 49, 84, 85, 200, 700)] + ["é ö same same same".encode(), b"x"]
    labels = [i % 2 for i in range(len(texts))]
    model = quality.train(texts, labels, rounds=3)
    assert np.allclose(model.logits([*texts, b"", b" "]), [brute.quality_logit(model, t) for t in [*texts, b"", b" "]])
    net = toxicity.train(texts, labels, rounds=2, budget=200)
    z = net.logits([*texts, b""])
    assert np.allclose(z[:-1], [net.slope * brute.toxic_logit(net, t) + net.shift for t in texts], atol=1e-4) and z[-1] == pytest.approx(net.prior)
    names = ["xx" if k else "yy" for k in labels]
    speech = langid.train(texts, names, steps=20)
    k, p = langid.predict(texts, speech.languages, speech.tables(), speech.out, speech.bias)
    want = [brute.language(speech, t) for t in texts]
    assert [speech.languages[i] for i in k] == [w[0] for w in want] and np.allclose(p, [w[1] for w in want], atol=1e-4)


def test_draws_are_bounded(spark, monkeypatch):
    from daytrace.llm import labelled as draws

    monkeypatch.setattr(draws, "MOST_ROWS", 20)
    monkeypatch.setattr(draws, "MOST_BYTES", 100)
    docs = frame(spark, [(i, "x" * (200 if i % 5 == 0 else 50)) for i in range(400)])
    marks = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(1, 0), (1, 1)], "doc_id long, toxic int")
    texts, labels = draws.sample(docs, marks, "toxic", F.lit(True), most=100)
    assert 0 < len(texts) < 50 and max(map(len, texts)) == 50 and set(labels) == {0, 1}
    assert draws.sample(docs.limit(0), marks, "toxic", F.lit(True), most=100) == ([], [])


def test_network_gradient():
    rng = np.random.default_rng(0)
    net = toxicity.Network(rng)
    for name in net.p:
        net.p[name] = net.p[name].astype(np.float64)
    x = rng.normal(size=(6, toxicity.WORD_WIDTH + toxicity.CHAR_WIDTH))
    index, length, y, w = rng.integers(0, 6, (5, 3)), np.array([5, 3, 1]), np.array([1.0, 0, 1]), np.ones(3)

    def loss():
        z = net.forward(net.gates(x), index, length)
        return float((w * (np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - z * y)).sum() / w.sum())

    g, dx = net.gradient(x, index, length, y, w)
    for name in ("wf", "ub", "cb", "att", "out"):
        at = tuple(int(rng.integers(0, k)) for k in net.p[name].shape)
        net.p[name][at] += 1e-3
        up = loss()
        net.p[name][at] -= 2e-3
        slope = (up - loss()) / 2e-3
        net.p[name][at] += 1e-3
        assert slope == pytest.approx(float(g[name][at]), rel=0.1, abs=2e-4)
    assert np.isfinite(dx).all()


def test_language_identification(spark):
    rng = random.Random(12)
    sounds = {"xx": ["ka", "to", "mi", "ra"], "yy": ["schr", "ung", "ö", "tz"], "zz": ["eau", "ç", "oux", "é"]}
    say = lambda lang, n: " ".join("".join(rng.choice(sounds[lang]) for _ in range(3)) for _ in range(n))
    rows = [(i, say(lang, rng.choice([4, 40, 200])), lang) for i in range(300) for lang in [rng.choice(list(sounds))]]
    rows += [(900, None, "xx"), (901, "12 34 !?", "xx"), (902, "", "yy"), (903, say("zz", 9000), None), (None, say("yy", 30), "yy")]
    got = langid.identify(frame(spark, rows)).collect()
    want = {r[0]: r[2] for r in rows[:300]}
    held = [r.lang_pred == want[r.doc_id] for r in got if r.held_out and r.doc_id in want]
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and np.mean(held) > 0.95 and by[903].lang_pred == "zz"
    assert {by[k].lang_pred for k in (900, 901, 902)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    assert langid.identify(frame(spark, rows).limit(0)).count() == 0


def test_language_windows_cover_the_text():
    x = bytes(range(1, 251)) * 5
    text, left, w = langid.cut([x, b"", x[:7]])
    assert left[text == 0].sum() - (len(left[text == 0]) - 1) * (langid.WINDOW - langid.STEP) == len(x)
    assert bytes(w[-1][:7]) == x[:7] and not w[-1][7:].any() and set(text) == {0, 2}


def test_flac_round_trips():
    rng = np.random.default_rng(3)
    wave = (128 + 100 * np.sin(np.arange(64 * 70) / 9)).astype(np.uint8).tobytes()
    for p in (bytes(64), flac.payload(b""), b"\xff" * 1088, bytes(rng.integers(0, 256, 64 * 50, dtype=np.uint8)), wave, (bytes(63) + b"\xff") * 33, flac.payload("héllo ".encode() * 9999)):
        (s,) = flac.encode([p])
        ((back, offsets),) = flac.decode([s])
        assert back == p and list(offsets) == list(range(0, len(p), flac.BLOCK))
    assert len(flac.encode([wave])[0]) < 0.7 * len(wave)


def test_flac_predictors_of_orders_3_and_4_are_read():
    """A frame that the encoder doesn't make: fixed order 3, one partition."""
    x = np.array([5, 8, 13, 20, 29, 40, 53, 68, 85, 104, 120, 118, 111, 100, 85, 66])
    r = x[3:] - 3 * x[2:-1] + 3 * x[1:-2] - x[:-3]
    u = [(int(v) << 1) ^ (int(v) >> 31) for v in r]
    bits = "0" + "001011" + "0" + "".join(f"{v & 255:08b}" for v in x[:3]) + "00" + "0000" + "0010" + "".join("0" * (v >> 2) + "1" + f"{v & 3:02b}" for v in u)
    head = np.frombuffer(bytes([0xFF, 0xF8, 0x70, 0x02, 0, 0, 15]), np.uint8)
    body = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    data = np.concatenate([head, flac._crcs(head, np.array([0]), np.array([7]), 8).astype(np.uint8), np.frombuffer(body, np.uint8)])
    crc = int(flac._crcs(data, np.array([0]), np.array([len(data)]), 16)[0])
    data = np.concatenate([data, np.array([crc >> 8, crc & 255], np.uint8)])
    out, n, number = flac.decode_frames(data, np.array([0]), np.array([len(data)]))
    assert out[0].tolist() == x.tolist() and n[0] == 16 and number[0] == 0


def test_flac_catches_damage():
    (s,) = flac.encode([flac.payload(b"some text " * 300)])
    for at in (0, 60, 100, len(s) // 2, len(s) - 1):
        bad = bytearray(s)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            flac.decode([bytes(bad)])


def test_media_columns(spark, texts):
    rows = [*texts, (None, "x"), (3, texts[3][1])]
    got = flac.digests(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for d, t in rows:
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = by[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert flac.digests(frame(spark, rows).limit(0)).count() == 0 and flac.pcm_blocks(flac.media(frame(spark, rows).limit(0))).count() == 0
    (good,) = flac.encode([flac.payload(b"some text")])
    mixed = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(good[:-3] + b"xyz")), (3, None), (4, bytearray(b"no stream")), (5, bytearray(good))], "doc_id long, media binary")
    seen = {r.doc_id: r for r in flac.pcm_blocks(mixed).collect()}
    assert {k for k, r in seen.items() if r.error is None} == {1, 5} and bytes(seen[5].pcm) == flac.payload(b"some text") and all(seen[k].pcm is None for k in (2, 3, 4))
    blocks = flac.pcm_blocks(flac.media(frame(spark, texts))).filter("doc_id = 45").orderBy("sample_offset").collect()
    assert b"".join(bytes(r.pcm) for r in blocks)[: by[45].n_bytes] == texts[45][1].encode() and [r.sample_offset for r in blocks[:3]] == [0, 1024, 2048]


PAGE = """<!DOCTYPE html><html><head><title>T {i}</title><script>var t="</p><article>x</article>";</script><style>p{{}}</style></head><body><nav><ul><li>Home</li><li>{i}</li></ul></nav>
<header>Site</header><div class="cookie-notice">We use cookies</div><aside>side {i}</aside><main><article><h1>Head {i}</h1><p>One &amp; two&nbsp;{i}<br>three <b>bo</b>ld {i}<p>unclosed   white
space {i}</p><form>Name <input></form><div class="ad">Buy</div><ul><li>item {i}</ul><p>Share this page</p></article></main><div id="comments"><p>reader {i}</p></div><!-- <p>no</p> --><footer>&copy; x</footer></body></html>"""


PLAIN = """<html><body><div class="q1"><a href="/">Home</a> <a href="/x">News</a></div><div class="q2"><h2>Title {i}</h2><p>First {i} {body}</p><p>Correspondence to the editor at the usual place.</p>
<div class="z"><p>Nested {i} words</p></div></div><div class="q3">Printed on paper by the usual printer {j}</div></body></html>"""
PAGES = "page_id long, url string, html string"


def extracted(spark, pages, schema=PAGES):
    return {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(pages, schema)).collect()}


def test_extraction(spark):
    pages = [(i, f"http://a.example/p/{i}?x", PAGE.format(i=i)) for i in range(12)] + [(50, "http://b.example/", PAGE.format(i=50)), (51, None, None), (52, "u", ""), (53, "http://c.example/x", "plain &lt;text&gt;"), (3, "http://a.example/p/3?x", PAGE.format(i=3))]
    pages.append((54, "http://d.example/", "<article>" + "<p>long &amp; longer</p>" * 20_000 + "</article>"))
    more = [(*p, "x", 1, True) for p in pages]  # columns that have the names of the operator's own
    got = extracted(spark, more, PAGES + ", host string, role long, main boolean")
    for i in (3, 50):
        assert got[i] == f"Head {i}\nOne & two {i}\nthree bold {i}\nunclosed white space {i}\nitem {i}\nShare this page"
    assert got[51] == "" and got[52] == "" and got[53] == "plain <text>" and got[54] == "\n".join(["long & longer"] * 20_000)
    assert extracted(spark, []) == {}


def test_extraction_of_a_page_does_not_depend_on_its_host(spark):
    """Pages with and without an article element, on hosts of 1 to 200 pages, some with ten copies of one article."""
    pages, want, body = [], {}, "plain words of a story " * 12
    for host, n in enumerate((1, 7, 8, 200)):
        for i in range(n):
            for kind, html in (("plain", PLAIN.format(i=i, body=body, j=i % 3)), ("article", f"<nav>Menu</nav><article class='post'><h1 class='entry-header'>T {i}</h1><p>{body} {i}</p><p>Same on all pages.</p></article><footer>f</footer>")):
                pages.append((len(pages), f"https://{kind}{host}.example/{i}", html))
                want[len(pages) - 1] = f"Title {i}\nFirst {i} {body.strip()}\nCorrespondence to the editor at the usual place.\nNested {i} words" if kind == "plain" else f"T {i}\n{body.strip()} {i}\nSame on all pages."
    for i in range(10):
        pages.append((len(pages), f"https://copies.example/{i}", PLAIN.format(i=5, body=body, j=1)))
        want[len(pages) - 1] = f"Title 5\nFirst 5 {body.strip()}\nCorrespondence to the editor at the usual place.\nNested 5 words"
    assert extracted(spark, pages) == want


def test_template_picks_the_main_slot(spark):
    """Pages whose own text would mislead: the article is short and a constant notice long. The host's classes tell them apart."""
    notice = "Terms of this site in many words that never change. " * 6
    pages = [(i, f"http://a.example/{i}", f"<body><div class='k1'><h2>T{i}</h2><p>{'own words here ' * (1 if i == 4 else 40)}{i}</p></div><div class='k2'><div>{notice}</div></div></body>") for i in range(12)]
    got = extracted(spark, pages)
    assert got[4] == "T4\nown words here 4" and all("Terms" not in t for t in got.values())


def test_template_tells_furniture_in_the_main_slot(spark):
    """Nested containers of constant text or of links go by their slots, whatever their names; paragraphs, varying and single ones stay, and so do those of copies."""
    rng = random.Random(3)
    prose = lambda n: " ".join(f"w{rng.randrange(999)}" for _ in range(n))
    shape = "<body><{e}><h1>{0}</h1><p>{1}</p><div class='x1'><p>Written for you with care.</p></div><p>All rights of the author.</p>" "<div class='x2'>{3}</div><div class='x3'><p>{2}</p></div></{e}></body>"
    rows, want = [], {}
    for k, element in enumerate(("article", "div class='z'")):
        for n in (1, 2, 8, 60):
            for i in range(n):
                a, b, c = prose(4), prose(80), prose(12)
                links = "".join(f"<a href='/{prose(1)}'>{prose(3)}</a> " for _ in range(3))
                page = shape.format(a, b, c, links, e=element).replace("</div class='z'>", "</div>")
                text = [a, b, "Written for you with care.", "All rights of the author.", " ".join(re.sub("<[^>]*>", "", links).split()), c]
                rows.append((len(rows), f"http://{k}-{n}.example/{i}", page))
                want[len(rows) - 1] = "\n".join(text if n == 1 else text[:2] + [text[3], text[5]])
        for i in range(10):  # copies of the last page are no evidence
            rows.append((len(rows), f"http://{k}-copies.example/{i}", page))
            want[len(rows) - 1] = "\n".join(text)
    got = extracted(spark, rows)
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_template_classes(spark):
    pages = spark.createDataFrame([(i, "http://a.example/", PLAIN.format(i=i, body="b", j=i)) for i in range(10)], PAGES)
    _, valid = htmltext.classes(pages)
    rows = valid.collect()
    root = [r for r in rows if r.root and r.times == r.pages]
    assert len(root) == 1 and [r.text for r in root[0].roles].count(True) == 2  # the menu and the constant paragraph
    nested = [r for r in rows if not r.root]
    at = {r.role: r.up for r in root[0].roles}
    assert all(r.slot in at for r in nested) and all(r.slot in m.up for r in rows if r.slot for m in r.roles)
    (t,) = htmltext.templates(pages).collect()
    assert t.main in t.root and [at[r] for r in t.root] == sorted((at[r] for r in t.root), key=lambda up: t.root.index(up[-1]))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(21)
    rows, labels = labelled(rng, 240)
    passage = ". ".join(prose(rng, 13, 9999) for _ in range(6)) + "."
    bench = [(1, prose(rng, 30, 9999))]
    clean = [(2000 + i, prose(rng, 150, 99_999), "en", "s") for i in range(6)]
    rows += clean + [(3000, f"start. {passage} tail"), (3001, f"other. {passage} rest"), (3002, clean[0][1]), (3003, "lead " + bench[0][1] + " end"), (3004, "badword " * 3 + prose(rng, 30)), (3005, None), (3006, "")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert set(out.columns) == set(docs.columns)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert 3004 not in seen["toxicity"] and {r[0] for r in clean} <= set(seen["toxicity"])
    assert passage in seen["line_dedup"][3000] and passage not in seen["line_dedup"][3001] and 3002 not in seen["line_dedup"]
    assert 3003 in seen["near_dedup"] and 3003 not in seen["decontamination"] and {r[0] for r in clean} <= set(seen["decontamination"])
    assert {r.doc_id: r.text for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == seen["mixing"]


def test_queries_and_stages_are_registered():
    import __spark_entry__
    import corpus_pipeline

    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names} >= {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]
