"""Spelling variant grouping: words one edit apart, found in a trie of letter-group counts, point to their most frequent neighbour.

A word's vector counts its letters by group. One inserted, deleted or replaced letter changes the
vector by one surplus and one deficit at most. A trie arranges words by the successive counts; a
search goes down depth first and spends a budget of one surplus and one deficit on children whose
count differs from its own. Words of the leaves it reaches are verified letter by letter.

How it runs:

1. One pass cuts texts into words and adds them up within each task, then over all tasks.
2. The trie is cut into shards at its upper levels: words whose first counts are equal are in one
   shard, so is their subtree. Upper nodes that hold more than SHARD_WORDS words are cut at full depth instead
   (a list of at most words / SHARD_WORDS nodes). Each word is sent to the shards that its budget
   can reach, at most once to each: 37 upper nodes, whatever the number of words.
3. A shard holds its own words, sorted by vector, so that a node is a range of them; the words
   sent there stream through in blocks, and each block goes down the trie together.
4. Links are added up by word, form and number of near words by partial aggregates; roots follow by
   pointer doubling. The number of a form is ten times that of its word, so rounds are few.

Each pair is found once: from the word whose vector is smaller at the first difference, so the surplus
is spent before the deficit; words of one vector from the smaller word. A leaf of very many words with
one vector is looked up by the words with a letter left out, not compared pair by pair.

Defined results: a null text has no words; a null doc_id hashes as the empty text; rows that
repeat count again; a very long text is counted in its own row, a very long word is a word;
an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER as SMALL
from .common import UPPER as CAPITALS
from .common import checkpointed, mix64, slices, table

#: Words have so many code points and occurrences at least; a form has so many times its word's occurrences.
LEAST_LENGTH, LEAST_N, TIMES = 7, 2, 10
#: One run in so many loses a letter.
DAMAGED = 31
#: Frequent letters have a level of the trie each, in this order; then two levels share the other letters of ASCII, and one all beyond.
LETTERS = b"etaoinsrhldu"
LEVELS, TOP = len(LETTERS) + 3, 8
#: An upper node of more words is cut at full depth; a range of so many words is a leaf; a leaf of more is looked up.
SHARD_WORDS, LEAF, LARGE = 20_000, 16, 256
#: Words up to this length are compared as rows of a matrix, longer ones alone.
WIDTH = 48
#: So many distinct words at most are added up in a task before they leave it; so many words go down a trie together.
MOST_COUNTED, BLOCK = 300_000, 200_000

_LOWER = bytes.maketrans(CAPITALS.encode(), SMALL.encode())
_RUN = re.compile(rb"[a-z\xc0-\xff]{%d,}" % LEAST_LENGTH)
_LEVEL = np.full(256, LEVELS - 1)
_LEVEL[97:123] = LEVELS - 3 + np.arange(26) % 2
_LEVEL[list(LETTERS)] = np.arange(len(LETTERS))
_SPREAD = mix64(np.arange(LEVELS, dtype=np.uint64) + np.uint64(0x51ED270B))
_POWERS = (1 << np.arange(LEVELS, dtype=np.int32))[::-1]


def _steps(levels: int) -> list[tuple[int, int]]:
    """(surplus, deficit): the levels at which a search spends, the surplus before the deficit; -1: not at all."""
    return [(-1, -1), *[(i, -1) for i in range(levels)], *[(i, j) for i in range(levels) for j in range(i + 1, levels)]]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the tasks' texts. Words are Latin-1 bytes meanwhile: other characters end a run."""

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array([w.decode("latin-1") for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    seen: Counter[bytes] = Counter()
    for batch in slices(batches, "text", 8 << 20):
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            if not text:
                continue
            start = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
            for w, n in Counter(_RUN.findall(text.encode("latin-1", "replace").translate(_LOWER))).items():
                h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                if h % DAMAGED == 0:
                    at = h % len(w)
                    w = w[:at] + w[at + 1 :]
                    if len(w) < LEAST_LENGTH:
                        continue
                seen[w] += n
        if len(seen) > MOST_COUNTED:
            yield out()
            seen.clear()
    if seen:
        yield out()


def words(docs: DataFrame) -> DataFrame:
    """(word, n): the words of all texts that are long and frequent enough."""
    c = docs.select("doc_id", "text").mapInArrow(_counted, "word string, n long")
    return c.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_N)


def vectors(given: list[bytes]) -> np.ndarray:
    """Letter-group counts, a row for each word."""
    flat = np.frombuffer(b"".join(given), np.uint8)
    row = np.repeat(np.arange(len(given)), np.fromiter(map(len, given), np.int64, len(given)))
    v = np.bincount(row * LEVELS + _LEVEL[flat], minlength=len(given) * LEVELS).reshape(-1, LEVELS)
    return v.astype(np.int16 if v.max(initial=0) < 1 << 14 else np.int32)


def node(v: np.ndarray, levels: int) -> np.ndarray:
    """A number for the node of each vector at a level. It is a sum over levels: a step changes it by a constant."""
    with np.errstate(over="ignore"):
        return (v[:, :levels].astype(np.uint64) * _SPREAD[:levels]).sum(1, dtype=np.uint64)


def _stepped(step: tuple[int, int]) -> np.uint64:
    with np.errstate(over="ignore"):
        return (_SPREAD[step[0]] if step[0] >= 0 else np.uint64(0)) - (_SPREAD[step[1]] if step[1] >= 0 else np.uint64(0))


def _words_of(batch: pa.RecordBatch) -> list[bytes]:
    return [w.encode("latin-1") for w in batch["word"].to_pylist()]


def _upper_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, n = np.unique(node(vectors(_words_of(batch)), TOP), return_counts=True)
        yield pa.record_batch([pa.array(at.view(np.int64)), pa.array(n)], names=["at", "n"])


def _spread(n_shards: int, full: np.ndarray):
    """Deals words to the shards that hold them and to those that they can reach. full: upper nodes that are cut at full depth."""
    upper = [(s, _stepped(s)) for s in _steps(TOP)]
    deep = {s: [(d, _stepped(d)) for d in _steps(LEVELS) if tuple(x if x < TOP else -1 for x in d) == s] for s, _ in upper}
    shard = lambda at: (mix64(at) % np.uint64(n_shards)).astype(np.int64)

    def reached(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, shard), each once."""
        top, bottom, found = node(v, TOP), node(v, LEVELS), []

        def add(where: np.ndarray, at: np.ndarray) -> None:
            found.append(where * n_shards + shard(at))

        with np.errstate(over="ignore"):
            for s, change in upper:
                ok = np.arange(len(v)) if s[1] < 0 else np.flatnonzero(v[:, s[1]])
                at = top[ok] + change
                cut = np.isin(at, full)
                add(ok[~cut], at[~cut])
                if cut.any():
                    for d, change_ in deep[s]:
                        also = ok[cut] if d[1] < 0 else ok[cut][v[ok[cut], d[1]] > 0]
                        add(also, bottom[also] + change_)
        pair = np.unique(np.concatenate(found))
        return pair // n_shards, pair % n_shards

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given, n = _words_of(batch), batch["n"].to_numpy()
            v = vectors(given)
            top = node(v, TOP)
            own = shard(np.where(np.isin(top, full), node(v, LEVELS), top))
            everyone = np.arange(len(given))
            out: list[tuple] = []
            for sent, (who, to) in ((False, (everyone, own)), (True, reached(v))):
                order = np.argsort(to, kind="stable")
                who, to = who[order], to[order]
                cuts = [0, *(np.flatnonzero(np.diff(to)) + 1), len(to)]
                out += [(int(to[a]), sent, b"\n".join([given[i] for i in who[a:b]]), n[who[a:b]].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], names=["shard", "sent", "words", "ns"])

    return rows


def near(a: bytes, b: bytes) -> bool:
    """Exactly one inserted, deleted or replaced letter apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def _aligned(given: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, and the words of up to WIDTH letters as rows, filled up at the end and at the beginning."""
    size = np.fromiter(map(len, given), np.int64, len(given))
    short = [w if len(w) <= WIDTH else b"" for w in given]
    left = np.frombuffer(b"".join(w.ljust(WIDTH, b"\0") for w in short), np.uint8).reshape(-1, WIDTH)
    right = np.frombuffer(b"".join(w[::-1].ljust(WIDTH, b"\0") for w in short), np.uint8).reshape(-1, WIDTH)
    return size, left, right


class Trie:
    """The words of a shard, sorted by their counts: a node is a range of words whose counts are equal up to its level."""

    def __init__(self, given: list[bytes], n: np.ndarray):
        v = vectors(given)
        order = np.lexsort(v.T[::-1])
        self.v, self.n, self.words = v[order], n[order], [given[i] for i in order]
        self.size, self.left, self.right = _aligned(self.words)

    def candidates(self, given: list[bytes], q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(given word, own word) of the leaves that the given words reach within their budgets. spent: 0 nothing, 1 the surplus, 2 both."""
        stack = [(0, len(self.words), 0, np.arange(len(q)), np.zeros(len(q), np.int8))]
        while stack:
            lo, hi, level, who, spent = stack.pop()
            if hi - lo <= LEAF and level < LEVELS:
                yield self._leaf(lo, hi, level, q, who, spent)
            elif level == LEVELS:
                if hi - lo > LARGE:
                    yield self._looked_up(lo, hi, given, who, spent)
                else:
                    yield np.tile(who, hi - lo), np.repeat(np.arange(lo, hi), len(who))
            else:
                counts, want = self.v[lo:hi, level], q[who, level]
                starts = np.concatenate([[0], np.flatnonzero(np.diff(counts)) + 1])
                for a, b in zip(starts, [*starts[1:], hi - lo], strict=True):
                    more = int(counts[a]) - want
                    up, down = (more == 1) & (spent == 0), (more == -1) & (spent == 1)
                    go = np.flatnonzero((more == 0) | up | down)
                    if len(go):
                        stack.append((lo + a, lo + b, level + 1, who[go], (spent + up + down)[go]))

    def _leaf(self, lo: int, hi: int, level: int, q: np.ndarray, who: np.ndarray, spent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rest of the levels at once."""
        found = []
        for k in range(lo, hi):
            more = self.v[k, level:] - q[who, level:]
            off = np.abs(more).sum(1)
            first = more @ _POWERS[level:]  # with one surplus and one deficit left, its sign is that of the first difference
            ok = (off == 0) | ((spent == 0) & (first > 0) & (more.max(1) <= 1) & ((off == 1) | ((off == 2) & (more.min(1) == -1)))) | ((spent == 1) & (off == 1) & (first < 0))
            found.append((who[ok], np.full(int(ok.sum()), k)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _looked_up(self, lo: int, hi: int, given: list[bytes], who: np.ndarray, spent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a leaf of many words: those that agree with one letter left out. Longer words than WIDTH are compared with each other."""
        without, shorter = defaultdict(list), defaultdict(list)
        long = [k for k in range(lo, hi) if self.size[k] > WIDTH]
        for k in range(lo, hi):
            w = self.words[k]
            if len(w) <= WIDTH:
                for i in range(len(w)):
                    without[i, w[:i] + w[i + 1 :]].append(k)
                    shorter[w[:i] + w[i + 1 :]].append(k)
        a, b = [], []
        for i, s in zip(who.tolist(), spent.tolist(), strict=True):
            w = given[i]
            own = set(shorter.get(w, ())) if s == 1 else {k for j in range(len(w)) for k in without.get((j, w[:j] + w[j + 1 :]), ())} if len(w) <= WIDTH else set()
            if len(w) >= WIDTH:
                own.update(long)
            a += [i] * len(own)
            b += own
        return np.array(a, np.int64), np.array(b, np.int64)

    def links(self, given: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(given word, own word): all pairs one edit apart that are found from the given word."""
        q = vectors(given)
        q = q.astype(np.result_type(q, self.v))
        size, left, right = _aligned(given)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        held, n_held = [], 0

        def verify() -> None:
            a, b = (np.concatenate(x) for x in zip(*held, strict=True))
            long = np.maximum(size[a], self.size[b]) > WIDTH
            if long.any():
                far = [(i, k) for i, k in zip(a[long].tolist(), b[long].tolist(), strict=True) if near(given[i], self.words[k])]
                out.append(tuple(np.array(x, np.int64) for x in zip(*far, strict=True)) if far else (a[:0], b[:0]))
                a, b = a[~long], b[~long]
            least = np.minimum(size[a], self.size[b])
            equal = lambda x, y: np.minimum(np.where((d := x[a] != y[b]).any(1), d.argmax(1), WIDTH), least)
            begin, end = equal(left, self.left), equal(right, self.right)
            by = np.abs(size[a] - self.size[b])
            ok = ((by == 0) & (begin < least) & (begin + end >= least - 1)) | ((by == 1) & (begin + end >= least))
            out.append((a[ok], b[ok]))

        for a, b in self.candidates(given, q):
            held.append((a, b))
            n_held += len(a)
            if n_held > 1 << 18:
                verify()
                held, n_held = [], 0
        if held:
            verify()
        a, b = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
        # words of one vector meet from both sides
        same = (size[a] == self.size[b]) & (q[a] == self.v[b]).all(1)
        keep = ~same
        for k in np.flatnonzero(same):
            keep[k] = given[a[k]] < self.words[b[k]]
        return a[keep], b[keep]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by shard, its own words before those sent there."""
    now, trie, own, sent, n_sent = None, None, [], [], 0

    def joined(rows: list[tuple[bytes, bytes]]) -> tuple[list[bytes], np.ndarray]:
        return [w for x, _ in rows for w in x.split(b"\n")], np.concatenate([np.frombuffer(n, np.int64) for _, n in rows])

    def searched() -> Iterator[pa.RecordBatch]:
        nonlocal trie, sent, n_sent
        if own and sent:
            trie = trie or Trie(*joined(own))
            given, n = joined(sent)
            a, b = trie.links(given)
            texts = lambda ws: pa.array([w.decode("latin-1") for w in ws], pa.string())
            yield pa.record_batch([texts([given[i] for i in a]), pa.array(n[a]), texts([trie.words[k] for k in b]), pa.array(trie.n[b])], names=["a", "n_a", "b", "n_b"])
        sent, n_sent = [], 0

    for batch in batches:
        for shard, is_sent, blob, ns in zip(*(batch[c].to_pylist() for c in ("shard", "sent", "words", "ns")), strict=True):
            if shard != now:
                yield from searched()
                now, trie, own = shard, None, []
            if is_sent:
                sent.append((blob, ns))
                n_sent += len(ns) // 8
                if n_sent >= BLOCK:
                    yield from searched()
            else:
                own.append((blob, ns))
    yield from searched()


def links(counted: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): each pair of words of (word, n) that are one edit apart, once."""
    n_words = counted.count()
    n_shards = max(1, -(-n_words // SHARD_WORDS))
    nodes = counted.select("word").mapInArrow(_upper_nodes, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    full = np.array([r["at"] for r in nodes.filter(F.col("n") > SHARD_WORDS).collect()], np.int64).view(np.uint64)  # words / SHARD_WORDS at most
    dealt = counted.select("word", "n").mapInArrow(_spread(n_shards, full), "shard long, sent boolean, words binary, ns binary")
    return dealt.repartition(max(n_shards, 1), "shard").sortWithinPartitions("shard", "sent").mapInArrow(_links, "a string, n_a long, b string, n_b long")


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of the documents."""
    counted = checkpointed(words(docs))
    both = links(counted).select(F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("by"), F.col("n_b").alias("by_n")), F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("by"), F.col("n_a").alias("by_n")))))
    best = F.min(F.when(F.col("by_n") >= TIMES * F.col("n"), F.struct((-F.col("by_n")).alias("n"), F.col("by").alias("word"))))
    found = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    found = checkpointed(counted.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.word").alias("form"), (-F.col("best.n")).alias("form_n")))
    roots = _roots(found.filter("form IS NOT NULL").select("word", "form"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form, by pointer doubling: after k rounds a pointer spans 2^k forms."""
    now = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = checkpointed(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = step.drop("moved")
        if step.filter("moved").isEmpty():
            return now


# The bytes of <doc_id>:<run> go through the usual table of CRC-32, which the first lines make.
ORACLE = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), distinct_runs AS (
  SELECT d, run, count(*) AS n, hex(encode(d || ':' || run)) AS x FROM runs WHERE length(run) >= 7 GROUP BY d, run
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT))), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) AS h
  FROM distinct_runs, crc_table
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, a.n, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, a.n, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, b.n, a.n FROM cut a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS top, arg_min(other, struct_pack(a := -other_n, b := encode(other))) AS other FROM near GROUP BY word
), f AS (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * words.n THEN other END AS form, CASE WHEN top >= 10 * words.n THEN top END AS form_n FROM words LEFT JOIN best ON words.word = best.word
), chain AS (
  SELECT word, word AS here, 0 AS i FROM f
  UNION ALL SELECT chain.word, f.form, i + 1 FROM chain JOIN f ON f.word = chain.here WHERE f.form IS NOT NULL
)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(here, i) AS root FROM chain GROUP BY word) r ON r.word = f.word
"""


def op13(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
