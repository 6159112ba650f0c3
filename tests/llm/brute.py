"""Plain Python versions of the operators, for small tables."""

import math
import re
import zlib
from collections import Counter

import numpy as np

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def fold(doc_id, n):
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def components(rows):
    """{doc_id: (n_shingles, component_id)} of [(doc_id, text)] with distinct ids."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def base_scores(rows, held):
    """{doc_id: (n_tokens, n_known, N, base)}."""
    tokens = {d: [w.encode() for w in words(t)] + [b" "] for d, t in rows}
    c = Counter(w for d, t in tokens.items() if not held(d) for w in t)
    n, v = sum(c.values()), len(c)
    return {d: (len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) for d, t in tokens.items()}


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(docs, items):
    """[(doc_id, n_words, n_hit, sorted item ids)] in order."""
    windows = {}
    for item, text in items:
        w = bench_words(text)
        for i in range(max(len(w) - 9, 1) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add("" if item is None else str(item))
    out = []
    for d, text in docs:
        w, hit, found = bench_words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[x]
        out.append((d, len(w), len(hit), sorted(found)))
    return out


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """{source: target}: capped sources are settled one by one, the rest shares what is left."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, left, out = share * sum(sizes.values()), set(order), {}
    while left:
        rest = total - sum(out.values())
        per = {s: rest * w[s] / sum(w[x] for x in left) for s in left}
        over = [s for s in left if per[s] >= most * sizes[s]]
        if not over:
            return out | per
        for s in over:
            out[s] = most * sizes[s]
        left -= set(over)
    return out


def line_dedup(rows):
    """{(doc_id, text): deleted characters} by aligning every document with every earlier one; a null id is the last."""
    from daytrace.llm import linededup

    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    out, seen = {}, {}
    for d, text in rows:
        t = text or ""
        w = list(linededup.WORD.finditer(t))
        if t in seen and seen[t] != d:
            out[d, text] = len(t) if len(w) >= 20 else 0
            continue
        seen.setdefault(t, d)
        at, gone = [m.start() for m in w] + [len(t)], set()
        for e, other in seen.items():
            if other != d and e:
                for a, b in linededup.common_blocks(e, t):
                    gone |= set(range(at[a], at[b]))
        out[d, text] = len(gone)
    return out


def repeated_lines(rows, left):
    """Runs of whole lines with 20 words or more that are left in a document though an earlier one has them; left: {(doc_id, text): remaining text}."""
    def lines(text):
        return [" ".join(x.split()) for x in re.split(r"\n|(?<=[^.!?][.!?]) ", text or "") if x.split()]

    def runs(ls):
        """The shortest ones from each line on."""
        n, out = [len(x.split()) for x in ls], set()
        for i in range(len(ls)):
            j, total = i, 0
            while j < len(ls) and total < 20:
                total, j = total + n[j], j + 1
            if total >= 20:
                out.add(tuple(ls[i:j]))
        return out

    seen, out = {}, []
    for (d, text), rest in sorted(left.items(), key=lambda kv: (kv[0][0] is None, kv[0][0] or 0)):
        out += [(d, r) for r in runs(lines(rest)) if seen.get(r, d) != d]
        for r in runs(lines(text)):
            seen.setdefault(r, d)
    return out


def quality_logit(model, text):
    """The mean of the values of all features of a text, one by one."""
    from daytrace.llm import quality
    from daytrace.llm.labelled import ngrams

    values, w = [], text.split()
    for k, word in enumerate(w):
        _, bucket, whole = ngrams([word], quality.SIZES, quality.BUCKETS)
        values += [model.value[b] for b in (*bucket, *whole)]
        if k:
            pair = [0, 0] if word == w[k - 1] else [0, 1]
            both = np.array([ngrams([x], quality.SIZES, quality.BUCKETS)[2][0] for x in (w[k - 1], word)])
            values.append(model.value[quality.bigrams(both, np.array(pair))[0]])
    return model.bias + (sum(values) / len(values) if values else 0.0)


def toxic_logit(net, text):
    """The strongest window's logit before the curve: one window, one word, one gate at a time."""
    from daytrace.llm import toxicity as t
    from daytrace.llm.labelled import ngrams

    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    n, best, x = t.STATE, -np.inf, []
    for word in text.lower().split():
        _, bucket, whole = ngrams([word], t.SIZES, t.CHAR_BUCKETS)
        chars = net.chars[bucket].mean(0) if len(bucket) else np.zeros(t.CHAR_WIDTH)
        x.append(np.concatenate([net.words[whole[0] % t.WORD_BUCKETS], chars]).astype(float))
    for at in range(0, max(len(x) - t.WINDOW + t.STEP, 1) if x else 0, t.STEP):
        window, states = x[at : at + t.WINDOW], []
        for way in "fb":
            h, row = np.zeros(n), []
            for v in window if way == "f" else window[::-1]:
                g, a = v @ net.p["w" + way] + net.p["c" + way], h @ net.p["u" + way]
                z, r = sigmoid(g[:n] + a[:n]), sigmoid(g[n : 2 * n] + a[n : 2 * n])
                h = h + z * (np.tanh(g[2 * n :] + r * a[2 * n :]) - h)
                row.append(h)
            states.append(row if way == "f" else row[::-1])
        s = np.concatenate([np.array(states[0]), np.array(states[1])], 1)
        alpha = np.exp(s @ net.p["att"])
        best = max(best, float((alpha / alpha.sum()) @ s @ net.p["out"] + net.p["bias"][0]))
    return best


def language(net, text):
    """(language, probability) by running each filter over each window's bytes."""
    from daytrace.llm import langid

    total, weight = np.zeros(len(net.languages)), 0
    for at in range(0, max(len(text) - langid.WINDOW + langid.STEP, 1), langid.STEP):
        b = text[at : at + langid.WINDOW]
        e = net.embed[np.frombuffer(b.ljust(langid.WINDOW, b"\0"), np.uint8)].astype(float)
        h = [max(0.0, max(float(sum(e[i + j] @ net.filters[w][j][:, f] for j in range(w))) for i in range(langid.WINDOW - w + 1))) for w in langid.WIDTHS for f in range(langid.FILTERS)]
        z = np.array(h) @ net.out + net.bias
        p = np.exp(z - z.max())
        total += p / p.sum() * len(b)
        weight += len(b)
    k = int(total.argmax())
    return net.languages[k], total[k] / weight
