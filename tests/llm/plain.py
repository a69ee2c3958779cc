"""Plain Python versions of the pipeline's operators, for small tables."""

import unicodedata
from collections import Counter
from math import isqrt, log2, sqrt

import numpy as np

from bitloom.llm import quality, simhash
from bitloom.llm.textops import text_key


def _js(p, q):
    a, b = sum(p.values()), sum(q.values())
    if not a or not b:
        return None
    total = 0.0
    for k in {*p, *q}:
        x, y = p[k] / a, q[k] / b
        total += (x * log2(2 * x / (x + y)) if x else 0) + (y * log2(2 * y / (x + y)) if y else 0)
    return sqrt(max(total, 0) / 2)


def _char(c):
    k = unicodedata.category(c)
    if c in " \t\n\r\f\v" or k[0] == "Z":
        return "space"
    return {"Ll": "lower", "Lu": "upper"}.get(k, {"L": "letter", "N": "digit", "P": "punct", "S": "symbol"}.get(k[0], "other"))


def _word(w):
    w = w[:-1] if len(w) > 1 and w[-1] in ".," else w
    return w if w in quality.COMMON_WORDS else ""


def judged(rows, rules=quality.QualityRules()):
    """(n_chars, n_words, char distance, word distance, reason) of (lang, text) rows."""
    hist = [(lang, Counter(map(_char, t or "")), Counter(map(_word, (t or "").lower().split()))) for lang, t in rows]
    ref = {}
    for lang, c, w in hist:
        a, b = ref.setdefault(lang, (Counter(), Counter()))
        a.update(c)
        b.update(w)
    out = []
    for lang, c, w in hist:
        n, m = sum(c.values()), sum(w.values())
        x, y = _js(c, ref[lang][0]), _js(w, ref[lang][1])
        enough = sum(ref[lang][1].values()) >= rules.min_reference_words
        reason = "ok"
        if not m:
            reason = "empty"
        elif enough and n >= rules.min_chars and round(x, 6) > rules.char_base + rules.char_slack / sqrt(n):
            reason = "characters"
        elif enough and m >= rules.min_words and round(y, 6) > rules.word_base + rules.word_slack / sqrt(m):
            reason = "words"
        out.append((n, m, x, y, reason))
    return out


def near_groups(rows, rules=simhash.SimHashRules()):
    """{(doc_id, key): smallest of its group} by all pairs of (doc_id, text)."""
    prints = {(i, text_key(t.encode("utf-8", "surrogatepass"))): simhash.fingerprint(t) for i, t in rows if i is not None and t is not None}
    nodes = sorted(k for k, f in prints.items() if f)
    root = {k: k for k in nodes}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    bits = {k: np.array(prints[k], np.int64).view(np.uint64) for k in nodes}
    for n, a in enumerate(nodes):
        for b in nodes[:n]:
            if np.bitwise_count(bits[a] ^ bits[b]).sum() <= rules.max_distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in nodes}


def repeats(rows, m=50):
    """{(doc_id, key): places of words that repeat an earlier passage}."""
    texts = sorted({(i, text_key(" ".join(t.split()).encode())): t.split() for i, t in rows if i is not None and t is not None}.items())
    first, out = {}, {}
    for node, words in texts:
        gone = out.setdefault(node, set())
        for p in range(len(words) - m + 1):
            if first.setdefault(tuple(words[p : p + m]), (node, p)) != (node, p):
                gone.update(range(p, p + m))
    return out


def best_fit(sizes, rules):
    """Bin of each size in the order given."""
    caps = (rules.max_tokens, rules.max_documents, rules.max_attention)
    rooms, out = [], []
    for n in sizes:
        need = (n, 1, n * n)
        best = None
        for k, room in enumerate(rooms):
            if all(r >= d for r, d in zip(room, need)):
                if rules.score == "dot":
                    s = sum(w * d / c * (r / c) for w, d, r, c in zip(rules.weights, need, room, caps))
                else:
                    s = -sum(w * ((r - d) / c) ** 2 for w, d, r, c in zip(rules.weights, need, room, caps))
                if best is None or s > best[0] + 1e-12:
                    best = s, k
        if best is None:
            rooms.append(list(caps))
            best = 0, len(rooms) - 1
        rooms[best[1]] = [r - d for r, d in zip(rooms[best[1]], need)]
        out.append(best[1])
    return out


def longest(rules):
    return min(rules.max_tokens, isqrt(rules.max_attention))
