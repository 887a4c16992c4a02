"""Plain Python models of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict

import xxhash

WS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def licences(rows, phrases):
    out = {}
    for doc, text in rows:
        words = ALNUM.findall(lower_ascii(text))
        hits = [(i, label) for phrase, label in phrases.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        starts = [i for i, _ in hits]
        out[doc] = (len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits})))
    return out


def licence_method(text, phrases, templates, min_run=3, min_cover=0.6, max_gap=40):
    """(labels, score): all maximal runs by direct search, best chains by comparing all pairs of runs."""
    words = ALNUM.findall(lower_ascii(text))
    labels, score = set(), 0.0
    for phrase, label in phrases.items():
        p = phrase.split()
        if any(words[i : i + len(p)] == p for i in range(len(words))):
            labels.add(label)
            score = 1.0
    everything = [ALNUM.findall(lower_ascii(x)) for _, x in templates] + [p.split() for p in phrases]
    known = {tuple(x[i:j]) for x in everything for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
    longest = []  # of the runs that end after each word
    for i in range(1, len(words) + 1):
        n = longest[-1] + 1 if longest else 1
        while n and tuple(words[i - n : i]) not in known:
            n -= 1
        longest.append(n)
    ends = [(i + 1 - n, n) for i, n in enumerate(longest) if n >= min_run and (i + 1 == len(words) or longest[i + 1] <= n)]
    for label, x in templates:
        t = ALNUM.findall(lower_ascii(x))
        runs = sorted((a, k, n) for a, n in ends for k in range(len(t) - n + 1) if t[k : k + n] == words[a : a + n])
        best = []
        for i, (a, k, n) in enumerate(runs):
            before = [best[j] for j, (b, m, o) in enumerate(runs[:i]) if m + o <= k and b + o <= a <= b + o + max_gap]
            best.append(n + max(before, default=0))
        cover = max(best, default=0) / len(t)
        score = max(score, min(1.0, cover))
        if cover >= min_cover:
            labels.add(label)
    return ",".join(sorted(labels)), score


def substring_dedup(rows, size=50):
    first: dict[tuple, int] = {}
    docs = [(doc, WS.findall(text or "")) for doc, text in rows]
    for doc, words in docs:
        for i in range(len(words) - size + 1):
            key = tuple(words[i : i + size])
            first[key] = min(first.get(key, doc), doc)
    out = {}
    for doc, words in docs:
        gone = set()
        for i in range(len(words) - size + 1):
            if first[tuple(words[i : i + size])] < doc:
                gone.update(range(i, i + size))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out[doc] = (len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def quality(rows):
    out = {}
    for doc, text in rows:
        text = text or ""
        words = WS.findall(text)
        lines = [x for x in text.split("\n") if WS.search(x)]
        grams = defaultdict(list)
        for i in range(len(words) - 7):
            grams[tuple(words[i : i + 8])].append(i)
        repeat = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
        out[doc] = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat), len(words) < 20 or 100 * len(repeat) > 30 * len(words))
    return out


def near_pairs(rows, threshold=0.8, size=5):
    """Links of an exact join by inverted index: {frozenset of two row numbers}."""
    sets = []
    for _, text in rows:
        words = ALNUM.findall(lower_ascii(text))
        sets.append({tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    index = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            index[x].append(k)
    shared = defaultdict(int)
    for at in index.values():
        for a in range(len(at)):
            for b in range(a):
                shared[at[b], at[a]] += 1
    links = {p for p, n in shared.items() if n >= threshold * (len(sets[p[0]]) + len(sets[p[1]]) - n) - 1e-9}
    empty = [k for k, s in enumerate(sets) if not s]
    return links | {(a, b) for i, a in enumerate(empty) for b in empty[i + 1 :]}


def classes(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def pieces(rows, tokenizer, capacity=2048):
    out = {}
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a : a + capacity]
            out[doc, k] = (a, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)))
    return out


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def secrets(rows):
    out = {}
    for doc, text in rows:
        text = text or ""
        spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        spans.sort()
        said = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
        out[doc] = (*(sum(k == x for _, k, _ in spans) for x in range(3)), hashlib.sha256(said.encode()).hexdigest())
    return out


def edited(rows):
    """doc -> (n_chars, text with its second half replaced, next document)."""
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (doc, text) in enumerate(order):
        after, other = order[(k + 1) % len(order)]
        text, h = text or "", len(text or "") // 2
        out[doc] = (len(text), text[: len(text) - h] + (other or "")[:h], after)
    return out


def simhash(text, term=5):
    """128 bits, each set if more than half of the terms' hashes have it; hashes are chained over a term's words."""
    words = WS.findall(text or "")
    votes, n = [0] * 128, 0
    for k in range(max(len(words) - term + 1, min(len(words), 1))):
        h = 42
        for w in words[k : k + term]:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        second = xxhash.xxh64_intdigest((1).to_bytes(4, "little"), xxhash.xxh64_intdigest(h.to_bytes(8, "little"), 42))
        n += 1
        for b in range(64):
            votes[b] += second >> b & 1
            votes[64 + b] += h >> b & 1
    return f"{sum(1 << b for b in range(128) if 2 * votes[b] > n):032x}"


def targets(sizes, weights=(3, 1, 2), share=1.5, epochs=2):
    """source -> target, by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    cap = {s: epochs * sizes[s] for s in names}
    out, open_, left = {s: 0.0 for s in names}, set(names), share * sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > cap[s]}
        if not full:
            return out | {s: level * w[s] for s in open_}
        for s in full:
            out[s] = cap[s]
            left -= cap[s]
        open_ -= full
    return out


def severity(text, weights, thresholds, scale=10.0, stems=(4, 5)):
    """(expected grade, P(any severity), margin) of an ordinal model, word by word."""
    words = [w.encode() for w in ALNUM.findall(lower_ascii(text))]
    counts = defaultdict(int)
    for w in words:
        for f in [xxhash.xxh32_intdigest(w)] + [xxhash.xxh32_intdigest(w[:n], n) for n in stems if len(w) > n]:
            counts[f] += 1
    margin = scale * sum(weights.get(f, 0.0) * math.log(1 + c) for f, c in counts.items()) / math.sqrt(max(len(words), 1))
    p = [1 / (1 + math.exp(t - margin)) for t in thresholds]
    return sum(p), p[0], margin


def quality_kept(rows, low, middle, high, fence, widths, bounds, tails, least):
    """doc -> broken rules of texts that pass the base rules, with exact quantiles; None for those that fail."""
    base = quality([(d, t) for d, t, _, _ in rows])
    measures = {}
    for doc, text, lang, source in rows:
        text = text or ""
        n, chars, symbols, dup, repeat, failed = base[doc]
        words, lines = WS.findall(text), [x for x in text.split("\n") if WS.search(x)]
        upper, letters = len(re.findall("[A-Z]", text)), len(re.findall("[A-Za-z]", text))
        m = {"symbol_rate": symbols / max(chars, 1), "dup_line_rate": dup / max(len(lines), 1), "repeat_rate": repeat / max(n, 1)}
        m |= {"upper_rate": upper / max(letters, 1), "mean_word": chars / max(n, 1), "distinct_rate": len(set(words)) / n**0.75 if n else 0.0}
        measures[doc] = (m, lang, source, failed)

    def quantiles(name, keep):
        x = sorted(m[name] for m, lang, source, failed in measures.values() if not failed and keep(lang, source))
        return [x[max(math.ceil(q * len(x)) - 1, 0)] for q in (low, middle, high)], len(x)

    out = {}
    for doc, (m, lang, source, failed) in measures.items():
        broken = set()
        for name, tail in tails.items():
            if failed:
                continue
            own, n = quantiles(name, lambda a, b: (a, b) == (lang, source))
            wide, w = quantiles(name, lambda a, b: a == lang)
            whole, _ = quantiles(name, lambda a, b: True)
            mixed = [(w * y + least * z) / (w + least) for y, z in zip(wide, whole, strict=True)]
            a, b, c = ((n * x + least * y) / (n + least) for x, y in zip(own, mixed, strict=True))
            bottom, top = b - max(fence * (b - a), widths[name]), b + max(fence * (c - b), widths[name])
            if name in bounds:
                bottom, top = max(bottom, (a + bounds[name]) / 2), min(top, (c + bounds[name]) / 2)
            if (tail in ("low", "both") and m[name] < bottom) or (tail in ("high", "both") and m[name] > top):
                broken.add(name)
        out[doc] = None if failed else broken
    return out
