"""Plain single-process versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = ("email", "ip", "card", "phone")


def url_verdict(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


def quality(rows, max_docs=20):
    """rows (id, text, host) -> list of (figures..., words_left, failed, kept)."""
    def plain(line):
        return re.sub(r"[\W_]+", "", re.sub(r"\d", "0", line.lower()))

    holders = defaultdict(set)
    keeper = {}
    for i, text, host in rows:
        for line in (text or "").split("\n"):
            if WORD.search(line) and plain(line):
                key = host, plain(line)
                holders[key].add(text)
                if i is not None:
                    keeper[key] = min(i, keeper.get(key, i))
    out = []
    for i, text, host in rows:
        words = WORD.findall(text or "")
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {k + s for k, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for s in range(3)}
        lost = sum(len(WORD.findall(x)) for x in lines if plain(x) and len(holders[host, plain(x)]) > max_docs and (i is None or keeper[host, plain(x)] != i))
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        out.append((i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), len(words) - lost, failed,
                    not failed and len(words) - lost >= len(words) / 3))
    return out


def personal(text):
    text, found = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        total = sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(reversed(digits)))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """{source: size} -> {source: target} by resharing until no source is above its ceiling."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    budget, full = share * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        left = budget - sum(most * sizes[s] for s in full)
        target = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if target[s] > most * sizes[s] + 1e-9}
        if not over:
            return {**target, **{s: most * sizes[s] for s in full}}
        full |= over


def closure(ids, links):
    """Least id reachable, per position; links are pairs of positions."""
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    groups = defaultdict(list)
    for k in range(len(ids)):
        groups[find(k)].append(k)
    return [min((ids[m] for m in groups[find(k)] if ids[m] is not None), default=None) for k in range(len(ids))]


def vectors(rows, threshold=0.98):
    """rows (id, vector, label) -> (id, links, component, kept)."""
    def sound(v, label):
        return v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    links = []
    for a, (_, v, label) in enumerate(rows):
        for b in range(a):
            w, other = rows[b][1:]
            if label == other and sound(v, label) and sound(w, other) and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold - 1e-12:
                    links.append((a, b))
    n = Counter(k for pair in links for k in pair)
    of = closure([r[0] for r in rows], links)
    return [(r[0], n[k], of[k], r[0] == of[k]) for k, r in enumerate(rows)]


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def near(rows):
    """rows (id, text) -> (id, n, component, kept)."""
    sets = [shingles(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    of = closure([r[0] for r in rows], links)
    return [(r[0], len(sets[k]), of[k], r[0] == of[k]) for k, r in enumerate(rows)]


def repeats(rows, length=400):
    """rows (id, text) -> (id, bytes, removed, spans, digest of the rest)."""
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(b[k:k + length] for b in texts for k in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, texts):
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                gone[k:k + length] = True
        starts = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), starts, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])).hexdigest()))
    return out
