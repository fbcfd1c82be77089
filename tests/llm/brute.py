"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import combinations

GAP = r"[ \t\n\x0b\x0c\r]+"


def words(text):
    return [w for w in re.split(GAP, text or "") if w]


def near(rows, percent=75):
    """(doc_id, text) rows -> [(doc_id, n_shingles, component_id)], row by row."""
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    sets = []
    for _, text in rows:
        w = words(lower(text or ""))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            parent[root(j)] = root(i)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)].append(d)
    return [(d, len(sets[i]), min(least[root(i)], default=None) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def base_counts(text):
    text = text or ""
    w = words(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = {g for g, n in Counter(grams).items() if n > 1}
    covered = {i + k for i, g in enumerate(grams) if g in often for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def smith_waterman(a, b, match=2, mismatch=-1, gap=-1):
    best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch), h[i - 1][j] + gap, h[i][j - 1] + gap)
            best = max(best, h[i][j])
    return best


def cut_value(source, sink, edges):
    """The least cost of any labelling."""
    n = len(source)
    return min(
        sum((sink[i] if m >> i & 1 else source[i]) for i in range(n)) + sum(c for u, v, c in edges if (m >> u & 1) != (m >> v & 1))
        for m in range(1 << n)
    )


def page_rank(seeds, edges, damping=0.85, steps=200):
    """seeds {host: (trust, distrust)}, edges {(a, b): weight} -> {host: [trust, distrust]}."""
    hosts = set(seeds) | {h for e in edges for h in e}
    out, into = Counter(), Counter()
    for (a, b), w in edges.items():
        out[a] += w
        into[b] += w
    s = {h: seeds.get(h, (0.0, 0.0)) for h in hosts}
    r = {h: [(1 - damping) * x for x in s[h]] for h in hosts}
    for _ in range(steps):
        new = {h: [(1 - damping) * x for x in s[h]] for h in hosts}
        for (a, b), w in edges.items():
            new[b][0] += damping * r[a][0] * w / out[a]
            new[a][1] += damping * r[b][1] * w / into[b]
        r = new
    return r


def fixpoint_targets(sizes, weights=(5, 2, 1), cap=3):
    """{source: size} in order -> {source: target}, by reshaping the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left, weight = total - sum(fixed.values()), sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / weight > cap * sizes[s]] if free else []
        if not over:
            return fixed | {s: left * w[s] / weight for s in free}
        fixed |= {s: cap * sizes[s] for s in over}


def templates(rows, leading=3, min_docs=3, constant=70, min_tokens=3):
    """(doc_id, text) rows -> the masked lines whose template recurs."""
    mask = lambda line: re.sub(r"[^ ]*(?:[0-9@]|://)[^ ]*", "<*>", re.sub(GAP, " ", line).strip(" "))
    docs_of, leaf_of = defaultdict(set), {}
    for d, text in set(rows):
        for line in (text or "").split("\n"):
            m = mask(line)
            t = m.split(" ")
            if m and len(t) >= min_tokens:
                docs_of[m].add((d, text))
                leaf_of[m] = (len(t), *t[:leading])
    seen = Counter()
    for m, who in docs_of.items():
        for i, token in enumerate(m.split(" ")):
            if token != "<*>":
                seen[leaf_of[m], i, token] += len(who)
    found = defaultdict(set)
    members = defaultdict(set)
    for m, who in docs_of.items():
        t = [x if seen[leaf_of[m], i, x] >= min_docs else "<*>" for i, x in enumerate(m.split(" "))]
        if 100 * sum(x != "<*>" for x in t) >= constant * len(t):
            key = (leaf_of[m], " ".join(t))
            found[key] |= who
            members[key].add(m)
    return {m for k, who in found.items() if len(who) >= min_docs for m in members[k]}, mask
