"""Brute-force versions."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text, n=5):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near_duplicates(docs):
    sets = {i: shingles(t) for i, t in docs}
    held, links = defaultdict(list), []
    for i in sorted(sets):
        both = Counter(j for s in sets[i] for j in held[s])
        links += [(i, j) for j, v in both.items() if 100 * v >= 75 * (len(sets[i]) + len(sets[j]) - v)]
        for s in sets[i]:
            held[s].append(i)
    c = components(sets, links)
    return {i: (len(sets[i]), c[i]) for i in sets}


def substrings(docs, window=50):
    words = {i: WORD.findall(t or "") for i, t in docs}
    least = {}
    for i in sorted(words, reverse=True):
        for k in range(len(words[i]) - window + 1):
            least[tuple(words[i][k : k + window])] = i
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def secrets(text):
    kinds = [("assign", re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12), ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile(r"[0-9a-f]+"), 0, 16)]
    found = [(m.start(), k, name, m.end()) for k, (name, p, g, n) in enumerate(kinds) for m in p.finditer(text or "") if len(m[g]) >= n]
    return [(name, s, e) for s, _, name, e in sorted(found)]
