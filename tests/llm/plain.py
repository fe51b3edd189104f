"""Brute-force forms of the operators, in plain Python."""

import base64
import hashlib
import re
import zlib
from urllib.parse import unquote

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def space_words(text):
    return SPACE.findall(text or "")


def alnum_words(text):
    return ALNUM.findall((text or "").translate(LOWER))


def least_reachable(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def shingles(text, k):
    w = space_words((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def near(sets, percent):
    keys = list(sets)
    return [
        (a, b)
        for i, a in enumerate(keys)
        for b in keys[i + 1 :]
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]


def hits(text, items, window=10):
    """Words hit, and items with an occurring window."""
    w, hit, found = alnum_words(text), set(), set()
    for item, item_text in items:
        q = alnum_words(item_text)
        n = min(window, len(q))
        runs = {tuple(q[i : i + n]) for i in range(len(q) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in runs:
                hit |= set(range(i, i + n))
                found.add(item)
    return len(w), len(hit), found


def cut(texts, window):
    """Per text: words, words removed, digest of the rest."""
    words = [space_words(t) for t in texts]
    seen = {}
    for t, w in enumerate(words):
        for i in range(len(w) - window + 1):
            seen.setdefault(tuple(w[i : i + window]), []).append((t, i))
    gone = [set() for _ in texts]
    for places in seen.values():
        if len(places) > 1:
            for t, i in places:
                gone[t] |= set(range(i, i + window))
    kept = [" ".join(x for i, x in enumerate(w) if i not in g) for w, g in zip(words, gone)]
    return [(len(w), len(g), hashlib.sha256(k.encode()).hexdigest()) for w, g, k in zip(words, gone, kept)]


def lines_removed(docs, k=5):
    """Line numbers to remove, by doc id."""
    first, places = {}, []
    for doc, text in sorted((d, t) for d, t in docs if d is not None and t is not None):
        for n, line in enumerate(text.split("\n")):
            if line := line.strip(" \t\r"):
                first.setdefault(line, (doc, n))
                places.append((doc, n, line))
    sets = {x: {x[i : i + k] for i in range(max(1, len(x) - k + 1))} for x in first}
    root = least_reachable(list(first), near(sets, 80))
    best = {}
    for x, r in root.items():
        best[r] = min(best.get(r, first[x]), first[x])
    out = {}
    for doc, n, line in places:
        if (doc, n) != best[root[line]]:
            out.setdefault(doc, []).append(n)
    return out


def decoded_secrets(text, depth=5):
    """Assigned secrets in a text and in all that decodes from any of its parts, by trying:
    every alphabet run, with and without its line breaks, from every one of its characters."""
    found, met, work = set(), set(), [(text, depth)]
    while work:
        now, left = work.pop()
        if now in met:
            continue
        met.add(now)
        found |= {m[0] for m in re.finditer("(password|secret|token)=[A-Za-z0-9]{12,}", now)}
        if not left:
            continue
        made = [unquote(now), re.sub(r"\\u([0-9A-Fa-f]{4})", lambda m: chr(int(m[1], 16)), now)]
        runs = re.findall(r"[A-Za-z0-9+/_-]{20,}", now) + re.findall(r"(?:[A-Za-z0-9+/_-]{20,}\r?\n[ \t]*)+[A-Za-z0-9+/_-]+", now)
        for run in runs:
            run = "".join(run.split()).replace("-", "+").replace("_", "/")
            for at in range(min(len(run), 40)):
                part = run[at:]
                data = base64.b64decode(part[: len(part) // 4 * 4] + (part[len(part) // 4 * 4 :] + "==" if len(part) % 4 > 1 else "") [: 4 * (len(part) % 4 > 1)])
                made.append(data.decode("utf-8", "replace"))
                for wbits in (31, 15):
                    try:
                        made.append(zlib.decompressobj(wbits).decompress(data).decode("utf-8", "replace"))
                    except zlib.error:
                        pass
        work += [(m, left - 1) for m in made if m != now and re.search("[ -~]{12}", m)]
    return found
