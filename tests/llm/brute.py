"""Brute-force versions of the training-data operators, for small inputs."""

from __future__ import annotations

import re
import zlib


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def simhash(text, shingle=3):
    import xxhash
    w = words(text)
    k = min(shingle, len(w))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i:i + k]).encode(), 42) for i in range(len(w) - k + 1)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_components(docs, radius=2):
    """{id: (hex, component)} of (id, text) with unique ids."""
    docs = sorted(docs)
    prints = [simhash(t) for _, t in docs]
    at = roots(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= radius])
    return {d: (format(f, "016x"), docs[r][0]) for (d, _), f, r in zip(docs, prints, at)}


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination(text, items, window=10):
    """(words, hit flags, item ids) of a text."""
    w = item_words(text)
    hit, found = [False] * len(w), set()
    for item, other in items:
        o = item_words(other)
        k = min(window, len(o))
        windows = {tuple(o[i:i + k]) for i in range(len(o) - k + 1)} if o else set()
        for i in range(len(w) - k + 1 if k else 0):
            if tuple(w[i:i + k]) in windows:
                found.add(str(item))
                hit[i:i + k] = [True] * k
    return w, hit, sorted(found)


def uncovered(docs, length=100):
    """{id: (kept bytes, spans)} of (id, text) with unique ids."""
    seen, out = set(), {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            s = b[p:p + length]
            if s in seen:
                gone[p:p + length] = [True] * length
            seen.add(s)
        spans = [m.span() for m in re.finditer("1+", "".join("01"[g] for g in gone))]
        out[i] = (bytes(c for c, g in zip(b, gone) if not g), spans)
    return out


def crc(value):
    return zlib.crc32(str(value).encode())
