"""The contracts of the text operators, spelled out without regard to speed."""

from __future__ import annotations

import hashlib
import re


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def shingle_set(text, size=5):
    own = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if len(own) < size:
        return {tuple(own)} if own else set()
    return {tuple(own[i : i + size]) for i in range(len(own) - size + 1)}


def jaccard_components(rows):
    """Sorted (doc_id, shingles, least linked doc_id); rows of one doc_id are one node."""
    sets = [(doc_id, shingle_set(text)) for doc_id, text in rows]
    parent = {doc_id: doc_id for doc_id, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, one) in enumerate(sets):
        for b, two in sets[i + 1 :]:
            if one and two and 100 * len(one & two) >= 80 * len(one | two):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return sorted((doc_id, len(own), root(doc_id)) for doc_id, own in sets)


def without_repeated_words(rows, size=13):
    """Sorted (doc_id, words, removed, digest)."""
    first = {}
    for doc_id, text in rows:
        own = words(text)
        for i in range(len(own) - size + 1):
            window = tuple(own[i : i + size])
            first[window] = min(first.get(window, doc_id), doc_id)
    found = []
    for doc_id, text in rows:
        own = words(text)
        kept = [True] * len(own)
        for i in range(len(own) - size + 1):
            if first[tuple(own[i : i + size])] < doc_id:
                kept[i : i + size] = [False] * size
        left = b" ".join(w for w, k in zip(own, kept, strict=True) if k)
        found.append((doc_id, len(own), len(own) - sum(kept), hashlib.sha256(left).hexdigest()))
    return sorted(found)


def without_copied_bytes(rows, size=100):
    """Sorted (doc_id, bytes, removed, spans, digest, kept bytes), equal rows once."""
    rows = sorted(set(rows), key=lambda r: (r[0], r[1] or ""))
    first = {}
    for doc_id, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - size + 1):
            first.setdefault(raw[i : i + size], (doc_id, i))
    found = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw) + 1)
        for i in range(len(raw) - size + 1):
            if first[raw[i : i + size]] < (doc_id, i):
                gone[i : i + size] = b"\1" * size
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(raw)))
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        found.append((doc_id, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return found
