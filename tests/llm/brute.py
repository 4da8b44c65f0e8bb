"""Plain versions of the text operators, for small tables."""

import hashlib
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def fingerprint(text, k=3):
    words = WORD.findall((text or "").translate(UPPER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, bits=2):
    """Number of each fingerprint's component: the smallest place in the list that its links reach."""
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= bits:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(fps))]


def shingles(text, k=5):
    words = WORD.findall((text or "").translate(UPPER))
    return {" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} or {" ".join(words)}


def kept_ids(data, similarity=0.8):
    """doc_id of what stays: the smallest of each component of links by Jaccard similarity of five-word shingles or by 2 bits."""
    sets, fps = [shingles(t) for _, t in data], [fingerprint(t, 5) for _, t in data]
    root = list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            if root[i] != root[j] and ((fps[i] ^ fps[j]).bit_count() <= 2 or len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= similarity):
                root = [root[j] if r == root[i] else r for r in root]
    groups = {}
    for (d, _), r in zip(data, root):
        groups.setdefault(r, []).append(d)
    return sorted(min(g) for g in groups.values())


def repeats(rows, length=100):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of rows (doc_id, text); a null doc_id comes first."""
    key = lambda d: (d is not None, d or 0)
    data = [(d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in data:
        for s in range(len(b) - length + 1):
            w, at = b[s : s + length], (key(d), s)
            first[w] = min(first.get(w, at), at)
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < (key(d), s):
                gone[s : s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeated_words(words, width=8):
    seen = {}
    for i in range(len(words) - width + 1):
        seen.setdefault(tuple(words[i : i + width]), []).append(i)
    return len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + width)})


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def overlaps(docs, items):
    """(doc_id, item_id) where 11 of 13 neighbouring item tokens agree on a diagonal (all, for 7 to 12 tokens)."""
    out = set()
    for d, text in docs:
        doc = tokens(text)
        for item_id, item_text in items:
            item = tokens(item_text)
            if len(item) < 7:
                continue
            width, need = min(13, len(item)), 11 if len(item) >= 13 else len(item)
            for diagonal in range(-len(item) + 1, len(doc)):
                hits = [j for j in range(len(item)) if 0 <= diagonal + j < len(doc) and doc[diagonal + j] == item[j]]
                if any(hits[i + need - 1] - hits[i] < width for i in range(len(hits) - need + 1)):
                    out.add((d, item_id))
                    break
    return out
