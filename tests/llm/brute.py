"""Plain single-machine versions of what the operators must return."""

import hashlib
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def low(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def fingerprint(text, shingle=3):
    w = words(low(text))
    if not w:
        return 0
    grams = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=3):
    """Labels of a list of fingerprints: equal for those that links join."""
    label = list(range(len(prints)))

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                label[find(i)] = find(j)
    return [find(k) for k in range(len(prints))]


def dedup_windows(rows, width=20):
    """(n_words, n_removed, kept_sha256) of each (doc_id, text), ids distinct."""
    seen, out = {}, {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        w = words(text)
        cut = set()
        for s in range(len(w) - width + 1):
            key = tuple(w[s : s + width])
            if key in seen:
                cut.update(range(s, s + width))
            seen.setdefault(key, (i, s))
        kept = [x for k, x in enumerate(w) if k not in cut]
        out[i] = (len(w), len(cut), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out
