"""Small inputs and plain reference versions."""

import hashlib
import random
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string"


def prose(seed: int, n_words: int, words: int = 400) -> list[str]:
    rng = random.Random(seed)
    known = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(words)]
    return [rng.choice(known) for _ in range(n_words)]


class Union:
    """Union-find in which the smallest member names its set."""

    def __init__(self, items):
        self.parent = {i: i for i in items}

    def find(self, x):
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x, y):
        x, y = self.find(x), self.find(y)
        self.parent[max(x, y)] = min(x, y)


def word_shingles(text, size=5):
    words = WORD.findall((text or "").translate(UPPER))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*[words[k:] for k in range(size)]))


def jaccard_components(docs, percent=80):
    """doc_id -> (size of its set, smallest id reachable), by comparing all that share a shingle."""
    sets = {i: word_shingles(t) for i, t in docs}
    found, owners = Union(sets), defaultdict(list)
    for i, s in sets.items():
        for x in s:
            owners[x].append(i)
    for ids in owners.values():
        for a in ids:
            for b in ids:
                if a < b:
                    common = len(sets[a] & sets[b])
                    if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                        found.join(a, b)
    return {i: (len(s), found.find(i)) for i, s in sets.items()}


def without_repeats(docs, width=50):
    """doc_id -> (bytes, removed, spans, sha256 of the rest), string by string."""
    least = {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        data = (text or "").encode()
        for k in range(len(data) - width + 1):
            least.setdefault(data[k:k + width], i)
    out = {}
    for i, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - width + 1):
            if least[data[k:k + width]] < i:
                gone[k:k + width] = b"\x01" * width
        kept = bytes(c for c, g in zip(data, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def kept_by_language(docs):
    """Ids with at least one letter: what the first stage may keep."""
    return {i for i, text in docs if any(c.isalpha() for c in text or "")}
