"""Plain versions of operators, for small inputs."""

import re
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_set(text, k):
    w = WORD.findall((text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))
    if not w:
        return frozenset()
    if len(w) < k:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def near_duplicates(rows, k, num=80, den=100):
    """{index: (set size, least doc_id reachable)} by an exact prefix-filtered join."""
    sets = [shingle_set(t, k) for _, t in rows]
    frequency = Counter(s for x in sets for s in x)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    seen = defaultdict(list)
    for i, x in enumerate(sets):
        if not x:
            continue
        order = sorted(x, key=lambda s: (frequency[s], s))
        prefix = order[: len(x) - -(-num * len(x) // den) + 1]
        for j in {j for s in prefix for j in seen[s]}:
            if root(i) != root(j):
                both = len(x & sets[j])
                if den * both >= num * (len(x) + len(sets[j]) - both):
                    parent[root(i)] = root(j)
        for s in prefix:
            seen[s].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        key = (d is None, d or 0)
        least[root(i)] = min(least.get(root(i), key), key)
    return {i: (len(sets[i]), None if least[root(i)][0] else least[root(i)][1]) for i in range(len(rows))}


def repeated_bytes(rows, length=100):
    """[(doc_id, kept bytes, number of removed runs)] in the order of (doc_id, nulls first), by a set of all windows seen so far."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            window = hash(data[i : i + length]), data[i : i + min(8, length)]
            if window in seen:
                gone[i : i + length] = b"\x01" * length
            seen.add(window)
        kept = bytes(c for c, g in zip(data, gone) if not g)
        out.append((doc_id, kept, sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))))
    return out
