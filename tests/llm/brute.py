"""Plain single-process versions of the operators, for small inputs."""

import hashlib


def words(text):
    return (text or "").encode().split()


def substring(rows, n):
    first, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        for p in range(len(w) - n + 1):
            first.setdefault(tuple(w[p:p + n]), i)
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - n + 1):
            if first[tuple(w[p:p + n])] < i:
                gone[p:p + n] = [True] * n
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[i] = (len(w), sum(gone), b" ".join(kept).decode())
    return out


def repeated_bytes(rows, n=100):
    first, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for p in range(len(b) - n + 1):
            first.setdefault(b[p:p + n], (i, p))
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if first[b[p:p + n]] < (i, p):
                gone[p:p + n] = b"\1" * n
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def lines(rows, m, min_words=50):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        all_lines = (t or "").split("\n")
        at = [k for k in range(len(all_lines)) if all_lines[k].encode().split()]
        gone = set()
        for a in range(len(at)):
            for size in {1, m}:
                key = tuple(all_lines[k] for k in at[a:a + size])
                if len(key) == size and (size == m or len(key[0].encode().split()) >= min_words):
                    if key in seen:
                        gone.update(at[a:a + size])
                    seen.add(key)
        out[i] = (len(at), len(gone), "\n".join(x for k, x in enumerate(all_lines) if k not in gone))
    return out


def shingles(text, n):
    w = (text or "").encode().lower().split()
    if len(w) >= n:
        return {tuple(w[k:k + n]) for k in range(len(w) - n + 1)}
    return {tuple(w)} if w else set()


def components(rows, n, percent):
    sets = {i: shingles(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    p, q = find(i), find(j)
                    root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def infix_distance(item, doc):
    """Least word edit distance of ``item`` to any stretch of ``doc``."""
    before = [0] * (len(doc) + 1)
    for i, a in enumerate(item):
        now = [i + 1]
        for j, b in enumerate(doc):
            now.append(min(before[j] + (a != b), before[j + 1] + 1, now[j] + 1))
        before = now
    return min(before)
