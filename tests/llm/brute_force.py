"""Plain definitions of what some operators compute, for small inputs."""

import re


def shingles(text, words):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(w[i: i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def near_copies(rows, words, share):
    """``id, size, component`` of every row, sorted; -1 stands for a null id."""
    sets = [shingles(text, words) for _, text in rows]
    component = {i: i for i, _ in rows if i is not None}

    def top(x):
        while component[x] != x:
            x = component[x]
        return x

    holders = {}
    for p, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(p)
    for p in range(len(rows)):
        shared = {}
        for x in sets[p]:
            for q in holders[x]:
                if q < p:
                    shared[q] = shared.get(q, 0) + 1
        for q, i in shared.items():
            if rows[p][0] is not None and rows[q][0] is not None and 100 * i >= share * (len(sets[p]) + len(sets[q]) - i):
                x, y = sorted((top(rows[p][0]), top(rows[q][0])))
                component[y] = x
    return sorted((i if i is not None else -1, len(s), top(i) if i is not None else -1) for (i, _), s in zip(rows, sets))


def without_repeats(rows, length):
    """``id, kept bytes`` of every row of ``id, bytes``."""
    first = {}
    for doc, raw in sorted(rows):
        for p in range(len(raw) - length + 1):
            first.setdefault(raw[p: p + length], (doc, p))
    for doc, raw in rows:
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if first[raw[p: p + length]] < (doc, p):
                gone[p: p + length] = b"\1" * length
        yield doc, bytes(b for b, g in zip(raw, gone) if not g)


def targets(sizes, weights=(3.0, 1.0, 2.0), share=1.5, most=2.0):
    names = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(most * sizes[s] for s in full)
        over = [s for s in rest if left * weight[s] / sum(weight[x] for x in rest) > most * sizes[s]]
        if not over:
            return {s: most * sizes[s] if s in full else left * weight[s] / sum(weight[x] for x in rest) for s in names}
        full |= set(over)
