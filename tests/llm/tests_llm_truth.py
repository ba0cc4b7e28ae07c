"""Plain definitions of what the corpus operators return."""

import hashlib
from collections import defaultdict
from itertools import combinations

SPACE = " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def line_truth(data, min_chars=20, min_docs=3):
    holders = defaultdict(set)
    split = [(i if i is not None else -2**63, (t or "").split("\n")) for i, t in data]
    key = [[x.strip(SPACE).translate(LOWER) for x in lines] for _, lines in split]
    for (i, _), keys in zip(split, key):
        for k in keys:
            if len(k) >= min_chars:
                holders[k].add(i)
    lost = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for (i, lines), keys in zip(split, key):
        kept = [x for x, k in zip(lines, keys) if k not in lost or lost[k] == i]
        out.append((None if i == -2**63 else i, len(lines), len(lines) - len(kept),
                    hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def jaccard_truth(data, words, percent):
    sets = []
    for i, t in data:
        w = (t or "").translate(LOWER).encode().split()
        grams = {tuple(w[a:a + words]) for a in range(len(w) - words + 1)}
        sets.append((i, grams or ({tuple(w)} if w else set())))
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        both = len(x & y)
        if x and y and 100 * both >= percent * (len(x) + len(y) - both):
            root[find(b)] = find(a)
    members = defaultdict(list)
    for a in range(len(sets)):
        if sets[a][0] is not None:
            members[find(a)].append(sets[a][0])
    return sorted(((i, len(s), min(members[find(a)], default=None))
                   for a, (i, s) in enumerate(sets)), key=repr)
