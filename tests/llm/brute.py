"""Plain versions that tests compare the operators with."""

import re
from itertools import combinations


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingle_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def reach(ids, links):
    """Smallest id reachable by links, for each id."""
    near = {i: set() for i in ids}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for i in sorted(ids):
        if i not in out:
            todo = [i]
            out[i] = i
            while todo:
                for k in near[todo.pop()]:
                    if k not in out:
                        out[k] = i
                        todo.append(k)
    return out


def ngram_components(rows, n, percent):
    sets = {i: shingle_set(t, n) for i, t in rows}
    links = []
    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
            both = len(x & y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                links.append((a, b))
    return {i: (len(sets[i]), c) for i, c in reach(sets, links).items()}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]
