"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import collections
import hashlib

from .odd import SPACES, words_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def exact(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups["".join(c for c in t or "" if c not in SPACES)].append((-len(t or ""), i is None, i))
    found = []
    for i, t in rows:
        key = "".join(c for c in t or "" if c not in SPACES)
        first = min(groups[key], key=lambda x: (x[0], x[1], x[2] or 0))
        found.append((i, first[2], len(groups[key]), (-len(t or ""), i) == (first[0], first[2]), hashlib.sha256(key.encode()).digest()))
    return found


def line_key(line):
    return line.strip(SPACES).translate(LOWER)


def lines(rows):
    """id, n_lines, n_dropped, text; each row is a document."""
    holders = collections.defaultdict(list)
    for i, t in rows:
        for key in {line_key(x) for x in (t or "").split("\n")}:
            if len(key) >= 40:
                holders[key].append(i)
    last = {k: max((i for i in v if i is not None), default=None) for k, v in holders.items() if len(v) >= 5}
    found = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        stay = [x for x in all_lines if line_key(x) not in last or i is None or i == last[line_key(x)]]
        found.append((i, len(all_lines), len(all_lines) - len(stay), "\n".join(stay)))
    return found


def shingles(text, n):
    words = words_of(text)
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) or frozenset([tuple(words)])


def near(rows, n, per_cent):
    """id, size of the set, smallest id reachable; rows of one id share their links."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= per_cent * len(s | t):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [(i, len(s), top(i) if i is not None and s else i) for i, s in sets]


def shared_out(given, children):
    """children: name -> (room, weight). Parts as the water level demands, in whole numbers."""
    order = sorted(children, key=lambda k: (children[k][1] == 0, children[k][0] / children[k][1] if children[k][1] else 0, k is not None, k or ""))
    parts, left, rest = {}, given, sum(w for _, w in children.values())
    for at, k in enumerate(order):
        room, weight = children[k]
        if weight == 0 or room * rest <= left * weight:
            parts[k] = room
            left, rest = left - room, rest - weight
        else:
            parts |= {j: left * children[j][1] // rest if children[j][1] else children[j][0] for j in order[at:]}
            break
    return parts


def copies(rows, weights, levels, budget, epochs, seed, full=False):
    """rows: id, tokens, path. How often each is taken."""
    room = collections.Counter()
    tokens = collections.Counter()
    live = lambda path: all(weights.get(level, {}).get(v, 1) > 0 for level, v in zip(levels, path))
    for _, n, path in rows:
        tokens[path] += n
        for depth in range(len(path) + 1):
            room[path[:depth]] += n * epochs if live(path) else 0
    given = {(): min(budget(sum(n for _, n, _ in rows)), room[()])}
    for depth, level in enumerate(levels):
        for parent in {p[:depth] for _, _, p in rows}:
            names = {p[depth] for _, _, p in rows if p[:depth] == parent}
            parts = shared_out(given[parent], {k: (room[*parent, k], weights.get(level, {}).get(k, 1)) for k in names})
            given |= {(*parent, k): part for k, part in parts.items()}
    found = []
    for path in {p for _, _, p in rows}:
        own = [(i, n) for i, n, p in rows if p == path]
        whole = given[path] // tokens[path] if tokens[path] else 0
        prefix = given[path] - whole * tokens[path]
        place = lambda i, whole=whole: hashlib.md5(f"{seed}:{whole}:{'null' if i is None else i}".encode()).hexdigest()
        for i, n in own:
            up_to = sum(m for j, m in own if place(j) <= place(i))
            before = sum(m for j, m in own if place(j) < place(i))
            inside = before < prefix if full else up_to <= prefix
            found.append((i, n, path, whole + (prefix > 0 and whole < epochs and inside)))
    return found
