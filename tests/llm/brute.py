"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def substring_dedup(texts: list[str | None], n: int) -> list[tuple[int, int, str]]:
    words = [SPACE.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone.update(range(i, i + n))
        out.append((len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    w = SPACE.findall(text)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def label_model(patterns: list[tuple], counts: list[int], *, good=(0.89, 0.1, 0.01), failure=(0.1, 0.2, 0.7), weight=0.5, smooth=0.5, rounds=2000) -> list[float]:
    """P(good) of each pattern of votes (0 good, 1 none, 2 doubtful, 3 bad), by expectation-maximisation one pattern, class and rule at a time."""
    n_rules, place = len(patterns[0]), {0: 0, 2: 1, 3: 2}
    spoken = [[smooth] * 3 for _ in range(n_rules)]
    for p, c in zip(patterns, counts):
        for r, v in enumerate(p):
            if v in place:
                spoken[r][place[v]] += c
    usual = [[x / sum(row) for x in row] for row in spoken]
    means = [[list(good) for _ in range(n_rules)]] + [[list(failure) if r == k else usual[r] for r in range(n_rules)] for k in range(n_rules)]
    table, prior = means, [0.5] + [0.5 / n_rules] * n_rules

    def share(p):
        x = []
        for c in range(1 + n_rules):
            y = prior[c]
            for r, v in enumerate(p):
                if v in place:
                    y *= table[c][r][place[v]]
            x.append(y)
        return [y / sum(x) for y in x]

    for _ in range(rounds):
        sums, size = [[[0.0] * 3 for _ in range(n_rules)] for _ in means], [0.0] * len(means)
        for p, n in zip(patterns, counts):
            for c, y in enumerate(share(p)):
                size[c] += n * y
                for r, v in enumerate(p):
                    if v in place:
                        sums[c][r][place[v]] += n * y
        table = [[[s + m * (smooth + weight * size[c]) for s, m in zip(sums[c][r], means[c][r])] for r in range(n_rules)] for c in range(len(means))]
        table = [[[x / sum(row) for x in row] for row in rows] for rows in table]
        new = [(x + smooth) / (sum(counts) + smooth * len(size)) for x in size]
        moved, prior = max(abs(a - b) for a, b in zip(new, prior)), new
        if moved < 1e-9:
            break
    return [share(p)[0] for p in patterns]


def jaccard_components(rows: list[tuple[int, str | None]], k: int, num: int, den: int) -> dict[int, tuple[int, int]]:
    sets = {}
    for i, t in rows:
        w = SPACE.findall(lower(t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    near = defaultdict(set)
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and den * len(a & b) >= num * len(a | b):
                near[i].add(j)
                near[j].add(i)
    out = {}
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(sets[i]), min(seen))
    return out


def decontaminate(texts: list[str | None], items: list[tuple[object, str | None]], n: int) -> list[tuple[int, int, int, str, bool]]:
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(lower(t or ""))
        size = min(n, len(w))
        for j in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[j : j + size])] |= {str(i)} - {"None"}
    out = []
    for t in texts:
        w = ALNUM.findall(lower(t or ""))
        hit, ids = set(), set()
        for size in {len(x) for x in windows}:
            for j in range(len(w) - size + 1):
                if (found := windows.get(tuple(w[j : j + size]))) is not None:
                    hit.update(range(j, j + size))
                    ids |= found
        out.append((len(w), len(hit), len(ids), sha(",".join(sorted(ids))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def url(url: str | None, rules: list[tuple[str, str, str]]) -> tuple[str, str, str | None, str | None]:
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        m = re.match(r"([^/?#]*)([^?#]*)", rest)
        host, path = lower(m[1]), m[2]
    best = None
    for verdict, h, p in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, best and best[0], best and best[1]


def merkle(rows: list[tuple], fanout: int, tamper) -> list[tuple]:
    """(id, leaf, subroot, root, digest of the proof, folded root, verified) of rows (id, group, ...)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(field, r)))

    def tree(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
        paths, own, level = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(level) > 1:
            for i, at in enumerate(own):
                a = at // fanout * fanout
                paths[i].append(("".join(level[a:at]), "".join(level[at + 1 : a + fanout])))
                own[i] = at // fanout
            level = [sha("".join(level[a : a + fanout])) for a in range(0, len(level), fanout)]
        return level[0], paths

    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in groups[g]])
    if not names:
        return []
    root, above = tree([trees[g][0] for g in names])
    out = []
    for g, up in zip(names, above):
        subroot, paths = trees[g]
        for r, path in zip(groups[g], paths):
            other = tamper(r)
            x = leaf(r if other is None else other)
            for a, b in path + up:
                x = sha(a + x + b)
            out.append((r[0], leaf(r), subroot, root, sha("".join(a + b for a, b in path + up)), x, x == root))
    return out


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def rank_search(docs: list[tuple], items: list[tuple], k: int) -> list[list[tuple]]:
    """For each item the (rank, id, score) of its best documents."""
    words = [(i, TERM.findall(lower(t or ""))) for i, t in docs]
    words = [(i, w, Counter(w)) for i, w in words if w]
    n, total = len(words), sum(len(w) for _, w, _ in words)
    df = Counter(t for _, _, c in words for t in c)
    out = []
    for _, text in items:
        scores = []
        for i, w, c in words:
            m = 100 - 25 + 25 * len(w) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in TERM.findall(lower(text or "")) if t in c)
            if score > 0:
                scores.append((-score, i is not None, i or 0, i))
        out.append([(r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)])
    return out
