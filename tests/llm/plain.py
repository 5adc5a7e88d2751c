"""Plain versions of operators, written from their definitions: one table in memory, no Spark, no partitions."""

import math
import re
from collections import defaultdict

import numpy as np

SPACE = b" \t\n\x0b\x0c\r"


def raw(t):
    return (t or "").encode()


def words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", raw(t))


# --- quality


def statistics(t):
    b = raw(t)
    n = max(1, len(b))
    share = lambda chosen: sum(x in chosen for x in b) / n
    ws = b.split()
    w = max(1, len(ws))
    lengths = [len(x) for x in ws] or [0]
    mean = sum(lengths) / len(lengths)
    lines = [x for x in b.split(b"\n") if x.strip()]
    kinds = [bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58)), b" ", b"\n", b".,;:'\"-?()", b"!", b"#*$%&@^~=+<>_/\\[]{}`", b"|", bytes(range(128, 256))]
    return [
        *map(share, kinds), math.log1p(len(ws)), mean, math.sqrt(sum((x - mean) ** 2 for x in lengths) / len(lengths)), math.log1p(max(lengths)), len(set(ws)) / w,
        math.log1p(len(set(ws))) / math.log1p(w), sum(a == b for a, b in zip(ws, ws[1:], strict=False)) / w, len(set(lines)) / max(1, len(lines)), math.log1p(len(ws) / max(1, len(lines))), sum(x[-1:] in (b".", b"!", b"?") for x in ws) / w,
    ]


def quality(learn, judge, texts, seed, features, ridge):
    """Scores of ``texts`` by a model of (text, label) rows, fitted on ``learn`` and calibrated on ``judge``."""
    rng = np.random.default_rng(seed)
    x = np.array([statistics(t) for t, _ in learn])
    waves, phase = rng.normal(size=(x.shape[1], features)) / math.sqrt(x.shape[1]), rng.uniform(0, 2 * math.pi, features)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)

    def features_of(ts):
        z = (np.array([statistics(t) for t in ts]) - mean) / scale
        z = np.where(z > 6, 6, np.where(z < -6, -6, z))
        return np.hstack([np.cos(z @ waves + phase) * math.sqrt(2 / features), np.ones((len(ts), 1))])

    f, y = features_of([t for t, _ in learn]), np.array([y for _, y in learn], float)
    weights = np.linalg.solve(f.T @ f + ridge * len(y) / features * np.eye(features + 1), f.T @ y)
    rows = sorted(zip(features_of([t for t, _ in judge]) @ weights, [y for _, y in judge], strict=True), key=lambda r: r[0])
    # Isotonic regression by its min-max formula; runs of one value are blocks.
    ys = [y for _, y in rows]
    means = lambda i, j: sum(ys[i : j + 1]) / (j + 1 - i)
    fitted = [max(min(means(j, k) for k in range(i, len(ys))) for j in range(i + 1)) for i in range(len(ys))]
    blocks = defaultdict(list)
    for (r, _), v in zip(rows, fitted, strict=True):
        blocks[round(v, 12)].append(r)
    steps = [(sum(b) / len(b), v) for v, b in sorted(blocks.items())]
    return np.interp(features_of(texts) @ weights, [a for a, _ in steps], [v for _, v in steps]).clip(0, 1)


# --- dedup


def exact_groups(rows):
    """Groups of (id, text) rows of equal texts, the row that stays first."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[raw(t).translate(None, SPACE)].append((i, t))
    return [sorted(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0], raw(r[1]))) for g in groups.values()]


def shingles(t, width):
    w = [x.lower() for x in words(t)]
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def near_groups(rows, width, percent):
    """Groups of linked (id, text) rows, the row that stays first; rows without words or id are alone."""
    sets, over = [shingles(t, width) for _, t in rows], list(range(len(rows)))

    def root(x):
        while over[x] != x:
            x = over[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and None not in (rows[a][0], rows[b][0]) and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                over[root(a)] = root(b)
    groups = defaultdict(list)
    for k, r in enumerate(rows):
        groups[root(k)].append(r)
    return [sorted(g, key=lambda r: (r[0] is None, r[0], raw(r[1]))) for g in groups.values()]


# --- mixing


def permuted(x, n, key):
    """A Feistel network of four rounds over two halves, applied until the result is below ``n``."""
    half = max(1, -(-max(1, n - 1).bit_length() // 2))
    low, full = (1 << half) - 1, (1 << 64) - 1

    def mixed(v):
        v ^= v >> 31
        v = v * 0x7FB5D329728EA185 & full
        v ^= v >> 27
        v = v * 0x81DADEF4BC2DD44D & full
        return v ^ v >> 33

    while True:
        a, b = x >> half, x & low
        for r in range(4):
            a, b = b, a ^ mixed(b + (key * 4 + r) * 0x9E3779B97F4A7C15 & full) & low
        x = a << half | b
        if x < n:
            return x


def mix(rows, marks, block=128, share=1.5, limit=2.0, seed=11):
    """For each (id, text, source) row: its source's size and target, and how often each of its words is taken."""
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    of = {s: sorted((k for k, r in enumerate(rows) if r[2] == s), key=lambda k: (rows[k][0] is not None, rows[k][0], len(words(rows[k][1])), marks[rows[k][1]])) for s in sources}
    size = {s: sum(len(words(rows[k][1])) for k in of[s]) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    target, full = dict.fromkeys(sources, 0.0), set()
    while True:
        free = [s for s in sources if size[s] and s not in full]
        left = share * sum(size.values()) - sum(limit * size[s] for s in full)
        for s in free:
            target[s] = left * weight[s] / sum(weight[x] for x in free)
        above = {s for s in free if target[s] > limit * size[s]}
        if not above:
            break
        full |= above
    for s in full:
        target[s] = limit * size[s]
    out = [None] * len(rows)
    for k, s in enumerate(sources):
        n = size[s]
        times = []
        if n:
            passes = target[s] / n
            b = -(-n // (block if passes == round(passes) else max(1, min(block, n // 32))))
            taken = [0] * b
            for slot in range(round(passes * b)):
                taken[permuted(slot % b, b, hash((seed, k, slot // b)) & 0xFFFFFFFF)] += 1
            times = [taken[j] for j in range(b) for _ in range(n // b + (j < n % b))]
        at = 0
        for r in of[s]:
            m = len(words(rows[r][1]))
            out[r] = n, target[s], times[at : at + m]
            at += m
    return out


def copies(t, times):
    """The texts that a document becomes: copy c has the words taken more than c times, with what stands between those
    that are neighbours."""
    b, out = raw(t), []
    at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)]
    for copy in range(max(times, default=0)):
        if min(times) > copy:
            out.append(t)
            continue
        made, last = b"", None
        for k, n in enumerate(times):
            if n > copy:
                made += (b"" if last is None else b[at[last][1] : at[k][0]] if last == k - 1 else b" ") + b[slice(*at[k])]
                last = k
        out.append(made.decode())
    return out
