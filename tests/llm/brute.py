"""Plain restatements of the corpus operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def contamination(docs, items, share=20):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for a in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[a : a + n])].add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[tuple(w[a : a + n])]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and share * len(hit) >= len(w)))
    return out


def repeats(texts, length=400):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), len(r) - len(kept), len(re.findall(b"\1+", bytes(gone))), kept))
    return out


def repeated_words(texts, length=51):
    """What stays of each text without the words in any run of length words that starts anywhere else too, and the spaces after them."""
    found = [list(re.finditer(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    seen = Counter(tuple(m[0] for m in w[i : i + length]) for w in found for i in range(len(w) - length + 1))
    out = []
    for t, w in zip(texts, found, strict=True):
        gone = {j for i in range(len(w) - length + 1) if seen[tuple(m[0] for m in w[i : i + length])] > 1 for j in range(i, i + length)}
        stop = [m.start() for m in w[1:]] + [len(t or "")] * bool(w)
        out.append((t or "")[: w[0].start() if w else None] + "".join(t[m.start() : e] for i, (m, e) in enumerate(zip(w, stop, strict=True)) if i not in gone))
    return out


def passages(texts, length=51):
    """(words in runs of length words that start anywhere else too, maximal runs of such words) of each text."""
    found = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in found for i in range(len(w) - length + 1))
    gone = [{j for i in range(len(w) - length + 1) if seen[tuple(w[i : i + length])] > 1 for j in range(i, i + length)} for w in found]
    return [(len(g), len(g - {j + 1 for j in g})) for g in gone]


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def one_of_each(docs):
    """Places of the rows that stay of (doc_id, text): one of each component, the least id first, null ids last; all without words."""
    label = _labels(docs)
    first = {}
    for i, (d, t) in enumerate(docs):
        if shingles(t):
            first[label[i]] = min((d is None, d or 0, i), first.get(label[i], (True, float("inf"), i)))
    return [i for i, (d, t) in enumerate(docs) if not shingles(t) or first[label[i]][2] == i]


def components(docs):
    sets = [shingles(t) for _, t in docs]
    label, least = _labels(docs), {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[label[i]] = min(d, least.get(label[i], d))
    return [(d, len(s), least.get(label[i]) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))]


def _labels(docs):
    sets = [shingles(t) for _, t in docs]
    part = list(range(len(docs)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= 75 * len(sets[i] | sets[j]):
                part[root(i)] = root(j)
    return [root(i) for i in range(len(docs))]


PRIOR, QUANTILE, MARGIN = 30.0, 0.99, 1.25
GROUPS = [" \t\n\v\f\r", *"abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",", "!?", ";:", "'´`", "-_", "()[]{}", '"', "#$%&*+/<=>@\\^|~"]


def symbol(c):
    """A space, a letter, or a class of characters; code points from 0xDF to 0xFF are told apart up to the 25th, and those over 511 always."""
    for i, group in enumerate(GROUPS):
        if c in group:
            return i
    o = ord(c)
    if 0xC0 <= o < 0xDF:
        return 27
    if 0xDF <= o <= 0xFF:
        return 38 + min(o - 0xDF, 24)
    return 63 if o < 512 else o


def symbols(t):
    s = [symbol(c) for c in t or ""]
    s = [x for i, x in enumerate(s) if x or i == 0 or s[i - 1]]
    s = s[1:] if s[:1] == [0] else s
    return s[:-1] if s[-1:] == [0] and len(s) > 1 else s


def discounts(n1, n2, n3, n4):
    """Discounts of the counts 0, 1, 2 and more as Chen and Goodman have them, kept inside (0, count)."""
    n = [max(1.0, float(x)) for x in (n1, n2, n3, n4)]
    y = n[0] / (n[0] + 2 * n[1])
    raw = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
    return [0.0] + [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]


def perplexities(trusted, texts):
    """(n, nll) of each text under a modified Kneser-Ney model of order 4, from dictionaries."""

    def grams(t):
        s = [0, 0, 0, *symbols(t)]
        return [tuple(s[i : i + 4]) for i in range(len(s) - 3)]

    counts = {4: Counter(g for t in trusted for g in grams(t))}
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    cut = {n: discounts(*[sum(c == i for c in counts[n].values()) for i in range(1, 5)]) for n in counts}
    rows = defaultdict(dict)
    for n in counts:
        for g, c in counts[n].items():
            rows[g[:-1], n][g] = c

    known = {}

    def p(g):
        if g not in known:
            known[g] = work(g)
        return known[g]

    def work(g):
        n = len(g)
        if n == 0:
            return 1 / 64
        row = rows.get((g[:-1], n), {})
        total = sum(row.values())
        if not total:
            return p(g[1:])
        low = lambda c: float(cut[n][min(c, 3)])
        c = row.get(g, 0)
        return (c - low(c)) / total + sum(map(low, row.values())) / total * p(g[1:])

    out = []
    for t in texts:
        g = grams(t)
        out.append((len(g), -sum(math.log(p(x)) for x in g)))
    return out


def kept_by_quality(docs, trusted_ids):
    """Which of (doc_id, text, lang) a quality filter keeps."""
    scored = perplexities([t for d, t, _ in docs if d in trusted_ids], [t for _, t, _ in docs])
    known = [(lang, n, s) for (d, _, lang), (n, s) in zip(docs, scored, strict=True) if d in trusted_ids and n]
    cuts = {}
    for lang in {k[0] for k in known}:
        mine = [(n, s) for k, n, s in known if k == lang]
        mean = sum(s for _, s in mine) / sum(n for n, _ in mine)
        drawn = sorted((s + PRIOR * mean) / (n + PRIOR) for n, s in mine)
        cuts[lang] = mean, drawn[max(0, math.ceil(QUANTILE * len(drawn)) - 1)] + math.log(MARGIN)
    out = []
    for (_, _, lang), (n, s) in zip(docs, scored, strict=True):
        mean, top = cuts[lang]
        out.append(n > 0 and (s + PRIOR * mean) / (n + PRIOR) <= top)
    return out


def mixture(docs, weights=(5, 2, 1), cap=3):
    """taken words of (doc_id, text, source), by sorting."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in docs]
    h = [int(hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()[:8], 16) >> 2 for d, _, _ in docs]
    sums = Counter()
    for (_, _, s), n in zip(docs, size, strict=True):
        sums[s] += n
    order = sorted(sums, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sums.values()), set()
    while True:
        rest, share = total - sum(cap * sums[s] for s in full), sum(w[s] for s in order if s not in full)
        over = [s for s in order if s not in full and rest * w[s] > cap * sums[s] * share]
        if not over:
            break
        full |= set(over)
    target = {s: cap * sums[s] if s in full else rest / share * w[s] for s in order}
    taken = [0] * len(docs)
    for s in order:
        whole = math.floor(target[s] / sums[s]) if sums[s] else 0
        left = target[s] - whole * sums[s]
        mine = sorted((h[i], i) for i, (_, _, x) in enumerate(docs) if x == s)
        spent, more = 0, set()
        for key in sorted({k for k, _ in mine}):
            same = [i for k, i in mine if k == key]
            n = sum(size[i] for i in same)
            if spent + n <= left:
                spent, more = spent + n, more | set(same)
            else:
                if spent + n - left < left - spent:
                    more |= set(same)
                break
        for _, i in mine:
            taken[i] = size[i] * (whole + (i in more))
    return taken


def near_duplicates(docs, size=3, percent=85):
    """(doc_id, n, component, kept) of rows (doc_id, text): all pairs of distinct sets."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t or "")) for _, t in docs]
    sets = [frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset() for w in words]
    part = list(range(len(docs)))

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                part[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)].append(d)
    out = []
    for i, (d, _) in enumerate(docs):
        c = (min(least[root(i)], default=None) if sets[i] else d)
        out.append((d, len(sets[i]), c, d is not None and d == c))
    return out


def spelling(docs):
    """(word, form, root, n, n_near, form_n) of rows (doc_id, text): every pair of words is compared."""
    count = Counter()
    for d, t in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            w = ascii_lower(run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w, n in words.items():
        around = [v for v in words if near(w, v)]
        best = min(around, key=lambda v: (-words[v], v), default=None)
        form = best if best and words[best] >= 2 * n else None
        out[w] = (form, n, len(around), words[form] if form else None)

    def root(w):
        return root(out[w][0]) if out[w][0] else w

    return [(w, f, root(w), n, k, m) for w, (f, n, k, m) in out.items()]


def manifest(docs):
    """Rows of the Merkle query for rows (doc_id, source, lang, n_chars, text), level by level."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    code = lambda vs: "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in vs)
    leaf = [sha(code(r)) for r in docs]
    bent = [sha(code((*r[:3], r[3] + 1, r[4]))) if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else None for r in docs]

    def tree(nodes):
        """The top and, for each node, its path: (side, sibling or '')."""
        paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(level) > 1:
            for i, j in enumerate(at):
                k = j ^ 1
                paths[i].append((j & 1, level[k] if k < len(level) else ""))
            at = [j // 2 for j in at]
            level = [sha("".join(level[j : j + 2])) for j in range(0, len(level), 2)]
        return level[0], paths

    groups = defaultdict(list)
    for i, r in enumerate(docs):
        groups[r[2]].append(i)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    tops, paths = {}, {}
    for name in names:
        own = sorted(groups[name], key=lambda i: (docs[i][0] is not None, docs[i][0] or 0, leaf[i]))
        tops[name], found = tree([leaf[i] for i in own])
        paths |= dict(zip(own, found, strict=True))
    root, above = tree([tops[x] for x in names]) if names else (None, [])
    out = []
    for i, r in enumerate(docs):
        path = paths[i] + above[names.index(r[2])]
        node = bent[i] or leaf[i]
        for side, kin in path:
            node = sha(kin + node if side else node + kin)
        out.append((r[0], leaf[i], tops[r[2]], root, sha("".join(k for _, k in path)), node, node == root))
    return out
