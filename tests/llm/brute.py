"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

LOWER = {i: chr(i + 32) for i in range(65, 91)}
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTER_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def space_words(text, lower=False):
    text = text or ""
    return SPACE_WORD.findall(text.translate(LOWER) if lower else text)


def letter_words(text):
    return LETTER_WORD.findall((text or "").translate(LOWER))


def near_dups(rows, k=4, percent=80):
    """{id: (n_shingles, component)} of distinct non-null ids."""
    sets = {}
    for i, text in rows:
        w = space_words(text, lower=True)
        sets[i] = frozenset(tuple(w[s : s + k]) for s in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def contamination(rows, items, window=10):
    """[(id, n_words, n_hit, n_items, sha, contaminated)]."""
    known = collections.defaultdict(set)
    for item, text in items:
        w = letter_words(text)
        if w:
            m = min(window, len(w))
            for s in range(len(w) - m + 1):
                known[tuple(w[s : s + m])].add(item)
    out = []
    for i, text in rows:
        w, hit, met = letter_words(text), set(), set()
        for m in {len(x) for x in known}:
            for s in range(len(w) - m + 1):
                if tuple(w[s : s + m]) in known:
                    hit |= set(range(s, s + m))
                    met |= known[tuple(w[s : s + m])]
        met = sorted({str(x) for x in met if x is not None})
        out.append((i, len(w), len(hit), len(met), sha(",".join(met)), len(hit) > 0))
    return out


def katz(rows, top=5):
    """{id: (held_out, n_tokens, n_known, train, base, score)} and the function P(w | h)."""
    tokens = [(i, [*space_words(t, lower=True), "</>"]) for i, t in rows]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i, _ in rows]
    one, two = collections.Counter(), collections.defaultdict(collections.Counter)
    for (_, t), out in zip(tokens, held, strict=True):
        if not out:
            one.update(t)
            for h, w in zip(["<>", *t], t, strict=False):
                two[h][w] += 1
    n, kinds = sum(one.values()), len(one)

    def discounts(counts):
        c = [counts.get(r, 0) for r in range(1, top + 2)]
        d = c[0] / (c[0] + 2 * c[1]) if c[0] else 0.5
        f = [(r - min(d, 0.9)) / r for r in range(1, top + 1)]
        if all(c) and (cut := (top + 1) * c[top] / c[0]) < 1:
            good = [((r + 1) * c[r] / c[r - 1] / r - cut) / (1 - cut) for r in range(1, top + 1)]
            f = [g if 0 < g < 1 else x for g, x in zip(good, f, strict=True)]
        return lambda r: r if r > top else r * f[r - 1]

    d1, d2 = discounts(collections.Counter(one.values())), discounts(collections.Counter(x for h in two.values() for x in h.values()))
    rest = 1 - sum(map(d1, one.values())) / n if n else 1.0
    scale = 1.0
    if rest <= 1e-12:
        rest, scale = 1 / (n + 1), n / (n + 1)

    def p1(w):
        return d1(one[w]) / n * scale if one.get(w) else rest

    def p2(h, w):
        f = two.get(h)
        if not f:
            return p1(w)
        total, freed = sum(f.values()), sum(x - d2(x) for x in f.values())
        if w in f:
            return d2(f[w]) / total * (1 if freed > 0 else total / (total + 1))
        return (freed / total if freed > 0 else 1 / (total + 1)) / (1 - sum(map(p1, f))) * p1(w)

    out = [(i, o, len(t), sum(w in one for w in t), n, sum(math.log10((one[w] + 0.1) / (n + 0.1 * (kinds + 1))) for w in t), sum(math.log10(p2(h, w)) for h, w in zip(["<>", *t], t, strict=False))) for (i, t), o in zip(tokens, held, strict=True)]
    return out, p2, one


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def licenses(rows):
    out = []
    for i, text in rows:
        w = letter_words(text)
        found = [(s, label) for p, label in PHRASES.items() for s in range(len(w)) if w[s : s + len(p.split())] == p.split()]
        out.append((i, len(w), len(found), min(found)[0] if found else None, max(found)[0] if found else None, ",".join(sorted({x for _, x in found}))))
    return out


def quality(rows):
    out = []
    for i, text in rows:
        text = text or ""
        w = space_words(text)
        times = collections.Counter(tuple(w[s : s + 8]) for s in range(len(w) - 7))
        covered = {s + j for s in range(len(w) - 7) if times[tuple(w[s : s + 8])] > 1 for j in range(8)}
        seen, lines = set(), 0
        for line in text.split("\n"):
            if SPACE_WORD.search(line):
                lines += line in seen
                seen.add(line)
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)))
    return out


def substring(rows, window=50):
    first = {}
    for i, text in rows:
        w = space_words(text)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if i is not None and i < first.get(key, math.inf):
                first[key] = i
    out = []
    for i, text in rows:
        w, gone = space_words(text), set()
        for s in range(len(w) - window + 1):
            if i is not None and first[tuple(w[s : s + window])] < i:
                gone |= set(range(s, s + window))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def katz_of_order(rows, order, top=5):
    """[(id, score)] of a Katz model of any order, and P(words): the probability of the last word after those before it ("<>" is the start)."""
    tokens = [(i, [*space_words(t, lower=True), "</>"]) for i, t in rows]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i, _ in rows]
    past = lambda t, at, m: tuple(["<>", *t][max(0, at + 2 - m) : at + 1])
    seen = {m: collections.defaultdict(collections.Counter) for m in range(1, order + 1)}
    for (_, t), out in zip(tokens, held, strict=True):
        if not out:
            for at, w in enumerate(t):
                for m in range(1, order + 1):
                    seen[m][past(t, at, m) if m > 1 else ()][w] += 1
    one = seen[1][()]
    n = sum(one.values())

    def discounted(counts):
        c = [counts.get(r, 0) for r in range(1, top + 2)]
        d = c[0] / (c[0] + 2 * c[1]) if c[0] else 0.5
        f = [(r - min(d, 0.9)) / r for r in range(1, top + 1)]
        if all(c) and (cut := (top + 1) * c[top] / c[0]) < 1:
            good = [((r + 1) * c[r] / c[r - 1] / r - cut) / (1 - cut) for r in range(1, top + 1)]
            f = [g if 0 < g < 1 else x for g, x in zip(good, f, strict=True)]
        return lambda r: r if r > top else r * f[r - 1]

    d = {m: discounted(collections.Counter(x for h in seen[m].values() for x in h.values())) for m in seen}
    rest = 1 - sum(map(d[1], one.values())) / n

    def p(m, h, w):
        if m == 1:
            return d[1](one[w]) / n if one.get(w) else rest
        below = lambda v: p(m - 1, h[1:] if len(h) == m - 1 else h, v) if m > 2 else p(1, (), v)
        f = seen[m].get(h)
        if not f:
            return below(w)
        total, freed = sum(f.values()), sum(x - d[m](x) for x in f.values())
        if w in f:
            return d[m](f[w]) / total * (1 if freed > 0 else total / (total + 1))
        return (freed / total if freed > 0 else 1 / (total + 1)) / (1 - sum(map(below, f))) * below(w)

    of = lambda words: p(order, tuple(words[:-1]), words[-1])
    return [(i, sum(math.log10(p(order, past(t, at, order), w)) for at, w in enumerate(t))) for i, t in tokens], of, one


CLASS_MARKS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\x0b\x0c\r", ".,;:!?-", "\"'()[]{}", "#*$%&|<>@=+_~^`/\\")
LENGTHS = sorted({int(8 * 256 ** (i / 32)) for i in range(33)})


def _divergence(p, q):
    """Jensen-Shannon divergence in bits of two lists of counts."""
    a, b = sum(p), sum(q)
    if not a or not b:
        return 0.0
    out = 0.0
    for x, y in zip(p, q, strict=True):
        x, y = x / a, y / b
        out += sum(z * math.log2(2 * z / (x + y)) for z in (x, y) if z) / 2
    return max(out, 0.0)


def _chance(q, n):
    """Mean and standard deviation of the divergence of n words drawn from shares q, bin by bin."""
    mean = var = 0.0
    for s in q:
        if 0 < s < 1:
            first = second = 0.0
            for x in range(n + 1):
                chance = math.exp(math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) + x * math.log(s) + (n - x) * math.log1p(-s))
                p = x / n
                bits = ((p * math.log2(2 * p / (p + s)) if p else 0) + s * math.log2(2 * s / (p + s))) / 2
                first, second = first + chance * bits, second + chance * bits * bits
            mean, var = mean + first, var + max(second - first * first, 0)
    return mean, math.sqrt(var)


def quality_verdicts(rows, common, least_words=50, class_limit=0.3, word_limit=0.6, deviations=3):
    """[(id, kept)] of rows (id, text, lang)."""
    base = {n: r for n, r in enumerate(quality([(i, t) for i, t, _ in rows]))}
    kinds, words = [], []
    for _, text, lang in rows:
        text = text or ""
        kind = [sum(text.count(c) for c in marks) for marks in CLASS_MARKS]
        wide = sum(ord(c) > 0x7F for c in text)
        kinds.append([*kind, len(text) - wide - sum(kind), wide])
        own = {w: j for j, w in enumerate(common.get(lang, []))}
        found = [0] * 31
        for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER)):
            found[own.get(w, 30)] += 1
        words.append(found)
    total = collections.defaultdict(lambda: ([0] * 9, [0] * 31))
    for (_, _, lang), k, w in zip(rows, kinds, words, strict=True):
        old = total[lang]
        total[lang] = ([a + b for a, b in zip(old[0], k, strict=True)], [a + b for a, b in zip(old[1], w, strict=True)])
    bounds = {}

    def bound(lang, n):
        """By straight lines between some lengths on a logarithmic scale; beyond the last, chance falls with the length."""
        q = total[lang][1]
        q = [x / max(sum(q), 1) for x in q]
        reach = _divergence([0] * 30 + [1], q)
        top = LENGTHS[-1]
        at = min(max(n, LENGTHS[0]), top)
        hi = next(x for x in LENGTHS if x >= at)
        lo = max([x for x in LENGTHS if x <= at])
        for x in (lo, hi):
            if (lang, x) not in bounds:
                bounds[lang, x] = _chance(q, x)
        share = (math.log(at) - math.log(lo)) / (math.log(hi) - math.log(lo)) if hi > lo else 0
        mean, spread = (a + (b - a) * share for a, b in zip(bounds[lang, lo], bounds[lang, hi], strict=True))
        beyond = max(n / top, 1)
        return math.sqrt(mean / beyond + max(word_limit**2 * reach, deviations * spread / beyond))

    out = []
    for n, (i, _, lang) in enumerate(rows):
        count, failed = base[n][1], base[n][-1]
        odd = count >= least_words and (math.sqrt(_divergence(kinds[n], total[lang][0])) > class_limit or math.sqrt(_divergence(words[n], total[lang][1])) > bound(lang, max(sum(words[n]), 1)))
        out.append((i, not failed and not odd))
    return out


def shards(rows, shards, slots):
    """[(id, size, shard)]: slots by xxhash64 of id, crc32 and size, dealt in turn, then moved one by one from the fullest shard to the emptiest while that levels them."""
    import xxhash

    placed, load = [], collections.Counter()
    for i, text in rows:
        body = (text or "").encode()
        h = 42
        for v in (i, zlib.crc32(body), len(body) + 8):
            if v is not None:
                h = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), seed=h)
        slot = (h - (1 << 64) if h >> 63 else h) % slots
        placed.append((i, len(body) + 8, slot))
        load[slot] += len(body) + 8
    owner = {s: s % shards for s in range(slots)}
    while True:
        total = [sum(load[s] for s in load if owner[s] == x) for x in range(shards)]
        full, empty = total.index(max(total)), total.index(min(total))
        lead = total[full] - total[empty]
        choice = [(abs(load[s] - lead / 2), load[s], s) for s in load if owner[s] == full and load[s] < lead]
        if not choice:
            return [(i, size, owner[s]) for i, size, s in placed]
        nearest = min(c[:2] for c in choice)
        # Of equal ones the last slot of the larger size below half, the first of the size above, as a sorted list gives them.
        same = [s for a, b, s in choice if (a, b) == nearest]
        owner[max(same) if nearest[1] < lead / 2 else min(same)] = empty
