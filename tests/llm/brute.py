"""Plain readings of the operators' definitions, one text at a time."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOW) if lower else text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


class Groups:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)

    def least(self, ids):
        best = defaultdict(list)
        for k, i in enumerate(ids):
            if i is not None:
                best[self.find(k)].append(i)
        return [min(best[self.find(k)], default=None) for k in range(len(ids))]


def shingle_set(text):
    w = words(text, True)
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def jaccard(rows):
    """[(id, text)] to sorted (id, size, component)."""
    sets = [shingle_set(t) for _, t in rows]
    holds, groups = defaultdict(list), Groups(len(rows))
    for k, s in enumerate(sets):
        seen = Counter(j for g in s for j in holds[g])
        for j, o in seen.items():
            if 100 * o >= 75 * (len(s) + len(sets[j]) - o):
                groups.join(k, j)
        for g in s:
            holds[g].append(k)
    return [(i, len(s), c if s else i) for (i, _), s, c in zip(rows, sets, groups.least([i for i, _ in rows]))]


def quality_counts(text):
    w = words(text)
    seen, again, covered = set(), 0, set()
    for line in (text or "").split("\n"):
        again += line in seen and bool(words(line))
        seen.add(line)
    times = Counter(zip(w, w[1:], w[2:]))
    for k in range(len(w) - 2):
        if times[tuple(w[k:k + 3])] > 1:
            covered |= {k, k + 1, k + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def cut_repeats(rows, width=13):
    """[(id, text)] to (id, words, removed, sha of the rest)."""
    last = 1 << 62
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - width + 1):
            key = tuple(w[k:k + width])
            first[key] = min(first.get(key, last), last if i is None else i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k:k + width])] < (last if i is None else i):
                gone[k:k + width] = [True] * width
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def license_blocks(w, template, threshold, required, short=10):
    """Containment of every matching block of twice the template's words, at whatever word it starts."""
    t = license_words(template)
    need = len(set(t)) if len(set(t)) < short else math.ceil(threshold * len(set(t)) - 1e-9)
    for b in range(len(w)):
        held = set(t) & set(w[b:b + 2 * len(t)])
        if len(held) >= need and set(license_words(required)) <= held:
            yield len(held) / len(set(t))


def license_scan(text, templates, phrases, threshold, required):
    w, places, base = license_words(text), [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k:k + len(p)] == p:
                places.append(k)
                base.add(label)
    labels, score = set(base), 1.0 if base else 0.0
    for name, template in templates.items():
        for share in license_blocks(w, template, threshold, required.get(name, "")):
            labels.add(name)
            score = max(score, share)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 9)


def crc(i, m):
    return i is not None and zlib.crc32(str(i).encode()) % m == 2


def unigrams(rows):
    """[(id, text)] to (id, held out, tokens, known, N, base score)."""
    count, texts = Counter(), 0
    for i, t in rows:
        if not crc(i, 7):
            count.update(words(t, True))
            texts += 1
    n, v = sum(count.values()) + texts, len(count) + (texts > 0)
    out = []
    for i, t in rows:
        w = words(t, True)
        score = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w) + math.log10((texts + 1) / (n + v + 1))
        out.append((i, crc(i, 7), len(w) + 1, sum(count[x] > 0 for x in w) + (texts > 0), n, round(score, 6)))
    return out
