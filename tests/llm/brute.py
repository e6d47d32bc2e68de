"""Plain Python versions of the corpus operators, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def exact(docs):
    groups = defaultdict(list)
    for doc_id, text in docs:
        groups[text or ""].append(doc_id)
    return {(d, max(ids), len(ids), d == max(ids), hashlib.sha256(t.encode()).hexdigest())
            for t, ids in groups.items() for d in ids}


def rules(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [s for s in text.split("\n") if WORD.search(s)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered), failed)


def license_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(AZ))


def licenses(text, phrases, templates, threshold):
    words = license_words(text)
    starts, labels = [], set()
    for phrase, label in phrases.items():
        parts = phrase.split()
        found = [i for i in range(len(words)) if words[i:i + len(parts)] == parts]
        starts += found
        labels |= {label} if found else set()
    more, best = set(), 0.0
    for line in (text or "").split("\n"):
        held = set(license_words(line))
        for label, template in templates.items():
            own = set(license_words(template))
            if len(own & held) >= threshold * len(own) - 1e-9:
                more.add(label)
                best = max(best, len(own & held) / len(own))
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)),
            ",".join(sorted(labels | more)), 1.0 if starts else best)


def shingles(text):
    words = WORD.findall((text or "").translate(AZ))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)])


def near(docs, percent=85):
    """{doc_id: (set size, component)} with links where 100 * intersection >= percent * union."""
    sets = {d: shingles(t) for d, t in docs}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            root[d] = root[root[d]]
            d = root[d]
        return d

    seen = set()
    for ids in holders.values():
        for i, a in enumerate(ids):
            for b in ids[:i]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    common = len(sets[a] & sets[b])
                    if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                        low, high = sorted((find(a), find(b)))
                        root[high] = low
    return {d: (len(s), find(d)) for d, s in sets.items()}
