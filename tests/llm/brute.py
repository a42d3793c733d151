"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import defaultdict

import xxhash

WORD = "[^\x20\x09-\x0d]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def simhash(text, size=4):
    words = re.findall(WORD, lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(count, linked):
    parent = list(range(count))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(count):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(count)]


def near_duplicates(docs, distance=4):
    prints = [simhash(t) for _, t in docs]
    root = roots(len(docs), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= distance)
    least = {}
    for (d, _), r in zip(docs, root):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted(((d, f"{p:016x}", least.get(r)) for (d, _), p, r in zip(docs, prints, root)), key=str)


def substring(docs, length=50):
    least, words = {}, [re.findall(WORD, t or "") for _, t in docs]
    for (d, _), w in zip(docs, words):
        for k in range(len(w) - length + 1) if d is not None else ():
            key = tuple(w[k : k + length])
            least[key] = min(d, least.get(key, d))
    out = []
    for (d, _), w in zip(docs, words):
        gone = set()
        for k in range(len(w) - length + 1) if d is not None else ():
            if least[tuple(w[k : k + length])] < d:
                gone.update(range(k, k + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def lines(docs, distance=2, least=20):
    first = {}
    parts = [((-1 if d is None else d), xxhash.xxh64_intdigest((t or "").encode(), 42), (t or "").split("\n")) for d, t in docs]
    parts = [(d, k - (1 << 64) if k >> 63 else k, p) for d, k, p in parts]
    for d, k, p in parts:
        for n, line in enumerate(p):
            if len(line) >= least:
                first[line] = min((d, k, n), first.get(line, (d, k, n)))
    near = {a for a in first for b in first if a != b and first[b] < first[a] and abs(len(a) - len(b)) <= distance and edits(a, b) <= distance}
    out = []
    for (doc, _), (d, k, p) in zip(docs, parts):
        kept = [line for n, line in enumerate(p) if len(line) < least or (line not in near and first[line] == (d, k, n))]
        out.append((doc, len(p), len(p) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def exact(docs):
    groups = defaultdict(list)
    for d, t in docs:
        groups[t or ""].append(d)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        took = False
        for d in ids:
            kept = d == keep and not took
            took |= kept
            out.append((d, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def url_rule(host, path, rules):
    fits = [(len(h) + len(p), len(h), a == "block", h + p, a) for h, p, a in rules if ("." + host).endswith("." + h) and path.startswith(p)]
    return max(fits)[3:] if fits else (None, None)


def licenses(docs, templates, phrases, threshold, least_block):
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)"""
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    sets = []
    for label, text in templates.values():
        size = max(least_block, next(1 << b for b in range(30) if 1 << b >= 2 * len(split(text))))
        sets.append((label, set(split(text)), size))
    out = []
    for d, t in docs:
        words, lines = split(t), [split(x) for x in (t or "").split("\n")]
        places = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        best, labels = 0.0, {label for _, label in places}
        for label, own, size in sets:
            for stream in [*lines, words]:
                for start in range(0, max(1, len(stream) - size // 2), size // 2):
                    share = len(own & set(stream[start : start + size])) / len(own)
                    if share >= threshold - 1e-9:
                        best = max(best, share)
                        labels.add(label)
        base = sorted({label for _, label in places})
        at = [i for i, _ in places]
        out.append((d, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(base), ",".join(sorted(labels)), 1.0 if at else best))
    return out


def shingles(text, size=5):
    words = lower(text).split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}
