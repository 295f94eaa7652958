"""Plain Python versions of the operators, for small fixtures."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substring_dedup(texts, width):
    found = [WORD.findall(t or "") for t in texts]
    counts = Counter(tuple(w[k : k + width]) for w in found for k in range(len(w) - width + 1))
    out = []
    for w in found:
        gone = set()
        for k in range(len(w) - width + 1):
            if counts[tuple(w[k : k + width])] > 1:
                gone |= set(range(k, k + width))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def linked_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    for a, b in {(a, b) for ids in where.values() for a in ids for b in ids if a < b}:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    counts = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    repeated = set()
    for k in range(len(w) - 7):
        if counts[tuple(w[k : k + 8])] > 1:
            repeated |= set(range(k, k + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def base_secrets(text):
    spans = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{z}" for a, _, k, z in sorted(spans))


def token_ids(tokenizer, rows, end_id):
    at, out = 0, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [end_id]
        out[i] = (at, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)))
        at += len(ids)
    return out


def line_shingles(line):
    return {line} if len(line) <= 5 else {line[k : k + 5] for k in range(len(line) - 4)}
