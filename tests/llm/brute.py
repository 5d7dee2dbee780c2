"""Plain Python versions of the operators' contracts, for small inputs."""

import collections
import hashlib
import re

ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK = re.compile(rb"[^\x20\x09-\x0D]+")
PHRASES = {(b"mit", b"license"): "mit", (b"apache", b"license"): "apache", (b"general", b"public", b"license"): "gpl"}


def words(text, pattern=ALNUM):
    return pattern.findall((text or "").encode().lower())


def licenses(doc_id, text):
    w = words(text)
    at = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
    starts = [i for i, _ in at]
    return doc_id, len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def contamination(docs, benchmark):
    index = collections.defaultdict(lambda: collections.defaultdict(set))
    for item, text in benchmark:
        w = words(text)
        n = min(13, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            index[n][tuple(w[a : a + n])].add(str(item))
    for doc_id, text in docs:
        w, hit, items = words(text), set(), set()
        for n, table in index.items():
            for a in range(len(w) - n + 1):
                if found := table.get(tuple(w[a : a + n])):
                    items |= found
                    hit.update(range(a, a + n))
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        yield doc_id, len(w), len(hit), len(items), digest, len(hit) > 0 and 20 * len(hit) >= len(w)


def shingles(text, n=5):
    w = words(text, BLANK)
    return frozenset(tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))) if w else frozenset()


def near_duplicates(docs, percent=85):
    """(doc_id, n_shingles, component_id, kept) by trying every pair."""
    sets = [(d, shingles(t)) for d, t in docs]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least.setdefault(root(i), []).append(d)
    for i, (d, s) in enumerate(sets):
        known = [x for x in least[root(i)] if x is not None] if s else [d]
        own = min(known) if known and known != [None] else None
        yield d, len(s), own, d == own


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def personal(text):
    t = text or ""
    digits = lambda s: re.sub(r"\D", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]
    return out


def spans(found):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def repeats(docs, span=13):
    """(doc_id, n_words, n_removed, kept text): words of windows that also start in a document with a smaller id."""
    split = [(d, (t or "").encode().split()) for d, t in docs]
    least = {}
    for d, w in split:
        for i in range(len(w) - span + 1 if d is not None else 0):
            key = tuple(w[i : i + span])
            least[key] = min(d, least.get(key, d))
    for d, w in split:
        gone = {i + k for i in range(len(w) - span + 1) if d is not None and least[tuple(w[i : i + span])] < d for k in range(span)}
        yield d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()


def rebuild(rows, heads=6, group=100):
    """conv_id -> turns (role, text) after the heads were exchanged."""
    import zlib

    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v, key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (abs(c) % group) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def trie(convs):
    """Every prefix as (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    members = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    below = collections.defaultdict(list)
    for p in members:
        for d in range(len(p) + 1):
            below[p[:d]].append(p)
    children = collections.Counter(p[:-1] for p in members if p)
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))
        saved = sum((len(members[q]) - 1) * (len(q[-1][1]) if q else 0) for q in below[p])
        leaves = sum(not children[q] for q in below[p])
        yield min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves, saved, hashlib.sha256(ends.encode()).hexdigest()
