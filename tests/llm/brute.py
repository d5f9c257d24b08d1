"""Plain versions of the operators."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def component_of(rows, k, percent=80):
    sets = {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def removed_lines(rows, percent=80):
    seen, out = [], {}
    for d, t in sorted(rows):
        out[d] = [0, []]
        for i, line in enumerate((t or "").split("\n")):
            s = frozenset(WORD.findall(line.translate(LOWER)))
            if not s:
                continue
            out[d][0] += 1
            if any(100 * len(s & x) >= percent * len(s | x) for x in seen):
                out[d][1].append(i)
            seen.append(s)
    return {d: (n, ",".join(map(str, r))) for d, (n, r) in out.items()}


def without_repeats(rows, length=400):
    raw = {d: (t or "").encode() for d, t in rows}
    seen = Counter(b[i : i + length] for b in raw.values() for i in range(len(b) - length + 1))
    out = {}
    for d, b in raw.items():
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[d] = (len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def windows(text, n=10):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return w, [tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []


def contaminated(docs, items):
    owner = {}
    for i, t in items:
        for x in windows(t)[1]:
            owner.setdefault(x, set()).add(i)
    out = {}
    for d, t in docs:
        w, _ = windows(t)
        hit, found = set(), set()
        for n in {len(x) for x in owner}:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in owner:
                    hit |= set(range(i, i + n))
                    found |= owner[x]
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit))
    return out


def counts(text):
    w = WORD.findall(text or "")
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    marked = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines, dup = set(), 0
    for x in (text or "").split("\n"):
        if WORD.search(x):
            dup += x in lines
            lines.add(x)
    failed = len(w) < 20 or 100 * len(marked) > 30 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(marked), failed)


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def personal(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    ok = {
        "email": lambda s: True,
        "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s)),
        "phone": lambda s: 8 <= len(digits(s)) <= 15,
    }
    return {k: [m.span() for m in r.finditer(text or "") if ok[k](m[0])] for k, r in BASE.items()}
