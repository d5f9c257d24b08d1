"""Character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import bisect
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Kinds that fixed patterns find too, and those that the tagger knows.
KINDS = ["email", "ip", "card", "phone"]
TAGGED = [*KINDS, "secret"]
#: Tags: 0 outside; 1 + 2k begins kind k, 2 + 2k goes on with it.
TAGS = 1 + 2 * len(TAGGED)
WIDTH, STRIDE = 96, 48

#: Classes of characters: 0 padding, 1 other, then as listed, then ASCII punctuation each by itself.
GROUPS = ["0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", " \t", "\n\r"]
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CLASSES = 2 + len(GROUPS) + len(PUNCTUATION) + 1
CLASS_OF = np.ones(129, np.int8)
for _i, _g in enumerate([*GROUPS, *PUNCTUATION]):
    for _c in _g:
        CLASS_OF[ord(_c)] = 2 + _i
CLASS_OF[128] = CLASSES - 1  # all that isn't ASCII

#: Names, and names joined by dots or @ that may be spaced or in brackets: no stretch ends inside.
NAMES = re.compile(r"[A-Za-z0-9._%+-]+(?:\s*[\[(]?[@.][\])]?\s*[A-Za-z0-9._%+-]+)*")


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return CLASS_OF[np.minimum(points, 128)]


def may_follow() -> np.ndarray:
    """Which tag may follow which: a kind goes on only after its own begin or middle."""
    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(TAGGED)):
        ok[:, 2 + 2 * k] = False
        ok[1 + 2 * k, 2 + 2 * k] = ok[2 + 2 * k, 2 + 2 * k] = True
    return ok


FORBIDDEN = -1e4


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Model:
    """embed (2, classes, 4h): input to gates by direction; recur (2, h, 4h); out (2h, tags); bias (tags); trans (tags, tags)."""

    embed: np.ndarray
    recur: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    trans: np.ndarray

    @staticmethod
    def fresh(hidden: int, seed: int) -> Model:
        r = np.random.default_rng(seed)
        embed = r.normal(0, 0.3, (2, CLASSES, 4 * hidden))
        embed[:, :, hidden : 2 * hidden] += 1.0  # remember at first
        return Model(embed, r.normal(0, hidden**-0.5, (2, hidden, 4 * hidden)), r.normal(0, 0.2, (2 * hidden, TAGS)), np.zeros(TAGS), np.zeros((TAGS, TAGS)))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.recur, self.out, self.bias, self.trans]

    def scores(self) -> np.ndarray:
        return np.where(may_follow(), self.trans, FORBIDDEN)

    def states(self, x: np.ndarray, keep: bool = False):
        """Hidden states (2, t, n, h) of windows x (n, t); direction 1 reads from the end, and is given in text order."""
        n, t = x.shape
        h = self.recur.shape[1]
        both = np.stack([x.T, x.T[::-1]])
        inputs = np.stack([self.embed[d][both[d]] for d in range(2)])
        hid = np.zeros((2, n, h), self.embed.dtype)
        cell = np.zeros_like(hid)
        all_h = np.empty((2, t, n, h), self.embed.dtype)
        tape = []
        for s in range(t):
            z = inputs[:, s] + hid @ self.recur
            ifo = sigmoid(z[:, :, : 3 * h])
            g = np.tanh(z[:, :, 3 * h :])
            before, was = cell, hid
            cell = ifo[:, :, h : 2 * h] * cell + ifo[:, :, :h] * g
            tc = np.tanh(cell)
            hid = ifo[:, :, 2 * h :] * tc
            all_h[:, s] = hid
            if keep:
                tape.append((ifo, g, before, was, tc))
        return (all_h, both, tape) if keep else np.stack([all_h[0], all_h[1][::-1]])

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """(n, t, tags) for windows x (n, t)."""
        s = self.states(x)
        h = self.recur.shape[1]
        return (s[0] @ self.out[:h] + s[1] @ self.out[h:] + self.bias).transpose(1, 0, 2)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def gradients(m: Model, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean negative log likelihood of tags y (n, t) of windows x, and its gradient by part."""
    n, t = x.shape
    h = m.recur.shape[1]
    raw, both, tape = m.states(x, keep=True)
    s0, s1 = raw[0], raw[1][::-1]
    e = s0 @ m.out[:h] + s1 @ m.out[h:] + m.bias  # (t, n, tags)
    a = m.scores()
    start = np.where(may_follow()[0], 0.0, FORBIDDEN)
    fwd, bwd = np.empty_like(e), np.zeros_like(e)
    fwd[0] = e[0] + start
    for s in range(1, t):
        fwd[s] = log_sum(fwd[s - 1][:, :, None] + a, 1) + e[s]
    for s in range(t - 2, -1, -1):
        bwd[s] = log_sum(a + (e[s + 1] + bwd[s + 1])[:, None, :], 2)
    z = log_sum(fwd[-1], 1)
    de = np.exp(fwd + bwd - z[:, None])
    rows = np.arange(n)
    gold = sum(e[s][rows, y[:, s]] for s in range(t)) + a[y[:, :-1], y[:, 1:]].sum(axis=1)
    da = np.zeros_like(a)
    for s in range(1, t):
        da += np.exp(fwd[s - 1][:, :, None] + a + (e[s] + bwd[s])[:, None, :] - z[:, None, None]).sum(axis=0)
        de[s][rows, y[:, s]] -= 1
    de[0][rows, y[:, 0]] -= 1
    np.add.at(da, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
    da[~may_follow()] = 0
    de /= n
    dout = np.concatenate([np.einsum("tnh,tnk->hk", s0, de), np.einsum("tnh,tnk->hk", s1, de)])
    dh = np.stack([de @ m.out[:h].T, (de @ m.out[h:].T)[::-1]])
    dembed, drecur = np.zeros_like(m.embed), np.zeros_like(m.recur)
    back, dcell = np.zeros((2, n, h)), np.zeros((2, n, h))
    for s in range(t - 1, -1, -1):
        ifo, g, before, was, tc = tape[s]
        d = dh[:, s] + back
        dcell = dcell + d * ifo[:, :, 2 * h :] * (1 - tc**2)
        dz = np.concatenate([dcell * g, dcell * before, d * tc], axis=2) * ifo * (1 - ifo)
        dz = np.concatenate([dz, dcell * ifo[:, :, :h] * (1 - g**2)], axis=2)
        drecur += was.transpose(0, 2, 1) @ dz
        for k in range(2):
            one = np.zeros((n, CLASSES))
            one[rows, both[k, s]] = 1
            dembed[k] += one.T @ dz[k]
        back = dz @ m.recur.transpose(0, 2, 1)
        dcell = dcell * ifo[:, :, h : 2 * h]
    return float((z - gold).mean()), [dembed, drecur, dout, de.sum(axis=(0, 1)), da / n]


def train(texts: list[str], spans: list[list[tuple[str, int, int]]], hidden: int = 16, steps: int = 260, batch: int = 48, rate: float = 0.02, seed: int = 5) -> Model:
    """A model of labelled spans (kind, start, end), by Adam on the CRF's likelihood over windows of the texts."""
    xs, ys = [], []
    for text, own in zip(texts, spans, strict=True):
        x, y = classes(text), np.zeros(len(text), np.int64)
        for kind, s, e in own:
            k = TAGGED.index(kind)
            y[s:e] = 2 + 2 * k
            y[s] = 1 + 2 * k
        for at in range(0, max(1, len(x) - STRIDE), STRIDE):
            a, b = x[at : at + WIDTH], y[at : at + WIDTH].copy()
            if len(b) and (b[0] > 0 and b[0] % 2 == 0):
                b[0] -= 1
            xs.append(np.pad(a, (0, WIDTH - len(a))))
            ys.append(np.pad(b, (0, WIDTH - len(b))))
    xs, ys = np.array(xs), np.array(ys)
    m = Model.fresh(hidden, seed)
    r = np.random.default_rng(seed)
    first = [np.zeros_like(p) for p in m.parts()]
    second = [np.zeros_like(p) for p in m.parts()]
    for step in range(1, steps + 1):
        pick = r.integers(0, len(xs), batch)
        _, grads = gradients(m, xs[pick], ys[pick])
        norm = max(1.0, sum(float((g**2).sum()) for g in grads) ** 0.5 / 5)
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, u, v in zip(m.parts(), grads, first, second, strict=True):
            g = g / norm
            u *= 0.9
            u += 0.1 * g
            v *= 0.999
            v += 0.001 * g**2
            p -= now * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(*[p.astype(np.float32) for p in m.parts()])


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def with_check_digit(digits: str) -> str:
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def labelled(n: int, seed: int) -> tuple[list[str], list[list[tuple[str, int, int]]]]:
    """Made-up texts with the spans that were put into them, and with strings that look like such but are none."""
    r = random.Random(seed)
    letters = "aabcdeeefghiilmnoprsttuéüöñçà"

    def word() -> str:
        w = "".join(r.choice(letters) for _ in range(r.randint(1, 11)))
        return r.choice([w, w, w, w.capitalize(), w.upper()])

    def digits(k: int) -> str:
        return "".join(r.choice("0123456789") for _ in range(k))

    def plain() -> str:
        return "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))

    def email() -> str:
        name = r.choice([plain(), f"{plain()}.{plain()}", f"{plain()}.{digits(2)}", f"{plain()}_{digits(3)}", f"{plain()}+{plain()}"])
        host = r.choice([f"{plain()}.com", f"mail{digits(1)}.{plain()}.org", f"{plain()}-{plain()}.co.uk", f"{plain()}.net"])
        return r.choice([f"{name}@{host}"] * 3 + [f"{name} @ {host}", f"{name}[@]{host}", f"{name} (@) {host}", f"{name}@{host}".replace(".", " . ")])

    def ip() -> str:
        return r.choice([".", ".", ".", "[.]", "(.)", " . "]).join(str(r.randint(0, 255)) for _ in range(4))

    def card() -> str:
        d = with_check_digit(digits(r.choice([15, 15, 15, 17, 18])))
        return r.choice([d, d, r.choice([" ", "-", ".", " - ", "/"]).join(d[i : i + 4] for i in range(0, len(d), 4))])

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice([f"+{digits(1)} ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{digits(2)}{a}{b}{c}", f"00{digits(2)} {a} {b} {c}", f"+{digits(1)}.{a}.{b}.{c}"])

    def secret() -> tuple[str, str]:
        """What comes before a secret, and the secret."""
        name = r.choice(["token", "secret", "api_key", "apikey", "password", "access_token", "auth_key", "client_secret"])
        signs = r.choice(["0123456789abcdef", "0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"])
        return r.choice([name, name.upper()]) + r.choice([' = "', ' = "', "=", ": ", '": "', "='"]), "".join(r.choice(signs) for _ in range(r.choice([20, 32, 40, 40, 64])))

    def other() -> str:
        return r.choice([
            lambda: '"' + "".join(r.choice("0123456789abcdef") for _ in range(r.choice([32, 40, 64]))) + '"',
            lambda: f"{r.randint(1, 9)}.{r.randint(0, 20)}.",
            lambda: f"version {r.randint(0, 9)}.{r.randint(0, 9)}.{r.randint(0, 99)}",
            lambda: str(r.randint(1900, 2030)),
            lambda: f"20{digits(2)}-{r.randint(10, 12)}-{r.randint(10, 28)}",
            lambda: digits(r.randint(1, 7)),
            lambda: f"{digits(2)}:{digits(2)}:{digits(2)}",
            lambda: f"@{plain()}",
            lambda: f"{digits(2)} {word()} {digits(3)}",
            lambda: f"{digits(1)},{digits(3)},{digits(3)}.{digits(2)}",
            lambda: digits(r.randint(20, 40)),
        ])()

    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    texts, spans = [], []
    for _ in range(n):
        text, own = "", []
        for _ in range(r.randint(1, 4)):
            text += "".join(word() + r.choice([" ", " ", " ", ", ", ". ", ".\n", "\n", "%%% ", " | "]) for _ in range(r.randint(0, 8)))
            kind = r.choice([*TAGGED, "other", "other"])
            before, s = secret() if kind == "secret" else ("", makers.get(kind, other)())
            text += before
            if kind != "other":
                own.append((kind, len(text), len(text) + len(s)))
            text += s + r.choice({'"': ['" ', '"\n', '"'], "'": ["' ", "'\n"]}.get(before[-1:], [" ", " ", ". ", ", ", "\n", ") "]))
        texts.append(text)
        spans.append(own)
    return texts, spans


@lru_cache(2)
def default_model(seed: int = 5) -> Model:
    return train(*labelled(3000, seed))


def regions(text: str, margin: int = STRIDE) -> list[tuple[int, int]]:
    """Stretches within ``margin`` characters of a digit or an @, and on to the end of the name, or of names joined by dots or @, that they
    would cut. A span of any kind has one of these characters, so outside these stretches the best tags are 'outside' by definition."""
    x = classes(text)
    hit = np.flatnonzero((x == 2) | (x == 2 + len(GROUPS) + PUNCTUATION.index("@")))
    if not len(hit):
        return []
    cut = np.flatnonzero(np.diff(hit) > 2 * margin)
    first, last = hit[np.r_[0, cut + 1]], hit[np.r_[cut, len(hit) - 1]]
    near = [(max(0, a - margin), min(len(x), b + 1 + margin)) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
    names = [m.span() for m in NAMES.finditer(text)]
    starts = [s for s, _ in names]
    out: list[tuple[int, int]] = []
    for a, b in near:
        if (k := bisect.bisect_right(starts, a) - 1) >= 0 and names[k][1] > a:
            a = names[k][0]
        if (k := bisect.bisect_left(starts, b) - 1) >= 0 and names[k][1] > b:
            b = names[k][1]
        if out and a <= out[-1][1]:
            a = out.pop()[0]
        out.append((a, b))
    return out


#: Characters of stretches that are scored together, and cells (chains times the longest) that are decoded together; one longer stretch is alone.
GROUP_CHARS, CELLS = 1 << 17, 1 << 18


def decode(m: Model, texts: list[str], chunk: int = 256) -> list[list[tuple[str, int, int]]]:
    """Spans of each text. Windows of WIDTH characters, STRIDE apart on a grid of the whole text, are scored; where they overlap, scores are
    averaged by how far inside the window a character lies; then each stretch is decoded as one chain, so spans that cross windows come out whole.

    Memory is some 150 bytes for each character of a stretch: of GROUP_CHARS characters, or of one stretch if that is longer.
    """
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    held: list[tuple[int, int, int]] = []
    size = 0
    for i, t in enumerate(texts):
        for a, b in regions(t):
            if held and size + b - a > GROUP_CHARS:
                decode_stretches(m, texts, held, chunk, out)
                held, size = [], 0
            held.append((i, a, b))
            size += b - a
    decode_stretches(m, texts, held, chunk, out)
    return [sorted(o, key=lambda s: s[1:]) for o in out]


def decode_stretches(m: Model, texts: list[str], stretches: list[tuple[int, int, int]], chunk: int, out: list[list[tuple[str, int, int]]]) -> None:
    """Adds the spans of stretches (number of the text, start, end) to ``out``."""
    coded = {i: classes(texts[i]) for i in {s[0] for s in stretches}}
    scores = [np.zeros((b - a, TAGS), np.float32) for _, a, b in stretches]
    weight = [np.zeros((b - a, 1), np.float32) for _, a, b in stretches]
    inside = np.minimum(np.arange(WIDTH) + 1, WIDTH - np.arange(WIDTH))[:, None].astype(np.float32)
    where: list[tuple[int, int]] = []
    xs: list[np.ndarray] = []

    def score() -> None:
        if not xs:
            return
        for (k, at), own in zip(where, m.emissions(np.array(xs)), strict=True):
            _, a, b = stretches[k]
            lo, hi = max(a, at), min(b, at + WIDTH)
            scores[k][lo - a : hi - a] += own[lo - at : hi - at] * inside[lo - at : hi - at]
            weight[k][lo - a : hi - a] += inside[lo - at : hi - at]
        where.clear()
        xs.clear()

    for k, (i, a, b) in enumerate(stretches):
        # the windows of the whole text that touch the stretch
        for at in range(max(0, (a - WIDTH) // STRIDE + 1) * STRIDE, min(b, max(1, len(coded[i]) - STRIDE)), STRIDE):
            x = coded[i][at : at + WIDTH]
            where.append((k, at))
            xs.append(np.pad(x, (0, WIDTH - len(x))))
            if len(xs) == chunk:
                score()
    score()
    for s, w in zip(scores, weight, strict=True):
        s /= w
    order = sorted(range(len(stretches)), key=lambda k: len(scores[k]))
    at = 0
    while at < len(order):
        n = 1
        while n < chunk and at + n < len(order) and len(scores[order[at + n]]) * (n + 1) <= CELLS:
            n += 1
        ks = order[at : at + n]
        for k, tags in zip(ks, viterbi(m, [scores[k] for k in ks]), strict=True):
            i, a, _ = stretches[k]
            out[i] += runs(tags, a)
        at += n


def viterbi(m: Model, scores: list[np.ndarray]) -> list[np.ndarray]:
    """Best tags of several chains at once; chains come in the order of their length. A chain keeps a byte for each back pointer."""
    a = m.scores()
    longest, n = max(map(len, scores)), len(scores)
    e = np.zeros((longest, n, TAGS), np.float32)
    e[:, :, 1:] = FORBIDDEN  # after a chain's end: outside
    for i, s in enumerate(scores):
        e[: len(s), i] = s
    best = e[0] + np.where(may_follow()[0], 0.0, FORBIDDEN)
    back = np.empty((longest, n, TAGS), np.int8)
    for t in range(1, longest):
        step = best[:, :, None] + a
        back[t] = step.argmax(axis=1)
        best = step.max(axis=1) + e[t]
        best -= best.max(axis=1, keepdims=True)  # only differences count; sums over long chains would lose them
    tags = np.empty((longest, n), np.int8)
    tags[-1] = best.argmax(axis=1)
    for t in range(longest - 1, 0, -1):
        tags[t - 1] = back[t][np.arange(n), tags[t]]
    return [tags[: len(s), i] for i, s in enumerate(scores)]


def runs(tags: np.ndarray, offset: int) -> list[tuple[str, int, int]]:
    out, at = [], 0
    while at < len(tags):
        t = int(tags[at])
        end = at + 1
        if t:
            k = (t - 1) // 2
            while end < len(tags) and tags[end] == 2 + 2 * k:
                end += 1
            out.append((TAGGED[k], offset + at, offset + end))
        at = end
    return out
