"""Operator 4: personal data by fixed patterns and a character-level bidirectional LSTM with a CRF.

The patterns give the base spans (email, ip, card, phone). A bidirectional LSTM over character
classes, trained in numpy from labelled spans that a seeded generator writes, scores each character's
labels; transitions forbid a span's inside without its begin. Windows overlap by half, and a character's scores
come from the window in whose middle it lies best. The joined scores of the whole text are then decoded at once,
so neighbouring windows can't contradict each other.

An email lies in a run without white space that holds an at sign, and the other kinds in a run without letters that
holds a digit. Outside these runs, of whatever length, "outside" is the only label allowed; so the chain falls
apart exactly at their ends, each run is decoded on its own, and windows without one need not be computed.

Spans of the model are added where no base span overlaps and the span can be of its kind (card: 16 to
19 digits with a valid checksum, phone: 8 to 15 digits, ip: four parts up to 255, email: a name, an at
sign and a dotted domain). Offsets are code points, ends exclusive. Null and empty texts have no
spans; texts of any length are read whole. Equal rows get equal spans, an empty table gives an empty one. ``find`` replaces columns
of df named as those it adds; all others pass through.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, table

KINDS = ("email", "ip", "card", "phone")

# --- base patterns -------------------------------------------------------------------------------

NAME = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a failed run of digits fails from each of its digits
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and NAME.match(text, start - 1):
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return found


def is_ip(text: str) -> bool:
    parts = text.split(".")
    return len(parts) == 4 and all(p and len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts if p.isascii() and p.isdigit()) and all(p.isascii() and p.isdigit() for p in parts)


def is_card(text: str) -> bool:
    d = _digits(text)
    return 16 <= len(d) <= 19 and luhn(d)


def is_phone(text: str) -> bool:
    return 8 <= len(_digits(text)) <= 15


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind, by kind and then start; failing matches are dropped."""
    if not text:
        return []
    found = [("email", a, b) for a, b in _emails(text)]
    if DIGIT.search(text):
        for kind, pattern, fine in (("ip", IP, is_ip), ("card", CARD, is_card), ("phone", PHONE, is_phone)):
            found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if fine(m[0])]
    return found


# --- the network ---------------------------------------------------------------------------------

SYMBOLS = "@.-+()_% \n:/=\"',;#"
#: Classes: padding, other, lower, upper, other letter, space-like, ten digits, then SYMBOLS.
N_CLASSES = 16 + len(SYMBOLS)
ASCII = np.ones(128, np.uint8)
ASCII[97:123], ASCII[65:91] = 2, 3
ASCII[9:14] = 5
ASCII[48:58] = np.arange(6, 16)
for _i, _c in enumerate(SYMBOLS):
    ASCII[ord(_c)] = 16 + _i
LABELS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
WIDTH, STRIDE = 64, 32
FORBIDDEN = -1e4


def classes_of(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where(codes < 128, ASCII[np.minimum(codes, 127)], np.where(codes < 0xC0, 1, 4)).astype(np.uint8)


def _transitions() -> np.ndarray:
    """0 where a label may follow another, else FORBIDDEN."""
    out = np.zeros((LABELS, LABELS), np.float32)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        out[:, inside] = FORBIDDEN
        out[[inside - 1, inside], inside] = 0
    return out


ALLOWED = _transitions()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    """Weights: embedding, one LSTM each way, output layer, label transitions."""

    def __init__(self, hidden: int = 16, embed: int = 10, seed: int = 3):
        r = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {"e": r.normal(0, 0.3, (N_CLASSES, embed)), "out": r.normal(0, 0.2, (2 * hidden, LABELS)), "bias": np.zeros(LABELS), "change": np.zeros((LABELS, LABELS))}
        for way in "fb":
            self.p[f"w{way}"] = r.normal(0, 0.25, (embed + hidden, 4 * hidden))
            self.p[f"b{way}"] = np.concatenate((np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _run(self, x: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (steps, rows, hidden) over embedded x (steps, rows, embed), in x's order of steps."""
        n, rows, h = x.shape[0], x.shape[1], self.hidden
        wx, wh, b = self.p[f"w{way}"][: x.shape[2]], self.p[f"w{way}"][x.shape[2] :], self.p[f"b{way}"]
        ready = x @ wx + b
        out = np.zeros((n, rows, h), np.float32)
        state, cell = np.zeros((rows, h), np.float32), np.zeros((rows, h), np.float32)
        for t in range(n) if way == "f" else range(n - 1, -1, -1):
            z = ready[t] + state @ wh
            gates = _sigmoid(z[:, : 3 * h])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            g = np.tanh(z[:, 3 * h :])
            before, cell = cell, f * cell + i * g
            squashed = np.tanh(cell)
            if keep is not None:
                keep.append((t, state, before, i, f, o, g, squashed))
            state = o * squashed
            out[t] = state
        return out

    def scores(self, classes: np.ndarray) -> np.ndarray:
        """Label scores (rows, width, LABELS) of windows of classes; padding scores as outside only."""
        x = self.p["e"][classes.T]
        both = np.concatenate((self._run(x, "f"), self._run(x, "b")), axis=2)
        return (both @ self.p["out"] + self.p["bias"]).transpose(1, 0, 2)

    def gradients(self, classes: np.ndarray, gold: np.ndarray, near: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of gold labels (rows, width) and its gradients."""
        p, h, rows, width = self.p, self.hidden, *classes.shape
        x = p["e"][classes.T]
        kept = {"f": [], "b": []}
        both = np.concatenate((self._run(x, "f", kept["f"]), self._run(x, "b", kept["b"])), axis=2)
        e = (both @ p["out"] + p["bias"]).astype(np.float64)  # steps, rows, labels
        e[:, :, 1:] += np.where(near.T, 0, FORBIDDEN)[:, :, None]
        a = (p["change"] + ALLOWED).astype(np.float64)
        first = np.where(np.arange(LABELS) % 2 + (np.arange(LABELS) == 0) > 0, 0, FORBIDDEN)

        def lse(v, axis):
            m = v.max(axis=axis, keepdims=True)
            return (m + np.log(np.exp(v - m).sum(axis=axis, keepdims=True))).squeeze(axis)

        ahead, behind = np.zeros_like(e), np.zeros_like(e)
        ahead[0] = e[0] + first
        for t in range(1, width):
            ahead[t] = e[t] + lse(ahead[t - 1][:, :, None] + a, 1)
        for t in range(width - 2, -1, -1):
            behind[t] = lse(a[None] + (e[t + 1] + behind[t + 1])[:, None, :], 2)
        total = lse(ahead[-1], 1)
        marginal = np.exp(ahead + behind - total[None, :, None])
        steps, at = np.arange(width)[:, None], np.arange(rows)[None, :]
        y = gold.T
        gold_score = e[steps, at, y].sum(0) + a[y[:-1], y[1:]].sum(0)
        loss = float((total - gold_score).mean())
        d = marginal.copy()
        d[steps, at, y] -= 1
        d /= rows
        change = np.zeros((LABELS, LABELS))
        for t in range(1, width):
            pair = ahead[t - 1][:, :, None] + a + (e[t] + behind[t])[:, None, :] - total[:, None, None]
            change += np.exp(pair).sum(0)
        np.add.at(change, (y[:-1].ravel(), y[1:].ravel()), -1)
        d = d.astype(np.float32)
        grad = {"out": both.reshape(-1, 2 * h).T @ d.reshape(-1, LABELS), "bias": d.sum((0, 1)), "change": (change / rows).astype(np.float32)}
        d_both = d @ p["out"].T
        d_x = np.zeros_like(x)
        for way, part in (("f", d_both[:, :, :h]), ("b", d_both[:, :, h:])):
            w = p[f"w{way}"]
            wh = w[x.shape[2] :]
            d_state, d_cell = np.zeros((rows, h), np.float32), np.zeros((rows, h), np.float32)
            d_z = np.zeros((width, rows, 4 * h), np.float32)
            states = np.zeros((width, rows, h), np.float32)
            for t, state, before, i, f, o, g, squashed in reversed(kept[way]):
                dh = part[t] + d_state
                dc = d_cell + dh * o * (1 - squashed**2)
                d_z[t] = np.concatenate((dc * g * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g**2)), axis=1)
                d_cell, d_state = dc * f, d_z[t] @ wh.T
                states[t] = state
            inputs = np.concatenate((x, states), axis=2).reshape(-1, w.shape[0])
            grad[f"w{way}"] = inputs.T @ d_z.reshape(-1, 4 * h)
            grad[f"b{way}"] = d_z.sum((0, 1))
            d_x += d_z @ w[: x.shape[2]].T
        grad["e"] = np.zeros_like(p["e"])
        np.add.at(grad["e"], classes.T.ravel(), d_x.reshape(-1, x.shape[2]))
        return loss, grad

    def decode(self, runs: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi labels of runs of scores (length, LABELS), of any lengths, each between outside labels."""
        a = self.p["change"] + ALLOWED
        order = sorted(range(len(runs)), key=lambda i: -len(runs[i]))
        found: list[np.ndarray] = [np.empty(0, np.int8)] * len(runs)
        for at in range(0, len(order), 2048):  # runs of like length together
            some = [runs[i] for i in order[at : at + 2048]]
            sizes = np.array([len(x) for x in some])
            active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")  # how many runs have a t-th character
            s = np.array([x[0] for x in some]) + a[0]
            final, back = s.copy(), []
            for t in range(1, sizes[0]):
                n = active[t]
                ways = s[:n, :, None] + a
                back.append(ways.argmax(axis=1).astype(np.int8))
                s = ways.max(axis=1) + np.array([x[t] for x in some[:n]])
                final[:n] = s
            last = (final + a[:, 0]).argmax(axis=1)
            labels = [np.zeros(n, np.int8) for n in sizes]
            for i, n in enumerate(sizes):
                labels[i][n - 1] = last[i]
                for t in range(n - 1, 0, -1):
                    labels[i][t - 1] = back[t - 1][i, labels[i][t]]
            for i, y in zip(order[at : at + 2048], labels):
                found[i] = y
        return found


def _runs(edges: np.ndarray, hits: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs between ``edges`` (ascending places) that hold one of ``hits``."""
    k = np.unique(np.searchsorted(edges, hits))
    bounds = np.concatenate(([-1], edges, [n]))
    return bounds[k] + 1, bounds[k + 1]


def possible(text: str, classes: np.ndarray) -> np.ndarray:
    """Where a span may lie: runs without white space around an at sign, and runs without letters around a digit."""
    letter = (classes == 2) | (classes == 3)
    high = np.flatnonzero((classes == 4) | (classes == 1))
    if len(high):
        is_letter = {c: c.isalpha() for c in set(text) if c > "\x7f"}
        if any(is_letter.values()):
            letter[high] = [is_letter.get(text[i], False) for i in high.tolist()]
    space = (classes == 5) | (classes == 16 + SYMBOLS.index(" ")) | (classes == 16 + SYMBOLS.index("\n"))
    edge = np.zeros(len(classes) + 1, np.int32)
    for edges, hits in ((space, classes == 16), (letter, (classes >= 6) & (classes <= 15))):
        starts, ends = _runs(np.flatnonzero(edges), np.flatnonzero(hits), len(classes))
        np.add.at(edge, starts, 1)
        np.add.at(edge, ends, -1)
    return np.cumsum(edge)[:-1] > 0


# --- labelled spans ------------------------------------------------------------------------------


class SpanMaker:
    """Seeded texts with labelled personal data among words, numbers, keys and versions."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        r = self.r
        w = "".join(r.choice(("an", "re", "tio", "el", "ou", "str", "de", "ñ", "ß", "é", "que", "th", "en")) for _ in range(r.randint(1, 4)))
        return r.choice((w, w, w, w.capitalize(), w.upper() if r.random() < 0.1 else w)) + r.choice(("", "", "", "", ",", "."))

    def some(self, letters: str, low: int, high: int) -> str:
        return "".join(self.r.choice(letters) for _ in range(self.r.randint(low, high)))

    def item(self) -> tuple[str, str]:
        r, lower, digits = self.r, "abcdefghijklmnopqrstuvwxyz", "0123456789"
        kind = r.choice(KINDS)
        if kind == "email":
            name = self.some(lower, 2, 8) + r.choice(("", ".", "_", "-", "+")) + self.some(lower + digits, 1, 5)
            return kind, f"{name}@{self.some(lower + digits, 2, 8)}." + r.choice(("example.com", "com", "org", "co.uk", "net"))
        if kind == "ip":
            return kind, ".".join(str(r.randint(0, 255)) for _ in range(4))
        if kind == "card":
            d = self.some(digits, 16, 16) if r.random() < 0.85 else self.some(digits, 16, 19)
            gap = r.choice(("", "", "", " ", "-"))
            return kind, gap.join(d[i : i + 4] for i in range(0, len(d), 4))
        area, a, b = self.some(digits, 3, 3), self.some(digits, 3, 3), self.some(digits, 4, 4)
        country = "+" + str(r.randint(1, 99))
        return kind, r.choice((f"{country} ({area}) {a}-{b}", f"{country} ({area}) {a}-{b}", f"{country} ({area}) {a}-{b}", f"{country}-{area}-{a}-{b}", f"{country} {area} {a} {b}", f"{country}{area}{a}{b}", f"({area}) {a}-{b}", f"{country}.{area}.{a}.{b}"))

    def other(self) -> str:
        r, digits, hexa = self.r, "0123456789", "0123456789abcdef"
        year = r.randint(1900, 2030)
        return r.choice((
            f"{r.randint(1, 9)}.{r.randint(0, 9)}.", f"version {r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 20)}", str(year), f"{year}-{r.randint(1, 12):02}-{r.randint(1, 28):02}",
            f"{r.randint(0, 23)}:{r.randint(0, 59):02}", f"{r.randint(1, 9999)}.{r.randint(0, 99):02}", self.some(digits, 1, 13), "AKIA" + self.some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16, 16),
            "password=" + self.some(hexa, 18, 18), f'token = "{self.some(hexa, 40, 40)}"', f"#{self.some(digits, 1, 6)}", f"@{self.some('abcdefgh', 3, 8)}", f"{self.some(digits, 2, 4)}{self.some('abc', 1, 3)}", f"({r.randint(1, 20)})", f"{r.randint(1, 300)}-{r.randint(1, 300)}",
        ))

    def text(self) -> tuple[str, np.ndarray]:
        r, parts, labels = self.r, [], []

        def put(piece: str, kind: str | None = None) -> None:
            k = KINDS.index(kind) if kind else -1
            labels.extend([0] * len(piece) if k < 0 else [1 + 2 * k] + [2 + 2 * k] * (len(piece) - 1))
            parts.append(piece)

        while len(labels) < 3 * WIDTH:
            chance = r.random()
            if chance < 0.45:
                for _ in range(r.choice((1, 1, 2, 4))):
                    kind, piece = self.item()
                    put(piece, kind)
                    put(r.choice((" ", " ", " ", " ", ", ", ". ", "\n", "; ")))
            elif chance < 0.65:
                put(self.other() + " ")
            for _ in range(r.randint(0, 7)):
                put(self.word() + r.choice((" ", " ", " ", " ", "\n")))
        return "".join(parts), np.array(labels, np.int8)


def train(n_texts: int = 1200, steps: int = 200, rows: int = 96, rate: float = 0.02, seed: int = 11) -> Network:
    """A network trained by Adam on windows of generated texts; the bound of the sample is n_texts."""
    maker, r, net = SpanMaker(seed), np.random.default_rng(seed), Network()
    windows, golds, nears = [], [], []
    for _ in range(n_texts):
        text, labels = maker.text()
        classes = classes_of(text)
        near = possible(text, classes)
        # a window's first label may not be an inside, so training windows begin at outside or begin labels
        for at in (0, WIDTH, 2 * WIDTH):
            while at and labels[at] and labels[at] % 2 == 0:
                at -= 1
            if at + WIDTH <= len(classes):
                windows.append(classes[at : at + WIDTH])
                golds.append(labels[at : at + WIDTH])
                nears.append(near[at : at + WIDTH])
    windows, golds, nears = np.array(windows), np.array(golds).astype(np.int64), np.array(nears)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    for step in range(1, steps + 1):
        some = r.choice(len(windows), rows, replace=False)
        _, grad = net.gradients(windows[some], golds[some], nears[some])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        now = rate * min(1.0, 2.0 * (1 - step / (steps + 1)) + 0.02)
        for k, g in grad.items():
            g = g * min(1.0, 5.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            v2[k] = 0.99 * v2[k] + 0.01 * g * g
            net.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


# --- whole texts ---------------------------------------------------------------------------------


def labels_of(net: Network, texts: list[str | None], rows: int = 1024) -> list[np.ndarray | None]:
    """Labels of every character of each text (None: all outside); windows and runs of many texts are batched."""
    out: list[np.ndarray | None] = [None] * len(texts)
    jobs: list[tuple[int, int]] = []
    ready: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    lo, hi = (WIDTH - STRIDE) // 2, (WIDTH + STRIDE) // 2

    def flush() -> None:
        for at in range(0, len(jobs), rows):
            some = jobs[at : at + rows]
            scores = net.scores(np.stack([ready[i][0][k : k + WIDTH] for i, k in some]))
            for (i, k), row in zip(some, scores):
                ready[i][2][k + lo : k + hi] = row[lo:hi]  # a window answers for its middle
        jobs.clear()
        where, runs = [], []
        for i, (_, may, scores) in ready.items():
            edge = np.flatnonzero(np.diff(may.astype(np.int8), prepend=0, append=0))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                where.append((i, a, b))
                runs.append(scores[a:b])
            out[i] = np.zeros(len(texts[i]), np.int8)
        for (i, a, b), y in zip(where, net.decode(runs)):
            out[i][a - WIDTH : b - WIDTH] = y
        ready.clear()

    for i, text in enumerate(texts):
        if not text or not ("@" in text or DIGIT.search(text)):
            continue
        own = classes_of(text)
        classes = np.concatenate((np.zeros(WIDTH, np.uint8), own, np.zeros(2 * WIDTH, np.uint8)))
        may = np.zeros(len(classes), bool)
        may[WIDTH : WIDTH + len(own)] = possible(text, own)
        ready[i] = (classes, may, np.zeros((len(classes), LABELS), np.float32))
        whole = len(may) // STRIDE * STRIDE
        # stretch k is the middle of the window that begins half a stride before it
        jobs += [(i, int(k) * STRIDE - lo) for k in np.flatnonzero(may[:whole].reshape(-1, STRIDE).any(axis=1))]
        if len(jobs) >= rows:
            flush()
    flush()
    return out


def model_spans(text: str, labels: np.ndarray) -> list[tuple[str, int, int]]:
    """Spans in a text's labels that can be of their kind; blanks and stops at the ends are trimmed."""
    found, n = [], len(labels)
    begins = np.flatnonzero(labels)
    done = -1
    for at in begins:
        if at <= done:
            continue
        k, end = (int(labels[at]) - 1) // 2, int(at) + 1
        while end < n and labels[end] == 2 + 2 * k:
            end += 1
        done = end - 1
        start = int(at)
        while start < end and text[start] in " \n\t,;.":
            start += 1
        while end > start and text[end - 1] in " \n\t,;.(":
            end -= 1
        piece, kind = text[start:end], KINDS[k]
        if kind == "email":
            name, _, domain = piece.partition("@")
            fine = bool(name) and "." in domain.strip(".") and not any(c.isspace() for c in piece) and "@" not in domain
        else:
            fine = {"ip": is_ip, "card": is_card, "phone": is_phone}[kind](piece)
            if kind in ("card", "phone"):
                fine = fine and not any(c.isalpha() for c in piece)
            # digits that go on beyond the span make it a part of something else
            fine = fine and not (start and text[start - 1].isalnum()) and not (end < n and text[end].isalnum())
        if fine:
            found.append((kind, start, end))
    return found


def all_spans(text: str, base: list[tuple[str, int, int]], labels: np.ndarray | None) -> list[tuple[str, int, int]]:
    """Base spans and those of the model that overlap none of them, by kind and then start."""
    if labels is None:
        return base
    added = [s for s in model_spans(text, labels) if all(s[2] <= a or b <= s[1] for _, a, b in base)]
    return sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1]))


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by <KIND>; of overlapping spans the first decides."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        elif b > at:
            a = at
        at = max(at, b)
    return "".join([*out, text[at:]])


def spelled(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_TRAINED: dict[tuple, Network] = {}


def trained() -> Network:
    """The network trained with the default parameters; made once per process."""
    if () not in _TRAINED:
        _TRAINED[()] = train()
    return _TRAINED[()]


def find(df: DataFrame, net: Network, text: str = "text", mask: bool = False) -> DataFrame:
    """df with n_email, n_ip, n_card, n_phone (base), base_spans and spans; mask: the text is masked too."""
    names = [f"n_{k}" for k in KINDS] + ["base_spans", "spans"]
    kept = [f for f in df.schema.fields if f.name not in names]
    weights = net.p  # some ten thousand numbers, sent with the function
    place = [f.name for f in kept].index(text)

    def run(batches):
        mine = Network()
        mine.p = weights
        for batch in batches:
            texts = batch.column(place).to_pylist()
            base = [base_spans(t) for t in texts]
            spans = [all_spans(t, b, y) for t, b, y in zip(texts, base, labels_of(mine, texts))]
            columns = list(batch.columns)
            if mask:
                columns[place] = pa.array([masked(t, s) if s else t for t, s in zip(texts, spans)], pa.string())
            counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([*columns, *counts, pa.array(map(spelled, base)), pa.array(map(spelled, spans))], [*[f.name for f in kept], *names])

    small_batches(df.sparkSession)
    added = [T.StructField(n, T.LongType()) for n in names[:4]] + [T.StructField(n, T.StringType()) for n in names[4:]]
    return df.select(*[f.name for f in kept]).mapInArrow(run, T.StructType([*kept, *added]))


def op4_pii(spark, sf_dir):
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), trained())
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(F.col("base_spans"), 256).alias("base_sha256"), "spans")


QUERIES = {"op4_pii": op4_pii}
