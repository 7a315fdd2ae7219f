"""Personal data: four base patterns, and a character BiLSTM-CRF that adds what they miss."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumenquarry.llm.common import bounded_batches, id_and_text, lean, slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind, end (exclusive), in code points

SLICE_BYTES = 2 << 20
#: Characters that any span of the four kinds holds one of; the model reads all text within REACH of one.
TRIGGER, REACH = re.compile("[0-9@]"), 24
WINDOW, STRIDE, HIDDEN = 48, 24, 16
#: Training: labelled windows, passes over them, windows in a step, seed; least mean probability of an added span.
EXAMPLES, PASSES, BATCH, SEED, SURE = 3000, 6, 100, 20, 0.9
#: Share of labelled numbers that have another value beside them.
BESIDE = 0.7

# base patterns

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _is_ip(text: str) -> bool:
    return all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in text.split("."))


def _is_card(text: str) -> bool:
    digits = "".join(_DIGITS.findall(text))
    return 14 <= len(digits) <= 19 and luhn(digits)


def base_spans(text: str) -> list[Span]:
    """Matches of the base patterns, leftmost and not overlapping within a kind, by start and kind.

    E-mail addresses are found from their @: the part before it is the run of allowed characters that
    ends there, from the last match on. It is the leftmost match, without a scan from every character.
    """
    out: list[Span] = []
    if "@" in text:
        end = 0
        for m in _AT.finditer(text):
            a = m.start()
            while a > end and text[a - 1] in _LOCAL:
                a -= 1
            if a < m.start():
                out.append((a, 0, m.end()))
                end = m.end()
    if _DIGITS.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _is_ip(m[0])]
        out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if _is_card(m[0])]
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.findall(m[0])) <= 15]
    return sorted(out)


# the model: tag 0 is outside, 1 + 2k begins kind k, 2 + 2k goes on in it

TAGS, CHARS = 1 + 2 * len(KINDS), 100


def codes(text: str) -> np.ndarray:
    """Printable ASCII by itself, other letters, other white space and the rest as one code each; 99 pads."""
    raw = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out = np.where((raw >= 32) & (raw < 127), raw - 32, 95)
    odd = np.flatnonzero(out == 95)
    if len(odd):
        out[odd] = [96 if (c := text[i]).isalpha() else 97 if c.isspace() else 95 for i in odd]
    return out.astype(np.int64)


def _example(rng: random.Random) -> tuple[str, list[Span]]:
    """A text and its spans: one, two beside each other, or something alike that is none."""
    letters, accents = "abcdefghijklmnopqrstuvwxyz", "äöüéèçñíó"
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda a=1, b=11: "".join(rng.choice(letters if rng.random() < 0.93 else accents) for _ in range(rng.randint(a, b)))
    ascii_ = lambda a=2, b=9: "".join(rng.choice(letters) for _ in range(rng.randint(a, b)))

    def value(kind: int) -> str:
        if kind == 0:
            local = ascii_() + rng.choice(["", ".", "_", "+"]) + rng.choice(["", ascii_(1, 5), digits(2)])
            local = local.rstrip("._+") or "a"
            gap = rng.choice(["", "", " "])
            core = f"{local}{gap}@{gap}{ascii_()}{rng.choice(['', digits(1)])}.{rng.choice(['com', 'org', 'net', 'example.com', 'co.uk'])}"
        elif kind == 1:
            core = rng.choice([".", ".", " . "]).join(str(rng.randint(0, 255)) for _ in range(4))
        elif kind == 2:
            parts = [digits(4) for _ in range(4)]
            core = rng.choice(["", " ", "-", ".", "/"]).join(parts)
        elif kind == 3:
            a, b, c = digits(3), digits(3), digits(4)
            core = rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{digits(2)} {digits(3)} {digits(7)}", f"({a}){b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}"])
        else:
            hexes = "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(8, 40)))
            core = rng.choice([f"password={hexes}", "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16)), f'"{hexes}"', f"version {digits(1)}.", f"{digits(1)}.{digits(1)}", digits(rng.randint(1, 8)), f"{digits(2)}.{digits(2)}.{digits(4)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{word()}{digits(3)}", f"@{word()}", f"{digits(2)}:{digits(2)}", f"{digits(3)},{digits(3)}.{digits(2)}", f"1.{digits(1)}.{digits(2)}", word()])
        return core

    kinds = [rng.choice([0, 1, 2, 3, 3, -1, -1, -1])]
    if kinds[0] > 0 and rng.random() < BESIDE:
        kinds.append(rng.choice([kinds[0], rng.randint(0, 3)]))
    text, spans = "", []
    while len(text) < rng.randint(0, 40):
        text += word() + rng.choice([" ", " ", " ", ", ", ". ", ".\n"])
    for i, kind in enumerate(kinds):
        text += rng.choice([" ", " ", ", ", "\n"]) if i else ""
        spans.append((len(text), kind, len(text) + len(core := value(kind))))
        text += core
    text += rng.choice(["", " ", ".", ", ", ".\n"])
    if text[-1] in " \n" or kinds[-1] != 2:
        while len(text) < WINDOW + 20:
            text += " " + word()
    return text, spans


def labelled(n: int = EXAMPLES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Windows of character codes and their tags, from labelled spans."""
    rng = random.Random(seed)
    x, y = np.full((n, WINDOW), CHARS - 1), np.zeros((n, WINDOW), np.int64)
    for i in range(n):
        text, spans = _example(rng)
        tags = np.zeros(len(text), np.int64)
        for start, kind, end in spans:
            if kind >= 0:
                tags[start] = 1 + 2 * kind
                tags[start + 1 : end] = 2 + 2 * kind
        start = rng.choice(spans)[0]
        a = rng.randint(max(0, start - WINDOW + 8), max(0, min(start, len(text) - WINDOW)) + 4)
        part = codes(text)[a : a + WINDOW]
        x[i, : len(part)] = part
        y[i, : len(part)] = tags[a : a + WINDOW]
    return x, y


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class BiLstmCrf:
    """Two LSTMs over a window, one in each direction, run side by side; emissions; transitions of a CRF."""

    def __init__(self, seed: int = SEED):
        g, h = np.random.default_rng(seed), HIDDEN
        self.p = {
            "wx": g.normal(0, 0.3, (2, CHARS, 4 * h)),
            "wh": g.normal(0, 1 / np.sqrt(h), (2, h, 4 * h)),
            "b": np.tile(np.r_[np.zeros(h), np.ones(h), np.zeros(2 * h)], (2, 1, 1)),
            "wo": g.normal(0, 0.3, (2 * h, TAGS)),
            "bo": np.zeros(TAGS),
            "tr": np.zeros((TAGS, TAGS)),
            "first": np.zeros(TAGS),
        }

    def _run(self, x: np.ndarray, keep: bool = False) -> tuple:
        """Hidden states (batch, time, 2h); keep: all that a backward pass needs."""
        n, steps = x.shape
        h = HIDDEN
        both = np.stack([x, x[:, ::-1]])
        state, cell = np.zeros((2, n, h)), np.zeros((2, n, h))
        out, kept = np.empty((2, n, steps, h)), []
        side = np.arange(2)[:, None]
        for t in range(steps):
            z = self.p["wx"][side, both[:, :, t]] + state @ self.p["wh"] + self.p["b"]
            i, f, o, g = _sigmoid(z[..., :h]), _sigmoid(z[..., h : 2 * h]), _sigmoid(z[..., 2 * h : 3 * h]), np.tanh(z[..., 3 * h :])
            new = f * cell + i * g
            th = np.tanh(new)
            if keep:
                kept.append((i, f, o, g, cell, th, state))
            cell, state = new, o * th
            out[:, :, t] = state
        return np.concatenate([out[0], out[1][:, ::-1]], 2), kept, both

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return self._run(x)[0] @ self.p["wo"] + self.p["bo"]

    def _chain(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log sums over the paths up to each tag and from it on, and over all paths."""
        n, steps, k = e.shape
        tr = self.p["tr"]
        alpha, beta = np.empty((steps, n, k)), np.zeros((steps, n, k))
        lse = lambda z, axis: (m := z.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(z - m).sum(axis))
        alpha[0] = self.p["first"] + e[:, 0]
        for t in range(1, steps):
            alpha[t] = lse(alpha[t - 1][:, :, None] + tr, 1) + e[:, t]
        for t in range(steps - 2, -1, -1):
            beta[t] = lse(tr + (e[:, t + 1] + beta[t + 1])[:, None, :], 2)
        return alpha, beta, lse(alpha[-1], 1)

    def marginals(self, e: np.ndarray) -> np.ndarray:
        """Probability of each tag at each place of each row, over all paths."""
        alpha, beta, z = self._chain(e)
        return np.exp(alpha + beta - z[None, :, None]).transpose(1, 0, 2)

    def _crf(self, e: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Mean negative log likelihood, and its gradients by emissions, transitions and first tags."""
        n, steps, k = e.shape
        tr = self.p["tr"]
        alpha, beta, z = self._chain(e)
        unary = np.exp(alpha + beta - z[None, :, None]).transpose(1, 0, 2)
        d_tr = np.zeros((k, k))
        for t in range(1, steps):
            d_tr += np.exp(alpha[t - 1][:, :, None] + tr + (e[:, t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
        rows = np.arange(n)
        gold = self.p["first"][y[:, 0]] + e[rows[:, None], np.arange(steps), y].sum(1) + tr[y[:, :-1], y[:, 1:]].sum(1)
        d_first = unary[:, 0].sum(0)
        np.subtract.at(d_tr, (y[:, :-1], y[:, 1:]), 1)
        np.subtract.at(d_first, y[:, 0], 1)
        unary[rows[:, None], np.arange(steps), y] -= 1
        return float((z - gold).mean()), unary / n, d_tr / n, d_first / n

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        h = HIDDEN
        hidden, kept, both = self._run(x, True)
        loss, d_e, d_tr, d_first = self._crf(hidden @ self.p["wo"] + self.p["bo"], y)
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["tr"], grads["first"], grads["bo"] = d_tr, d_first, d_e.sum((0, 1))
        grads["wo"] = hidden.reshape(-1, 2 * h).T @ d_e.reshape(-1, TAGS)
        d_hidden = d_e @ self.p["wo"].T
        d_out = np.stack([d_hidden[..., :h], d_hidden[:, ::-1, h:]])
        d_state, d_cell = np.zeros((2, len(x), h)), np.zeros((2, len(x), h))
        for t in range(x.shape[1] - 1, -1, -1):
            i, f, o, g, cell, th, state = kept[t]
            d_state = d_state + d_out[:, :, t]
            d_cell = d_cell + d_state * o * (1 - th * th)
            d_z = np.concatenate([d_cell * g * i * (1 - i), d_cell * cell * f * (1 - f), d_state * th * o * (1 - o), d_cell * i * (1 - g * g)], 2)
            for s in range(2):
                np.add.at(grads["wx"][s], both[s, :, t], d_z[s])
            grads["wh"] += state.transpose(0, 2, 1) @ d_z
            grads["b"] += d_z.sum(1, keepdims=True)
            d_state, d_cell = d_z @ self.p["wh"].transpose(0, 2, 1), d_cell * f
        return loss, grads

    def fit(self, x: np.ndarray, y: np.ndarray, passes: int = PASSES, rate: float = 0.02) -> BiLstmCrf:
        """Adam; the same windows give the same model."""
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        steps, order, t = passes * -(-len(x) // BATCH), np.random.default_rng(SEED), 0
        for _ in range(passes):
            turn = order.permutation(len(x))
            for a in range(0, len(x), BATCH):
                t += 1
                _, grads = self.gradients(x[turn[a : a + BATCH]], y[turn[a : a + BATCH]])
                size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                for k, g in grads.items():
                    g = g * min(1.0, 5 / (size + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] = self.p[k] - rate * (1 - t / steps) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
        return self

    def decode(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best tags of padded rows (batch, time, tags); a tag inside a kind only follows one of that kind."""
        n, steps, k = e.shape
        tr = self.p["tr"].copy()
        first = self.p["first"].copy()
        for c in range(len(KINDS)):
            bad = np.ones(k, bool)
            bad[[1 + 2 * c, 2 + 2 * c]] = False
            tr[bad, 2 + 2 * c] = -1e6
            first[2 + 2 * c] = -1e6
        back = np.zeros((steps, n, k), np.int8)
        score = first + e[:, 0]
        for t in range(1, steps):
            z = score[:, :, None] + tr
            back[t] = z.argmax(1)
            new = z.max(1) + e[:, t]
            live = (t < lengths)[:, None]
            back[t] = np.where(live, back[t], np.arange(k))
            score = np.where(live, new, score)
        tags = np.zeros((n, steps), np.int64)
        tags[:, -1] = score.argmax(1)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = back[t][np.arange(n), tags[:, t]]
        return tags


@lru_cache(maxsize=2)
def trained(examples: int = EXAMPLES, seed: int = SEED) -> BiLstmCrf:
    return BiLstmCrf(seed).fit(*labelled(examples, seed))


def regions(text: str) -> list[tuple[int, int]]:
    """Ranges of the text within REACH of a trigger; what lies outside holds no digit and no @."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _plausible(kind: int, text: str) -> bool:
    """What a span that the model proposes must be, whatever its format."""
    tight = re.sub(r"\s", "", text)
    if kind == 0:
        return re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", tight) is not None
    if kind == 1:
        return re.fullmatch(r"[0-9]+(\.[0-9]+){3}", tight) is not None and _is_ip(tight)
    if re.fullmatch(r"[0-9+().\s/-]+", text) is None:
        return False
    return _is_card(text) if kind == 2 else 10 <= len(_DIGITS.findall(text)) <= 15


_PARTS = {0: re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\s?@\s?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), 1: re.compile(r"(?<![0-9])[0-9]++(?:\s?\.\s?[0-9]++){3}")}
_INSIDE, _OF_NUMBERS = re.compile("[A-Za-z0-9_]"), frozenset("0123456789+()./- \t\r\n")
_NUMBER = re.compile(r"\+?\(?[0-9]+\)?")
#: A phone number that is cut out of more has a sign of one: + or ( first, no space inside, or groups of 3, 3 and 4.
_PHONE_PART = re.compile(r"[+(].*|\S+|(?:1\s)?[0-9]{3}\s[0-9]{3}\s[0-9]{4}", re.DOTALL)


def _parts(kind: int, text: str) -> list[tuple[int, int]]:
    """The longest plausible parts of a proposal, cut at separators: of all choices the one that covers most, in the fewest parts.

    Numbers are runs of digits with their + and brackets; those of one part are at most 3 characters
    apart. A part has at most 19 digits, so each number is tried with a bounded number of others.
    """
    if kind < 2:
        return [m.span() for m in _PARTS[kind].finditer(text) if _plausible(kind, m[0])]
    at = [m.span() for m in _NUMBER.finditer(text)]
    best: list[tuple[int, int, int]] = [(0, 0, 0)] * (len(at) + 1)  # from each number on: characters covered, minus parts, end of the part that begins here
    for i in range(len(at) - 1, -1, -1):
        best[i] = (*best[i + 1][:2], 0)
        digits = 0
        for j in range(i, len(at)):
            a, b = at[i][0], at[j][1]
            digits += len(_DIGITS.findall(text[at[j][0] : b]))
            if digits > 19 or (j > i and at[j][0] - at[j - 1][1] > 3):
                break
            if _plausible(kind, text[a:b]) and (kind == 2 or _PHONE_PART.fullmatch(text[a:b])):
                best[i] = max(best[i], (best[j + 1][0] + b - a, best[j + 1][1] - 1, j + 1))
    out, i = [], 0
    while i < len(at):
        if best[i][2]:
            out.append((at[i][0], at[best[i][2] - 1][1]))
        i = best[i][2] or i + 1
    return out


def _cut(kind: int, text: str, start: int, end: int, found: list[Span], low: int, high: int) -> list[tuple[int, int]]:
    """What is plausible of a proposal, free of base spans: all of it, or else parts of the numbers around it.

    A proposal often begins or ends inside a number where values are next to each other, so numbers are
    taken whole: it grows over digits and separators, by 2 * WINDOW and to low and high at most.
    """

    def alone(a: int, b: int) -> bool:
        return not (_INSIDE.match(text[a]) and a and _INSIDE.match(text[a - 1])) and not (b < len(text) and _INSIDE.match(text[b]))

    while end > start and text[end - 1] in " \t\n.,-/":
        end -= 1
    if end > start and all(end <= c or d <= start for c, _, d in found) and _plausible(kind, text[start:end]) and (kind == 0 or alone(start, end)):
        return [(start, end)]
    if kind:
        low, high = max(low, start - 2 * WINDOW), min(high, end + 2 * WINDOW)
        while start > low and text[start - 1] in _OF_NUMBERS:
            start -= 1
        while end < high and text[end] in _OF_NUMBERS:
            end += 1
    out = []
    for c, d in [*((a, b) for a, _, b in found if a < end and b > start), (end, end)]:
        if c > start:
            out += [(start + x, start + y) for x, y in _parts(kind, text[start:c]) if kind == 0 or alone(start + x, start + y)]
        start = max(start, d)
    return out


def model_spans(model: BiLstmCrf, texts: list[str], found: list[list[Span]]) -> list[list[Span]]:
    """Spans that the model adds to those found.

    Windows overlap by half. A character's emissions and marginals are the mean over its windows,
    weighted by the distance from the window's edge; each region is decoded once over its whole length.
    A proposal that is not plausible as a whole, or touches a base span, is cut into its plausible parts.
    """
    places = [(i, a, b) for i, t in enumerate(texts) for a, b in regions(t)]
    added: list[list[Span]] = [[] for _ in texts]
    if not places:
        return added
    parts = [codes(texts[i][a:b]) for i, a, b in places]
    starts = [list(range(0, max(1, len(p) - STRIDE), STRIDE)) for p in parts]
    owner = np.repeat(np.arange(len(parts)), [len(s) for s in starts])
    at = np.array([s for some in starts for s in some])
    windows = np.full((len(at), WINDOW), CHARS - 1)
    for w, (o, s) in enumerate(zip(owner.tolist(), at.tolist(), strict=True)):
        piece = parts[o][s : s + WINDOW]
        windows[w, : len(piece)] = piece
    weight = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(float)
    offset = np.r_[0, np.cumsum([len(p) + WINDOW for p in parts])]
    total, odds, mass = np.zeros((offset[-1], TAGS)), np.zeros((offset[-1], TAGS)), np.zeros(offset[-1])
    for a in range(0, len(at), 2048):
        e = model.emissions(windows[a : a + 2048])
        to = (offset[owner[a : a + 2048]] + at[a : a + 2048])[:, None] + np.arange(WINDOW)
        np.add.at(total, to, e * weight[:, None])
        np.add.at(odds, to, model.marginals(e) * weight[:, None])
        np.add.at(mass, to, np.broadcast_to(weight, to.shape))  # of a single row of weights, add.at reads past the end
    total /= np.maximum(mass, 1e-9)[:, None]
    odds /= np.maximum(mass, 1e-9)[:, None]
    lengths = np.array([len(p) for p in parts])
    order = np.argsort(lengths, kind="stable")
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and b - a < 512 and lengths[order[b]] <= lengths[order[a]] * 1.3 + 16:
            b += 1
        some = order[a:b]
        a = b
        width = int(lengths[some].max())
        e = np.zeros((len(some), width, TAGS))
        for r, p in enumerate(some):
            e[r, : lengths[p]] = total[offset[p] : offset[p] + lengths[p]]
        tags = model.decode(e, lengths[some])
        for r, p in enumerate(some):
            i, base, _ = places[p]
            row = tags[r, : lengths[p]]
            sure = 1 - odds[offset[p] : offset[p] + len(row), 0]  # of any kind: where values are next to each other the form tells which
            for s in np.flatnonzero(row % 2 == 1).tolist():
                kind, f = (int(row[s]) - 1) // 2, s + 1
                while f < len(row) and row[f] == 2 + 2 * kind:
                    f += 1
                for x, y in _cut(kind, texts[i], base + s, base + f, found[i], base, base + len(row)):
                    if sure[x - base : y - base].mean() >= SURE and all(y <= c or d <= x for c, _, d in added[i]):
                        added[i].append((x, kind, y))
    return added


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one, named after the first."""
    out, end = [], 0
    for a, k, b in sorted(spans):
        if a >= end:
            out += [text[end:a], f"<{KINDS[k]}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


@lean
def _found(batches: Iterator[pa.RecordBatch], model: BiLstmCrf, redacted: bool) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, SLICE_BYTES):
            texts = batch.column("text").to_pylist()
            base = [base_spans(t) for t in texts]
            spans = [b + m for b, m in zip(base, model_spans(model, texts, base), strict=True)]
            columns = [batch.column("doc_id"), *(pa.array([sum(k == c for _, k, _ in b) for b in base], pa.int64()) for c in range(len(KINDS)))]
            columns += [pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b in base]), pa.array([_joined(s) for s in spans], pa.string())]
            names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
            if redacted:
                columns.append(pa.array([redact(t, s) if s else t for t, s in zip(texts, spans, strict=True)], pa.string()))
                names.append("redacted")
            yield pa.RecordBatch.from_arrays(columns, names=names)


def find_pii(docs: DataFrame, redacted: bool = False, examples: int = EXAMPLES, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added); redacted adds the text without them.

    The model is trained on the driver, from `examples` labelled windows, and broadcast (under 200 KB).
    It reads every part of a text near a digit or @, in overlapping windows; elsewhere no kind can be.
    Base spans all stay; an added span overlaps none and is of a plausible form. Spans are in code
    points. Null text: empty, no spans. Null ids and repeated rows stay; an empty table gives an
    empty table; other columns are not read. No shuffle.
    """
    model = docs.sparkSession.sparkContext.broadcast(trained(examples, seed))
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string" + (", redacted string" if redacted else "")
    return id_and_text(docs, id_col, text_col).mapInArrow(lambda it: _found(it, model.value, redacted), schema)


@lean
def _rewritten(batches: Iterator[pa.RecordBatch], model: BiLstmCrf, text_col: str) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, SLICE_BYTES, text_col):
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            base = [base_spans(t) for t in texts]
            spans = [b + m for b, m in zip(base, model_spans(model, texts, base), strict=True)]
            clean = [redact(t, s) if s else was for t, s, was in zip(texts, spans, batch.column(text_col).to_pylist(), strict=True)]
            at = batch.schema.get_field_index(text_col)
            yield batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))


def redact_documents(docs: DataFrame, examples: int = EXAMPLES, seed: int = SEED, text_col: str = "text") -> DataFrame:
    """docs, with every span of `find_pii` replaced by its kind; other columns and null texts stay. Narrow: no shuffle.

    Null ids, repeated rows and columns of any name come through as they are; an empty table gives an
    empty table. Spans that overlap become one.
    """
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(trained(examples, seed))
    return docs.mapInArrow(lambda it: _rewritten(it, model.value, text_col), docs.schema)
