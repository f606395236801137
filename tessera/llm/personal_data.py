"""Personal data by rules and by a character-level bidirectional LSTM with CRF transitions.

*Base.* Four patterns (email, ip, card, phone) with their checks; leftmost, non-overlapping per kind.

*Model.* Characters are embedded, read by an LSTM in each direction, and given a score for each label (outside, and begin
and inside of each kind); a linear-chain CRF adds transition scores. Gates are clipped lines and cells soft signs, which
need no exponentials. It is trained here, in numpy, from labelled spans: back-propagation through time under the CRF's
likelihood, with Adam. The labelled texts are made by a seeded generator (``examples``: N_EXAMPLES texts, a documented
bound) in more notations than the patterns know (addresses with spaces or spelled out, numbers in groups or without a plus
sign, card numbers that fail their check), amid numbers, versions, dates and handles that are no personal data. The model
has one kind more than the patterns: secrets (keys, tokens, passwords).

*Decoding.* Whole texts are cut into overlapping windows; each character takes its label from the window that holds it
most centrally. A window whose best path is outside throughout is found out by an upper bound (``Tagger.quiet``), which
keeps no paths; the others are decoded by
Viterbi's algorithm, and spans are read off the reconciled labels. A span is added if it is whole (its ends cut no word),
has the shape of its kind in some notation (SHAPE; not the patterns' checks) and overlaps no base span.

Places are code points, ends exclusive. Defined results: null text is the empty text, without spans; every row gives
one row, repeated rows and null doc_ids too; a text of any length is read whole; columns other than doc_id and the text are
left out, so none can clash; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_lists

KINDS = ("email", "ip", "card", "phone")
#: What the model tells apart; kinds after KINDS have no pattern.
TAGS = (*KINDS, "secret")
#: What an added span must hold, in any notation: an address its at and dot, numbers their digits, a secret a long run with digits.
SHAPE = {
    "email": re.compile(r"(?is)^(?=.*(?:@|\bat\b)).*\w(?:\.|\bdot\b|\[dot\])"), "ip": re.compile(r"(?s)^\d{1,3}(?:\D{1,6}\d{1,3}){3}$"), "card": re.compile(r"(?s)^(?:\d[ .-]?){13,19}$"),
    "phone": re.compile(r"(?s)^[+(]*(?:\d[ ().-]*){7,15}$"), "secret": re.compile(r"(?s)^(?=.*\d).*[A-Za-z0-9_-]{10}"),
}
#: Patterns of the contract. The address is found from its @ outwards, which gives the same matches in linear time.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile("[0-9@]")
WINDOW, STRIDE = 256, 224
N_EXAMPLES, LENGTH, STEPS, BATCH = 4000, 80, 700, 64
EMBED, HIDDEN, LABELS = 8, 12, 1 + 2 * len(TAGS)
#: Characters with an embedding of their own; letters beyond ASCII share one, everything else another.
OWN = {chr(c): i for i, c in enumerate(range(32, 127))} | {"\n": 95}
CHARS = len(OWN) + 2

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def valid(kind: str, text: str) -> bool:
    """A match's check."""
    digits = _digits(text)
    if kind == "ip":
        parts = text.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and int(p[-6:]) <= 255 and len(p.lstrip("0")) <= 3 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    local, _, domain = text.partition("@")
    return bool(local.strip()) and bool(DOMAIN.fullmatch(domain.strip())) and "@" not in domain


def base_spans(text: str) -> list[Span]:
    """The patterns' matches that pass their checks, by kind, then start."""
    out: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > last and text[lo - 1] in LOCAL:
            lo -= 1
        end = DOMAIN.match(text, at + 1) if lo < at else None
        if end:
            out.append(("email", lo, end.end()))
            last = end.end()
        at = text.find("@", max(at + 1, last))
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(kind, m[0])]
    return out


def examples(n: int = N_EXAMPLES, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Made-up texts of about two LENGTHs of characters with their labelled spans."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    number = lambda k: "".join(str(int(d)) for d in rng.integers(0, 10, k))
    letters = lambda lo, hi: "".join(pick("abcdefghijklmnopqrstuvwxyz") for _ in range(int(rng.integers(lo, hi))))
    signs = lambda of, lo, hi: "".join(pick(of) for _ in range(int(rng.integers(lo, hi))))
    hexes, capitals = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    syllables = ["th", "er", "on", "an", "tion", "ing", "ed", "ou", "ea", "st", "sh", "é", "qu", "eau", "ch", "ung", "ä", "ó", "ci", "la", "re", "ment", "ble", "ß"]

    def card() -> str:
        head = pick("3456") + number(int(pick([14, 14, 14, 13, 12])))
        d = next(head + c for c in "0123456789" if luhn(head + c)) if rng.random() < 0.8 else head + number(1)
        sep = pick(["", "", " ", "-", "."])
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    def email() -> str:
        local = (letters(2, 8) + pick(["", ".", "_", "-", ""]) + pick(["", number(2), letters(2, 6)])).strip("._-")
        host, end = letters(3, 8) + pick(["", number(1)]), pick(["com", "org", "example.com", "net", "co.uk", "de"])
        if rng.random() < 0.25:
            at, dot = pick([(" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" AT ", " DOT ")])
            return local.replace(".", dot) + at + host + dot + end.replace(".", dot)
        return local + pick(["@", "@", "@", " @ ", " @"]) + host + "." + end

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return pick([f"+{pick('123456789')} ({a}) {b}-{c}", f"+{pick('123456789')}{number(1)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{number(11)}", f"00{pick('123456789')}{number(1)} {a} {b} {c}"])

    def secret() -> str:
        name = pick(["token", "password", "secret", "api_key", "key", "passwd", "auth"])
        return pick([lambda: f'{name} = "{signs(hexes, 24, 42)}"', lambda: f"{name}={signs(hexes, 12, 33)}", lambda: f"{name}: {signs(capitals + hexes, 16, 33)}", lambda: "AKIA" + signs(capitals, 16, 17), lambda: pick(["ghp_", "sk-"]) + signs(capitals + hexes, 24, 37)])()

    def ip() -> str:
        sep = pick([".", ".", ".", ".", " . ", "[.]"])
        return sep.join(str(int(x)) for x in rng.integers(0, 256, 4))

    make = {"email": email, "ip": ip, "card": card, "phone": phone, "secret": secret}
    plain = [
        lambda: str(int(rng.integers(1900, 2030))), lambda: f"{rng.integers(0, 9)}.{rng.integers(0, 9)}", lambda: f"v{rng.integers(0, 20)}.{rng.integers(0, 20)}.{rng.integers(0, 20)}", lambda: number(int(rng.integers(1, 8))),
        lambda: "@" + letters(3, 9), lambda: f"{number(2)},{number(3)}.{number(2)}", lambda: f"{number(4)}-{number(2)}-{number(2)}", lambda: f"{number(2)}:{number(2)}", lambda: letters(2, 5) + number(2),
        lambda: pick(["token", "password", "key", "secret", "at", "dot", "the token of", "a key to", "=", "x = y", "at home", "dot com"]), lambda: f'"{letters(3, 9)}"', lambda: pick(["|", "---", "***", "a)", "{", "}", "[1]", "(2)", "<b>", "</p>", "&amp;", "//", "CC BY-NC 4.0.", "MIT", "2.0,", "(c) 2019", "50%", "$12.50"]),
    ]
    out = []
    for _ in range(n):
        parts, spans, size = [], [], 0
        junk = pick([[""], [""], [""], ["***", "%%%", "&&&", "$$$", "###"], ["!!"]])
        shout, busy = rng.random() < 0.1, rng.random() < 0.6
        while size < 2 * LENGTH:
            kind = pick(TAGS) if busy and rng.random() < 0.09 else None
            word = make[kind]() if kind else pick(plain)() if rng.random() < 0.12 else pick([letters(1, 9), "".join(pick(syllables) for _ in range(int(rng.integers(1, 5)))), pick(["the", "of", "and", "la", "der", "The", "Von", "été", "año", "über"])])
            if kind:
                spans.append((kind, size, size + len(word)))
            elif shout:
                word = word.upper()
            word += pick(junk) + pick([" ", " ", " ", " ", ", ", ". ", ".\n"])
            parts.append(word)
            size += len(word)
        out.append(("".join(parts), spans))
    return out


@functools.cache
def _classes() -> np.ndarray:
    """Embedding of each character of the basic plane; others are as those that are neither listed nor letters."""
    return np.array([OWN.get(chr(c), CHARS - 2 if chr(c).isalpha() else CHARS - 1) for c in range(1 << 16)], np.uint8)


def char_ids(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(codes < 1 << 16, _classes()[np.minimum(codes, 0xFFFF)], CHARS - 1)


def label_ids(n: int, spans: list[Span]) -> np.ndarray:
    y = np.zeros(n, np.int64)
    for kind, a, z in spans:
        k = 1 + 2 * TAGS.index(kind)
        y[a] = k
        y[a + 1 : z] = k + 1
    return y


def _soft(x: np.ndarray) -> np.ndarray:
    return x / (1.0 + np.abs(x))


class Tagger:
    """The network. Arrays are (feature, batch) at each time, so that every gate is one block of memory."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        w = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-1])).astype(np.float32)
        self.p = {"E": w(EMBED, CHARS) * 8, "O": w(LABELS, 2 * HIDDEN), "o": np.zeros((LABELS, 1), np.float32), "T": np.zeros((LABELS, LABELS), np.float32), "S": np.zeros(LABELS, np.float32)}
        for way in "fb":
            # Rows: input, forget and output gate, cell; columns: embedding, state before, one.
            self.p["W" + way] = np.concatenate([w(4 * HIDDEN, EMBED + HIDDEN) * np.repeat([0.5, 0.5, 0.5, 1.0], HIDDEN)[:, None], np.repeat([0.5, 0.8, 0.5, 0.0], HIDDEN)[:, None]], 1).astype(np.float32)
        # Inside follows begin or inside of its own kind only.
        self.never = np.zeros((LABELS, LABELS), np.float32)
        for k in range(len(TAGS)):
            inside = 2 + 2 * k
            self.never[:, inside] = -1e4
            self.never[inside - 1 : inside + 1, inside] = 0.0

    def _lstm(self, x: np.ndarray, w: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (time, HIDDEN, batch) of inputs (time, EMBED, batch)."""
        n, _, batch = x.shape
        out = np.empty((n, HIDDEN, batch), x.dtype)
        z, g, c = np.zeros((EMBED + HIDDEN + 1, batch), x.dtype), np.empty((4 * HIDDEN, batch), x.dtype), np.zeros((HIDDEN, batch), x.dtype)
        z[-1] = 1.0
        gates, u, i, f, o = g[: 3 * HIDDEN], g[3 * HIDDEN :], g[:HIDDEN], g[HIDDEN : 2 * HIDDEN], g[2 * HIDDEN : 3 * HIDDEN]
        size = np.empty_like(c)
        for t in range(n):
            z[:EMBED] = x[t]
            np.dot(w, z, out=g)
            if keep is not None:
                keep.append((z.copy(), g.copy(), c.copy()))
            np.clip(gates, 0.0, 1.0, out=gates)
            np.abs(u, out=size)
            size += 1.0
            u /= size
            u *= i
            c *= f
            c += u
            np.abs(c, out=size)
            size += 1.0
            np.divide(c, size, out=out[t])
            out[t] *= o
            z[EMBED:-1] = out[t]
        return out

    def _lstm_back(self, d: np.ndarray, keep: list, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dw, dx = np.zeros_like(w), np.empty((len(d), EMBED, d.shape[2]), d.dtype)
        dh = dc = np.zeros(d.shape[1:], d.dtype)
        for t in range(len(d) - 1, -1, -1):
            z, g, before = keep[t]
            i, f, o = (np.clip(g[k * HIDDEN : (k + 1) * HIDDEN], 0, 1) for k in range(3))
            u = _soft(g[3 * HIDDEN :])
            c = f * before + i * u
            dh = dh + d[t]
            dc = dc + dh * o / (1 + np.abs(c)) ** 2
            dg = np.concatenate([dc * u, dc * before, dh * _soft(c), dc * i / (1 + np.abs(g[3 * HIDDEN :])) ** 2])
            dg[: 3 * HIDDEN] *= (g[: 3 * HIDDEN] >= 0) & (g[: 3 * HIDDEN] <= 1)
            dw += dg @ z.T
            dz = w.T @ dg
            dx[t], dh, dc = dz[:EMBED], dz[EMBED:-1], dc * f
        return dx, dw

    def emissions(self, ids: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Label scores (time, LABELS, batch) and both directions' states (time, HIDDEN, batch) of characters (time, batch)."""
        x = np.empty((len(ids), EMBED, ids.shape[1]), self.p["E"].dtype)
        for t in range(len(ids)):
            np.take(self.p["E"], ids[t], axis=1, out=x[t], mode="clip")
        f = self._lstm(x, self.p["Wf"], keep and keep[0])
        b = self._lstm(x[::-1], self.p["Wb"], keep and keep[1])[::-1]
        e = np.matmul(self.p["O"][:, :HIDDEN], f)
        e += np.matmul(self.p["O"][:, HIDDEN:], b)
        e += self.p["o"]
        return e, (f, b)

    def gradients(self, ids: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the label paths, and its gradients."""
        keep: tuple[list, list] = ([], [])
        scores, states = self.emissions(ids, keep)
        h, e = np.concatenate(states, 1), scores.swapaxes(1, 2)
        n, batch, _ = e.shape
        trans = self.p["T"] + self.never
        lse = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0] + self.p["S"]
        for t in range(1, n):
            alpha[t] = lse(alpha[t - 1][:, :, None] + trans, 1) + e[t]
        for t in range(n - 2, -1, -1):
            beta[t] = lse(trans[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        logz = lse(alpha[-1], 1)
        node = np.exp(alpha + beta - logz[None, :, None])
        gold = self.p["S"][y[0]] + np.take_along_axis(e, y[:, :, None], 2).sum((0, 2)) + trans[y[:-1], y[1:]].sum(0)
        de = node.copy()
        np.put_along_axis(de, y[:, :, None], np.take_along_axis(de, y[:, :, None], 2) - 1, 2)
        de /= batch
        edge = np.zeros_like(trans)
        for t in range(n - 1):
            edge += np.exp(alpha[t][:, :, None] + trans + (e[t + 1] + beta[t + 1])[:, None, :] - logz[:, None, None]).sum(0)
        np.add.at(edge, (y[:-1].ravel(), y[1:].ravel()), -1)
        ds = node[0].sum(0)
        np.add.at(ds, y[0], -1)
        g = {"T": edge / batch, "S": ds / batch, "O": np.einsum("tbl,thb->lh", de, h, optimize=True), "o": de.sum((0, 1))[:, None]}
        dh = np.ascontiguousarray((de @ self.p["O"]).swapaxes(1, 2))
        dxf, g["Wf"] = self._lstm_back(dh[:, :HIDDEN], keep[0], self.p["Wf"])
        dxb, g["Wb"] = self._lstm_back(dh[::-1, HIDDEN:], keep[1], self.p["Wb"])
        by_char = np.zeros(self.p["E"].T.shape, self.p["E"].dtype)
        np.add.at(by_char, ids, (dxf + dxb[::-1]).swapaxes(1, 2))
        g["E"] = by_char.T
        return float((logz - gold).mean()), g

    def fit(self, texts: list[tuple[str, list[Span]]], steps: int = STEPS, rate: float = 0.02, seed: int = 3) -> Tagger:
        rng = np.random.default_rng(seed)
        # Texts are cut anywhere, as windows are: a window may begin within a span.
        cut = [int(rng.integers(0, len(t) - LENGTH + 1)) for t, _ in texts]
        ids = np.stack([char_ids(t)[a : a + LENGTH] for a, (t, _) in zip(cut, texts)], 1)
        y = np.stack([label_ids(len(t), s)[a : a + LENGTH] for a, (t, s) in zip(cut, texts)], 1)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            batch = rng.integers(0, ids.shape[1], BATCH)
            _, g = self.gradients(ids[:, batch], y[:, batch])
            norm = max(1.0, np.sqrt(sum(float((x * x).sum()) for x in g.values())) / 5.0)
            now = rate * min(1.0, 1.5 * (1 - step / (steps + 1)))
            for k, x in g.items():
                x = x / norm
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def quiet(self, e: np.ndarray) -> np.ndarray:
        """Windows (a boolean each) whose best path is certainly outside throughout.

        Viterbi's recursion without paths, on scores over "outside", in which a label that is not the run's own goes on as
        the best of all such would: that is never less than the best path's score.
        """
        trans = self.p["T"] + self.never - self.p["T"][0, 0]
        column = lambda x: np.ascontiguousarray(x, np.float32)[:, None]
        begin, inside, inner = slice(1, None, 2), slice(2, None, 2), np.arange(1, LABELS, 2)
        to_begin, other_begin = column(trans[0, begin]), column(trans[1:, begin].max(0))
        first, on = column(trans[inner, inner + 1]), column(trans[inner + 1, inner + 1])
        to_out = np.float32(trans[1:, 0].max())
        score = e[0] - e[0, 0] + column(self.p["S"] - self.p["S"][0])
        d = np.empty_like(score)
        for t in range(1, len(e)):
            other = score[1:].max(0)
            new = np.maximum(score[0] + to_begin, other + other_begin)
            np.maximum(score[begin] + first, score[inside] + on, out=score[inside])
            score[begin] = new
            np.maximum(score[0], other + to_out, out=score[0])
            np.subtract(e[t], e[t, 0], out=d)
            score += d
        return score.max(0) <= 0

    def best_paths(self, e: np.ndarray) -> np.ndarray:
        """Best label paths (time, batch) by Viterbi's algorithm."""
        e = np.ascontiguousarray(e.swapaxes(1, 2))
        trans = self.p["T"] + self.never
        score, back = e[0] + self.p["S"], []
        for t in range(1, len(e)):
            a = score[:, :, None] + trans
            back.append(a.argmax(1))
            score = a.max(1) + e[t]
        path = np.empty(e.shape[:2], np.int64)
        path[-1] = score.argmax(1)
        for t in range(len(e) - 2, -1, -1):
            path[t] = np.take_along_axis(back[t], path[t + 1][:, None], 1)[:, 0]
        return path


@functools.cache
def trained() -> Tagger:
    """The model, trained once a process: the same weights each time."""
    return Tagger().fit(examples())


def model_spans(model: Tagger, texts: list[str], batch: int = 512) -> list[list[Span]]:
    """The model's spans of whole texts, reconciled over overlapping windows.

    Neighbouring windows share WINDOW - STRIDE characters; each takes the half that it holds more centrally.
    """
    blank, half = OWN["\n"], (WINDOW - STRIDE) // 2
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    ids = np.append(char_ids("".join(texts)), blank)  # the last is what stands beyond a text's end
    count = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE)), 0)
    text = np.repeat(np.arange(len(texts)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    first = number * STRIDE
    out: list[list[Span]] = [[] for _ in texts]
    step = np.arange(WINDOW)[:, None]
    for at in range(0, len(text), batch):
        t, lo = text[at : at + batch], first[at : at + batch]
        where = np.where(lo + step < sizes[t], begin[t] + lo + step, len(ids) - 1)
        e, _ = model.emissions(ids[where])
        loud = np.flatnonzero(~model.quiet(e))
        if not len(loud):
            continue
        paths = model.best_paths(e[:, :, loud])
        for k, y in zip(loud.tolist(), paths.T):
            one, a = int(t[k]), int(lo[k])
            left = half if a else 0
            right = WINDOW - half if number[at + k] + 1 < count[one] else min(WINDOW, int(sizes[one]) - a)
            spans = out[one]
            for c in (np.flatnonzero(y[left:right]) + left).tolist():
                kind = TAGS[(y[c] - 1) // 2]
                if y[c] % 2 == 0 and spans and spans[-1][2] == a + c and spans[-1][0] == kind:
                    spans[-1] = (kind, spans[-1][1], a + c + 1)
                else:
                    spans.append((kind, a + c, a + c + 1))
    return out


def added_spans(text: str, base: list[Span], found: list[Span]) -> list[Span]:
    """The model's spans that are whole, shaped like their kind and overlap no base span; edges are trimmed of space and stops first."""
    out = []
    for kind, a, z in found:
        while a < z and text[a] in " \n.,;:":
            a += 1
        while a < z and text[z - 1] in " \n.,;:":
            z -= 1
        # A span that would cut a run of letters or digits in two is no span.
        whole = (a == 0 or not text[a - 1].isalnum()) and (z == len(text) or not text[z].isalnum())
        if whole and SHAPE[kind].search(text[a:z]) and not any(a < y and x < z for _, x, y in base + out):
            out.append((kind, a, z))
    return out


def by_kind(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in sorted(spans, key=lambda s: (TAGS.index(s[0]), s[1], s[2])))


def find_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the base spans), spans (base and added), n_added, n_spans (all)."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def make():
        model = shared.value

        def fn(ids, texts):
            texts = [t or "" for t in texts]
            base = [base_spans(t) if TRIGGER.search(t) else [] for t in texts]
            found = model_spans(model, texts)
            extra = [added_spans(t, b, f) if f else [] for t, b, f in zip(texts, base, found)]
            counts = [[sum(s[0] == k for s in b) for b in base] for k in KINDS]
            return ids, *counts, [hashlib.sha256(by_kind(b).encode()).hexdigest() for b in base], [by_kind(b + x) for b, x in zip(base, extra)], [len(x) for x in extra], [len(b) + len(x) for b, x in zip(base, extra)]

        return fn

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_lists(docs.select("doc_id", F.col(f"`{text}`").alias("text")), make, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind."""
    out, pos = [], 0
    for kind, a, z in sorted(spans, key=lambda s: s[1]):
        if a >= pos:
            out += [text[pos:a], f"<{kind}>"]
            pos = z
    return "".join(out) + text[pos:]
