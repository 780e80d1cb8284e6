"""Personal data in texts: fixed patterns and a character-level BiLSTM-CRF.

Patterns find e-mail addresses, IPv4 addresses, card numbers and phone
numbers.  A bidirectional LSTM over characters with a CRF on top, trained here
in numpy from labelled spans, adds spans in forms that the patterns miss (a
phone number without +, an address with spaces about its @).  Its tags obey
the CRF's transitions, and every span must hold a digit or an @, so windows
without either decode to no span and are not computed.  A decoded span must be
of its kind (digits of a card pass Luhn, parts of an address are at most 255);
of one that is not, the longest runs of words that are stay candidates.

Texts are covered by overlapping windows on a fixed grid.  A span shorter than
the stride lies inside of some window; a window's spans that touch an end of
it inside the text are left to that one.  Longer spans run through several
windows: what one window leaves open at its end is joined with what the next
one has of that kind at its start, so no length is lost.  All are reconciled
over the whole text by weighted interval scheduling on their tag scores.
Spans that touch a pattern's span are dropped: the patterns' spans always stay.

The network is trained on the driver from a bounded number of windows
(``TRAIN_WINDOWS`` of ``TRAIN_CHARS`` code points): stretches of
``CONTEXT_CHARS`` code points from at most ``CONTEXT_TEXTS`` documents, both
chosen by hash, with labelled values of each kind and look-alikes set in.
The seed is fixed, so a table always gives the same network; a process that
has trained on the same stretches uses that network again.

Null and empty texts have no spans.  Positions count code points, ends are
exclusive.  Rows are independent, so ties and repeats need no care.  Texts of
any length are taken whole: a batch of windows is held at a time.  ``redact``
keeps all columns, whatever their names; ``find_personal_data`` ignores extra
ones.  With an empty table the network learns from made-up words alone.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.hashing import pieces
from tidemark.llm.storage import map_batches

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, TRAIN_CHARS = 160, 80, 80
HIDDEN, EMBED = 32, 12
TRAIN_WINDOWS, CONTEXT_TEXTS, CONTEXT_CHARS = 8000, 400, 1000
BATCH, STEPS, SEED = 64, 600, 20

#: Tags: 0 is outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)

Span = tuple[int, int, int]  # start, end, kind

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if place % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ so that long words cost no more."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by start, then kind as listed."""
    if not _TRIGGER.search(text):
        return []
    spans = [(a, b, 0) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m.group().split(".")):
            spans.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                spans.append((m.start(), m.end(), 3))
    return sorted(spans, key=lambda s: (s[0], s[2]))


# ---------------------------------------------------------------- characters

_PAD, _SPACES, _LETTER, _OTHER = 0, 1, 2, 3
SYMBOLS = 4 + 94
_SYMBOL = np.full(128, _OTHER, np.int64)
_SYMBOL[33:127] = np.arange(4, SYMBOLS)
_SYMBOL[[9, 10, 11, 12, 13, 32]] = _SPACES


def symbols(text: str) -> np.ndarray:
    """A small number for each code point: ASCII ones apart, others by class."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where(codes < 128, _SYMBOL[np.minimum(codes, 127)], np.where(codes >= 170, _LETTER, _OTHER))


# ------------------------------------------------------------------- network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    """Weights of the tagger."""

    weights: dict[str, np.ndarray]

    @staticmethod
    def fresh(rng: np.random.Generator) -> Network:
        def draw(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        w = {"embed": draw(SYMBOLS, EMBED) * 3, "out": draw(2 * HIDDEN, TAGS), "out_bias": np.zeros(TAGS, np.float32), "move": np.zeros((TAGS, TAGS), np.float32)}
        for way in ("f", "b"):
            w[f"in_{way}"], w[f"rec_{way}"], w[f"bias_{way}"] = draw(EMBED, 4 * HIDDEN), draw(HIDDEN, 4 * HIDDEN), np.zeros(4 * HIDDEN, np.float32)
            w[f"bias_{way}"][HIDDEN : 2 * HIDDEN] = 1  # remember at first
        return Network(w)

    def _both(self, name: str) -> np.ndarray:
        return np.stack([self.weights[f"{name}_f"], self.weights[f"{name}_b"]])

    def _run(self, inputs: np.ndarray, keep: dict | None) -> np.ndarray:
        """Hidden states (steps, batch, 2 * HIDDEN) of both directions, which
        run side by side, the second one from the end."""
        steps, count = inputs.shape[:2]
        turned = np.stack([inputs, inputs[::-1]], axis=1)
        ahead = np.matmul(turned, self._both("in")) + self._both("bias")[:, None, :]
        rec = self._both("rec")
        hidden, cell = np.zeros((2, count, HIDDEN), np.float32), np.zeros((2, count, HIDDEN), np.float32)
        out = np.empty((steps, 2, count, HIDDEN), np.result_type(hidden, rec))
        trace = []
        for t in range(steps):
            z = ahead[t] + np.matmul(hidden, rec)
            gates, fresh = _sigmoid(z[..., : 3 * HIDDEN]), np.tanh(z[..., 3 * HIDDEN :])
            before = cell
            cell = gates[..., HIDDEN : 2 * HIDDEN] * before + gates[..., :HIDDEN] * fresh
            squashed = np.tanh(cell)
            out[t] = hidden = gates[..., 2 * HIDDEN :] * squashed
            if keep is not None:
                trace.append((gates, fresh, before, squashed))
        if keep is not None:
            keep.update(turned=turned, out=out, trace=trace)
        return np.concatenate([out[:, 0], out[::-1, 1]], axis=2)

    def scores(self, chars: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Tag scores (steps, batch, TAGS) of windows of symbols (batch, steps)."""
        states = self._run(self.weights["embed"][chars.T], keep)
        if keep is not None:
            keep["states"] = states
        return states @ self.weights["out"] + self.weights["out_bias"]

    def gradients(self, chars: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags and its gradients."""
        kept: dict = {}
        scores = self.scores(chars, kept)
        loss, d_scores, d_move = crf_loss(scores, self.weights["move"] + ALLOWED, tags.T)
        w, states, out, turned = self.weights, kept["states"], kept["out"], kept["turned"]
        flat = d_scores.reshape(-1, TAGS)
        grads = {"move": d_move, "out": states.reshape(-1, 2 * HIDDEN).T @ flat, "out_bias": flat.sum(0)}
        d_states = d_scores @ w["out"].T
        d_out = np.stack([d_states[..., :HIDDEN], d_states[::-1, :, HIDDEN:]], axis=1)
        back = self._both("rec").transpose(0, 2, 1)
        d_hidden = d_cell = np.zeros_like(out[0])
        d_z = np.empty((*out.shape[:3], 4 * HIDDEN), out.dtype)
        for t in range(len(out) - 1, -1, -1):
            gates, fresh, before, squashed = kept["trace"][t]
            i, f, o = gates[..., :HIDDEN], gates[..., HIDDEN : 2 * HIDDEN], gates[..., 2 * HIDDEN :]
            d_hidden = d_hidden + d_out[t]
            d_cell = d_cell + d_hidden * o * (1 - squashed**2)
            z = d_z[t]
            z[..., :HIDDEN] = d_cell * fresh * i * (1 - i)
            z[..., HIDDEN : 2 * HIDDEN] = d_cell * before * f * (1 - f)
            z[..., 2 * HIDDEN : 3 * HIDDEN] = d_hidden * squashed * o * (1 - o)
            z[..., 3 * HIDDEN :] = d_cell * i * (1 - fresh**2)
            d_hidden, d_cell = np.matmul(z, back), d_cell * f
        old = np.concatenate([np.zeros_like(out[:1]), out[:-1]])
        d_inputs = np.zeros_like(turned[:, 0])
        for k, way in enumerate("fb"):
            own = d_z[:, k].reshape(-1, 4 * HIDDEN)
            grads[f"rec_{way}"], grads[f"bias_{way}"] = old[:, k].reshape(-1, HIDDEN).T @ own, own.sum(0)
            grads[f"in_{way}"] = turned[:, k].reshape(-1, EMBED).T @ own
            d_inputs = d_inputs + (d_z[:, k] @ w[f"in_{way}"].T)[:: 1 - 2 * k]
        grads["embed"] = np.zeros_like(w["embed"])
        np.add.at(grads["embed"], chars.T.ravel(), d_inputs.reshape(-1, EMBED))
        return loss, grads


def _allowed() -> np.ndarray:
    """0 for moves between tags that make whole spans, else a large penalty."""
    moves = np.zeros((TAGS, TAGS), np.float32)
    for kind in range(len(KINDS)):
        inside = 2 + 2 * kind
        moves[:, inside] = -1e4
        moves[[inside - 1, inside], inside] = 0
    return moves


ALLOWED = _allowed()


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def crf_loss(scores: np.ndarray, move: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, and its gradients by tag scores and by transitions."""
    steps, count, _ = scores.shape
    alpha, beta = np.empty_like(scores), np.zeros_like(scores)
    alpha[0] = scores[0]
    for t in range(1, steps):
        alpha[t] = _log_sum(alpha[t - 1][:, :, None] + move, 1) + scores[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = _log_sum(move + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
    total = _log_sum(alpha[-1], 1)
    d_scores = np.exp(alpha + beta - total[:, None])
    d_move = np.zeros_like(move)
    rows = np.arange(count)
    gold = scores[np.arange(steps)[:, None], rows, tags].sum() + move[tags[:-1], tags[1:]].sum()
    for t in range(1, steps):
        d_move += np.exp(alpha[t - 1][:, :, None] + move + (scores[t] + beta[t] - total[:, None])[:, None, :]).sum(0)
    np.subtract.at(d_move, (tags[:-1].ravel(), tags[1:].ravel()), 1)
    d_scores[np.arange(steps)[:, None], rows, tags] -= 1
    return float((total.sum() - gold) / count), d_scores / count, d_move / count


def viterbi(scores: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best tags (batch, steps) for tag scores (steps, batch, TAGS)."""
    steps, count, _ = scores.shape
    best = scores[0] + np.where(np.arange(TAGS) % 2 == 0, np.where(np.arange(TAGS) > 0, -1e4, 0), 0).astype(np.float32)
    came = np.zeros(scores.shape, np.int8)
    for t in range(1, steps):
        ways = best[:, :, None] + move
        came[t] = ways.argmax(1)
        best = ways.max(1) + scores[t]
    out = np.empty((count, steps), np.int8)
    out[:, -1] = best.argmax(1)
    rows = np.arange(count)
    for t in range(steps - 1, 0, -1):
        out[:, t - 1] = came[t, rows, out[:, t]]
    return out


# ------------------------------------------------------------ labelled spans


def _digits(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _word(rng: np.random.Generator, least: int = 3, most: int = 9) -> str:
    return "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(least, most)))


def _card_digits(rng: np.random.Generator, n: int) -> str:
    head = str(rng.integers(3, 7)) + _digits(rng, n - 2)
    return next(x for x in (head + str(d) for d in range(10)) if luhn(x))


def labelled_value(rng: np.random.Generator, kind: int) -> str:
    """A value of the kind, in one of its usual or looser forms."""

    def one(*choices):
        return choices[rng.integers(0, len(choices))]

    if kind == 0:
        local = _word(rng) + one("", "", f".{_word(rng)}", _digits(rng, 2), f".{_digits(rng, 2)}", f"_{_word(rng)}", f"-{_word(rng)}")
        host = one("", f"{_word(rng)}.") + _word(rng) + one("", "", _digits(rng, 1), f"-{_word(rng)}")
        top = one("com", "org", "net", "example.com", "de", "fr", _word(rng, 2, 5), _word(rng, 2, 5), f"{_word(rng, 2, 4)}.{_word(rng, 2, 3)}")
        at, dot = one(("@", "."), ("@", "."), ("@", "."), (" @ ", "."), (" @ ", " . "), ("@ ", "."), (" @", "."))
        return f"{local}{at}{host}{dot}{top}"
    if kind == 1:
        return one(".", ".", ".", ".", " . ", "[.]").join(map(str, rng.integers(1, 255, 4)))
    if kind == 2:
        digits, gap = _card_digits(rng, one(16, 16, 16, 15)), one("", " ", " ", "-", ".", "/", "_")
        cuts = [0, 4, 8, 12, 16] if len(digits) == 16 else [0, 4, 10, 15]
        return gap.join(digits[i:j] for i, j in zip(cuts, cuts[1:]))
    area, first, last = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    gap = one("-", "-", " ", ".")
    number = one(f"{area}{gap}{first}{gap}{last}", f"({area}) {first}{gap}{last}", f"({area}){first}{gap}{last}")
    return one("", "", "+1 ", "1-", "+1.", f"+{rng.integers(1, 99)} ") + number


def look_alike(rng: np.random.Generator) -> str:
    """Digits and @ that are no personal data."""
    form = rng.integers(0, 9)
    if form == 0:
        return "".join("0123456789abcdef"[c] for c in rng.integers(0, 16, rng.integers(12, 41)))
    if form == 1:
        return f"{rng.integers(1900, 2100)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}"
    if form == 2:
        return f"{rng.integers(0, 24)}:{rng.integers(0, 60):02d}"
    if form == 3:
        return f"{rng.integers(0, 1000)}.{_digits(rng, rng.integers(1, 6))}"
    if form == 4:
        return f"{rng.integers(0, 20)}.{rng.integers(0, 20)}.{rng.integers(0, 20)}"
    if form == 5:
        return _digits(rng, rng.integers(1, 9))
    if form == 6:
        return f"@{_word(rng)}"
    if form == 7:
        return f"https://{_word(rng)}.com/{_digits(rng, rng.integers(1, 7))}"
    return f"{_word(rng)}{_digits(rng, rng.integers(1, 5))}"


def training_windows(contexts: list[str], count: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and tags of windows with labelled values and look-alikes set in."""
    plain = [x for x in (_TRIGGER.sub("", t) for t in contexts) if len(x) >= 2 * TRAIN_CHARS]
    chars, tags = np.zeros((count, TRAIN_CHARS), np.int64), np.zeros((count, TRAIN_CHARS), np.int64)
    for row in range(count):
        if plain and rng.random() < 0.9:
            own = plain[rng.integers(0, len(plain))]
            at = rng.integers(0, len(own) - TRAIN_CHARS)
            around = own[at : at + TRAIN_CHARS]
        else:
            around = " ".join(_word(rng) for _ in range(20))
        text, marks, used = "", [], 0
        for _ in range(rng.integers(1, 4)):
            step = int(rng.integers(0, 30)) if rng.random() < 0.75 else 0  # values may stand side by side
            text += around[used : used + step]
            marks += [0] * (len(text) - len(marks))
            used += step
            glue = [" ", " ", " ", "\n", "", ""][rng.integers(0, 6)]
            kind = int(rng.integers(0, len(KINDS))) if rng.random() < 0.6 else -1
            value = labelled_value(rng, kind) if kind >= 0 else look_alike(rng)
            if kind >= 0 or not glue:
                glue = glue or [" ", ": ", " ("][rng.integers(0, 3)]
            text += glue
            marks += [0] * len(glue)
            text += value
            marks += [1 + 2 * kind] + [2 + 2 * kind] * (len(value) - 1) if kind >= 0 else [0] * len(value)
            tail = [" ", ".", ", ", "\n", "### ", " "][rng.integers(0, 6)]
            text += tail
            marks += [0] * len(tail)
        text += around[used:]
        marks += [0] * (len(text) - len(marks))
        start = int(rng.integers(0, max(1, len(text) - TRAIN_CHARS + 1)))
        own = marks[start : start + TRAIN_CHARS]
        for place, tag in enumerate(own):  # a span that the window cuts is learned from its first tag here on
            if place == 0 and tag and tag % 2 == 0:
                own[0] = tag - 1
        part = symbols(text[start : start + TRAIN_CHARS])
        chars[row, : len(part)], tags[row, : len(own)] = part, own
    return chars, tags


def train(contexts: list[str], windows: int = TRAIN_WINDOWS, steps: int = STEPS, seed: int = SEED) -> Network:
    """A tagger fitted by Adam on ``windows`` labelled windows."""
    rng = np.random.default_rng(seed)
    chars, tags = training_windows(contexts, windows, rng)
    net = Network.fresh(rng)
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    for step in range(1, steps + 1):
        rows = rng.integers(0, windows, BATCH)
        _, grads = net.gradients(chars[rows], tags[rows])
        norm = float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in grads.values())))
        rate = 0.012 * min(1.0, step / 20) * (1 - step / (steps + 1)) ** 0.5
        for k, g in grads.items():
            g = g * min(1.0, 5 / (norm + 1e-9))
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            net.weights[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


#: Networks by the digest of the stretches they learned from.
_trained: dict[str, Network] = {}


def training_contexts(documents: DataFrame) -> list[str]:
    """Stretches of at most ``CONTEXT_TEXTS`` documents, by hash.

    A rate that follows from the number of rows leaves some four times as many
    before they are sorted, whatever the partitions; equal rows count once.
    """
    rate = max(1, documents.count() // (4 * CONTEXT_TEXTS))
    room = F.greatest(F.length("text") - CONTEXT_CHARS, F.lit(1)).cast("bigint")
    stretch = F.col("text").substr((F.pmod(F.xxhash64("text"), room) + 1).cast("int"), F.lit(CONTEXT_CHARS))
    few = documents.where("text is not null").select(F.xxhash64("doc_id", "text").alias("place"), stretch.alias("text"))
    few = few.where(F.pmod("place", F.lit(rate)) == 0).groupBy("place").agg(F.min("text").alias("text"))
    return [r["text"] for r in few.orderBy(F.xxhash64("place"), "place").limit(CONTEXT_TEXTS).collect()]


def train_on(documents: DataFrame) -> Network:
    """A tagger whose contexts are stretches of ``CONTEXT_TEXTS`` documents."""
    contexts = training_contexts(documents)
    digest = hashlib.sha256("\0".join(contexts).encode("utf-8", "replace")).hexdigest()
    if digest not in _trained:
        while len(_trained) >= 4:
            _trained.pop(next(iter(_trained)))
        _trained[digest] = train(contexts)
    return _trained[digest]


# ------------------------------------------------------------------ decoding


def _window_starts(text: str) -> list[int]:
    """Grid windows that hold a digit or an @."""
    last = max(0, -(-(len(text) - WINDOW) // STRIDE))
    found: list[int] = []
    for m in re.finditer(r"[0-9@](?:[^0-9@]{0,8}[0-9@])*", text):
        low = max(0, -(-(m.start() - WINDOW + 1) // STRIDE))
        high = min(last, (m.end() - 1) // STRIDE)
        begin = max(low, found[-1] + 1 if found else 0)
        found.extend(range(begin, high + 1))
    return [k * STRIDE for k in found]


def _valid(text: str, kind: int) -> bool:
    """Whether a decoded span can be of its kind at all."""
    digits = sum("0" <= c <= "9" for c in text)
    if kind == 0:
        return text.count("@") == 1 and not text.startswith("@") and "." in text.partition("@")[2]
    if kind == 1:
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and not re.search(r"[^0-9 .\[\]()]", text)
    if kind == 2:
        return 14 <= digits <= 19 and luhn(_NOT_DIGIT.sub("", text)) and not re.search(r"[^0-9 ./_-]", text)
    return 7 <= digits <= 15 and not re.search(r"[^0-9 ()+./-]", text)


#: Code points of a part of a span that cannot be of its kind as a whole.
MOST_PART = 120


def _valid_parts(text: str, kind: int) -> Iterator[tuple[int, int]]:
    """From each word of the text the longest run of words that can be of the kind."""
    words = [m.span() for m in re.finditer(r"\S+", text)]
    for i, (a, _) in enumerate(words):
        ends = [b for _, b in takewhile(lambda w: w[1] - a <= MOST_PART, words[i : i + MOST_PART])]
        best = next((b for b in reversed(ends) if _valid(text[a:b], kind)), None)
        if best is not None:
            yield a, best


def reconcile(candidates: list[tuple[float, Span]]) -> list[Span]:
    """Disjoint spans of the greatest total score; ties go to earlier spans."""
    best: dict[Span, float] = {}
    for score, span in candidates:
        best[span] = max(score, best.get(span, score))
    spans = sorted(best, key=lambda s: (s[1], s[0], s[2]))
    ends = [s[1] for s in spans]
    total, take = [0.0], []
    for k, span in enumerate(spans):
        before = bisect_right(ends, span[0], 0, k)
        take.append((total[before] + best[span], before))
        total.append(max(total[-1], take[-1][0]))
    out, k = [], len(spans)
    while k:
        if take[k - 1][0] > total[k - 1]:
            out.append(spans[k - 1])
            k = take[k - 1][1]
        else:
            k -= 1
    return out[::-1]


@dataclass
class _Open:
    """A span that has run to the end of the window at ``at``."""

    at: int
    start: int
    end: int
    kind: int
    score: float


def learned_spans(texts: list[str], net: Network, batch: int = 256) -> list[list[Span]]:
    """The network's spans in each text, reconciled over its windows."""
    places = [(row, start) for row, text in enumerate(texts) for start in _window_starts(text)]
    found: list[list[tuple[float, Span]]] = [[] for _ in texts]
    running: list[list[_Open]] = [[] for _ in texts]
    move = net.weights["move"] + ALLOWED

    def closed(row: int, span: Span, score: float) -> None:
        start, end, kind = span
        value = texts[row][start:end]
        if score <= 0 or not _TRIGGER.search(value):
            return
        if _valid(value, kind):
            found[row].append((score, span))
        else:  # values side by side may be tagged as one
            found[row].extend((score * (b - a) / len(value), (start + a, start + b, kind)) for a, b in _valid_parts(value, kind))

    for a in range(0, len(places), batch):
        part = places[a : a + batch]
        chars = np.zeros((len(part), WINDOW), np.int64)
        for k, (row, start) in enumerate(part):
            own = symbols(texts[row][start : start + WINDOW])
            chars[k, : len(own)] = own
        scores = net.scores(chars)
        tags = viterbi(scores, move)
        for k in np.flatnonzero(tags.any(axis=1)).tolist():
            row, start = part[k]
            own, size = tags[k], len(texts[row])
            before = [x for x in running[row] if x.at == start - STRIDE]
            running[row] = []
            for s in np.flatnonzero(own % 2 == 1).tolist():
                kind, e = (int(own[s]) - 1) // 2, s + 1
                while e < WINDOW and own[e] == own[s] + 1:
                    e += 1
                if start + e > size:
                    continue
                steps = np.arange(s, e)
                gains = scores[steps, k, own[steps]] - scores[steps, k, 0]
                first, score = start + s, float(gains.sum())
                if s == 0 and start > 0:  # goes on from the window before, or belongs to it
                    cut = next((x for x in before if x.kind == kind and start <= x.end <= start + e), None)
                    if cut is None:
                        continue
                    first, score = cut.start, cut.score + float(gains[cut.end - start :].sum())
                if e == WINDOW and start + e < size:
                    running[row].append(_Open(start, first, start + e, kind, score))
                else:
                    closed(row, (first, start + e, kind), score)
    return [reconcile(x) for x in found]


def all_spans(texts: list[str], net: Network) -> list[tuple[list[Span], list[Span]]]:
    """Pattern spans, and pattern and learned spans together, of each text."""
    base = [base_spans(t) for t in texts]
    some = [i for i, t in enumerate(texts) if _TRIGGER.search(t)]
    added = dict(zip(some, learned_spans([texts[i] for i in some], net)))
    out = []
    for i, own in enumerate(base):
        covered: list[list[int]] = []  # union of the pattern spans
        for a, b, _ in own:
            if covered and a < covered[-1][1]:
                covered[-1][1] = max(b, covered[-1][1])
            else:
                covered.append([a, b])
        starts = [a for a, _ in covered]
        more = []
        for a, b, kind in added.get(i, []):
            k = bisect_left(starts, b) - 1
            if k < 0 or covered[k][1] <= a:
                more.append((a, b, kind))
        out.append((own, sorted([*own, *more], key=lambda s: (s[0], s[2]))))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; spans that
    overlap are replaced together, under the first one's kind."""
    out, done = [], 0
    for a, b, kind in spans:
        if a >= done:
            out += [text[done:a], f"[{KINDS[kind].upper()}]"]
        done = max(done, b)
    return "".join(out) + text[done:]


def find_personal_data(documents: DataFrame, net: Network) -> DataFrame:
    """doc_id, counts of pattern spans by kind, base_sha256 and all spans."""
    shared = documents.sparkSession.sparkContext.broadcast(net)  # a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in pieces(batch.column(1)):
                part = batch.slice(first, last - first)
                found = all_spans([x or "" for x in part.column(1).to_pylist()], shared.value)
                counts = [pa.array([sum(k == kind for *_, k in base) for base, _ in found], pa.int64()) for kind in range(len(KINDS))]
                digests = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, digests, pa.array([joined(x) for _, x in found], pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return map_batches(documents.select("doc_id", "text"), run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def redact(documents: DataFrame, net: Network) -> DataFrame:
    """The documents with all spans replaced; all columns stay, null texts too."""
    shared = documents.sparkSession.sparkContext.broadcast(net)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in pieces(batch.column(at)):
                part = batch.slice(first, last - first)
                texts = part.column(at).to_pylist()
                found = all_spans([x or "" for x in texts], shared.value)
                clean = pa.array([t if t is None else redacted(t, x) for t, (_, x) in zip(texts, found)], pa.string())
                yield pa.RecordBatch.from_arrays([clean if i == at else part.column(i) for i in range(part.num_columns)], part.schema.names)

    return map_batches(documents, run, documents.schema)
