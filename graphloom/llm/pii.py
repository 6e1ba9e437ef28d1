"""Personal data: patterns, and a character-level bidirectional LSTM with a CRF on top, in numpy.

The patterns' spans always stay. The tagger adds spans of the same kinds, and
of secrets, where the patterns see none. It reads windows of WINDOW characters
at multiples of half a window and labels each by the best path through the
CRF. Windows overlap, and each character's label is taken from the window in
whose middle half it lies; the labels of a whole text are then cut into spans.

A span holds at least one anchor, a digit or @. So a window without one can't
add a span; it is not read, which changes nothing else.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret")
TAGS = 1 + 2 * len(KINDS)  # O, then begin and inside of each kind
WINDOW = 64
EMBED, HIDDEN = 12, 16
#: Labelled windows in a step, steps, and the rate of training.
BATCH, STEPS, RATE = 48, 500, 0.01
#: Shortest span that the tagger may add.
MIN_CHARS = 7
_SYMBOLS = 98

_ANCHOR = re.compile(r"[0-9@]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# A match that fails from a run's first digit fails from its others, so only that is tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the patterns, by start, then kind."""
    out = []
    if "@" in text:
        out += [("email", s, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def encode(text: str) -> np.ndarray:
    """Symbols of a text: printable ASCII one by one, line ends, letters beyond ASCII, the rest."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    return np.where((codes >= 32) & (codes < 127), codes - 32, np.where(codes < 32, 95, np.where(codes >= 0xC0, 96, 97)))


# Labelled spans.

_SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve que les ment eau ción ados ung sch ber lich ä é ñ ö".split()


def _word(r: random.Random) -> str:
    w = "".join(r.choices(_SYLLABLES, k=r.randint(1, 4)))
    style = r.random()
    w = w.capitalize() if style < 0.15 else w.upper() if style < 0.2 else w
    return w + r.choices(["", ",", ".", "###", "$$$", "&&&", "%%%", "***", "!!", " |"], weights=[70, 8, 8, 2, 2, 2, 2, 2, 2, 2])[0]


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choices("0123456789", k=n))


def _entity(r: random.Random) -> tuple[str, str, int, int]:
    """(text, kind, start and end of the span in it)."""
    kind = r.choice(KINDS)
    pre = post = ""
    if kind == "email":
        name = "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 8)))
        at = r.choices(["@", " @ ", " (at) @", "@ "], weights=[80, 8, 4, 8])[0]
        body = name + r.choice(["", ".", "_", "-"]) + r.choice(["", _digits(r, 2), "".join(r.choices("abcdefgh", k=4))]) + at + "".join(r.choices("abcdefghijklmno", k=r.randint(3, 8))) + "." + r.choice(["com", "org", "net", "example", "co.uk", "de", "fr"])
    elif kind == "ip":
        body = ".".join(str(r.randint(0, 255)) for _ in range(4))
    elif kind == "card":
        n = r.choice([13, 15, 16, 16, 16, 16])
        d = _digits(r, n)
        sep = r.choice(["", " ", "-", "."])
        body = sep.join(d[k : k + 4] for k in range(0, n, 4))
    elif kind == "phone":
        style = r.randint(0, 4)
        a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
        body = [f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{r.randint(20, 99)} {a} {b} {c}", f"{a}.{b}.{c}"][style]
    else:
        pre = r.choice(['token = "', 'api_key = "', "secret: ", 'password="', "key=", "bearer "])
        post = '"' if pre.endswith('"') else ""
        body = "".join(r.choices(r.choice(["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"]), k=r.choice([24, 32, 40, 40])))
        body = r.choice(["", "sk-", "ghp_"]) + body if r.random() < 0.3 else body
    return pre + body + post, kind, len(pre), len(pre) + len(body)


def _decoy(r: random.Random) -> str:
    """Text with anchors that isn't personal."""
    n = r.randint(1, 99)
    return r.choice([f"version {r.randint(1, 9)}.{r.randint(0, 9)}", f"Version {r.randint(1, 5)}.0.", "CC BY-NC 4.0.", f"{r.randint(1900, 2030)}-{n % 12 + 1:02d}-{n % 28 + 1:02d}", f"{n % 24}:{n % 60:02d}", str(r.randint(0, 99999)), f"${n}.{n % 10}0", f"{n}%", f"@{_word(r)}", f"{n},{_digits(r, 3)}", f"[{n}]", f"1.{n}.{n % 7}", f"no. {n}", f"{n} km", f"{r.randint(1900, 2030)}"])


def labelled_window(r: random.Random) -> tuple[str, np.ndarray]:
    """A window of text and the tag of each character."""
    text, tags = "", []
    while len(text) < 3 * WINDOW:
        x = r.random()
        if x < 0.16:
            piece, kind, s, e = _entity(r)
            k = 1 + 2 * KINDS.index(kind)
            own = [0] * s + [k] + [k + 1] * (e - s - 1) + [0] * (len(piece) - e)
        else:
            piece = _decoy(r) if x < 0.3 else _word(r)
            own = [0] * len(piece)
        gap = r.choices([" ", "\n", "", " - "], weights=[90, 6, 2, 2])[0]
        text, tags = text + piece + gap, tags + own + [0] * len(gap)
    at = r.randint(0, len(text) - WINDOW)
    tag = np.array(tags[at : at + WINDOW])
    if tag[0] and tag[0] % 2 == 0:
        tag[0] -= 1  # a span that began before goes on as one that begins
    return text[at : at + WINDOW], tag


# The model. Weights: embed, for each direction wx, wh and b (gates: in, forget, out, new), out, bias, trans.

Weights = dict[str, np.ndarray]


def new_weights(seed: int = 5) -> Weights:
    r = np.random.default_rng(seed)
    make = lambda *shape: (r.standard_normal(shape) * shape[0] ** -0.5).astype(np.float32)
    w = {"embed": (r.standard_normal((_SYMBOLS, EMBED)) * 0.5).astype(np.float32), "out": make(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
    for d in "fb":
        w |= {f"wx{d}": make(EMBED, 4 * HIDDEN), f"wh{d}": make(HIDDEN, 4 * HIDDEN), f"b{d}": np.zeros(4 * HIDDEN, np.float32)}
        w[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _lstm(w: Weights, d: str, x: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states (T, B, HIDDEN) of one direction over symbols x (T, B), and what goes back needs."""
    table = w["embed"] @ w[f"wx{d}"] + w[f"b{d}"]
    h = c = np.zeros((x.shape[1], HIDDEN), table.dtype)
    out, kept = np.empty((*x.shape, HIDDEN), table.dtype), []
    for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
        z = table[x[t]] + h @ w[f"wh{d}"]
        gate = _sigmoid(z[:, : 3 * HIDDEN])
        new = np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN : 2 * HIDDEN], gate[:, 2 * HIDDEN :]
        before, c = c, f * c + i * new
        th = np.tanh(c)
        kept.append((t, h, before, i, f, o, new, th))
        h = out[t] = o * th
    return out, kept


def _lstm_back(w: Weights, d: str, x: np.ndarray, kept: list, dout: np.ndarray, grad: Weights) -> None:
    dh = dc = np.zeros_like(dout[0])
    dtable = np.zeros((_SYMBOLS, 4 * HIDDEN), dout.dtype)
    dwh = np.zeros_like(w[f"wh{d}"])
    for t, h, before, i, f, o, new, th in reversed(kept):
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - th * th)
        dz = np.concatenate([dc * new * i * (1 - i), dc * before * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - new * new)], axis=1)
        np.add.at(dtable, x[t], dz)
        dwh += h.T @ dz
        dh, dc = dz @ w[f"wh{d}"].T, dc * f
    grad[f"wh{d}"], grad[f"b{d}"], grad[f"wx{d}"] = dwh, dtable.sum(axis=0), w["embed"].T @ dtable
    grad["embed"] = grad.get("embed", 0) + dtable @ w[f"wx{d}"].T


def _emissions(w: Weights, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list, list]:
    f, kf = _lstm(w, "f", x)
    b, kb = _lstm(w, "b", x)
    h = np.concatenate([f, b], axis=2)
    return h @ w["out"] + w["bias"], h, kf, kb


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return np.log(np.exp(a - m).sum(axis=axis)) + m.squeeze(axis)


def loss_and_gradients(w: Weights, x: np.ndarray, y: np.ndarray) -> tuple[float, Weights]:
    """Mean CRF loss of windows of symbols x (T, B) with tags y (T, B)."""
    e, h, kf, kb = _emissions(w, x)
    t_, b_ = x.shape
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    for t in range(1, t_):
        alpha[t] = e[t] + _lse(alpha[t - 1][:, :, None] + w["trans"], 1)
    for t in range(t_ - 2, -1, -1):
        beta[t] = _lse(w["trans"] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    total = _lse(alpha[-1], 1)
    rows = np.arange(b_)
    gold = sum(e[t, rows, y[t]] for t in range(t_)) + sum(w["trans"][y[t - 1], y[t]] for t in range(1, t_))
    de = np.exp(alpha + beta - total[:, None])
    de[np.arange(t_)[:, None], rows, y] -= 1
    dtrans = np.zeros_like(w["trans"])
    for t in range(1, t_):
        dtrans += np.exp(alpha[t - 1][:, :, None] + w["trans"] + (e[t] + beta[t] - total[:, None])[:, None, :]).sum(axis=0)
    np.add.at(dtrans, (y[:-1].ravel(), y[1:].ravel()), -1)
    de /= b_
    grad: Weights = {"trans": dtrans / b_, "out": h.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS), "bias": de.sum(axis=(0, 1))}
    dh = de @ w["out"].T
    _lstm_back(w, "f", x, kf, dh[:, :, :HIDDEN], grad)
    _lstm_back(w, "b", x, kb, dh[:, :, HIDDEN:], grad)
    return float((total - gold).mean()), grad


def train(steps: int = STEPS, seed: int = 3) -> Weights:
    """Weights fitted on labelled windows, the same each time."""
    r = random.Random(seed)
    w = new_weights()
    m1, m2 = ({n: np.zeros_like(a) for n, a in w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        made = [labelled_window(r) for _ in range(BATCH)]
        x, y = np.stack([encode(t) for t, _ in made], axis=1), np.stack([t for _, t in made], axis=1)
        _, grad = loss_and_gradients(w, x, y)
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        norm = float(np.sqrt(sum((g * g).sum() for g in grad.values())))
        for n, g in grad.items():
            g = g * min(1.0, 5 / (norm + 1e-9))
            m1[n] += 0.1 * (g - m1[n])
            m2[n] += 0.01 * (g * g - m2[n])
            w[n] -= (rate * (m1[n] / (1 - 0.9**step)) / (np.sqrt(m2[n] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


@lru_cache(maxsize=1)
def default_weights() -> Weights:
    return train()


#: Paths that can't be: an inside tag after anything but its own kind.
_NEVER = np.zeros((TAGS, TAGS), np.float32)
for _k in range(2, TAGS, 2):
    _NEVER[[t for t in range(TAGS) if t not in (_k, _k - 1)], _k] = -1e4


def viterbi(w: Weights, x: np.ndarray) -> np.ndarray:
    """Best tags (T, B) of windows of symbols x (T, B)."""
    e = _emissions(w, x)[0]
    trans = w["trans"] + _NEVER
    best, back = e[0].copy(), []
    best[:, 2::2] -= 1e4
    for t in range(1, len(x)):
        step = best[:, :, None] + trans
        back.append(step.argmax(axis=1))
        best = step.max(axis=1) + e[t]
    out = np.empty(x.shape, dtype=np.int64)
    out[-1] = best.argmax(axis=1)
    rows = np.arange(x.shape[1])
    for t in range(len(x) - 2, -1, -1):
        out[t] = back[t][rows, out[t + 1]]
    return out


def tag_texts(w: Weights, texts: list[str], prune: bool = True) -> list[np.ndarray | None]:
    """Tags of each text's characters, None where no window was read. prune: pass over windows without an anchor."""
    half = WINDOW // 2
    jobs: list[tuple[int, int]] = []
    coded: dict[int, np.ndarray] = {}
    for n, text in enumerate(texts):
        at = [m.start() for m in _ANCHOR.finditer(text)]
        if not at and prune:
            continue
        last = max(0, -(-(len(text) - WINDOW) // half))
        if prune:
            k = np.array(at) // half
            ks = np.unique(np.clip(np.concatenate([k - 1, k]), 0, last))
        else:
            ks = np.arange(last + 1)
        coded[n] = encode(text)
        jobs += [(n, int(k)) for k in ks if prune or text]
    tags: list[np.ndarray | None] = [np.zeros(len(t), dtype=np.int64) if n in coded else None for n, t in enumerate(texts)]
    for c in range(0, len(jobs), 1024):
        part = jobs[c : c + 1024]
        x = np.full((WINDOW, len(part)), 95, dtype=np.int64)
        for b, (n, k) in enumerate(part):
            piece = coded[n][k * half : k * half + WINDOW]
            x[: len(piece), b] = piece
        found = viterbi(w, x)
        for b, (n, k) in enumerate(part):
            size = len(texts[n])
            lo = 0 if k == 0 else WINDOW // 4
            hi = WINDOW if k * half + WINDOW >= size else WINDOW - WINDOW // 4
            own = found[lo:hi, b]
            if not prune and not _ANCHOR.search(texts[n], k * half, k * half + WINDOW):
                own = np.zeros_like(own)
            target = tags[n][k * half + lo : k * half + hi]
            target[:] = own[: len(target)]
    return tags


def spans_of(text: str, tags: np.ndarray | None) -> list[tuple[str, int, int]]:
    """Spans that the tags of a whole text make: runs of one kind, cut where one begins within its own middle."""
    if tags is None or not tags.any():
        return []
    kind = (tags + 1) // 2
    edges = np.flatnonzero(np.diff(kind, prepend=0, append=0))
    out = []
    for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if not kind[s]:
            continue
        # Windows reconcile to one run; a begin that follows a blank starts a new span.
        cuts = [s, *(i for i in range(s + 1, e) if tags[i] % 2 == 1 and tags[i - 1] % 2 == 0 and text[i - 1].isspace()), e]
        for a, b in zip(cuts, cuts[1:]):
            while a < b and not text[a].isalnum() and text[a] not in "+(":
                a += 1
            while b > a and not text[b - 1].isalnum():
                b -= 1
            if b - a >= MIN_CHARS and _ANCHOR.search(text, a, b) and plausible(KINDS[kind[s] - 1], text[a:b]):
                out.append((KINDS[kind[s] - 1], a, b))
    return out


def plausible(kind: str, text: str) -> bool:
    """Whether what the tagger calls an address, a card or a number can be one by its digits."""
    digits = re.sub(r"[^0-9]", "", text)
    if kind == "card":
        return 12 <= len(digits) <= 19 and _luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "ip":
        return all(int(p) <= 255 for p in re.findall(r"[0-9]+", text)) and len(re.findall(r"[0-9]+", text)) == 4
    return kind != "email" or "@" in text


def all_spans(base: list[tuple[str, int, int]], added: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The base spans, and of the added ones those that touch none of them."""
    free = [x for x in added if all(x[2] <= s or e <= x[1] for _, s, e in base)]
    return sorted([*base, *free], key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_OUT = "n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: Weights | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the patterns), n_added, base_sha256 and spans of every row.

    Spans are kind:start:end in code points, by start, then kind. A null text
    counts as empty. Each row is handled by itself, so ties, repeated rows and
    other columns don't matter; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(default_weights() if weights is None else weights)

    @F.pandas_udf(_OUT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for c in range(0, len(texts), 256):
                part = [t or "" for t in texts.iloc[c : c + 256]]
                for text, tags in zip(part, tag_texts(shared.value, part)):
                    base = base_spans(text) if tags is not None else []
                    spans = all_spans(base, spans_of(text, tags))
                    n = [sum(k == kind for k, _, _ in base) for kind in KINDS[:4]]
                    rows.append((*n, len(spans) - len(base), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _OUT.split(", ")])

    return docs.select(F.col(id_col).alias("doc_id"), run(F.col(text_col)).alias("_p")).select("doc_id", "_p.*")
