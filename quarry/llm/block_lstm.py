"""A bidirectional LSTM in numpy that labels every leaf block of a page as main text or not.

Its inputs are hashed tag-path vectors (the tags of the path with the words of their class, id and role), hashed word
vectors of the block's whole text, and a few counters; each block is judged in the context of all blocks of its page. It is
trained here, on pages built from a seeded grammar of layouts (menus, headers, sidebars, notices, adverts, forms, comments
and footers around articles of made-up words), never on the pages that it labels.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np

from quarry.llm.arrowtext import mix, words

PATHS, WORDS, MORE, HIDDEN, INPUT = 1024, 256, 8, 20, 32
U = np.uint64


@lru_cache(maxsize=200_000)
def path_slots(path: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Slots and weights of a tag path: every mark once for itself, the innermost two elements once more for their place."""
    slots: dict[int, float] = {}
    for depth, marks in enumerate(reversed(path)):
        for m in marks:
            for name, w in ((m, 1.0 if depth < 3 else 0.7), *(((f"{depth}{m}", 0.5),) if depth < 2 else ())):
                k = zlib.crc32(name.encode()) % PATHS
                slots[k] = max(slots.get(k, 0.0), w)
    return np.array(list(slots), np.int64), np.array(list(slots.values()), np.float32)


def counters(blocks) -> np.ndarray:
    out = np.zeros((len(blocks), MORE), np.float32)
    n = len(blocks)
    for i, b in enumerate(blocks):
        t, size = b.text, len(b.text)
        out[i] = np.log1p(size) / 8, min(1.0, b.linked / size), t[-1] in ".!?…\"'»”", i / n, (n - i) / n, t[:1] == "©", ("©" in t or "cookie" in t.lower()) and size < 400, 1.0
    return out


def word_slots(blocks) -> tuple[np.ndarray, np.ndarray]:
    """(slots of all words of all blocks, words before each block)."""
    raw = [b.text.encode() for b in blocks]
    at = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    h, before = words(at, np.frombuffer(b"".join(raw), np.uint8))
    return (mix(h) % U(WORDS)).astype(np.int64), before


def inputs(pages: list[list], wp: np.ndarray, ww: np.ndarray, wc: np.ndarray) -> np.ndarray:
    """(blocks of all pages, INPUT): the linear map of the sparse vectors."""
    flat = [b for p in pages for b in p]
    x = np.empty((len(flat), INPUT), np.float32)
    known: dict[tuple, np.ndarray] = {}
    for i, b in enumerate(flat):
        got = known.get(b.path)
        if got is None:
            slots, w = path_slots(b.path)
            got = known[b.path] = w @ wp[slots] if len(slots) else np.zeros(INPUT, np.float32)
        x[i] = got
    slots, before = word_slots(flat)
    sizes = np.diff(before)
    for first in range(0, len(flat), 4096):
        last = min(len(flat), first + 4096)
        own = np.repeat(np.arange(last - first), sizes[first:last]) * WORDS + slots[before[first] : before[last]]
        counts = np.bincount(own, minlength=(last - first) * WORDS).reshape(last - first, WORDS)
        x[first:last] += (counts / np.maximum(1, sizes[first:last])[:, None]).astype(np.float32) @ ww
    more = np.concatenate([counters(p) for p in pages]) if flat else np.zeros((0, MORE), np.float32)
    return x + more @ wc


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(x: np.ndarray, on: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: bool = False):
    """States of a forward pass over (time, pages, INPUT); where `on` is 0 (beyond a page's end) the state stays 0."""
    steps, n, _ = x.shape
    h, c, out, saved = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32), np.empty((steps, n, HIDDEN), np.float32), []
    pre = x.reshape(-1, x.shape[2]) @ w + b
    pre = pre.reshape(steps, n, 4 * HIDDEN)
    for t in range(steps):
        z = pre[t] + h @ u
        s, g = sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        was_h, was_c = h, c
        c = (f * c + i * g) * on[t][:, None]
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        if keep:
            saved.append((was_h, was_c, i, f, o, g, tc))
    return out, saved


def lstm_back(grad: np.ndarray, x: np.ndarray, on: np.ndarray, w: np.ndarray, u: np.ndarray, saved: list):
    steps, n, _ = x.shape
    dz_all = np.empty((steps, n, 4 * HIDDEN), np.float32)
    dh, dc, du = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32), np.zeros_like(u)
    for t in range(steps - 1, -1, -1):
        was_h, was_c, i, f, o, g, tc = saved[t]
        dh = dh + grad[t]
        do, dc = dh * tc, (dc + dh * o * (1 - tc * tc)) * on[t][:, None]
        dz = np.concatenate([dc * g * i * (1 - i), dc * was_c * f * (1 - f), do * o * (1 - o), dc * i * (1 - g * g)], 1)
        dz_all[t] = dz
        du += was_h.T @ dz
        dh, dc = dz @ u.T, dc * f
    flat = dz_all.reshape(-1, 4 * HIDDEN)
    return x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(0), (flat @ w.T).reshape(x.shape)


class Labeller:
    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        g = lambda *shape: (r.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        self.wp, self.ww, self.wc = (0.3 * r.normal(size=(k, INPUT)).astype(np.float32) for k in (PATHS, WORDS, MORE))
        self.ww *= 0.1
        self.cells = [[g(INPUT, 4 * HIDDEN), g(HIDDEN, 4 * HIDDEN), np.zeros(4 * HIDDEN, np.float32)] for _ in range(2)]
        for c in self.cells:
            c[2][HIDDEN : 2 * HIDDEN] = 1
        self.v, self.d, self.a = g(2 * HIDDEN, 1)[:, 0], g(INPUT, 1)[:, 0], np.zeros(1, np.float32)

    @staticmethod
    def padded(x: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(time, pages, INPUT) arrays forward and backward, and which places are blocks."""
        steps, at = max(sizes), np.cumsum([0, *sizes])
        ahead = np.zeros((steps, len(sizes), x.shape[1]), np.float32)
        back, on = ahead.copy(), np.zeros((steps, len(sizes)), np.float32)
        for j, n in enumerate(sizes):
            own = x[at[j] : at[j + 1]]
            ahead[:n, j], back[:n, j], on[:n, j] = own, own[::-1], 1
        return ahead, back, on

    def margins(self, pages: list[list]) -> list[np.ndarray]:
        """One margin for each block of each page; positive is main text."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        first = 0
        while first < len(order):
            last = first + 1  # pages of like length together; the padded arrays stay bounded
            while last < len(order) and last - first < 256 and len(pages[order[last]]) * (last - first + 1) <= max(16384, len(pages[order[last]])):
                last += 1
            own = [pages[i] for i in order[first:last]]
            x = inputs(own, self.wp, self.ww, self.wc)
            sizes = [len(p) for p in own]
            ahead, back, on = self.padded(x, sizes)
            f, b = lstm(ahead, on, *self.cells[0])[0], lstm(back, on, *self.cells[1])[0]
            at = np.cumsum([0, *sizes])
            for j, n in enumerate(sizes):
                out[order[first + j]] = f[:n, j] @ self.v[:HIDDEN] + b[:n, j][::-1] @ self.v[HIDDEN:] + x[at[j] : at[j + 1]] @ self.d + self.a[0]
            first = last
        return out

    def train(self, pages: list[list], labels: list[np.ndarray], rounds: int, rate: float = 0.006, batch: int = 32, seed: int = 9) -> None:
        r = np.random.default_rng(seed)
        params = [self.wp, self.ww, self.wc, *self.cells[0], *self.cells[1], self.v, self.d, self.a]
        m, s, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for turn in range(rounds):
            for pick in np.array_split(r.permutation(len(pages)), max(1, len(pages) // batch)):
                own = [pages[i] for i in pick]
                sizes = [len(p) for p in own]
                flat = [b for p in own for b in p]
                x = inputs(own, self.wp, self.ww, self.wc)
                ahead, back, on = self.padded(x, sizes)
                (f, fs), (b, bs) = lstm(ahead, on, *self.cells[0], keep=True), lstm(back, on, *self.cells[1], keep=True)
                at, goal = np.cumsum([0, *sizes]), np.concatenate([labels[i] for i in pick])
                hf = np.concatenate([f[:n, j] for j, n in enumerate(sizes)])
                hb = np.concatenate([b[:n, j][::-1] for j, n in enumerate(sizes)])
                z = hf @ self.v[:HIDDEN] + hb @ self.v[HIDDEN:] + x @ self.d + self.a[0]
                dz = ((sigmoid(z) - goal) / len(own)).astype(np.float32)
                df, db = np.zeros_like(f), np.zeros_like(b)
                for j, n in enumerate(sizes):
                    own_dz = dz[at[j] : at[j + 1], None]
                    df[:n, j], db[:n, j] = own_dz * self.v[:HIDDEN], (own_dz * self.v[HIDDEN:])[::-1]
                gf, gb = lstm_back(df, ahead, on, *self.cells[0][:2], fs), lstm_back(db, back, on, *self.cells[1][:2], bs)
                dx = dz[:, None] * self.d
                for j, n in enumerate(sizes):
                    dx[at[j] : at[j + 1]] += gf[3][:n, j] + gb[3][:n, j][::-1]
                gp, gw = np.zeros_like(self.wp), np.zeros_like(self.ww)
                for i, block in enumerate(flat):
                    slots, w = path_slots(block.path)
                    gp[slots] += w[:, None] * dx[i]
                slots, before = word_slots(flat)
                each = dx / np.maximum(1, np.diff(before))[:, None]
                np.add.at(gw, slots, np.repeat(each, np.diff(before), axis=0))
                gc = np.concatenate([counters(p) for p in own]).T @ dx
                grads = [gp, gw, gc, *gf[:3], *gb[:3], np.concatenate([hf.T @ dz, hb.T @ dz]), x.T @ dz, np.array([dz.sum()], np.float32)]
                size = np.sqrt(sum(float((q * q).sum()) for q in grads))
                step += 1
                for p, q, mm, ss in zip(params, grads, m, s, strict=True):
                    q = q * min(1.0, 5.0 / (size + 1e-9))
                    mm += 0.1 * (q - mm)
                    ss += 0.002 * (q * q - ss)
                    p -= (rate * (0.4 if turn > rounds * 0.7 else 1.0) * (mm / (1 - 0.9**step)) / (np.sqrt(ss / (1 - 0.998**step)) + 1e-7)).astype(np.float32)
