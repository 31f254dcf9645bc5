"""A character-level bidirectional LSTM with CRF transitions, in numpy: training and decoding.

The network reads texts window by window; where windows overlap, what they say of a character
is averaged, and one best path of tags is taken through each stretch of windows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

WINDOW, STRIDE = 64, 32
#: Characters whose tags are decoded together.
TOGETHER = 1 << 18
#: Windows of texts that are tagged together.
AT_ONCE = 4096

_CLASSES = ["\0", "0123456789", "@", ".", "-", "+", "(", ")", " ", "\n\r\t", ",", ":;", "/", "_", "%", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "\"'", "=", "#*&$"]
#: Class of each code point below 128; 20 is any other ASCII character, 21 what lies beyond.
_CLASS_OF = np.full(129, 20, dtype=np.int64)
_CLASS_OF[128] = 21
for _k, _chars in enumerate(_CLASSES):
    for _c in _chars:
        _CLASS_OF[ord(_c)] = _k
N_CLASSES = 22


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return _CLASS_OF[np.minimum(points, 128)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Tagger:
    """tags: names, the first of them for characters outside every span. p: the parameters by name."""

    tags: tuple[str, ...]
    hidden: int
    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, kinds: Sequence[str], hidden: int, seed: int) -> Tagger:
        rng = np.random.default_rng(seed)
        tags = ("O", *[f"{x}-{k}" for k in kinds for x in "BI"])
        n, h = len(tags), hidden
        p = {f"{name}_{d}": rng.normal(0, s, shape) for d in "fb" for name, s, shape in (("in", 0.3, (N_CLASSES, 4 * h)), ("re", 0.3 / np.sqrt(h), (h, 4 * h)))}
        p |= {"out": rng.normal(0, 0.3, (2 * h, n)), "bias": np.zeros(n), "move": rng.normal(0, 0.1, (n, n)), "begin": np.zeros(n), "finish": np.zeros(n)}
        for d in "fb":
            p[f"in_{d}"][:, h : 2 * h] += 1.0  # gates that keep the cell's state begin open
        return cls(tags, hidden, p)

    # Network: ids and everything else are (time, batch, ...)

    def _lstm(self, ids: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        h, into, re = self.hidden, self.p[f"in_{d}"], self.p[f"re_{d}"]
        state = cell = np.zeros((ids.shape[1], h), dtype=into.dtype)
        out, steps = np.empty((*ids.shape, h), dtype=into.dtype), []
        for t in range(len(ids)) if d == "f" else range(len(ids) - 1, -1, -1):
            z = into[ids[t]] + state @ re
            gate = _sigmoid(z[:, : 3 * h])
            new = np.tanh(z[:, 3 * h :])
            before, was = cell, state
            cell = gate[:, h : 2 * h] * cell + gate[:, :h] * new
            squashed = np.tanh(cell)
            state = gate[:, 2 * h :] * squashed
            out[t] = state
            if keep:
                steps.append((t, gate, new, before, was, squashed))
        return out, steps

    def _lstm_back(self, ids: np.ndarray, d: str, steps: list, grad: np.ndarray, g: dict[str, np.ndarray]) -> None:
        h, re = self.hidden, self.p[f"re_{d}"]
        carry = cell_grad = 0.0
        for t, gate, new, before, was, squashed in reversed(steps):
            i, f, o = gate[:, :h], gate[:, h : 2 * h], gate[:, 2 * h :]
            dh = grad[t] + carry
            dc = cell_grad + dh * o * (1 - squashed**2)
            dz = np.concatenate((dc * new * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - new**2)), axis=1)
            g[f"re_{d}"] += was.T @ dz
            g[f"in_{d}"] += np.eye(N_CLASSES)[ids[t]].T @ dz
            carry, cell_grad = dz @ re.T, dc * f

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        return np.concatenate((self._lstm(ids, "f", False)[0], self._lstm(ids, "b", False)[0]), axis=2) @ self.p["out"] + self.p["bias"]

    # CRF

    def _loss(self, e: np.ndarray, gold: np.ndarray) -> tuple[float, np.ndarray, dict[str, np.ndarray]]:
        """Negative log likelihood a window, and its gradients."""
        p, (times, batch, n) = self.p, e.shape
        forward, back = np.empty_like(e), np.empty_like(e)
        forward[0], back[-1] = p["begin"] + e[0], p["finish"]
        for t in range(1, times):
            forward[t] = np.logaddexp.reduce(forward[t - 1][:, :, None] + p["move"], axis=1) + e[t]
        for t in range(times - 2, -1, -1):
            back[t] = np.logaddexp.reduce(p["move"] + (e[t + 1] + back[t + 1])[:, None, :], axis=2)
        total = np.logaddexp.reduce(forward[-1] + p["finish"], axis=1)
        share = np.exp(forward + back - total[:, None])
        one = np.eye(n)[gold]
        pairs = np.exp(forward[:-1, :, :, None] + p["move"] + (e[1:] + back[1:])[:, :, None, :] - total[:, None, None]).sum((0, 1))
        known = np.einsum("tbi,tbj->ij", one[:-1], one[1:])
        score = (e * one).sum() + (known * p["move"]).sum() + p["begin"][gold[0]].sum() + p["finish"][gold[-1]].sum()
        g = {"move": (pairs - known) / batch, "begin": (share[0] - one[0]).sum(0) / batch, "finish": (share[-1] - one[-1]).sum(0) / batch}
        return (total.sum() - score) / batch, (share - one) / batch, g

    def step(self, ids: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        ahead, steps_f = self._lstm(ids, "f", True)
        behind, steps_b = self._lstm(ids, "b", True)
        both = np.concatenate((ahead, behind), axis=2)
        loss, de, g = self._loss(both @ self.p["out"] + self.p["bias"], gold)
        g["bias"] = de.sum((0, 1))
        g["out"] = np.einsum("tbh,tbn->hn", both, de)
        d = de @ self.p["out"].T
        g |= {f"{name}_{x}": np.zeros_like(self.p[f"{name}_{x}"]) for x in "fb" for name in ("in", "re")}
        self._lstm_back(ids, "f", steps_f, d[:, :, : self.hidden], g)
        self._lstm_back(ids, "b", steps_b, d[:, :, self.hidden :], g)
        return loss, g

    def fit(self, ids: np.ndarray, gold: np.ndarray, epochs: int, batch: int, rate: float, seed: int) -> float:
        """Adam over (windows, WINDOW) classes and tags; returns the last epoch's mean loss."""
        rng, n = np.random.default_rng(seed), 0
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        loss = 0.0
        for epoch in range(epochs):
            order, losses = rng.permutation(len(ids)), []
            for at in range(0, len(ids), batch):
                rows = order[at : at + batch]
                loss, g = self.step(ids[rows].T, gold[rows].T)
                losses.append(loss)
                n += 1
                pace = rate * (1 - epoch / epochs) + 0.1 * rate
                for k, x in g.items():
                    x = np.clip(x, -1, 1)
                    first[k] += 0.1 * (x - first[k])
                    second[k] += 0.01 * (x * x - second[k])
                    self.p[k] -= pace * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.99**n)) + 1e-8)
            loss = float(np.mean(losses))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        return loss

    def viterbi(self, emissions: Sequence[np.ndarray]) -> list[np.ndarray]:
        """The best tags of each sequence (length, tags), by Viterbi; sequences of like lengths go together."""
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(emissions)
        order, at = np.argsort([len(x) for x in emissions], kind="stable").tolist(), 0
        while at < len(order):
            rows = order[at : at + max(1, TOGETHER // max(1, len(emissions[order[at]])))]
            at += len(rows)
            lengths = np.array([len(emissions[k]) for k in rows])
            e = np.zeros((lengths.max(), len(rows), len(self.tags)), np.float32)
            for k, row in enumerate(rows):
                e[: lengths[k], k] = emissions[row]
            if not len(e):
                continue
            best, came = self.p["begin"] + e[0], np.empty(e.shape, dtype=np.int8)
            for t in range(1, len(e)):
                ways = best[:, :, None] + self.p["move"]
                going = (t < lengths)[:, None]
                # A sequence that has ended stays as it is.
                came[t] = np.where(going, ways.argmax(1), np.arange(len(self.tags)))
                best = np.where(going, ways.max(1) + e[t], best)
            tags, now = np.empty(e.shape[:2], dtype=np.int8), (best + self.p["finish"]).argmax(1)
            for t in range(len(e) - 1, -1, -1):
                tags[t] = now
                now = came[t][np.arange(len(now)), now] if t else now
            for k, row in enumerate(rows):
                out[row] = tags[: lengths[k], k].copy()
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The best tags of (windows, WINDOW) classes, each window by itself."""
        return np.stack(self.viterbi(list(self.emissions(ids.T).transpose(1, 0, 2)))) if len(ids) else np.zeros((0, WINDOW), np.int8)

    def spans(self, texts: Sequence[str], anchors: Sequence[Sequence[int]]) -> list[list[tuple[int, int, str]]]:
        """Spans (start, end, kind) of each text, of the windows that hold one of its anchors.

        Windows stand at every multiple of STRIDE, so that a character is in two of them.  Where
        windows follow each other, their emissions are averaged, the more by a window the further
        a character is from its edges, and one best path is taken through all of the stretch.
        """
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        stretches: list[tuple[int, np.ndarray]] = []
        held = 0
        for k, at in enumerate(anchors):
            windows = np.unique([w for p in at for w in (p // STRIDE - 1, p // STRIDE)]).astype(np.int64)
            held += len(windows)
            stretches += [(k, x) for x in (np.split(windows, np.flatnonzero(np.diff(windows) * STRIDE >= WINDOW) + 1) if len(windows) else [])]
            if held > AT_ONCE or k + 1 == len(texts):
                found = self._averaged([(texts[j], windows) for j, windows in stretches])
                starts = [max(0, int(x[0]) * STRIDE) for _, x in stretches]
                for (j, _), start, tags in zip(stretches, starts, self.viterbi(found), strict=True):
                    out[j] += [(start + s, start + e, kind) for s, e, kind in self.spans_of(tags)]
                stretches, held = [], 0
        return out

    def _averaged(self, stretches: Sequence[tuple[str, np.ndarray]]) -> list[np.ndarray]:
        """For each text and stretch of windows, the emissions (length, tags) of the text's characters in it."""
        known, places = [], []
        for text, windows in stretches:
            low = int(windows[0]) * STRIDE
            part = np.zeros(int(windows[-1]) * STRIDE + WINDOW - low, dtype=np.int64)
            start, end = max(0, low), min(len(text), low + len(part))
            part[start - low : end - low] = classes(text[start:end])
            places.append(windows * STRIDE - low)
            known.append(part)
        begins = np.concatenate(([0], np.cumsum([len(x) for x in known]))).astype(np.int64)
        line = np.concatenate([*known, np.zeros(0, np.int64)])
        place = np.concatenate([p + b for p, b in zip(places, begins, strict=False)]) if places else np.zeros(0, np.int64)
        near = (WINDOW / 2 - np.abs(np.arange(WINDOW) - (WINDOW - 1) / 2)).astype(np.float32)
        total, weight = np.zeros((len(line), len(self.tags)), np.float32), np.zeros(len(line), np.float32)
        for i in range(0, len(place), 2048):
            some = place[i : i + 2048]
            found = self.emissions(line[some[:, None] + np.arange(WINDOW)].T) * near[:, None, None]
            for k, at in enumerate(some.tolist()):
                total[at : at + WINDOW] += found[:, k]
                weight[at : at + WINDOW] += near
        total /= weight[:, None]
        out = []
        for (text, windows), begin in zip(stretches, begins, strict=False):
            low = int(windows[0]) * STRIDE
            start, end = max(0, low), min(len(text), int(windows[-1]) * STRIDE + WINDOW)
            out.append(total[begin + start - low : begin + end - low])
        return out

    def spans_of(self, tags: np.ndarray) -> list[tuple[int, int, str]]:
        """Runs of one kind's tags; a tag B begins one, and so does an I after anything else."""
        out: list[tuple[int, int, str]] = []
        for at in np.flatnonzero(tags).tolist():
            name = self.tags[tags[at]]
            if out and name[0] == "I" and out[-1][1:] == (at, name[2:]):
                out[-1] = (out[-1][0], at + 1, name[2:])
            else:
                out.append((at, at + 1, name[2:]))
        return out


def windows_of(samples: Sequence[tuple[str, Sequence[tuple[int, int, str]]]], tags: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Labelled texts of at most WINDOW characters as classes and tags."""
    ids, gold = np.zeros((len(samples), WINDOW), np.int64), np.zeros((len(samples), WINDOW), np.int64)
    place = {x: k for k, x in enumerate(tags)}
    for row, (text, spans) in enumerate(samples):
        ids[row, : len(text)] = classes(text)[:WINDOW]
        for start, end, kind in spans:
            gold[row, start:end] = place[f"I-{kind}"]
            if start < WINDOW:
                gold[row, start] = place[f"B-{kind}"]
    return ids, gold
