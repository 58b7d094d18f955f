"""Linear-chain conditional random field over sparse binary features, in numpy."""

from __future__ import annotations

from collections import Counter, defaultdict, deque

import numpy as np


class Crf:
    """Weights ``(features, tags)``, transitions ``(tags, tags)``, and start and end scores."""

    def __init__(self, tags: int, features: int):
        self.tags, self.features = tags, features
        self.theta = np.zeros((features + tags + 2, tags))

    def scores(self, units: list[list[int]]) -> np.ndarray:
        flat = np.fromiter((i for u in units for i in u), np.int64)
        starts = np.cumsum([0, *map(len, units)])[:-1]
        return np.add.reduceat(self.theta[flat], starts)  # each unit has a feature at least

    def fit(self, sequences: list[tuple[list[list[int]], list[int]]], rounds: int = 120, l2: float = 1e-4) -> "Crf":
        """Maximises the penalised conditional likelihood of all sequences by L-BFGS, in so many steps or less."""
        if not sequences:
            return self
        loss = self._loss(sequences, l2)
        x, kept = self.theta, deque(maxlen=10)
        f, g = loss(x)
        for _ in range(rounds):
            d, back = -g, []
            for s, y, r in reversed(kept):
                back.append((s * d).sum() / r)
                d = d - back[-1] * y
            if kept:
                s, y, r = kept[-1]
                d = d * (r / (y * y).sum())
            else:
                d = d / max(1e-12, np.sqrt((g * g).sum()))
            for (s, y, r), was in zip(kept, reversed(back)):
                d = d + (was - (y * d).sum() / r) * s
            slope, step = (d * g).sum(), 1.0
            while True:
                new = x + step * d
                f_new, g_new = loss(new)
                if f_new <= f + 1e-4 * step * slope or step < 1e-6:
                    break
                step /= 2
            if f_new >= f:  # as good as it gets
                break
            s, y = new - x, g_new - g
            if (r := (s * y).sum()) > 1e-12:
                kept.append((s, y, r))
            x, f, g = new, f_new, g_new
        self.theta = x
        return self

    def _loss(self, sequences: list[tuple[list[list[int]], list[int]]], l2: float):
        """What gives the loss at weights, and its gradient. Equal units are scored once, and equal sequences gone through once."""
        f, t, n = self.features, self.tags, len(sequences)
        numbers: dict[tuple[int, ...], int] = {}
        times = Counter((tuple(numbers.setdefault(tuple(u), len(numbers)) for u in units), tuple(tags)) for units, tags in sequences)
        flat = np.fromiter((i for u in numbers for i in u), np.int64)
        size = np.fromiter(map(len, numbers), np.int64)
        starts = np.cumsum(size) - size
        by_length: dict[int, list] = defaultdict(list)
        for (units, tags), k in times.items():
            by_length[len(units)].append((units, tags, k))
        groups = [(np.asarray([u for u, _, _ in v]), np.asarray([y for _, y, _ in v]), np.asarray([k for _, _, k in v], float)) for v in by_length.values()]
        fixed = np.zeros((f + t + 2, t))  # how often the right tags have each weight
        of_unit = np.zeros((len(numbers), t))
        for u, y, k in groups:
            for i in range(u.shape[1]):
                np.add.at(of_unit, (u[:, i], y[:, i]), k)
                if i:
                    np.add.at(fixed, (f + y[:, i - 1], y[:, i]), k)
            np.add.at(fixed[f + t], y[:, 0], k)
            np.add.at(fixed[f + t + 1], y[:, -1], k)
        for j in range(t):
            fixed[:f, j] = np.bincount(flat, weights=np.repeat(of_unit[:, j], size), minlength=f)

        def loss(theta: np.ndarray) -> tuple[float, np.ndarray]:
            emit = np.add.reduceat(theta[:f][flat], starts)
            top = emit.max(axis=1)
            seen = np.exp(emit - top[:, None])
            tops = theta[f : f + t].max(), theta[f + t].max(), theta[f + t + 1].max()
            trans, begin, end = np.exp(theta[f : f + t] - tops[0]), np.exp(theta[f + t] - tops[1]), np.exp(theta[f + t + 1] - tops[2])
            model = np.zeros_like(theta)
            of_unit = np.zeros_like(emit)
            logs = 0.0
            for u, _, k in groups:
                length = u.shape[1]
                e = seen[u]
                a, b, c = np.empty_like(e), np.empty_like(e), np.empty(u.shape)
                for i in range(length):  # forward, each step made to add up to 1
                    a[:, i] = (a[:, i - 1] @ trans if i else begin) * e[:, i]
                    c[:, i] = a[:, i].sum(axis=1)
                    a[:, i] /= c[:, i, None]
                z = (a[:, -1] * end).sum(axis=1)
                b[:, -1] = end / z[:, None]
                for i in range(length - 2, -1, -1):
                    b[:, i] = (e[:, i + 1] * b[:, i + 1] / c[:, i + 1, None]) @ trans.T
                logs += (k * (np.log(c).sum(axis=1) + np.log(z) + top[u].sum(axis=1) + (length - 1) * tops[0] + tops[1] + tops[2])).sum()
                p = a * b * k[:, None, None]
                for j in range(t):
                    of_unit[:, j] += np.bincount(u.ravel(), weights=p[:, :, j].ravel(), minlength=len(emit))
                for i in range(1, length):
                    model[f : f + t] += trans * np.einsum("na,nb->ab", a[:, i - 1] * k[:, None], e[:, i] * b[:, i] / c[:, i, None])
                model[f + t] += p[:, 0].sum(axis=0)
                model[f + t + 1] += p[:, -1].sum(axis=0)
            for j in range(t):
                model[:f, j] = np.bincount(flat, weights=np.repeat(of_unit[:, j], size), minlength=f)
            return (logs - (fixed * theta).sum()) / n + l2 / 2 * (theta * theta).sum(), (model - fixed) / n + l2 * theta

        return loss

    def tag_all(self, sequences: list[list[list[int]]]) -> list[list[int]]:
        """Most probable tags (Viterbi) of each sequence; sequences of one length are gone through together."""
        if not sequences:
            return []
        f, t = self.features, self.tags
        emit, trans = self.scores([u for s in sequences for u in s]), self.theta[f : f + t]
        starts = np.cumsum([0, *map(len, sequences)])
        by_length: dict[int, list[int]] = defaultdict(list)
        for i, s in enumerate(sequences):
            by_length[len(s)].append(i)
        out: list[list[int]] = [[] for _ in sequences]
        for length, which in by_length.items():
            e = emit[starts[which][:, None] + np.arange(length)]
            best, back = self.theta[f + t] + e[:, 0], []
            for i in range(1, length):
                through = best[:, :, None] + trans
                back.append(through.argmax(axis=1))
                best = through.max(axis=1) + e[:, i]
            tags = [(best + self.theta[f + t + 1]).argmax(axis=1)]
            for pointers in reversed(back):
                tags.append(np.take_along_axis(pointers, tags[-1][:, None], axis=1)[:, 0])
            for i, row in zip(which, np.stack(tags[::-1], axis=1).tolist()):
                out[i] = row
        return out

    def tag(self, units: list[list[int]]) -> list[int]:
        return self.tag_all([units])[0]
