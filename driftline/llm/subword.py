"""Bags of hashed character n-grams, embedded, averaged and put through a linear softmax; trained here in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

from .textnum import PIECE, groups, letters, marks

#: Lengths of n-grams in bytes; an n-gram lies in one word with a blank at either side.
SIZES = (3, 4, 5)
BITS = 17


def grams(text: np.ndarray, first: int, last: int, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in [first, last) at which an n-gram of a word begins, and its bucket. ``text`` is from ``letters``."""
    last = min(last, len(text) - n + 1)
    if last <= first:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    window = [text[first + i : last + i] for i in range(n)]
    fine = window[1] != 32
    for part in window[2:-1]:
        fine &= part != 32
    at = np.flatnonzero(fine)
    code = np.full(len(at), n, np.uint32)
    for part in window:
        code = (code ^ part[at]) * np.uint32(0x01000193)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x2C1B3C6D)
    return at + first, (code >> np.uint32(32 - bits)).astype(np.int64)


def padded(text: np.ndarray, offsets: np.ndarray, punctuation: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts with a blank before each and after the last; text i lies in [offsets[i], offsets[i + 1]).

    Punctuation is blank too, unless it is asked for.
    """
    n = len(offsets) - 1
    out = np.full(len(text) + n + 1, 32, np.uint8)
    keep = np.ones(len(out), bool)
    moved = offsets + np.arange(n + 1)
    keep[moved] = False
    out[keep] = marks(text) if punctuation else letters(text)
    return out, moved


@dataclass
class Model:
    """labels; the embedding table times the softmax weights (buckets x labels): averaging commutes with them; bias; whether n-grams keep punctuation."""

    labels: list
    table: np.ndarray
    bias: np.ndarray
    bits: int
    temperature: float = 1.0
    threshold: float = 0.0
    punctuation: bool = False


def text_logits(model: Model, text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Logits (texts x labels) of the average over all n-grams of each text; the bias alone where there is none."""
    out, moved = padded(text, offsets, model.punctuation)
    n, k = len(offsets) - 1, len(model.bias)
    total, count = np.zeros((n, k)), np.zeros(n)
    for a in range(0, len(out), PIECE):
        b = min(a + PIECE, len(out))
        lo, hi = np.searchsorted(moved, [a, b - 1], side="right")
        lo, hi = lo - 1, min(hi, n)
        edges = np.clip(moved[lo : hi + 1], a, b)
        for size in SIZES:
            at, code = grams(out, a, b, size, model.bits)
            sums = np.zeros((len(at) + 1, k))
            np.cumsum(model.table[code], axis=0, out=sums[1:])
            cut = np.searchsorted(at, edges)
            total[lo:hi] += np.diff(sums[cut], axis=0)
            count[lo:hi] += np.diff(cut)
    return total / np.maximum(count, 1)[:, None] + model.bias


#: Words of a window, the middle one of the three sizes of bags by which a text is judged.
NEAR = 8


def bag_scores(line: np.ndarray, text: np.ndarray, offsets: np.ndarray, bits: int, near: int = NEAR) -> np.ndarray:
    """For each text the largest average of ``line`` (a number for each bucket) over the n-grams of a word, the largest
    over those of ``near`` consecutive words (or all, if there are fewer), and the average over all: texts x 3, 0 where there is no n-gram."""
    out, moved = padded(text, offsets)
    n = len(offsets) - 1
    blanks = np.flatnonzero(out == 32)
    starts = blanks[:-1][np.diff(blanks) > 1]  # the blank before each word
    ends = blanks[1:][np.diff(blanks) > 1]  # the blank after it
    owner = np.searchsorted(moved, starts, side="right") - 1
    total, count = np.zeros(len(starts)), np.zeros(len(starts))
    for a in range(0, len(out), PIECE):
        b = min(a + PIECE, len(out))
        lo = max(int(np.searchsorted(starts, a, side="right")) - 1, 0)
        hi = int(np.searchsorted(starts, b))
        if hi <= lo:
            continue
        for size in SIZES:
            at, code = grams(out, a, b, size, bits)
            sums = np.zeros(len(at) + 1)
            np.cumsum(line[code], out=sums[1:])
            left, right = np.searchsorted(at, starts[lo:hi]), np.searchsorted(at, ends[lo:hi])
            total[lo:hi] += sums[right] - sums[left]
            count[lo:hi] += right - left
    return np.stack([*pooled(total, count, owner, n, near)], axis=1)


def pooled(total: np.ndarray, count: np.ndarray, owner: np.ndarray, n: int, near: int = NEAR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From words' sums and numbers of n-grams, in order: the best word, the best window, and the mean of each of n texts."""
    first = np.searchsorted(owner, np.arange(n + 1))
    some = np.flatnonzero(np.diff(first))
    out = tuple(np.zeros(n) for _ in range(3))
    if not len(some):
        return out
    sums, counts = (np.concatenate([[0], np.cumsum(x)]) for x in (total, count))
    last = first[owner + 1]
    end = np.minimum(np.arange(len(owner)) + near, last)
    begin = np.minimum(np.arange(len(owner)), np.maximum(last - near, first[owner]))
    word = total / np.maximum(count, 1)
    window = (sums[end] - sums[begin]) / np.maximum(counts[end] - counts[begin], 1)
    out[0][some] = np.maximum.reduceat(word, first[some])
    out[1][some] = np.maximum.reduceat(window, first[some])
    out[2][some] = (sums[first[some + 1]] - sums[first[some]]) / np.maximum(counts[first[some + 1]] - counts[first[some]], 1)
    return out


#: Distinct n-grams (8 bytes each), of all texts together, that are kept in training; those of further texts are found anew at each visit.
KEPT = 8_000_000


def _bags(text: np.ndarray, offsets: np.ndarray, bits: int, punctuation: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct buckets and their shares."""
    for a, b in groups(offsets, PIECE >> 3):
        out, moved = padded(text[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], punctuation)
        parts = [grams(out, 0, len(out), n, bits) for n in SIZES]
        for i in range(b - a):
            cut = [code[slice(*np.searchsorted(at, moved[i : i + 2]))] for at, code in parts]
            codes, counts = np.unique(np.concatenate(cut), return_counts=True)
            yield codes.astype(np.int32), (counts / max(1, counts.sum())).astype(np.float32)


def _bag_of(texts: tuple[np.ndarray, np.ndarray], bits: int, punctuation: bool) -> Callable[[int], tuple[np.ndarray, np.ndarray]]:
    """The bag of a text by its number. Whatever words the texts are of, not many more than KEPT n-grams are held."""
    bags, left = [], KEPT
    for bag in _bags(*texts, bits, punctuation):
        bags.append(bag)
        left -= len(bag[0])
        if left < 0:
            break
    return lambda i: bags[i] if i < len(bags) else next(_bags(*next(_texts(texts, np.array([i]))), bits, punctuation))


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def softmax(z: np.ndarray, temperature: float = 1.0) -> np.ndarray:
    return _softmax(z / temperature)


def train_texts(texts: tuple[np.ndarray, np.ndarray], targets: np.ndarray, labels: list, dim: int = 16, epochs: int = 4, rate: float = 0.5, bits: int = BITS, seed: int = 7, punctuation: bool = False) -> Model:
    """Stochastic gradient descent, one text a step, on embeddings, weights and bias together.

    A fifth of the rows is held back to fit the temperature, and the threshold under which a prediction is rejected:
    the smallest one over which 99 % of the held-back predictions are right.
    """
    rng = np.random.default_rng(seed)
    k = len(labels)
    emb = (rng.standard_normal((1 << bits, dim)) * 0.1).astype(np.float32)
    w = (rng.standard_normal((dim, k)) * 0.1).astype(np.float32)
    bias = np.zeros(k, np.float32)
    bag = _bag_of(texts, bits, punctuation)
    order = rng.permutation(len(texts[1]) - 1)
    back, fit = order[: len(order) // 5], order[len(order) // 5 :]
    steps, done = max(1, epochs * len(fit)), 0
    for _ in range(epochs):
        for i in rng.permutation(fit):
            codes, share = bag(i)
            if not len(codes):
                continue
            now = rate * (1 - done / steps)
            done += 1
            mean = share @ emb[codes]
            slope = _softmax(mean @ w + bias)
            slope[targets[i]] -= 1
            down = w @ slope
            w -= now * np.outer(mean, slope)
            bias -= 0.1 * now * slope
            emb[codes] -= (now * 20) * share[:, None] * down
    model = Model(labels, emb @ w, bias, bits, punctuation=punctuation)
    if len(back):
        z = np.array([share @ model.table[codes] if len(codes) else np.zeros(k) for codes, share in map(bag, back)], np.float64) + bias
        heat = [0.05 * 1.25**i for i in range(24)]
        right = targets[back]
        model.temperature = float(min(heat, key=lambda t: -np.log(_softmax(z / t)[np.arange(len(back)), right] + 1e-12).mean()))
        p = _softmax(z / model.temperature)
        top, good = p.max(axis=1), p.argmax(axis=1) == right
        rank = np.argsort(-top)
        precise = np.flatnonzero(np.cumsum(good[rank]) / np.arange(1, len(rank) + 1) >= 0.99)
        model.threshold = float(top[rank[precise[-1]]]) if len(precise) else 1.0
    return model


#: Words whose n-grams are looked at together in training, which bounds its temporary arrays.
WORDS = 20_000


def _vocabulary(texts: tuple[np.ndarray, np.ndarray], bits: int):
    """The distinct (text, word) pairs, and the n-gram buckets of each distinct word as (first, buckets)."""
    text, offsets = texts
    seen: dict[bytes, int] = {}
    owners, ids = [], []
    for a, b in groups(offsets):
        out, moved = padded(text[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        blanks = np.flatnonzero(out == 32)
        starts, ends = blanks[:-1][np.diff(blanks) > 1], blanks[1:][np.diff(blanks) > 1]
        raw = out.tobytes()
        mine = np.fromiter((seen.setdefault(raw[s : e + 1], len(seen)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.int64, len(starts))
        owner = np.searchsorted(moved, starts, side="right") - 1
        pair = np.unique(owner * np.int64(1 << 40) + mine)
        owners.append(((pair >> 40) + a).astype(np.int32))
        ids.append((pair & ((1 << 40) - 1)).astype(np.int32))
    names, codes, counts = list(seen), [], []
    del seen
    for a in range(0, len(names), WORDS):
        part = names[a : a + WORDS]
        one = np.frombuffer(b"".join(part), np.uint8)  # each distinct word between its blanks
        begin = np.concatenate([[0], np.cumsum(np.fromiter(map(len, part), np.int64, len(part)))])
        found = [(*grams(one, 0, len(one), n, bits), n) for n in SIZES]
        at = np.concatenate([x for x, _, _ in found])
        reach = np.concatenate([np.full(len(x), n) for x, _, n in found])
        order = np.argsort(at, kind="stable")
        at, reach, code = at[order], reach[order], np.concatenate([c for _, c, _ in found])[order]
        word = np.searchsorted(begin, at, side="right") - 1
        inside = at + reach <= begin[word + 1]
        codes.append(code[inside].astype(np.int32))
        counts.append(np.bincount(word[inside], minlength=len(part)).astype(np.int32))
    del names
    first = np.concatenate([[0], np.cumsum(np.concatenate(counts), dtype=np.int64)]) if counts else np.zeros(1, np.int64)
    return np.concatenate(owners), np.concatenate(ids), first, np.concatenate(codes) if codes else np.zeros(0, np.int32)


def _means(line: np.ndarray, first: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The average of ``line`` over each word's buckets."""
    out = np.zeros(len(first) - 1, np.float32)
    for a in range(0, len(out), WORDS):
        cuts = first[a : a + WORDS + 1]
        sums = np.concatenate([[0], np.cumsum(line[code[cuts[0] : cuts[-1]]], dtype=np.float64)])
        out[a : a + WORDS] = np.diff(sums[cuts - cuts[0]]) / np.maximum(np.diff(cuts), 1)
    return out


def _spread(by_word: np.ndarray, first: np.ndarray, code: np.ndarray, buckets: int) -> np.ndarray:
    """The slopes of buckets from those of the words' averages."""
    out = np.zeros(buckets)
    for a in range(0, len(first) - 1, WORDS):
        cuts = first[a : a + WORDS + 1]
        size = np.diff(cuts)
        out += np.bincount(code[cuts[0] : cuts[-1]], np.repeat(by_word[a : a + WORDS] / np.maximum(size, 1), size), buckets)
    return out.astype(np.float32)


@dataclass
class Detector:
    """Two labels: embeddings times the difference of the softmax weights, and what the three averages of ``bag_scores`` count for."""

    line: np.ndarray
    weights: np.ndarray
    bits: int

    def logits(self, text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        found = bag_scores(self.line, text, offsets, self.bits)
        return found @ self.weights[:3] + self.weights[3]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Weights (the last one of a constant) of a logistic regression, by Newton's steps."""
    x = np.column_stack([x, np.ones(len(x))])
    held = ridge * np.append(np.ones(x.shape[1] - 1), 1e-3)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + held * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(held + 1e-9)
        w = w - np.linalg.solve(bend, slope)
    return w


def train_detector(texts: tuple[np.ndarray, np.ndarray], targets: np.ndarray, share: float, dim: int = 8, steps: int = 60, rate: float = 1.0, ridge: float = 2e-4, bits: int = BITS, seed: int = 7) -> Detector:
    """Learns label 1 against label 0 from the labels of whole texts.

    A text holds many bags, one for each of its words; each averages the embeddings of its n-grams and goes through one
    linear softmax. The text's logit is a soft maximum over its bags, flat at first, so that the label of the text pulls
    on all of its words, and sharper with every step, so that it pulls on those that account for it. Embeddings and
    softmax weights descend together (AdaGrad on all texts at once). No count of words or texts decides anything.
    A fifth of the texts is held back: on it the averages over the best word, the best window of words and the whole text
    are weighed into one calibrated logit, for texts of which ``share`` are of label 1.
    """
    rng = np.random.default_rng(seed)
    owner, ids, first, code = _vocabulary(texts, bits)
    n, many = len(first) - 1, len(targets)
    back = np.zeros(many, bool)
    for y in (0, 1):
        mine = rng.permutation(np.flatnonzero(targets == y))
        back[mine[: len(mine) // 5]] = True
    used = ~back[owner]
    pair_text, pair_word = owner[used], ids[used]  # by text, as the vocabulary gives them
    del owner, ids, used
    here, begin = np.unique(pair_text, return_index=True)
    length = np.diff(np.append(begin, len(pair_text)))
    y = targets[here].astype(np.float64)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    emb = (rng.standard_normal((1 << bits, dim)) * 0.1).astype(np.float32)
    w = (rng.standard_normal(dim) * 0.3).astype(np.float32)
    bias = 0.0
    seen_e, seen_w, seen_b = np.full((1 << bits, 1), 1e-8, np.float32), np.full(dim, 1e-8), 1e-8
    for step in range(steps if len(here) else 0):
        sharp = 1.0 + 9.0 * step / steps
        z = _means(emb @ w, first, code)[pair_word]
        top = np.maximum.reduceat(z, begin)
        e = np.exp(np.float32(sharp) * (z - np.repeat(top, length)))
        total = np.add.reduceat(e, begin, dtype=np.float64)
        logit = top + np.log(total / length) / sharp + bias
        miss = weight * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y)
        e *= np.repeat((miss / total).astype(np.float32), length)
        by_code = _spread(np.bincount(pair_word, e, n), first, code, 1 << bits)
        slope_e = by_code[:, None] * w + ridge / (1 << bits) * emb
        slope_w = emb.T @ by_code + ridge * w
        seen_e += (slope_e * slope_e).mean(axis=1, keepdims=True)
        seen_w += slope_w * slope_w
        seen_b += miss.sum() ** 2
        emb -= (0.1 * rate) * slope_e / np.sqrt(seen_e)
        w -= (0.1 * rate * slope_w / np.sqrt(seen_w)).astype(np.float32)
        bias -= 0.1 * rate * miss.sum() / seen_b**0.5
    line = (emb @ w).astype(np.float64)
    held = np.flatnonzero(back)
    if len(set(targets[held].tolist())) < 2:
        held = np.arange(many)  # too few texts to hold any back
    found = np.concatenate([bag_scores(line, text, cuts, bits) for text, cuts in _texts(texts, held)]) if len(held) else np.zeros((0, 3))
    y = targets[held].astype(np.float64)
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())) * len(held)
    scale = np.maximum(found.std(axis=0), 1e-6)
    fit = _logistic(found / scale, y, weight, 0.05)
    return Detector(line, np.append(fit[:3] / scale, fit[3]), bits)


def _texts(texts: tuple[np.ndarray, np.ndarray], chosen: np.ndarray):
    """The chosen texts one by one, as flat bytes and offsets."""
    text, offsets = texts
    for i in chosen.tolist():
        yield text[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]])
