"""A linear-chain conditional random field over words, in arrays.

A word's features are its byte n-grams (with a gap before and after, so that affixes
are among them), its first and last letters, and the word itself as a lexicon entry,
all hashed into one table of weights per label.  Transitions between labels are
learned with them.  Training is by stochastic gradients of the conditional
log-likelihood; labels come from forward-backward marginals.

Whole texts are labelled, each as one chain.  Its words are dealt to blocks of ``CHAIN``
that are worked on side by side; the messages between a long text's blocks come from the
products of all their steps, so the marginals are those of the whole chain.  Training
chains are of one block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from driftloom.llm.words import Words

#: Slots of the hashed feature table (a power of two).
SLOTS = 1 << 17
CHAIN = 128
_MASK = np.uint32(SLOTS - 1)


def _slots(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint32(seed)) * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77)
    return ((x ^ (x >> np.uint32(13))) & _MASK).astype(np.int32)


def gram_slots(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the 3- and 4-grams around each byte of each word, and where words begin."""
    at = np.flatnonzero(words.inside)
    b = words.bytes
    padded = np.concatenate([b, np.full(2, 32, np.uint8)])
    one = padded[at].astype(np.uint32)
    three = padded[at - 1].astype(np.uint32) << np.uint32(16) | one << np.uint32(8) | padded[at + 1]
    four = three << np.uint32(8) | padded[at + 2]
    lengths = words.ends - words.starts
    offsets = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    return _slots(three, 1), _slots(four, 2), offsets


def word_slots(words: Words) -> np.ndarray:
    """Slots of word-level features: the word, its first letters, its last letters."""
    h = words.hashes()
    padded = np.concatenate([words.bytes, np.full(6, 32, np.uint8)])
    first = np.zeros(len(h), np.uint64)
    last = np.zeros(len(h), np.uint64)
    out = [(h & np.uint64(SLOTS - 1)).astype(np.int32)]
    for k in range(5):
        inside = words.starts + k < words.ends
        first = first << np.uint64(8) | np.where(inside, padded[words.starts + k], 32).astype(np.uint64)
        inside = words.ends - 1 - k >= words.starts
        last = last << np.uint64(8) | np.where(inside, padded[words.ends - 1 - k], 32).astype(np.uint64)
        if k >= 2:
            out.append(_slots((first * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32), 10 + k))
            out.append(_slots((last * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32), 20 + k))
    return np.stack(out)


@dataclass
class Model:
    labels: list[str]
    #: One row of SLOTS weights per label.
    weights: np.ndarray
    #: transitions[i, j]: from label i to label j; begin: of a chain's first label.
    transitions: np.ndarray
    begin: np.ndarray

    def emissions(self, words: Words) -> np.ndarray:
        """Scores (word, label)."""
        if not len(words.starts):
            return np.zeros((0, len(self.labels)), np.float32)
        three, four, offsets = gram_slots(words)
        whole = word_slots(words)
        out = np.empty((len(words.starts), len(self.labels)), np.float32)
        for k, w in enumerate(self.weights):
            score = np.add.reduceat(w[three] + w[four], offsets)
            for row in whole:
                score += w[row]
            out[:, k] = score
        return out

    def marginals(self, emissions: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Label probabilities of each word; ``counts`` words belong to each text."""
        if not len(emissions):
            return emissions
        blocks, place = chain_places(counts)
        grid = np.zeros((CHAIN, blocks, emissions.shape[1]), np.float32)
        grid[place[1], place[0]] = emissions
        used = np.zeros((CHAIN, blocks), bool)
        used[place[1], place[0]] = True
        return forward_backward(grid, used, self.transitions, self.begin, -(-counts // CHAIN))[place[1], place[0]]


def chain_places(counts: np.ndarray) -> tuple[int, tuple[np.ndarray, np.ndarray]]:
    """Deals the words of texts to blocks: how many, and each word's (block, step)."""
    per_text = -(-counts // CHAIN)
    firsts = np.concatenate([[0], np.cumsum(counts)])[:-1]
    within = np.arange(int(counts.sum())) - np.repeat(firsts, counts)
    first_chain = np.concatenate([[0], np.cumsum(per_text)])[:-1]
    return int(per_text.sum()), (np.repeat(first_chain, counts) + within // CHAIN, within % CHAIN)


def _seams(
    e: np.ndarray, used: np.ndarray, move: np.ndarray, begin: np.ndarray, blocks: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Messages into each block from the left (before its first scores) and from the right.

    ``blocks`` in a row belong to each chain.
    """
    n = e.shape[2]
    left, right = np.tile(begin, (e.shape[1], 1)), np.ones((e.shape[1], n), e.dtype)
    in_chain = np.repeat(blocks, blocks)
    rank = np.arange(len(in_chain)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    long = np.flatnonzero(in_chain > 1)
    if not len(long):
        return left, right
    # a block's steps as one matrix: its first scores, then a move and the scores of each further step
    through = np.eye(n, dtype=e.dtype) * e[0, long][:, None, :]
    for t in range(1, len(e)):
        further = (through.reshape(-1, n) @ move).reshape(-1, n, n) * e[t, long][:, None, :]
        through = np.where(used[t, long][:, None, None], further, through)
        through /= through.sum(axis=(1, 2), keepdims=True)
    place = np.zeros(len(in_chain), np.int64)
    place[long] = np.arange(len(long))
    order = np.argsort(rank[long], kind="stable")
    waves = np.split(long[order], np.cumsum(np.bincount(rank[long]))[:-1])
    for now in waves[1:]:
        message = np.einsum("bi,bij->bj", left[now - 1], through[place[now - 1]]) @ move
        left[now] = message / message.sum(axis=1, keepdims=True)
    for now in waves[:0:-1]:
        message = np.einsum("bij,bj->bi", through[place[now]], right[now]) @ move.T
        right[now - 1] = message / message.sum(axis=1, keepdims=True)
    return left, right


def forward_backward(
    grid: np.ndarray, used: np.ndarray, transitions: np.ndarray, begin: np.ndarray, blocks: np.ndarray | None = None
) -> np.ndarray:
    """Marginals for scores (step, block, label); chains end where ``used`` does.

    ``blocks`` in a row belong to each chain, all but the last of them full; without it
    each block is a chain.  Messages are scaled at each step, which leaves marginals as
    they are.
    """
    steps = len(grid)
    e = np.exp(grid - grid.max(axis=2, keepdims=True))
    e[~used] = 1.0
    move = np.exp(transitions - transitions.max()).astype(np.float32)
    first = np.exp(begin - begin.max()).astype(np.float32)
    left, beta = _seams(e, used, move, first, np.ones(grid.shape[1], np.int64) if blocks is None else blocks)
    alpha = np.empty_like(e)
    a = left * e[0]
    alpha[0] = a / a.sum(axis=1, keepdims=True)
    for t in range(1, steps):
        a = (alpha[t - 1] @ move) * e[t]
        alpha[t] = a / a.sum(axis=1, keepdims=True)
    back = move.T
    for t in range(steps - 1, -1, -1):
        gamma = alpha[t] * beta
        alpha[t] = gamma / gamma.sum(axis=1, keepdims=True)
        live = used[t][:, None]
        b = (e[t] * beta) @ back
        beta = np.where(live, b / b.sum(axis=1, keepdims=True), 1.0)
    return alpha


class Features:
    """Feature slots of all words of a training sample, ragged by word."""

    def __init__(self, words: Words) -> None:
        three, four, offsets = gram_slots(words)
        whole = word_slots(words)
        lengths = words.ends - words.starts
        per_word = 2 * lengths + len(whole)
        self.offsets = np.concatenate([[0], np.cumsum(per_word)])
        self.slots = np.empty(int(self.offsets[-1]), np.int32)
        base = self.offsets[:-1]
        at = np.repeat((base - offsets).astype(np.int32), lengths) + np.arange(len(three), dtype=np.int32)
        self.slots[at] = three
        at += np.repeat(lengths.astype(np.int32), lengths)
        self.slots[at] = four
        del at
        for k, row in enumerate(whole):
            self.slots[base + 2 * lengths + k] = row

    def of(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the given words one after another, and where each word's begin."""
        sizes = self.offsets[word + 1] - self.offsets[word]
        ends = np.cumsum(sizes)
        begins = ends - sizes
        return self.slots[np.arange(int(ends[-1])) + np.repeat(self.offsets[word] - begins, sizes)], begins


def fit(
    words: Words,
    chains: list[np.ndarray],
    tags: list[np.ndarray],
    labels: list[str],
    epochs: int = 4,
    batch: int = 64,
    rate: float = 0.15,
    decay: float = 1e-6,
    seed: int = 7,
) -> Model:
    """Fit to chains of word numbers with their tags (label numbers).

    Adaptive stochastic gradients; the order of chains is drawn from ``seed``.
    """
    n = len(labels)
    rng = np.random.default_rng(seed)
    features = Features(words) if len(words.starts) else None
    w = np.zeros((n, SLOTS), np.float32)
    seen = np.full((n, SLOTS), 1e-2, np.float32)
    moves, begin = np.zeros((n, n)), np.zeros(n)
    seen_moves, seen_begin = np.full((n, n), 1.0), np.full(n, 1.0)
    order = np.arange(len(chains))
    for _ in range(epochs if features else 0):
        rng.shuffle(order)
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            word = np.concatenate([chains[k] for k in own])
            tag = np.concatenate([tags[k] for k in own])
            counts = np.array([len(chains[k]) for k in own])
            slots, begins = features.of(word)
            scores = np.stack([np.add.reduceat(w[k][slots], begins) for k in range(n)], axis=1)
            steps = int(counts.max())
            chain = np.repeat(np.arange(len(own)), counts)
            step = np.arange(len(word)) - np.repeat(np.cumsum(counts) - counts, counts)
            grid = np.zeros((steps, len(own), n), np.float32)
            used = np.zeros((steps, len(own)), bool)
            grid[step, chain], used[step, chain] = scores, True
            marginal, pair = _expected(grid, used, moves, begin)
            gap = marginal[step, chain]
            gap[np.arange(len(tag)), tag] -= 1.0
            sizes = np.diff(np.append(begins, len(slots)))
            for k in range(n):
                g = np.bincount(slots, weights=np.repeat(gap[:, k], sizes), minlength=SLOTS).astype(np.float32)
                g += decay * w[k]
                seen[k] += g * g
                w[k] -= rate * g / np.sqrt(seen[k])
            follows = np.flatnonzero(step[1:] > 0) + 1
            real = np.zeros((n, n))
            np.add.at(real, (tag[follows - 1], tag[follows]), 1.0)
            g = pair - real
            seen_moves += g * g
            moves -= rate * g / np.sqrt(seen_moves)
            g = marginal[0].sum(axis=0) - np.bincount(tag[step == 0], minlength=n)
            seen_begin += g * g
            begin -= rate * g / np.sqrt(seen_begin)
    return Model(labels, w, moves.astype(np.float32), begin.astype(np.float32))


def _expected(grid: np.ndarray, used: np.ndarray, moves: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (step, chain, label) and expected counts of transitions."""
    steps = len(grid)
    e = np.exp(grid - grid.max(axis=2, keepdims=True)).astype(np.float64)
    e[~used] = 1.0
    move = np.exp(moves - moves.max())
    alpha = np.empty_like(e)
    a = np.exp(begin - begin.max()) * e[0]
    alpha[0] = a / a.sum(axis=1, keepdims=True)
    for t in range(1, steps):
        a = (alpha[t - 1] @ move) * e[t]
        alpha[t] = a / a.sum(axis=1, keepdims=True)
    marginal = np.empty_like(e)
    pair = np.zeros_like(move)
    beta = np.ones_like(e[0])
    for t in range(steps - 1, -1, -1):
        g = alpha[t] * beta
        marginal[t] = g / g.sum(axis=1, keepdims=True)
        live = used[t]
        eb = e[t] * beta
        if t and live.any():
            joint = alpha[t - 1][live][:, :, None] * move[None] * eb[live][:, None, :]
            pair += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        b = eb @ move.T
        beta = np.where(live[:, None], b / b.sum(axis=1, keepdims=True), 1.0)
    return marginal, pair
