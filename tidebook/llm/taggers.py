"""A bidirectional LSTM over characters with a CRF on top, in numpy.

Every character has a row of gate inputs for either direction, so a step is one small product for both directions at
once. The CRF's sums are kept scaled, step by step. Training is plain backpropagation with Adam's steps.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Ids of characters: 0 pads; printable ASCII in lower case, the digits from 2 on alike; then white space, letters beyond
#: ASCII, and all else.
_BLANK, _LETTER, _OTHER = 97, 98, 99
VOCABULARY = 100


def _ids_of_codes() -> np.ndarray:
    out = np.full(0x251, _OTHER, np.int16)
    out[0x20:0x7F] = np.arange(1, 96)
    out[ord("A") : ord("Z") + 1] = out[ord("a") : ord("z") + 1]
    out[ord("2") : ord("9") + 1] = out[ord("2")]
    out[[*range(0x09, 0x0E), 0x85, 0xA0]] = _BLANK
    out[0xC0:0x250] = _LETTER
    return out


_TABLE = _ids_of_codes()


def character_ids(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = (codes >= 0xFF01) & (codes <= 0xFF5E)  # full-width forms of ASCII
    return _TABLE[np.minimum(np.where(wide, codes - np.uint32(0xFEE0), codes), np.uint32(0x250))]


@dataclass(frozen=True)
class Tagger:
    """``inputs``: direction, character, gates; ``within``: gate (in, keep, out, new), direction, states; ``out`` and ``bias``: states to tags;
    ``moves``: from tag to tag; ``first``: tags that begin. ``allowed`` and ``allowed_first`` are 0 where no tag may follow.
    """

    inputs: np.ndarray
    within: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    moves: np.ndarray
    first: np.ndarray
    allowed: np.ndarray
    allowed_first: np.ndarray

    def learned(self) -> dict[str, np.ndarray]:
        return {k: getattr(self, k) for k in ("inputs", "within", "out", "bias", "moves", "first")}


def fresh(allowed: np.ndarray, allowed_first: np.ndarray, hidden: int, rng: np.random.Generator) -> Tagger:
    tags = len(allowed)
    inputs = rng.normal(0, 0.3, (2, VOCABULARY, 4 * hidden))
    inputs[:, :, hidden : 2 * hidden] += 1.0  # states are remembered to begin with
    within = rng.normal(0, 1 / np.sqrt(hidden), (4, 2, hidden, hidden))
    made = (inputs, within, rng.normal(0, 0.2, (2 * hidden, tags)), np.zeros(tags), np.zeros((tags, tags)), np.zeros(tags), allowed, allowed_first)
    return Tagger(*(x.astype(np.float32) for x in made))


def _states(model: Tagger, ids: np.ndarray, keep: bool = False):
    """The states of both directions (steps, texts, 2 * hidden), and what backpropagation needs."""
    (n, steps), hidden = ids.shape, model.within.shape[-1]
    given = np.empty((steps, 4, 2, n, hidden), model.inputs.dtype)
    for side, order in ((0, ids.T), (1, ids.T[::-1])):
        given[:, :, side] = model.inputs[side][order].reshape(steps, n, 4, hidden).transpose(0, 2, 1, 3)
    h = c = np.zeros((2, n, hidden), model.inputs.dtype)
    gates, cells, out = [], [c], np.empty((steps, 2, n, hidden), model.inputs.dtype)
    for t in range(steps):
        z = given[t]
        z += h @ model.within
        s, g = 1 / (1 + np.exp(-z[:3])), np.tanh(z[3])
        c = s[1] * c + s[0] * g
        tc = np.tanh(c)
        h = out[t] = s[2] * tc
        if keep:
            gates.append((*s, g, tc))
            cells.append(c)
    return np.concatenate([out[:, 0], out[::-1, 1]], -1), (out, gates, cells)


def _scaled(model: Tagger, scores: np.ndarray):
    """Forward and backward sums of each step, each scaled to one; the tags' weights and the log of the whole sum."""
    top = scores.max(-1, keepdims=True)
    weight, move = np.exp(scores - top), np.exp(model.moves) * model.allowed
    steps, n, tags = scores.shape
    ahead, back = np.empty_like(weight), np.empty_like(weight)
    a, total = np.exp(model.first) * model.allowed_first * weight[0], np.zeros(n)
    for t in range(steps):
        if t:
            a = (a @ move) * weight[t]
        z = a.sum(-1, keepdims=True)
        a = ahead[t] = a / z
        total += np.log(z[:, 0]) + top[t, :, 0]
    b = back[steps - 1] = np.full((n, tags), 1.0, weight.dtype)
    for t in range(steps - 1, 0, -1):
        b = (b * weight[t]) @ move.T
        b = back[t - 1] = b / b.sum(-1, keepdims=True)
    return ahead, back, weight, move, total


def scores_of(model: Tagger, ids: np.ndarray) -> np.ndarray:
    """Of texts by steps of character ids: a score for each step, text and tag."""
    return _states(model, ids)[0] @ model.out + model.bias


def marginals(model: Tagger, scores: np.ndarray) -> np.ndarray:
    """How likely each tag is at each step, over all sequences of tags."""
    ahead, back, *_ = _scaled(model, scores)
    both = ahead * back
    return both / both.sum(-1, keepdims=True)


def best_tags(model: Tagger, scores: np.ndarray) -> np.ndarray:
    """The likeliest sequence of tags of each text (steps by texts), by Viterbi's algorithm."""
    with np.errstate(divide="ignore"):
        move, best = model.moves + np.log(model.allowed), scores[0] + model.first + np.log(model.allowed_first)
    came = []
    for step in scores[1:]:
        ways = best[:, :, None] + move
        came.append(ways.argmax(1))
        best = ways.max(1) + step
    out = [best.argmax(-1)]
    for origin in reversed(came):
        out.append(np.take_along_axis(origin, out[-1][:, None], 1)[:, 0])
    return np.stack(out[::-1])


def loss_and_slopes(model: Tagger, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The mean negative log likelihood of the given tags, and its slope by each learned array."""
    (n, steps), hidden = ids.shape, model.within.shape[-1]
    states, (out, gates, cells) = _states(model, ids, keep=True)
    scores = states @ model.out + model.bias
    ahead, back, weight, move, total = _scaled(model, scores)
    y, rows = tags.T, np.arange(n)
    held = np.take_along_axis(scores, y[:, :, None], 2)[..., 0].sum(0) + model.first[y[0]] + model.moves[y[:-1], y[1:]].sum(0)
    likely = ahead * back
    likely /= likely.sum(-1, keepdims=True)
    d = likely.copy()
    np.put_along_axis(d, y[:, :, None], np.take_along_axis(d, y[:, :, None], 2) - 1, 2)
    d /= n
    d_moves = np.zeros_like(model.moves)
    for t in range(1, steps):
        after = weight[t] * back[t]
        z = ((ahead[t - 1] @ move) * after).sum(-1, keepdims=True)
        d_moves += (ahead[t - 1] / z).T @ after * move
    np.subtract.at(d_moves, (y[:-1], y[1:]), 1.0)
    d_first = likely[0].copy()
    d_first[rows, y[0]] -= 1
    d_states = d @ model.out.T
    d_out = np.stack([d_states[..., :hidden], d_states[::-1, :, hidden:]], 1)
    d_given = np.empty((steps, 4, 2, n, hidden), model.inputs.dtype)
    dh = dc = np.zeros((2, n, hidden), model.inputs.dtype)
    turned = model.within.swapaxes(-1, -2)
    for t in range(steps - 1, -1, -1):
        i, f, o, g, tc = gates[t]
        dh = dh + d_out[t]
        dc = dc + dh * o * (1 - tc * tc)
        z = d_given[t]
        z[0] = dc * g * i * (1 - i)
        z[1] = dc * cells[t] * f * (1 - f)
        z[2] = dh * tc * o * (1 - o)
        z[3] = dc * i * (1 - g * g)
        dh, dc = (z @ turned).sum(0), dc * f
    d_inputs, d_within = np.zeros_like(model.inputs), np.zeros_like(model.within)
    for side, order in ((0, ids.T), (1, ids.T[::-1])):
        one = np.zeros((steps * n, VOCABULARY), model.inputs.dtype)
        one[np.arange(steps * n), order.reshape(-1)] = 1
        before = out[:-1, side].reshape(-1, hidden).T
        for gate in range(4):
            moved = d_given[:, gate, side]
            d_inputs[side][:, gate * hidden : (gate + 1) * hidden] = one.T @ moved.reshape(-1, hidden)
            d_within[gate, side] = before @ moved[1:].reshape(-1, hidden)
    flat = states.reshape(steps * n, -1)
    slopes = {"inputs": d_inputs, "within": d_within, "out": flat.T @ d.reshape(steps * n, -1), "bias": d.sum((0, 1)), "moves": d_moves / n, "first": d_first.sum(0) / n}
    return float((total - held).mean()), slopes


def train(ids: np.ndarray, tags: np.ndarray, allowed: np.ndarray, allowed_first: np.ndarray, hidden: int = 32, rounds: int = 6, batch: int = 128, rate: float = 0.03, seed: int = 5) -> Tagger:
    """Of texts (rows of character ids) and their tags; the rate falls to nothing over the rounds."""
    rng = np.random.default_rng(seed)
    model = fresh(allowed, allowed_first, hidden, rng)
    first, second = ({k: np.zeros_like(v) for k, v in model.learned().items()} for _ in range(2))
    steps, done = rounds * -(-len(ids) // batch), 0
    for _ in range(rounds):
        order = rng.permutation(len(ids))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            slopes = loss_and_slopes(model, ids[chosen], tags[chosen])[1]
            size = np.sqrt(sum(float((s * s).sum()) for s in slopes.values()))
            now, done = rate * (1 - done / steps), done + 1
            for k, s in slopes.items():
                s = s * min(1.0, 5.0 / max(size, 1e-12))
                first[k] += 0.1 * (s - first[k])
                second[k] += 0.01 * (s * s - second[k])
                value = getattr(model, k)
                value -= now * (first[k] / (1 - 0.9**done)) / (np.sqrt(second[k] / (1 - 0.99**done)) + 1e-6)
    return model
