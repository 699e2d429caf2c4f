"""A small bidirectional gated recurrent network over bytes, in numpy.

Gates and candidate use x / (1 + |x|) in place of the logistic function and the hyperbolic tangent: the same
shape at a quarter of the time. A text is cut into segments of SEGMENT bytes that are run side by side;
every byte position gets label probabilities from the states of both directions.
"""

from __future__ import annotations

import numpy as np

SEGMENT = 64
PAD = 256
GATES = ("z", "r", "n")


def segments(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All segments (n, SEGMENT) of the byte strings, their lengths, and the piece each is of."""
    lengths = np.array([len(p) for p in pieces], dtype=np.int64)
    counts = (lengths + SEGMENT - 1) // SEGMENT
    owner = np.repeat(np.arange(len(pieces)), counts)
    first = np.cumsum(counts) - counts
    size = np.minimum(lengths[owner] - (np.arange(len(owner)) - first[owner]) * SEGMENT, SEGMENT)
    grid = np.full((len(owner), SEGMENT), PAD, dtype=np.int64)
    grid[np.arange(SEGMENT) < size[:, None]] = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    return grid, size, owner


def init(labels: int, hidden: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    model = {}
    for way in ("f", "b"):
        for gate in GATES:
            model[f"{way}E{gate}"] = rng.normal(0, 0.5, (PAD + 1, hidden))
            model[f"{way}U{gate}"] = rng.normal(0, 0.5 / np.sqrt(hidden), (hidden, hidden))
        model[f"{way}W"] = rng.normal(0, 0.5, (hidden, labels))
    model["c"] = np.zeros(labels)
    return {name: value.astype(np.float32) for name, value in model.items()}


def _squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def states(model: dict, way: str, grid: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """States of one direction, (SEGMENT, n, hidden); ``keep`` gets what training needs."""
    n, steps = len(grid), grid.shape[1]
    columns = np.ascontiguousarray(grid.T)
    (ez, er, en), (uz, ur, un) = ([model[f"{way}{m}{g}"] for g in GATES] for m in "EU")
    hidden = len(uz)
    out = np.empty((steps, n, hidden), np.float32)
    h = np.zeros((n, hidden), np.float32)
    for t in range(steps) if way == "f" else reversed(range(steps)):
        at = columns[t]
        z = ez.take(at, axis=0)
        z += h @ uz
        r = er.take(at, axis=0)
        r += h @ ur
        if keep is not None:
            keep[t] = {"h": h, "az": z, "ar": r}
            z, r = z.copy(), r.copy()
        for gate in (z, r):
            scale = np.abs(gate)
            scale += 1
            gate /= scale
            gate += 1
            gate *= np.float32(0.5)
        q = h @ un
        a = q * r
        a += en.take(at, axis=0)
        candidate = _squash(a)
        if keep is not None:
            keep[t] |= {"z": z, "r": r, "q": q, "a": a, "c": candidate}
        new = h - candidate
        new *= z
        new += candidate
        out[t] = h = new
    return out


def probabilities(model: dict, grid: np.ndarray) -> np.ndarray:
    """Label probabilities of every position, (SEGMENT, n, labels)."""
    scores = states(model, "f", grid) @ model["fW"]
    scores += states(model, "b", grid) @ model["bW"]
    scores += model["c"]
    top = scores[..., 0].copy()
    for k in range(1, scores.shape[-1]):
        np.maximum(top, scores[..., k], out=top)
    scores -= top[..., None]
    np.exp(scores, out=scores)
    total = scores[..., 0].copy()
    for k in range(1, scores.shape[-1]):
        total += scores[..., k]
    scores /= total[..., None]
    return scores


def gradients(model: dict, grid: np.ndarray, size: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy over all positions, and its gradient by backpropagation through time."""
    keep: dict[str, dict] = {"f": {}, "b": {}}
    h = {way: states(model, way, grid, keep[way]) for way in "fb"}
    scores = h["f"] @ model["fW"] + h["b"] @ model["bW"] + model["c"]
    scores -= scores.max(-1, keepdims=True)
    p = np.exp(scores)
    p /= p.sum(-1, keepdims=True)
    steps, n = p.shape[:2]
    mask = (np.arange(steps)[:, None] < size[None, :]).astype(np.float32) / size.sum()
    loss = -(np.log(p[:, np.arange(n), label] + 1e-9) * mask).sum()
    p[:, np.arange(n), label] -= 1
    p *= mask[..., None]
    grad = {name: np.zeros_like(value) for name, value in model.items()}
    grad["c"] = p.sum((0, 1))
    for way in "fb":
        grad[f"{way}W"] = np.tensordot(h[way], p, ([0, 1], [0, 1]))
        from_out = p @ model[f"{way}W"].T
        back = np.zeros_like(from_out[0])
        inputs: dict[str, list] = {g: [] for g in GATES}
        order = list(range(steps)) if way == "f" else list(reversed(range(steps)))
        for t in reversed(order):
            k = keep[way][t]
            back = back + from_out[t]
            dz = back * (k["h"] - k["c"]) * 0.5 / (1 + np.abs(k["az"])) ** 2
            da = back * (1 - k["z"]) / (1 + np.abs(k["a"])) ** 2
            dr = da * k["q"] * 0.5 / (1 + np.abs(k["ar"])) ** 2
            dq = da * k["r"]
            grad[f"{way}Uz"] += k["h"].T @ dz
            grad[f"{way}Ur"] += k["h"].T @ dr
            grad[f"{way}Un"] += k["h"].T @ dq
            for gate, value in zip(GATES, (dz, dr, da)):
                inputs[gate].append(value)
            back = back * k["z"] + dz @ model[f"{way}Uz"].T + dr @ model[f"{way}Ur"].T + dq @ model[f"{way}Un"].T
        seen = grid.T[order[::-1]].ravel()
        hidden = back.shape[1]
        for gate in GATES:
            flat = np.concatenate(inputs[gate]).reshape(-1, hidden)
            grad[f"{way}E{gate}"] = np.stack(
                [np.bincount(seen, flat[:, j], PAD + 1) for j in range(hidden)], axis=1
            ).astype(np.float32)
    return float(loss), grad


def train(
    pieces: list[bytes], labels: np.ndarray, n_labels: int, hidden: int = 8, rounds: int = 250, batch: int = 384,
    rate: float = 0.02, seed: int = 7,
) -> dict[str, np.ndarray]:
    """A model fitted with Adam on random batches of segments."""
    rng = np.random.default_rng(seed)
    grid, size, owner = segments(pieces)
    target = labels[owner]
    model = init(n_labels, hidden, rng)
    first, second = ({name: np.zeros_like(value) for name, value in model.items()} for _ in range(2))
    for step in range(1, rounds + 1):
        pick = rng.integers(0, len(grid), min(batch, 4 * len(grid)))
        _, grad = gradients(model, grid[pick], size[pick], target[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        speed = rate * (1 - 0.9 * step / rounds)
        for name, g in grad.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            first[name] = 0.9 * first[name] + 0.1 * g
            second[name] = 0.99 * second[name] + 0.01 * g * g
            move = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-6)
            model[name] = (model[name] - speed * move).astype(np.float32)
    return model
