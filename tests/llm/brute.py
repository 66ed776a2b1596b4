"""Plain Python versions of what has no SQL."""

from __future__ import annotations

import hashlib


def water_filling(sizes, weights, default, cap, budget=None):
    """{source: epochs}: clamp what exceeds its cap and share the excess out, again and again."""
    sizes = {s: n for s, n in sizes.items() if n > 0}
    weight = {s: weights.get(s, default) if s is not None else default for s in sizes}
    sizes = {s: n for s, n in sizes.items() if weight[s] > 0}
    left = sum(sizes.values()) if budget is None else budget
    open_, epochs = set(sizes), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > cap * sizes[s]}
        if not over:
            epochs |= {s: max(0.0, left * weight[s] / total / sizes[s]) for s in open_}
            break
        for s in over:
            epochs[s] = float(cap)
            left -= cap * sizes[s]
        open_ -= over
    return epochs


def copies(doc_id, text, epochs, seed):
    key = f"{seed}|{doc_id if doc_id is not None else hashlib.md5(text.encode()).hexdigest() if text is not None else ''}"
    number = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 2**52
    return int(epochs) + (number < epochs - int(epochs))
