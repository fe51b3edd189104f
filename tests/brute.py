"""Plain-Python forms of the searches, written from their definitions."""

import math


def right(rows, t):
    return sum((s > t) == (y == 1) for s, y in rows)


def exact(rows):
    scores = sorted({s for s, _ in rows})
    cuts = [a if not a < (a + b) / 2 < b else (a + b) / 2 for a, b in zip(scores, scores[1:])] + [scores[-1]]
    best = max(cuts, key=lambda t: right(rows, t))
    below = math.nextafter(scores[0], -math.inf)
    return below if right(rows, below) > right(rows, best) else best


def linear(rows):
    scores = sorted(s for s, _ in rows)
    cuts = [(a + b) / 2 for a, b in zip(scores, scores[1:])]
    return max(cuts, key=lambda t: right(rows, t))


def grid(rows, places):
    low, high = min(s for s, _ in rows), max(s for s, _ in rows)
    below = math.nextafter(low, -math.inf)
    n = 10**places
    cuts = [low, below] if low == high else [low + i * ((high - low) / n) for i in range(n)] + [high, below]
    return max(cuts, key=lambda t: right(rows, t)), cuts


def hist(rows, bins):
    low, high = min(s for s, _ in rows), max(s for s, _ in rows)

    def at(s):
        return 0 if low == high else min(int((s - low) / (high - low) * bins), bins - 1)

    best, correct = None, sum(y == 1 for _, y in rows)
    for k in range(bins):
        now = sum((at(s) > k) == (y == 1) for s, y in rows)
        if now > correct and any(at(s) == k for s, _ in rows):
            best, correct = k, now
    return best, correct, at
