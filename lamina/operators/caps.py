"""Optimal bucket caps: an exact partition of a weighted histogram."""

from __future__ import annotations


def derive_caps(hist: dict[int, float], k: int = 8, library_max: int | None = None) -> list[int]:
    """Caps of at most k contiguous groups of rect counts with the least sum of weight times the group's largest.

    The histogram has tens of entries, so the exact dynamic programme runs where
    it is. Of equal partitions the one that splits earliest wins. Without
    entries: fixed caps. The last cap is raised to the library's largest count.
    """
    values = sorted(v for v, w in hist.items() if w > 0)
    if not values:
        return [8, 16, 32, 64]
    if len(values) <= k:
        caps = values[:]
    else:
        n = len(values)
        total = [0.0]
        for v in values:
            total.append(total[-1] + hist[v])
        best = [[float("inf")] * (n + 1) for _ in range(k + 1)]
        cut = [[0] * (n + 1) for _ in range(k + 1)]
        best[0][0] = 0.0
        for g in range(1, k + 1):
            for end in range(g, n + 1):
                for start in range(g - 1, end):
                    cost = best[g - 1][start] + (total[end] - total[start]) * values[end - 1]
                    if cost < best[g][end]:
                        best[g][end], cut[g][end] = cost, start
        caps, end = [], n
        for g in range(k, 0, -1):
            caps.append(values[end - 1])
            end = cut[g][end]
        caps.reverse()
    if library_max is not None:
        caps[-1] = max(caps[-1], library_max)
    return caps
