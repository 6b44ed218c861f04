"""The plan on counts needs as many sequences as best fit by falling length, piece by piece."""

import random

from tidepool.llm.packing import plan_places


def best_fit(counts, length):
    rooms = []
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            k = min((k for k, r in enumerate(rooms) if r >= size), key=rooms.__getitem__, default=None)
            if k is None:
                rooms.append(length - size)
            else:
                rooms[k] -= size
    return sorted(length - r for r in rooms)


def fills(counts, length):
    fill = {}
    for size, _, n, sequence, _ in plan_places(counts, length):
        for k in range(n):
            fill[sequence + k] = fill.get(sequence + k, 0) + size
    return sorted(fill.values())


def test_plan_is_best_fit():
    assert len(fills({1100: 1, 400: 2}, 2048)) == 1 and len(fills({1100: 1000, 400: 2000}, 2048)) == 1000
    rng = random.Random(6)
    for _ in range(300):
        counts = {rng.randrange(1, 65): rng.randrange(1, rng.choice([3, 40])) for _ in range(rng.randrange(1, 20))}
        assert fills(counts, 64) == best_fit(counts, 64), counts
