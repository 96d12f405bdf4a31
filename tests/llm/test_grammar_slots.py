"""Re-Pair passes against a plain version, also when many pairs share a slot."""

from collections import Counter

import numpy as np
import pytest

from pairsieve.llm import grammar as G


def plain(ids, begins, frequent):
    symbols, rules, starts = [int(i) for i in ids], [], set(begins)
    while len(symbols) > 1:
        counts = Counter((a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if i + 1 not in starts)
        most = max(counts.values(), default=0)
        if most < frequent:
            break
        chosen = sorted(p for p, c in counts.items() if c >= max(frequent, most // G.CLASS))
        at, last = [], -2
        for i in range(len(symbols) - 1):
            if i + 1 not in starts and (symbols[i], symbols[i + 1]) in set(chosen) and i != last + 1:
                at.append(i)
                last = i
        used = sorted({(symbols[i], symbols[i + 1]) for i in at})
        names = {p: G.FIRST_RULE + len(rules) + k for k, p in enumerate(used)}
        out, moved, i, hits = [], set(), 0, set(at)
        while i < len(symbols):
            if i in starts:
                moved.add(len(out))
            if i in hits:
                out.append(names[symbols[i], symbols[i + 1]])
                i += 2
            else:
                out.append(symbols[i])
                i += 1
        symbols, starts, rules = out, moved, rules + used
    return symbols, rules, sorted(starts)


@pytest.mark.parametrize("shift, slots", [(14, 1 << 18), (29, 8), (31, 2)])
def test_passes_are_those_of_the_plain_version(monkeypatch, shift, slots):
    monkeypatch.setattr(G, "_SLOT_SHIFT", np.uint32(shift))
    monkeypatch.setattr(G, "_SLOTS", slots)
    for seed in range(12):
        rng = np.random.default_rng(seed)
        ids = rng.zipf(1.6, 400).clip(1, 40).astype(np.uint32)
        begins = np.unique([0, *rng.integers(0, 400, 6)])
        for frequent in (2, 4):
            grammar, places = G.compress(ids, begins, frequent)
            symbols, rules, starts = plain(ids, begins, frequent)
            assert grammar.symbols.tolist() == symbols and [tuple(r) for r in grammar.rules.tolist()] == rules
            assert places.tolist() == starts
