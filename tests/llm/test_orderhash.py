import random

import numpy as np

from anamnesis.llm import orderhash


def brute_signature(text):
    """Every k-mer is ordered by its hash and occurrence number, whether or not any is repeated."""
    h, seen, u = orderhash.kmers(text), {}, []
    for x in h.tolist():
        k = seen[x] = seen.get(x, -1) + 1
        u.append(int(orderhash.mix(np.array([(x + k * int(orderhash.BASE)) % (1 << 64)], np.uint64))[0]))
    out = []
    for s, f in enumerate(orderhash.FACTORS.tolist()):
        v = np.array([s + 1], np.uint64)
        for i in sorted(sorted(range(len(u)), key=lambda i: f * u[i] % (1 << 64))[: orderhash.DEPTH]):
            v = orderhash.mix(v * orderhash.BASE + h[i : i + 1])
        out.append(int(v[0]) >> 48)
    return out


def test_one_repeat_more_changes_few_slots():
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300))
    more = text + text[:8]
    h = orderhash.kmers(text)
    assert len(np.unique(h)) == len(h) and len(np.unique(orderhash.kmers(more))) < len(orderhash.kmers(more))
    assert orderhash.likeness(orderhash.signature(text), orderhash.signature(more)) > 0.7
    for t in (text, more):
        assert orderhash.signature(t).tolist() == brute_signature(t)
