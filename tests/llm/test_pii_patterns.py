"""The patterns' matches against the contract's own expressions, on random texts."""

import random
import re

from corvane.llm.pii import base_spans


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    tests = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, (p, ok) in enumerate(tests) for m in re.finditer(p, t) if ok(m[0])]


def number(rng):
    """14 to 21 digits; half of them pass the Luhn test."""
    d = "".join(rng.choices("0123456789", k=rng.randint(14, 21)))
    return next(d[:-1] + c for c in "0123456789" if luhn(d[:-1] + c)) if rng.random() < 0.5 else d


def test_patterns():
    rng, seen = random.Random(4), [0] * 4
    makers = [
        lambda: "".join(rng.choices("ab.@-%1", k=12)),
        lambda: ".".join(str(rng.randint(0, 300)) for _ in range(rng.randint(3, 9))),
        lambda: "".join(d + rng.choice(["", "", "", " ", "-"]) for d in number(rng)) + rng.choice(["", "--1"]),
        lambda: "+" + "".join(rng.choices("0123456789 ().-", k=rng.randint(3, 20))),
        lambda: rng.choice(["é🙂", "x", "\n", " ", "+", ".", "٣", "00255.1.1.1", "a@b.c"]),
    ]
    for _ in range(20_000):
        t = "".join(rng.choice(makers)() + rng.choice(["", " ", "z"]) for _ in range(rng.randint(0, 5)))
        want = plain_spans(t)
        assert base_spans(t) == want, t
        for k, _, _ in want:
            seen[k] += 1
    assert min(seen) > 500
