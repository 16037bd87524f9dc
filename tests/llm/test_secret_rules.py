"""Allow rules of the secret scan: linear time, and spans against a brute force over a table."""

import math
import random
import time
from collections import Counter

import pytest

from daylark.llm import secrets

STEMS = ["A-", "a-", "Ab.", "AB_", "1-", "12=", "A1/", "0", "x", "com.", ".com", "-", "A", "aB+"]


@pytest.mark.parametrize("stem", STEMS)
def test_rules_take_time_in_proportion(stem):
    text = (stem * 10_000)[:10_000] + "A12345~"
    began = time.perf_counter()
    for rule in secrets.ALLOWED:
        rule.fullmatch(text)
        rule.fullmatch(text[:-1])
    secrets.judged_random(text[:-1])
    assert time.perf_counter() - began < 1


def test_a_lone_capital_is_a_part_as_before():
    rule = secrets.ALLOWED[2]
    for text, known in (("A-B-C-12", True), ("A", True), ("Ab-CD-E1", True), ("ABc-d", False), ("A-A12345", False), ("ABCDEFGHIJKLMNOP", False), ("", True)):
        assert (rule.fullmatch(text) is not None) == known


def entropy(window):
    return -sum(n / len(window) * math.log2(n / len(window)) for n in Counter(window).values())


def brute_random(text):
    if len(text) < 20 or text.isalpha() and (text.islower() or text[1:].islower()):
        return False
    if any(r.fullmatch(text) for r in secrets.ALLOWED):
        return False
    rest = secrets.FILLERS.sub("", text)
    if len(rest) < len(text) and (len(rest) < 16 or any(r.fullmatch(rest) for r in secrets.ALLOWED)):
        return False
    kind = next(c for c in secrets.CLASSES if all(secrets.CLASSES[-1].pattern.fullmatch(x) and c.pattern.fullmatch(x) for x in rest))
    size = min(kind.window, len(rest))
    peaks = [0.0]
    for k in range(len(rest) - size + 1):
        window = rest[k : k + size]
        groups = any("a" <= c <= "z" for c in window) + any("A" <= c <= "Z" for c in window) + any("0" <= c <= "9" for c in window)
        if groups >= kind.mixed:
            peaks.append(entropy(window))
    return max(peaks) >= kind.bits * math.log2(size) / math.log2(kind.window) - 1e-9


def brute_parts(run):
    """Wider classes first; what a class doesn't take is looked at by the narrower ones."""
    found, taken = [], [False] * len(run)
    for kind in reversed(secrets.CLASSES):
        start = 0
        blocks = []
        for k in range(len(run) + 1):
            if k == len(run) or taken[k] or not kind.pattern.fullmatch(run[k]):
                if k > start:
                    blocks.append((start, k))
                start = k + 1
        for a, b in blocks:
            if b - a >= 20 and brute_random(run[a:b]):
                found.append((a, b))
                taken[a:b] = [True] * (b - a)
    return sorted(found)


def test_random_parts_equal_brute_force():
    rng = random.Random(7)
    alphabets = ["0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcXYZ019+/=_.-", "aaaaab", "A-"]
    hits = 0
    for _ in range(1500):
        run = "".join("".join(rng.choice(rng.choice(alphabets[: rng.randrange(1, 6)])) for _ in range(rng.randrange(1, 45))) + rng.choice(("", "-", "/", "xxxx", "example")) for _ in range(rng.randrange(1, 4)))
        assert secrets.random_parts(run) == brute_parts(run), run
        hits += bool(brute_parts(run))
    assert hits > 100
