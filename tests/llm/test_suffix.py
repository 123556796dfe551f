import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronolake.llm.suffix import LCP_CAP, induced_suffix_array, join_strings, window_classes


def brute(text):
    raw = text.tobytes()
    order = sorted(range(len(raw)), key=lambda i: raw[i:])
    common = [0]
    for a, b in zip(order, order[1:]):
        k = 0
        while max(a, b) + k < len(raw) and raw[a + k] == raw[b + k]:
            k += 1
        common.append(min(k, LCP_CAP))
    return order, common


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60), st.sampled_from([64, 1 << 28]), st.sampled_from([2, 1 << 20]))
def test_any_text(symbols, memory, in_memory):
    text = np.array([*symbols, 0], np.uint8)
    order, common = induced_suffix_array(text, memory, True, in_memory)
    assert (order.tolist(), common.tolist()) == brute(text)


def test_queues_spill_and_names_recurse():
    rng = random.Random(5)
    part = [rng.randint(1, 3) for _ in range(700)]
    text = np.array([*part, *part, 0], np.uint8)
    stats = {}
    order, common = induced_suffix_array(text, 256, True, 4, stats)
    assert (order.tolist(), common.tolist()) == brute(text)
    assert stats["spilled"] > 0 and stats["recursions"] > 1


@pytest.mark.parametrize("strings", [[b""], [b"abc", b"abc"], [b"\0\0\0\0", b"x\0\0y"], [b"aaaaaa", b"baaa"]])
def test_window_classes(strings):
    text, starts = join_strings(strings)
    places, classes = window_classes(text, starts, np.array([len(s) for s in strings]), 2)
    got = {}
    for p, c in zip(places.tolist(), classes.tolist()):
        k = int(np.searchsorted(starts, p, "right")) - 1
        got.setdefault(c, set()).add((k, p - int(starts[k])))
    want = {}
    for k, s in enumerate(strings):
        for i in range(len(s) - 1):
            want.setdefault(s[i : i + 2], set()).add((k, i))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_empty():
    assert len(induced_suffix_array(np.zeros(0, np.uint8))[0]) == 0


def test_too_wide_windows():
    from chronolake.llm import suffix

    text, starts = suffix.join_strings([b"a" * 400, b"a" * 400])
    with pytest.raises(ValueError):
        suffix.window_classes(text, starts, np.array([400, 400]), suffix.LCP_CAP + 1)
