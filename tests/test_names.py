"""Names in turns of a stream are looked up, not tried one after the other."""

import random
import re
import time

from quaere.streaming.conversations import Names, Slots


def test_names_are_found_as_by_patterns():
    made = random.Random(3)
    names = ["".join(made.choice("ab# -é") for _ in range(made.randint(1, 6))) for _ in range(60)]
    ordered = sorted({*names}, key=lambda x: (-len(x), x))
    look = Names([(n, n) for n in ordered])
    for _ in range(3000):
        text = "".join(made.choice("ab# -é") for _ in range(made.randint(0, 14)))
        want = next((n for n in ordered if re.search(rf"\b{re.escape(n)}\b", text)), None)
        assert (look.first(text) or (None,))[0] == want


def test_many_names_take_no_longer():
    slots = Slots([(f"Supplier#{k:09d}", k) for k in range(60_000)], [])
    start = time.perf_counter()
    assert all(slots.step("word " * 60 + f"Supplier#{k:09d}?", "question", None)[1] == f"Supplier#{k:09d}" for k in range(500))
    assert time.perf_counter() - start < 10
