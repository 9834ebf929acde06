"""Small tables with every odd case: nulls, empty and long texts, repeated rows, clashing columns."""

import random

WORDS = "river stone lamp garden window paper winter music bridge orange silver market".split()


def prose(seed: int, words: int = 120) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randint(0, 400)) for _ in range(words))


def rows() -> list[tuple]:
    base = prose(1)
    near = base.split()
    near[60] = "changed"
    out = [
        (1, base, "a", True, 5),
        (2, base, "a", True, 5),  # a copy
        (3, " ".join(near), "b", None, 5),  # a near copy
        (4, prose(4), "b", False, 5),
        (4, prose(4), "b", False, 5),  # a repeated row
        (5, None, "a", True, 5),
        (6, "", None, True, 5),
        (7, " \n\t ", "c", True, 5),
        (8, "two words", "c", True, 5),
        (9, prose(9, 40_000), "a", True, 5),  # very long
        (None, prose(10), "a", True, 5),
        (None, None, None, None, None),
        (11, "x" * 3_000_000, "c", True, 5),  # one very long word
        (12, 'key password = "hunter2hunter2" end é€' + prose(12), "a", True, 5),
    ]
    return out
