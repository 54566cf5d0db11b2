"""Long lists of children are aligned as short ones are."""

import random

from strandline.llm import dom


class Plain:
    def __init__(self, sign, kids=()):
        self.sign, self.kids = sign, list(kids)


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[-1], last[j + 1]))
    return row[-1]


def test_long_lists_have_the_largest_matching():
    rng = random.Random(3)
    a, b = ("".join(rng.choice("abc") for _ in range(260)) for _ in range(2))  # 67,600 cells
    size, pairs = dom.matching(Plain("r", map(Plain, a)), Plain("r", map(Plain, b)))
    assert size == len(pairs) == 1 + longest(a, b)


def test_a_text_in_a_long_list_keeps_its_node():
    """The first item is missing on one page: in one pass all that follows would meet the wrong nodes."""
    a, b = ("".join("ab"[k % 2] for k in range(n)) for n in (401, 400))
    size, _ = dom.matching(Plain("r", map(Plain, "c" + a)), Plain("r", map(Plain, a[1:] + "c")))
    assert size == 1 + longest("c" + a, a[1:] + "c") and len(b) == 400
