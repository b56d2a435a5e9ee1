"""The vectorised matcher against the standard library's, on all kinds of pairs."""

import random
from difflib import SequenceMatcher

import pytest

from lectern.functions import diffs, matching

ALPHABETS = ["ab", "abc ", "abcdefghij klmnop", "etaoin shrdlu" * 5 + "qzjx", "一二三四五六七八九十，。", "a\U0001f600b\ud800é"]


def pairs():
    r = random.Random(6)
    for k in range(900):
        letters = ALPHABETS[k % len(ALPHABETS)]
        word = lambda n: "".join(r.choice(letters) for _ in range(n))
        a = word(r.choice([0, 1, 5, 40, 199, 200, 201, 450]))
        kind = k % 4
        if kind == 0:
            b = word(r.choice([0, 1, 5, 40, 199, 200, 201, 450]))
        elif kind == 1:  # a few edits
            b = list(a)
            for _ in range(r.randrange(6)):
                at = r.randrange(len(b) + 1)
                b[at : at + r.randrange(4)] = word(r.randrange(4))
            b = "".join(b)
        elif kind == 2:  # moved parts
            cut = r.randrange(len(a) + 1)
            b = a[cut:] + word(3) + a[:cut]
        else:
            b = a
        yield a, b


@pytest.mark.parametrize("autojunk", [True, False])
def test_blocks_and_operations_equal_the_library(autojunk):
    for a, b in pairs():
        m = SequenceMatcher(None, a, b, autojunk)
        assert matching.blocks(a, b, autojunk) == [tuple(x) for x in m.get_matching_blocks()[:-1]], (a, b)
        assert matching.operations(a, b, autojunk) == m.get_opcodes()
        if autojunk:
            assert matching.ratio(a, b) == m.ratio() <= matching.bound(matching.codes(a), matching.codes(b)) or not a or not b


def test_pairs_with_too_many_places_are_left_to_the_library(monkeypatch):
    monkeypatch.setattr(matching, "PLACES", 10)
    for a, b in list(pairs())[:60]:
        assert matching.blocks(a, b) == [tuple(x) for x in SequenceMatcher(None, a, b).get_matching_blocks()[:-1]]


def test_long_texts():
    r = random.Random(2)
    a = "".join(r.choice("etaoinshrdlu ,.") for _ in range(20_000))
    b = a[:7_000] + "X" * 50 + a[7_500:]
    assert matching.ratio(a, b) == SequenceMatcher(None, a, b).ratio()


def test_meaning():
    text = "a b，c。\t1-2_3 $x　é!"
    assert diffs.meaning(text) == "abc123$xé" == diffs.meaning("".join(text))


def test_nearest_equals_a_plain_comparison():
    """Every neighbour matched, the best taken: what the bounds may not change."""
    r = random.Random(11)

    def plain(text, own, near):
        if not text or not text.strip():
            return 0
        at_home = best = diffs.ratio(text, own)
        offset = 0
        for o, other in sorted(near):
            if (score := diffs.ratio(text, other)) > best:
                best, offset = score, o
        return offset if best >= 0.45 and best >= at_home + 0.2 else 0

    seen = set()
    for _ in range(1_500):
        word = lambda: "".join(r.choice("abcdefgh ,") for _ in range(r.choice([0, 1, 4, 12, 30])))
        texts = [word() for _ in range(5)]
        text = r.choice([r.choice(texts), word(), r.choice(texts) + word(), r.choice(texts)[: r.randrange(1, 20)]])
        near = [(o, texts[o + 2]) for o in (-2, -1, 1, 2)]
        got = diffs.nearest(text, texts[2], near)
        assert got == plain(text, texts[2], near)
        seen.add(got)
    assert seen == {-2, -1, 0, 1, 2}
    assert diffs.nearest(None, "a", []) == diffs.nearest("a", None, [(1, None)]) == diffs.nearest("，", "b", [(1, "，")]) == 0


def test_edits_of_long_texts_list_few_places(monkeypatch):
    """Of a text and its edited form only the places of long runs are listed, not all equal characters."""
    r, listed, runs = random.Random(3), [], matching._runs

    def counted(a, b, *more):
        found = runs(a, b, *more)
        listed.append(sum(found[1] - found[0]))
        return found

    monkeypatch.setattr(matching, "_runs", counted)
    for change in (("th", "TH"), ("e", "ee")):
        a = "".join(r.choice("thequ ansior") for _ in range(1_500))
        b = a.replace(*change)
        assert matching.blocks(a, b, False) == [tuple(x) for x in SequenceMatcher(None, a, b, False).get_matching_blocks()[:-1]]
    assert sum(listed) < 20 * 1_500
