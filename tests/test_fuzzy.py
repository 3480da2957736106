"""The similarity of sequences against the standard library's."""

import random
from difflib import SequenceMatcher

from loomgraph.functions.fuzzy import longest_common, sequence_similarity


def test_similarity_equals_the_library():
    rng = random.Random(5)
    for case in range(400):
        letters = "ab" if case % 2 else "abcdefg "
        a = "".join(rng.choices(letters, k=rng.randrange(0, 60)))
        b = a if case % 3 == 0 else "".join(rng.choices(letters, k=rng.randrange(0, 60)))
        if case % 3 == 0 and a:
            cut = rng.randrange(len(a))
            b = b[:cut] + "zz" + b[cut + rng.randrange(3) :]
        matcher = SequenceMatcher(None, a, b, autojunk=False)
        assert longest_common(a, b) == (tuple(matcher.find_longest_match()) if matcher.find_longest_match().size else (0, 0, 0))
        assert sequence_similarity(a, b) == matcher.ratio()
        least = sequence_similarity(a, b, 0.8)
        assert least == (matcher.ratio() if matcher.ratio() >= 0.8 else least) and least <= matcher.ratio()


def test_long_repetitive_texts_take_no_square_of_time():
    a = "absent words. " + "the cat sat on the mat " * 4000
    assert sequence_similarity(a, a[14:], 0.8) > 0.99
