import random
import re
import time

import numpy as np

from siltmill.llm import abuse
from siltmill.llm.text_batch import TextBlock


def same_words(texts):
    """Whether each text, flagged or not, has the words it has when every text is rewritten."""
    got, first = abuse.word_buckets(abuse.respelled(texts, {}))
    all_, its = abuse.word_buckets(TextBlock([abuse.plain_spelling(t) for t in texts]))
    return np.array_equal(first, its) and np.array_equal(got, all_)


def test_signs_at_either_end_of_a_word():
    for text, plain in {"1diot": "idiot", "5hit": "shit", "!diot": "idiot", "as$": "ass", "a 1diot is here": "a idiot is here"}.items():
        assert abuse.respelled([text], {}).texts[0] == plain


def test_flagged_and_unflagged_texts_have_the_words_of_plain_spelling():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abst   @$!3015+€|27é,") for _ in range(rng.randint(0, 12))) for _ in range(20_000)]
    assert same_words(texts)
    assert all(same_words([t]) for t in texts[:4_000])


def test_known_words_do_not_depend_on_the_size_of_the_sample():
    for n in (40, 3_000):
        rows = [np.array([100 + i % 5, 200] if i < abuse.MIN_DOCUMENTS else [100 + i % 5, 201] if i < 5 else [100 + i % 5]) for i in range(n)]
        model = abuse.fit_network(rows, np.arange(n) % 2, steps=1)
        assert model.known[200] and not model.known[201]


def test_long_tokens_take_little_time():
    """Tokens of any length are read in as many steps as they have characters, with the same results as before."""
    began = time.monotonic()
    for t in ("a" * 45_000 + ".", "aB4" * 15_000, "ab!" * 15_000, "3" * 45_000 + "a", "a_" * 20_000):
        abuse.plain_spelling(t)
    assert time.monotonic() - began < 5
    old = re.compile(r"(?<![^\W\d_])[^\W\d_]*(?:[@$!3015+€|]+[^\W\d_]+)+|[^\W\d_]+(?:[@$3015€|]+[^\W\d_]*)+")
    rng = random.Random(2)
    for _ in range(20_000):
        t = "".join(rng.choice("ab$3!.4é") for _ in range(rng.randint(0, 9)))
        change = lambda m: m.group().translate(abuse.SIGNS)
        assert abuse._SIGNED.sub(change, t) == old.sub(change, t), t
