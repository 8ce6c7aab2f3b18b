"""The memo of words' ids."""

import numpy as np
import public_tokenizers

from cartolith.llm.token_files import WordEncoder


def test_words_that_come_again_are_encoded_once():
    own = WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    asked, encode = [], own.pool.encode
    own.pool.encode = lambda words: (asked.append(len(words)), encode(words))[1]
    words = [f"w{i:x}" for i in range(300_000)]
    texts = [" ".join(words[i : i + 30_000]) for i in range(0, len(words), 30_000)]
    first = [own.encode([t]) for t in texts]
    assert sum(asked) == len(words)
    again = [own.encode([t]) for t in texts]
    assert sum(asked) == len(words)
    assert all((a[0] == b[0]).all() and (a[1] == b[1]).all() for a, b in zip(first, again))
    few = " ".join([*words[:50], "", "Zürich", *words[:50]])
    assert own.encode([few, None])[0].tolist() == own.lib.encode(few, add_special_tokens=False).ids
    assert np.diff(own.encode([few, None])[1])[1] == 0
