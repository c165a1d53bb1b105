"""What a worker forgets: stretches met once go, those that come again stay, and the ids are the library's."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from clientele.llm.tokens import StretchEncoder


@pytest.mark.parametrize("name, blank", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_stretches_that_come_again_are_learned_once(name, blank):
    chance = random.Random(4)
    word = lambda: "".join(chance.choice("abcdefghij") for _ in range(9))
    common = [word() for _ in range(60)]
    batches = [
        [" ".join([word(), *chance.sample(common, 60), *(word() + "," for _ in range(40)), chance.choice(common) + ".", "a\n b"])]
        for _ in range(30)
    ]
    path = public_tokenizers.path(name)
    encoder, library = StretchEncoder(path, blank, remembered=300), Tokenizer.from_file(path)
    learned: dict[str, int] = {}
    real = encoder._add

    def add(stretches, ids, counts):
        for stretch in stretches:
            learned[stretch] = learned.get(stretch, 0) + 1
        real(stretches, ids, counts)

    encoder._add = add
    for texts in batches:
        ids, starts = encoder.flat(texts)
        for at, text in enumerate(texts):
            assert ids[starts[at] : starts[at + 1]].tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(encoder._number) < 600
    assert all(learned[c] == 1 for c in common)
