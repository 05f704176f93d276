"""Ids of every code point, and of mixtures with those that Python's tables do not know, against the library."""

import random
import unicodedata
from array import array

from rulelens.llm.bpe import Codec
from rulelens.llm.queries import vocabulary
from tokenizers import Tokenizer


def test_every_code_point_is_classed_as_the_library_does():
    ours, library = Codec(vocabulary()), Tokenizer.from_file(vocabulary())
    texts = [f"a{chr(p)}b1" for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    for at in range(0, len(texts), 50_000):
        some = texts[at : at + 50_000]
        for text, want in zip(some, library.encode_batch(some, add_special_tokens=False), strict=True):
            assert ours.encode(text) == array("I", want.ids).tobytes(), ascii(text)


def test_unknown_code_points_are_normalised_as_the_library_does():
    ours, library, rnd = Codec(vocabulary()), Tokenizer.from_file(vocabulary()), random.Random(5)
    unknown = [chr(p) for p in range(0x33480) if unicodedata.category(chr(p)) == "Cn" and (0x1C80 <= p <= 0x1C8F or 0xA7C0 <= p <= 0xA7FF or 0x105C0 <= p <= 0x105FF or 0x11380 <= p <= 0x113FF or 0x16100 <= p <= 0x16EFF)]
    other = [*"aZ1 Σςé'", "́", "̇", "̣", "\U000105d2", "한", "\U0001f600", "'s"]
    for _ in range(4000):
        text = "".join(rnd.choice(unknown if rnd.random() < 0.4 else other) for _ in range(rnd.randint(1, 12)))
        assert ours.encode(text) == array("I", library.encode(text, add_special_tokens=False).ids).tobytes(), ascii(text)
