"""The few places that a splice asks for are those of the library's list of offsets, which is not built."""

import pytest

from veridex.llm import tokens
from veridex.llm.queries import tokenizer_path

TEXT = "Some words, and 12 more;  it's late\n\n漢字。 Größe! " * 40


def test_places_are_those_of_the_offsets():
    tok = tokens.tokenizer(tokenizer_path("byte_bpe_50k.json"))
    e, first = tokens.Encoded(tok, TEXT, 7, len(TEXT)), {}
    for k, (a, _) in enumerate(tok.encode(TEXT[7:], add_special_tokens=False).offsets):
        first.setdefault(a + 7, k)
    stable = [m.start() for m in tokens.STABLE.finditer(TEXT, 8)]
    assert [e.token(p) for p in stable] == [first.get(p) for p in stable]
    assert len([p for p in stable if p in first]) > 100


def test_splices_build_no_list_of_offsets():
    class Watched:
        def __init__(self, tok):
            self.tok = tok

        def encode(self, *args, **kwargs):
            return Bare(self.tok.encode(*args, **kwargs))

    class Bare:
        def __init__(self, e):
            self.e, self.char_to_token, self.token_to_chars = e, e.char_to_token, e.token_to_chars

        def __len__(self):
            return len(self.e)

        @property
        def offsets(self):
            pytest.fail("all offsets were asked for")

    c = tokens.TokenCounts(tokenizer_path("byte_bpe_50k.json"), 200, 50)
    want = len(c.tok.encode(TEXT, add_special_tokens=False))
    c.tok = Watched(c.tok)
    assert c.spliced(TEXT) == want
