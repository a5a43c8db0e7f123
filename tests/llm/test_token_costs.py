"""What encoding by stretches costs: stretches that are known are looked up once, and memory for cuts doesn't grow with the batch."""

import public_tokenizers
import pyarrow as pa
import pytest
from postloom.llm import token_files


class Counting(dict):
    reads = 0

    def get(self, key, default=None):
        self.reads += 1
        return super().get(key, default)

    def __contains__(self, key):
        self.reads += 1
        return super().__contains__(key)


@pytest.fixture
def encoder():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return token_files.StretchEncoder(f.read(), 2)


def test_known_stretches_are_looked_up_once(encoder):
    words = [f"w{i}".encode() for i in range(100)]
    encoder.known = Counting(zip(words, [b"xy"] * 100, strict=True))
    assert encoder._stretches(words) == [b"xy"] * 100
    assert encoder.known.reads == 100  # before: twice each


def test_cuts_do_not_depend_on_blocks(encoder, monkeypatch):
    texts = pa.array(["One,  two.\n\n three's  été\tx" * 9, "", " ", "a", "über \x1c das.\r\n Ende  ", "了 的　文 x"])
    want = [encoder._library([t.as_py().encode()])[0] for t in texts]
    for block in (1, 2, 3, 7, 1 << 15):
        monkeypatch.setattr(token_files, "BLOCK", block)
        assert encoder.encode_all(texts) == want
        assert encoder.encode_all(texts[2:]) == want[2:]


def test_generations_of_the_memo(encoder, monkeypatch):
    monkeypatch.setattr(token_files, "MEMO", 3)
    for k in range(6):
        words = [f"word{(k + i) % 7}".encode() for i in range(4)]
        assert encoder._stretches(words) == encoder._library(words)
    assert len(encoder.known) <= 8 and set(encoder.old) | set(encoder.known)
