import random

import numpy as np
import public_tokenizers
import pyarrow as pa

from marketops.llm import pieces, token_files

FILE = public_tokenizers.path("byte_bpe_50k.json")


def counted(coder):
    """The words that the model is asked for from now on."""
    asked, merged = [], coder.merged
    coder.merged = lambda words: asked.extend(words) or merged(words)
    return asked


def test_any_white_space_gives_the_ids_of_the_plain_call():
    rng, coder = random.Random(3), token_files.Coder(FILE, False)
    cache = pieces.PieceCache("test of white space", coder.pieces, 50)
    alphabet = [*"aab  BC \n\t'.,s9²é\x1c\x85\xa0\xad 漢🙂", " the", " x<|endoftext|>", *rng.sample(token_files.LATIN, 40)]
    for _ in range(60):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(20)]
        data, ends = coder.encode(pa.array(texts, pa.string()), cache, b"\0\0")
        want = [np.array([*coder.tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u2").tobytes() for t in texts]
        assert [data[i:j].tobytes() for i, j in zip([0, *ends[:-1]], ends, strict=True)] == want


def test_the_model_merges_a_word_once_however_often_it_occurs():
    coder = token_files.Coder(FILE, False)
    asked = counted(coder)
    cache = pieces.PieceCache("test of words", coder.pieces, token_files.PIECES)
    words = ["q" + "".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(200_000)]
    for _ in range(2):
        for i in range(0, len(words), 50_000):
            cache(pa.array(["- " + " ".join(words[i : i + 50_000]), "- " + " ".join(w + "." for w in words[i : i + 50_000])]))
    assert len(asked) == len(set(asked)) == len(words) + 2


def test_long_strings_are_not_remembered():
    cache = pieces.PieceCache("test of long strings", lambda new: [p.encode() for p in new], 1000)
    texts = [c * 100_000 for c in "abc"] + ["x " + c * 100_000 for c in "def"]
    for _ in range(2):
        data, ends = cache(pa.array([*texts, None]))
        assert data.tobytes().decode() == "".join(texts) and ends.tolist() == np.cumsum([*map(len, texts), 0]).tolist()
    assert set(cache.first) == {"x", ""}
    assert not cache.later.young
