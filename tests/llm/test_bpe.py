import hashlib
import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm.bpe import Codec, Decoder, Transducer, check

PATH = public_tokenizers.path("word_bpe_49k.json")
SOURCE = open(PATH, "rb").read()


@pytest.fixture(scope="module")
def both():
    return Codec(SOURCE), Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def small():
    """The same in pieces of 40 characters: words go on over many of them."""
    return Codec(SOURCE, piece=40)


def ids(codec, text):
    packed = b"".join(p for some in codec.encode(text) for p in some)
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def decoded(codec, text):
    return "".join(codec.decode(codec.encode(text)))


TEXTS = [
    "", " ", "a", "Hello, World!!! it's 2024 — we'll see", "ΣΊΣΥΦΟΣ Σ", "İstanbul ǅ ß", "é é́", "日本語テキスト 🙂🙂", "x" * 3000, "ab" * 1500, "!" * 999,
    "<|endoftext|> in <|startoftext|>text", "a\x1cb\x85c d e​f", "½ Ⅷ ² 1234", "don't DON'T 'S 'll", "</w> a</w>b", "\r\n\t\x0b\x0c", "Éèç œuvre naïve",
]


@pytest.mark.parametrize("text", TEXTS)
def test_as_the_library(both, small, text):
    codec, library = both
    want = library.encode(text, add_special_tokens=False).ids
    for one in (codec, small):
        assert ids(one, text) == want
        assert decoded(one, text) == library.decode(want, skip_special_tokens=False)


def test_pieces_cut_no_word_and_no_character(both, small):
    codec, library = both
    rng = random.Random(3)
    bits = ["the ", "and", "'s", "'ll", "'", "!", "...", "é", "e\u0301", "日本語", "テキスト", "🙂", "\n", "\t", "\u00a0", " ", "x" * 100, "ΣΑΣ", "İ", "1", "22"]
    bits += ["<|endoftext|>", "<|end", "가", "\u1100\u1161\u11a8", "\u0316\u0300", "\u0928\u093c", "</w>", "\u3000", "-" * 70, "ab" * 60, "'" * 50]
    for _ in range(400):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 60)))
        want = library.encode(text, add_special_tokens=False).ids
        assert ids(small, text) == want, text
        assert decoded(small, text) == library.decode(want, skip_special_tokens=False), text


def test_memory_does_not_grow_with_the_text():
    import tracemalloc

    def peak(text):
        codec = Codec(SOURCE, piece=4096)
        codec.packed.most = codec.shown.most = 0
        tracemalloc.start()
        tokens = sum(len(p) // 4 for some in codec.encode(text) for p in some)
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return tokens, top

    for unit in ("the and ion ", "theandion"):  # many words; one word
        short, long = peak(unit * 2_000), peak(unit * 16_000)
        assert long[0] > 7 * short[0] and long[1] < short[1] + 200_000


def test_other_tokeniser_files_are_refused():
    import json

    for change in ({"normalizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}, {"decoder": {"type": "WordPiece"}}, {"post_processor": {"type": "ByteLevel"}}):
        with pytest.raises(ValueError):
            check(json.loads(SOURCE) | change)
    spec = json.loads(SOURCE)
    spec["model"]["dropout"] = 0.1
    with pytest.raises(ValueError):
        check(spec)


def test_random_words_as_the_library(both):
    codec, library = both
    rng = random.Random(5)
    for alphabet in ("ab", "the", "etaoinshrd", "abcdefghijklmnopqrstuvwxyz", "éèçàaeiou", "!?.,-", "aàあ🙂"):
        for _ in range(150):
            text = " ".join("".join(rng.choice(alphabet) for _ in range(rng.choice([1, 3, 8, 20, 400 if _ % 30 == 0 else 12]))) for _ in range(3))
            assert ids(codec, text) == library.encode(text, add_special_tokens=False).ids, text


def test_memory_of_the_transducer_is_bounded(both):
    codec, library = both
    word = "".join(random.Random(1).choice("theandion") for _ in range(20_000))
    one = Transducer(codec.merges, every=64)
    early = [t for k in range(0, len(word) - 1, 97) for t in one.feed(word[k : min(k + 97, len(word) - 1)])]
    tokens = early + one.feed(word[-1], True)
    assert tokens == library.encode(word, add_special_tokens=False).ids
    assert one.most <= 64 + 10 * codec.merges.longest < codec.merges.lookahead and len(early) > 1000


def test_decoder_state_machine_splits_characters():
    spec = {"model": {"vocab": {"ðŁ": 0, "ĻĤ": 1, "a": 2}}, "added_tokens": [], "decoder": {"type": "ByteLevel"}}
    one = Decoder(spec)
    feed = lambda i: one.feed(one.token_bytes(struct.pack("<I", i)))
    assert [feed(2), feed(0), feed(1), feed(0), one.end()] == ["a", "", "🙂", "", "�"]


def test_digests(spark):
    from tessera.llm.bpe import encode_table

    rows = [(1, "Hello the world"), (2, None), (3, ""), (3, ""), (None, "null key")]
    df = spark.createDataFrame([(k, t, 9) for k, t in rows], "doc_id long, text string, n_tokens int")
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256) for r in encode_table(df, "doc_id", "text", PATH).collect())
    library = Tokenizer.from_file(PATH)
    want = []
    for k, t in rows:
        i = library.encode(t or "", add_special_tokens=False).ids
        want.append((k or 0, len(i), hashlib.sha256(struct.pack(f"<{len(i)}I", *i)).hexdigest()))
    assert got == sorted(want)
    assert encode_table(df.limit(0), "doc_id", "text", PATH).count() == 0
