import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from gavelyard.llm import pieces
from gavelyard.llm.pieces import BPE, UNIGRAM, Model
from gavelyard.llm.tokens import Encoder, lone_spaces

BYTE_BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def texts(n, alphabet="ab  \n\té中文🙂teinonr's▁.,12  <|endoftext|>$"):
    rng = random.Random(4)
    fixed = ["", " ", "  ", "\n", "a  b", " a", "a ", "\0a", "\x1c a", "a  b", "isn't it, here? 1234 http://x.y", "<|endoftext|>", "The The\n\nThe.", "word " * 300]
    return fixed + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)] + [" " * k + "x" for k in range(20)]


def ids(packed):
    return np.frombuffer(packed, dtype="<u4").tolist()


def test_byte_bpe_equals_the_library():
    encoder = Encoder(BYTE_BPE, most_cached=500)
    given = texts(1500)
    want = [x.ids for x in encoder.tokenizer.encode_batch(given, add_special_tokens=False)]
    got = [ids(x) for k in range(0, len(given), 100) for x in encoder.ids(given[k : k + 100])]
    assert got == want and encoder.ids([None]) == [b""]


def test_texts_with_nul_equal_the_library():
    encoder, rng = Encoder(BYTE_BPE), random.Random(8)
    given = ["x \0a", "a \0 b", "\0a b", "a\0b c", "x \0", "\0", " \0", "x \0\0a", *("".join(rng.choice("ab \0\n.é") for _ in range(12)) for _ in range(500))]
    assert [ids(x) for x in encoder.ids(given)] == [x.ids for x in encoder.tokenizer.encode_batch(given, add_special_tokens=False)]


def test_lone_spaces_by_definition():
    spaces = [c for c in map(chr, range(0x110000)) if c.isspace()]
    given = [x for c in spaces for x in (c, f"a{c}b", f"a{c} b", f"a {c}b", f"{c}a b", f"a b{c}", f"a{c}{c}b c")]
    for text in [*given, *texts(1500), *texts(800, "ab \n"), "中 文 \u3000", "a\x1c b"]:
        assert lone_spaces(text) == (len(re.findall(r"(?<=\S) (?=\S)", text)) == text.count(" ")), text


def test_known_words_cost_little_beside_their_look_up():
    """A text of remembered words takes about the time of dividing it and looking each word up; nothing else visits all characters."""
    rng, encoder = random.Random(3), Encoder(BYTE_BPE)
    words = ["".join(rng.choice("abdeinort") for _ in range(rng.randint(4, 12))) for _ in range(200)]
    given = [" ".join(rng.choices(words, k=500)) for _ in range(200)]
    encoder.ids(given)
    get = encoder.known.__getitem__

    def least(f):
        took = []
        for _ in range(9):
            began = time.thread_time()
            f()
            took.append(time.thread_time() - began)
        return min(took)

    assert least(lambda: encoder.ids(given)) < 2 * least(lambda: [b"".join(map(get, x.split(" ")[1:])) for x in given])


@pytest.fixture(scope="module")
def model_bytes():
    with open(PIECES, "rb") as f:
        return f.read()


def test_pieces_equal_the_library(model_bytes):
    model, library = Model(model_bytes, most_cached=300), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    given = texts(1200)
    assert model.kind == BPE
    assert [ids(model.encode(t)) for t in given] == library.encode(given)
    assert [model.decode(model.encode(t)) for t in given] == [t.replace("▁", " ") for t in given]
    assert model.encode(None) == b"" and model.decode(b"") == ""


def test_viterbi_scores_as_the_library_on_the_same_pieces_as_unigram(model_bytes):
    # the trainer's model type is the varint 2 (BPE) after this name; 1 is unigram
    patched = model_bytes.replace(b"\x12\x06tok_v0\x18\x02", b"\x12\x06tok_v0\x18\x01")
    assert patched != model_bytes
    model, library = Model(patched), sentencepiece.SentencePieceProcessor(model_proto=patched)
    given = [" ".join(t.split()) for t in texts(800, "abc teinonr lo wd,.") if t.isascii() and "\0" not in t and "\x1c" not in t]
    assert model.kind == UNIGRAM
    total = lambda found: sum(model.scores[i] for i in found)  # noqa: E731  several splits may tie for the best
    got, want = [ids(model.encode(t)) for t in given], library.encode(given)
    assert all(total(x) >= total(y) for x, y in zip(got, want, strict=True)) and sum(x == y for x, y in zip(got, want, strict=True)) > 0.99 * len(given)
    assert [model.decode(model.encode(t)) for t in given] == given


def test_pieces_in_spark(spark, model_bytes):
    """Whole tables through the operators: null, empty, repeated and very long texts, null ids, clashing names."""
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(7)
    spaceless = "".join(rng.choice("abcdeinortész") for _ in range(120_000))
    strange = "".join(rng.choice("ab🜁🜂") for _ in range(60_000))
    rows = [(1, None), (2, ""), (3, "a plain text"), (3, "a plain text"), (None, "no id"), (4, "word " * 100_000), (5, spaceless), (6, strange), (7, "▁ and \n\n two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as n_pieces", "3 as decoded")
    began = time.time()
    coded = pieces.encode_pieces(df, PIECES).collect()
    assert time.time() - began < 60
    key = lambda d, t: (d is None, d or 0, t)
    want = sorted(((d, library.encode(t or "")) for d, t in rows), key=lambda r: key(r[0], str(r[1])[:50]))
    assert sorted(((r.doc_id, r.ids) for r in coded), key=lambda r: key(r[0], str(r[1])[:50])) == want
    back = pieces.decode_pieces(pieces.encode_pieces(df, PIECES), PIECES).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(d), (t or "").replace("▁", " ")) for d, t in rows)
    digests = {(r.doc_id, r.n_pieces, r.ids_crc32) for r in pieces.piece_digests(df, PIECES).where("decoded").collect()}
    assert digests == {(d, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for d, x in want}
    none = df.limit(0)
    assert pieces.encode_pieces(none, PIECES).count() == pieces.piece_digests(none, PIECES).count() == pieces.decode_pieces(pieces.encode_pieces(none, PIECES), PIECES).count() == 0


def test_merging_by_definition(model_bytes):
    """The heap of candidates against the definition, one merge at a time over the whole text."""
    model = Model(model_bytes)

    def plainly(text):
        parts = list(text)
        while True:
            found = [(-model.scores[i], k) for k in range(len(parts) - 1) if (i := model.ids.get(parts[k] + parts[k + 1])) is not None]
            if not found:
                return parts
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    rng = random.Random(1)
    for n in [*range(30), *[60] * 60]:
        text = "".join(rng.choice("▁abteinor中🜁") for _ in range(n))
        assert model.merged(text) == plainly(text)
