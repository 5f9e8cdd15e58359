import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from gridloom.llm import bpe, token_files
from tokenizers import Tokenizer

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _odd_texts():
    pick = random.Random(3)
    space = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", " ", "　"]
    words = ["a", "the", "don't", "é", "中文", "😀", "1²", "Ⅷ", "!!", "_", "<|endoftext|>", "x" * 70, "ab" * 90, "'S", "ſ"]
    return ["".join(pick.choice(space if pick.random() < 0.4 else words) for _ in range(pick.randint(0, 25))) for _ in range(600)] + ["z" * 20_000]


def test_encoder_equals_library(library):
    own, texts = bpe._table(RANKS, P.PATTERN), _odd_texts()
    ids, bounds = own[1].texts(texts)
    assert [x.tolist() for x in np.split(ids, bounds[1:-1])] == [library.encode_ordinary(t) for t in texts]
    raw, ends = own[0].decode(ids, bounds)
    assert [x.tobytes().decode() for x in np.split(raw, ends[1:-1])] == texts


def test_bpe_digests(spark, docs, none, library):
    got = bpe.digests(bpe.encode(docs, RANKS, P.PATTERN, decoded=True)).collect()
    want = []
    for r in docs.collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert bpe.encode(none, RANKS, P.PATTERN).count() == 0


def test_token_files(spark, docs, none, sf, tmp_path):
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    odd = spark.createDataFrame(list(enumerate(_odd_texts())), "doc_id long, text string")
    control = spark.createDataFrame(list(enumerate(_control_texts(2000))), "doc_id long, text string")
    for n, df in enumerate((docs, spark.read.parquet(f"{sf}/documents.parquet"), odd, control)):
        files = token_files.write_token_files(df, P.path("byte_bpe_50k.json"), length=64, path=str(tmp_path / str(n)))
        got = token_files.read_token_files(spark, files).orderBy("start").collect()
        rows = sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
        at = 0
        for g, r in zip(got, rows, strict=True):
            ids = np.array([*own.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
            assert tuple(g) == (r.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
            at += len(ids)
        first = token_files.Sequences(files[0][0])
        assert len(first[0][0]) == 64 and len(first) == -(-files[0][3] // 64)
    assert token_files.read_token_files(spark, token_files.write_token_files(none, P.path("byte_bpe_50k.json"))).count() == 0


def test_added_tokens_in_texts(spark):
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    df = spark.createDataFrame(list(enumerate(["a <|endoftext|> b", "x<|endoftext|>, y", "c"])), "doc_id long, text string")
    for added in (True, False):
        own.encode_special_tokens = not added
        got = token_files.read_token_files(spark, token_files.write_token_files(df, P.path("byte_bpe_50k.json"), added=added)).orderBy("start").collect()
        want = [[*own.encode(t, add_special_tokens=False).ids, 0] for t in ("a <|endoftext|> b", "x<|endoftext|>, y", "c")]
        assert (50256 in want[0]) == added
        assert [(g.n_tokens, g.ids_crc32) for g in got] == [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in want]


def _control_texts(n):
    """Short texts over all control characters, the signs of words and numbers, commas and full stops."""
    pick = random.Random(n)
    signs = [*map(chr, range(32)), "\x7f", *map(chr, range(0x80, 0xA1)), *"  , . , .\n", "a", "the", "é", "1", "_", "'s", "-"]
    return ["a \x02 b", "a \x03", "\x02", "a, \x02 \x03.", *("".join(pick.choices(signs, k=pick.randint(1, 12))) for _ in range(n))]


def test_control_characters(library):
    own, table = bpe._table(RANKS, P.PATTERN)
    texts = _control_texts(20_000)
    ids, bounds = table.texts(texts)
    assert [x.tolist() for x in np.split(ids, bounds[1:-1])] == [library.encode_ordinary(t) for t in texts]
    raw, ends = own.decode(ids, bounds)
    assert raw.tobytes().decode() == "".join(texts) and ends[-1] == len(raw)


@pytest.mark.parametrize("pattern", [r"\S+|\s+", r"[^,]+|,", r"(?s).+"])
def test_patterns_that_split_elsewhere_are_errors(pattern):
    with pytest.raises(ValueError):
        bpe._table(RANKS, pattern)


@pytest.mark.parametrize("text", ["{}'s", "a{}'ll 1", "'s{}", "{}, a", "1{}2 {}."])
def test_every_character_is_of_the_library_s_class(library, text):
    own = bpe._table(RANKS, P.PATTERN)[0]
    signs = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    step = 1 if text == "{}'s" else 7
    known = regex.compile(f"[{bpe.NEWER}]")
    texts = [text.format(c, c) for n, c in enumerate(signs) if n % step == 0 or known.match(c)]
    ids, each = own.encode_pieces(texts)
    ends, flat = np.cumsum(each).tolist(), ids.tolist()
    assert [t for t, i, j in zip(texts, [0, *ends], ends, strict=False) if flat[i:j] != library.encode_ordinary(t)] == []


def test_newer_letters_within_texts(library):
    table = bpe._table(RANKS, P.PATTERN)[1]
    texts = ["\u0558's", "a \u0558, b", "x\u0558.\n\U000323b0\U000323b1's go", "é \u0558'll 1\U0001e6fe, ok"]
    ids, bounds = table.texts(texts)
    assert [x.tolist() for x in np.split(ids, bounds[1:-1])] == [library.encode_ordinary(t) for t in texts]


def test_a_very_long_text(library, spark):
    text = "The quick, brown fox's 12 jumps.\n" * 60_000 + "x" * 40_000
    got = bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), RANKS, P.PATTERN).first()
    assert np.frombuffer(got.ids, "<u4").tolist() == library.encode_ordinary(text)
