import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textveil.llm.crc import joined_crc32
from textveil.llm.packing import SIZE, cut, pack, plan
from textveil.llm.token_counts import token_counts
from textveil.llm.token_files import from_planes, read_ids, read_token_files, to_planes, write_token_files
from textveil.llm.tokens import PLAIN, TextEncoder

VOCABULARY, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, part int, tie long, row string, n_tokens string"
ODD = ["", None, " ", "a  b", " a b ", "x<|endoftext|>y", "don't  's 'll", "a\n\n b\t c", "a\x1c b", "日本 語 1234 ½", "é ñ ß", "lone퟿", "w " * 3000]
ROWS = [(k, t, 1, 2, "x", "y") for k, t in enumerate(ODD)] + [(3, "a  b", 1, 1, "", ""), (3, "a  b", 1, 1, "", ""), (None, "no id", 1, 1, "", "")]


@pytest.fixture(scope="module")
def known():
    return TextEncoder(VOCABULARY, RANKS)


def library_ids(known, text):
    return known.library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t.,'aZé0 \x1c ")), max_size=40))
def test_ids_equal_the_library(text):
    known = test_ids_equal_the_library.known
    assert known.ids(text).tolist() == library_ids(known, text)
    assert known.count(text) == len(library_ids(known, text))


test_ids_equal_the_library.known = TextEncoder(VOCABULARY, RANKS, most_units=50)


def test_fast_alphabet_equals_the_library(known):
    letters = [chr(c) for c in range(0x20, 0x250) if known.ranks and __import__("textveil.llm.tokens", fromlist=["PLAIN"]).PLAIN.fullmatch(chr(c))] + ["\n"]
    rng = random.Random(1)
    for a in letters:
        for text in (f" {a}", f"x{a}y", f" {a}{a}1{a}", "".join(rng.choices(letters, k=12)).strip() or "x"):
            assert known._encode(text) == library_ids(known, text), repr(text)


PLAIN_TEXTS = st.text(st.one_of(st.sampled_from(" \n"), st.sampled_from(" \n.,'aZ09étsĀ"), st.characters(min_codepoint=0x20, max_codepoint=0x7E), st.characters(min_codepoint=0xD8, max_codepoint=0xF6)), max_size=60)


@settings(max_examples=500, deadline=None)
@given(PLAIN_TEXTS)
def test_plain_texts_as_a_whole_equal_the_library(text):
    known = test_ids_equal_the_library.known
    if PLAIN.fullmatch(text) and not known._special(text):
        assert known._plain(text) and known._plain_ids(text).tolist() == library_ids(known, text)


def test_plain_texts_are_looked_up_by_no_unit(known):
    rng = random.Random(4)
    words = [f"{rng.choice(['Und', 'the', 'ñé', 'x9', '(a', 'don' + chr(39) + 't'])}{rng.randrange(10**4)}" for _ in range(30000)]
    before = len(known.ids_of)
    for text in ("a  b \n\n c ", " ".join(words), "  ".join(words), "\n".join(words)):  # longer than a piece
        assert known.ids(text).tolist() == library_ids(known, text)
    assert len(known.ids_of) == before


def test_long_words_and_white_space_are_not_given_as_a_whole(known):
    for text in ("a" * 200 + " b", "b " + "é" * 100, "a" + " " * 300 + "b", "a" + " \n" * 150 + "b", "x" * 100_000, " " * 100_000, "\n" * 5000 + "a"):
        assert not known._plain(text)
        assert known.ids(text).tolist() == library_ids(known, text)


def test_counts_and_edge_rows(spark, known):
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit): n for r, n in Counter(token_counts(spark.createDataFrame(ROWS, SCHEMA), VOCABULARY, RANKS).collect()).items()}
    want = Counter((i, len((t or "").encode()), len(library_ids(known, t)), len(library_ids(known, t)) > 512) for i, t, *_ in ROWS)
    assert got == want
    assert token_counts(spark.createDataFrame([], SCHEMA), VOCABULARY, RANKS).count() == 0


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_planes_round_trip(kind):
    rng = np.random.default_rng(0)
    for ids in (np.array([0]), np.array([50256, 1]), rng.integers(0, 50257, 4097), rng.integers(0, 1 << 32, 100)):
        assert (from_planes(to_planes(ids, kind), len(ids), kind) == ids).all()


def test_joined_crc32():
    for a, b in ((b"", b""), (b"a", b""), (b"", b"b"), (b"x" * 1000, b"y" * 77777)):
        assert joined_crc32(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_token_files(spark, known, tmp_path, kind):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    write_token_files(docs, path := str(tmp_path / "files"), VOCABULARY, RANKS, block=100, planes=kind)
    got = sorted(read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in ROWS), key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        ids = next(library_ids(known, t) + [0] for i, t, *_ in ROWS if i == r.doc_id)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert read_ids(spark.read.parquet(path)).selectExpr("sum(size(ids))").first()[0] == at
    write_token_files(spark.createDataFrame([], SCHEMA), path := str(tmp_path / "none"), VOCABULARY, RANKS)
    assert read_token_files(spark, path).count() == 0


def test_plan_uses_all_and_is_near_the_bound():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 3000):
        lengths = np.clip(rng.lognormal(6, 1, n).astype(int) + 1, 1, SIZE)
        planned, used = plan(Counter(lengths.tolist())), Counter()
        for pattern, times in planned:
            assert sum(pattern) <= SIZE and times > 0
            for x in pattern:
                used[x] += times
        assert used == Counter(lengths.tolist())
        if n:
            assert sum(t for _, t in planned) <= -(-int(lengths.sum()) // SIZE) * 1.02 + 1
    assert plan({1500: 2, 548: 1, 300: 1, 248: 1})[:2] == [((1500, 548), 1), ((1500, 300, 248), 1)]


def test_pack(spark, known):
    assert cut(2048) == [(0, 2048)] and cut(2049) == [(0, 1), (1, 2048)] and cut(4096) == [(0, 2048), (2048, 2048)]
    got = pack(spark.createDataFrame(ROWS, SCHEMA), VOCABULARY, RANKS, group=3).collect()
    want = Counter()
    for i, t, *_ in ROWS:
        ids = library_ids(known, t) + [0]
        want.update((i, k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())) for k, (at, n) in enumerate(cut(len(ids))))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= SIZE
    assert pack(spark.createDataFrame([], SCHEMA), VOCABULARY, RANKS).count() == 0
