import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kgspark.llm import bpe
from tests.llm.conftest import prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(PATH)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="aA \n\t'sl.é漢😀0<|endoftext|>", max_size=60)), max_size=6))
def test_same_ids_as_the_library(texts):
    library = Tokenizer.from_file(PATH) if not hasattr(test_same_ids_as_the_library, "t") else test_same_ids_as_the_library.t
    test_same_ids_as_the_library.t = library
    own = bpe.loaded(PATH)
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert own.decode(ids) == text


def test_runs_and_special_tokens(reference):
    texts = ["a" * n for n in range(1, 40)] + ["<|endoftext|>", "x<|endoftext|><|endoftext|> y", "aaaa bbbb  cc   \n\n d"]
    for text, ids in zip(texts, bpe.loaded(PATH).encode(texts), strict=True):
        assert ids.tolist() == reference.encode(text, add_special_tokens=False).ids


def test_table(docs, reference):
    texts = [None, "", "Hello wörld 12", "Hello wörld 12", prose(1, 30_000), "\x00 ﷽ 🇩🇪"]
    rows = bpe.encode_decode(docs(texts, [0, None, 2, 2, 4, 5]), PATH).collect()
    assert len(rows) == len(texts) and {r.doc_id for r in rows} == {0, None, 2, 4, 5}
    by_text = {r.decoded: r.token_ids for r in rows}
    for text in texts:
        want = reference.encode(text or "", add_special_tokens=False).ids
        assert by_text[text or ""] == b"".join(i.to_bytes(4, "little") for i in want)


def test_decode_and_empty_table(docs):
    assert bpe.encode_decode(docs([]), PATH).count() == 0
    done = bpe.encode_decode(docs(["one two", None]), PATH)
    assert sorted(r.decoded for r in bpe.decode(done, PATH).collect()) == ["", "one two"]


def test_query_hashes(spark, tmp_path, docs):
    from kgspark.llm import queries

    docs(["", "word"]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in queries.op8_bpe(spark, str(tmp_path)).collect()}
    assert rows[0].n_tokens == 0 and rows[0].ids_sha256 == rows[0].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[1].decoded_sha256 == hashlib.sha256(b"word").hexdigest()


def test_words_equal_the_library_for_all_code_points():
    """Every code point beside letters, digits, signs, spaces, itself and its neighbour is cut into words as the library does."""
    own, library = bpe.loaded(PATH), Tokenizer.from_file(PATH).pre_tokenizer
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 20_000):
        part = points[k : k + 20_000]
        for text in ("".join(f"a{c}1{c}!{c} {c}\n{c}{c}" for c in part), "".join(part), "".join(f"{a}{b} " for a, b in zip(part, reversed(part), strict=True))):
            assert own.split(text) == [text[a:b] for _, (a, b) in library.pre_tokenize_str(text)]
    assert own.split("\U00011dc8蜛") == ["\U00011dc8", "蜛"]
