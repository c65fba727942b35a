import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sessionlogs.llm import bytefiles, idcoder, token_output
from tests.llm.helpers import awkward, documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [0, 1, 2, 127, 128, 1000, 40_000])
@pytest.mark.parametrize("most", [1, 2, 300, 60_000, 2**21])
def test_blocks_round_trip(n, most):
    ids = np.random.default_rng(n + most).integers(0, most, n).astype(np.uint32)
    assert (idcoder.decode(idcoder.encode(ids)) == ids).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=600))
def test_any_ids_round_trip(ids):
    ids = np.array(ids, np.uint32)
    assert (idcoder.decode(idcoder.encode(ids)) == ids).all()


def test_skewed_ids_take_few_bits():
    rng = np.random.default_rng(1)
    ids = np.tile(rng.integers(0, 50_000, 500), 200).astype(np.uint32)
    assert len(idcoder.encode(ids)) < 0.4 * 2 * len(ids)


def test_damage_is_found():
    block = bytearray(idcoder.encode(np.arange(1000, dtype=np.uint32)))
    for at in (0, 5, 30, len(block) - 1):
        bad = bytearray(block)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            idcoder.decode(bytes(bad))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab é漢1!'\n\t  \u0085\x1c<|>"), max_size=40), min_size=1, max_size=5))
def test_words_are_encoded_as_in_whole_texts(texts):
    words, whole = token_output._words(PATH), Tokenizer.from_file(PATH)
    ids, lengths = words.encode(texts)
    want = [whole.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    assert ids.tolist() == [i for x in want for i in x]
    assert lengths.tolist() == [len(x) for x in want]


def test_files_hold_all_documents_in_order(spark, tmp_path):
    df = awkward(spark)
    token_output.write(df, str(tmp_path / "ids"), PATH, files=3, block_ids=1000)
    found = token_output.with_starts(token_output.read(spark, str(tmp_path / "ids"))).orderBy("start").collect()
    whole = Tokenizer.from_file(PATH)
    rows = sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    assert len(found) == len(rows)
    for got, (doc_id, text) in zip(found, rows, strict=True):
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        assert (got.doc_id, got.start, got.n_tokens, got.ids_crc32, got.ids) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()), ids.tolist())
        start += len(ids)


def test_empty_table(spark, tmp_path):
    token_output.write(documents(spark, []), str(tmp_path / "ids"), PATH, files=2)
    assert token_output.with_starts(token_output.read(spark, str(tmp_path / "ids"))).count() == 0


def test_streams_are_cut_after_zero_bytes():
    rng = np.random.default_rng(3)
    stream = [rng.integers(0, 4, rng.integers(0, 1 << 21)).astype(np.uint8).tobytes() for _ in range(8)] + [b"\1\0"]
    assert b"".join(r + b"\0" for r in bytefiles.cut(stream)) == b"".join(stream)
    with pytest.raises(ValueError):
        list(bytefiles.cut([b"a"]))
