import re
import struct

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from relaylens.llm import sentencepieces as S
from tests.conftest import SF001
from tests.llm.helpers import AWKWARD, table

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  lead and  double ", "<s>x</s> <unk> <0x41>", "é́ 日本 \U0001f600\n\n\t\x00 z", "a" * 500, "▁marked ▁", " nbsp em"]


def field(number, value):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def unigram(path, fallback, remove_extra=True):
    """A small unigram model file."""
    words = {"▁": -2.0, "▁the": -3.0, "▁cat": -4.0, "c": -6.0, "a": -5.5, "t": -5.6, "s": -5.1, "▁s": -5.0, "at": -4.4, "sat": -4.2, "h": -7.0, "e": -7.1, "th": -6.1}
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if fallback else []
    pieces += [(w, s, 1) for w, s in words.items()]
    raw = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in pieces)
    raw += field(2, field(3, 1) + field(35, int(fallback))) + field(3, field(3, 1) + field(4, int(remove_extra)))
    path.write_bytes(raw)
    return str(path)


def parity(model, texts):
    codec, other = S.Codec(model), sentencepiece.SentencePieceProcessor(model_file=model)
    ids = [x.tolist() for x in codec.encode(texts)]
    assert ids == other.encode(texts)
    assert all(codec.parity(t, np.array(i)) for t, i in zip(texts, ids))
    return codec, other, ids


def test_merge_model_equals_the_library_on_whole_texts():
    docs = [r[0] for r in duckdb.sql(f"select text from '{SF001}/documents.parquet' where text is not null").fetchall()]
    codec, other, ids = parity(MODEL, docs + TEXTS)
    assert [codec.decode(i) for i in ids] == other.decode(ids)
    assert [codec.decode(i) for i in ids[: len(docs)]] == docs


@pytest.mark.parametrize("fallback", [True, False])
@pytest.mark.parametrize("remove_extra", [True, False])
def test_unigram_model(tmp_path, fallback, remove_extra):
    model = unigram(tmp_path / "m.model", fallback, remove_extra)
    codec, other, ids = parity(model, ["the cat sat", "  the   cats that ", "the é cat\nzz", "", "sat<s>the"])
    assert [codec.decode(i) for i in ids] == other.decode(ids)


def test_parse_reads_scores_kinds_and_flags(tmp_path):
    m = S.parse(open(unigram(tmp_path / "m.model", True), "rb").read())
    assert m.algorithm == S.UNIGRAM and m.byte_fallback and m.remove_extra and m.dummy_prefix
    assert m.kinds[:3] == [2, 3, 3] and m.scores[m.pieces.index("▁the")] == -3.0


def test_a_disagreement_shows():
    codec = S.Codec(MODEL)
    codec.differs.add("▁fox")
    fox, dog = codec.encode(["the quick fox", "the quick dog"])
    assert not codec.parity("the quick fox", fox) and codec.parity("the quick dog", dog)


@pytest.mark.parametrize("flag", ["dummy_prefix", "remove_extra"])
def test_a_broken_normaliser_shows(flag):
    """Whole documents are held against the unmodified model."""
    codec = S.Codec(MODEL)
    setattr(codec.model, flag, not getattr(codec.model, flag))
    text = " two  spaces and a fox "
    assert not codec.parity(text, codec.encode([text])[0])


def test_a_wrong_chunk_split_shows(monkeypatch):
    """Chunks that agree one by one do not hide that they were cut wrongly."""
    monkeypatch.setattr(S, "WHOLE_EVERY", 1)
    codec = S.Codec(MODEL)
    codec.encoder.split = re.compile("(?s).{1,3}").findall
    text = "the quick brown fox"
    ids = codec.encode([text])[0]
    assert not codec.differs and not codec.parity(text, ids)


def test_unusual_texts_are_encoded_whole():
    codec = S.Codec(MODEL)
    plain = next(t for t in (f"plain text {i}" for i in range(100)) if not codec.whole(t))
    assert all(codec.whole(f"{plain} {c}") for c in "\u2581\x00\u3000\u0301\U0001f600\xa0")


def test_every_plain_text_is_held_against_the_library():
    """No sample: a wrong split shows on each of them, as do other wrong ids."""
    codec = S.Codec(MODEL)
    texts = [f"plain text {i}" for i in range(100)]
    right = codec.encode(texts)
    assert all(codec.parity(t, i) for t, i in zip(texts, right))
    assert not any(codec.parity(t, np.append(i, 5)) for t, i in zip(texts, right))
    codec = S.Codec(MODEL)
    codec.encoder.split = re.compile("(?s).{1,3}").findall
    wrong = codec.encode(texts)
    assert not codec.differs and not any(codec.parity(t, i) for t, i in zip(texts, wrong))


def test_joined_chunks_keep_their_ids():
    codec = S.Codec(MODEL)
    chunks = ["▁a", "\n", "▁", "▁▁▁", "▁<0x0A>", "b\nc", "\r", "\x00", "日本", "▁\U0001f600", "z" * 200] + [f"▁w{i}x" for i in range(250)]
    assert codec._joined(chunks) == codec._library(chunks) and not codec._joined([])


def test_decoded_columns_equal_decoded_rows():
    codec = S.Codec(MODEL)
    rows = [x.tolist() for x in codec.encode(TEXTS)] + [None, [], [3, 4, 5], [0, 1, 2], codec.encode(["é 日"])[0].tolist()[:-1]]
    column = pa.array(rows, pa.list_(pa.int32()))
    expected = [codec.decode(r or []) for r in rows]
    assert codec.decode_column(column) == expected
    assert codec.decode_column(column.slice(2, 7)) == expected[2:9]
    assert codec.decode_column(column.slice(0, 0)) == []


def test_a_broken_decoder_shows():
    codec = S.Codec(MODEL)
    ids = [x.astype(np.int32) for x in codec.encode([*TEXTS, "a plain text"])]
    column = pa.array([x.tolist() for x in ids], pa.list_(pa.int32()))
    assert all(map(codec.decoding_parity, ids, codec.decode_column(column)))
    codec.model.dummy_prefix = False
    assert not codec.decoding_parity(ids[-1], codec.decode_column(column)[-1])


def test_unsupported_models_are_refused(tmp_path):
    raw = open(unigram(tmp_path / "m.model", True), "rb").read()
    S.parse(raw + field(2, field(24, 0)) + field(3, field(5, 1)) + field(5, field(3, 1)))
    for more in (field(2, field(24, 1)), field(3, field(5, 0)), field(5, field(2, b"map"))):
        with pytest.raises(ValueError):
            S.parse(raw + more)


def test_operators_on_awkward_rows(spark):
    docs = table(spark, AWKWARD)
    encoded = S.encode(docs, MODEL)
    assert set(docs.columns) | {"parity"} == set(encoded.columns)
    rows = S.decode(encoded, MODEL).collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        assert r.decoded == r.text and r.parity
    digest = S.digest(encoded, MODEL).collect()
    assert all(r.round_trip for r in digest)
    assert {r.n_tokens for r in digest if r.doc_id in (2, 3)} == {0}
    assert S.digest(S.encode(docs.where("false"), MODEL), MODEL).count() == 0
