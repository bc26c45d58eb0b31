import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from versetime.llm import tokens as T
from versetime.llm.queries import op5_token_binary, packed_tokens

SF, PATH = "/root/testdata/sf0.001", public_tokenizers.path("byte_bpe_50k.json")
PLAIN, OURS = Tokenizer.from_file(PATH), T.Encoder(PATH)


def ids_of(text):
    return np.array(PLAIN.encode(text or "", add_special_tokens=False).ids, "<u4")


@given(st.lists(st.integers(0, 2**17 - 1), max_size=300), st.integers(17, 32), st.data())
@settings(max_examples=60, deadline=None)
def test_packing(ids, bits, data):
    block = T.pack(np.array(ids, "<u4"), bits)
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert len(block) == -(-len(ids) * bits // 8) and T.unpack(block, bits, a, b).tolist() == ids[a:b]


def test_bits():
    assert [T.bits_needed(n) for n in (1, 2, 3, 256, 257, 50_257, 65_536, 65_537)] == [1, 1, 2, 8, 9, 16, 16, 17]


@given(st.text(st.sampled_from("ab'sé ß ñ1 2\n\t\0　\xa0.,!-_(中😀 lt"), max_size=60) | st.lists(st.sampled_from(["<|endoftext|>", " ", "a", ".", "\n", "<|", "'s"]), max_size=12).map("".join))
@settings(max_examples=400, deadline=None)
def test_encoder_gives_the_ids_of_the_tokenizer(text):
    assert b"".join(OURS(text)) == ids_of(text).tobytes()


def test_every_assigned_code_point_gives_the_ids_of_the_tokenizer():
    chars = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) not in ("Cn", "Co", "Cs")]
    texts = [f"a{c}b" for c in chars if c.isspace()] + [f"a {c} b" for c in chars if c.isspace()]
    rest = [c for c in chars if not c.isspace()]
    texts += [" ".join(f"a{c}b {c} {c}b, a{c}." for c in rest[i : i + 2000]) for i in range(0, len(rest), 2000)]
    assert [t for t in texts if b"".join(OURS(t)) != ids_of(t).tobytes()] == []


def test_slices_give_the_same_ids(monkeypatch):
    text = "Some words, it's (so)  far.\nNext line – über 12 things\t\tend " * 40
    monkeypatch.setattr(T, "SLICE_CHARS", 11)
    assert len(list(OURS(text))) > 20 and b"".join(OURS(text)) == ids_of(text).tobytes()


def expected(rows):
    out, start = [], 0
    for doc, text in rows:
        own = np.append(ids_of(text), np.uint32(2)).astype("<u4")
        out.append((doc, start, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    return out


def test_query_against_the_tokenizer(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    assert sorted(map(tuple, op5_token_binary(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == expected(rows)


def test_odd_rows(spark):
    data = [(5, None), (2, ""), (9, "nine words here"), (None, "null id"), (9, "again nine"), (9, "again nine"), (1, "<|endoftext|> x"), (7, "w " * 100_000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in data], "doc_id long, text string, start int, ids int")
    found = packed_tokens(df).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in found) == sorted((str(d), n, c) for d, _, n, c in expected(data))
    assert [r.doc_id for r in sorted(found, key=lambda r: r.start)] == [None, 1, 2, 5, 7, 9, 9, 9]
    begins = sorted((r.start, r.start + r.n_tokens) for r in found)
    assert begins[0][0] == 0 and all(a[1] == b[0] for a, b in zip(begins, begins[1:], strict=False))
    assert packed_tokens(df.limit(0)).count() == 0


def test_random_access_and_broken_files(spark, tmp_path):
    rows = [(i, f"text {i} " * (400 * i)) for i in range(60)]
    T.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), str(tmp_path / "t"), tokenizer=PATH, end_id=2, vocabulary=70_000)
    content = max((p.read_bytes() for p in (tmp_path / "t").glob("part-*")), key=len)
    file = T.TokenFile(memoryview(content))
    assert file.bits == 17 and len(file.offsets) > 1
    for k in (0, len(file.doc_ids) // 2, len(file.doc_ids) - 1):
        assert file.ids(int(file.starts[k]), int(file.stops[k])).tolist() == [*ids_of(rows[file.doc_ids[k]][1]), 2]
    with pytest.raises(ValueError):
        T.TokenFile(memoryview(content[:-20]))
