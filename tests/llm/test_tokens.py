import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lastro.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", None, "a<|endoftext|>b <|startoftext|>", "<|endoftext|>", "x<|endoftext|><|endoftext|>y", "don't 've 'sea ''s x'll'm re're", "ΣΑΣ İstanbul é e\u0301 ﬁ ½ ² ٣ 漢字 😀😀 a\u200bb\x85c",
    "a" * 3000, "'" * 900, "ha" * 4000 + "!", " \n\t ", "İǅ ﬃ ẞ", "é" * 1500,
]


@pytest.fixture(scope="module")
def model():
    with open(PATH, encoding="utf-8") as f:
        return bpe.loaded(f.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_encode_equals_library(model, library, documents):
    texts = ODD + [r.text for r in documents.select("text").collect()]
    ids, begin = model.encode(texts)
    for i, t in enumerate(texts):
        assert ids[begin[i] : begin[i + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids, repr((t or "")[:60])


def test_long_pieces_stream(model, library):
    source = random.Random(1)
    for letters in ("abcdeiou", "aab", "th", "erstn"):
        text = "".join(source.choice(letters) for _ in range(5000))
        assert model.long_piece(text.encode()) == library.encode(text, add_special_tokens=False).ids


def test_lookahead_bounds_change(model):
    """No continuation changes tokens that end `lookahead` before the cut."""
    source = random.Random(2)
    for _ in range(60):
        head = "".join(source.choice("aehinorst") for _ in range(model.lookahead + 40)).encode()
        tail = "".join(source.choice("aehinorst") for _ in range(30)).encode()
        parts = []
        for text in (head, head + tail):
            s = model.start(text, ended=False)
            ids, _ = model.merge(s, np.array([len(s)]))
            ends = np.cumsum([len(model.raw[i]) for i in ids.tolist()])
            parts.append([(e, i) for e, i in zip(ends.tolist(), ids.tolist(), strict=True) if e <= len(head) - model.lookahead])
        assert parts[0] == parts[1] and parts[0]


def test_streams(model, library, documents):
    text = " ".join(r.text for r in documents.select("text").limit(5).collect()) + " " + "x" * 2000
    encoder, decoder, out, said = bpe.StreamEncoder(model), bpe.StreamDecoder(model, plain=False), [], ""
    for i in range(0, len(text), 777):
        ids = encoder.feed(text[i : i + 777])
        out += ids
        said += decoder.feed(ids)
    ids = encoder.finish()
    out, said = out + ids, said + decoder.feed(ids)
    assert out == library.encode(text, add_special_tokens=False).ids and said == library.decode(out, skip_special_tokens=False)
    plain = bpe.StreamDecoder(model)
    assert "".join(plain.feed([i]) for i in library.encode("é 漢字 ok", add_special_tokens=False).ids) + plain.finish() == "é 漢字 ok "


def test_encode_table(spark, library):
    rows = [(1, "Olá mundo", "x"), (1, "Olá mundo", "x"), (None, "a", "y"), (2, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(docs, PATH).collect())
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_lengths():
    assert packing.lengths(4096 * 2 + 5, 4096) == [4096, 4096, 4, 1] and packing.lengths(1, 8) == [1] and packing.lengths(8, 8) == [8]


def test_pack(spark, library):
    docs = spark.createDataFrame([(1, "the cat " * 3000, 0), (2, None, 0), (3, "hi", 0), (3, "hi", 0)], "doc_id long, text string, start int")
    rows = packing.pack(docs, PATH).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 and r.length == 2**r.bucket <= 4096 for r in rows)
    for r in rows:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    one = sorted((r for r in rows if r.doc_id == 1), key=lambda r: r.start)
    assert [i for r in one for i in r.ids] == library.encode("the cat " * 3000, add_special_tokens=False).ids + [2] and one[0].doc_tokens == 6001
    assert [(r.length, r.ids) for r in rows if r.doc_id == 2] == [(1, [2])] and len([r for r in rows if r.doc_id == 3 and r.start == 0]) == 2
    with pytest.raises(ValueError):
        packing.pack(docs, PATH, most=1000)


@pytest.mark.parametrize("text", ["ab1<x-y_" * 700, "Xylem" * 1200, "he" * 900 + "\u0301" + "re" * 900 + "'s" * 700, "a" * 1400 + "é" + "B" * 1400 + "<|endoftext|>" + "c" * 1400 + "'ll", "q1<|endoftext|>" * 300])
@pytest.mark.parametrize("step", [1, 13, 5000])
def test_runs_without_white_space(model, library, text, step):
    encoder, out, most = bpe.StreamEncoder(model), [], 0
    for i in range(0, len(text), step):
        out += encoder.feed(text[i : i + step])
        most = max(most, len(encoder.held))
    assert out + encoder.finish() == library.encode(text, add_special_tokens=False).ids
    assert most <= bpe.WINDOW + 20 + step


def test_query_decodes_by_the_state_machine(model, monkeypatch):
    ids = model.encode(["Olá mundo 漢字 <|endoftext|> " * 30])[0]
    fed = []
    feed = bpe.StreamDecoder.feed
    monkeypatch.setattr(bpe, "BLOCK", 7)
    monkeypatch.setattr(bpe.StreamDecoder, "feed", lambda self, x: fed.extend(x) or feed(self, x))
    assert bpe.decoded_digest(model, ids) == hashlib.sha256(b" ".join([model.tokens[i] for i in ids])).hexdigest() and fed == ids.tolist()


@pytest.mark.parametrize("bits", range(9, 14))
def test_pieces_that_polynomial_hashes_confuse(model, library, bits):
    """Thue-Morse words and their complements have equal hashes modulo 2 ** 64."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(1 << bits))
    texts = [word, word.translate(str.maketrans("ab", "ba")), word]
    ids, begin = model.encode(texts)
    for i, t in enumerate(texts):
        assert ids[begin[i] : begin[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids


def test_confused_pieces_in_queries(spark, library):
    word = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    texts = [word, word.translate(str.maketrans("ab", "ba"))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    packed = packing.pack(docs, PATH).collect()
    for r in bpe.encode(docs, PATH).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert [i for p in sorted((p for p in packed if p.doc_id == r.doc_id), key=lambda p: p.start) for i in p.ids] == [*ids, 2]


@pytest.mark.parametrize("letters", ["abcdefghij", "漢字語文", "é́à", "!?'-", "가각ᅡᆨ"])
def test_buffer_is_bounded(model, letters):
    """5,000,000 bytes of ASCII letters, and 300,000 characters of others, without white space."""
    source, encoder, most = random.Random(7), bpe.StreamEncoder(model), 0
    chunk = "".join(source.choices(letters, k=100_000))
    for _ in range(50 if letters.isalpha() and letters.isascii() else 3):
        encoder.feed(chunk)
        most = max(most, len(encoder.held) + len(encoder.piece.buffer if encoder.piece else b""))
    assert most <= bpe.WINDOW + 20 + bpe.READ + bpe.WINDOW + model.lookahead


@pytest.mark.parametrize("step", [1, 3, 64, 1000])
def test_streams_of_any_script(model, library, step):
    source = random.Random(step)
    alphabet = [*"ab'srvelmtd Σσİ \n\t1½!-é漢😀", "é", "̣̇", "각", "가", "̈́", "ো", "<|endoftext|>", "<|endof", "​", "ﬁ", "Ω", "יִ"]
    for n in (40, 900):
        text = "".join(source.choice(alphabet) * source.choice([1, 1, 1, 2, 700 if n < 100 else 1]) for _ in range(n))
        encoder, out = bpe.StreamEncoder(model), []
        for i in range(0, len(text), step):
            out += encoder.feed(text[i : i + step])
        assert out + encoder.finish() == library.encode(text, add_special_tokens=False).ids


def test_long_texts_stream(model, library, documents, monkeypatch):
    text = " ".join(r.text for r in documents.select("text").limit(30).collect())
    monkeypatch.setattr(bpe, "SLICE_BYTES", 1000)
    monkeypatch.setattr(bpe, "FED", 3000)
    ids, begin = model.encode([text])
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids and begin.tolist() == [0, len(ids)]


def test_pack_edges(spark, tmp_path):
    docs = spark.createDataFrame([(None, "a b", 0), (None, None, 1), (4, "word " * 5000, 2)], "doc_id long, text string, length int")
    assert packing.pack(docs.limit(0), PATH).count() == 0
    packed = packing.pack(docs, PATH)
    assert sorted((r.length, r.doc_tokens) for r in packed.filter("doc_id is null").collect()) == [(1, 1), (1, 3), (2, 3)]
    packing.write_buckets(packed, f"{tmp_path}/packed")
    back = spark.read.parquet(f"{tmp_path}/packed")
    assert back.count() == packed.count() and back.filter("length <> 1 << bucket or size(ids) <> length").count() == 0
    drawn = packing.read_bucket(spark, f"{tmp_path}/packed", 12)
    assert {r.length for r in drawn.collect()} == {4096} and "PartitionFilters: [isnotnull(bucket" in drawn._jdf.queryExecution().toString()
