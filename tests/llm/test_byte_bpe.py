"""Byte-level BPE against the tokenizer library: single texts, seams in every place, the registered query's rows."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from sigsieve.llm import byte_bpe, queries

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id bigint, text string"
BITS = ["'", "s", "t", "re", "ll", "d", "m", "ve", " ", "  ", "\n", "\t", "a", "B", "1", "２", "!", "é", "漢", "　", "\x1c", "\xa0", "😀", "'S", "\U000107bb", "\U0001246f", "ſ", "</s>", "<|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(PATH), special_tokens={})


def _text(r, n):
    return "".join(r.choice(BITS) for _ in range(n))


def _sorted(rows):
    return sorted(map(tuple, rows), key=repr)


def _ids(rows):
    return _sorted((x.doc_id, tuple(x.ids)) for x in rows)


def test_texts_side_by_side(library):
    r = random.Random(0)
    coder = byte_bpe.Coder(byte_bpe.load_ranks(PATH), byte_bpe.character_classes())
    for _ in range(400):
        texts = [_text(r, r.randint(0, 20)) for _ in range(6)]
        assert [x.tolist() for x in byte_bpe._encode_texts(coder, texts)] == [library.encode_ordinary(t) for t in texts]


def test_merges_of_long_pieces(library):
    r = random.Random(1)
    ranks = byte_bpe.load_ranks(PATH)
    for piece in ("'", "zq", "a" * 5000, "ab" * 3000, "ab" * 47, "xyzq" * 24, "".join(r.choice("etaoin") for _ in range(4000)), "é漢" * 500):
        assert byte_bpe.merge(piece.encode(), ranks) == library.encode_ordinary(piece)


def test_merges_of_many_pieces_at_once(library):
    r = random.Random(2)
    coder = byte_bpe.Coder(byte_bpe.load_ranks(PATH), byte_bpe.character_classes())
    pieces = list({"".join(r.choice("etaoinéxq'1") for _ in range(r.randint(1, 40))) for _ in range(3000)})
    ids, before = coder.ids([p.encode() for p in pieces])
    for p, a, b in zip(pieces, before[:-1], before[1:], strict=True):
        assert ids[a:b].tolist() == byte_bpe.merge(p.encode(), coder.ranks)


@pytest.mark.parametrize(("chunk", "overlap"), [(7, 7), (16, 5), (64, 8), (65_536, 512)])
def test_seams(spark, library, chunk, overlap):
    r = random.Random(chunk)
    rows = [(i, _text(r, r.randint(0, 90))) for i in range(60)]
    rows += [(100, "x" * 500), (101, " " * 300 + "y"), (102, "!" * 200 + "'s"), (103, ("\n" * 40 + "a") * 6), (104, "'ll" * 60), (105, "a" * 90 + " b" * 90 + "7" * 90)]
    rows += [(200, None), (201, ""), (None, "no id " * 30), (7, rows[7][1]), (7, rows[7][1]), (106, rows[100 - 40][1])]
    df = spark.createDataFrame([(*x, "n", 1) for x in rows], SCHEMA + ", ids string, part int")
    tokens = byte_bpe.encode(df, PATH, chunk, overlap)
    assert _ids(tokens.collect()) == _sorted((d, tuple(library.encode_ordinary(t or ""))) for d, t in rows)
    back = byte_bpe.decode(tokens, PATH)
    assert _sorted((x.doc_id, bytes(x.data)) for x in back.collect()) == _sorted((d, (t or "").encode()) for d, t in rows)
    assert byte_bpe.encode(df.limit(0), PATH, chunk, overlap).count() == 0


def test_null_ids_decode_to_nothing_and_unknown_ids_fail(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [64])], "doc_id bigint, ids array<int>")
    assert [bytes(x.data) for x in byte_bpe.decode(rows, PATH).orderBy("doc_id").collect()] == [b"", b"", next(t for t, i in byte_bpe.load_ranks(PATH).items() if i == 64)]
    with pytest.raises(Exception, match="KeyError"):
        byte_bpe.decode(spark.createDataFrame([(1, [99_999_999])], "doc_id bigint, ids array<int>"), PATH).collect()


def test_another_vocabulary(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    text = "Größe und Maß, l'été, año 2024 … 漢字"
    got = byte_bpe.encode(spark.createDataFrame([(1, text)], SCHEMA), path, 8, 5).collect()
    assert got[0].ids == library.encode_ordinary(text)


def test_query_rows(spark, library):
    docs = [tuple(x) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = []
    for d, text in docs:
        ids = library.encode_ordinary(text or "")
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    got = queries.op12_byte_bpe(spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    assert _sorted(got.collect()) == _sorted(want)
