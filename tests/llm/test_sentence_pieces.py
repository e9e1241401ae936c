"""Operator 12 against the sentencepiece library, whose files and models these are, and its edge cases."""

import random
import time
from array import array

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from folioforge.llm import queries, sentence_pieces
from folioforge.llm.sentence_pieces import Pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", "\n", " ", "▁x", "<s>a</s>", "a\0b", "ＡＢ ﬁ", "\t\tx", "日本語", " " * 40 + "x" + " " * 33, "é" * 50, "😀 👍🏽x", "▁▁ a", "a" * 3000, "aab" * 1500, "x" * 90 + " y" * 90, "don't", "\r\n\r\n"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def pieces():
    with open(PATH, "rb") as f:
        return Pieces(f.read())


def ids(pieces, text):
    return array("I", pieces.encode(text)).tolist()


def test_ids_and_texts_are_the_librarys(pieces, library, spark, sf_dir):
    rnd = random.Random(1)
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] + ODD
    texts += ["".join(rnd.choice("abcdefgh  ▁.,-=0123\né日本é😀ß") for _ in range(rnd.randrange(60))) for _ in range(1500)]
    some = list(pieces.id)
    texts += ["".join(rnd.choice(some) for _ in range(rnd.randrange(10))) for _ in range(3000)]
    for t in texts:
        want = library.encode(t, add_bos=True, add_eos=True)
        assert ids(pieces, t) == want, t[:80]
        assert pieces.decode(want) == library.decode(want), t[:80]


def test_any_ids_decode_as_the_librarys(pieces, library):
    rnd = random.Random(2)
    for _ in range(5000):
        some = [rnd.choice([rnd.randrange(32000), rnd.randrange(3, 259), rnd.randrange(3, 259), rnd.randrange(3), 28705]) for _ in range(rnd.randrange(9))]
        assert pieces.decode(some) == library.decode(some), some


def small_model(rnd):
    """A model of a few letters with scores that tie, and pieces that no merge makes."""
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    m = proto.ModelProto()
    add = lambda text, kind, score=0.0: m.pieces.add(piece=text, score=score, type=kind)
    add("<unk>", 2), add("<s>", 3), add("</s>", 3)
    for b in range(256):
        add(f"<0x{b:02X}>", 6)
    made = {*"ab▁"} | {"".join(rnd.choice("ab") for _ in range(rnd.randint(2, 5))) for _ in range(12)} | {"▁" + "".join(rnd.choice("ab") for _ in range(rnd.randint(1, 3))) for _ in range(4)} | {"▁▁"}
    for t in sorted(made):
        add(t, 1, -float(rnd.randint(1, 40)) if len(t) > 1 else -100.0)
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = 2, True
    m.normalizer_spec.name, m.normalizer_spec.remove_extra_whitespaces = "identity", False
    return m


def test_small_models_with_ties(spark):
    """Distinct scores: then the pieces of a text are settled, whatever order equal pairs are merged in."""
    rnd = random.Random(3)
    taken_back = 0
    for _ in range(25):
        m = small_model(rnd)
        for at, p in enumerate(p for p in m.pieces if p.type == 1 and len(p.piece) > 1):
            p.score -= at / 1000
        own, library = Pieces(m.SerializeToString()), sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
        for _ in range(150):
            t = "".join(rnd.choice("aabb c") for _ in range(rnd.randrange(14)))
            assert ids(own, t) == library.encode(t, add_bos=True, add_eos=True), (t, [p.piece for p in m.pieces][259:])
        taken_back += sum(not ok for ok in own.pairs.values())
    assert taken_back  # some longest match didn't get along with the piece before it


def test_models_that_cannot_be_encoded_so_are_told(spark):
    rnd = random.Random(4)

    def unigram(m):
        m.trainer_spec.model_type = 1

    def normalising(m):
        m.normalizer_spec.remove_extra_whitespaces = True

    def across(m):
        m.pieces.add(piece="a▁b", score=-1.0, type=1)

    def user(m):
        m.pieces.add(piece="zz", score=0.0, type=4)

    for change in (unigram, normalising, across, user):
        m = small_model(rnd)
        change(m)
        with pytest.raises(ValueError, match="backtracking"):
            Pieces(m.SerializeToString())


def test_long_words_take_time_in_proportion(pieces):
    pieces.encode("warm")
    for make in (lambda n: "a" * n, lambda n: "=" * n, lambda n: "ab" * (n // 2), lambda n: " " * n, lambda n: "日" * n, lambda n: "͸" * n, lambda n: "the" * (n // 3)):
        began = time.time()
        assert len(pieces.encode(make(200_000))) > 8
        assert time.time() - began < 4


def test_query_rows(spark, library):
    import hashlib

    texts = [None, *ODD, "word " * 3000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (3, texts[3]), (3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit(1), "n_tokens": F.lit("x"), "decoded": F.lit(2.0)})
    want = []
    for i, t in rows:
        e = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(e), hashlib.sha256(array("I", e).tobytes()).hexdigest(), hashlib.sha256(library.decode(e).encode()).hexdigest()))
    got = sentence_pieces.round_trip(df, PATH).select("doc_id", "n_tokens", F.sha2("ids", 256), F.sha2(F.col("decoded").cast("binary"), 256))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert sentence_pieces.round_trip(df.limit(0), PATH).collect() == []
    arrays = sentence_pieces.encode(df, PATH)
    assert {r.doc_id: r.ids for r in arrays.collect()}[4] == library.encode(texts[4], add_bos=True, add_eos=True)
    assert {r.doc_id: r.text for r in sentence_pieces.decode(arrays, PATH).collect()}[len(texts) - 1] == texts[-1]


def test_registered(spark, sf_dir):
    assert queries.op12_sentence_pieces(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
