import hashlib
import pickle
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vaultmill.llm import pieces

tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
PATH = tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "a", " a", "a  b ", "▁x", " ▁ ", "a\nb\n\n", "x\x00y", "﻿", "�", "日本語ひ🙂", "é", "\r\n\t", "𐀀" * 9]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as f:
        return pieces.Model(f.read())


def each(ids, counts):
    ends = np.append(0, np.cumsum(counts))
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]


def made_up(library):
    rng = random.Random(7)
    vocab = [library.id_to_piece(i) for i in range(259, library.get_piece_size())]
    bits = ["a", "the", "ing", " ", "  ", "   ", "▁", "\n", "er", "tion", "0", "ß", "aaaaaaa", "\t", "🙂", "\x00"]
    out = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    out += ["".join(rng.choice(vocab) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    return out + ["".join(rng.choice("etaoin") for _ in range(4000)), "the" * 2000, "a" * 3001, " " * 1000]


def test_ids_are_the_library_s(model, library):
    assert model.early.any()  # this vocabulary has merges that must wait
    texts = [t or "" for t in ODD] + made_up(library)
    ids, counts = model.encode(texts)
    want = library.encode(texts)
    assert each(ids, counts) == want
    assert model.decode(ids, counts) == library.decode(want)


def small(names, bytes_too):
    """A model with pieces in order of score; equal names of the list share a score with the next."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m, kind = pb.ModelProto(), pb.ModelProto.SentencePiece
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = pb.TrainerSpec.BPE, bytes_too
    m.trainer_spec.vocab_size = 3 + 256 * bytes_too + len(names)
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces = "identity", True, False
    every = [("<unk>", kind.UNKNOWN, 0), ("<s>", kind.CONTROL, 0), ("</s>", kind.CONTROL, 0)]
    every += [(f"<0x{i:02X}>", kind.BYTE, 0) for i in range(256 * bytes_too)]
    for name, t, score in [*every, *((n, kind.NORMAL, float(-(k // 2))) for k, n in enumerate(names))]:
        m.pieces.add(piece=name, type=t, score=score)
    return m.SerializeToString()


@pytest.mark.parametrize("bytes_too", [True, False])
def test_vocabularies_in_any_order(bytes_too, monkeypatch):
    """Scores that no training would give: merges make better pairs, scores tie, characters lack, spaces follow letters."""
    rng, waited = random.Random(5), 0
    for _ in range(60):
        alphabet = rng.choice(["ab", "abc", "ab▁", "abc▁é"])
        names = list({"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(3, 25))})
        rng.shuffle(names)
        data = small(names, bytes_too)
        lib, own = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.Model(data)
        texts = ["".join(rng.choice(alphabet + " z") for _ in range(rng.randint(0, 25))) for _ in range(60)] + ["ab" * 30, "a" * 31, "abab ab"]
        ids, counts = own.encode(texts)
        assert each(ids, counts) == lib.encode(texts)
        assert own.decode(ids, counts) == lib.decode(lib.encode(texts))
        hasty = pieces.Model(data)
        hasty.early[:] = False
        waited += each(*hasty.encode(texts)) != each(ids, counts)
    assert waited > 5  # merging without waiting would be wrong


def test_any_ids_decode_as_in_the_library(model, library):
    rng = random.Random(3)
    rows = [[rng.choice([rng.randint(0, 31999), rng.randint(3, 258), rng.randint(0, 3), 28705, 264]) for _ in range(rng.randint(0, 6))] for _ in range(5000)]
    flat = np.array([i for r in rows for i in r], np.int32)
    assert model.decode(flat, np.array([len(r) for r in rows])) == library.decode(rows)
    with pytest.raises(ValueError):
        model.decode(np.array([model.size]), np.array([1]))


def test_words_kept_and_dropped(model, library, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT", 5)
    for t in ["one two three", "four five six one two", "one one one", "x" * 100 + " one"]:
        assert each(*model.encode([t, t])) == library.encode([t, t])
        assert len(model.seen) <= 5 and all(len(w) <= pieces.SHORT for w in model.seen)
    assert not pickle.loads(pickle.dumps(model)).seen


def other(change):
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(PATH, "rb") as f:
        m.ParseFromString(f.read())
    change(m, pb)
    return m.SerializeToString()


def test_models_without_byte_pieces(library):
    def plain(m, pb):
        for p in m.pieces:
            if p.type == pb.ModelProto.SentencePiece.BYTE:
                p.type = pb.ModelProto.SentencePiece.NORMAL
        m.trainer_spec.byte_fallback = False

    data = other(plain)
    lib, own = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.Model(data)
    texts = ["𐀀𐀁 𐀀a𐀀𐀀\n\n\tx", "\n", "a\n", "\n\n b"]
    ids, counts = own.encode(texts)
    assert each(ids, counts) == lib.encode(texts)
    assert own.decode(ids, counts) == lib.decode(lib.encode(texts))


def test_models_that_are_refused():
    def kind(m, pb):
        m.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM

    def spaces(m, pb):
        m.normalizer_spec.remove_extra_whitespaces = True

    for change in (kind, spaces):
        with pytest.raises(ValueError):
            pieces.Model(other(change))


def test_columns(spark, library, monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK", 50)
    rows = [(k % 7, t, "x", k) for k, t in enumerate(ODD + ["hello world " * 60, "hello world"] * 2)]
    df = spark.createDataFrame(rows, "doc_id int, text string, ids2 string, n_tokens int").repartition(3)
    got = pieces.decoded(pieces.encoded(df, PATH), PATH).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "ids2", "n_tokens", "ids", "decoded"}
    for r in got:
        assert r.ids == library.encode(r.text or "") and r.decoded == library.decode(r.ids)
    assert pieces.encoded(df.limit(0), PATH).count() == 0
    assert spark.createDataFrame([(None,)], "ids array<int>").select(pieces.decode(F.col("ids"), pieces.load(spark, PATH))).first()[0] == ""


def test_query(spark, library, tmp_path):
    rows = [(1, "Hello there\nworld"), (2, None), (None, ""), (1, "Hello there\nworld"), (4, "ß 🙂" * 3000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = pieces.op12_sentencepiece_ids(spark, str(tmp_path))
    assert str(out._jdf.queryExecution().executedPlan()).count("ArrowEvalPython") == 2
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(i, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids))) for i, t in rows for ids in [library.encode(t or "")]]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
