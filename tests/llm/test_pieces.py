import os
import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from weftlink.llm import pieces as P
from weftlink.llm.queries import PIECES

pytestmark = pytest.mark.skipif(not os.path.exists(PIECES), reason="no model file")


@pytest.fixture(scope="module")
def bpe():
    return P.Transducer(open(PIECES, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=PIECES)


def texts(n, seed=0):
    rng = random.Random(seed)
    alphabet = "abcdefghij ehtns \n\t▁ЖД漢字🙂éñ  12.,;#"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def test_bpe_paths_equal_the_library(bpe):
    mine, theirs = bpe
    for t in [*texts(600), *(" " * n + w for n in range(40) for w in ("", "a", "the"))]:
        assert mine.encode(t) == theirs.encode(t)


def test_decoding_gives_the_text_back(bpe):
    mine, theirs = bpe
    for t in texts(300, 1):
        assert mine.decode(mine.encode(t)) == t.replace("▁", " ")


def test_unigram_paths_have_the_least_weight(tmp_path):
    proto = pb.ModelProto()
    proto.ParseFromString(open(PIECES, "rb").read())
    proto.trainer_spec.model_type = 1
    for i, p in enumerate(proto.pieces):
        p.score = -((i * 7919) % 1000) / 100 - 1 if p.type == 1 else p.score
    data = proto.SerializeToString()
    mine, theirs = P.Transducer(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    for t in texts(300, 2):
        a, b = mine.encode(t), theirs.encode(t)
        cost = lambda ids: sum(mine.weight[i] for i in ids if proto.pieces[i].type == 1)
        assert len(a) == 0 and len(b) == 0 or abs(cost(a) - cost(b)) < 1e-3, (t, a, b)


def test_rows(rows, spark):
    data = [(1, "Hello  wörld", "x"), (2, None, "x"), (3, "", "x"), (1, "Hello  wörld", "x"), (None, "é" * 3000, "x")]
    out = P.encode(rows(data, "doc_id long, text string, token_ids string"), PIECES, check_col="ok").collect()
    assert len(out) == 5 and all(r["ok"] for r in out)
    by = {r["doc_id"]: r["token_ids"] for r in out}
    assert by[2] == [] and by[3] == []
    back = P.decode(spark.createDataFrame([(by[1],), (None,)], "token_ids array<int>"), PIECES).collect()
    assert [r["text"] for r in back] == ["Hello  wörld", None]
    assert P.encode(spark.createDataFrame([], "doc_id long, text string"), PIECES).count() == 0


ODD = "ＡＢ①½ﬁ ㍿　\u00a0\t\n\u200be\u0301é ab  cdİßŸ°カﾞ가각\u1100\u1161ΣΩ"


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["", " ", "   ", "\u3000", *("".join(rng.choice(ODD) for _ in range(rng.randint(0, 40))) for _ in range(n))]


@pytest.mark.parametrize("rule", ["identity", "nfkc", "nmt_nfkc", "nfkc_cf", "nmt_nfkc_cf"])
def test_the_normaliser_equals_the_library(rule):
    for prefix in (True, False):
        for squeeze in (True, False):
            for mark in (True, False):
                theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, remove_extra_whitespaces=squeeze, escape_whitespaces=mark)
                proto = pb.ModelProto()
                proto.ParseFromString(theirs.serialized_model_proto())
                mine = P.Normaliser(proto.normalizer_spec)
                for t in odd_texts(120, 3):
                    assert mine.compose(t) == theirs.normalize(t), (rule, prefix, squeeze, mark, t)


@pytest.mark.parametrize("kind", [1, 2])
def test_models_with_a_character_map_encode_like_the_library(kind):
    proto, norm = pb.ModelProto(), pb.ModelProto()
    proto.ParseFromString(open(PIECES, "rb").read())
    norm.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    proto.normalizer_spec.CopyFrom(norm.normalizer_spec)
    proto.trainer_spec.model_type = kind
    if kind == 1:
        for i, p in enumerate(proto.pieces):
            p.score = -((i * 7919) % 100003) / 1000 - 1 if p.type == 1 else p.score
    data = proto.SerializeToString()
    mine, theirs = P.Transducer(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    for t in [*odd_texts(200, 4), *texts(100, 5)]:
        a, b = mine.encode(t), theirs.encode(t)
        if kind == 2:
            assert a == b, t
        else:
            cost = lambda ids: sum(mine.weight[i] for i in ids if proto.pieces[i].type == 1)
            assert abs(cost(a) - cost(b)) < 1e-2, (t, a, b)
