import itertools
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelake.llm import pieces
from tracelake.llm.pieces import BYTE, NORMAL, UNIGRAM, UNKNOWN, Model, Transducer

BYTES = tuple((f"<0x{b:02X}>", 0.0, BYTE) for b in range(256))
TOY = Model((("<unk>", 0.0, UNKNOWN), *BYTES, *((t, s, NORMAL) for t, s in {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.0, "▁a": -3.5, "ba": -4.0, "aba": -5.0, "▁ab": -4.2}.items())), UNIGRAM)
have_model = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no model file")


def slow_cost(model, text):
    """The least cost over all ways to cut a text."""
    score = {t: s for t, s, k in model.pieces if k == NORMAL}
    least = min(score.values())
    best = float("inf")
    for cuts in itertools.product((0, 1), repeat=max(0, len(text) - 1)):
        parts, last = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(text[last:i])
                last = i
        parts.append(text[last:])
        if all(p in score or len(p) == 1 for p in parts):
            best = min(best, sum(-score[p] if p in score else 10 - least for p in parts))
    return best


@pytest.mark.parametrize("text", ["ab", "aba", "abab ab", "a b", "  ab", "xab", "baab a", "é a"])
def test_shortest_path_is_least(text):
    t = Transducer(TOY)
    ids = t.encode(text).tolist()
    score = {i: -s for i, (_, s, k) in enumerate(TOY.pieces) if k == NORMAL}
    n_unknown = sum(c not in "ab " for c in text)
    cost = sum(score.get(i, 0) for i in ids) + n_unknown * t.unknown_cost
    assert abs(cost - slow_cost(TOY, t.normalise(text))) < 1e-9
    assert t.decode(np.array(ids), t.outputs()) == text


@have_model
@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(text):
    t = test_round_trip.machine = getattr(test_round_trip, "machine", None) or Transducer(pieces.read_model())
    assert t.decode(t.encode(text), t.outputs()) == text.replace("▁", " ")


@have_model
def test_same_ids_as_the_library():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    t, rng = Transducer(pieces.read_model()), random.Random(1)
    texts = ["", " ", "  two  spaces ", "a\n\nb\tc", "naïve 日本 😀", "x" * 200, "<s> <0x0A>", "▁a▁ b"]
    texts += ["".join(rng.choice("etaoin shrdlu  .,E\n0é") for _ in range(120)) for _ in range(150)]
    for text in texts:
        assert t.encode(text).tolist() == sp.encode(text), text


@pytest.fixture(scope="module")
def folding(tmp_path_factory):
    """A small unigram model that folds compatibility characters and drops
    repeated spaces, in the library's own format."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    del proto.pieces[:]
    for text, score, kind in TOY.pieces:
        proto.pieces.add(piece=text, score=score, type=kind)
    for text in ("A", "é", "1", "▁1", "株", "abab"):
        proto.pieces.add(piece=text, score=-2.0 - len(text), type=NORMAL)
    proto.trainer_spec.model_type, proto.trainer_spec.byte_fallback, proto.trainer_spec.unk_id = UNIGRAM, True, 0
    proto.normalizer_spec.add_dummy_prefix = proto.normalizer_spec.remove_extra_whitespaces = proto.normalizer_spec.escape_whitespaces = True
    path = tmp_path_factory.mktemp("model") / "folding.model"
    path.write_bytes(proto.SerializeToString())
    return str(path)


def test_compiled_rules_as_the_library(folding):
    """The character map's rules, spaces and least paths, against the library."""
    import sentencepiece

    sp, t = sentencepiece.SentencePieceProcessor(model_file=folding), Transducer(pieces.read_model(folding))
    assert len(t.model.rules) > 1000 and dict(t.model.rules)["①"] == "1"
    rng = random.Random(3)
    texts = ["", " ", "  a  b  ", "①ａｂ㈱", "e\u0301 é", "\u3000a\u00a0b\t", "ﾊﾟ ｶﾞ", "a\u200bb", "½ab", "a\nb"]
    texts += ["".join(rng.choice("ab  Aａ①éｅ\u0301é株㈱½\u3000\t1") for _ in range(40)) for _ in range(300)]
    for text in texts:
        assert t.normalise(text).replace("▁", " ") == sp.normalize(text).replace("▁", " "), text
        assert t.encode(text).tolist() == sp.encode(text), text


@have_model
def test_paths_cost_nothing_or_are_cut_off():
    """On the BPE path too the costs are relaxed: of all ways to cut a word
    into pieces one is accepted, and it is what the merges leave."""
    t = test_round_trip.machine = getattr(test_round_trip, "machine", None) or Transducer(pieces.read_model())
    for word in ("▁the", "▁unhappy", "▁aaaa", "▁naïve"):
        ids = t.shortest_path(word)
        assert [t.text[i] for i in ids] == t.merged(word)
        assert t.accepts(pieces.FRONT, ids[0]) and all(t.accepts(a, b) for a, b in zip(ids, ids[1:]))
        ways = 0
        for cuts in itertools.product((0, 1), repeat=len(word) - 1):
            parts = "".join(c + "|" * k for c, k in zip(word, (*cuts, 0))).split("|")
            way = [t.pieces.longest(x, 0) for x in parts]
            if all(end == len(x) for (end, _), x in zip(way, parts)):
                way = [i for _, i in way]
                ways += t.accepts(pieces.FRONT, way[0]) and all(t.accepts(a, b) for a, b in zip(way, way[1:]))
        assert ways == 1


@have_model
def test_odd_rows(odd, make):
    rows = pieces.encode(odd).collect()
    assert len(rows) == odd.count() and all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0}
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(odd)).collect()}
    assert back[4] == odd.filter("doc_id = 4").first().text and back[1] == ""
    assert pieces.encode(make([])).count() == 0
