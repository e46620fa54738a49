import os
import random
import zlib

import numpy as np
import pytest

from tracelake.llm import langid

VOC = {"aa": "ka ki ko kaka kiko koki".split(), "bb": "tu te to tutu teto tote".split(), "cc": "ñu ñe ñó ñuñe éñu".split()}


def docs(make, n=300):
    rng = random.Random(1)
    return make([(i, " ".join(rng.choices(VOC[k], k=30)) + ".", k) for i in range(n) for k in [list(VOC)[i % 3]]])


def test_gradients_match_differences():
    net = langid.Network(["x", "y"], hidden=3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    for texts in ([b"abc", b"de"], [b"ab c", b"de f"]):
        x, mask = langid._abreast(texts)
        assert (mask is None) == (len(texts[0]) == len(texts[1]))
        y = np.array([0, 1])
        _, grads = net.step(x, mask, y)
        rng = np.random.default_rng(0)
        for k, g in grads.items():
            for _ in range(6):
                at = tuple(rng.integers(s) for s in g.shape) if k[0] != "e" else (rng.integers(g.shape[0]), rng.choice(x.ravel()))
                old = net.w[k][at]
                net.w[k][at] = old + 1e-3
                up = net.step(x, mask, y)[0]
                net.w[k][at] = old - 1e-3
                down = net.step(x, mask, y)[0]
                net.w[k][at] = old
                assert abs((up - down) / 2e-3 - g[at]) < 2e-3


def test_held_out_accuracy_and_folds(spark, make):
    out = {r.doc_id: r for r in langid.identify(docs(make)).collect()}
    assert len(out) == 300
    for i, r in out.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in out.values() if r.held_out]
    assert sum(r.lang_pred == list(VOC)[r.doc_id % 3] for r in held) >= 0.95 * len(held) > 40


def slow_states(net, text, d):
    """One recurrence, byte by byte, as in the textbook."""
    h, w, logistic = net.hidden, net.w, lambda v: 1 / (1 + np.exp(-v))
    state, out = np.zeros(h), [None] * len(text)
    for t in range(len(text)) if d == "f" else range(len(text) - 1, -1, -1):
        fed = w["e" + d][:, text[t]]
        gates = logistic(fed[: 2 * h] + w["u" + d] @ state)
        new = np.tanh(fed[2 * h :] + w["c" + d] @ (gates[h:] * state))
        state = state + gates[:h] * (new - state)
        out[t] = state
    return np.array(out)


def test_pooled_over_every_letter():
    """Against one run over each whole text: states go on across words, every
    byte of a letter is labelled, and windows change next to nothing."""
    net = langid.Network(["x", "y", "z"])
    rng = random.Random(5)
    texts = ["ab cd, 12 é!", "a", "x" * 700, " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(400))]
    got = net.documents([t.encode() for t in texts])
    for text, p in zip(texts, got):
        read = text.encode()
        both = np.concatenate([slow_states(net, read, d) for d in "fb"], axis=1)
        z = both @ net.w["o"].T + net.w["p"].T
        q = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        letters = [langid._LETTER[b] for b in read]
        assert np.allclose(p, q[letters].mean(axis=0), atol=1e-5 if len(read) < langid.CORE else 2e-3)
    for n in (0, 1, 511, 512, 513, 5000):
        text = bytes(i % 251 for i in range(n))
        assert b"".join(w[a:b] for w, a, b in langid.windows(text)) == text


def test_context_goes_past_the_word():
    """The label of a byte depends on the word before."""
    net = langid.Network(["x", "y"])
    x, _ = langid._abreast([b"qq abc", b"zz abc"])
    last = net._run(x, None, "f", False)[0][-1]
    assert np.abs(last[:, 0] - last[:, 1]).max() > 1e-4


def test_letters():
    assert [langid.has_letter(t) for t in ("½ ½ ②", "Ⅷ ²", "12 _ !", "½a", "é", "中", "")] == [False, False, False, True, True, True, False]


def test_real_documents(spark):
    """Held-out accuracy on the test tables' documents."""
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    docs = spark.read.parquet(path)
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'")
    n, right = out.count(), out.filter("lang = lang_pred").count()
    assert n > 150 and right >= 0.98 * n


def test_many_labels_are_bounded(spark, make):
    """Of a dirty column only the most frequent languages are learned."""
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(VOC[k], k=20)), k) for i in range(60) for k in [list(VOC)[i % 3]]] + [(100 + i, "word", f"typo-{i}") for i in range(40)]
    assert langid.train(make(rows), languages=3).langs == ["aa", "bb", "cc"]


def test_odd_rows(odd, make):
    rows = langid.predict(odd, langid.Network(["aa", "bb"])).collect()
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, r)
    assert len(rows) == odd.count()
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (1, 2, 3))
    assert out[4].lang_pred in ("aa", "bb") and out[9].lang_pred in ("aa", "bb")
    assert [r.lang_pred for r in langid.predict(make([(1, "½ ½ ②")]), langid.Network(["aa", "bb"])).collect()] == ["und"]
    assert langid.identify(make([])).count() == 0
    assert [r.lang_pred for r in langid.identify(make([(1, "abc", None)])).collect()] == ["und"]
