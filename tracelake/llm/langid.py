"""Language identification with a bidirectional gated recurrent network.

The network reads the bytes of a text in order: one recurrence runs forward
and one backward, over words and all that stands between them, and every
position gets a probability for each language.  A document's probabilities are
the means over the positions of its letters.  Texts are read in windows of
CORE bytes, with CONTEXT more on either side that only bring the states up, so
a long text is many short sequences side by side.

The network is trained here, in numpy, by backpropagation through time, on a
bounded sample: SAMPLE_DOCS documents for each of the LANGUAGES most frequent
languages, SAMPLE_WINDOWS windows of each, picked by hashes over the whole
text.  All labelled documents of those are candidates alike.  Prediction reads
every byte of every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the training sample: languages, documents of each, windows of a
#: document, and bytes of a window.
LANGUAGES, SAMPLE_DOCS, SAMPLE_WINDOWS, SAMPLE_BYTES = 100, 400, 8, 64
HIDDEN, STEPS, BATCH, RATE = 8, 300, 128, 0.02
#: Bytes of a window that are labelled, bytes read before and after them, and
#: windows that run side by side.
CORE, CONTEXT, ABREAST = 512, 32, 1024
UNDETERMINED = "und"
_WORDLIKE = re.compile(r"[^\W\d_]").finditer

#: Bytes that letters are made of.
_LETTER = np.array([chr(b).isalpha() or b >= 128 for b in range(256)])


def has_letter(text: str) -> bool:
    """Letters proper: a fraction or a circled digit is none."""
    return any(m[0].isalpha() for m in _WORDLIKE(text))


def windows(text: bytes, core: int = CORE, context: int = CONTEXT) -> Iterator[tuple[bytes, int, int]]:
    """``(bytes, first, last)``: every byte of the text is in one window from
    ``first`` to ``last``."""
    for at in range(0, len(text), core):
        first = max(0, at - context)
        yield text[first : at + core + context], at - first, min(at + core, len(text)) - first


def _abreast(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray | None]:
    """Bytes, time first, and 1 where a text goes on (None if all are as long)."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    width = int(size.max())
    x = np.frombuffer(b"".join(t.ljust(width) for t in texts), np.uint8).reshape(len(texts), width).T
    return x.astype(np.intp), None if size.min() == width else (np.arange(width)[:, None] < size).astype(np.float32)


class Network:
    """Weights: for each direction the byte table (3H, 256) that feeds the
    update gate, the reset gate and the candidate, and the recurrent matrices;
    one softmax layer over both directions' states.  States stand in columns."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 1, weights: dict | None = None) -> None:
        self.langs, self.hidden = langs, hidden
        if weights is None:
            rng = np.random.default_rng(seed)
            draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
            weights = {f"{n}{d}": v for d in "fb" for n, v in (("e", draw(3 * hidden, 256)), ("u", draw(2 * hidden, hidden)), ("c", draw(hidden, hidden)))}
            weights |= {"o": draw(len(langs), 2 * hidden), "p": np.zeros((len(langs), 1), np.float32)}
        self.w = weights

    def _run(self, x: np.ndarray, mask: np.ndarray | None, d: str, keep: bool, read: np.ndarray | None = None) -> tuple[np.ndarray, list]:
        """(time, H, text): the state after each byte, or what ``read`` makes
        of it; where the mask is 0 a state stays."""
        h, w = self.hidden, self.w
        u, c = w["u" + d] * 0.5, w["c" + d]
        table = np.concatenate((w["e" + d][: 2 * h] * 0.5, w["e" + d][2 * h :]))
        state, tape = np.zeros((h, x.shape[1]), c.dtype), []
        fed = np.empty((3 * h, x.shape[1]), table.dtype)
        out = np.empty((len(x), h if read is None else len(read), x.shape[1]), c.dtype)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            np.take(table, x[t], axis=1, out=fed, mode="clip")
            gates = u @ state
            gates += fed[: 2 * h]
            np.tanh(gates, out=gates)  # the logistic function by halves
            gates += 1
            gates *= 0.5
            held = gates[h:] * state
            new = c @ held
            new += fed[2 * h :]
            np.tanh(new, out=new)
            step = new - state
            step *= gates[:h]
            if mask is not None:
                step *= mask[t]
            if keep:
                tape.append((t, state, gates, held, new))
            state = state + step
            if read is None:
                out[t] = state
            else:
                np.matmul(read, state, out=out[t])
        return out, tape

    def pooled(self, x: np.ndarray, mask: np.ndarray | None, weight: np.ndarray) -> np.ndarray:
        """(language, text): the positions' probabilities, weighted and summed."""
        h, o = self.hidden, self.w["o"]
        p = self._run(x, mask, "f", False, np.ascontiguousarray(o[:, :h]))[0]
        p += self._run(x, mask, "b", False, np.ascontiguousarray(o[:, h:]))[0]
        p += self.w["p"]
        if np.abs(o).sum(axis=1).max() + np.abs(self.w["p"]).max() > 60:  # states are within 1, so most networks need no shift
            p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p *= (weight / p.sum(axis=1))[:, None, :]
        return p.sum(axis=0)

    def step(self, x: np.ndarray, mask: np.ndarray | None, y: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients, backpropagated through time."""
        runs = {d: self._run(x, mask, d, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=1)
        p = _softmax(np.matmul(self.w["o"], both) + self.w["p"])
        weight = (np.ones(x.shape, p.dtype) if mask is None else mask) * _LETTER[x]
        weight = weight / max(weight.sum(), 1)
        at = np.arange(len(y))
        loss = -float((np.log(p[:, y, at] + 1e-9) * weight).sum())
        g = p.copy()
        g[:, y, at] -= 1
        g *= weight[:, None, :]
        h = self.hidden
        grads = {"o": np.einsum("tln,thn->lh", g, both, optimize=True), "p": g.sum(axis=(0, 2))[:, None]}
        for k, d in enumerate("fb"):
            grads |= self._back(x, mask, runs[d][1], np.matmul(self.w["o"][:, k * h : (k + 1) * h].T, g), d)
        return loss, grads

    def _back(self, x: np.ndarray, mask: np.ndarray | None, tape: list, outer: np.ndarray, d: str) -> dict:
        h, w = self.hidden, self.w
        gu, gc = np.zeros_like(w["u" + d]), np.zeros_like(w["c" + d])
        fed = np.empty((len(x), 3 * h, x.shape[1]), outer.dtype)
        carry = np.zeros(outer.shape[1:], outer.dtype)
        for t, state, gates, held, new in reversed(tape):
            z, r = gates[:h], gates[h:]
            g = carry + outer[t]
            live = g if mask is None else g * mask[t]
            gnew = live * z * (1 - new * new)
            gheld = w["c" + d].T @ gnew
            ggates = np.concatenate((live * (new - state) * z * (1 - z), gheld * state * r * (1 - r)))
            gc += gnew @ held.T
            gu += ggates @ state.T
            fed[t, : 2 * h], fed[t, 2 * h :] = ggates, gnew
            carry = g - live * z + gheld * r + w["u" + d].T @ ggates
        flat, rows = x.ravel(), fed.transpose(1, 0, 2).reshape(3 * h, -1)
        ge = np.stack([np.bincount(flat, row, 256) for row in rows]).astype(w["e" + d].dtype)
        return {"e" + d: ge, "u" + d: gu, "c" + d: gc}

    def train(self, texts: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = 2) -> float:
        """Adam over seeded batches of texts of like length; the last loss."""
        rng = np.random.default_rng(seed)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        loss = 0.0
        for i in range(1, steps + 1):
            pick = rng.permutation(len(texts))[: 4 * BATCH]
            pick = pick[np.argsort(size[pick], kind="stable")]
            at = rng.integers(max(1, len(pick) - BATCH + 1))
            pick = pick[at : at + BATCH]
            x, mask = _abreast([texts[j] for j in pick])
            loss, grads = self.step(x, mask, labels[pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            rate = RATE * min(1.0, 2 * (1 - i / (steps + 1)))
            for k, g in grads.items():
                g = g * min(1.0, 1 / (norm + 1e-9))
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                self.w[k] -= rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-7)
        return loss

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities for each text over the bytes of its letters;
        zeros for a text without one."""
        sums, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))

        def flush(some: list[tuple[int, bytes, int, int]]) -> None:
            some.sort(key=lambda s: len(s[1]))
            for a in range(0, len(some), ABREAST):
                doc, read, first, last = zip(*some[a : a + ABREAST])
                x, mask = _abreast(list(read))
                at = np.arange(len(x))[:, None]
                counts = (_LETTER[x] & (at >= np.array(first)) & (at < np.array(last))).astype(np.float32)
                np.add.at(sums, list(doc), self.pooled(x, mask, counts).T)
                np.add.at(n, list(doc), counts.sum(axis=0))

        held: list[tuple[int, bytes, int, int]] = []
        for i, text in enumerate(texts):
            for window in windows(text):
                held.append((i, *window))
                if len(held) == 4 * ABREAST:
                    flush(held)
                    held = []
        if held:
            flush(held)
        return sums / np.maximum(n, 1)[:, None]


def _softmax(x: np.ndarray) -> np.ndarray:
    """Over the second axis."""
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


def held_out(id_col: Column) -> Column:
    """Documents that no training sees."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs: int = SAMPLE_DOCS, each: int = SAMPLE_WINDOWS, languages: int = LANGUAGES) -> Network:
    """A network for the most frequent ``languages`` of ``labelled``.  The
    sample is bounded by ``docs`` documents of a language (more or less, by
    hash) and ``each`` windows of a document."""
    rows = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    langs = sorted(counts)
    if len(langs) < 2:
        return Network(langs)
    limit = F.element_at(F.create_map(*(F.lit(x) for k in langs for x in (k, min(1 << 30, int(docs / counts[k] * (1 << 30)) + 1)))), F.col("lang"))
    picked = rows.filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < limit)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for i, text, lang in zip(*(batch.column(k).to_pylist() for k in range(3))):
                read = text.encode("utf-8", "surrogatepass")
                rng = np.random.default_rng(xxhash.xxh32_intdigest(f"{i}"))
                starts = rng.integers(0, max(1, len(read) - SAMPLE_BYTES + 1), each)
                some = sorted({read[a : a + SAMPLE_BYTES] for a in starts.tolist()}) if has_letter(text) else []
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([i], pa.string()), pa.array([some], pa.list_(pa.binary()))], ["lang", "id", "windows"])

    # 2 * docs at most, so that a hash that piles up stays bounded
    sample = picked.mapInArrow(draw, "lang string, id string, windows array<binary>").orderBy(F.xxhash64("id"), "id", "windows").limit(2 * docs * len(langs)).collect()
    sample.sort(key=lambda r: (r["lang"], r["id"] or "", r["windows"]))
    flat = [(bytes(w), langs.index(r["lang"])) for r in sample for w in r["windows"] or []]
    net = Network(langs)
    if flat:
        net.train([w for w, _ in flat], np.array([y for _, y in flat]))
    return net


def predict(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for each row.

    A null text or one without a letter is ``und`` with score 0, and so is any
    text if nothing was learned; repeated rows repeat; an empty table gives no
    rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast({"langs": network.langs, "hidden": network.hidden, "weights": network.w})
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        network, langs = Network(held["langs"], held["hidden"], weights=held["weights"]), np.array([*held["langs"], UNDETERMINED], object)
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                texts = [t if t and has_letter(t) else "" for t in part.column(1).to_pylist()]
                if len(langs) > 1:
                    p = network.documents([t.encode("utf-8", "surrogatepass") for t in texts])
                    found = np.array([bool(t) for t in texts])
                    best = np.where(found, p.argmax(axis=1), len(langs) - 1)
                    score = np.where(found, np.clip(p.max(axis=1), 0, 1), 0.0)
                else:
                    best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs[best].tolist(), pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: learned from the labelled rows
    that are not held out (see held_out), predicted for all."""
    network = train(docs.filter(~held_out(F.col(id_col))), id_col, text_col, lang_col)
    out = predict(docs, network, id_col, text_col)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
