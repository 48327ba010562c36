"""Language ID by a bidirectional gated recurrent network over bytes (operator 6).

The bytes of a text are read in windows of WINDOW bytes, forwards and backwards, by gated recurrent units.
Every byte gets a probability for each language from both states at its place; a document's probabilities are
the means over all its bytes. The network is trained in numpy by backpropagation through time on a bounded
sample of labelled documents, with the document's language as the label of each of its bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import crc_mod, hash_fraction, ship, tidy

#: Bounded training sample: documents for each language, and windows of each, drawn from the whole text.
SAMPLE_DOCS, SAMPLE_WINDOWS = 300, 24
#: More labels than this are an error: each takes its share of the training sample and of every byte's work.
MOST_LANGUAGES = 1000
WINDOW, HIDDEN, STEPS, BATCH = 64, 8, 400, 128
NO_LANGUAGE = "und"


@dataclass
class Network:
    """Weights: byte (2, 256, 3H) and state (2, H, 3H) to the gates reset, update, candidate; bias (2, 1, H) of the candidate's state part; out (2H, L), out_bias (L)."""

    languages: list[str]
    byte: np.ndarray
    state: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [self.byte, self.state, self.bias, self.out, self.out_bias]


def new_network(languages: list[str], hidden: int, rng: np.random.Generator) -> Network:
    n = len(languages)
    w = lambda *shape: (rng.standard_normal(shape) / np.sqrt(hidden)).astype(np.float32)
    zero = lambda *shape: np.zeros(shape, np.float32)
    return Network(languages, w(2, 256, 3 * hidden), w(2, hidden, 3 * hidden), zero(2, 1, hidden), w(2 * hidden, n), zero(n))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, np.float32(0.5), out=x)
    np.tanh(x, out=x)
    x += np.float32(1)
    x *= np.float32(0.5)
    return x


def _states(net: Network, x: np.ndarray, tape: list | None = None) -> np.ndarray:
    """States (2, T, B, H) for windows x (B, T) of bytes; direction 1 runs backwards, its states stand at their own bytes. tape: gets what BPTT needs."""
    n, t = x.shape
    k = net.state.shape[1]
    h, hs = np.zeros((2, n, k), np.float32), np.empty((2, t, n, k), np.float32)
    both = (x, x[:, ::-1])
    for s in range(t):
        gates = np.stack([net.byte[d].take(both[d][:, s], axis=0) for d in (0, 1)])
        from_h = h @ net.state
        ru = _sigmoid(gates[:, :, : 2 * k] + from_h[:, :, : 2 * k])
        r, u = ru[:, :, :k], ru[:, :, k:]
        inner = from_h[:, :, 2 * k :] + net.bias
        c = np.tanh(gates[:, :, 2 * k :] + r * inner)
        if tape is not None:
            tape.append((h, r, u, c, inner))
        h = c + u * (h - c)
        hs[0, s], hs[1, t - 1 - s] = h[0], h[1]
    return hs


def _probabilities(net: Network, hs: np.ndarray) -> np.ndarray:
    """(T, B, L): each byte's language probabilities."""
    k = net.state.shape[1]
    z = hs[0] @ net.out[:k] + hs[1] @ net.out[k:] + net.out_bias
    z -= z.max(axis=2, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=2, keepdims=True)
    return z


def _gradients(net: Network, x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Loss and gradients by backpropagation through time. weight (B, T): 1 for bytes that count."""
    n, t = x.shape
    k = net.state.shape[1]
    tape: list = []
    hs = _states(net, x, tape)
    p = _probabilities(net, hs)
    total = max(float(weight.sum()), 1.0)
    w = (weight.T / total).astype(np.float32)
    loss = -float((np.log(np.maximum(np.take_along_axis(p, label[None, :, None].repeat(t, 0), 2)[:, :, 0], 1e-9)) * w).sum())
    dz = p
    dz[np.arange(t)[:, None], np.arange(n)[None, :], label[None, :]] -= 1
    dz *= w[:, :, None]
    flat = dz.reshape(t * n, -1)
    g_out = np.concatenate([hs[0].reshape(t * n, k).T @ flat, hs[1].reshape(t * n, k).T @ flat])
    dh_all = np.stack([dz @ net.out[:k].T, (dz @ net.out[k:].T)[::-1]])  # in the order of each direction's steps
    g_state, g_bias, dh = np.zeros_like(net.state), np.zeros_like(net.bias), np.zeros((2, n, k), np.float32)
    dx = np.empty((2, t, n, 3 * k), np.float32)
    for s in range(t - 1, -1, -1):
        before, r, u, c, inner = tape[s]
        dh = dh + dh_all[:, s]
        dc = dh * (1 - u) * (1 - c * c)
        du = dh * (before - c) * u * (1 - u)
        dr = dc * inner * r * (1 - r)
        d_inner = dc * r
        dg = np.concatenate([dr, du, d_inner], axis=2)
        dx[:, s, :, :k], dx[:, s, :, k : 2 * k], dx[:, s, :, 2 * k :] = dr, du, dc
        g_state += before.transpose(0, 2, 1) @ dg
        g_bias += d_inner.sum(axis=1, keepdims=True)
        dh = dh * u + dg @ net.state.transpose(0, 2, 1)
    g_byte = np.zeros_like(net.byte)
    for d, seen in enumerate((x, x[:, ::-1])):
        ids, rows = seen.T.reshape(-1), dx[d].reshape(t * n, -1)
        for j in range(3 * k):
            g_byte[d, :, j] = np.bincount(ids, weights=rows[:, j], minlength=256)
    return loss, [g_byte, g_state, g_bias, g_out, flat.sum(axis=0)]


def windows(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(W, WINDOW) bytes and 0/1 weights that cover every byte of a text that isn't empty exactly once: the last window ends with the text; a shorter text is padded with spaces."""
    b = np.frombuffer(text, np.uint8)
    if len(b) < WINDOW:
        x, w = np.full((1, WINDOW), 32, np.uint8), np.zeros((1, WINDOW), np.float32)
        x[0, : len(b)], w[0, : len(b)] = b, 1
        return x, w
    whole, rest = divmod(len(b), WINDOW)
    x = b[: whole * WINDOW].reshape(whole, WINDOW)
    w = np.ones(x.shape, np.float32)
    if rest:
        last = np.zeros((1, WINDOW), np.float32)
        last[0, WINDOW - rest :] = 1
        x, w = np.concatenate([x, b[None, -WINDOW:]]), np.concatenate([w, last])
    return x, w


def drawn_windows(text: bytes, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """SAMPLE_WINDOWS of a whole text's windows at most, drawn without replacement."""
    x, w = windows(text)
    if len(x) <= SAMPLE_WINDOWS:
        return x, w
    pick = np.random.default_rng(seed % (1 << 63)).choice(len(x), SAMPLE_WINDOWS, replace=False)
    return x[pick], w[pick]


def fit(texts: list[bytes], labels: list[str], steps: int = STEPS, hidden: int = HIDDEN, seed: int = 11) -> Network | None:
    """Train on labelled texts. None without a text that isn't empty."""
    some = [(drawn_windows(x, k), y) for k, (x, y) in enumerate(zip(texts, labels)) if x]
    return fit_windows([x for x, _ in some], [y for _, y in some], steps, hidden, seed)


def fit_windows(drawn: list[tuple[np.ndarray, np.ndarray]], labels: list[str], steps: int = STEPS, hidden: int = HIDDEN, seed: int = 11) -> Network | None:
    """Train on labelled windows with Adam; each language is drawn equally often. None without any."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    if not languages:
        return None
    place = {y: k for k, y in enumerate(languages)}
    pool: dict[int, list] = {k: [] for k in range(len(languages))}
    for x, y in zip(drawn, labels):
        pool[place[y]].append(x)
    data = {k: tuple(map(np.concatenate, zip(*v))) for k, v in pool.items()}
    net = new_network(languages, hidden, rng)
    first = [np.zeros_like(p) for p in net.params()]
    second = [np.zeros_like(p) for p in net.params()]
    if len(languages) == 1:
        return net
    for step in range(1, steps + 1):
        y = rng.integers(len(languages), size=BATCH)
        at = [int(rng.integers(len(data[k][0]))) for k in y]
        x = np.stack([data[k][0][i] for k, i in zip(y, at)])
        w = np.stack([data[k][1][i] for k, i in zip(y, at)])
        _, grads = _gradients(net, x, y, w)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.02 * min(1.0, 2.0 * (1 - step / (steps + 1))) * (1.0 if norm < 1 else 1 / norm)
        for p, g, m, v in zip(net.params(), grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def document_probabilities(net: Network, texts: list[bytes], block: int = 2048) -> np.ndarray:
    """(documents, languages): mean over all bytes of each text; rows of empty texts are 0."""
    made = [windows(t) if t else (np.zeros((0, WINDOW), np.uint8), np.zeros((0, WINDOW), np.float32)) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(x) for x, _ in made])
    x, w = np.concatenate([a for a, _ in made]), np.concatenate([b for _, b in made])
    out = np.zeros((len(texts), len(net.languages)))
    for lo in range(0, len(x), block):
        p = _probabilities(net, _states(net, x[lo : lo + block]))
        sums = np.einsum("tbl,bt->bl", p, w[lo : lo + block])
        np.add.at(out, owner[lo : lo + block], sums)
    size = np.array([max(len(t), 1) for t in texts])
    return out / size[:, None]


_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether any character is a letter (Unicode category L)."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def training_sample(docs: DataFrame, usable: Column) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[str]]:
    """Windows of a bounded sample of texts and their languages, about as many of each language, picked by the hash of id and text. Only windows leave the executors."""
    rows = docs.where(usable & F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES + 1).collect()
    if not counts:
        return [], []
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
    share = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(min(1.0, SAMPLE_DOCS / r["count"]))) for r in counts])
    got = rows.where(hash_fraction("doc_id", "text") < share).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text, h in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                x, w = drawn_windows(text.as_py().encode(), h)
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (h, lang, x.tobytes(), w.astype(np.uint8).tobytes())], names=["h", "lang", "x", "w"])

    got = got.mapInArrow(tidy(draw), "h long, lang string, x binary, w binary").orderBy("h", "lang", "x").limit(2 * SAMPLE_DOCS * len(counts)).collect()
    part = lambda b: np.frombuffer(b, np.uint8).reshape(-1, WINDOW)
    return [(part(r["x"]), part(r["w"]).astype(np.float32)) for r in got], [r["lang"] for r in got]


def identify(docs: DataFrame, usable: Column | None = None) -> DataFrame:
    """``docs`` (doc_id, text, lang) with lang_pred (string) and lang_score (double, 0 to 1) added.

    The network learns from rows where ``usable`` holds (default: all) and lang isn't null; lang, source and
    doc_id are never inputs of a prediction. lang_pred is the language with the largest mean probability over
    the bytes of the whole text, lang_score that mean.

    Null, empty and letterless texts get "und" and score 0, and so do all rows if nothing can be learned from.
    Equal texts get equal results. Repeated rows stay. Columns of these two names in ``docs`` are replaced, all
    others kept. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("lang_pred", "lang_score")
    net = fit_windows(*training_sample(docs, F.lit(True) if usable is None else usable))
    shared = spark.sparkContext.broadcast(net)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [t if t and has_letter(t) else "" for t in part.column(place).to_pylist()]
                if net is None:
                    texts = [""] * len(texts)
                p = document_probabilities(net, [t.encode() for t in texts]) if net else np.zeros((len(texts), 1))
                best = p.argmax(axis=1)
                lang = [net.languages[k] if t else NO_LANGUAGE for t, k in zip(texts, best)]
                score = np.where([bool(t) for t in texts], np.clip(p.max(axis=1), 0.0, 1.0), 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score)], names=[*part.schema.names, "lang_pred", "lang_score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "lang_pred string", "lang_score double"])
    return docs.mapInArrow(tidy(run), schema)


def held_out_predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out (crc32 of the id modulo 5 is 0; never learned from), lang_pred, score.

    Documents without id are never held out. Null, empty and letterless texts, repeated rows and empty tables as in
    ``identify``; long texts are read whole, window by window. Other columns are not read.
    """
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    out = identify(docs.select("doc_id", "text", "lang"), usable=~held)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
