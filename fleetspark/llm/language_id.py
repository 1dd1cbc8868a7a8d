"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a text (A-Z lower-cased), white space and all, in both directions and labels every
byte with a distribution over languages; a document's distribution is the mean over all its bytes. So that texts of any
length are read in parallel, each is cut into stretches of ``CORE`` bytes, which the network reads with the ``AROUND``
bytes before and after them (as far as the text goes); each byte is labelled once, in its own stretch.

Training is backpropagation through time in numpy on the driver, every byte labelled with its text's language. It takes
``per_language`` rows of each language at most (those with the smallest hash of the id), and of these ``pieces`` pieces
of 200 signs a language at most (those with the smallest hash), so what is collected is bounded in bytes too.

Defined results. Null texts and texts without a letter are ``und`` with score 0. Ties go to the language that
sorts first. Without any training row every text is ``und``; so it is with an empty table, which gives no rows.
Repeated rows are predicted alike. Null ids are carried along. Only the id, text and language columns are read, the
language for training rows alone, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.llm.common import chunks, plain_strings, text_bytes, tidy

LETTER = regex.compile(r"\p{L}")
#: Bytes of a stretch, and bytes read before and after it.
CORE, AROUND = 240, 16
#: Stretches that are read together.
TOGETHER = 3_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Stretches:
    """The stretches of many texts, by falling length: their text, what is read (start, stop) and, within that, where
    their own bytes begin and how many they are."""

    doc: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    lead: np.ndarray
    own: np.ndarray

    @classmethod
    def of(cls, offsets: np.ndarray, core: int, around: int) -> Stretches:
        count = -(-np.diff(offsets) // core)
        doc = np.repeat(np.arange(len(count)), count)
        begin = offsets[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * core
        end = np.minimum(begin + core, offsets[doc + 1])
        start, stop = np.maximum(begin - around, offsets[doc]), np.minimum(end + around, offsets[doc + 1])
        order = np.argsort(start - stop, kind="stable")
        return cls(*(a[order] for a in (doc, start, stop, begin - start, end - begin)))

    def matrix(self, data: np.ndarray, some: slice | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length, stretches) of their bytes, and how many stretches have a byte at each place."""
        size = (self.stop - self.start)[some]
        length = int(size.max(initial=0))
        at = self.start[some] + np.minimum(np.arange(length)[:, None], size - 1)
        return data[at], np.searchsorted(-size, -np.arange(1, length + 1), side="right")


@dataclass
class Network:
    """Weights: for both directions the input table (256, 3h), the recurrent matrix (h, 3h); the output layer."""

    languages: list[str]
    tables: list[np.ndarray]
    loops: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], hidden: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        return cls(languages, [draw(256, 3 * hidden) * 4 for _ in range(2)], [draw(hidden, 3 * hidden) for _ in range(2)], draw(2 * hidden, len(languages)), np.zeros(len(languages), np.float32))

    def weights(self) -> list[np.ndarray]:
        return [*self.tables, *self.loops, self.out, self.bias]

    def states(self, x: np.ndarray, alive: np.ndarray, way: int, keep: bool = False):
        """The state after each byte (length, stretches, h); stretches are of falling length, alive[t] have a byte t.
        Backwards (way 1) a stretch's first step is its last byte."""
        length, n = x.shape
        h = self.loops[way].shape[0]
        table, loop = self.tables[way], self.loops[way]
        out = np.zeros((length, n, h), np.float32)
        kept = []
        state = np.zeros((n, h), np.float32)
        for t in range(length) if way == 0 else range(length - 1, -1, -1):
            k = alive[t]
            before = state[:k]
            wide = before @ loop
            given = table[x[t, :k]]
            zr = _sigmoid(given[:, : 2 * h] + wide[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            new = np.tanh(given[:, 2 * h :] + r * wide[:, 2 * h :])
            after = new + z * (before - new)
            if keep:
                kept.append((t, k, before.copy(), z, r, new, wide[:, 2 * h :]))
            out[t, :k] = after
            state[:k] = after
        return (out, kept) if keep else out

    @np.errstate(over="ignore")
    def labels(self, x: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """(languages, length, stretches) distributions; beyond a stretch's end they mean nothing. The same recurrence
        as ``states``, gate by gate in arrays that are used again."""
        (length, n), h = x.shape, self.loops[0].shape[0]
        score = np.empty((len(self.languages), length, n), np.float32)
        score[:] = self.bias[:, None, None]
        signs = np.repeat(np.array([-1, -1, 1], np.float32), h)
        parts = lambda w: [np.ascontiguousarray(w[:, i * h : (i + 1) * h]) for i in range(3)]
        for way in (0, 1):
            tables, loops, out = parts(signs * self.tables[way]), parts(signs * self.loops[way]), np.ascontiguousarray(self.out[way * h : (way + 1) * h].T)
            whole, kept = np.zeros((n, h), np.float32), [np.empty((n, h), np.float32) for _ in range(3)]
            for t in range(length) if way == 0 else range(length - 1, -1, -1):
                k = alive[t]
                state, read = whole[:k], x[t, :k]
                z, r, new = (a[:k] for a in kept)
                for gate, table, loop in zip((z, r), tables, loops, strict=False):
                    np.matmul(state, loop, out=gate)
                    gate += table[read]
                    np.exp(gate, out=gate)  # the weights are negative here; beyond the largest number it is 1 / inf
                    gate += 1
                    np.reciprocal(gate, out=gate)
                np.matmul(state, loops[2], out=new)
                new *= r
                new += tables[2][read]
                np.tanh(new, out=new)
                state -= new
                state *= z
                state += new
                score[:, t, :k] += out @ state.T
        score -= score.max(axis=0)
        np.exp(score, out=score)
        score /= score.sum(axis=0)
        return score

    def text_sums(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each text, the sum of its bytes' distributions."""
        sums = np.zeros((len(offsets) - 1, len(self.languages)))
        cut = Stretches.of(offsets, CORE, AROUND)
        for a in range(0, len(cut.doc), TOGETHER):
            some = slice(a, a + TOGETHER)
            x, alive = cut.matrix(data, some)
            x = x.astype(np.intp)
            place = np.arange(len(x))[:, None] - cut.lead[some]
            own = ((place >= 0) & (place < cut.own[some])).astype(np.float32)
            np.add.at(sums, cut.doc[some], np.einsum("kln,ln->nk", self.labels(x, alive), own))
        return sums

    def gradients(self, x: np.ndarray, alive: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over bytes and its gradients, by backpropagation through time."""
        runs = [self.states(x, alive, way, keep=True) for way in (0, 1)]
        both = np.concatenate([r[0] for r in runs], axis=2)
        score = both @ self.out + self.bias
        score = np.exp(score - score.max(axis=2, keepdims=True))
        p = score / score.sum(axis=2, keepdims=True)
        inside = np.arange(x.shape[1])[None, :] < alive[:, None]
        total = inside.sum()
        loss = -np.log(np.take_along_axis(p, target[None, :, None], 2)[..., 0] + 1e-9)[inside].sum() / total
        d = p.copy()
        np.put_along_axis(d, np.broadcast_to(target[None, :, None], (*d.shape[:2], 1)), np.take_along_axis(d, np.broadcast_to(target[None, :, None], (*d.shape[:2], 1)), 2) - 1, 2)
        d *= (inside / total)[..., None]
        d_out, d_bias = np.tensordot(both, d, ((0, 1), (0, 1))), d.sum(axis=(0, 1))
        d_both = d @ self.out.T
        h = self.loops[0].shape[0]
        d_tables, d_loops = [], []
        for way, (_, kept) in enumerate(runs):
            d_table, d_loop = np.zeros_like(self.tables[way]), np.zeros_like(self.loops[way])
            loop = self.loops[way]
            carry = np.zeros((x.shape[1], h), np.float32)
            for t, k, before, z, r, new, wide in reversed(kept):
                g = carry[:k] + d_both[t, :k, way * h : (way + 1) * h]
                d_new = g * (1 - z) * (1 - new * new)
                d_z = g * (before - new) * z * (1 - z)
                d_r = d_new * wide * r * (1 - r)
                d_given = np.concatenate([d_z, d_r, d_new], axis=1)
                d_wide = np.concatenate([d_z, d_r, d_new * r], axis=1)
                np.add.at(d_table, x[t, :k], d_given)
                d_loop += before.T @ d_wide
                carry[:k] = g * z + d_wide @ loop.T
            d_tables.append(d_table)
            d_loops.append(d_loop)
        return float(loss), [*d_tables, *d_loops, d_out, d_bias]


def train(texts: list[str], labels: list[str], hidden: int = 12, length: int = 64, epochs: int = 4, batch: int = 128, rate: float = 0.015, seed: int = 5) -> Network:
    """A network fitted by Adam to all bytes of the texts, in stretches of ``length``, each byte labelled with its
    text's language."""
    languages = sorted(set(labels))
    net, rng = Network.fresh(languages, hidden, seed), np.random.default_rng(seed)
    data, offsets = text_bytes(plain_strings(pa.array(texts, pa.string())))
    data, cut = _LOWER[data], Stretches.of(offsets, length, 0)
    target = np.array([languages.index(x) for x in labels], np.int64)[cut.doc]
    first, second = [np.zeros_like(w) for w in net.weights()], [np.zeros_like(w) for w in net.weights()]
    step, steps = 0, epochs * -(-len(cut.doc) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(cut.doc))
        for a in range(0, len(order), batch):
            some = np.sort(order[a : a + batch])  # stretches are numbered by falling length
            x, alive = cut.matrix(data, some)
            _, grads = net.gradients(x, alive, target[some])
            step += 1
            pace = rate * (1 - step / (steps + 1))
            for w, g, m, v in zip(net.weights(), grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def predict(net: Network, column: pa.Array | pa.ChunkedArray) -> tuple[list[str], np.ndarray]:
    """The language and score of each text."""
    texts = plain_strings(column)
    data, offsets = text_bytes(texts)
    share = net.text_sums(_LOWER[data], offsets) / np.maximum(np.diff(offsets), 1)[:, None]
    best = share.argmax(axis=1)
    letter = np.array([bool(LETTER.search(t)) for t in texts.to_pylist()], bool)
    names = [net.languages[b] if ok else "und" for b, ok in zip(best, letter, strict=True)]
    return names, np.where(letter, np.clip(share.max(axis=1, initial=0), 0, 1), 0.0)


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row."""
    if net is None:
        return docs.select(id_col, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, text_col, 2 << 20):
            names, score = predict(shared.value, table.column(text_col))
            yield pa.record_batch({id_col: table.column(id_col).combine_chunks(), "lang_pred": pa.array(names, pa.string()), "score": pa.array(score)})
        tidy()

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def sample(known: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, pieces: int) -> DataFrame:
    """(lang, piece) of a bounded sample; see the module's text. Rows are counted by language first, and those whose
    hash is far from the smallest ones are left out before any are ranked, so the ranking meets few of them."""
    usable = known.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    counts = usable.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row for each output of the network
    if not counts:
        return usable.select("lang", F.col("text").alias("piece"))
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, 4 * per_language / r["n"]))))
    drawn = usable.filter((F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)) <= share[F.col("lang")])
    place = Window.partitionBy("lang")
    rows = drawn.withColumn("r", F.row_number().over(place.orderBy(F.xxhash64("id", F.lit(11)), "id", "text"))).filter(F.col("r") <= per_language)
    cut = rows.select("lang", "id", F.posexplode(F.expr("transform(sequence(0, greatest(length(text) - 1, 0) div 200), i -> substr(text, int(i * 200 + 1), 200))")).alias("i", "piece"))
    return cut.withColumn("r", F.row_number().over(place.orderBy(F.xxhash64("id", "i"), "piece"))).filter(F.col("r") <= pieces).select("lang", "piece")


def fit(known: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 300, pieces: int = 800) -> Network | None:
    """A network trained on a bounded sample of the rows with text and language; None without any."""
    rows = sample(known, id_col, text_col, lang_col, per_language, pieces).orderBy("lang", "piece").toArrow()
    return train(rows["piece"].to_pylist(), rows["lang"].to_pylist()) if rows.num_rows else None


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents``; a fifth of them, by the checksum of the id, is held out of training."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    net = fit(docs.filter(~held))
    return identify(docs, net).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")
