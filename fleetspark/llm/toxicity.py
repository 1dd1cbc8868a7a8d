"""Toxic spans by a linear-chain conditional random field.

Tokens are the white-space-separated words of a sentence (a line, ended earlier by . ! or ?, or after ``LONGEST``
words, so that a text without stops is read in bounded steps). The field has two
states, toxic or not, emissions from the word itself, its beginnings and ends and its length, and transitions.
Documents carry labels, tokens do not: token labels for training come from the documents' labels. Words and
parts of words that stand in so many different surroundings in toxic documents, and practically in none in clean ones,
that chance does not explain it, make a lexicon; their occurrences in toxic documents are labelled toxic. The field is trained on those tokens by gradient ascent
of the conditional likelihood (forward-backward), with L2 regularisation.

Scoring reads every whole text: forward-backward gives each token's marginal; the tokens over one half are the
offending ones, given by character offsets. The largest marginal and the expected number and share of toxic
tokens, combined by a logistic fit on the training documents, are the document's score.

Training takes ``most_labelled`` toxic and twice as many clean documents at most, those with the smallest hash of the
id, of texts up to ``most_chars`` signs, and of their sentences ``most_sentences`` at most, half of them with a toxic
token. Scoring has no such bounds.

Defined results. Null, empty and blank texts have no tokens and the score of a text without any toxic one. Without
labels of both kinds, or without a word in the labelled texts, every score is 0. Equal texts have equal scores. A null
label is no label; of repeated labels of an id the toxic one counts. Rows that repeat an id, or have none, are scored
each by its own text. An empty table gives no rows. Other columns are not read, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.llm.common import chunks, plain_strings
from fleetspark.llm.words import Words, mix, words_of

FEATURE_BITS = 18
N_FEATURES = 11
#: The most words whose emission a worker remembers.
CACHE = 500_000
#: The most words of a sentence.
LONGEST = 256
_STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_STOPS = np.isin(np.arange(256), [ord(c) for c in ".!?"])


def units(core: str) -> list[str]:
    """A word, its beginnings and its ends, each with a sign of its kind."""
    return ["w" + core, *("a" + core[:k] for k in range(3, min(8, len(core) + 1))), *("z" + core[-k:] for k in range(3, min(6, len(core) + 1)))]


def features(word: str) -> list[int]:
    """Hashed features of a lower-cased word: its units (as many for every word), its length, a constant."""
    core = word.strip(_STRIP) or word
    named = ["1", "n" + str(min(len(core), 12)), *units(core)]
    return [crc32(f.encode()) & ((1 << FEATURE_BITS) - 1) for f in (named + ["1"] * (N_FEATURES - len(named)))]


def sequences(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(first word, number of words) of the sentences of all texts."""
    n = len(words.starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lines = np.concatenate(([0], np.cumsum(words.data == 10)))
    new = np.ones(n, bool)
    new[1:] = (words.doc[1:] != words.doc[:-1]) | _STOPS[words.data[words.ends[:-1] - 1]] | (lines[words.starts[1:]] > lines[words.ends[:-1]])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    parts = -(-size // LONGEST)
    first = np.repeat(first, parts) + (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * LONGEST
    return first, np.diff(np.append(first, n))


@dataclass
class Field:
    """Log weights: of hashed features for the toxic state, and of transitions (from, to)."""

    weights: np.ndarray
    moves: np.ndarray
    blend: tuple[float, ...] = (0.0, 1.0, 0.0, 0.0)

    def passes(self, odds: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward ratios (toxic to clean) of every token; sentences go in step, long ones first."""
        t = np.exp(self.moves)
        order = np.argsort(-size, kind="stable")
        begin, size = first[order], size[order]
        longest = int(size[0]) if len(size) else 0
        alive = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")
        ahead, back = np.empty(len(odds)), np.ones(len(odds))
        for k in range(longest):
            at = begin[: alive[k]] + k
            if k:
                r = ahead[at - 1]
                ahead[at] = odds[at] * (t[0, 1] + r * t[1, 1]) / (t[0, 0] + r * t[1, 0])
            else:
                ahead[at] = odds[at]
        for k in range(longest - 2, -1, -1):
            at = begin[: alive[k + 1]] + k
            e = odds[at + 1] * back[at + 1]
            back[at] = (t[1, 0] + t[1, 1] * e) / (t[0, 0] + t[0, 1] * e)
        return ahead, back

    def marginals(self, odds: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        ahead, back = self.passes(odds, first, size)
        both = ahead * back
        return both / (1 + both)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ np.array(self.blend), -40, 40)))


def _odds(total: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(total, -25, 25))


def lexicon(cores: list[str], core: np.ndarray, doc: np.ndarray, toxic: np.ndarray, least: int = 6, chance: float = 0.01, precision: float = 0.98) -> set[str]:
    """Units of words that tell toxic documents from clean ones: so frequent in toxic ones that with probability
    1 - ``chance`` none of all units would be by luck, however few of the toxic documents have it. ``core`` numbers each token's word in ``cores``. What
    counts is in how many different surroundings (the words before and after) the words of a unit stand, so that
    copies of one passage count once."""
    edge = np.append(np.flatnonzero(np.diff(doc, prepend=-1)), len(doc))
    before, after = np.roll(core, 1), np.roll(core, -1)
    before[edge[:-1]] = after[edge[1:] - 1] = len(cores)
    places = mix(mix(before.astype(np.uint64) + np.uint64(1)) * np.uint64(3) + mix(core.astype(np.uint64)) * np.uint64(5) + mix(after.astype(np.uint64) + np.uint64(7)))
    counts = []
    for kind in (True, False):
        _, at = np.unique(places[toxic[doc] == kind], return_index=True)
        per_word = np.bincount(core[toxic[doc] == kind][at], minlength=len(cores))
        total: dict[str, int] = {}
        for i in np.flatnonzero(per_word).tolist():
            for unit in units(cores[i]):
                total[unit] = total.get(unit, 0) + int(per_word[i])
        counts.append(total)
    n_bad = int(toxic.sum())
    rate = n_bad / max(1, len(toxic) - n_bad)
    enough = max(least, np.log(max(1, len(counts[0])) / chance) / -np.log(n_bad / len(toxic)))
    return {u for u, n in counts[0].items() if n >= enough and n >= precision * (n + rate * counts[1].get(u, 0))}


def train(texts: list[str], toxic: list[bool], epochs: int = 60, most_sentences: int = 12_000, ridge: float = 1e-3, seed: int = 3) -> Field | None:
    """The field of labelled texts; None without texts of both kinds."""
    seen: dict[str, bool] = {}
    for text, bad in zip(texts, toxic, strict=True):
        seen.setdefault(text, bad)
    texts, kinds = list(seen), np.array(list(seen.values()), bool)
    if not kinds.any() or kinds.all():
        return None
    words = words_of(pa.array(texts, pa.string()), lower=True)
    if not len(words.starts):
        return None
    _, at, token = np.unique(words.hashes(), return_index=True, return_inverse=True)
    distinct = [bytes(words.data[words.starts[i] : words.ends[i]]).decode("utf-8", "replace") for i in at]
    cores: dict[str, int] = {}
    core = np.array([cores.setdefault(t.strip(_STRIP) or t, len(cores)) for t in distinct], np.int64)
    known = lexicon(list(cores), core[token], words.doc, kinds)
    marked = np.array([not known.isdisjoint(units(c)) for c in cores], bool)
    gold = marked[core[token]] & kinds[words.doc]
    first, size = sequences(words)
    has = np.add.reduceat(gold, first) > 0
    rng = np.random.default_rng(seed)
    # sentences of explained documents without a labelled token, and of clean documents
    some = np.concatenate([rng.permutation(np.flatnonzero(has))[: most_sentences // 2], rng.permutation(np.flatnonzero(~has))[: most_sentences // 2]])
    offset = np.cumsum(size[some]) - size[some]
    at = np.repeat(first[some] - offset, size[some]) + np.arange(int(size[some].sum()))
    met, f = np.unique(token[at], return_inverse=True)
    f = np.array([features(distinct[i]) for i in met], np.int64)[f]
    y, first, size = gold[at].astype(float), offset, size[some]
    used, f = np.unique(f, return_inverse=True)
    f = f.reshape(len(at), -1)
    w, moves = np.zeros(len(used)), np.zeros((2, 2))
    inner = np.ones(len(at), bool)
    inner[first] = False
    to = np.flatnonzero(inner)
    gw, gm = np.zeros_like(w) + 1e-8, np.zeros_like(moves) + 1e-8
    seen_moves = np.array([[((1 - y[to - 1]) * (1 - y[to])).sum(), ((1 - y[to - 1]) * y[to]).sum()], [(y[to - 1] * (1 - y[to])).sum(), (y[to - 1] * y[to]).sum()]])
    for _ in range(epochs):
        field = Field(w, moves)
        odds = _odds(w[f].sum(axis=1))
        ahead, back = field.passes(odds, first, size)
        p = ahead * back / (1 + ahead * back)
        e, r, t = odds[to] * back[to], ahead[to - 1], np.exp(moves)
        joint = np.stack([t[0, 0] + 0 * e, t[0, 1] * e, r * t[1, 0], r * t[1, 1] * e])
        joint = (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
        grad = np.bincount(f.ravel(), np.repeat(y - p, f.shape[1]), minlength=len(used)) - ridge * len(some) * w
        grad_m = seen_moves - joint - ridge * len(some) * moves
        gw += grad * grad
        gm += grad_m * grad_m
        w = w + 0.5 * grad / np.sqrt(gw)
        moves = moves + 0.2 * grad_m / np.sqrt(gm)
    full = np.zeros(1 << FEATURE_BITS)
    full[used] = w
    return _calibrated(Field(full, moves), texts, kinds.tolist())


def _calibrated(field: Field, texts: list[str], toxic: list[bool], ridge: float = 0.5) -> Field:
    """The field with the logistic that turns a document's evidence into its score, fitted by Newton steps."""
    x = Reader(field).read(pa.chunked_array([pa.array(texts, pa.string())]))[0]
    y = np.array(toxic, float)
    blend, hold = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    hold[0, 0] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ blend, -40, 40)))
        blend = blend + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold, x.T @ (y - p) - hold @ blend)
    field.blend = tuple(blend.tolist())
    return field


class Reader:
    """Marginals of tables of texts, remembering the emissions of words."""

    def __init__(self, field: Field):
        self.field = field
        self.known: dict[int, float] = {}

    def emissions(self, words: Words) -> np.ndarray:
        distinct, at, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > CACHE:
            self.known.clear()
        out = np.empty(len(distinct))
        for i, h in enumerate(distinct.tolist()):
            value = self.known.get(h)
            if value is None:
                word = bytes(words.data[words.starts[at[i]] : words.ends[at[i]]]).decode("utf-8", "replace")
                value = self.known[h] = float(self.field.weights[features(word)].sum())
            out[i] = value
        return _odds(out)[inverse]

    def read(self, column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, Words]:
        """(evidence of each text, marginal of each word, the words). Evidence: a constant, the log odds of the
        largest marginal, the logs of the expected toxic tokens and of their share."""
        words = words_of(column, lower=True)
        first, size = sequences(words)
        p = self.field.marginals(self.emissions(words), first, size)
        n = len(column)
        top = np.full(n, 1e-4)
        np.maximum.at(top, words.doc, p)
        top = np.minimum(top, 1 - 1e-4)
        mass = np.bincount(words.doc, np.where(p > 0.3, p, 0), minlength=n)
        share = mass / (words.counts + 20)
        return np.stack([np.ones(n), np.log(top / (1 - top)), np.log1p(mass), np.log1p(200 * share)], axis=1), p, words


def score(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, spans) of every row; spans are the character ranges {start, stop} of offending tokens."""
    kind = docs.schema[id_col].dataType.simpleString()
    if field is None:
        return docs.select(id_col, F.lit(0.0).alias("score"), F.array().cast("array<struct<start:long,stop:long>>").alias("spans"))
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for table in chunks(batches, text_col, 2 << 20):
            evidence, p, words = reader.read(table.column(text_col))
            marked = np.flatnonzero(p > 0.5)
            spans: list[list[dict]] = [[] for _ in range(table.num_rows)]
            texts = plain_strings(table.column(text_col))
            base = np.concatenate(([0], np.cumsum(np.asarray(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False), np.int64))))
            lead = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80))) if len(marked) else None
            for i in marked:
                d = int(words.doc[i])
                spans[d].append({"start": int(lead[words.starts[i]] - lead[base[d]]), "stop": int(lead[words.ends[i]] - lead[base[d]])})
            yield pa.record_batch(
                {id_col: table.column(id_col).combine_chunks(), "score": pa.array(reader.field.score(evidence)), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))}
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, spans array<struct<start:long,stop:long>>")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_labelled: int = 1_000, most_chars: int = 50_000) -> Field | None:
    """The field of a bounded sample of labelled rows, of 3 * ``most_labelled`` texts at most."""
    known = labels.filter(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias(label_col))
    ranked = known.filter(F.col(label_col) == 1).orderBy(F.xxhash64(id_col), id_col).limit(most_labelled).union(known.filter(F.col(label_col) == 0).orderBy(F.xxhash64(id_col), id_col).limit(2 * most_labelled))
    texts = docs.select(id_col, F.col(text_col).alias("_text")).filter(F.length("_text") <= most_chars)
    rows = texts.join(F.broadcast(ranked), id_col).select(id_col, "_text", F.col(label_col).alias("_label")).orderBy(F.xxhash64(id_col, "_text"), id_col, "_text").limit(3 * most_labelled).toArrow()
    return train(rows["_text"].to_pylist(), [x == 1 for x in rows["_label"].to_pylist()])


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents``; a third of them, by the checksum of the id, is held out of training."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    field = fit(docs.filter(~held), labels.filter(~held))
    out = score(docs, field)
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
