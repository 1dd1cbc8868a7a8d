"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

The vocabulary is a tokenizer file of the word-end kind: lower-cased NFC text, split into runs of letters,
single digits and runs of other signs; the last byte of a piece carries the word-end mark. Instead of
applying merges by rank, the encoder takes the longest token at each position (all matches of a piece
come from one Aho-Corasick pass), accepts it if the merges would never have joined or split it with the
token before it (the pair-compatibility test), and otherwise falls back to the next shorter match or one
token back. Positions known to lead nowhere are marked, so each is left at most once: the work is linear.

White space never is part of a piece and pieces never span it, so equal white-space-separated words have
equal ids; each worker remembers those of the words it met, up to ``CACHE_BYTES`` of them. Words with signs that Unicode
versions treat differently (``in_doubt``) are normalised and split by the tokenizers library, so that its tables hold.

Defined results. Null and empty texts, and those of white space alone, have no ids and decode to the empty
string; texts of any length are encoded whole. An empty table gives an empty one. The strings of special tokens in a text become their ids, as the file's added tokens say. Ids are
packed as little-endian unsigned 32-bit integers in one binary. Decoding joins the token strings by one
space (the file has no decoder); an id outside the vocabulary is an error. Rows are independent of each
other: repeated rows and ties need no rule. Extra columns are carried along; a clash of names is an error.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from fleetspark.llm.common import chunks, plain_strings, tidy

#: Fixed values of the file format: the split pattern and the word-end mark.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
SPACE = regex.compile(r"\s+")
WORD_END = "</w>"
#: Signs that str.split() takes for white space and the pattern does not.
NOT_SPACE = "\x1c\x1d\x1e\x1f"
#: About the most bytes of words and ids that a worker remembers; longer words are not kept, and what each entry takes besides.
CACHE_BYTES, LONGEST, ENTRY = 64 << 20, 256, 200
#: The most pairs of tokens whose compatibility a worker remembers.
PAIRS = 150_000
#: Last bytes of a piece are written as signs from here on, so that a token's place in a piece is part of its string.
_LAST = 0x10000


def in_doubt(sign: str) -> bool:
    """Whether Unicode tables of different age may treat the sign differently: this Python's table calls it unassigned,
    or it is a mark that came after Unicode 3.2."""
    kind = unicodedata.category(sign)
    return kind == "Cn" or kind[0] == "M" and unicodedata.ucd_3_2_0.category(sign) == "Cn"


def byte_signs() -> list[str]:
    """The printable sign of each byte: itself if it has one, else the next free sign from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


@dataclass
class Vocabulary:
    """What the tasks need of a tokenizer file: token strings by id, the pair each was merged from, added tokens."""

    tokens: list[str]
    pairs: list[tuple[int, int]]
    first_merge: int
    added: dict[str, int]

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        first = len(vocab) - len(merges)
        if any(vocab[a + b] != first + i for i, (a, b) in enumerate(merges)):
            raise ValueError(f"{path}: ids don't follow the merges")
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = [""] * (max([*vocab.values(), *added.values()]) + 1)
        for text, i in [*vocab.items(), *added.items()]:
            tokens[i] = text
        return cls(tokens, [(vocab[a], vocab[b]) for a, b in merges], first, added)


class Encoder(dict):
    """Maps a word to its packed ids; pieces are encoded when first met."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v = vocabulary
        self.held = 0
        self.older: dict[str, bytes] = {}
        self.sure: set[str] = set()
        self.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.splitter = pre_tokenizers.Split(Regex(PIECE.pattern), "removed", invert=True)
        self.signs = byte_signs()
        self.joined = {pair: vocabulary.first_merge + i for i, pair in enumerate(vocabulary.pairs)}
        last_of = {s: chr(_LAST + b) for b, s in enumerate(self.signs)}
        plain_of = {s: chr(b) for b, s in enumerate(self.signs)}
        self.lengths = [0] * len(vocabulary.tokens)
        self.matcher = ahocorasick.Automaton()
        n, keys = vocabulary.first_merge + len(vocabulary.pairs), []
        for i, token in enumerate(vocabulary.tokens[:n]):
            ends = token.endswith(WORD_END) and token != WORD_END
            body = token[: -len(WORD_END)] if ends else token
            key = "".join(plain_of[s] for s in body[:-1]) + (last_of if ends else plain_of)[body[-1]]
            self.lengths[i] = len(key)
            self.matcher.add_word(key, (i, len(key) - 1))
            keys.append(key)
        # the longest token that a token begins with
        self.shorter = [next((self.matcher.get(k[:m])[0] for m in range(len(k) - 1, 0, -1) if self.matcher.exists(k[:m])), -1) for k in keys]
        self.matcher.make_automaton()
        self.compatible: dict[int, bool] = {}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.added, key=len, reverse=True))) + ")") if vocabulary.added else None

    def parts(self, token: int) -> tuple[int, int]:
        """The two tokens that were merged into it; a byte's token stands for itself."""
        i = token - self.v.first_merge
        return self.v.pairs[i] if i >= 0 else (token, token)

    def together(self, a: int, b: int) -> bool:
        """Whether the merges leave a and b as neighbours: undoing the later merge on either side of the
        border again and again, no pair across it may have been merged before those merges were made."""
        left, right, before, good = a, b, 1 << 40, True
        while True:
            if self.joined.get((left, right), before) < before:
                good = False
                break
            inner_left, inner_right = self.parts(left)[1], self.parts(right)[0]
            undo_left = inner_left != left and (left > right or inner_right == right)
            if undo_left:
                before, left = left, inner_left
            elif inner_right != right:
                # a pair of the same rank further left is merged first
                before, right = right + 1, inner_right
            else:
                break
        if len(self.compatible) > PAIRS:
            self.compatible.clear()
        self.compatible[a << 20 | b] = good
        return good

    def piece(self, text: str) -> list[int]:
        raw = text.encode("utf-8")
        n = len(raw)
        longest = [0] * n
        for end, (token, size) in self.matcher.iter(raw[:-1].decode("latin-1") + chr(_LAST + raw[-1])):
            longest[end - size] = token  # later matches from the same place are longer
        lengths, shorter, compatible = self.lengths, self.shorter, self.compatible
        dead = bytearray(n + 1)
        out: list[int] = []
        p, token, last = 0, longest[0], -1
        while True:
            while token >= 0:
                if not dead[p + lengths[token]]:
                    if last < 0:
                        break
                    good = compatible.get(last << 20 | token)
                    if self.together(last, token) if good is None else good:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                p += lengths[token]
                if p == n:
                    return out
                last, token = token, longest[p]
            else:  # nothing fits here: one token back, and a shorter one there
                dead[p] = 1
                last = out.pop()
                p -= lengths[last]
                token = shorter[last]
                last = out[-1] if out else -1

    def pieces(self, word: str) -> list[str]:
        if not word.isascii():
            if not self.sure.issuperset(word):
                if any(map(in_doubt, word)):
                    return [p for p, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(word))]
                self.sure.update(word)
            word = unicodedata.normalize("NFC", word).replace("Σ", "σ")  # lower-cased sign by sign, without the rule for word ends
        return PIECE.findall(word.lower())

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            tokens = [i for p in self.pieces(word) for i in self.piece(p)]
            ids = pack(f"<{len(tokens)}I", *tokens)
        if len(word) <= LONGEST:
            self.held += len(word) + len(ids) + ENTRY
            if self.held > CACHE_BYTES // 2:  # words that were not met again since the last turn are forgotten
                self.older = dict(self)
                self.clear()
                self.held = 0
            self[word] = ids
        return ids

    def plain(self, text: str) -> bytes:
        """The ids of a text without special tokens."""
        words = SPACE.split(text) if any(sign in text for sign in NOT_SPACE) else text.split()
        return b"".join(map(self.__getitem__, words))

    def encode(self, text: str) -> bytes:
        if self.special is None or "<|" not in text:
            return self.plain(text)
        return b"".join(np.array([self.v.added[s]], "<u4").tobytes() if s in self.v.added else self.plain(s) for s in self.special.split(text))


class Decoder:
    """Token strings end to end in one buffer, each with the space that follows it, and where they start."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        strings = [(t + " ").encode() for t in vocabulary.tokens]
        self.blob = np.frombuffer(b"".join(strings), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(s) for s in strings])))

    def decode(self, ids: np.ndarray) -> bytes:
        begin, end = self.offsets[ids], self.offsets[ids + 1]
        size = end - begin
        into = np.cumsum(size) - size
        take = np.repeat(begin - into, size) + np.arange(int(size.sum()))
        return self.blob[take].tobytes()[:-1]


class _Shared:
    """One encoder or decoder a worker for a broadcast vocabulary."""

    made: dict = {}

    @classmethod
    def of(cls, broadcast, kind):
        vocabulary = broadcast.value
        if kind not in cls.made or cls.made[kind].v is not vocabulary:
            cls.made[kind] = kind(vocabulary)
        return cls.made[kind]


def _added(df: DataFrame, kinds: dict[str, str]) -> str:
    if clash := set(kinds) & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} are there already; choose other names")
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"`{name}` {kind}" for name, kind in kinds.items())])


def _decoded(decoder: Decoder, ids: list[bytes | None]) -> pa.Array:
    return pa.array([decoder.decode(np.frombuffer(x, "<u4").astype(np.int64)) if x else b"" for x in ids], pa.binary()).cast(pa.string())


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the packed ids of each whole text, by the vocabulary file at ``path`` (read by the driver), and, if
    ``decoded_col`` is given, the text that these ids decode to, made in the same pass. ``keep``: the columns of
    ``docs`` that are wanted beside them (all)."""
    kept = docs.columns if keep is None else keep
    schema = _added(docs.select(kept), {ids_col: "binary"} | ({decoded_col: "string"} if decoded_col else {}))
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Shared.of(shared, Encoder)
        for table in chunks(batches, text_col, 1 << 20):
            ids = [encoder.encode(t) for t in plain_strings(table.column(text_col)).to_pylist()]
            out = table.select(kept).append_column(ids_col, pa.array(ids, pa.binary()))
            if decoded_col:
                out = out.append_column(decoded_col, _decoded(_Shared.of(shared, Decoder), ids))
            yield from out.combine_chunks().to_batches()
        tidy()

    return docs.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``df`` with the text that its packed ids stand for, special tokens included (null ids: empty)."""
    schema = _added(df, {decoded_col: "string"})
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary.read(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _Shared.of(shared, Decoder)
        for table in chunks(batches, ids_col, 1 << 20):
            yield from table.append_column(decoded_col, _decoded(decoder, table.column(ids_col).to_pylist())).combine_chunks().to_batches()
        tidy()

    return df.mapInArrow(run, schema)


def op8_bpe(spark, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Whole ``documents``: number and digest of the ids, digest of the decoded text."""
    import public_tokenizers

    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, path, decoded_col="decoded", keep=["doc_id"]).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
