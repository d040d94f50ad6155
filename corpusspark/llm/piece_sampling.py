"""Sampled SentencePiece segmentations by forward filtering and backward sampling; lossless decoding.

The lattice of a text has a node per character place and an edge per piece of the public model, or the bytes of a
character that no piece covers.  No piece has a blank after another character, and none holds a line break, so the
lattice falls into one per word.  Forward filtering runs once per different word of a task: each node keeps its edges'
cumulative posterior.  Backward sampling then runs for all words of a slice at once, one edge per step, from numbers
that only the seed, the row's key, the word's place and the step decide.  The model is BPE: its ranks stand for
probabilities by Zipf's law, p = (rank + 1) ** -sharpness; nothing is trained.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, small_batches, trim_memory

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SHARPNESS = 0.3
#: Characters sampled at once, characters of new words filtered at once, and nodes of different words a task keeps
#: before it starts its table anew.
SLICE, CHUNK, NODES = 1 << 18, 1 << 16, 600_000
_WORD = re.compile(r" +[^ \n]*|[^ \n]+|\n")
_BLANK = "▁"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_NO_CHARACTER = 0x110000


def _codes(text: str, blanks: bool) -> np.ndarray:
    """Hash of each character.  In texts a blank is the model's sign for it, and that sign itself is in no piece."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if blanks:
        code[code == ord(_BLANK)] = _NO_CHARACTER
        code[code == 32] = ord(_BLANK)
    return _mix(code + np.uint64(1))


class Pieces:
    """The model's pieces: bytes and log weights by id, and a hash table of their strings."""

    def __init__(self, model: bytes, sharpness: float = SHARPNESS):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.raw: list[bytes] = [b""] * n
        self.byte_id: list[int] = [-1] * 256
        self.weight = -sharpness * np.log(np.arange(n) + 2.0)
        ids, names = [], []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
                self.weight[i] = -sharpness * math.log(n + 1.0)
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                ids.append(i)
                names.append(piece)
                self.raw[i] = piece.replace(_BLANK, " ").encode()
        self.longest = max(map(len, names))
        keys = np.zeros(len(names), np.uint64)
        for k, name in enumerate(names):
            h = np.zeros(1, np.uint64)
            for c in _codes(name, False):
                h = h * _FACTOR + c
            keys[k] = _mix(h)[0]
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(ids, np.int32)[order]
        self.bins = np.searchsorted(self.keys >> np.uint64(48), np.arange((1 << 16) + 1, dtype=np.uint64))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Id of the piece with that hash, or -1."""
        keys = _mix(hashes)
        top = (keys >> np.uint64(48)).astype(np.int64)
        at, end = self.bins[top], self.bins[top + 1]
        out = np.full(len(keys), -1, np.int32)
        live = np.flatnonzero(at < end)
        while len(live):
            same = self.keys[at[live]] == keys[live]
            out[live[same]] = self.ids[at[live[same]]]
            at[live] += 1
            live = live[~same & (at[live] < end[live])]
        return out


class Words(dict):
    """word -> row.  New words wait until :meth:`flat` filters all of them together."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces = pieces
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.strings: list[tuple[int, ...]] = []  # of edges that are several byte pieces
        self.string_of: dict[int, int] = {}
        self.nodes = 0
        self.waiting: list[str] = []
        self.tables = {n: np.zeros(0, t) for n, t in (("base", np.int64), ("length", np.int64), ("upto", float), ("start", np.int32), ("piece", np.int32))}

    def __missing__(self, word: str) -> int:
        self[word] = row = len(self)
        self.waiting.append(word)
        return row

    def flat(self) -> dict[str, np.ndarray]:
        """base and length per word; per edge upto (node + cumulative posterior, increasing over all), start place and
        piece (an id, or -1 - row of ``strings``)."""
        parts, run, size = [self.tables], [], 0
        for i, word in enumerate(self.waiting):
            run.append(word)
            size += len(word)
            if size > CHUNK or i == len(self.waiting) - 1:
                new = self._filter(run)
                parts.append({n: new[n].astype(t.dtype) for n, t in self.tables.items()})
                self.nodes += size
                run, size = [], 0
        if self.waiting:
            for n in self.tables:  # one column at a time: the old one goes before the next is copied
                self.tables[n] = np.concatenate([p.pop(n) if p is not self.tables else p[n] for p in parts])
            self.waiting = []
        return self.tables

    def _spelled(self, code: int) -> int:
        """Edge of a character that is no piece: its byte pieces."""
        if code not in self.string_of:
            ids = tuple(self.pieces.byte_id[b] for b in chr(code).encode("utf-8", "surrogatepass"))
            self.strings.append(ids)
            self.string_of[code] = -len(self.strings)
        return self.string_of[code]

    def _filter(self, words: list[str]) -> dict[str, np.ndarray]:
        pieces, text = self.pieces, "".join(words)
        length = np.array([len(w) for w in words], np.int64)
        base = np.cumsum(length) - length
        n = len(text)
        place = np.arange(n) - np.repeat(base, length)
        left = np.repeat(length, length) - place  # characters up to the word's end
        codes = _codes(text, True)
        starts, ends, found = [], [], []
        h = np.zeros(n, np.uint64)
        for size in range(1, min(pieces.longest, int(length.max())) + 1):
            h = h[: n - size + 1] * _FACTOR + codes[size - 1 :]
            at = np.flatnonzero(left[: n - size + 1] >= size)
            ids = pieces.find(h[at])
            if size == 1:
                plain = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                bare = np.flatnonzero(ids < 0)
                ids[bare] = -2 - np.array([-1 - self._spelled(c) for c in plain[bare].tolist()], np.int32)
            hit = np.flatnonzero(ids != -1)
            starts.append(at[hit])
            ends.append(at[hit] + size - 1)  # the last character's node
            found.append(ids[hit])
        start, end, piece = map(np.concatenate, (starts, ends, found))
        piece = np.where(piece < -1, piece + 1, piece)
        own = np.array([pieces.weight[list(s)].sum() for s in self.strings] or [0.0])
        weight = np.where(piece >= 0, pieces.weight[np.maximum(piece, 0)], own[np.maximum(-1 - piece, 0)])
        order = np.lexsort((start, end, place[end]))
        start, end, piece, weight = start[order], end[order], piece[order], weight[order]
        level = np.searchsorted(place[end], np.arange(int(length.max()) + 1))
        forward, chance = np.zeros(n + 1), np.empty(len(end))
        for a, b in zip(level[:-1], level[1:], strict=True):  # places of all words, in step
            e = end[a:b]
            heads = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
            logs = weight[a:b] + np.where(place[start[a:b]] > 0, forward[start[a:b] - 1], 0.0)
            top = np.maximum.reduceat(logs, heads)
            sizes = np.diff(np.concatenate([heads, [b - a]]))
            part = np.exp(logs - np.repeat(top, sizes))
            whole = np.add.reduceat(part, heads)
            forward[e[heads]] = top + np.log(whole)
            chance[a:b] = part / np.repeat(whole, sizes)
        order = np.lexsort((start, end))
        start, end, piece, chance = start[order], end[order], piece[order], chance[order]
        run = np.cumsum(chance)
        last = np.concatenate([end[1:] != end[:-1], [True]])
        before = np.concatenate([[0.0], run[last][:-1]])
        within = np.clip(run - before[np.cumsum(last) - last], 0.0, 1.0)
        within[last] = 1.0
        return {"base": base + self.nodes, "length": length, "upto": end + self.nodes + within, "start": place[start], "piece": piece}


def key_seed(key: object, seed: int) -> int:
    return xxhash.xxh64_intdigest(f"{seed}:{key}")


def sample(words: Words, texts: list[str], seeds: list[int]) -> list[np.ndarray]:
    """Ids of one sampled segmentation per text."""
    rows: list[int] = []
    counts = []
    for t in texts:
        found = list(map(words.__getitem__, _WORD.findall(t)))
        counts.append(len(found))
        rows += found
    at = np.array(rows, np.int64)
    ends = np.cumsum(counts, dtype=np.int64)
    if not len(at):
        return [np.zeros(0, np.int32) for _ in texts]
    flat = words.flat()
    upto, start, piece = flat["upto"], flat["start"], flat["piece"]
    base, place = flat["base"][at], flat["length"][at]
    number = np.arange(len(at), dtype=np.int64) - np.repeat(ends - counts, counts)
    state = _mix(np.repeat(np.array(seeds, np.uint64), counts) + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    live, taken, owner = np.arange(len(at)), [], []
    step = 0
    while len(live):
        drawn = (_mix(state[live] + np.uint64((step + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(12)).astype(float) / float(1 << 52)
        edge = np.searchsorted(upto, base[live] + place[live] - 1 + drawn, side="right")
        taken.append(piece[edge])
        owner.append(live)
        place[live] = start[edge]
        live = live[place[live] > 0]
        step += 1
    steps = np.concatenate([np.full(len(o), i) for i, o in enumerate(owner)])
    owned, ids = np.concatenate(owner), np.concatenate(taken)
    per_word = np.bincount(owned, minlength=len(at))
    first = np.cumsum(per_word) - per_word
    out = np.empty(len(ids), np.int32)
    out[first[owned] + per_word[owned] - 1 - steps] = ids  # the last edge was drawn first
    cuts = np.concatenate([first, [len(ids)]])[np.concatenate([[0], ends])]
    parts = [out[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [p if not len(p) or p.min() >= 0 else _spell(p, words.strings) for p in parts]


def _spell(ids: np.ndarray, strings: list[tuple[int, ...]]) -> np.ndarray:
    return np.array([x for i in ids.tolist() for x in ((i,) if i >= 0 else strings[-1 - i])], np.int32)


def decode_ids(raw: list[bytes], ids: list[int]) -> str:
    return b"".join([raw[i] for i in ids]).decode("utf-8", "surrogatepass")


_LOADED: dict[tuple, Pieces] = {}


def _pieces(model: bytes, sharpness: float) -> Pieces:
    key = (xxhash.xxh64_intdigest(model), sharpness)
    if key not in _LOADED:
        _LOADED[key] = Pieces(model, sharpness)
    return _LOADED[key]


def _encoded(words: Words, keys: list, texts: list[str | None], seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids) in order, slice by slice; null texts have no ids."""
    run, size = [], 0
    for i, t in enumerate(texts):
        run.append(i)
        size += len(t or "")
        if size > SLICE or i == len(texts) - 1:
            if words.nodes > NODES:
                words.restart()
            yield from zip(run, sample(words, [texts[k] or "" for k in run], [key_seed(keys[k], seed) for k in run]), strict=True)
            run, size = [], 0


def _model_bytes(df: DataFrame, path: str):
    with open(path, "rb") as f:  # half a MB, read where the job is written
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", ids_col: str = "piece_ids", seed: int = 0,
           model_path: str = MODEL, sharpness: float = SHARPNESS) -> DataFrame:
    """The table with ``ids_col`` as its last column (underscores in front where the name is taken): a sampled segmentation
    of each text.  Null texts have null, empty texts no ids.

    Rows of one key and text get the same segmentation at any time and in any task; null keys count as 'None'.
    """
    ids_col = free_name(df, ids_col)
    model = _model_bytes(df, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(_pieces(model.value, sharpness))
        for batch in small_batches(batches):
            texts = batch.column(text_col).to_pylist()
            ids = [x for _, x in _encoded(words, batch.column(key_col).to_pylist(), texts, seed)]
            lists = pa.array([None if t is None else x for t, x in zip(texts, ids, strict=True)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, ids_col])
        del words
        trim_memory()

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, ids_col: str = "piece_ids", text_col: str = "decoded", model_path: str = MODEL) -> DataFrame:
    """The table with ``text_col``: the texts that the ids spell; null ids have null."""
    model = _model_bytes(df, model_path)

    @F.pandas_udf("string")
    def spell(ids: pd.Series) -> pd.Series:
        raw = _pieces(model.value, SHARPNESS).raw
        return pd.Series([None if x is None else decode_ids(raw, x.tolist()) for x in ids], dtype=object)

    return df.withColumn(text_col, spell(F.col(ids_col)))


def digests(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", seed: int = 0, model_path: str = MODEL,
            sharpness: float = SHARPNESS) -> DataFrame:
    """Per row: doc_id, n_chars, n_pieces, ids_crc32 (of the ids as 32-bit integers), text_crc32, lossless.

    Encodes, decodes and compares row by row without carrying ids or texts any further.  A null text counts as empty.
    """
    model = _model_bytes(df, model_path)
    rows = df.select(F.col(key_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = _pieces(model.value, sharpness)
        words = Words(pieces)
        for batch in batches:
            texts, out = batch["text"].tolist(), []
            for i, ids in _encoded(words, batch["doc_id"].tolist(), texts, seed):
                text = texts[i] or ""
                out.append((len(text), len(ids), zlib.crc32(ids.astype("<i4").tobytes()), zlib.crc32(text.encode("utf-8", "surrogatepass")),
                            decode_ids(pieces.raw, ids.tolist()) == text))
            done = pd.DataFrame(out, columns=["n_chars", "n_pieces", "ids_crc32", "text_crc32", "lossless"])
            yield pd.concat([batch[["doc_id"]].reset_index(drop=True), done], axis=1)
        del words
        trim_memory()

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInPandas(run, f"doc_id {kind}, n_chars long, n_pieces long, ids_crc32 long, text_crc32 long, lossless boolean")
