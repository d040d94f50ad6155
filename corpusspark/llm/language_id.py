"""Language identification by error-correcting output codes.

Every language gets a codeword.  For each bit a binary classifier over hashed character n-grams says on which side of
the bit a text is: the log-odds of the two sides' n-gram distributions, averaged over the text.  Decoding sums an
exponential loss over the bits, weighted by how well a bit separates that language, and takes the nearest codeword;
the text is ambiguous when the second is about as near.  The distributions are counted over all training rows in one
Spark aggregation; integers make the sums the same in any order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import trim_memory

BUCKETS = 1 << 13
NGRAMS = (2, 3, 4)
#: Characters of text handled at once, fixed-point factor of counts, smoothing, sharpness of the score, least lead.
SLICE, FIXED, SMOOTH, SHARP, LEAD = 1 << 20, 1 << 16, 0.5, 4.0, 0.25
#: A text fits no language when its nearest codeword is farther than this many times what 90 % of the labelled texts of
#: its length class stay within.  Classes by code points; those with fewer rows than ``CLASS_ROWS`` use all classes' value.
SLACK, USUAL, LENGTHS, CLASS_ROWS = 1.75, 0.9, (30, 100, 400, 2000), 20
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: Bytes of the lower-cased UTF-8 text: ASCII letters and all of longer characters stay, the rest is a blank.
_KEEP = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_GAP = b"    "


def _buckets(raw: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n bytes from each place on (as many as there are bytes, less n - 1)."""
    code = raw[: len(raw) - n + 1].astype(np.uint32)
    for i in range(1, n):
        code |= raw[i : len(raw) - n + 1 + i].astype(np.uint32) << np.uint32(8 * i)
    code *= np.uint32(2654435761)
    code ^= np.uint32(n * 40503)
    return (code * np.uint32(2246822519)) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def gram_counts(texts: list[str]) -> np.ndarray:
    """(texts, BUCKETS) counts of 2- to 4-grams; blanks between texts keep their n-grams apart."""
    parts = [t.lower().encode("utf-8", "replace").translate(_KEEP) + _GAP for t in texts]
    raw = np.frombuffer(b"".join(parts), np.uint8)
    row = np.repeat(np.arange(len(parts), dtype=np.int64) * BUCKETS, [len(p) for p in parts])
    out = np.zeros(len(parts) * BUCKETS, np.int64)
    for n in NGRAMS:
        out += np.bincount(row[: len(raw) - n + 1] + _buckets(raw, n), minlength=len(out))
    out = out.reshape(len(parts), BUCKETS)
    blank = np.full(8, 32, np.uint8)
    for n in NGRAMS:
        out[:, _buckets(blank, n)[0]] = 0
    return out


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about SLICE characters; a longer text is a run of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE:
            yield start, i
            start, size = i, 0
        size += len(t) + 4096  # a row of counts costs about as much
    if start < len(texts):
        yield start, len(texts)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = batch["text"].tolist(), batch["lang"].to_numpy()
        for a, b in slices(texts):
            counts = gram_counts(texts[a:b])
            total = counts.sum(1)
            weighed = np.rint(counts * (FIXED / np.sqrt(np.maximum(total, 1)))[:, None]).astype(np.int64)
            for lang in set(langs[a:b]):
                sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                sums[lang] += weighed[langs[a:b] == lang].sum(0)
    trim_memory()
    for lang, s in sums.items():
        at = np.flatnonzero(s)
        yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": s[at]})


def codewords(k: int, seed: int = 0) -> np.ndarray:
    """(k, bits) of +1 and -1: the exhaustive code for up to six languages, else the best of random dense codes."""
    if k <= 6:
        bits = [[1 if (j >> i) & 1 else -1 for i in range(k)] for j in range(1, 1 << (k - 1))]
        return np.array(bits, np.int8).reshape(-1, k).T
    rng, best, apart = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (k, int(np.ceil(10 * np.log2(k)))))
        code = code[:, np.abs(code.sum(0, dtype=int)) < k]
        near = int((code[:, None] != code[None]).sum(2)[~np.eye(k, dtype=bool)].min())
        if near > apart:
            best, apart = code, near
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # (languages, bits)
    weights: np.ndarray  # (BUCKETS, bits), scaled so that a bit's usual margin is 1
    trust: np.ndarray  # (languages, bits), each row sums to 1


def fit(rows: DataFrame) -> Model:
    """rows (text, lang): all of them are counted.  Only sums per language and bucket come to the driver."""
    used = rows.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    counted = used.mapInPandas(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    return model_of(counted.toPandas())


def model_of(counted: pd.DataFrame) -> Model:
    """From (lang, bucket, n) sums."""
    langs = sorted(counted["lang"].unique())
    sums = np.zeros((len(langs), BUCKETS))
    sums[counted["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int), counted["bucket"].to_numpy(int)] = counted["n"].to_numpy(float) / FIXED
    dist = sums + SMOOTH
    dist /= dist.sum(1, keepdims=True)
    code = codewords(len(langs)) if langs else np.zeros((0, 0), np.int8)
    weights = np.zeros((BUCKETS, code.shape[1]))
    for b in range(code.shape[1]):
        weights[:, b] = np.log(dist[code[:, b] > 0].mean(0)) - np.log(dist[code[:, b] < 0].mean(0))
    margin = np.abs(dist @ weights)
    weights /= np.maximum(margin.mean(0), 1e-9) if len(langs) else 1.0
    trust = margin / np.maximum(margin.sum(1, keepdims=True), 1e-9)
    return Model(langs, code, weights.astype(np.float32), trust)


def losses(model: Model, counts: np.ndarray) -> np.ndarray:
    """(rows, languages): the weighed loss of each row of counts against each codeword; 1 is what no evidence costs."""
    f = (counts.astype(np.float32) @ model.weights) / np.maximum(counts.sum(1), 1)[:, None]
    return np.stack([(np.exp(-np.clip(f * c, -4, 4)) * t).sum(1) for c, t in zip(model.code, model.trust, strict=True)], 1)


def decode(model: Model, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(best, second, score, ambiguous) per row of counts."""
    n = len(counts)
    if len(model.langs) < 2:
        return np.zeros(n, int), np.zeros(n, int), np.ones(n), np.zeros(n, bool)
    loss = losses(model, counts)
    order = np.argsort(loss, 1, kind="stable")
    best, second = order[:, 0], order[:, 1]
    lead = np.take_along_axis(loss, second[:, None], 1)[:, 0] - np.take_along_axis(loss, best[:, None], 1)[:, 0]
    p = np.exp(-SHARP * (loss - loss.min(1, keepdims=True)))
    return best, second, 1 / p.sum(1), lead < LEAD


def _predictor(model: Model):
    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            known = [i for i, t in enumerate(texts) if t and model.langs and _LETTER.search(t)]
            lang, second = np.full(len(texts), UNDETERMINED, object), np.full(len(texts), None, object)
            score, unsure = np.zeros(len(texts)), np.ones(len(texts), bool)
            names, used = np.array(model.langs, object), [texts[i] for i in known]
            for a, b in slices(used):
                at = known[a:b]
                first, other, score[at], unsure[at] = decode(model, gram_counts(used[a:b]))
                lang[at] = names[first]
                if len(names) > 1:
                    second[at] = names[other]
            out = batch.drop(columns=["text"])
            out["lang_pred"], out["lang_second"], out["score"], out["ambiguous"] = lang, second, score, unsure
            yield out
        trim_memory()

    return predict


def is_held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def identify(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score, lang_second, ambiguous, a row per row of ``docs``.

    Trains on the rows that are not held out and have text and lang.  Texts that are null or have no letter are `und`
    with score 0 (ambiguous); so is everything when there is nothing to learn from.  With a single learned language
    that one is predicted with score 1.  Null ids count as '' in the split.  Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), is_held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = fit(rows.filter(~F.col("held_out")))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.select("doc_id", "held_out", "text").mapInPandas(
        _predictor(model), f"doc_id {kind}, held_out boolean, lang_pred string, lang_second string, score double, ambiguous boolean")


def _nearest(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(loss of the nearest codeword, its language) per text; texts without a letter have infinity and -1."""
    far, lang = np.full(len(texts), np.inf), np.full(len(texts), -1)
    known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
    if len(model.langs) < 2:  # nothing to be told apart, nothing to be far from
        far[known] = 0.0
        return far, lang
    used = [texts[i] for i in known]
    for a, b in slices(used):
        loss = losses(model, gram_counts(used[a:b]))
        far[known[a:b]], lang[known[a:b]] = loss.min(1), loss.argmin(1)
    return far, lang


_BINS = 1 << 12


def _length_class(texts: list[str | None]) -> np.ndarray:
    return np.searchsorted(np.array(LENGTHS), [len(t or "") for t in texts], side="right")


def usual_losses(rows: DataFrame, model: Model) -> np.ndarray:
    """Per length class the loss that ``USUAL`` of all rows (text, lang), held out or not, that decode to their own lang
    stay within.

    Counted over every labelled row in bins of the loss's logarithm, so that a few odd rows, however odd, move nothing; only
    the counts come to the driver.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(LENGTHS) + 1) * _BINS, np.int64)
        names = np.array([*model.langs, None], object)
        for batch in batches:
            texts = batch["text"].tolist()
            far, lang = _nearest(model, texts)
            clean = (names[lang] == batch["lang"].to_numpy()) & np.isfinite(far)
            bins = np.clip((np.log(np.where(clean, far, 1.0)) + 4) / 8 * _BINS, 0, _BINS - 1).astype(int)  # a loss is between e^-4 and e^4
            sums += np.bincount((_length_class(texts) * _BINS + bins)[clean], minlength=len(sums))
        trim_memory()
        at = np.flatnonzero(sums)
        yield pd.DataFrame({"bin": at, "n": sums[at]})

    used = rows.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    told = used.mapInPandas(counted, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(LENGTHS) + 1, _BINS))
    counts.reshape(-1)[told["bin"].to_numpy(int)] = told["n"].to_numpy(float)
    every = counts.sum(0)
    if not every.sum():
        return np.full(len(counts), np.inf)
    used_counts = np.where(counts.sum(1, keepdims=True) >= CLASS_ROWS, counts, every)
    upto = np.cumsum(used_counts, 1)
    place = (upto >= USUAL * upto[:, -1:]).argmax(1)
    return np.exp((place + 1) / _BINS * 8 - 4)


def keep_identified(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """The rows that fit a learned language, with all their columns.

    Texts without a letter go, and texts much farther from every codeword than labelled texts of their length usually are
    (:func:`usual_losses`, ``SLACK`` times): other languages, encoded data, code.  When fewer than two languages could be
    learned, only the former go.
    """
    rows = docs.select(is_held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = fit(rows.filter(~F.col("held_out")))
    limits = SLACK * usual_losses(rows, model) if len(model.langs) > 1 else np.full(len(LENGTHS) + 1, np.inf)

    @F.pandas_udf("boolean")
    def fits(text: pd.Series) -> pd.Series:
        texts = text.tolist()
        far, _ = _nearest(model, texts)
        return pd.Series(np.isfinite(far) & (far <= limits[_length_class(texts)]))

    return docs.filter(fits(F.col(text_col)))
