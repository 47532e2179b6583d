"""Multilingual mixture inference.

A document is a bag of letter trigrams, each drawn from one of its languages:
p(gram) = sum over languages of share * p(gram | language). Expectation-
maximisation finds the shares. The language set is the one of the nested sets
(by share) with the best penalised likelihood. Trigram counts of the training
documents, all of them, are summed in tasks before they are exchanged; what
reaches the driver is one count table, languages x grams, whatever the input. It takes
256 KB a language and is what is broadcast: 77 MB for 300 labels. No label is refused or merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._work import Scratch, lean, slices

#: Gram slots, and slots that are summed by one task of the exchange.
SLOTS = 1 << 16
PART = 1 << 12
#: Labels whose counts a training task holds before it hands them on, which bounds its memory to 16 MB.
HELD = 32
SMOOTHING = 0.1
#: Each further language must raise the log-likelihood by this times the logarithm of the grams.
#: A letter is in three grams, hence thrice the half of the usual criterion; then twice that.
PENALTY = 3.0
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point of the basic plane its lower-case letter, or 0 if it is no letter."""
    out = np.zeros(1 << 16, np.uint32)
    for c in range(1 << 16):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(slots of all letter trigrams, first): those of text i are slots[first[i]:first[i + 1]]. Runs of other characters count as one blank."""
    joined = "\n".join([t or "" for t in texts])
    code = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    size = np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts))
    text = np.repeat(np.arange(len(texts)), size)[: len(code)]
    low = _letters()[np.minimum(code, 0xFFFF)]
    if len(code) and code.max() > 0xFFFF:
        wide = np.unique(code[code > 0xFFFF])
        wide = wide[[chr(c).isalpha() for c in wide]]
        low = np.where(code > 0xFFFF, np.where(np.isin(code, wide), code, 0), low).astype(np.uint32)
    keep = low > 0
    keep[1:] |= low[:-1] > 0
    keep[:1] = True
    low, text = low[keep], text[keep]
    letter = np.flatnonzero(low > 0)
    padded = np.concatenate([[0], low, [0]]).astype(np.uint64)
    # texts are apart by a line feed, so a letter's neighbours are of its own text or blank
    h = padded[letter] * np.uint64(0x9E3779B1) + padded[letter + 1] * np.uint64(0x85EBCA77C2B2AE63) + padded[letter + 2] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(48)).astype(np.int32), np.searchsorted(text[letter], np.arange(len(texts) + 1))


class Model:
    """The probability of each gram slot in each language, in single precision."""

    def __init__(self, languages: list[str], p: np.ndarray):
        self.languages, self.p = languages, p

    def mixture(self, slots: np.ndarray) -> tuple[np.ndarray, list[int], float]:
        """(shares of the chosen languages, their indices by share, mean log-likelihood over that of uniform grams).

        Likelihoods are summed over the distinct grams by how often each occurs.
        """
        n, count = len(slots), len(self.languages)
        slots, times = np.unique(slots, return_counts=True)
        full, times = self.p[slots].astype(np.float64), times.astype(np.float64)
        single = times @ np.log(full)
        share, _ = _em(full, times, np.full(count, 1 / count))
        best = int(single.argmax())
        order = [best, *(int(i) for i in np.argsort(-share, kind="stable") if i != best)]
        chosen, shares, score = order[:1], np.ones(1), float(single[best])
        cost = PENALTY * np.log(max(n, 2))
        like = score
        for k in range(2, count + 1):
            if share[order[k - 1]] < 1e-3:
                break
            start = np.maximum(share[order[:k]], 1e-3)
            found, better = _em(full[:, order[:k]], times, start / start.sum())
            if better - cost * (k - 1) <= score:
                break
            chosen, shares, score, like = order[:k], found, better - cost * (k - 1), better
        rank = np.argsort(-shares, kind="stable")
        return shares[rank], [chosen[i] for i in rank], like / n + float(np.log(SLOTS))


def _em(p: np.ndarray, times: np.ndarray, share: np.ndarray, rounds: int = 40, close: float = 2e-3) -> tuple[np.ndarray, float]:
    """Maximum-likelihood shares of the columns of p, whose row i counts times[i], and the log-likelihood."""
    n = times.sum()
    for _ in range(rounds):
        total = p @ share
        new = share * ((times / total) @ p) / n
        moved = np.abs(new - share).max()
        share = new
        if moved < close:
            break
    return share, float(times @ np.log(p @ share))


def train(spark: SparkSession, docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of all rows with a label; their gram counts are summed over the whole table."""
    rows = docs.filter(F.col(f"`{lang_col}`").isNotNull()).select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text"))

    def out(sums: dict[tuple[str, int], np.ndarray]) -> pa.RecordBatch:
        keys = list(sums)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([sums[k].astype("<i8").tobytes() for k in keys], pa.binary())], names=["lang", "part", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        cut = lambda: out({(name, k): got[k * PART : (k + 1) * PART] for name, got in sums.items() for k in range(SLOTS // PART)})
        for batch in slices(batches, "text", 1 << 19):
            slots, first = grams(batch.column("text").to_pylist())
            lang = np.array(batch.column("lang").to_pylist(), object)
            of = np.repeat(np.arange(batch.num_rows), np.diff(first))
            for name in sorted(set(lang.tolist())):
                got = np.bincount(slots[(lang == name)[of]], minlength=SLOTS)
                sums[name] = sums[name] + got if name in sums else got
                if len(sums) >= HELD:
                    yield cut()
                    sums.clear()
        if sums:
            yield cut()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for name, part, blob in zip(*(batch.column(c).to_pylist() for c in ("lang", "part", "counts")), strict=True):
                got = np.frombuffer(blob, "<i8")
                sums[name, part] = sums[name, part] + got if (name, part) in sums else got
        if sums:
            yield out(sums)

    schema = "lang string, part int, counts binary"
    summed = rows.mapInArrow(lean(count), schema).repartition("lang", "part").mapInArrow(lean(add), schema)
    table = Scratch(spark, "languages").table(summed)
    languages = sorted(r[0] for r in table.select("lang").distinct().collect())
    p = np.zeros((SLOTS, len(languages)), np.float32)
    total = dict.fromkeys(languages, 0)
    place = {name: i for i, name in enumerate(languages)}
    for r in table.toLocalIterator():  # SLOTS counts a language, whatever the input, a file of them at a time
        got = np.frombuffer(bytes(r["counts"]), "<i8")
        total[r["lang"]] += int(got.sum())
        p[r["part"] * PART : (r["part"] + 1) * PART, place[r["lang"]]] = got + SMOOTHING
    p /= np.array([total[name] + SMOOTHING * SLOTS for name in languages], np.float32)
    return Model(languages, p)


def identify(spark: SparkSession, docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The `keep` columns of every row with (lang_pred, score, languages, shares, fit).

    lang_pred is the language with the largest share, score that share; languages and shares are the
    whole chosen set. fit is the mean log-likelihood of a gram over that of grams drawn at random: a text
    that no known language explains has fit below zero. Null texts, texts without a letter, and all texts
    if nothing was learned, have lang_pred `und`, score 0, no languages and null fit.
    """
    rows = docs.select(*[F.col(f"`{c}`").alias(f"keep_{c}") for c in keep], F.col(f"`{text_col}`").alias("text"))
    kept = [f"keep_{c}" for c in keep]
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, "text", 1 << 19):
            slots, first = grams(batch.column("text").to_pylist())
            preds, scores, sets, shares, fits = [], [], [], [], []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                if a == b or not model.languages:
                    share, chosen, fit = np.zeros(0), [], None
                else:
                    share, chosen, fit = model.mixture(slots[a:b])
                names = [model.languages[i] for i in chosen]
                preds.append(names[0] if names else UNKNOWN)
                scores.append(min(1.0, float(share[0])) if names else 0.0)
                sets.append(names)
                shares.append(share.tolist())
                fits.append(fit)
            cols = [pa.array(preds), pa.array(scores, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64())), pa.array(fits, pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *cols], names=[*kept, "lang_pred", "score", "languages", "shares", "fit"])

    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != "text")
    found = rows.mapInArrow(lean(run), f"{types}lang_pred string, score double, languages array<string>, shares array<double>, fit double")
    return found.select(*[F.col(f"keep_{c}").alias(c) for c in keep], "lang_pred", "score", "languages", "shares", "fit")


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept for testing: fold 2. Rows with a null id are not."""
    return F.coalesce(fold(id_col) == 2, F.lit(False))
