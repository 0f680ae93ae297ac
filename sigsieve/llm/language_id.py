"""Language identification by inference of a mixture of languages.

Learned: counts of hashed byte trigrams inside words, per language, over every document that may teach.  A word's
likelihood in a language is the product over its trigrams.  For each document, expectation-maximisation estimates the
share of words that each language contributed; nested language sets, in the order of those shares, are compared by
penalised likelihood (half the logarithm of the word count for each further share), and the best set stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textgrid as tg
from .common import column, out, pieces, utf8

BINS = 1 << 16
#: Everything ASCII but letters separates words here.
NO_LETTER = np.array([i < 128 and not chr(i).isalpha() for i in range(256)])
#: Three trigrams cover each byte of a word, so a third of their summed likelihood counts.
OVERLAP = 3.0


@dataclass(frozen=True)
class Model:
    langs: list[str]
    logs: np.ndarray  # (BINS, languages)


def _trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each letter byte with its neighbours, first bin of each word, index of each text's first word)."""
    data, ends = utf8(pa.array([(t or "").lower() for t in texts], pa.large_string()))
    starts, stops, first = tg.words(data, ends, NO_LETTER)
    wide = data.astype(np.uint32)
    before, after = np.empty_like(wide), np.empty_like(wide)
    before[1:], after[:-1] = wide[:-1], wide[1:]
    before[starts] = after[stops - 1] = 32
    sizes = stops - starts
    word_at = np.cumsum(sizes) - sizes
    keep = ~NO_LETTER[data]
    key = (before << np.uint32(16) | wide << np.uint32(8) | after)[keep]
    return (key * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.int64), word_at, first


def counts(docs: DataFrame) -> DataFrame:
    """(lang, bin, n): trigram counts of the documents' texts by their label; null labels and texts teach nothing."""
    schema = pa.schema([("lang", pa.string()), ("bin", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for b in pieces(batches, "text"):
            langs, texts = column(b, "lang").to_pylist(), column(b, "text").to_pylist()
            for lang in set(langs):
                bins, _, _ = _trigrams([t for t, x in zip(texts, langs, strict=True) if x == lang])
                totals[lang] = totals.get(lang, 0) + np.bincount(bins, minlength=BINS)
        for lang, n in totals.items():
            at = np.flatnonzero(n)
            yield out(schema, [[lang] * len(at), at.astype(np.int32), n[at].astype(np.int64)])

    per_task = docs.select("lang", "text").where("lang is not null and text is not null").mapInArrow(run, "lang string, bin int, n bigint")
    return per_task.groupBy("lang", "bin").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, max_langs: int = 1000) -> Model:
    """A model of every label in docs.  The driver holds at most BINS numbers for each language, and refuses more than
    max_langs of them."""
    table: dict[str, np.ndarray] = {}
    for row in counts(docs).toLocalIterator():
        if row.lang not in table and len(table) == max_langs:
            raise ValueError(f"more than {max_langs} languages")
        table.setdefault(row.lang, np.zeros(BINS))[row.bin] = row.n
    langs = sorted(table)
    if not langs:
        return Model([], np.zeros((BINS, 0)))
    n = np.column_stack([table[x] for x in langs]) + 0.05
    return Model(langs, np.log(n / n.sum(axis=0)))


def _fit(e: np.ndarray, text: np.ndarray, first: np.ndarray, size: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation from `share`, zero shares staying zero; returns the shares and each text's log sum."""
    for _ in range(rounds):
        r = e * share[text]
        r /= r.sum(axis=1, keepdims=True)
        share = np.add.reduceat(r, first, axis=0) / size[:, None]
    return share, np.add.reduceat(np.log((e * share[text]).sum(axis=1)), first)


def mixtures(texts: list[str | None], model: Model, rounds: int = 10, penalty: float = 1.0) -> np.ndarray:
    """Share of each language in each text (zero for languages outside the chosen set; all zero without a letter)."""
    result = np.zeros((len(texts), len(model.langs)))
    bins, word_at, first = _trigrams(texts)
    count = np.diff(first)
    has = np.flatnonzero(count)
    has = np.array([i for i in has if any(c.isalpha() for c in texts[i])], np.int64) if len(has) else has
    if not len(has) or not model.langs:
        return result
    words = np.add.reduceat(model.logs[bins], word_at, axis=0) / OVERLAP
    if len(has) < np.count_nonzero(count):  # symbols only
        words = words[np.isin(np.repeat(np.arange(len(texts)), count), has)]
    size = count[has]
    start = np.cumsum(size) - size
    best = np.add.reduceat(words, start, axis=0)
    chosen = np.zeros_like(best)
    chosen[np.arange(len(has)), best.argmax(axis=1)] = 1
    best = best.max(axis=1)
    if len(model.langs) > 1:
        top = words.max(axis=1)
        e = np.exp(words - top[:, None])
        shift = np.add.reduceat(top, start)
        text = np.repeat(np.arange(len(has)), size)
        share, _ = _fit(e, text, start, size, np.full_like(chosen, 1 / len(model.langs)), rounds)
        order = np.argsort(-share, axis=1, kind="stable")
        live = np.arange(len(has))
        for k in range(2, len(model.langs) + 1):
            # a language with less than one word's share can't pay the penalty
            live = live[share[live, order[live, k - 1]] * size[live] >= 1]
            if not len(live):
                break
            inside = np.zeros((len(live), len(model.langs)))
            np.put_along_axis(inside, order[live, :k], 1.0, axis=1)
            seed = share[live] * inside
            rows = np.isin(text, live)
            sizes = size[live]
            at = np.cumsum(sizes) - sizes
            fitted, fit = _fit(e[rows], np.repeat(np.arange(len(live)), sizes), at, sizes, seed / seed.sum(axis=1, keepdims=True), rounds)
            fit += shift[live] - 0.5 * penalty * (k - 1) * np.log(sizes)
            better = fit > best[live]
            chosen[live[better]], best[live[better]] = fitted[better], fit[better]
    result[has] = chosen
    return result


def identify(docs: DataFrame, model: Model, rounds: int = 10, penalty: float = 1.0) -> DataFrame:
    """docs' doc_id, plus lang_pred, score and langs, the chosen set with its shares, one row for each row.

    lang_pred is the language with the largest share (the first in alphabetical order of several), score that share.
    Null texts and texts without a letter, and all texts if nothing was learned: "und", score 0, no languages.
    Only doc_id and text are read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("langs", pa.map_(pa.string(), pa.float64()))])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            preds, scores, sets = _labels(column(b, "text").to_pylist(), sent.value, rounds, penalty)
            yield out(schema, [column(b, "doc_id"), preds, scores, pa.array(sets, schema.field("langs").type)])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, lang_pred string, score double, langs map<string,double>")


def _labels(texts: list[str | None], model: Model, rounds: int, penalty: float):
    share = mixtures(texts, model, rounds, penalty)
    if not model.langs:
        return ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
    top, score = share.argmax(axis=1), np.minimum(share.max(axis=1), 1.0)
    preds = [model.langs[t] if s > 0 else "und" for t, s in zip(top, score, strict=True)]
    sets = [[(model.langs[j], float(row[j])) for j in np.flatnonzero(row)] for row in share]
    return preds, score, sets


def keep_identified(docs: DataFrame, model: Model, rounds: int = 10, penalty: float = 1.0) -> DataFrame:
    """The rows of docs, whole, whose text has a language (see identify); "und" goes."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            preds, _, _ = _labels(column(b, "text").to_pylist(), sent.value, rounds, penalty)
            yield b.filter(pa.array([p != "und" for p in preds], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out() -> F.Column:
    """Whether crc32(doc_id as text) mod 4 is 2; false without doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
