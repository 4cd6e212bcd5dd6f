"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

A text becomes its lower-cased letters with one mark for each run of anything else. For every language a model of order
``ORDER`` is trained with absolute discounting; orders below the highest count distinct left contexts. The n-grams of all
languages of one order stand in one sorted array of 64-bit hashes beside a matrix with each language's
log-probability, back-off already mixed in; contexts stand in a second pair with each language's back-off weight. A
symbol is looked up at the highest order first; only what no language has seen goes on to the next lower order with the
weights of its context added. The language with the lowest cross-entropy per symbol is chosen.

Training takes at most ``SAMPLE`` documents of each language, those with the least hash of doc_id, of the rows offered
for training, whole texts; this is the documented bound of what the driver holds. A quarter of the sample is kept from
training to calibrate rejection: a text is rejected if its cross-entropy exceeds its language's mean by more than
``SLACK`` nats and ``SPREAD`` standard errors of its length. Predictions use nothing but the text.

Defined results: null text and text without a letter get ``und`` and score 0 and count as rejected; ties go to the
language first in code-point order; without any labelled text every row gets ``und``; a repeated text repeats its
prediction; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataquery.llm.common import bound_batches, fresh, pin

ORDER = 4
SAMPLE = 240
SLACK = 0.9
SPREAD = 6.0
MARK = np.uint64(32)
UNKNOWN = 1e-7
#: Symbols scored at a time.
CHUNK = 1 << 19


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def symbols(text: str | None) -> np.ndarray:
    """Code points of the lower-cased letters, runs of others as one mark, a mark at both ends; empty without a letter."""
    raw = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[raw]
    if not letter.any():
        return np.zeros(0, dtype=np.uint64)
    out = np.where(letter, raw, 32).astype(np.uint64)
    first = letter.copy()
    first[1:] |= letter[:-1]
    out = out[first]
    if out[0] != MARK:
        out = np.concatenate(([MARK], out))
    return out if out[-1] == MARK else np.append(out, MARK)


def hashes(x: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n symbols that end at each place from n-1 on; exact for up to 3 symbols."""
    h = x[: len(x) - n + 1].copy()
    for k in range(1, n):
        h = (h << np.uint64(21) if n <= 3 else h * np.uint64(0x9E3779B97F4A7C15)) ^ x[k : len(x) - n + 1 + k]
    return h


class Model:
    """Tables of all orders; picklable, of the size of the sample's n-grams."""

    def __init__(self, langs: list[str], grams: list, contexts: list, floor: np.ndarray):
        self.langs, self.grams, self.contexts, self.floor = langs, grams, contexts, floor
        self.mean = np.zeros(len(langs))
        self.spread = np.ones(len(langs))
        self.slack = np.full(len(langs), SLACK)

    def logs(self, x: np.ndarray) -> np.ndarray:
        """Natural log-probabilities [symbol, language] of x[ORDER-1:] given the symbols before."""
        n = len(x) - ORDER + 1
        out = np.empty((n, len(self.langs)), dtype=np.float32)
        todo, add = np.arange(n), None
        for k in range(ORDER, 0, -1):
            # the hash of the last k symbols at each place still open
            h = hashes(x[ORDER - k :], k)[todo]
            keys, values = self.grams[k - 1]
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[at] == h
            found = values[at[hit]]
            out[todo[hit]] = found if add is None else found + add[hit]
            todo = todo[~hit]
            if not len(todo):
                return out
            add = np.zeros((len(todo), len(self.langs)), dtype=np.float32) if add is None else add[~hit]
            if k > 1:
                keys, values = self.contexts[k - 1]
                c = hashes(x[ORDER - k : -1], k - 1)[todo]
                at = np.minimum(np.searchsorted(keys, c), len(keys) - 1)
                add = add + np.where((keys[at] == c)[:, None], values[at], np.float32(0))
        out[todo] = self.floor + add
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """([text, language] cross-entropy per symbol, symbols scored), many texts at a time."""
        total = np.zeros((len(texts), len(self.langs)))
        count = np.zeros(len(texts), dtype=np.int64)
        run, owners, size = [], [], 0

        def flush():
            nonlocal run, owners, size
            if run:
                x = np.concatenate(run)
                who = np.repeat(owners, [len(p) for p in run])[ORDER - 1 :]
                lead = np.concatenate([np.arange(len(p)) < ORDER - 1 for p in run])[ORDER - 1 :]  # symbols that only lead in
                logs = self.logs(x)
                logs[lead] = 0
                starts = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
                np.add.at(total, who[starts], -np.add.reduceat(logs, starts, axis=0, dtype=np.float64))
                np.add.at(count, who[starts], np.add.reduceat((~lead).astype(np.int64), starts))
            run, owners, size = [], [], 0

        pad = np.full(ORDER - 2, MARK, dtype=np.uint64)
        for i, text in enumerate(texts):
            x = symbols(text)
            if not len(x):
                continue
            x = np.concatenate((pad, x))
            for at in range(0, len(x) - ORDER + 1, CHUNK):  # parts overlap by the context of their first symbol
                run.append(x[at : at + CHUNK + ORDER - 1])
                owners.append(i)
                size += len(run[-1])
                if size > CHUNK:
                    flush()
        flush()
        return total / np.maximum(count, 1)[:, None], count

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        """lang_pred, score, rejected of each text."""
        rows = pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": 0.0, "rejected": True})
        if not self.langs:
            return rows
        ce, n = self.entropies(texts)
        best = ce.argmin(axis=1)
        low = ce[np.arange(len(texts)), best]
        score = 1.0 / np.exp(-4.0 * (ce - low[:, None])).sum(axis=1)
        limit = self.mean[best] + self.slack[best] + SPREAD * self.spread[best] / np.sqrt(np.maximum(n, 1))
        has = n > 0
        rows["lang_pred"] = np.where(has, np.array(self.langs, dtype=object)[best], "und")
        rows["score"] = np.where(has, np.clip(score, 0.0, 1.0), 0.0)
        rows["rejected"] = ~has | (low > limit)
        return rows


def _counts(parts: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct k-grams of one language: hashes, counts, and one place (in the joined symbols) of each."""
    x = np.concatenate(parts)
    h = hashes(x, k)
    inside = np.concatenate([np.arange(len(p)) >= k - 1 for p in parts])[k - 1 :]
    places = np.flatnonzero(inside)
    keys, first, n = np.unique(h[places], return_index=True, return_counts=True)
    return keys, n, places[first] + k - 1


def train(samples: dict[str, list[str]]) -> Model:
    """samples: texts of each language."""
    texts = {lang: own for lang, own in sorted(samples.items()) if any(len(symbols(t)) for t in own)}
    held = {lang: own[::4] if len(own) > 3 else own for lang, own in texts.items()}
    kept = {lang: [t for i, t in enumerate(own) if len(own) <= 3 or i % 4] for lang, own in texts.items()}
    langs = list(texts)
    if not langs:
        return Model([], [], [], np.zeros(0))
    pad = np.full(ORDER - 2, MARK, dtype=np.uint64)
    parts = {lang: [np.concatenate((pad, s)) for t in kept[lang] if len(s := symbols(t))] or [np.full(ORDER, MARK)] for lang in langs}
    joined = {lang: np.concatenate(parts[lang]) for lang in langs}
    raw = {lang: [_counts(parts[lang], k) for k in range(1, ORDER + 1)] for lang in langs}
    grams, contexts = [], []
    lower: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    floor = np.full(len(langs), np.log(UNKNOWN), dtype=np.float32)
    for k in range(1, ORDER + 1):
        per = {}
        for lang in langs:
            keys, n, place = raw[lang][k - 1]
            x = joined[lang]
            if k < ORDER:  # continuation: the number of distinct symbols before the k-gram
                up_place = raw[lang][k][2]
                suffix = hashes(x, k)[up_place - k + 1]
                n = np.zeros(len(keys), dtype=np.int64)
                np.add.at(n, np.searchsorted(keys, suffix), 1)
                n = np.maximum(n, 1)
            once, twice = (n == 1).sum(), (n == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            context = hashes(x, k - 1)[place - k + 1] if k > 1 else np.zeros(len(keys), dtype=np.uint64)
            ckeys, inverse = np.unique(context, return_inverse=True)
            total, kinds = np.bincount(inverse, weights=n), np.bincount(inverse)
            gamma = discount * kinds / total
            if k == 1:
                base = np.full(len(keys), 1.0 / (len(keys) + 1))
            else:
                low_keys, low_p = lower[lang]
                base = low_p[np.searchsorted(low_keys, hashes(x, k - 1)[place - k + 2])]
            p = (n - discount) / total[inverse] + gamma[inverse] * base
            lower[lang] = (keys, p)
            per[lang] = (keys, p, ckeys, np.log(gamma))
        keys = np.unique(np.concatenate([per[lang][0] for lang in langs]))
        ckeys = np.unique(np.concatenate([per[lang][2] for lang in langs])) if k > 1 else np.zeros(0, dtype=np.uint64)
        weight = np.zeros((len(ckeys), len(langs)), dtype=np.float32)
        value = np.empty((len(keys), len(langs)), dtype=np.float32)
        for j, lang in enumerate(langs):
            if k > 1:
                weight[np.searchsorted(ckeys, per[lang][2]), j] = per[lang][3]
        # a k-gram that a language lacks: the weight of its context there and the next lower order
        where = {}
        for lang in langs:
            place = raw[lang][k - 1][2]
            where.update(zip(raw[lang][k - 1][0].tolist(), ((lang, int(q)) for q in place)))
        grams_symbols = np.array([joined[lang][q - k + 1 : q + 1] for lang, q in (where[h] for h in keys.tolist())], dtype=np.uint64).reshape(len(keys), k)
        if k == 1:
            value[:] = np.log(UNKNOWN)
        else:
            flat = np.ascontiguousarray(grams_symbols)
            low_h, con_h = _row_hash(flat[:, 1:]), _row_hash(flat[:, :-1])
            low_keys, low_values = grams[k - 2]
            value[:] = low_values[np.searchsorted(low_keys, low_h)] + weight[np.searchsorted(ckeys, con_h)]
        for j, lang in enumerate(langs):
            value[np.searchsorted(keys, per[lang][0]), j] = np.log(per[lang][1])
        grams.append((keys, value))
        contexts.append((ckeys, weight))
    model = Model(langs, grams, contexts, floor)
    for j, lang in enumerate(langs):
        ce, n = model.entropies(held[lang])
        own, n = ce[n > 0, j], n[n > 0]
        if len(own):
            model.mean[j] = np.average(own, weights=n)
            residual = (own - model.mean[j]) * np.sqrt(n)
            model.spread[j] = max(0.3, float(np.sqrt(np.mean(np.minimum(residual, np.quantile(residual, 0.98)) ** 2))))
    return model


def _row_hash(rows: np.ndarray) -> np.ndarray:
    """hashes() of whole rows."""
    n = rows.shape[1]
    h = rows[:, 0].copy()
    for k in range(1, n):
        h = (h << np.uint64(21) if n <= 3 else h * np.uint64(0x9E3779B97F4A7C15)) ^ rows[:, k]
    return h


def sample(rows: DataFrame, per_language: int = SAMPLE) -> dict[str, list[str]]:
    """At most per_language different texts of each lang, by the least hash of doc_id and text; rows: doc_id, text, lang."""
    labelled = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text", F.xxhash64("text").alias("key"))
    w = W.partitionBy("lang").orderBy("h", "doc_id", "key")
    ids = labelled.select("doc_id", "lang", "key", F.xxhash64("doc_id").alias("h"))
    chosen = pin(ids.withColumn("r", F.dense_rank().over(w)).where(F.col("r") <= per_language).select("doc_id", "lang", "key").distinct())
    on = [labelled[c].eqNullSafe(chosen[c]) for c in ("doc_id", "lang", "key")]
    found = labelled.join(F.broadcast(chosen), on, "left_semi").groupBy("doc_id", "lang", "key").agg(F.min("text").alias("text"))  # SAMPLE rows a language
    got: dict[str, list[str]] = {}
    for r in sorted(found.collect(), key=lambda r: (r["lang"], r["doc_id"] is None, r["doc_id"] or 0, r["text"])):
        got.setdefault(r["lang"], []).append(r["text"])
    return got


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train_on(docs: DataFrame) -> Model:
    """A model from the rows that are not held out."""
    rows = docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id")))
    return train(sample(rows))


def predictor(spark, model: Model):
    """A column function text -> struct(lang_pred, score, rejected)."""
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            yield shared.value.predict([t if isinstance(t, str) else None for t in part])

    return predict


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row."""
    predict = predictor(docs.sparkSession, model or train_on(docs))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict("text").alias("told")).select("doc_id", "held_out", "told.*")


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Rows of docs that are not rejected, with all their columns."""
    predict = predictor(docs.sparkSession, model or train_on(docs))
    told = fresh(docs, "told")
    return docs.withColumn(told, predict("text")).where(~F.col(f"{told}.rejected")).select(*docs.columns)
