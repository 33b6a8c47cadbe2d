"""Language identification: multinomial logistic regression on TF-IDF of hashed character n-grams.

The weights are learned with follow-the-regularised-leader (FTRL-proximal) and elastic-net penalties, so
that most of them are zero; a temperature, fitted on rows kept apart, calibrates the probabilities.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ftrl
from .common import id_mod, map_arrow, slices, table, without_ids
from .sampling import per_label

BUCKETS = 1 << 12
ORDERS = (1, 2, 3)
#: Share of all characters from which one counts as used by the languages.
USED = 2e-5
_LETTER = re.compile(r"[^\W\d_]")
#: Characters and texts that are counted at once: each text has a dense row of counts meanwhile.
_BLOCK, _ROWS = 1 << 17, 64


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts in lower case, and how many each text has."""
    low = [t.lower() for t in texts]
    return np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32), np.array([len(t) for t in low])


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngram_counts(texts: list[str], buckets: int = BUCKETS) -> np.ndarray:
    """A row of counts of hashed character n-grams (lower case, padded with spaces) for each text."""
    parts = [f" {t.lower()}  " for t in texts]
    code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(p) for p in parts])
    owner_ends = np.cumsum(lengths)
    shift = np.uint32(32 - buckets.bit_length() + 1)
    out = np.zeros(len(texts) * buckets, np.float32)
    for a in range(0, len(code) - 2, _BLOCK):
        b = min(a + _BLOCK, len(code) - 2)
        i = np.arange(a, b)
        owner = np.searchsorted(owner_ends, i, "right")
        inside = i < owner_ends[owner] - 2
        base = owner[inside] * buckets
        h = np.zeros(b - a, np.uint32)
        for n in ORDERS:
            h = (h ^ code[a + n - 1 : b + n - 1]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
            key = base + (((h + np.uint32(n)) * np.uint32(0xC2B2AE35)) >> shift)[inside]
            out += np.bincount(key, minlength=len(out)).astype(np.float32)
    return out.reshape(len(texts), buckets)


def tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """In place: logarithms of counts, weighted, rows of length 1."""
    np.log1p(counts, out=counts)
    counts *= idf
    counts /= np.maximum(np.sqrt(np.einsum("ij,ij->i", counts, counts)), 1e-9)[:, None]
    return counts


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the least log loss, by golden section on its logarithm."""
    loss = lambda t: -np.log(ftrl.softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()
    a, b, r = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


@dataclass
class LanguageModel:
    langs: list
    weights: np.ndarray
    idf: np.ndarray
    temp: float
    used: np.ndarray  # which code points the languages use

    def predict(self, texts: list) -> tuple[list, list]:
        """A language and its probability for each text; `und` and 0 for null and for no letter.

        The probability is that of the classes times the share of letters that the languages use, as a text in
        letters that none of them uses is in none of them.
        """
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        if self.langs:
            for lo, hi in slices([texts[i] for i in known], _BLOCK):
                rows = known[lo:hi]
                for part in range(0, len(rows), _ROWS):
                    some = rows[part : part + _ROWS]
                    x = tfidf(ngram_counts([texts[i] for i in some]), self.idf)
                    p = ftrl.softmax((x @ self.weights[:-1] + self.weights[-1]) / self.temp)
                    code, n = code_points([texts[i] for i in some])
                    letter, owner = letters()[code], np.repeat(np.arange(len(some)), n)
                    total = np.bincount(owner[letter], minlength=len(some))
                    used = np.bincount(owner[letter & self.used[code]], minlength=len(some)) / np.maximum(total, 1)
                    for i, row, share in zip(some, p, used):
                        lang[i], score[i] = self.langs[int(row.argmax())], float(row.max() * share)
        return lang, score


def fit(docs: DataFrame, per_lang: int = 1000, most_rows: int = 20_000, most_langs: int = 2000) -> LanguageModel:
    """Learn from docs (doc_id, text, lang): document frequencies from all rows with text and a lang, weights from
    per_lang rows of each language at most, and about most_rows of all (fewer if there are fewer). More than
    most_langs languages raise ValueError."""
    docs = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    langs = docs.select("lang").distinct().limit(most_langs + 1).count()
    if langs > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    per_lang = max(10, min(per_lang, most_rows // max(1, langs)))

    def frequencies(batches):
        df, n, seen = np.zeros(BUCKETS, np.int64), 0, np.zeros(0x110000, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                texts = b.column(0).slice(at, _ROWS).to_pylist()
                for lo, hi in slices(texts, _BLOCK):
                    df += (ngram_counts(texts[lo:hi]) > 0).sum(0)
                    code = code_points(texts[lo:hi])[0]
                    if len(code):
                        seen[: code.max() + 1] += np.bincount(code)
            n += b.num_rows
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([*range(BUCKETS + 1), *(-1 - some)], pa.int32()), pa.array([*df, n, *seen[some]], pa.int64())], names=["bucket", "n"])

    df, seen = np.zeros(BUCKETS + 1), np.zeros(0x110000)
    for r in docs.select("text").mapInArrow(frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        if r["bucket"] >= 0:
            df[r["bucket"]] = r["n"]
        else:
            seen[-1 - r["bucket"]] = r["n"]
    used = seen > USED * seen.sum()
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)

    def features(b):
        texts = b.column(1).to_pylist()
        for lo, hi in slices(texts, _BLOCK):
            rows = [(np.flatnonzero(c).astype(np.int16).tobytes(), c[c > 0].astype(np.float32).tobytes()) for c in (ngram_counts([t])[0] for t in texts[lo:hi])]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["doc_id", "lang", "at", "n"])

    sample = per_label(docs, "lang", per_lang)
    rows = sorted(map_arrow(sample, features, "doc_id long, lang string, at binary, n binary").collect(), key=lambda r: (r["lang"], r["doc_id"] is None, r["doc_id"] or 0, r["at"], r["n"]))
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return LanguageModel([], np.zeros((BUCKETS + 1, 0)), idf, 1.0, used)
    at = [np.frombuffer(r["at"], np.int16) for r in rows]
    x = ftrl.Rows(np.array([len(a) for a in at]), np.concatenate(at).astype(np.int64), np.log1p(np.concatenate([np.frombuffer(r["n"], np.float32) for r in rows])))
    owner = np.repeat(np.arange(len(x)), x.sizes)
    x.val *= idf[x.idx]
    x.val /= np.maximum(np.sqrt(np.bincount(owner, weights=x.val.astype(float) ** 2, minlength=len(x))), 1e-9)[owner]
    y = np.searchsorted(langs, [r["lang"] for r in rows])
    if len(langs) == 1:  # nothing to tell apart
        return LanguageModel(langs, np.zeros((BUCKETS + 1, 1), np.float32), idf, 1.0, used)
    apart = np.random.default_rng(3).random(len(rows)) < 0.2
    if apart.sum() < 5 or apart.all():
        apart[:] = False
    w = ftrl.fit(x, np.eye(len(langs))[y], BUCKETS, np.flatnonzero(~apart))
    held = np.flatnonzero(apart)
    temp = temperature(x.take(held).times(w), y[held]) if len(held) else 1.0
    return LanguageModel(langs, w.astype(np.float32), idf, temp, used)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score for each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows, one column a language

    def run(b):
        for at in range(0, b.num_rows, _ROWS):
            part = b.slice(at, _ROWS)
            lang, score = shared.value.predict(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, lang_pred string, score double")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from those whose crc32(doc_id) mod 5 is not 0.

    Null text and text without a letter are `und` with score 0; so is all if no row has a language.
    """
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(id_mod(F.col("doc_id"), 5) != 0))
    return identify(docs, model).withColumn("held_out", id_mod(F.col("doc_id"), 5) == 0).select("doc_id", "held_out", "lang_pred", "score")


def known_language(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """docs less those in no language: `und`, or calibrated probability below `least`. Learns from docs itself."""
    found = identify(docs, fit(docs))
    return without_ids(docs, found.where(f"lang_pred = 'und' OR score < {least}").select("doc_id"))
