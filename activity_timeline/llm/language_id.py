"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram is the product of its
letters' vectors, rotated by their places (binding); a text is the sum of its
trigrams' vectors (bundling); a language is the sum over its texts. A text gets
the language whose prototype, less what all prototypes have in common, has the
largest cosine with it.

Letters are lower-cased and mapped to 40 symbols (a to z by themselves, others
by code point); whatever is no letter is one separator. So there are 40^3
trigrams, bundling is a product of trigram counts and a fixed matrix, and
learning needs nothing but trigram counts per language, added up by Spark over
all texts that may be learned from.

A text that is null or has no letter is `und` with score 0. Rows without doc_id
count as held out. Repeated rows are rows like others. If no text has a
language, all are `und`. Empty tables give no rows. Further columns are left
alone; language and source are never read for a prediction.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from activity_timeline.llm.common import in_tasks, resident, ship

SYMBOLS = 40
TRIGRAMS = SYMBOLS ** 3
DIMENSIONS = 512
SEED = 7
LEAST_TAUGHT = 30    # texts of a language and size from which a floor is learned


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


def trigram_vectors() -> np.ndarray:
    return resident("trigram vectors", _make_vectors)


def _make_vectors() -> np.ndarray:
    """Bound vectors of all trigrams, int8."""
    letters = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, DIMENSIONS))
    second, third = np.roll(letters, 1, axis=1), np.roll(letters, 2, axis=1)
    pairs = (letters[:, None, :] * second[None, :, :]).reshape(-1, DIMENSIONS)
    return (pairs[:, None, :] * third[None, :, :]).reshape(-1, DIMENSIONS)


@lru_cache(1)
def _symbol_table() -> np.ndarray:
    """Symbol of every code point of the basic plane; 0 is the separator."""
    table = np.zeros(65_536, np.uint8)
    for point in range(65_536):
        char = chr(point)
        if char.isalpha():
            low = ord(char.lower()[0])
            table[point] = low - 96 if 97 <= low <= 122 else 27 + low % (SYMBOLS - 27)
    return table


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _symbol_table()
    return np.where(points < 65_536, table[np.minimum(points, 65_535)], _beyond(points))


def _beyond(points: np.ndarray) -> np.ndarray:
    """Symbols of code points above the basic plane."""
    out = np.zeros(len(points), np.uint8)
    for i in np.flatnonzero(points >= 65_536).tolist():
        if chr(points[i]).isalpha():
            out[i] = 27 + points[i] % (SYMBOLS - 27)
    return out


def trigrams(text: str | None) -> np.ndarray:
    """Codes of the trigrams that hold a letter, with separators around the text."""
    if not text:
        return np.zeros(0, np.int64)
    s = symbols(text)
    if not s.any():
        return np.zeros(0, np.int64)
    # runs of separators count as one
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    s = np.concatenate([[0], s[keep], [0]]).astype(np.int64)
    codes = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
    return codes[(s[:-2] + s[1:-1] + s[2:]) > 0]


def _language_counts(batches):
    """Trigram counts per language of a whole task: one row for each language and trigram."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            if lang not in totals:
                totals[lang] = np.zeros(TRIGRAMS, np.int64)
            codes = trigrams(text)
            if len(codes):
                totals[lang] += np.bincount(codes, minlength=TRIGRAMS)
    for lang, counts in totals.items():
        used = np.flatnonzero(counts)
        yield pa.record_batch(
            [pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)),
             pa.array(counts[used])], names=["lang", "trigram", "n"])


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes; TRIGRAMS rows per language reach the driver."""
    taught = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = (in_tasks(taught.select("lang", "text"), _language_counts,
                       "lang string, trigram int, n bigint")
              .groupBy("lang", "trigram").agg(F.sum("n").alias("n")).toPandas())
    langs = sorted(counts["lang"].unique())
    vectors = trigram_vectors()
    prototypes = np.zeros((len(langs), DIMENSIONS))
    for i, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        weights = own["n"].to_numpy(float)
        prototypes[i] = (weights / weights.sum()) @ vectors[own["trigram"].to_numpy()]
    return langs, prototypes


def predictor(langs: list[str], prototypes: np.ndarray):
    """Column function of the text: struct of lang_pred, score (cosine with its prototype) and
    n_trigrams (different ones)."""
    shared = prototypes.mean(axis=0) if len(langs) > 1 else np.zeros(DIMENSIONS)
    own = prototypes - shared
    norms = np.linalg.norm(own, axis=1)
    own = (own / np.where(norms > 0, norms, 1)[:, None]).astype(np.float32)
    centre = shared.astype(np.float32)

    def of(text: str | None) -> tuple[str, float, int]:
        codes = trigrams(text)
        if not len(codes) or not len(langs):
            return "und", 0.0, 0
        used, n = np.unique(codes, return_counts=True)
        vectors, weights = trigram_vectors(), n.astype(np.float32) / np.float32(len(codes))
        bundle = -centre
        for a in range(0, len(used), 4096):
            bundle = bundle + weights[a:a + 4096] @ vectors[used[a:a + 4096]].astype(np.float32)
        cosines = own @ bundle / max(float(np.linalg.norm(bundle)), 1e-30)
        best = int(np.argmax(cosines))
        return langs[best], min(1.0, max(0.0, float(cosines[best]))), len(used)

    @F.pandas_udf("lang_pred string, score double, n_trigrams int")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([of(t) for t in texts], columns=["lang_pred", "score", "n_trigrams"])

    return predicted.asNondeterministic()  # so that Spark calls it once for each row


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    ship(docs.sparkSession)
    found = docs.select("doc_id", held_out().alias("held_out"),
                        predictor(langs, prototypes)("text").alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that may be learned from, predict all."""
    return predict(docs, *learn(docs))


def size_bin() -> Column:
    """Texts of up to twice as many different trigrams share a bin."""
    return F.floor(F.log2(F.greatest("found.n_trigrams", F.lit(1)))).cast("int")


def floors(docs: DataFrame, predicted) -> list[tuple[str, int, float]]:
    """Language, bin of sizes and the least cosine there of a text that is like the language.

    Learned from the taught texts that are predicted as what they are. Between their median
    and lower quartile lie 0.67 standard deviations; the floor is four of them below the
    median, and a third of the median and the least of them at most, so that none of them goes. Equal cosines (copies) count once. A bin with
    fewer than LEAST_TAUGHT texts has the floor of the next smaller one, or none. The size of
    a text is the number of its different trigrams, since repetition says nothing new.
    """
    ship(docs.sparkSession)
    taught = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    scores = (taught.select("lang", predicted(F.col("text")).alias("found"))
              .where("found.lang_pred = lang")
              .select("lang", size_bin().alias("bin"), F.round("found.score", 6).alias("score")).distinct())
    quarters = (scores.groupBy("lang", "bin")
                .agg(F.count("*").alias("n"),
                     F.min("score").alias("least"),
                     F.percentile_approx("score", [0.25, 0.5]).alias("q"))
                .where(F.col("n") >= LEAST_TAUGHT).collect())
    return [(r["lang"], r["bin"], min(r["q"][1] - 4 / 0.6745 * (r["q"][1] - r["q"][0]),
                                      r["q"][1] / 3, r["least"])) for r in quarters]


def keep_known(docs: DataFrame) -> DataFrame:
    """Documents with a letter that are as like their predicted language as its own texts are.

    Rejected are texts whose cosine is below the floor of the language for texts of their
    size (see `floors`): most text of languages that were not learned, encoded blobs, markup.
    Short and repetitive texts have low floors and mostly stay, and so does text of a language too close
    to a learned one; where too few texts were taught, only a cosine of 0 is rejected.
    `lang` becomes the predicted one, all other columns are as they were.
    """
    predicted = predictor(*learn(docs))
    low = floors(docs, predicted)
    found = docs.select(F.struct("*").alias("row"), predicted(F.col("text")).alias("found"))
    floor = F.lit(0.0)
    for lang, bin, least in sorted(low):   # larger bins come later and are asked first
        floor = F.when((F.col("found.lang_pred") == lang) & (size_bin() >= bin),
                       least).otherwise(floor)
    kept = found.where((F.col("found.lang_pred") != "und") & (F.col("found.score") > 0)
                       & (F.col("found.score") >= floor))
    return kept.select(*[(F.col("found.lang_pred") if c == "lang" else F.col("row")[c]).alias(c)
                         for c in docs.columns])
