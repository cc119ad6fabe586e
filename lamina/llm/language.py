"""Language identification by rank-order profiles.

The n-grams of one to three characters inside words are ranked by frequency; a text's most
frequent ones are held against each language's ranks, and the language with the least
sum of displacements (the out-of-place distance) is predicted.

Defined cases: a null text or one without a letter is ``und`` with score 0; equal
distances go to the first language by name; n-grams of equal frequency rank by their
code points; with no learned language all texts are ``und``; more than LANGUAGES are an error; more than LANGUAGES are an error; repeated rows are handled
each; a null doc_id is carried; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.llm import common

PROFILE = 300  # n-grams of a profile, and of a text
PER_LANGUAGE = 4000  # rows of each language that a profile is learned from, expected
LANGUAGES = 4096  # of more labels than that no profiles are made, as the driver holds them: an error, no choice among them
BLOCK = 1 << 20  # characters whose n-grams are counted at once
_SPACE = 32


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def words_only(text: str) -> np.ndarray:
    """Code points of the lower-cased words, each run of anything else one space, with a space at both ends; empty without letters."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4")
    letter = _letters()[points]
    if not letter.any():
        return points[:0]
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # the first character behind a word
    kept[0] = True
    return np.where(letter, points, _SPACE)[kept]


def grams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-grams inside words (the spaces at their ends included) as numbers of 21 bits a character, and their counts."""
    keys, counts = np.empty(0, "i8"), np.empty(0, "i8")
    for start in range(0, len(points), BLOCK):
        p = points[start : start + BLOCK + 2].astype("i8")
        n = min(BLOCK, len(points) - start)
        two = p[:-1] << 21 | p[1:]
        three = (two[:-1] << 21 | p[2:])[p[1:-1] != _SPACE] if len(p) > 2 else two[:0]
        if len(p) - n == 2:
            two = two[:n]
        found = [np.unique(np.concatenate([p[:n][p[:n] != _SPACE], two, three]), return_counts=True)]
        if len(keys):
            found.append((keys, counts))
            merged, where = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
            keys, counts = merged, np.bincount(where, np.concatenate([c for _, c in found])).astype("i8")
        else:
            keys, counts = found[0]
    return keys, counts


def ranked(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, in order."""
    return keys[np.lexsort((keys, -counts))[:size]]


class Profiles:
    """Rank tables of all languages."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.languages, self.size = sorted(profiles), size
        self.known = np.unique(np.concatenate([np.array(profiles[x], "i8") for x in self.languages])) if profiles else np.empty(0, "i8")
        self.ranks = np.full((len(profiles), len(self.known) + 1), size, "i8")
        for row, name in enumerate(self.languages):
            own = np.array(profiles[name], "i8")
            self.ranks[row, np.searchsorted(self.known, own)] = np.arange(len(own))
        self.absent = self.ranks == size

    def predict(self, text: str | None) -> tuple[str, float]:
        points = words_only(text) if text else np.empty(0, "u4")
        if not len(points) or not self.languages:
            return "und", 0.0
        top = ranked(*grams(points), self.size)
        place = np.searchsorted(self.known, top)
        place[self.known[np.minimum(place, len(self.known) - 1)] != top] = len(self.known)
        moved = np.abs(self.ranks[:, place] - np.arange(len(top)))
        moved[self.absent[:, place]] = self.size
        distance = moved.sum(axis=1)
        best = int(distance.argmin())
        others = np.delete(distance, best)
        next_best = int(others.min()) if len(others) else self.size * len(top)
        return self.languages[best], float(1 - distance[best] / next_best) if next_best else 0.0


def learn(labelled: DataFrame, size: int = PROFILE, per_language: int = PER_LANGUAGE) -> Profiles:
    """Profiles from columns doc_id, text, lang.

    Of each language about ``per_language`` rows are learned from (all, where it has fewer), chosen by a hash of
    their ids. The n-grams are counted where the rows are, and only ``size`` of each language reach the driver.
    """
    rows = labelled.where("lang is not null and text is not null")
    sizes = rows.groupBy("lang").agg((F.lit(float(per_language)) / F.count("*")).alias("share")).limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    share = F.broadcast(rows.sparkSession.createDataFrame(sizes, "lang string, share double"))
    chance = (F.xxhash64(F.coalesce("doc_id", F.lit(-1))).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)).alias("chance")
    chosen = rows.select("text", "lang", chance).join(share, "lang").where("chance < share").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found.setdefault(lang, []).append(grams(words_only(text.as_py())))
            for lang, parts in found.items():
                keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                counts = np.bincount(where, np.concatenate([c for _, c in parts]), len(keys)).astype("i8")
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], ["lang", "gram", "n"])

    counted = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    profiles: dict[str, list[int]] = {}
    for lang, gram, _ in sorted(top.select("lang", "gram", "rank").collect(), key=lambda r: (r[0], r[2])):
        profiles.setdefault(lang, []).append(gram)
    return Profiles(profiles, size)


def language(text: Column, profiles: Profiles) -> Column:
    """A struct (lang_pred, score) for a column of texts."""

    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([profiles.predict(t if isinstance(t, str) else None) for t in texts], columns=["lang_pred", "score"])

    predict.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(predict, "lang_pred string, score double")(text.cast("string"))


def eligible(docs: DataFrame) -> DataFrame:
    """What may be learned from: rows outside the held-out quarter."""
    return docs.select("doc_id", "text", "lang").where(common.doc_bucket("doc_id", 4) != 2)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    found = docs.select("doc_id", language(F.col("text"), learn(eligible(docs))).alias("found"))
    return found.select("doc_id", (common.doc_bucket("doc_id", 4) == 2).alias("held_out"), "found.lang_pred", "found.score")


def language_stage(docs: DataFrame) -> DataFrame:
    """The documents in whose text a language is recognised; profiles are learned from the same documents."""
    return docs.where(language(F.col("text"), learn(eligible(docs)))["lang_pred"] != "und")
