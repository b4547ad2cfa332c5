"""The natural language of an explanation: a character n-gram classifier fitted on labelled rows.

The labelled rows are prompts whose problem names a language. Of each language at most MOST_LABELLED are taken, those with the smallest
hashes of their text; short lists of function words (FUNCTION_WORDS) stand in for languages without labelled rows. Counts of character
n-grams inside words, hashed to a fixed number of dimensions, give a naive Bayes model of fixed size. A text whose letters are mostly of a
script of its own (Han, Kana, Hangul, Arabic and so on) is in the language of that script.

Code, quoted sentences and names don't count: code blocks, quotations and capitalised words are left out.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Frequent function words per language.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for on with as by are be this each all than when which must can not from only so at an if what who where about into after between one no has have more less there they we i you then how",
    "de": "der die das und ist nicht ein eine einer einen den dem des mit von zu im auf für sich dass wird auch an als es bei aus nur oder wenn so sind jede jeder jedes alle aller mehr nie zwischen durch ich wir sie nach zur zum wie aber denn dann keine kein hat haben man",
    "fr": "le la les de des du et est une un que qui dans pour sur avec par au aux ne pas plus ce cette ces sont il elle on se sa ses son chaque tous toutes dont ou où mais donc entre si comme en leurs leur nous je vous puis aucun être",
    "es": "el la los las de del y es una un que en para por con se al no más lo su sus como cada todos todas este esta son si o pero entre donde cuando hay ni ya muy sin sobre le yo nos luego ningún ser está",
    "ru": "и в не на что с по это как из к для от все а но он мы так его за то или если только при каждый каждая у о же бы был есть нет их она они можно нужно через после когда где тогда ли до",
}
#: Labelled rows per language, and languages, at most.
MOST_LABELLED, MOST_LANGUAGES = 400, 64
#: Hashed character n-grams of up to ORDER characters.
DIMENSIONS, ORDER = 1 << 15, 3
#: Probability of n-grams that the labelled rows of a language do not have.
UNSEEN = 0.1
#: A language is told from this many words on, and from this lead of the mean log-likelihood of an n-gram over the second.
LEAST_WORDS, LEAD = 5, 0.08
#: A worker forgets its words beyond this many.
MOST_WORDS = 300_000

_CODE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)
_INLINE = re.compile(r"`[^`\n]*`")
_QUOTED = re.compile(r"«[^»]*»|„[^“”]*[“”]|“[^”]*”|\"[^\"\n]*\"|‘[^’\n]{12,}’")
_WORD = re.compile(r"[^\W\d_]+")
#: Scripts that do not tell a language by themselves.
_SHARED = {"LATIN", "CYRILLIC"}


def explanation(text: str) -> str:
    """The text without code, quotations and tags."""
    text = _CODE.sub(" ", text)
    text = _INLINE.sub(" ", text)
    text = _QUOTED.sub(" ", text)
    return re.sub(r"</?think>", " ", text)


def told_words(text: str | None) -> list[str]:
    """The words of an explanation that speak for its language, in lower case; those with a capital first letter only may be names."""
    return [w.lower() for w in _WORD.findall(explanation(text)) if not w[0].isupper() or (len(w) > 1 and w.isupper())] if text else []


def script_of(words: list[str]) -> str | None:
    """The script of most letters if it tells the language, else None; judged by the first letter of each word."""
    counts: dict[str, int] = {}
    for w in words:
        name = unicodedata.name(w[0], "").split(" ")[0]
        name = "HAN" if name == "CJK" else name
        counts[name] = counts.get(name, 0) + len(w)
    if not counts:
        return None
    name, n = max(counts.items(), key=lambda x: x[1])
    return name.lower() if name not in _SHARED and n * 2 > sum(counts.values()) else None


def grams_of(word: str) -> list[int]:
    padded = f" {word} "
    return [xxhash.xxh3_64_intdigest(padded[i : i + n]) % DIMENSIONS for n in range(1, ORDER + 1) for i in range(len(padded) - n + 1) if padded[i : i + n] != " "]


def gram_counts(texts: list[list[str]]) -> np.ndarray:
    """Counts of the n-grams of texts, given as words."""
    times: dict[str, int] = {}
    for words in texts:
        for w in words:
            times[w] = times.get(w, 0) + 1
    out = np.zeros(DIMENSIONS)
    for w, n in times.items():
        np.add.at(out, grams_of(w), n)
    return out


@dataclass
class LanguageModel:
    """Log-probabilities of hashed n-grams per language."""

    names: list[str]
    table: np.ndarray
    known: dict[str, tuple[np.ndarray, int]] = field(default_factory=dict)

    @classmethod
    def of(cls, counts: dict[str, np.ndarray]) -> LanguageModel:
        every = dict(counts)
        for name, listed in FUNCTION_WORDS.items():
            every[name] = every.get(name, 0) + gram_counts([listed.split()])
        names = sorted(every)
        c = np.stack([every[n] for n in names])
        # Unseen n-grams cost the same in every language, however much text it was fitted on.
        p = (1 - UNSEEN) * c / c.sum(axis=1, keepdims=True) + UNSEEN / DIMENSIONS
        return cls(names, np.log(p).astype(np.float32).T.copy())

    def __getstate__(self) -> dict:
        return {"names": self.names, "table": self.table, "known": {}}

    def _word(self, word: str) -> tuple[np.ndarray, int]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= MOST_WORDS:
                self.known.clear()
            grams = grams_of(word)
            found = self.known[word] = self.table[grams].sum(axis=0), len(grams)
        return found

    def language(self, text: str | None) -> str | None:
        """The language of a text, or None where too few words or no clear lead tell it."""
        words = told_words(text)
        script = script_of(words)
        if script is not None:
            return script if sum(map(len, words)) >= 2 * LEAST_WORDS else None
        if len(words) < LEAST_WORDS:
            return None
        rows = [self._word(w) for w in words]
        score = np.sum([r[0] for r in rows], axis=0) / sum(r[1] for r in rows)
        second, first = np.argsort(score)[-2:]
        return self.names[first] if score[first] - score[second] >= LEAD else None


def fit_languages(labelled: DataFrame) -> LanguageModel:
    """A model fitted on rows (lang, text); null languages and texts are left out.

    What comes to the driver has at most MOST_LANGUAGES rows of DIMENSIONS counts.
    """
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"))
    names = [r.lang for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()]
    if not names:
        return LanguageModel.of({})
    # The planner keeps MOST_LABELLED rows per language and task before it shuffles.
    sample = rows.where(F.col("lang").isin(names)).withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h", "text"))).where(F.col("k") <= MOST_LABELLED).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts: dict[str, list[list[str]]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts.setdefault(lang, []).append(told_words(text))
            for lang, words in texts.items():
                sums[lang] = sums.get(lang, 0) + gram_counts(words)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["lang", "counts"])

    counts: dict[str, np.ndarray] = {}
    for r in sample.mapInArrow(count, "lang string, counts binary").collect():  # one row per language and task that holds rows of it
        counts[r.lang] = counts.get(r.lang, 0) + np.frombuffer(r.counts)
    return LanguageModel.of(counts)
