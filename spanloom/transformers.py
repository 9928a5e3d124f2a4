"""Text steps as pyspark.ml transformers, for use in pipelines."""

from __future__ import annotations

from functools import cache

import pandas as pd
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions.text import normalize, words


@cache
def _stop_words(language: str) -> tuple[str, ...]:
    from pyspark.ml.feature import StopWordsRemover

    return tuple(StopWordsRemover.loadDefaultStopWords(language))


def stop_words(spark: SparkSession, language: str) -> list[str]:
    """The stop words that Spark has for a language."""
    return list(_stop_words(language))


class _TextStep(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    def _put(self, **params) -> None:
        self._set(**{k: v for k, v in params.items() if v is not None})


class TextNormalizer(_TextStep):
    """Strip, remove tags, lower, strip characters, fix, remove stop words: each step by its flag."""

    lower = Param(Params._dummy(), "lower", "lower case", TypeConverters.toBoolean)
    stripCharacters = Param(Params._dummy(), "stripCharacters", "drop list numbering and unusual characters", TypeConverters.toBoolean)
    stopwords = Param(Params._dummy(), "stopwords", "drop stop words and marks", TypeConverters.toBoolean)
    removeTags = Param(Params._dummy(), "removeTags", "take the text of HTML", TypeConverters.toBoolean)
    fixText = Param(Params._dummy(), "fixText", "single blanks and points", TypeConverters.toBoolean)
    language = Param(Params._dummy(), "language", "language of the stop words", TypeConverters.toString)

    def __init__(self, inputCol=None, outputCol=None, lower=None, stripCharacters=None, stopwords=None, removeTags=None, fixText=None, language=None) -> None:
        super().__init__()
        self._setDefault(lower=True, stripCharacters=False, stopwords=False, removeTags=False, fixText=True, language="russian")
        self._put(inputCol=inputCol, outputCol=outputCol, lower=lower, stripCharacters=stripCharacters, stopwords=stopwords, removeTags=removeTags, fixText=fixText, language=language)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        get = self.getOrDefault
        listed = stop_words(dataset.sparkSession, get(self.language)) if get(self.stopwords) else None
        out = normalize(F.col(self.getInputCol()), get(self.lower), get(self.stripCharacters), get(self.fixText), listed, get(self.removeTags))
        return dataset.withColumn(self.getOutputCol(), out)


# Endings of the published Russian Snowball stemmer. Those after а or я come first in pairs.
_PERFECTIVE = (("вшись", "вши", "в"), ("ившись", "ывшись", "ивши", "ывши", "ив", "ыв"))
_REFLEXIVE = ("ся", "сь")
_ADJECTIVE = "ими ыми его ого ему ому ее ие ые ое ей ий ый ой ем им ым ом их ых ую юю ая яя ою ею".split()
_PARTICIPLE = (("ем", "нн", "вш", "ющ", "щ"), ("ивш", "ывш", "ующ"))
_VERB = (
    "ете йте ешь нно ла на ли ем ло но ет ют ны ть й л н".split(),
    "ейте уйте ила ыла ена ите или ыли ило ыло ено ует уют ены ить ыть ишь ей уй ил ыл им ым ен ят ит ыт ую ю".split(),
)
_NOUN = "иями ями ами ией иям ием иях ев ов ие ье еи ии ей ой ий ям ем ам ом ах ях ию ью ия ья а е и й о у ы ь ю я".split()
_DERIVED = ("ость", "ост")
_SUPERLATIVE = ("ейше", "ейш")
_VOWELS = "аеиоуыэюя"


def _longest(word: str, region: int, endings, after: bool = False) -> str | None:
    for e in sorted(endings, key=len, reverse=True):
        if word.endswith(e) and len(word) - len(e) >= region and (not after or word[: -len(e)][-1:] in ("а", "я") and len(word) - len(e) - 1 >= region):
            return e
    return None


def _either(word: str, region: int, pair) -> str | None:
    found = [x for x in (_longest(word, region, pair[0], True), _longest(word, region, pair[1])) if x is not None]
    return max(found, key=len, default=None)


@cache
def stem(word: str) -> str:
    """The stem of a Russian word by the published Snowball rules; other words in lower case."""
    w = word.lower().replace("ё", "е")
    if not any(c in _VOWELS for c in w):
        return w
    rv = next(i for i, c in enumerate(w) if c in _VOWELS) + 1

    def region(start: int) -> int:
        i = start
        while i < len(w) and w[i] not in _VOWELS:
            i += 1
        while i < len(w) and w[i] in _VOWELS:
            i += 1
        return min(i + 1, len(w))

    r2 = region(region(0))
    if (e := _either(w, rv, _PERFECTIVE)) is not None:
        w = w[: -len(e)]
    else:
        if e := _longest(w, rv, _REFLEXIVE):
            w = w[: -len(e)]
        if e := _longest(w, rv, _ADJECTIVE):
            w = w[: -len(e)]
            if (p := _either(w, rv, _PARTICIPLE)) is not None:
                w = w[: -len(p)]
        elif (e := _either(w, rv, _VERB)) is not None:
            w = w[: -len(e)]
        elif e := _longest(w, rv, _NOUN):
            w = w[: -len(e)]
    if w.endswith("и") and len(w) - 1 >= rv:
        w = w[:-1]
    if e := _longest(w, r2, _DERIVED):
        w = w[: -len(e)]
    if w.endswith("нн") and len(w) - 2 >= rv:
        w = w[:-1]
    elif e := _longest(w, rv, _SUPERLATIVE):
        w = w[: -len(e)]
        if w.endswith("нн"):
            w = w[:-1]
    elif w.endswith("ь") and len(w) - 1 >= rv:
        w = w[:-1]
    return w


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stems(s: pd.Series) -> pd.Series:
    return s.map(lambda ws: [stem(w) for w in ws], na_action="ignore")


class TextStemmer(_TextStep):
    """Every word replaced by its stem, joined by blanks."""

    def __init__(self, inputCol=None, outputCol=None) -> None:
        super().__init__()
        self._put(inputCol=inputCol, outputCol=outputCol)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), F.array_join(_stems(words(F.col(self.getInputCol()))), " "))


class TextLemmatizer(_TextStep):
    """Every word replaced by its lemma from a table, joined by blanks; words the table lacks stay, in lower case.

    A morphological analyser can be plugged in as a pandas UDF from array<string> to array<string>.
    """

    def __init__(self, inputCol=None, outputCol=None, lemmas: dict[str, str] | None = None, analyser=None) -> None:
        super().__init__()
        self.lemmas, self.analyser = lemmas or {}, analyser
        self._put(inputCol=inputCol, outputCol=outputCol)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ws = words(F.lower(F.col(self.getInputCol())))
        if self.analyser is not None:
            ws = self.analyser(ws)
        elif self.lemmas:
            table = F.create_map(*[F.lit(x) for kv in self.lemmas.items() for x in kv])
            ws = F.transform(ws, lambda w: F.coalesce(F.try_element_at(table, w), w))
        return dataset.withColumn(self.getOutputCol(), F.array_join(ws, " "))
