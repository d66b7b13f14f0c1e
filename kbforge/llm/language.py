"""Language identification by words first, then by ever shorter character n-grams for words never seen.

Training counts words by language on labelled texts. The sample is bounded: of each language about ``SAMPLE_DOCS``
documents, chosen by a hash of their text, all of them where there are fewer. The model holds every word and n-gram of the
sample, each with a log frequency for each language; the bound on the sample is the only one. It is broadcast.

A text's words are its runs of letters, lower-cased. A known word adds its log frequency for each language. An unknown
word is spelt with its ends marked and cut into 4-grams; those the model knows are averaged, and if it knows none, 3-,
2- and 1-grams are tried in turn. A word of which even no letter is known adds nothing. The text gets the language of the
highest sum, equal sums the alphabetically first; the score is that language's share of the posterior at equal priors.

Null texts and texts without a letter get ``und`` and 0. So does every text if nothing is labelled. Languages of null are
not learned from. Null ids and repeated rows stay as rows, other columns are ignored. Whole texts are read, whatever
their length.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kbforge.functions.storage import materialize
from kbforge.llm.token_words import slices

#: Texts of a language, and of all languages, that are learned from, about; and characters of the longest one.
SAMPLE_DOCS, SAMPLE_ALL, SAMPLE_TEXT = 500, 20_000, 1_000_000
ORDERS = (4, 3, 2, 1)
SMOOTHING = 0.5
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
#: Which characters are number signs that are no letters, though ``\\w`` takes them: fractions, superscripts, numerals.
_IS_SIGN = np.array([c.isalnum() and not c.isalpha() and not c.isdecimal() for c in map(chr, range(sys.maxunicode + 1))])
_SIGNS = re.compile("[" + "".join(map(chr, np.flatnonzero(_IS_SIGN).tolist())) + "]")
#: Rows of a table of languages that may be broadcast.
BROADCAST_LANGUAGES = 100_000
#: Characters of text whose words are scored at a time.
SLICE = 400_000
#: Words that a worker remembers the scores of.
_CACHE = 300_000


def held_out(doc_id: Column) -> Column:
    """The quarter of all documents that training never sees; a null id is in no quarter."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _words(texts: list[str]) -> list[list[str]]:
    """The words of each text; signs are looked for in all texts at once, as few have any."""
    if _IS_SIGN[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)].any():
        texts = [t if t.isascii() else _SIGNS.sub(" ", t) for t in texts]
    return [_LETTERS.findall(t.lower()) for t in texts]


def _grams(word: str, n: int) -> list[str]:
    if n == 1:
        return list(word)
    marked = f"\x02{word}\x03"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def sample(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> DataFrame:
    """``lang, text``: of the unlike texts of each language a share by hash that gives ``per_language`` on average.

    Copies count once, and of all languages together ``SAMPLE_ALL`` texts are drawn on average. Texts above ``SAMPLE_TEXT``
    characters are not learned from.
    """
    rows = docs.filter(f"lang IS NOT NULL AND length(text) <= {SAMPLE_TEXT}").select("lang", "text", F.xxhash64("text", F.lit(17)).alias("h"))
    counts = materialize(rows.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")), "languages")
    each = min(per_language, max(1, SAMPLE_ALL // max(1, counts.count())))
    share = counts.select("lang", F.least(F.lit(1.0), F.lit(float(each)) / F.col("n")).alias("share"))
    share = F.broadcast(share) if counts.count() <= BROADCAST_LANGUAGES else share
    draw = F.pmod("h", F.lit(1 << 20)) / float(1 << 20)
    return rows.join(share, "lang").filter(draw < F.col("share")).dropDuplicates(["lang", "h"]).select("lang", "text")


def word_counts(labelled: DataFrame) -> DataFrame:
    """``lang, word, n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.update((lang, w) for w in _words([text])[0])
            langs, words = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(found.values(), pa.int64())], names=["lang", "word", "n"])

    return labelled.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _counted(counts: DataFrame, langs: list[str]) -> tuple[list[str], np.ndarray]:
    """Items in order and a row of counts by language for each; as large as the bounded sample."""
    found = counts.select("item", "lang", "n").toArrow()
    items = sorted(set(found["item"].to_pylist()))
    place = {item: k for k, item in enumerate(items)}
    table = np.zeros((len(items), len(langs)))
    column = {lang: k for k, lang in enumerate(langs)}
    table[[place[i] for i in found["item"].to_pylist()], [column[g] for g in found["lang"].to_pylist()]] = found["n"].to_numpy()
    return items, table


class Model:
    """Languages, and the rows of known words and n-grams in tables of log frequencies."""

    def __init__(self, langs: list[str], words: tuple[list[str], np.ndarray], grams: tuple[list[str], np.ndarray]):
        self.langs = langs
        self.words, self.grams = ({item: k for k, item in enumerate(items)} for items, _ in (words, grams))
        self.word_scores, self.gram_scores = words[1], grams[1]

    def scorer(self) -> "Scorer":
        """The worker's scorer; it lives as long as the worker holds the model."""
        if "own" not in self.__dict__:
            self.own = Scorer(self)
        return self.own


def _logs(counts: np.ndarray) -> np.ndarray:
    """Log frequencies by language, smoothed."""
    return np.log(counts + SMOOTHING) - np.log(counts.sum(axis=0) + SMOOTHING * (len(counts) + 1))


def train(labelled: DataFrame, per_language: int = SAMPLE_DOCS) -> Model:
    counts = materialize(word_counts(sample(labelled, per_language)), "words")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    words, table = _counted(counts.withColumnRenamed("word", "item"), langs)
    marked = F.concat(F.lit("\x02"), "word", F.lit("\x03"))

    def cut(n: int) -> Column:
        text = F.col("word") if n == 1 else marked
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))

    grams = counts.select("lang", "n", F.explode(F.concat(*map(cut, ORDERS))).alias("item")).groupBy("lang", "item").agg(F.sum("n").alias("n"))
    items, found = _counted(grams, langs)
    order = np.array([len(i) for i in items])
    for n in np.unique(order):
        found[order == n] = _logs(found[order == n])
    return Model(langs, (words, _logs(table)), (items, found))


class Scorer:
    """Sums of a model over texts. The scores of words seen before stand in a table, a row for each word."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.model.langs)))

    def learn(self, new: list[str]) -> None:
        """Add the scores of new words; those of unknown words are the means of their known n-grams' scores."""
        while len(self.rows) + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        base = len(self.rows)
        self.rows.update(zip(new, range(base, base + len(new))))
        block = self.table[base : base + len(new)]
        block[:] = 0
        at = [self.model.words.get(w, -1) for w in new]
        seen = [i for i, r in enumerate(at) if r >= 0]
        block[seen] = self.model.word_scores[[at[i] for i in seen]]
        rest, known = [i for i, r in enumerate(at) if r < 0], self.model.grams.get
        for n in ORDERS:
            flat: list[int] = []
            sizes, found, left = [], [], []
            for i in rest:
                hits = [r for g in _grams(new[i], n) if (r := known(g)) is not None]
                if hits:
                    flat += hits
                    sizes.append(len(hits))
                    found.append(i)
                else:
                    left.append(i)
            if found:
                count = np.array(sizes)
                block[found] = np.add.reduceat(self.model.gram_scores[flat], np.cumsum(count) - count, axis=0) / count[:, None]
            rest = left

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        words = _words(texts)
        sizes = np.array([len(w) for w in words], np.int64)
        out = [(UNKNOWN, 0.0)] * len(texts)
        full = np.flatnonzero(sizes)
        if not len(full) or not self.model.langs:
            return out
        if len(self.rows) > _CACHE:
            self.clear()
        coded = pa.array(list(chain.from_iterable(words)), pa.string()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        self.learn([w for w in distinct if w not in self.rows])
        codes = np.fromiter(map(self.rows.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        sums = np.add.reduceat(self.table[codes], (np.cumsum(sizes) - sizes)[full], axis=0)
        best = sums.argmax(axis=1)
        share = 1.0 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        for i, k, score in zip(full.tolist(), best.tolist(), share.tolist()):
            out[i] = (self.model.langs[k], score)
        return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` of every text; map-only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            found = [f for part in slices(batch.column(1).to_pylist(), SLICE) for f in scorer.predict(part)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> DataFrame:
    """Learn from the labelled documents that are not held out, predict all: ``doc_id, held_out, lang_pred, score``."""
    model = train(docs.filter(~held_out(F.col("doc_id"))).select("lang", "text"), per_language)
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
