"""Language identification by interpolated Kneser-Ney character models kept in sorted hash arrays."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from . import words as w

ORDER = 5
DISCOUNT = 0.75
SAMPLE_BYTES = 4 << 20  # training text of all languages together: bounds the model that is sent to the tasks
LANGUAGES = 256  # languages whose tables are kept together; more are kept in several groups
REJECT_SHARE = 0.01  # share of the training texts that the calibrated threshold would reject
CALIBRATION_BYTES = 1 << 20  # and their text, all languages together
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_BOUND = "\n"  # stands before and after each word; no word has one inside


def has_letter(text: bytes) -> bool:
    return _ASCII_LETTER.search(text) is not None or any(c.isalpha() for c in text.decode() if c > "\x7f")


def training_rows(doc_id: Column) -> Column:
    """Rows to learn from; a row without id is none."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _numbers(order: int, sums: np.ndarray) -> np.ndarray:
    """Hash numbers of grams of `order` characters from their polynomial sums."""
    return (w.mixed(sums + np.uint64(order)) >> np.uint64(1)).astype(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)


def _sums(codes: np.ndarray) -> list[np.ndarray]:
    """For 0 to ORDER characters the polynomial sum of the last so many at each place, the latest with the lowest power."""
    out = [np.zeros(len(codes), np.uint64)]
    for k in range(ORDER):
        back = np.concatenate((np.zeros(min(k, len(codes)), np.uint64), codes[:max(len(codes) - k, 0)]))
        out.append(out[-1] + back * np.uint64(pow(int(_STEP), k, 1 << 64)))
    return out


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Character n-grams of words with their counts: `(lang, gram, n)` of 1 to ORDER characters."""
    for batch in batches:
        found: Counter = Counter()
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            text = _BOUND + word.lower() + _BOUND
            for end in range(2, len(text) + 1):
                for size in range(1, min(ORDER, end) + 1):
                    found[lang, text[end - size:end]] += n
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in zip(*((lang, gram, n) for (lang, gram), n in found.items()))] if found
            else [pa.array([], t) for t in (pa.string(), pa.string(), pa.int64())], names=["lang", "gram", "n"],
        )


@dataclass
class Table:
    """Of one order, a column for each language: sorted gram numbers with their discounted probabilities, sorted context
    numbers with their back-off weights (1 for a context the language never had)."""

    grams: np.ndarray
    share: np.ndarray
    contexts: np.ndarray
    rest: np.ndarray


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full((len(wanted), values.shape[1]), missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[at] == wanted)[:, None], values[at], missing)


def _spread(numbers: np.ndarray, language: np.ndarray, values: np.ndarray, languages: int, missing: float) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(numbers, return_inverse=True)
    out = np.full((len(keys), languages), missing)
    out[at, language] = values
    return keys, out


def _table(order: int, counts: dict[tuple[int, str], int], languages: int) -> Table:
    """counts: (language, gram) to its count (highest order) or to the number of characters seen before it (lower)."""
    if not counts:
        none = np.zeros(0, np.int64), np.zeros((0, languages))
        return Table(*none, *none)
    language = np.fromiter((k for k, _ in counts), np.int64, len(counts))
    n = np.fromiter(counts.values(), np.float64, len(counts))
    codes = _codes("".join(gram for _, gram in counts)).reshape(-1, order)
    sums = np.stack(_sums(codes.reshape(-1)), axis=1).reshape(len(counts), order, ORDER + 1)
    grams = _numbers(order, sums[:, -1, order])
    contexts = _numbers(order, sums[:, -2, order - 1]) if order > 1 else _numbers(order, np.zeros(len(counts), np.uint64))
    pairs, at = np.unique(np.stack((language, contexts)), axis=1, return_inverse=True)
    total, kinds = np.bincount(at, n), np.bincount(at)
    share = _spread(grams, language, np.maximum(n - DISCOUNT, 0) / total[at], languages, 0.0)
    rest = _spread(pairs[1], pairs[0], DISCOUNT * kinds / total, languages, 1.0)
    return Table(*share, *rest)


@dataclass
class Model:
    """For each LANGUAGES languages one table per order, order 1 first."""

    languages: list[str]
    groups: list[list[Table]]
    characters: int
    limit: float = math.inf  # bits a character above which a text is like none of the languages

    def word_bits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each word and the bound after it under each language, and the number of these characters.

        A character's chance depends on the last ORDER characters alone, so each such run is looked up once."""
        lowered = [word.lower() for word in words]
        codes = _codes(_BOUND + "".join(word + _BOUND for word in lowered))
        place = np.arange(1, len(codes))
        bound = np.maximum.accumulate(np.where(codes[:-1] == ord(_BOUND) + 1, place - 1, 0))
        size = np.minimum(place - bound + 1, ORDER)
        sums = _sums(codes)
        top = np.stack(sums)[size, place] + size.astype(np.uint64) * _STEP
        _, first, back = np.unique(top, return_index=True, return_inverse=True)
        at, size = place[first], size[first]
        chances = [np.zeros((len(at), 0))]
        for tables in self.groups:
            chance = np.full((len(at), tables[0].share.shape[1]), 1.0 / (self.characters + 1))
            for order, table in enumerate(tables, 1):
                gram, context = _numbers(order, sums[order][at]), _numbers(order, sums[order - 1][at - 1])
                longer = _look(table.grams, table.share, gram, 0.0) + _look(table.contexts, table.rest, context, 1.0) * chance
                chance = np.where((size >= order)[:, None], longer, chance)
            chances.append(chance)
        chance = np.concatenate(chances, axis=1)
        bits, sizes = -np.log2(chance), np.array([len(word) + 1 for word in lowered], np.int64)
        starts = w.bounds(sizes)[:-1]
        columns = [np.add.reduceat(bits[back, k], starts) if len(words) else np.zeros(0) for k in range(len(self.languages))]
        return np.stack(columns, axis=1), sizes


class Scorer:
    """Bits of whole texts under each language; words met before are remembered."""

    def __init__(self, model: Model):
        self.model = model
        self.fewer = -(-len(model.languages) // LANGUAGES) or 1  # groups of languages: so many times fewer words at once
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.bits, self.sizes = np.zeros((1 << 12, len(self.model.languages))), np.zeros(1 << 12, np.int64)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        """Length-normalised cross-entropy: bits a character, a row for each text."""
        split = [text.split() for text in texts]
        fresh = sorted({x for words in split for x in words if x not in self.place})
        if len(self.place) + len(fresh) > w.CACHE_WORDS // self.fewer:
            self._forget()
            fresh = sorted({x for words in split for x in words})
        step = max(1, 20_000 // self.fewer)
        for a in range(0, len(fresh), step):
            part = fresh[a:a + step]
            decoded = [x.decode() for x in part]
            at = len(self.place)
            while at + len(part) > len(self.sizes):
                self.bits, self.sizes = np.concatenate((self.bits, self.bits)), np.concatenate((self.sizes, self.sizes))
            self.bits[at:at + len(part)], self.sizes[at:at + len(part)] = self.model.word_bits(decoded)
            self.place.update((x, at + k) for k, x in enumerate(part))
        ends = w.bounds([len(x) for x in split])
        at = np.fromiter((self.place[x] for words in split for x in words), np.int64, int(ends[-1]))
        out = np.zeros((len(texts), len(self.model.languages)))
        full = np.flatnonzero(np.diff(ends))
        if len(full):
            size = np.add.reduceat(self.sizes[at], ends[full])
            for k in range(out.shape[1]):
                out[full, k] = np.add.reduceat(self.bits[at, k], ends[full]) / size
        return out


def _sample(rows: DataFrame, limit: int) -> DataFrame:
    """Whole rows, the lowest in a fixed mix of their ids, until they fill the share of their language: the last one may
    cross it, so each language has one row at least."""
    mix = F.xxhash64("doc_id", F.lit(3))
    rows = rows.withColumns({"_mix": mix, "_step": F.shiftright(mix, 48), "_size": F.octet_length("text").cast("long")})
    # Whole languages are not sorted: steps of the mix, at most 65,536 a language, tell which rows can be reached.
    steps = rows.groupBy("lang", "_step").agg(F.sum("_size").alias("_bytes"))
    before = Window.partitionBy("lang").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("_bytes").over(before.orderBy("_step")), F.lit(0))
    share = rows.agg((F.lit(limit) / F.greatest(F.lit(1), F.count_distinct("lang"))).alias("_share"))
    reached = steps.withColumn("_before", earlier).crossJoin(F.broadcast(share)).where("_before < _share")
    near = rows.join(F.broadcast(reached.select("lang", "_step", "_before", "_share")), ["lang", "_step"])
    inside = Window.partitionBy("lang", "_step").orderBy("_mix", "doc_id", F.xxhash64("text"))
    own = F.coalesce(F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return near.withColumn("_own", own).where("_before + _own < _share").select("doc_id", "lang", "text")


def build(langs: list[str], grams: list[str], times: list[int]) -> Model:
    """The model of summed gram counts."""
    languages = sorted(set(langs))
    number = {lang: k for k, lang in enumerate(languages)}
    counts: list[dict[tuple[int, str], int]] = [{} for _ in range(ORDER)]
    for lang, gram, n in zip(map(number.get, langs), grams, times):
        # A gram that starts with the bound has nothing before it: its own count stands for what precedes it.
        if len(gram) == ORDER or gram[0] == _BOUND and len(gram) > 1:
            counts[len(gram) - 1][lang, gram] = n
        if len(gram) > 1:
            counts[len(gram) - 2][lang, gram[1:]] = counts[len(gram) - 2].get((lang, gram[1:]), 0) + 1
    characters = sum(len(gram) == 1 for gram in set(grams))
    groups = []
    for a in range(0, len(languages), LANGUAGES):
        n = min(LANGUAGES, len(languages) - a)
        own = [{(lang - a, gram): times for (lang, gram), times in c.items() if a <= lang < a + n} for c in counts]
        groups.append([_table(k, c, n) for k, c in enumerate(own, 1)])
    return Model(languages, groups, characters)


def train(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Models of the languages of `docs(doc_id, text, lang)`, of all that have a row with words to learn from, from a
    sample of whole rows in equal shares of `sample_bytes`; the last row of a language may cross its share. An eighth of
    the rows is put aside for the threshold of rejection, unless their language has no others. Rows without id, text, word
    or language are left out."""
    rows = docs.select("doc_id", "text", "lang").where(training_rows(F.col("doc_id")) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    rows = rows.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    aside = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(8)) == 0  # for the threshold
    others = rows.groupBy("lang").agg(F.max(~aside).alias("_others"))
    rows = rows.join(F.broadcast(others), "lang").withColumn("_aside", aside & F.col("_others"))
    words = _sample(rows.where("NOT _aside"), sample_bytes).select("lang", F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word"))
    words = words.where("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n"))
    grams = words.mapInArrow(_grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = grams.toPandas()  # no more rows than the sample has characters times ORDER
    model = build(found["lang"].tolist(), found["gram"].tolist(), found["n"].tolist())
    lacking = {r.lang for r in others.select("lang").collect()}.difference(model.languages)
    if lacking:
        raise ValueError(f"languages without a model: {sorted(lacking)}")
    model.limit = _threshold(model, rows.where("_aside"), sample_bytes)
    return model


def _threshold(model: Model, rows: DataFrame, sample_bytes: int) -> float:
    """The bits a character that all but REJECT_SHARE of rows put aside stay below, each under its own language."""
    if not model.languages:
        return math.inf
    scorer, own = Scorer(model), {x: k for k, x in enumerate(model.languages)}
    sample = _sample(rows, min(CALIBRATION_BYTES, sample_bytes)).toPandas()
    sample = sample[sample["lang"].isin(own)]
    if not len(sample):
        return math.inf
    bits = scorer([t.encode() for t in sample["text"]])
    return float(np.quantile(bits[np.arange(len(sample)), [own[x] for x in sample["lang"]]], 1 - REJECT_SHARE))


def _identified(model, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        names = scorer.model.languages
        for batch in w.blocks(batches):
            texts = w.texts(batch)
            bits = scorer(texts) if names else np.zeros((len(texts), 0))
            letters = np.array([bool(names) and has_letter(text) for text in texts])
            if names:
                best = bits.argmin(axis=1)
                low = bits[np.arange(len(texts)), best]
                odds = np.exp2(-np.minimum((bits - low[:, None]) * 8, 500))
                sure = np.where(letters, 1 / odds.sum(axis=1), 0.0)
            else:
                best, low, sure = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([names[k] if ok else "und" for k, ok in zip(best.tolist(), letters.tolist())], pa.string()),
                pa.array(sure), pa.array(np.where(letters, low, np.nan), from_pandas=True), pa.array(~letters | (low > scorer.model.limit)),
            ], schema=schema)

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """`(doc_id, lang_pred, score, bits_per_character, rejected)` for each row of `docs(doc_id, text)`.

    The language with the fewest bits a character over the whole text wins; of equals the first by name. `score` is its
    share of the odds. `rejected` marks texts without a letter and those that the calibrated threshold finds unlike all
    languages. The model is broadcast, its size bounded by SAMPLE_BYTES. Nulls: a null text has no letter; texts
    without one, and all texts if there is no model, are `und` with score 0. Repeated rows are scored each for itself.
    Other columns are not read. An empty table gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType([
        docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("bits_per_character", T.DoubleType()), T.StructField("rejected", T.BooleanType()),
    ])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(_identified(sent, to_arrow_schema(out)), out)
