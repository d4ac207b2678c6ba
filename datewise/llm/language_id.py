"""Language identification by rank-order profiles.

Each language's profile is its most frequent character n-grams over every
training text. A document gets a profile of its own and is compared with each
language by the out-of-place distance: how far each of its n-grams stands from
its rank in the language, or the profile's size where the language lacks it.

n-grams are 63-bit numbers of three 21-bit places, so that texts are counted by
sorting arrays. The order of the numbers is that of the n-grams as strings.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

#: n-grams a profile holds, of a language and of a document.
PROFILE_SIZE = 300
#: Longest n-gram; a word is padded by one mark on either side.
NGRAM = 3
#: n-grams that a task sorts at a time.
SORT_ITEMS = 2_000_000
#: Language of a text that has no letter.
UNDETERMINED = "und"

_MARK = 1  # the padding; an absent place is 0 and a letter its code point plus 2


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Number of each code point: itself plus 2 for letters, the mark for anything else."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    table = np.full(0x110000, _MARK, dtype=np.int64)
    numbers = np.array(points, dtype=np.int64)
    for m in regex.finditer(r"\p{L}+", "".join(map(chr, points))):
        own = numbers[m.start():m.end()]
        table[own] = own + 2
    return table


def ngrams(text: str) -> np.ndarray:
    """All 1- to 3-grams inside the padded words of a text, with repeats."""
    table = _letters()
    c = table[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    gap = c == _MARK
    c = c[~(gap & np.concatenate([[False], gap[:-1]]))]  # one mark between words
    gap = c == _MARK
    two = (c[:-1] << 42) | (c[1:] << 21)
    three = two[:-1] | c[2:]
    return np.concatenate([c[~gap] << 42, two, three[~gap[1:-1]]]) if len(c) > 1 else np.empty(0, np.int64)


def as_text(gram: int) -> str:
    return "".join("_" if x == _MARK else chr(x - 2) for x in (gram >> 42, gram >> 21 & 0x1FFFFF, gram & 0x1FFFFF) if x)


def profile(grams: np.ndarray, size: int = PROFILE_SIZE) -> np.ndarray:
    """The most frequent n-grams, ties in string order."""
    distinct, counts = np.unique(grams, return_counts=True)
    return distinct[np.argsort(-counts, kind="stable")[:size]]


def language_profiles(train: DataFrame, text_col: str = "text", lang_col: str = "lang",
                      size: int = PROFILE_SIZE) -> dict[str, list[int]]:
    """Profiles of every language over all training rows; rows with a null text or language teach nothing.

    Counts are combined per task before they are shuffled. What reaches the
    driver is `size` n-grams a language.
    """

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        grams, place = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        return grams, np.bincount(place, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

    def count(batches):
        waiting: dict[str, list[np.ndarray]] = {}
        held: dict[str, int] = {}
        counted: dict[str, list] = {}

        def sort(lang):
            counted.setdefault(lang, []).append(np.unique(np.concatenate(waiting.pop(lang)), return_counts=True))
            held[lang] = 0
            if len(counted[lang]) > 8:
                counted[lang] = [merged(counted[lang])]

        for batch in slices(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams = ngrams(text)
                waiting.setdefault(lang, []).append(grams)
                held[lang] = held.get(lang, 0) + len(grams)
                if held[lang] > SORT_ITEMS // 4:
                    sort(lang)
        for lang in list(waiting):
            sort(lang)
        for lang, parts in counted.items():
            grams, n = merged(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])

    rows = train.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        "text IS NOT NULL AND lang IS NOT NULL")
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size)
    profiles: dict[str, list[int]] = {}
    for r in ranked.orderBy("lang", "rank").collect():
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


class _Language:
    def __init__(self, grams: list[int]):
        grams = np.array(grams, dtype=np.int64)
        self.ranks = np.argsort(grams)
        self.grams = grams[self.ranks]

    def distance(self, document: np.ndarray, size: int) -> int:
        """Out-of-place distance of a document's profile."""
        if not len(self.grams):
            return size * len(document)
        at = np.minimum(np.searchsorted(self.grams, document), len(self.grams) - 1)
        off = np.abs(self.ranks[at] - np.arange(len(document)))
        return int(np.where(self.grams[at] == document, off, size).sum())


def identify(docs: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text",
             size: int = PROFILE_SIZE, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, then `keep`.

    `lang_pred` has the smallest out-of-place distance, ties to the first name
    in alphabetical order; `und` when the text is null, has no letter, or there
    are no profiles. `score` is 1 - distance / (largest possible distance), 0
    for `und`. Texts are read whole. Only the text decides. An empty table gives
    an empty result; other columns are ignored, whatever their names.
    """
    tables = [(lang, _Language(grams)) for lang, grams in sorted(profiles.items())]

    def predict(batches):
        for batch in slices(batches):
            langs, scores = [], []
            for text in batch.column(1).to_pylist():
                own = profile(ngrams(text), size) if text else []
                if not len(own) or not tables:
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                distance, lang = min((table.distance(own, size), lang) for lang, table in tables)
                langs.append(lang)
                scores.append(1.0 - distance / (size * len(own)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                 *batch.columns[2:]], ["doc_id", "lang_pred", "score", *[f"keep_{c}" for c in keep]])

    kind = docs.schema[id_col].dataType.simpleString()
    extra = "".join(f", `keep_{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                      *[F.col(c).alias(f"keep_{c}") for c in keep]).mapInArrow(
        predict, f"doc_id {kind}, lang_pred string, score double{extra}")
    return out.select("doc_id", "lang_pred", "score", *[F.col(f"keep_{c}").alias(c) for c in keep])
