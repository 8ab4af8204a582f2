"""Quality rules with distribution divergence.

A document is compared with the reference of its language in two histograms:
character classes, and the language's common words with one bin for all others.
The references are totals over all documents of that language, counted in a pass
of their own; a language's common words are fixed lists of function words, and a
language without a list has the first histogram only.  The distance is that of
Jensen and Shannon (base 2, 0 to 1).  It says little about short texts, so the
verdict needs a least number of words, and each limit lies well above what sound
prose of the length shows.  For common words both ends depend on the language and
the length: a text without any common word has a distance of 0.38 or so (the
reach), and chance alone takes a sound text of 50 words to 0.26.  So the word limit
is a share of the reach, on top of what chance makes of so many words.  Rules on
length and repetition come first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.tables import integral, ready, small, written
from sheaf.llm.words import LOWER, Lanes, Words, doc_grams, lean, pieces, raw

#: Common words of languages.
COMMON = {
    "en": "the of and to in is that it for was on with as be by at this are from or an not which but his they have had were their".split(),
    "de": "der die und das in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec mais on ou".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si".split(),
}
#: Limits: least words for a verdict of divergence, largest distance of character classes, largest share of the reach of common words, and base rules.
LEAST_WORDS, CLASS_LIMIT, WORD_LIMIT = 50, 0.3, 0.6
#: Standard deviations of chance that the word limit leaves at least, and lengths at which chance is worked out; beyond the last it falls as 1 / words.
DEVIATIONS, LENGTHS = 3, np.unique(np.geomspace(8, 2048, 33).astype(np.int64))
SHORT, REPEATED_PERCENT, RUN = 20, 30, 8

#: Classes of a byte: lower, upper, digit, white space, sentence marks, quotes and brackets, symbols, control, start of a wider character, its rest (not counted).
CLASSES = 9
_CLASS = np.full(256, 7, np.uint8)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A] = 0, 1, 2
_CLASS[[0x20, *range(0x09, 0x0E)]] = 3
_CLASS[list(b".,;:!?-")] = 4
_CLASS[list(b"\"'()[]{}")] = 5
_CLASS[list(b"#*$%&|<>@=+_~^`/\\")] = 6
_CLASS[0xC0:] = 8
_CLASS[0x80:0xC0] = 9
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NEWLINE = np.ones(256, bool)
_NEWLINE[:] = False
_NEWLINE[0x0A] = True
_STRIP = ".,;:!?\"'()[]{}-"


def _common_hashes() -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Sorted hashes of all common words of all languages, and their (language, place) table."""
    langs = list(COMMON)
    names = sorted({w for v in COMMON.values() for w in v})
    data, offsets = raw(pa.array(names, pa.string()))
    h = Words(data, offsets).hash
    place = np.full((len(langs), len(names)), -1)
    for i, lang in enumerate(langs):
        for j, w in enumerate(COMMON[lang]):
            place[i, names.index(w)] = j
    order = np.argsort(h)
    return h[order], place[:, order], langs


def _per_doc(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(flags))[first])


def histograms(data: np.ndarray, offsets: np.ndarray, lang: list) -> tuple[np.ndarray, np.ndarray]:
    """Character classes (n, CLASSES) and common words (n, 31: 30 words of the language and others) of each text."""
    n = len(offsets) - 1
    own = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(own * 10 + _CLASS[data], minlength=n * 10).reshape(n, 10)[:, :CLASSES]
    known, place, langs = _common_hashes()
    # Letters only, so that a mark at a word's end doesn't matter.
    marks = np.zeros(256, bool)
    marks[:0x80] = True
    marks[0x41:0x5B] = marks[0x61:0x7B] = False
    words = Words(LOWER[data], offsets, marks)
    spot = np.minimum(np.searchsorted(known, words.hash), len(known) - 1)
    which = np.array([langs.index(x) if x in langs else -1 for x in lang])[words.doc] if len(words) else np.empty(0, np.int64)
    bin_ = np.where((known[spot] == words.hash) & (which >= 0), place[which, spot], -1)
    bin_[bin_ < 0] = 30
    return kinds, np.bincount(words.doc * 31 + bin_, minlength=n * 31).reshape(n, 31)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of rows of counts; 0 where either has none."""
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = p / p.sum(axis=1, keepdims=True), q / q.sum(axis=1, keepdims=True)
        m = (a + b) / 2
        kl = lambda x: np.where(x > 0, x * np.log2(x / m), 0).sum(axis=1)
        out = np.sqrt(np.maximum((kl(a) + kl(b)) / 2, 0))
    return np.where((p.sum(axis=1) > 0) & (q.sum(axis=1) > 0), out, 0.0)


@lru_cache(64)
def _chance(reference: bytes) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean and standard deviation of the divergence of LENGTHS words drawn from a reference, and the divergence of a text without its common words."""
    q = np.frombuffer(reference)
    q = q / max(q.sum(), 1)
    logs = np.append(0, np.cumsum(np.log(np.arange(1, LENGTHS[-1] + 1))))
    some = q[(q > 0) & (q < 1)][:, None]
    mean, spread = np.zeros(len(LENGTHS)), np.zeros(len(LENGTHS))
    for i, n in enumerate(LENGTHS.tolist()):
        x = np.arange(n + 1)
        chance = np.exp(logs[n] - logs[x] - logs[n - x] + x * np.log(some) + (n - x) * np.log1p(-some))
        p, m = x / n, (x / n + some) / 2
        bits = (np.where(x > 0, p * np.log2(np.where(x > 0, p, 1) / m), 0) + some * np.log2(some / m)) / 2
        own = (chance * bits).sum(axis=1)
        mean[i], spread[i] = own.sum(), np.sqrt(((chance * bits**2).sum(axis=1) - own**2).clip(0).sum())
    none = np.zeros((1, len(q)))
    none[0, -1] = 1
    return mean, spread, float(distance(none, q[None])[0]) ** 2


def word_bounds(counts: np.ndarray, references: np.ndarray, share: float) -> np.ndarray:
    """The largest distance of common words for texts of so many words, each against its reference (rows of counts)."""
    out = np.zeros(len(counts))
    kinds, which = np.unique(references, axis=0, return_inverse=True)
    for i, reference in enumerate(kinds):
        own = np.flatnonzero(which.ravel() == i)
        mean, spread, reach = _chance(np.ascontiguousarray(reference, np.float64).tobytes())
        n = np.maximum(counts[own], 1)
        within, beyond = np.log(np.minimum(n, LENGTHS[-1])), np.maximum(n / LENGTHS[-1], 1)
        chance, deviation = (np.interp(within, np.log(LENGTHS), x) / beyond for x in (mean, spread))
        out[own] = np.sqrt(chance + np.maximum(share**2 * reach, DEVIATIONS * deviation))
    return out


@lean
def _reference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str | None, np.ndarray] = {}
    for batch in batches:
        for piece in pieces(batch):
            lang = piece.column("lang").to_pylist()
            kinds, common = histograms(*raw(piece.column("text")), lang)
            both = np.hstack((kinds, common))
            codes = {x: i for i, x in enumerate(dict.fromkeys(lang))}
            index = np.array([codes[x] for x in lang])
            for x, i in codes.items():
                total[x] = total.get(x, 0) + both[index == i].sum(axis=0)
            if len(total) > 1000:
                yield _counted(total)
                total = {}
    yield _counted(total)


def _counted(total: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"lang": pa.array(list(total), pa.string()), "counts": pa.array([x.tolist() for x in total.values()], pa.list_(pa.int64()))})


def language_references(source: DataFrame) -> DataFrame:
    """(lang, counts array<long>): both histograms, one after the other, summed over all documents of each language."""
    width = CLASSES + 31
    counts = source.mapInArrow(_reference, "lang string, counts array<long>")
    return counts.groupBy("lang").agg(*(F.sum(F.get("counts", F.lit(i))).alias(f"c{i}") for i in range(width))).select("lang", F.array(*(f"c{i}" for i in range(width))).alias("counts"))


def _repeats(words: Words, run: int) -> np.ndarray:
    """Words of each document in a window of ``run`` words that is found twice or more in it."""
    g, at = doc_grams(words, run)
    covered = np.zeros(len(words) + 1, np.int64)
    cuts = np.searchsorted(at, words.first)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a > 1:
            order = np.argsort(g[a:b], kind="stable")
            s = g[a:b][order]
            same = s[1:] == s[:-1]
            if same.any():
                twice = np.append(same, False) | np.append(False, same)
                start = at[a:b][order[twice]]
                np.add.at(covered, start, 1)
                np.subtract.at(covered, start + run, 1)
    return _per_doc(np.cumsum(covered)[: len(words)] > 0, words.first)


def _duplicate_lines(data: np.ndarray, offsets: np.ndarray, words: Words) -> np.ndarray:
    """Lines of each document that have a word and equal an earlier line of it."""
    lines = Words(data, offsets, _NEWLINE)  # empty lines have no word anyway
    out = np.zeros(len(offsets) - 1, np.int64)
    if not len(lines):
        return out
    seen = np.append(0, np.cumsum(words.inside))
    some = np.flatnonzero(seen[lines.end] > seen[lines.start])
    doc, lanes = lines.doc[some], lines.lanes(some)
    # By document and hash; a line counts if its bytes are those of the line before it in this order.
    todo, seed = np.arange(len(doc)), 0
    h = lanes.hash() if len(doc) else np.empty(0, np.uint64)
    while len(todo):
        order = np.lexsort((todo, h, doc[todo]))
        todo, h = todo[order], h[order]
        head = np.append(True, (h[1:] != h[:-1]) | (doc[todo[1:]] != doc[todo[:-1]]))
        first = todo[np.flatnonzero(head)[np.cumsum(head) - 1]]
        rest = Lanes(data, lines.start[some][todo], lines.end[some][todo] - lines.start[some][todo])
        equal = rest.same(lanes, first)
        out += np.bincount(doc[todo[equal & ~head]], minlength=len(out))
        # Lines of one hash and other bytes are compared among themselves by another hash.
        todo, seed = todo[~equal], seed + 1
        if len(todo):
            h = lines.lanes(some[todo]).hash(seed)
    return out


@lean
def _rules(batches: Iterator[pa.RecordBatch], limits: tuple[int, float, float]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch):
            data, offsets = raw(piece.column("text"))
            words = Words(data, offsets)
            n = words.counts
            chars = words.inside & ((data < 0x80) | (data >= 0xC0))
            lang = piece.column("lang").to_pylist()
            kinds, common = histograms(data, offsets, lang)
            counts = np.array([x or [0] * (CLASSES + 31) for x in piece.column("counts").to_pylist()], np.float64).reshape(len(n), -1)
            d_class, d_word = distance(kinds.astype(float), counts[:, :CLASSES]), distance(common.astype(float), counts[:, CLASSES:])
            repeated = _repeats(words, RUN)
            failed = (n < SHORT) | (100 * repeated > REPEATED_PERCENT * n)
            odd = (n >= limits[0]) & ((d_class > limits[1]) | (d_word > word_bounds(common.sum(axis=1), counts[:, CLASSES:], limits[2])))
            columns = [n, _per_doc(chars, offsets), _per_doc(_SYMBOL[data], offsets), _duplicate_lines(data, offsets, words), repeated]
            yield pa.RecordBatch.from_arrays(
                [piece.column("id"), piece.column("text_hash"), *(pa.array(x.astype(np.int64)) for x in columns), pa.array(failed), pa.array(~failed & ~odd), pa.array(d_class), pa.array(d_word)],
                ["id", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"],
            )


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_words: int = LEAST_WORDS, class_limit: float = CLASS_LIMIT, word_limit: float = WORD_LIMIT, references: DataFrame | None = None) -> DataFrame:
    """One row for each row: id, text_hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance.

    A null or empty text has no words and fails.  Rows of a null or rare language
    are held against that language's own totals.  ``references`` (lang, counts), as
    ``language_references`` makes them of sound documents, stands in for the totals
    of the table itself; a language that it lacks is judged by the base rules only.
    Null and repeated ids are rows like others; other columns are left out; an
    empty table gives an empty one.
    """
    ready(docs.sparkSession)
    source = docs.select(integral(docs, id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).withColumn("text_hash", F.xxhash64("text"))
    reference = language_references(source.select("text", "lang")) if references is None else references
    # One row for each language; beyond a thousand the join is shuffled.
    reference = small(written(reference, "references"), 1000).withColumnRenamed("lang", "of")
    joined = source.join(reference, F.col("lang").eqNullSafe(F.col("of")), "left").drop("of")
    schema = "id long, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"
    return joined.mapInArrow(partial(_rules, limits=(least_words, class_limit, word_limit)), schema).withColumnRenamed("id", id_col)
