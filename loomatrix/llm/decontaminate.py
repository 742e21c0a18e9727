"""Benchmark decontamination by template windows.

Words become a template: numbers, with their units, and names, of one word or several,
turn into typed placeholders, other words lose case and edge punctuation. Windows of eight
template words of the documents are hash-joined with those of the benchmark items, so a
question is found with other numbers, units or names too. A capitalised word that opens a
sentence may be a name or not, so it is read both ways. Windows that are too poor in plain
words for a template, and items shorter than a window, are compared word by word instead.
Along each alignment of a document with an item the placeholders' values must map one to
one: a benchmark value to one document value, and no two to the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import coded_words, edge_hashes, null_safe, raw_bytes, slices, unsigned, unused, window_hashes, words_of, written
from .spans import HashFilter, hash_filter, hash_filter_for_tasks

WHITE = np.array([32, *range(9, 14)], np.uint8)
EDGES = ".,;:!?\"'()[]{}<>«»“”…"
NUMBER = re.compile(r"[+-]?[$€£]?[0-9][0-9.,:/]*%?")
QUANTITY = re.compile(r"[+-]?[$€£]?[0-9][0-9.,:/]*[A-Za-z°µ]{1,5}(/[A-Za-z]{1,2})?")
# fixed values: words that are units after a number, in English, German, French and Spanish
UNITS = frozenset(
    "mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t ton tons tonne tonnes oz lb lbs pound pounds ml cl l litre litres liter liters gallon gallons "
    "s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years % percent km/h mph m/s kmh hz khz mhz ghz w kw mw v kv a ma j kj "
    "kcal cal pa kpa bar k °c °f c f degrees dollar dollars euro euros cent cents usd eur gbp b kb mb gb tb bit bits byte bytes "
    "stunde stunden minuten sekunde sekunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren metern kilometern gramm kilogramm prozent grad "
    "heure heures seconde secondes jour jours semaine semaines mois an ans année années mètre mètres kilomètre kilomètres gramme grammes kilogrammes pour-cent degrés "
    "hora horas minuto minutos segundo segundos día días semana semanas mes meses año años metro metros kilómetro kilómetros gramo gramos kilogramos grados".split()
)
# fixed values: spelled-out numbers; words that are no names where a capital opens them, whatever the corpus shows
SPELLED = {w: str(k) for k, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
SPELLED |= {w: str(10 * k) for k, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
SPELLED |= {w: str(k) for k, w in enumerate("zwei drei vier fünf sechs sieben acht neun zehn elf zwölf".split(), 2)}
SPELLED |= {w: str(k) for k, w in enumerate("deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize".split(), 2)}
SPELLED |= {w: str(k) for k, w in enumerate("dos tres cuatro cinco seis siete ocho nueve diez".split(), 2)}
SPELLED |= {"dozen": "12", "hundred": "100", "thousand": "1000", "million": "1000000", "billion": "1000000000"}
NO_NAMES = frozenset(
    "a an the this that these those i you he she it we they my your his her its our their who whom whose what which when where why how if then than so and or but nor for of in on at by to from "
    "with without into over under after before during between is are was were be been do does did has have had can could would should must not no all each every some any there here as because while".split()
)
LITERAL, NUM, NAME, QTY = range(4)
#: Readings of a window: opening words as literals, or as names; or all words as they stand; or
#: numbers only, names being literals.
PLAIN, NAMED, EXACT, NUMBERED = range(4)
#: A language that gives so many of its words inside sentences a capital, told by so many words at
#: least, marks no names by it.
NOUN_SHARE, NOUN_WORDS = 0.12, 10_000
#: A word of more than this share of the documents, and of so many at least, carries no template.
COMMON_SHARE, COMMON_DOCS = 0.1, 100
#: Windows of more items than this say nothing of one of them, except at places where the item has others.
MANY_ITEMS = 8
#: Placeholders; a quantity is a number that has its unit already.
TYPES = ("", "num", "name", "num")


def _spelled(word: str) -> str | None:
    """The digits of a number in one word: twelve, twenty-five, three-hundred; else None."""
    parts = [SPELLED.get(p) for p in word.split("-")]
    if None in parts:
        return None
    total = run = 0
    for n in map(int, parts):
        if n >= 1000:
            total, run = total + max(run, 1) * n, 0
        else:
            run = max(run, 1) * n if n == 100 else run + n
    return str(total + run)


def _kind(word: str) -> tuple[int, str, str]:
    """What the word can be, its bare form with numbers in digits, and as it stands without case."""
    if word.isalpha() and word.islower():
        return (NUM, SPELLED[word], word) if word in SPELLED else (LITERAL, word, word)
    bare = word.strip(EDGES) or word
    low = bare.lower()
    if NUMBER.fullmatch(bare):
        return QTY if bare.endswith("%") else NUM, bare, low
    if QUANTITY.fullmatch(bare):
        return QTY, low, low
    if (low in SPELLED or "-" in low) and (spelled := _spelled(low)) is not None:
        return NUM, spelled, low
    if bare[0].isupper() and low not in UNITS and low not in NO_NAMES:
        return NAME, low, low
    return LITERAL, low, low


def _ends(word: str) -> bool:
    """Whether a sentence ends with the word."""
    return word[-1] in EDGES and any(c in ".!?" for c in word[len(word.rstrip(EDGES)) :])


class _Reading:
    """The texts' template words: where each starts, what it is, and its value to hash."""

    def __init__(self, made: _Template, kind: np.ndarray):
        n, codes = len(kind), made.codes
        before = np.r_[LITERAL, kind[:-1]][:n]
        # a unit goes into the number before it, a name into the name before it
        joins = made.inner & ((made.unit[codes] & (before == NUM)) | ((kind == NAME) & (before == NAME)))
        self.start = np.flatnonzero(~joins)
        self.end = np.r_[self.start[1:], n][: len(self.start)]
        self.kind = kind[self.start]
        self.value = np.where(self.kind == LITERAL, made.bare_hash[codes[self.start]], made.slot_hash[self.kind])
        self.offsets = np.searchsorted(self.start, made.offsets)
        self.owner = made.owner[self.start]


class _Template:
    """A slice's texts as template words, in both readings, and as bare words without case."""

    def __init__(self, texts: pa.Array, judged: _Judged | None = None, nouns: np.ndarray | None = None):
        import xxhash

        self.texts = texts
        hashed = lambda some, seed: np.array([xxhash.xxh64_intdigest(x.encode(), seed) for x in some], np.uint64)
        self.codes, words, self.offsets = words_of(texts)
        words = words or ["-"]
        said = [_kind(w) for w in words]
        self.bare = [b for _, b, _ in said]
        self.bare_hash, self.slot_hash = hashed(self.bare, 3), hashed([f"<{t}>" for t in TYPES], 5)
        exact = self.bare_hash.copy()
        other = [k for k, (_, bare, low) in enumerate(said) if bare != low]
        exact[other] = hashed([said[k][2] for k in other], 3)
        self.exact = exact[self.codes]
        self.unit = np.array([b in UNITS for b in self.bare])
        self.lower = [low for _, _, low in said]
        self.owner = np.repeat(np.arange(len(texts)), np.diff(self.offsets))
        n = len(self.codes)
        first = np.zeros(n, bool)
        first[self.offsets[:-1][np.diff(self.offsets) > 0]] = True
        after = lambda flags: np.r_[True, flags[self.codes][:-1]][:n]
        #: words with no punctuation between them and the word before
        self.inner = ~first & ~after(np.array([w[-1] in EDGES for w in words]))
        kinds = np.array([k for k, _, _ in said])
        if judged:
            names = np.flatnonzero(kinds == NAME)
            kinds[names[judged.no_names.of_texts([self.lower[k] for k in names.tolist()])]] = LITERAL
        kind = kinds[self.codes]
        self.nouns = nouns if nouns is not None else np.zeros(len(texts), bool)
        kind[self.nouns[self.owner] & (kind == NAME)] = LITERAL
        opening = (kind == NAME) & (first | after(np.array([_ends(w) for w in words])))
        self.readings = [_Reading(self, np.where(opening, LITERAL, kind)), _Reading(self, kind)]

    def windows(self, way: int, length: int, literals: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of a reading's windows inside one text with enough literal words."""
        some = self.readings[way]
        hashes = window_hashes(some.value, length, 0x9E3779B97F4A7C15)
        starts = np.arange(len(hashes))
        plain = np.concatenate([[0], np.cumsum(some.kind == LITERAL)])
        ok = (starts + length <= some.offsets[1:][some.owner[: len(starts)]]) & (plain[starts + length] - plain[starts] >= literals)
        return starts[ok], hashes[ok]

    def carried(self, way: int, starts: np.ndarray, length: int, rare: int, common: HashFilter) -> np.ndarray:
        """Which windows of a reading have so many different plain words that aren't common."""
        some, common = self.readings[way], common.of_texts(self.lower)
        word = self.codes[some.start]
        ok = np.zeros(len(starts), bool)
        for k, s in enumerate(starts.tolist()):
            mine = slice(s, s + length)
            plain = (some.kind[mine] == LITERAL) & ~common[word[mine]]
            ok[k] = len(set(some.value[mine][plain].tolist())) >= rare
        return ok

    def lines(self, starts: np.ndarray, length: int) -> np.ndarray:
        """Whether a window's words are all words of a line of the text."""
        data, bounds = raw_bytes(pc.fill_null(self.texts.cast(pa.large_string()), ""))
        space = np.isin(data, WHITE)
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        at = np.flatnonzero(~space & (edge[:-1] | np.concatenate([[True], space[:-1]])))
        line = np.cumsum(data == 10)[at]
        opens = np.ones(len(at) + 1, bool)
        opens[1:-1] = (line[1:] > line[:-1]) | (self.owner[1:] != self.owner[:-1])
        return opens[starts] & opens[starts + length]

    def exact_windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of all windows inside one text, of bare words without case."""
        hashes = window_hashes(self.exact, length, 0x9E3779B97F4A7C15)
        starts = np.arange(len(hashes))
        ok = starts + length <= self.offsets[1:][self.owner[: len(starts)]]
        return starts[ok], hashes[ok]

    def whole(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of the texts that have so many words."""
        starts, hashes = self.exact_windows(length)
        ok = np.diff(self.offsets)[self.owner[starts]] == length
        return starts[ok], hashes[ok]

    def slots(self, way: int, start: int, length: int) -> list[str]:
        """The placeholders' values in a window."""
        if way == EXACT:
            return []
        some, out = self.readings[way], []
        for k in range(start, start + length):
            if some.kind[k] != LITERAL:
                words = [self.bare[c] for c in self.codes[some.start[k] : some.end[k]].tolist()]
                out.append(f"{TYPES[some.kind[k]]}={(' ' if some.kind[k] == NAME else '').join(words)}")
        return out

    def places(self, way: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, at, word, inside) of each window: its number among the text's template words and
        among its words, and whether it begins inside a template word of several words."""
        if way == EXACT:
            owner = self.owner[starts]
            return owner, starts - self.offsets[owner], starts - self.offsets[owner], ~np.isin(starts, self.readings[PLAIN].start)
        some = self.readings[way]
        owner = some.owner[starts]
        return owner, starts - some.offsets[owner], some.start[starts] - self.offsets[owner], np.zeros(len(starts), bool)


class _Judged(NamedTuple):
    """What the corpus shows: words that are no names, words that carry no template, languages with
    capital nouns (as filters, which bounds them), and whether there are such languages."""

    no_names: HashFilter
    common: HashFilter
    noun_languages: HashFilter
    any_nouns: bool


def _item_windows(made: _Template, judged: _Judged, length: int, literals: int, rare: int, any_case: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(way, length, starts, hashes) of an item's windows: each reading's, the word by word
    ones of places without a template (of all places for any case), and the whole of short items."""
    for way in (PLAIN, NAMED):
        starts, hashes = made.windows(way, length, literals)
        ok = made.carried(way, starts, length, rare, judged.common)
        yield way, length, starts[ok], hashes[ok]
        if way == PLAIN:
            covered = made.readings[PLAIN].start[starts[ok]]
    starts, hashes = made.exact_windows(length)
    left = any_case | ~np.isin(starts, covered)
    yield EXACT, length, starts[left], hashes[left]
    for n in range(1, length):
        yield EXACT, n, *made.whole(n)


def _text_windows(made: _Template, judged: _Judged, length: int, literals: int, filled: HashFilter, lengths: list[int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(way, length, starts, hashes) of a document's windows that may meet an item's; word by
    word ones in the lengths that items need."""
    for way in (PLAIN, NAMED):
        starts, hashes = made.windows(way, length, literals)
        hit = filled(hashes)
        if way == NAMED:  # without names both readings are the same
            hit &= ~made.nouns[made.readings[way].owner[starts]]
        yield way, length, starts[hit], hashes[hit]
    for n in lengths:
        starts, hashes = made.exact_windows(n)
        hit = filled(hashes)
        yield EXACT, n, starts[hit], hashes[hit]


def _window_rows(windows, id_type: pa.DataType, judged: Broadcast[_Judged], length: int, *args):
    """Rows of windows; items (those without a lang column) also as texts of a language with capital nouns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = [a.value if isinstance(a, Broadcast) else a for a in args]
        names = ["h", "id", "sig", "way", "n", "at", "word", "inside", "line", "slots"]
        for batch in slices(batches, "text"):
            texts, nouns, items = batch.column("text"), None, "lang" not in batch.schema.names
            if not items:
                nouns = judged.value.noun_languages.of_texts([x or "" for x in batch.column("lang").to_pylist()])
            made = _Template(texts, judged.value, nouns)
            some = list(windows(made, judged.value, length, *given))
            if items and judged.value.any_nouns:
                plain = _Template(texts, judged.value, np.ones(len(texts), bool))
                starts, hashes = plain.windows(PLAIN, length, given[0])
                ok = plain.carried(PLAIN, starts, length, given[1], judged.value.common)
                yield from _rows(batch, plain, [(NUMBERED, length, starts[ok], hashes[ok])], id_type, names, length)
            yield from _rows(batch, made, some, id_type, names, length)

    return run


def _rows(batch: pa.RecordBatch, made: _Template, windows, id_type: pa.DataType, names: list[str], length: int) -> Iterator[pa.RecordBatch]:
    for way, n, starts, hashes in windows:
        read = PLAIN if way == NUMBERED else way
        owner, at, word, inside = made.places(read, starts)
        rows = pa.array(owner)
        number = lambda x: pa.array(np.full(len(starts), x, np.int32))  # noqa: B023, E731
        line = made.lines(starts, n) if n < length and len(starts) else np.ones(len(starts), bool)
        yield pa.RecordBatch.from_arrays(
            [pa.array(unsigned(hashes)), batch.column("id").take(rows).cast(id_type), batch.column("sig").take(rows), number(way), number(n), pa.array(at.astype(np.int64)), pa.array(word.astype(np.int64)), pa.array(inside), pa.array(line), pa.array([made.slots(read, s, n) for s in starts.tolist()], pa.list_(pa.string()))],
            names,
        )


def _evidence(edges: Broadcast[HashFilter], wanted: Broadcast[HashFilter]):
    """Rows (word, lang, docs, low, high, inside): for words that pass the filters the documents of a slice
    that hold them, in lower case, and with a capital inside a sentence; for each language, as word
    null, the words inside sentences with a capital (high) and all of them (inside)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            codes, said, offsets = coded_words(batch.column("text"))
            if not len(codes):
                continue
            bare = pc.utf8_trim(said, EDGES)
            bare = pc.if_else(pc.equal(bare, ""), said, bare)
            opening, known = pc.utf8_slice_codeunits(bare, 0, 1), {}
            lower = pc.utf8_lower(bare)
            number = np.full(len(said), -1)
            # few words have the edges of a wanted one; only those are hashed whole
            maybe = np.flatnonzero(edges.value(edge_hashes(lower)))
            few = lower.take(pa.array(maybe)).to_pylist()
            for k in np.flatnonzero(wanted.value.of_texts(few)).tolist():
                number[maybe[k]] = known.setdefault(few[k], len(known))
            capital, small = (f(opening).to_numpy(zero_copy_only=False) for f in (pc.utf8_is_upper, pc.utf8_is_lower))
            ends = pc.match_substring_regex(said, f"[.!?][{re.escape(EDGES)}]*$").to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            first = np.concatenate([[True], owner[1:] != owner[:-1]])
            inside = ~first & ~np.concatenate([[True], ends[codes][:-1]]) & (capital | small)[codes]
            high, width = inside & capital[codes], max(1, len(known))
            # for each known word of a document whether it stands there in lower case (1), and inside a sentence with a capital (2)
            coded = number[codes]
            some = np.flatnonzero(coded >= 0)
            flagged = np.sort((owner[some] * width + coded[some]) << 2 | small[codes[some]] | high[some].astype(np.int64) << 1)
            starts = np.flatnonzero(np.diff(flagged >> 2, prepend=-1))
            marks = np.bitwise_or.reduceat(flagged & 3, starts) if len(starts) else starts
            word = (flagged[starts] >> 2) % width
            counts = [np.bincount(word[f], minlength=width)[: len(known)] for f in (slice(None), marks & 1 > 0, marks & 2 > 0)]
            tongue = [x or "" for x in batch.column("lang").to_pylist()]
            spoken: dict[str, int] = {}
            of = np.array([spoken.setdefault(x, len(spoken)) for x in tongue])[owner]
            total = [np.bincount(of[f], minlength=len(spoken)) for f in (high, inside)]
            none, n, m = [0] * len(spoken), len(known), len(spoken)
            columns = [[*known, *[None] * m], [None] * n + list(spoken), [*counts[0], *none], [*counts[1], *none], [*counts[2], *total[0]], [*[0] * n, *total[1]]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k < 2 else pa.int64()) for k, c in enumerate(columns)], ["word", "lang", "docs", "low", "high", "inside"])

    return run


def judged_words(texts: DataFrame, items: DataFrame, use_languages: bool) -> Broadcast[_Judged]:
    """What documents (text, lang) and items (text) show of the items' words and of the languages."""
    spark = items.sparkSession

    def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = {(w.strip(EDGES) or w).lower() for w in words_of(batch.column("text"))[1]}
            found = pa.array(sorted(words), pa.string())
            yield pa.RecordBatch.from_arrays([found, pa.array(unsigned(edge_hashes(found)))], ["word", "edges"])

    asked = written(items.select("text").mapInArrow(vocabulary, "word string, edges bigint").distinct())
    edges, wanted = hash_filter_for_tasks(asked, F.col("edges"), 256), hash_filter_for_tasks(asked, F.xxhash64("word"), 256)
    both = texts.select("text", "lang").unionByName(items.select("text", F.lit(None).cast("string").alias("lang")))
    seen = both.mapInArrow(_evidence(edges, wanted), "word string, lang string, docs bigint, low bigint, high bigint, inside bigint")
    seen = written(seen.groupBy("word", "lang").agg(*[F.sum(c).alias(c) for c in ("docs", "low", "high", "inside")]))
    all_docs = texts.count()
    words = seen.where("word is not null")
    common = hash_filter(words.where(F.col("docs") > max(COMMON_DOCS, COMMON_SHARE * all_docs)), F.xxhash64("word"), 256)
    no_names = hash_filter(words.where((F.col("low") > 0) & (F.col("low") >= 2 * F.col("high"))), F.xxhash64("word"), 256)
    nouns = seen.where((F.col("inside") >= NOUN_WORDS) & (F.col("high") >= NOUN_SHARE * F.col("inside"))).where(F.col("lang") != "")
    nouns = nouns if use_languages else nouns.limit(0)
    return spark.sparkContext.broadcast(_Judged(no_names, common, hash_filter(nouns, F.xxhash64("lang"), 256), not nouns.isEmpty()))


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 8, min_literals: int = 4, min_windows: int = 6, max_conflicts: float = 0.2, any_case: bool = False, lang_col: str | None = None, min_rare: int = 2) -> DataFrame:
    """One row for each document and item that it holds: (id, sig, item_id, n_matched,
    n_windows, n_changed, verdict).

    n_matched of the item's n_windows windows occur in the document along consistent
    alignments, at least min_windows (13 words in a row make 6 windows of 8) or all of
    a shorter item's. Where opening words are read as names, fewer windows may have
    enough plain words: then all of those count, if they are half of the windows needed
    otherwise. An alignment is consistent if its placeholder values map one to one but
    for max_conflicts of the pairs, counted for either side. verdict is `verbatim` if all
    windows from the first to the last one matched occur with the same placeholder values
    in some reading or word by word (those that begin inside a placeholder aside),
    `reparameterised` otherwise, with n_changed values that differ. sig is the
    text's xxhash64. Template windows need min_literals plain words; an item's other
    windows match the same words only, whatever their case and edge punctuation, and
    count in n_windows. An item of fewer words than a window is one window, which
    matches word by word: as `verbatim` where it is all words of a line or of the text, else
    as a `mention`, which drop_contaminated doesn't count. Template windows also need
    min_rare different plain words that no more than COMMON_SHARE of the documents (or
    COMMON_DOCS) hold. Places of an item at which all windows, in any reading, are windows of
    more than MANY_ITEMS items, such as a common instruction, count for a document only if it
    matches enough of the item's other places, by whatever window, where the item has any.
    So items that differ in values only are all found by their template, however many they
    are. lang_col, where
    given, tells which documents are in a language with capital nouns. Names are told by their capitals, so a
    copy in lower case or capitals has other templates: any_case compares all windows of
    the items word by word too, so that a copy counts in any case. Null texts are empty;
    rows with a null item id match like others; repeated documents or items count once;
    other columns are ignored; empty tables give an empty result.
    """
    kind, item_kind = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    schema = lambda t: f"h bigint, id {t.simpleString()}, sig bigint, way int, n int, at bigint, word bigint, inside boolean, line boolean, slots array<string>"
    items = benchmark.select(benchmark[item_col].alias("id"), benchmark[item_text_col].alias("text"), F.xxhash64(benchmark[item_text_col]).alias("sig"))
    lang = F.coalesce(docs[lang_col].cast("string"), F.lit("")) if lang_col else F.lit("")
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("sig"), lang.alias("lang"))
    judged = judged_words(texts, items, lang_col is not None)
    known = items.mapInArrow(_window_rows(_item_windows, to_arrow_type(item_kind), judged, window, min_literals, min_rare, any_case), schema(item_kind)).distinct()
    exact = lambda way: F.when(F.col(way) == EXACT, F.col("n")).otherwise(0)  # noqa: E731 - the kinds of windows don't meet
    known = written(known.withColumn("exact", exact("way")))
    # windows whose hash isn't in the benchmark's filter needn't be shuffled
    filled = hash_filter_for_tasks(known.select("h").distinct(), F.col("h"), 1024)
    lengths = sorted(n for n, in known.where(F.col("way") == EXACT).select("n").distinct().collect())  # `window` of them at most
    found = texts.mapInArrow(_window_rows(_text_windows, to_arrow_type(kind), judged, window, min_literals, filled, lengths), schema(kind))
    found = written(found.withColumn("exact", exact("way")).drop("n"))
    # places of windows of many items only; an item that has no others is told by them
    holders = known.groupBy("h", "exact").agg(F.count_distinct("sig").alias("holders"))
    known = known.join(holders, ["h", "exact"]).withColumn("few", F.col("holders") <= MANY_ITEMS)
    any_few = lambda *keys: F.max("few").over(Window.partitionBy(*keys))  # noqa: E731 - an item's windows at most
    known = written(known.withColumn("rare", any_few("id", "sig", "word") | ~any_few("id", "sig")).drop("holders", "few"))
    of = lambda way: F.count_distinct(F.when(F.col("way") == way, F.col("word")))
    sizes = known.groupBy(F.col("id").alias("item"), F.col("sig").alias("item_sig")).agg(F.count_distinct("word").alias("n_windows"), F.count_distinct(F.when(F.col("rare"), F.col("word"))).alias("n_rare"), (F.max("n") < window).alias("short"), of(PLAIN).alias("all_plain"), of(NAMED).alias("all_named"), of(NUMBERED).alias("all_numbered"), F.collect_set(F.when(~F.col("inside"), F.col("word"))).alias("places"))
    other = known.select("h", "exact", "rare", F.col("way").alias("item_way"), F.col("id").alias("item"), F.col("sig").alias("item_sig"), F.col("at").alias("item_at"), F.col("word").alias("item_word"), F.col("slots").alias("item_slots"))
    met = found.join(other.where("rare"), ["h", "exact"])
    shared = other.where("not rare")
    if not shared.isEmpty():
        pairs = written(met.select("id", "sig", "item", "item_sig").distinct())
        hot = found.join(shared.select("h", "exact").distinct(), ["h", "exact"], "left_semi")
        more = null_safe(null_safe(hot, pairs, ["id", "sig"]), shared, ["h", "exact", "item", "item_sig"])
        met = met.unionByName(more)
    pair = F.arrays_zip(F.col("item_slots").alias("theirs"), F.col("slots").alias("ours"))
    met = met.withColumn("pairs", pair).withColumn("clean", F.when(F.col("item_slots") == F.col("slots"), F.col("item_word")))
    # each reading is judged by its own pairs, so that one's conflicts don't undo the other's windows
    lines = met.groupBy("id", "sig", "item", "item_sig", "item_way", "way", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.collect_set("item_word").alias("ats"), F.collect_set(F.when(F.col("rare"), F.col("item_word"))).alias("rares"), F.max("line").alias("line"), F.collect_set("clean").alias("clean"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    conflicts = lambda side: F.size("pairs") - F.size(F.array_distinct(F.transform("pairs", lambda x: x[side])))
    changed = F.transform(F.filter("pairs", lambda x: x["theirs"] != x["ours"]), lambda x: F.struct(x["theirs"], x["ours"]))
    lines = lines.withColumn("changed", changed).where(F.greatest(conflicts("theirs"), conflicts("ours")) <= max_conflicts * F.size("pairs"))
    all_of = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    reading = lambda way: F.size(all_of(F.when(F.col("item_way") == way, F.col("ats"))))
    pairs = lines.groupBy("id", "sig", "item", "item_sig").agg(all_of("ats").alias("ats"), F.size(all_of("rares")).alias("rares"), F.max("line").alias("line"), all_of("clean").alias("clean"), F.size(all_of("changed")).cast("long").alias("changed"), reading(PLAIN).alias("plain"), reading(NAMED).alias("named"), reading(NUMBERED).alias("numbered"))
    pairs = pairs.withColumn("n_matched", F.size("ats").cast("long"))
    enough = lambda some, of: F.col(some) >= F.least(F.col(of), F.lit(min_windows))
    by_plain = (F.col("all_plain") > 0) & enough("plain", "all_plain")
    by_names = (F.col("all_named") > 0) & enough("named", "all_named") & (2 * F.col("named") >= F.least(F.col("all_plain"), F.lit(min_windows)))
    by_numbers = (F.col("all_numbered") > 0) & enough("numbered", "all_numbered")
    judged = null_safe(pairs, sizes, ["item", "item_sig"]).where(enough("n_matched", "n_windows") | by_plain | by_names | by_numbers)
    # of the item's own places as many are needed as there can be, or a reading's share of them
    judged = judged.where((F.col("n_rare") == F.col("n_windows")) | enough("rares", "n_rare"))
    # a window that occurs unchanged in one reading, or word by word, isn't changed by another
    altered = F.size(F.array_except(F.filter("places", lambda p: p.between(F.array_min("ats"), F.array_max("ats"))), "clean")) > 0
    n_changed, verdict = F.when(altered, F.col("changed")).otherwise(0), F.when(F.col("short") & ~F.col("line"), "mention").when(altered, "reparameterised").otherwise("verbatim")
    return judged.select(F.col("id").alias(id_col), "sig", F.col("item").alias("item_id"), "n_matched", "n_windows", n_changed.alias("n_changed"), verdict.alias("verdict"))


def drop_contaminated(docs: DataFrame, found: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no benchmark item, mentions of short ones aside, with all their
    columns, whatever their names."""
    sig = unused("__sig", docs)
    bad = found.where("verdict <> 'mention'").select(id_col, F.col("sig").alias(sig)).distinct()
    return null_safe(docs.withColumn(sig, F.xxhash64(text_col)), bad, [id_col, sig], "left_anti").drop(sig)
