"""Benchmark decontamination: numbers, quantities and names become typed placeholders, one for each however many words it
has; windows of such templates are hash-joined with the benchmark's, and names must map one to one along an aligned
passage, and a number that comes again must be changed alike, with few exceptions.

Each text has two templates: as it is written, where a capital marks a name, and without regard to case, where only known
names do, so that a copy whose capitals changed is found too. A window of almost nothing but placeholders is joined by
its values as well: it says something only with these, or beside other windows of its alignment.
"""

from __future__ import annotations

import functools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._words import LETTERS, Words, mix, slices, windows, words
from ._work import HOT, cut, sole, table

# Words that are numbers, units (after a number) and first names.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half "
    "third quarter dozen twice"
).split()
UNITS = (
    "mm cm m km in inch inches ft foot feet yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound "
    "pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute "
    "minutes h hour hours day days week weeks month months year years dollar dollars cent cents euro euros usd eur "
    "percent degree degrees celsius fahrenheit mph kmh watt watts volt volts joule joules meter meters metre metres"
).split()
SCALES = ["hundred", "thousand", "million", "billion"]
NAMES = (
    "alice bob carol dave eve tom mary john james anna emma liam noah olivia ava mia lucas ethan sarah david daniel "
    "maria peter paul jack kate lucy sam ben max leo mark lisa julia laura kevin brian jason susan karen linda robert "
    "michael william"
).split()

_NUM, _QUANTITY, _NAME = (np.uint64(x) for x in (0x4E554D5F5F5F5F5F, 0x554E49545F5F5F5F, 0x4E414D455F5F5F5F))
_TINY = np.isin(np.arange(256), [*b".!?:;\n\"'([{|*#"])  # what a sentence may start after, besides spaces
_JOINED = re.compile(rb"[0-9]+([A-Za-z]+)")


@dataclass(frozen=True)
class Vocabulary:
    """Words that are numbers, units (right after a number) and first names, in lower case."""

    numbers: tuple[str, ...] = tuple(NUMBER_WORDS)
    units: tuple[str, ...] = tuple(UNITS)
    names: tuple[str, ...] = tuple(NAMES)


@functools.lru_cache(maxsize=64)
def _known(names: tuple[str, ...]) -> np.ndarray:
    return np.sort(words([" ".join(names)], LETTERS).hash)


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


@dataclass
class Parts:
    """A template's places. hash: the word's own or its type's; doc: its text's number; begin, end: the words that it stands
    for; slot, name: whether it is a placeholder, and one for a name; value: hash of the words in it."""

    hash: np.ndarray
    doc: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    slot: np.ndarray
    name: np.ndarray
    value: np.ndarray


def template(w: Words, cased: bool = True, known: Vocabulary = Vocabulary()) -> Parts:
    """The words with one placeholder for each number (1,250; twenty-five), quantity (5 km; 5km; $5; 5 %) and run of name words (Mary Ann).

    A number starts with a digit or is a number word, or is the "and" of "one hundred and five"; a quantity is a number
    with a unit; a name is a known first name or, if cased, a word with one capital at its head that starts no sentence
    (a known name only with a capital then)."""
    n = len(w.hash)
    if not n:
        return Parts(w.hash, w.doc, *[np.empty(0, np.int64)] * 2, *[np.empty(0, bool)] * 2, w.hash)
    first = w.raw[w.start]
    digit = (first >= 48) & (first <= 57)
    number = digit | _among(w.hash, _known(known.numbers))
    link = np.flatnonzero(w.hash[1:-1] == _known(("and",))[0]) + 1
    number[link[number[link + 1] & _among(w.hash[link - 1], _known(tuple(SCALES))) & (w.doc[link - 1] == w.doc[link + 1])]] = True
    after = np.zeros(n, bool)
    after[1:] = number[:-1] & (w.doc[1:] == w.doc[:-1])
    unit = after & ~number & _among(w.hash, _known(known.units))
    one, two = w.raw[np.maximum(w.start - 1, 0)], w.raw[np.maximum(w.start - 2, 0)]
    next_, third = w.raw[np.minimum(w.end, len(w.raw) - 1)], w.raw[np.minimum(w.end + 1, len(w.raw) - 1)]
    signed = number & (((one == 36) & (w.start > 0)) | (next_ == 37) | ((next_ == 32) & (third == 37)))
    for k in np.flatnonzero(digit & (w.raw[w.end - 1] > 57)):
        if (m := _JOINED.fullmatch(w.raw[w.start[k] : w.end[k]].tobytes())) and m[1].decode().lower() in known.units:
            signed[k] = True
    name = _among(w.hash, _known(known.names))
    if cased:
        capital = (first >= 65) & (first <= 90)
        second = w.raw[np.minimum(w.start + 1, len(w.raw) - 1)]
        title = capital & (second >= 97) & (second <= 122) & (w.end - w.start > 1)
        opens = (w.start == 0) | _TINY[one] | ((one == 32) & ((w.start < 2) | _TINY[two] | (two == 32)))
        name = (title & ~opens) | (capital & name)
    name &= ~number & ~unit
    goes_on = np.zeros(n, bool)
    goes_on[1:] = (((number | unit)[1:] & number[:-1]) | (name[1:] & name[:-1])) & (w.doc[1:] == w.doc[:-1])
    begin = np.flatnonzero(~goes_on)
    within = np.arange(n) - np.repeat(begin, np.diff(begin, append=n))
    with np.errstate(over="ignore"):
        value = np.add.reduceat(mix(w.hash + within.astype(np.uint64)), begin)
    quantity = np.logical_or.reduceat(unit | signed, begin)
    form = np.where(name[begin], _NAME, np.where(quantity, _QUANTITY, np.where(number[begin], _NUM, w.hash[begin])))
    return Parts(form, w.doc[begin], begin, np.append(begin[1:], n), number[begin] | name[begin], name[begin], value)


def _before(x: np.ndarray) -> np.ndarray:
    """The place of the last equal value before each; -1 where there is none."""
    order = np.argsort(x, kind="stable")
    before = np.full(len(x), -1)
    same = x[order[1:]] == x[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    return before


def _windows(
    texts: list[str], sizes: tuple[tuple[int, ...], tuple[int, ...]], least_words: int, known: Vocabulary,
) -> Iterator[tuple[Parts, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """Parts, window hashes, hashes of the windows' values, places, whether they hold least_words different words, size and kind (0 as
    written, 1 without case) of the texts; sizes by kind."""
    w = words(texts, LETTERS)
    for kind in (0, 1):
        parts = template(w, kind == 0, known)
        before = _before(parts.hash)
        for size in sizes[kind]:
            hashed, at = windows(parts.hash, parts.doc, size)
            own, _ = windows(parts.value, parts.doc, size)
            filled = sum((~parts.slot[at + k] & (before[at + k] < at) for k in range(size)), np.zeros(len(at), int))
            yield parts, mix(hashed ^ np.uint64(2 * size + kind)), own, at, filled >= min(least_words, size), size, kind


FOUND = "id long, version long, place int, begin int, end int, window long, kind int, enough boolean, own long, names array<long>, numbers array<long>, number_at array<int>"


def _rows(
    ids: pa.RecordBatch, texts: pa.Array | list[str | None], sizes: tuple[tuple[int, ...], tuple[int, ...]],
    least_words: int, known: Vocabulary, wanted: np.ndarray | None,
) -> Iterator[pa.RecordBatch]:
    """Windows as rows of FOUND (ids: id and version of the texts; begin, end: the words that they cover); with wanted (a
    bit map, see bits()) only those in it. A window of few words has two rows: by its hash, and, as one of enough words,
    by that of its values."""
    for base, run in slices(texts):
        for p, hashed, own, at, enough, size, kind in _windows(run, sizes, least_words, known):
            few = np.flatnonzero(~enough)
            hashed = np.concatenate([hashed, mix(own[few] + np.uint64(2 * size + kind))])
            own, at, enough = np.concatenate([own, own[few]]), np.concatenate([at, at[few]]), np.concatenate([enough, np.ones(len(few), bool)])
            if wanted is not None:
                near = np.flatnonzero((wanted[(hashed >> np.uint64(44)).astype(np.int64)] >> ((hashed >> np.uint64(38)) & np.uint64(63))) & np.uint64(1))
                hashed, own, at, enough = hashed[near], own[near], at[near], enough[near]
            if not len(at):
                continue
            doc = p.doc[at]
            first = np.searchsorted(p.doc, doc)
            names = [p.value[k : k + size][p.name[k : k + size]].view(np.int64) for k in at]
            number_at = [np.flatnonzero(p.slot[k : k + size] & ~p.name[k : k + size]) for k in at]
            numbers = [p.value[k + n].view(np.int64) for k, n in zip(at, number_at, strict=True)]
            of = ids.take(pa.array(base + doc))
            yield pa.record_batch({
                "id": of.column(0), "version": of.column(1), "place": pa.array((at - first).astype(np.int32)), "begin": pa.array((p.begin[at] - p.begin[first]).astype(np.int32)),
                "end": pa.array((p.end[at + size - 1] - p.begin[first]).astype(np.int32)), "window": pa.array(hashed.view(np.int64)), "kind": pa.array(np.full(len(at), kind, np.int32)),
                "enough": pa.array(enough), "own": pa.array(own.view(np.int64)), "names": _lists(names), "numbers": _lists(numbers), "number_at": _lists([n.astype(np.int32) for n in number_at]),
            })


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)), pa.array(np.concatenate(rows)))


def bits(windows: DataFrame) -> np.ndarray:
    """A map of 2**26 bits (8 MB, whatever the number of windows): those of the windows' leading bits are set."""
    word, bit = F.shiftrightunsigned("window", 44), F.shiftrightunsigned("window", 38).bitwiseAND(63).cast("int")
    rows = windows.select(word.alias("word"), F.expr("1L").alias("one"), bit.alias("bit")).select("word", F.expr("shiftleft(one, bit)").alias("bit"))
    found = rows.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    made = np.zeros(1 << 20, np.uint64)
    made[found.column("word").to_numpy()] = found.column("bit").to_numpy().astype(np.int64).view(np.uint64)
    return made


def _runs(windows: list[dict]) -> Iterator[list[dict]]:
    """The longest runs of an alignment's windows along which names map one to one; windows are in order of their place."""
    there: dict[int, Counter] = defaultdict(Counter)
    back: dict[int, Counter] = defaultdict(Counter)
    first = clashes = 0
    for k, w in enumerate(windows):
        for a, b in w["names"]:
            for x, y, side in ((a, b, there), (b, a, back)):
                clashes += y not in side[x] and len(side[x]) > 0
                side[x][y] += 1
        if clashes and k > first:
            yield windows[first:k]
        while clashes:
            for a, b in windows[first]["names"]:
                for x, y, side in ((a, b, there), (b, a, back)):
                    side[x][y] -= 1
                    if not side[x][y]:
                        del side[x][y]
                        clashes -= len(side[x]) > 0
            first += 1
    if first < len(windows):
        yield windows[first:]


def _steady(run: list[dict], exceptions: float) -> bool:
    """Whether numbers keep their places: each of the item's stands for one of the document's wherever it comes again, but for
    one place, or that share of the run's number places."""
    there: dict[int, Counter] = defaultdict(Counter)
    places = {w["place"] + at: (a, b) for w in run for at, a, b in w["numbers"]}
    for a, b in places.values():
        there[a][b] += 1
    return len(places) - sum(max(c.values()) for c in there.values()) <= max(1, exceptions * len(places))


def _passage(windows: list[dict], total: int, min_words: int, min_share: float, exceptions: float) -> tuple[int, float] | None:
    """Most words that windows cover without a gap, and share of the item's windows, of the runs that are passages.

    Where names clash, a run must hold min_share of the item's windows; its numbers must be steady."""
    windows = sorted(windows, key=lambda w: w["place"])
    best = None
    for run in _runs(windows):
        if not _steady(run, exceptions):
            continue
        longest = begin = end = 0
        for w in run:
            if w["begin"] > end or w is run[0]:
                begin = w["begin"]
            end = max(end, w["end"])
            longest = max(longest, end - begin)
        share = len({w["place"] for w in run}) / total
        if share >= min_share or (longest >= min_words and len(run) == len(windows)):
            best = (longest, share) if best is None else (max(best[0], longest), max(best[1], share))
    return best


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", window: int = 8, min_words: int = 13,
    min_share: float = 0.5, least_words: int = 3, known: Vocabulary = Vocabulary(), exceptions: float = 0.25,
) -> DataFrame:
    """Pairs of a document and a benchmark item of which it holds a passage: id, item_id, words, share, exact.

    A passage is a run of touching windows (`window` words or placeholders each, shorter items whole) on one alignment that
    covers min_words of the item's words, or windows of an alignment that are min_share of the item's. Windows of fewer
    than least_words different words that are no placeholders count only with equal values or on an alignment that holds another
    window. Along a passage each name of the item stands for one of the document's and the other way round; where names
    clash, the longest runs without a clash are passages if they hold min_share of the item's windows. A number or quantity
    that the item repeats must stand for one and the same of the document's, but for one place or `exceptions` of the
    passage's number places; two of the item's may become one, as small numbers of a changed question often collide. Windows with
    equal values are a passage whatever stands between them. words, share: of the best passage; exact: one is found with
    all values unchanged (else only re-parameterised).

    Items or documents whose id or text is null or empty match nothing. Rows that repeat an id with other texts are
    compared one by one and have a row together. An empty table gives no pairs. Each task holds a map of 8 MB of the
    benchmark's windows and passes on only windows in it. A window that many documents hold is joined in parts.
    """
    spark = docs.sparkSession
    named = lambda df, i, t: sole(df, {"id": i, "text": t}).where("id is not null").select(
        F.col("id").cast("long").alias("id"), F.xxhash64("text").alias("version"), "text",
    )
    items = named(benchmark, item_id_col, item_text_col)

    def lengths(text: str | None) -> tuple[int, int]:
        """Of a text's two templates."""
        w = words([text or ""], LETTERS)
        return len(template(w, True, known).hash), len(template(w, False, known).hash)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [lengths(t) for t in b.column(0).to_pylist()]
            yield pa.record_batch({"kind": pa.array([k for _ in n for k in (0, 1)], pa.int32()), "n": pa.array([x for both in n for x in both], pa.int64())})

    short = items.select("text").mapInArrow(count, "kind int, n long").where((F.col("n") > 0) & (F.col("n") < window)).distinct().collect()
    sizes = tuple((window, *sorted(r["n"] for r in short if r["kind"] == kind)) for kind in (0, 1))

    def own_size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """An item's windows: of `window` places, or, if it is shorter, of its own length."""
        for b in batches:
            for k, t in enumerate(b.column("text").to_pylist()):
                yield from _rows(
                    b.slice(k, 1).select(["id", "version"]), [t],
                    tuple((min(window, n),) if n else () for n in lengths(t)), least_words, known, None,
                )

    renamed = {"id": "item_id", "version": "item_version", "place": "item_place", "own": "item_own", "names": "item_names", "numbers": "item_numbers"}
    bench = cut(items.mapInArrow(own_size, FOUND).withColumnsRenamed(renamed), "benchmark-windows")
    shared = spark.sparkContext.broadcast(bits(bench))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _rows(b.select(["id", "version"]), b.column("text"), sizes, least_words, known, shared.value)

    found = cut(named(docs, id_col, text_col).mapInArrow(run, FOUND).drop("begin", "end", "number_at"), "found-windows")
    often = found.count()
    hot = found.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * HOT > often)
    hot = F.broadcast(hot.select("window", F.ceil(F.col("n") * HOT / often).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    asked = found.where("enough").join(hot, "window", "left").withColumn("part", F.pmod(F.xxhash64("id", "place"), parts).cast("int"))
    strong = bench.where("enough").join(hot, "window", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    place = ["id", "version", "item_id", "item_version", "kind", "shift"]
    columns = [*place, "item_place", "begin", "end", "item_own", "own", "item_names", "names", "number_at", "item_numbers", "numbers"]
    aligned = asked.drop("enough", "parts").join(strong.drop("enough", "parts"), ["window", "kind", "part"]).withColumn("shift", F.col("place") - F.col("item_place")).select(*columns)
    # by the places that an alignment gives them, never by their hash alone, which many documents may hold
    due = aligned.select(*place).distinct().join(
        bench.where("not enough").drop("enough"), ["item_id", "item_version", "kind"],
    ).withColumn("place", F.col("item_place") + F.col("shift"))
    beside = found.where("not enough").drop("enough").join(due, ["id", "version", "kind", "place", "window"]).select(*columns)
    names = F.transform(F.arrays_zip("item_names", "names"), lambda p: F.array(p["item_names"], p["names"]))
    numbers = F.transform(F.arrays_zip("number_at", "item_numbers", "numbers"), lambda p: F.array(p["number_at"].cast("long"), p["item_numbers"], p["numbers"]))
    spot = F.struct(F.col("item_place").alias("place"), "begin", "end", (F.col("item_own") == F.col("own")).alias("exact"), names.alias("names"), numbers.alias("numbers"))
    windows_of = aligned.unionByName(beside).groupBy(*place).agg(F.collect_set(spot).alias("windows"))
    totals = bench.groupBy("item_id", "item_version", "kind").agg(F.countDistinct("item_place").alias("total"))

    @F.arrow_udf("struct<words:int,share:double,exact:boolean>")
    def passage(windows: pa.Array, total: pa.Array) -> pa.Array:
        out = []
        for w, n in zip(windows.to_pylist(), total.to_pylist(), strict=True):
            exact = _passage([x for x in w if x["exact"]], n, min_words, min_share, exceptions)
            best = _passage(w, n, min_words, min_share, exceptions) or exact
            out.append(best and {"words": best[0], "share": best[1], "exact": exact is not None})
        return pa.array(out, pa.struct([("words", pa.int32()), ("share", pa.float64()), ("exact", pa.bool_())]))

    # a filter on what a deterministic function gives would call it once more, in a second worker
    found_at = passage.asNondeterministic()("windows", "total").alias("best")
    passages = windows_of.join(totals, ["item_id", "item_version", "kind"]).select("id", "item_id", found_at).where("best is not null")
    best = [
        F.max("best.words").alias("words"), F.max("best.share").alias("share"),
        F.max(F.col("best.exact").cast("int")).cast("boolean").alias("exact"),
    ]
    return passages.groupBy("id", "item_id").agg(*best).withColumnRenamed("id", id_col)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
