"""Benchmark decontamination by template windows with slot consistency."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, chunks, mix, row_keys, signed, staged, without_rows

#: Words taken as units of measure.
UNITS = frozenset(
    """mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t ton tons tonne tonnes oz lb lbs pound pounds ml cl l litre litres liter liters gallon gallons
    s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent degree degrees dollar dollars euro euros cent cents
    usd eur gbp mph kmh kph watt watts volt volts amp amps joule joules newton newtons hz khz mhz ghz kb mb gb tb""".split()
)
_TOKEN = re.compile(r"\n|[.!?]+(?=\s|$)|\d+(?:[.,]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)*")
WORD, NAME, NUMBER, UNIT, STOP = range(5)
MAX_ITEMS_WINDOWS = 1 << 20
#: Fixed value: bytes of the bitmaps that Spark aggregates.
BITMAP_BYTES = 4096
#: So many of an item's words in a row, word for word, are a leak whatever its length; so many words may be put
#: in or left out in one place of a copy.
VERBATIM, NEAR = 13, 16
#: Fixed value: the share of a copy's windows that one mapping of the slots must leave in place.
CONSISTENT = 0.9


class Tokens(dict):
    """token -> 64-bit hash whose lowest three bits are its kind; remembered for the tokens met lately.
    Capitalised words are NAME here; template() turns those that begin a sentence into words."""

    def __missing__(self, token: str) -> int:
        if len(self) >= 1 << 19:
            self.clear()
        low = token.lower()
        if token[0].isdigit():
            kind = NUMBER
        elif token[0] in "\n.!?":
            kind = STOP
        elif low in UNITS:
            kind = UNIT
        elif len(token) > 1 and token[0].isupper() and token[1:].islower():
            kind = NAME
        else:
            kind = WORD
        self[token] = value = xxhash.xxh3_64_intdigest(low.encode()) >> 3 << 3 | kind
        return value


def template(text: str, cache: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(canonical, own): for each word or number its hash as a template token, and its own hash.

    Numbers, names (capitalised words inside a sentence) and units that follow a number become typed
    placeholders; other words are lower-cased; punctuation plays no part, and case only in what is a name (see plain()).
    """
    raw = np.fromiter(map(cache.__getitem__, _TOKEN.findall(text)), U64)
    if not len(raw):
        return raw, raw
    kind = raw & U64(7)
    before = np.concatenate([[STOP], kind[:-1]])
    own = raw >> U64(3)
    place = (kind == NUMBER) | ((kind == NAME) & (before != STOP)) | ((kind == UNIT) & (before == NUMBER))
    words = kind != STOP
    return np.where(place, kind, own | U64(1 << 63))[words], own[words]


def plain(canonical: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Tokens with numbers as the only placeholders: the same however names are written and lines are broken."""
    return np.where(canonical == NUMBER, canonical, own | U64(1 << 63))


def window_hashes(canonical: np.ndarray, width: int) -> np.ndarray:
    n = len(canonical) - width + 1
    if n < 1:
        return np.empty(0, U64)
    own = mix(canonical)
    out = np.full(n, U64(width))
    for j in range(width):
        out *= U64(0x9E3779B97F4A7C15)
        out += own[j : j + n]
    return mix(out)


def windows_of(text: str, width: int, cache: Tokens) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """An item's window length, own hashes, slots, numbers, and its windows' hashes and places, as templates and, where they
    differ, as plain() words.  None without words."""
    canonical, own = template(text, cache)
    w = min(width, len(canonical))
    if not w:
        return None
    found, places = window_hashes(canonical, w), np.arange(len(canonical) - w + 1)
    bare = window_hashes(plain(canonical, own), w)
    other = bare != found
    return w, own, canonical < U64(8), canonical == NUMBER, np.concatenate([found, bare[other]]), np.concatenate([places, places[other]])


def in_filter(canonical: np.ndarray, own: np.ndarray, w: int, table: np.ndarray, shift: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of a text's windows of ``w`` words, in both forms, whose hash prefix is in ``table``."""
    grams = window_hashes(canonical, w)
    hit = np.flatnonzero(table[(grams >> shift).view(np.int64)])
    keys = grams[hit]
    bare = plain(canonical, own)
    if len(grams) and (bare != canonical).any():
        again = window_hashes(bare, w)
        more = np.flatnonzero(table[(again >> shift).view(np.int64)])
        more = more[again[more] != grams[more]]
        hit, keys = np.concatenate([hit, more]), np.concatenate([keys, again[more]])
    return hit, keys


def judge(at: np.ndarray, where: np.ndarray, theirs: np.ndarray, mine: np.ndarray, slots: np.ndarray, numbers: np.ndarray, n_windows: int, least: float) -> tuple[int, int, bool, int, int] | None:
    """(windows matched, slots changed, exact, first, last word of the document) of the best copy of an item, of which at
    least ``least`` of the windows, or VERBATIM words in a row, are found in consistent slots; None without one.

    Row by row a window ``at`` of the item and an equal one ``where`` in the document, with both sides' words, the item's slots
    and which of these are numbers; places repeat where windows agree in both forms.  Each pair of windows places the item at one
    offset.  Offsets that follow each other within NEAR words are one copy, with words put in or left out: their
    windows count together.
    """
    w = theirs.shape[1]
    pairs, rows = np.unique(np.stack([where - at, at], 1), axis=0, return_index=True)
    cuts = np.flatnonzero(np.diff(pairs[:, 0]) > NEAR) + 1
    best = None
    for part in np.split(rows, cuts):
        if len(part) >= min(least * n_windows, max(1, VERBATIM - w + 1)):
            found = judge_copy(at[part], where[part], theirs[part], mine[part], slots[part], numbers[part], n_windows, least)
            if found and (best is None or (found[0], -found[1], -found[3]) > (best[0], -best[1], -best[3])):
                best = found
    return best


def judge_copy(at: np.ndarray, where: np.ndarray, theirs: np.ndarray, mine: np.ndarray, slots: np.ndarray, numbers: np.ndarray, n_windows: int, least: float) -> tuple[int, int, bool, int, int] | None:
    """judge() for the windows of one copy, in order of offset and place.

    The words under the item's slots must map one to one to the item's: the same number, name or unit of the item always to the
    same of the document, and different ones to different ones.  Windows that contradict the mapping of most slots don't
    count, nor do changed ones where more than a tenth contradict it; windows whose own words are equal always count.
    """
    w = theirs.shape[1]
    same = (theirs == mine).all(1)
    # Where all but the numbers is equal, names and units stand for themselves.
    slots = np.where(((theirs == mine) | numbers).all(1)[:, None], numbers, slots)
    pairs, of, counts = np.unique(np.stack([theirs[slots], mine[slots]], 1), axis=0, return_inverse=True, return_counts=True)
    one_to_one = len(pairs) == len(np.unique(pairs[:, 0])) == len(np.unique(pairs[:, 1]))
    good = np.ones(len(pairs), bool)
    if not one_to_one:
        # The mapping of most slots; equal words first where as many speak for another.
        left, right = set(), set()
        for k in np.lexsort((pairs[:, 0] != pairs[:, 1], -counts)):
            good[k] = pairs[k, 0] not in left and pairs[k, 1] not in right
            if good[k]:
                left.add(pairs[k, 0])
                right.add(pairs[k, 1])
    fits = np.ones(slots.shape, bool)
    fits[slots] = good[of.ravel()]
    fits = fits.all(1)
    everything = len(np.unique(at))
    # Changed values that contradict each other in more than a few windows aren't a copy; equal words always are.
    if len(np.unique(at[fits])) < CONSISTENT * everything:
        fits = same
    counted = fits | same
    at, where, same, slots, theirs, mine = at[counted], where[counted], same[counted], slots[counted], theirs[counted], mine[counted]
    places = len(np.unique(at))
    if places < least * n_windows and longest_run(at[same], where[same]) + w - 1 < VERBATIM:
        return None
    pairs = np.unique(np.stack([theirs[slots], mine[slots]], 1), axis=0)
    changed = int((pairs[:, 0] != pairs[:, 1]).sum())
    return places, changed, changed == 0 and places == everything, int(where.min()), int(where.max() + w - 1)


class Items:
    """A few items in memory: what find_leaks() finds, for one text and without Spark."""

    def __init__(self, items: list[tuple[int, str]], width: int) -> None:
        cache = Tokens()
        self.items = [(item_id, windows_of(text or "", width, cache)) for item_id, text in items]

    def find(self, canonical: np.ndarray, own: np.ndarray, least: float) -> list[tuple[int, int, int, int, bool, int, int]]:
        """(item_id, windows matched, windows, slots changed, exact, first, last word) of each item that leaks into a text."""
        out, all_pass = [], np.ones(2, bool)
        for item_id, found in self.items:
            if found is None:
                continue
            w, theirs, slots, numbers, hashes, places = found
            hit, keys = in_filter(canonical, own, w, all_pass, U64(63))
            match = np.argwhere(keys[:, None] == hashes[None, :])
            if len(match):
                where, at, span = hit[match[:, 0]], places[match[:, 1]], np.arange(w)
                n = len(theirs) - w + 1
                verdict = judge(at, where, theirs[at[:, None] + span], own[where[:, None] + span], slots[at[:, None] + span], numbers[at[:, None] + span], n, least)
                if verdict:
                    out.append((item_id, verdict[0], n, *verdict[1:]))
        return out


def longest_run(at: np.ndarray, where: np.ndarray) -> int:
    """The most windows in a row, of windows in order of offset and place."""
    if not len(at):
        return 0
    ends = np.flatnonzero(np.append((np.diff(at) != 1) | (np.diff(where) != 1), True))
    return int(np.diff(ends, prepend=-1).max())


def _bits(flags: np.ndarray) -> np.ndarray:
    return (flags.astype(np.int64) << np.arange(flags.shape[1])).sum(1)


def _flags(bits: np.ndarray, w: int) -> np.ndarray:
    return (bits[:, None] >> np.arange(w) & 1).astype(bool)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    """Matrices of words, one below the other, as lists of 64-bit numbers."""
    lengths = np.concatenate([np.full(len(m), m.shape[1]) for m in rows])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), signed(np.concatenate([m.ravel() for m in rows])))


def _item_windows(width: int):
    """Items -> one row a window and form."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Tokens()
        for _, (rows, ids, texts) in chunks(batches):
            out = []
            for row, item_id, text in zip(rows, ids, texts, strict=True):
                found = windows_of(text, width, cache)
                if found:
                    w, own, slots, numbers, hashes, places = found
                    at = places[:, None] + np.arange(w)
                    n = len(hashes)
                    out.append((hashes.view(np.int64), np.full(n, row), [item_id] * n, places, np.full(n, w), np.full(n, len(own) - w + 1), own[at], _bits(slots[at]), _bits(numbers[at])))
            if out:
                h, row, ids_, at, w, n, own, slots, numbers = zip(*out, strict=True)
                flat = [pa.array(np.concatenate(x), pa.int64()) for x in (h, row, at, w, n)]
                kinds = pa.array([i for part in ids_ for i in part], pa.int64())
                masks = [pa.array(np.concatenate(x), pa.int64()) for x in (slots, numbers)]
                yield pa.RecordBatch.from_arrays([*flat[:2], kinds, *flat[2:], _lists(list(own)), *masks], ["hash", "item", "item_id", "at", "w", "n_windows", "theirs", "slots", "numbers"])

    return run


def _candidates(sizes: list[int], bits: int, packed: bytes):
    """Documents -> one row a window that the filter lets through, in either form."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, shift = Tokens(), U64(64 - bits)
        table = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little").view(bool)
        for part, (row, _, k2, texts) in chunks(batches):
            of, hits, keys, own_words = [], [], [], []
            for i, text in enumerate(texts):
                if text:
                    canonical, own = template(text, cache)
                    for w in sizes:
                        hit, key = in_filter(canonical, own, w, table, shift)
                        if len(hit):
                            of.append(np.full(len(hit), i))
                            hits.append(hit)
                            keys.append(key)
                            own_words.append(own[hit[:, None] + np.arange(w)])
            if of:
                at = np.concatenate(of)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at)), part.column(2).take(pa.array(at)), signed(np.concatenate(keys)), pa.array(np.concatenate(hits)), _lists(own_words)],
                    ["row", "doc_id", "k2", "hash", "place", "mine"],
                )

    return run


def _judged(least: float):
    """The windows that a document's row and an item share -> a leak, or nothing."""

    def run(group: pa.Table) -> pa.Table:
        w, n = group["w"][0].as_py(), group["n_windows"][0].as_py()
        at, where, slots, numbers = (group[c].to_numpy() for c in ("at", "place", "slots", "numbers"))
        theirs, mine = (group[c].combine_chunks().flatten().to_numpy().reshape(-1, w) for c in ("theirs", "mine"))
        found = judge(at, where, theirs, mine, _flags(slots, w), _flags(numbers, w), n, least)
        rows = [(group["doc_id"][0].as_py(), group["item_id"][0].as_py(), found[0], n, *found[1:], group["k2"][0].as_py())] if found else []
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_LEAKS), _LEAKS, strict=True)], schema=_LEAKS)

    return run


_LEAKS = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_matched", pa.int64()), ("n_windows", pa.int64()), ("n_changed", pa.int64()), ("exact", pa.bool_()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("k2", pa.int64())]
)
LEAKS = "doc_id long, item_id long, n_matched long, n_windows long, n_changed long, exact boolean, first_word long, last_word long, k2 long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 8, least: float = 0.25, block_windows: int = MAX_ITEMS_WINDOWS) -> DataFrame:
    """Leaks of ``benchmark`` (item_id, text) in ``docs`` (doc_id, text): doc_id, item_id, n_matched and n_windows (template
    windows of ``width`` words found, and all of the item), n_changed (slots with another value), exact,
    first_word, last_word.  An item leaks where at least ``least`` of its windows are found close together, in consistent
    slots, or VERBATIM of its words in a row.

    Both sides' template windows are joined by hash, and what a document and an item share is judged as one group.  The items'
    windows are a staged table.  Documents are read once, whole; a filter of hash prefixes, made for at most ``block_windows``
    windows and of a fixed size beyond (4 MB), turns away windows that no item has, so only likely ones are
    shuffled.  A benchmark too large for its filter lets more windows through and loses none.

    Items of fewer words than ``width`` are one window.  Null or empty texts on either side leak nothing.  Repeated rows
    give repeated leaks; repeated items are searched one by one.  Null ids stay null.  Empty tables: no rows.
    """
    return leaks_by_row(docs, benchmark, width, least, block_windows).drop("k2")


def leaks_by_row(docs: DataFrame, benchmark: DataFrame, width: int = 8, least: float = 0.25, block_windows: int = MAX_ITEMS_WINDOWS) -> DataFrame:
    """What find_leaks() returns, and the row's second key (see row_keys)."""
    if not 0 < width < 63:
        raise ValueError(f"width must be 1 to 62, not {width}")
    spark = docs.sparkSession
    items = benchmark.where("text IS NOT NULL").select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text")
    kinds = "hash long, item long, item_id long, at long, w long, n_windows long, theirs array<long>, slots long, numbers long"
    items = staged(items.mapInArrow(_item_windows(width), kinds), "items")
    lengths = items.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()
    if not lengths:
        return spark.createDataFrame([], LEAKS)
    bits = max(10, (16 * min(sum(r["n"] for r in lengths), block_windows)).bit_length())
    own = F.col("doc_id").cast("long")
    texts = docs.select(F.monotonically_increasing_id().alias("row"), own.alias("doc_id"), row_keys(own, F.col("text"))[1], "text")
    found = texts.mapInArrow(_candidates(sorted(r["w"] for r in lengths), bits, prefix_filter(items, bits)), "row long, doc_id long, k2 long, hash long, place long, mine array<long>")
    # Windows in common, whatever their places: fewer than any copy has can't be one.
    enough = F.count(F.lit(1)).over(Window.partitionBy("row", "item")) >= F.least(F.col("n_windows") * least, F.greatest(F.lit(1), VERBATIM - F.col("w") + 1))
    shared = found.join(items, "hash").drop("hash").withColumn("enough", enough).where("enough").drop("enough")
    return shared.groupBy("row", "item").applyInArrow(_judged(least), LEAKS)


def prefix_filter(items: DataFrame, bits: int) -> bytes:
    """A bit for each ``bits``-bit prefix of the hashes: 2 ** bits of them, whatever the number of hashes, from partial bitmaps."""
    place = F.shiftrightunsigned("hash", 64 - bits) + 1
    parts = items.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap")).collect()
    out = np.zeros(max(1, (1 << bits) // (8 * BITMAP_BYTES)) * BITMAP_BYTES, np.uint8)
    for r in parts:
        out[(r["part"] - 1) * BITMAP_BYTES : r["part"] * BITMAP_BYTES] = np.frombuffer(r["bitmap"], np.uint8)
    return out.tobytes()


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which nothing leaks, all columns kept; rows that share an id, or have none, go one by one."""
    return without_rows(docs, leaks_by_row(docs, benchmark, **options))
