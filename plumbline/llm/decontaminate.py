"""Benchmark decontamination by template canonicalisation.

Numbers, names and units of a text become typed placeholders, so that a question whose slots were filled anew has the
same template. Template windows of five words are hash-joined with those of the benchmark; where enough of an item's
windows lie together in a document, the values of its slots are checked: one item value must always have become the
same document value, and different values different ones. Beside the templates every text is read word for word in lower
case, so that a copy matches whatever its letter case and however many of its words are slots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import words as W
from plumbline.llm.base import Scratch, list_array, pieces, small_batches
from plumbline.llm.bitmaps import bitmap, without
from plumbline.session import checkpointed

WIDTH = 5
#: Share of an item's windows that must lie together in a document; an edit in the middle takes five of them. Of short
#: items it is the larger share, up to so many windows.
COVERAGE, SHORT, SHORT_WINDOWS = 0.5, 0.8, 6
#: Or so many words of an item in one aligned stretch.
RUN = 13
#: Share of the slots whose values must agree with a one-to-one renaming.
CONSISTENT = 0.8
#: Windows of mostly placeholders say nothing; so many words of one must be literal.
LITERAL = 2
#: A passage may be longer than its item by this factor.
STRETCH = 1.3
BITS = 23
# Words that are units after a number.
UNITS = """mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers
kilometre kilometres g kg mg gram grams kilogram kilograms lb lbs oz pound pounds ounce ounces ton tons tonne tonnes l ml liter liters litre
litres gallon gallons cup cups s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years
mph kmh km/h usd eur gbp dollar dollars euro euros cent cents percent degree degrees celsius fahrenheit volt volts watt watts
joule joules newton newtons hz khz mhz byte bytes kb mb gb""".split()
#: How a text is read: opening capitalised words literal or as names, all as names, word for word, a short line as a whole.
TEMPLATE, NAMED, VERBATIM, LINE = range(4)
# Words that are numbers.
SPELLED = """one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen
twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion""".split()
NUM, NAME, UNIT = (np.uint64(x) for x in (0x6E756D, 0x6E616D65, 0x756E6974))


def templates(texts: list[bytes]) -> tuple[W.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, their template hashes with the first word of a sentence literal and as a name, and whether they are slots.

    A word that begins with a digit or spells a number is a number; a unit word after a number is a unit; a capitalised word that does not
    open a sentence is a name. Whether an opening capitalised word is a name cannot be told, so both readings count.
    """
    w = W.split(texts)
    number, capital, opens = w.number(), w.capital(), w.opens()
    units, spelled = (np.sort(W.split([u.encode() for u in x]).hash) for x in (UNITS, SPELLED))
    at = np.minimum(np.searchsorted(spelled, w.hash), len(spelled) - 1)
    number = number | (spelled[at] == w.hash)
    at = np.minimum(np.searchsorted(units, w.hash), len(units) - 1)
    after = np.zeros(len(w.hash), bool)
    after[1:] = number[:-1] & (w.text[1:] == w.text[:-1])
    unit = (units[at] == w.hash) & after & ~number
    name = capital & ~opens & ~number & ~unit
    plain = np.where(number, NUM, np.where(unit, UNIT, np.where(name, NAME, w.hash)))
    named = np.where(capital & opens & ~number & ~unit, NAME, plain)
    return w, plain, named, number | unit | name


def slots_of(w: W.Words, reading: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of the places of a reading, where a run of names or of numbers within a sentence is one place, and
    the values of these places."""
    start = np.ones(len(reading), bool)
    start[1:] = (reading[1:] != reading[:-1]) | ((reading[1:] != NAME) & (reading[1:] != NUM)) | (w.text[1:] != w.text[:-1]) | w.opens()[1:]
    first = np.flatnonzero(start)
    size = np.diff(np.append(first, len(reading)))
    inner = (np.arange(len(reading)) - np.repeat(first, size)).astype(np.uint64)
    return first, np.where(size > 1, np.add.reduceat(W.mix(w.hash + inner), first), w.hash[first])


def window_rows(text: np.ndarray, reading: np.ndarray, literal: np.ndarray, least: int = LITERAL) -> tuple[np.ndarray, np.ndarray]:
    """First place and hash of the windows with enough literal words."""
    at, hashes = W.windows(reading, text, WIDTH)
    count = np.append(0, np.cumsum(literal))
    keep = count[at + WIDTH] - count[at] >= least if len(at) else np.zeros(0, bool)
    return at[keep], hashes[keep]


def short_rows(w: W.Words, lines: bool) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of the texts with fewer than five words, or also of such lines of a text."""
    groups = [w.text]
    if lines:
        groups.append(np.append(0, np.cumsum(w.data == 10))[w.start])
    at, hashes = [], []
    for group in groups if len(w.hash) else []:
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        size = np.diff(np.append(first, len(group)))
        first, size = first[size < WIDTH], size[size < WIDTH]
        total = size.astype(np.uint64)
        for k in range(WIDTH - 1):
            more = k < size
            total[more] = total[more] * W.MULTIPLIER + w.hash[first[more] + k]
        at.append(first)
        hashes.append(W.mix(total))
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, hashes = np.concatenate(at), np.concatenate(hashes)
    at, one = np.unique(at, return_index=True)
    return at, hashes[one]


def window_table(rows: DataFrame, key: str, text: str = "text", filled: np.ndarray | None = None) -> DataFrame:
    """(key, mode, pos, h, values, slots, n): windows of every row in every reading, ``pos`` in places of that reading.

    ``values`` are the hashes of the window's words, or runs of them, as written (empty without slots), ``slots`` which of them are
    placeholders (as bits), ``n`` the number of windows of the row in this reading. With ``filled``, the bits of a map over
    window hashes, only windows that pass it come.
    """
    small_batches(rows.sparkSession)
    slim = rows.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text is not null")
    shared = rows.sparkSession.sparkContext.broadcast(filled) if filled is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value if shared else None
        for batch in pieces(batches, limit=W.BLOCK_BYTES):
            texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column(1)]
            w, plain, named, slot = templates(texts)
            if not len(w.hash):
                continue
            open_first, open_value = slots_of(w, plain)
            name_first, name_value = slots_of(w, named)
            every = np.arange(len(w.hash))
            readings = []
            for mode, first, value, ways in ((TEMPLATE, open_first, open_value, (plain, named)), (NAMED, name_first, name_value, (named,)), (VERBATIM, every, w.hash, (w.hash,))):
                text, size = w.text[first], None
                for way in ways:
                    slots = slot[first] if way is plain else (way != w.hash)[first]
                    at, hashes = window_rows(text, way[first], ~slots, 0 if mode == VERBATIM else LITERAL)
                    if size is None:
                        size = np.bincount(text[at], minlength=len(texts))
                    else:  # a window that reads the same in both is told once
                        changed = np.append(0, np.cumsum((named != plain)[first]))
                        fresh = changed[at + WIDTH] > changed[at] if len(at) else np.zeros(0, bool)
                        at, hashes = at[fresh], hashes[fresh]
                    readings.append((mode, text, at, hashes, None if mode == VERBATIM else slots, value, size))
            at, hashes = short_rows(w, bits is not None)
            readings.append((LINE, w.text, at, hashes, None, None, np.bincount(w.text[at], minlength=len(texts))))
            for mode, text, at, hashes, slots, value, size in readings:
                hashes = W.mix(hashes + np.uint64(mode))
                if bits is not None:
                    spot = hashes & np.uint64((1 << BITS) - 1)
                    hit = (bits[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    at, hashes = at[hit], hashes[hit]
                if not len(at):
                    continue
                text_of = text[at]
                if slots is None:
                    marks, values = np.zeros(len(at), np.int32), list_array(np.zeros(0, np.int64), np.zeros(len(at), np.int64), pa.int64())
                else:
                    inner = at[:, None] + np.arange(WIDTH)
                    marks = (slots[inner] << np.arange(WIDTH)).sum(axis=1).astype(np.int32)
                    values = list_array(value[inner].ravel().view(np.int64), np.full(len(at), WIDTH), pa.int64())
                begin = np.searchsorted(text, np.arange(len(texts)))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(text_of)), pa.array(np.full(len(at), mode, np.int32)), pa.array((at - begin[text_of]).astype(np.int32)),
                    pa.array(hashes.view(np.int64)), values, pa.array(marks), pa.array(size[text_of].astype(np.int32))], ["key", "mode", "pos", "h", "values", "slots", "n"])

    return slim.mapInArrow(run, f"key {slim.schema['key'].dataType.simpleString()}, mode int, pos int, h long, values array<long>, slots int, n int")


def bit_array(hashes: DataFrame) -> np.ndarray:
    """The map of ``h`` as bytes; its size is fixed."""
    out = np.zeros(1 << (BITS - 6), dtype=np.int64)
    rows = bitmap(hashes, "h", BITS).collect()  # at most 1 << (BITS - 6) rows of two numbers
    out[[r["word"] for r in rows]] = [r["mask"] for r in rows]
    return out.view(np.uint8)


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", coverage: float = COVERAGE) -> DataFrame:
    """(key, item, coverage, consistency, literal): documents that hold a benchmark item or a re-parameterised one.

    An item is held when a share of its windows lies together, or ``RUN`` of its words in one aligned run. ``coverage`` is
    the share of the item's windows in the best stretch of the document, ``consistency`` the share of its
    slots that agree with a one-to-one renaming of values, ``literal`` whether all values are the item's own. The readings
    are judged apart, and the best one tells. Items with fewer than five words match whole texts and whole lines; null and
    empty texts match nothing. Rows that share an id are judged together; rows without one are not reported.

    What several later steps read is written out once. In one plan it would stand once for each of them, and the driver tells
    its listeners the whole plan again at the end of every shuffle.
    """
    scratch = Scratch(docs.sparkSession)
    items = checkpointed(window_table(benchmark.filter(F.col(item).isNotNull()), item).select(F.struct("key", "mode").alias("item"), F.col("pos").alias("ipos"), "h", F.col("values").alias("ivalues"), "slots", F.col("n").alias("in_all")))
    hits = checkpointed(window_table(docs.filter(F.col(key).isNotNull()), key, filled=bit_array(items)).drop("mode", "slots", "n"))
    items = checkpointed(items.withColumn("nth", F.dense_rank().over(Window.partitionBy("item").orderBy("ipos"))))
    need = F.least(F.col("in_all"), F.greatest(F.ceil(F.col("in_all") * coverage - 1e-9), F.least(F.ceil(F.col("in_all") * SHORT - 1e-9), F.lit(SHORT_WINDOWS))))
    # Of n windows at least ``need`` must be found, so one of the others' number plus one is: the rarest serve as probes.
    # A run of windows holds a whole block of about half its length, so the rarest of every block serves as well.
    run = RUN - WIDTH + 1
    commonness = items.groupBy("h").agg(F.count(F.lit(1)).alias("shared"))
    rare = Window.partitionBy("item").orderBy("shared", "ipos")
    block = Window.partitionBy("item", F.floor(F.col("nth") / ((run + 1) // 2))).orderBy("shared", "ipos")
    positions = items.join(commonness, "h").groupBy("item", "ipos", "nth", "in_all").agg(F.max("shared").alias("shared"))
    probes = (positions.withColumn("place", F.row_number().over(rare)).withColumn("first", F.row_number().over(block))
              .filter((F.col("place") <= F.col("in_all") - need + 1) | (F.col("first") == 1)).select("item", "ipos"))
    probe_hashes = scratch.keep(items.join(probes, ["item", "ipos"], "left_semi").select("item", "h").distinct())
    candidates = hits.select("key", "h").distinct().join(probe_hashes, "h").select("key", "item").distinct()
    met = scratch.keep(candidates.join(items, "item").join(hits, ["key", "h"]).select("key", "item", "ipos", "nth", "in_all", "pos", "slots", "ivalues", "values"))
    # The best stretch: as long as the item and a little more, it holds the most of the item's windows.
    stretch = Window.partitionBy("key", "item").orderBy(F.floor(F.col("pos").cast("long") * 1000 / F.col("in_all"))).rangeBetween(0, int(STRETCH * 1000))
    spots = met.groupBy("key", "item", "in_all", "pos").agg(F.collect_set("ipos").alias("ipos"))
    found = spots.withColumn("inside", F.size(F.array_distinct(F.flatten(F.collect_list("ipos").over(stretch)))))
    covered = (found.groupBy("key", "item", "in_all").agg(F.max_by("pos", F.struct("inside", -F.col("pos"))).alias("from"), F.max("inside").alias("inside"))
               .withColumn("coverage", F.col("inside") / F.col("in_all")))
    # The longest run: neighbouring windows of the item at neighbouring places.
    shifted = met.select("key", "item", (F.col("pos") - F.col("ipos")).alias("shift"), "nth", "pos").distinct()
    island = F.col("nth") - F.row_number().over(Window.partitionBy("key", "item", "shift").orderBy("nth"))
    runs = shifted.withColumn("island", island).groupBy("key", "item", "shift", "island").agg(F.count(F.lit(1)).alias("length"), F.min("pos").alias("run_from"), F.max("pos").alias("run_to"))
    runs = runs.filter(F.col("length") >= run).groupBy("key", "item").agg(F.max_by(F.struct("run_from", "run_to"), F.struct("length", -F.col("run_from"))).alias("run"))
    whole = F.col("inside") >= need
    best = checkpointed(covered.join(runs, ["key", "item"], "left").filter(whole | F.col("run").isNotNull())
                        .withColumn("to", F.when(whole, F.col("from") + STRETCH * F.col("in_all")).otherwise(F.col("run.run_to")))
                        .withColumn("from", F.when(whole, F.col("from")).otherwise(F.col("run.run_from"))).drop("run"))
    # Slots of the windows in that stretch: how item values became document values. A window that occurs twice in an item
    # is aligned where most others are; of two readings the one with fewer slots counts.
    inside = (met.join(best, ["key", "item", "in_all"]).filter(F.col("pos").between(F.col("from"), F.col("to")))
              .withColumn("shift", F.col("pos") - F.col("ipos")))
    support = inside.groupBy("key", "item", "shift").agg(F.countDistinct("ipos").alias("support"))
    inside = (inside.join(support, ["key", "item", "shift"]).groupBy("key", "item", "pos")
              .agg(F.max_by(F.struct("slots", "ivalues", "values"), F.struct("support", -F.bit_count("slots"), -F.col("ipos"))).alias("w")).select("key", "item", "w.*"))
    slot = F.filter(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda k: F.col("slots").bitwiseAND(F.element_at(F.array(*[F.lit(1 << j) for j in range(WIDTH)]), k + 1)) != 0)
    pairs = scratch.keep(inside.select("key", "item", F.explode(F.transform(slot, lambda k: F.struct(F.element_at("ivalues", k + 1).alias("was"), F.element_at("values", k + 1).alias("now")))).alias("p"))
             .groupBy("key", "item", "p.was", "p.now").agg(F.count(F.lit(1)).alias("n")))
    forward = pairs.groupBy("key", "item", "was").agg(F.max("n").alias("top"), F.sum("n").alias("all"), F.sum(F.when(F.col("was") == F.col("now"), F.col("n")).otherwise(0)).alias("same"))
    backward = pairs.groupBy("key", "item", "now").agg(F.max("n").alias("top"), F.sum("n").alias("all"))
    agree = (forward.groupBy("key", "item").agg((F.sum("top") / F.sum("all")).alias("there"), (F.sum("same") == F.sum("all")).alias("literal"))
             .join(backward.groupBy("key", "item").agg((F.sum("top") / F.sum("all")).alias("back")), ["key", "item"]))
    told = best.join(agree, ["key", "item"], "left").withColumn("consistency", F.coalesce(F.least("there", "back"), F.lit(1.0))).withColumn("literal", F.coalesce("literal", F.lit(True)))
    order = F.struct(F.col("literal") | (F.col("consistency") >= CONSISTENT), "coverage", "consistency", "literal")
    out = checkpointed(told.groupBy("key", F.col("item.key").alias("of")).agg(F.max_by(F.struct("coverage", "consistency", "literal"), order).alias("x"))
                       .select(F.col("key").alias(key), F.col("of").alias(item), "x.*"))
    scratch.drop()
    return out


def contaminated(found: DataFrame, consistent: float = CONSISTENT) -> DataFrame:
    """The matches that count: literal ones, and those with consistent slots."""
    return found.filter(F.col("literal") | (F.col("consistency") >= consistent))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_items, item_ids (sorted), coverage and consistency of the best match (null
    without any), and whether the document is kept."""
    per = (contaminated(matches(docs, benchmark)).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.array_sort(F.collect_list("item_id")).alias("item_ids"),
        F.max(F.struct("coverage", "consistency")).alias("best")))
    return docs.select("doc_id").join(per, "doc_id", "left").select(
        "doc_id", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"),
        "best.coverage", "best.consistency", F.col("n_items").isNull().alias("kept"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without its contaminated rows."""
    return without(docs, checkpointed(contaminated(matches(docs, benchmark)).select("doc_id").distinct()))
