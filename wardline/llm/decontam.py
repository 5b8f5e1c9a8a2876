"""Benchmark decontamination over a distributed positional inverted index.

Only DataFrame functions run here. Steps:

1. Benchmark items become windows of ``size`` words (a shorter item is one window).
2. The corpus is counted for the benchmark's vocabulary; each window picks the two
   rarest of its terms that the corpus has. Only a window of which it has all terms
   can occur as a phrase; the others may still stand near.
3. Postings of the picked terms (document, position, surrounding words) are stored.
   A table of 2**20 bits, the only thing that every task gets, drops other words before
   the join with the terms.
4. Lists are intersected after adjusting positions by the term's place in the item:
   a (document, item, diagonal) that holds both rare terms of a window is a candidate,
   and the words stored with the posting decide exactly.

Defined cases: a null text has no words; an item without words has no window; rows
equal in id and text are one document for the search and each get the result; items
with the same id count once and a null item id counts as the empty string; columns
other than the id and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import cut_lineage
from .common import text_key, unused

WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SIZE = 10
BITS = 20


def words_of(text: str = "text") -> Column:
    return F.coalesce(F.array_remove(F.split(F.translate(text, UPPER, LOWER), SEPARATORS), ""), F.array().cast("array<string>"))


def _slot(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(1 << BITS))


def bit_table(words: DataFrame) -> Column:
    """The hashes of column ``word`` as a scalar array of 2**14 longs, whatever their number."""
    h = words.select(_slot(F.col("word")).alias("h")).distinct()
    cells = h.groupBy((F.col("h") / 64).cast("long").alias("id")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(h % 64 as int))")).alias("v")
    )
    full = words.sparkSession.range(1 << (BITS - 6)).join(cells, "id", "left")
    rows = F.sort_array(F.collect_list(F.struct("id", F.coalesce("v", F.lit(0)).alias("v"))))
    return full.agg(F.transform(rows, lambda x: x["v"]).alias("bits")).scalar()


def in_table(bits: Column, word: Column) -> Column:
    """Whether the word's bit is set; other words may pass, so a join follows."""
    h = _slot(word)
    cell = F.get(bits, (h / 64).cast("int"))
    return F.getbit(cell, (h % 64).cast("int")) == 1


def benchmark_windows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """(item, start, terms) for each window of each item; ``item`` is the id as a string."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of().alias("words"))
    rows = rows.filter(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)))
    return rows.select("item", F.explode(starts).alias("start"), "words").select(
        "item", F.xxhash64("words").alias("version"), "start", F.slice("words", F.col("start") + 1, size).alias("terms")
    ).distinct()


def pick_rarest(documents: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows with the places ``q1`` and ``q2`` of the two rarest terms that the corpus has, and whether it has all (``whole``)."""
    places = windows.select("item", "version", "start", F.posexplode("terms").alias("offset", "word"))
    vocabulary = places.select("word").distinct()
    seen = documents.select(F.explode(words_of()).alias("word")).filter(in_table(bit_table(vocabulary), F.col("word")))
    counts = seen.groupBy("word").agg(F.count("*").alias("n"))
    ranked = places.join(counts, "word", "left").groupBy("item", "version", "start").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset"))).alias("r")
    )
    ranked = ranked.withColumn("present", F.filter("r", lambda x: x["n"] > 0)).filter(F.size("present") > 0)
    place = lambda i: F.col("start") + F.get("present", F.lit(i))["offset"]
    whole = (F.size("present") == F.size("r")).alias("whole")
    picked = ranked.select("item", "version", "start", place(0).alias("q1"), place(1).alias("q2"), whole)
    return picked.join(windows, ["item", "version", "start"])


def postings(documents: DataFrame, terms: DataFrame, size: int = SIZE) -> DataFrame:
    """The index: (word, key, position, context, first) for every occurrence of a term.

    ``context`` holds the words up to ``size - 1`` places away, ``first`` the position of its first word.
    """
    words = documents.select(text_key().alias("key"), words_of().alias("words"))
    at = words.select("key", "words", F.posexplode("words").alias("position", "word"))
    at = at.filter(in_table(bit_table(terms), F.col("word")))
    first = F.greatest(F.col("position") - (size - 1), F.lit(0))
    near = F.slice("words", first + 1, F.col("position") - first + size)
    return at.select("word", "key", "position", F.concat_ws(" ", near).alias("context"), first.alias("first")).join(terms, "word")


def index_for(documents: DataFrame, items: DataFrame, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """Windows with their rarest terms, and the stored postings of these terms."""
    windows = cut_lineage(pick_rarest(documents, benchmark_windows(items, size)), "windows")
    terms = windows.select(F.explode(F.array("q1", "q2")).alias("q"), "start", "terms").filter("q is not null")
    terms = terms.select(F.get("terms", F.col("q") - F.col("start")).alias("word")).distinct()
    return windows, cut_lineage(postings(documents, terms, size), "postings")


def _places(windows: DataFrame) -> DataFrame:
    """The picked places of each item: (word, item, version, q, before, after), with the neighbouring words."""
    q = windows.select("item", "version", "start", "terms", F.explode(F.array("q1", "q2")).alias("q")).filter("q is not null")
    at = F.col("q") - F.col("start")
    return q.select("item", "version", "q", F.get("terms", at).alias("word"), F.get("terms", at - 1).alias("b"), F.get("terms", at + 1).alias("a")).groupBy(
        "item", "version", "q", "word"
    ).agg(F.max("b").alias("before"), F.max("a").alias("after"))


def phrase_matches(windows: DataFrame, index: DataFrame) -> DataFrame:
    """(key, item, position, length): every place of a document at which a window occurs word by word."""
    windows = windows.filter("whole")
    hits = index.join(_places(windows), "word")
    around = F.split("context", " ")
    here = F.col("position") - F.col("first")
    # a window of two words or more also holds a neighbour of its term
    neighbour = (F.get(around, here - 1) == F.col("before")) | (F.get(around, here + 1) == F.col("after"))
    alone = F.col("before").isNull() & F.col("after").isNull()
    diagonals = (
        hits.filter(F.coalesce(neighbour, F.lit(False)) | alone)
        .groupBy("key", "item", "version", (F.col("position") - F.col("q")).alias("diagonal"))
        .agg(F.map_from_entries(F.collect_set(F.struct("q", F.struct("context", "first")))).alias("found"))
    )
    both = F.map_contains_key("found", F.col("q1")) & (F.col("q2").isNull() | F.map_contains_key("found", F.coalesce("q2", F.lit(0))))
    stored = F.get(F.array("found"), F.lit(0))[F.col("q1")]
    position = F.col("diagonal") + F.col("start")
    same = F.slice(F.split(stored["context"], " "), F.greatest(position - stored["first"], F.lit(0)) + 1, F.size("terms")) == F.col("terms")
    return (
        diagonals.join(windows, ["item", "version"])
        .filter((position >= 0) & both)
        .filter((position >= stored["first"]) & same)
        .select("key", "item", position.alias("position"), F.size("terms").alias("length"))
        .distinct()
    )


def proximity_matches(windows: DataFrame, index: DataFrame, slop: int = 3) -> DataFrame:
    """(key, item, start, position): windows whose two rarest terms stand at most ``slop`` words from their distance in the item.

    Positions meet in blocks as wide as the longest window and ``slop``, each tried with its neighbours.
    """
    width = F.lit(slop + (windows.agg(F.max(F.size("terms"))).first()[0] or 1))
    pairs = windows.filter("q2 is not null").select(
        "item", "start", (F.col("q2") - F.col("q1")).alias("gap"),
        F.get("terms", F.col("q1") - F.col("start")).alias("word"), F.get("terms", F.col("q2") - F.col("start")).alias("other"),
    )
    block = F.floor(F.col("position") / width)
    first = index.select("word", "key", "position").join(pairs, "word")
    first = first.withColumn("block", F.explode(F.array(block - 1, block, block + 1)))
    second = index.select(F.col("word").alias("other"), "key", F.col("position").alias("place"), block.alias("block"))
    near = F.abs(F.col("place") - F.col("position") - F.col("gap")) <= slop
    return first.join(second, ["key", "other", "block"]).filter(near).select("key", "item", "start", "position").distinct()


def covered(matches: DataFrame) -> DataFrame:
    """Words inside any match and the items that match, per document key."""
    order = Window.partitionBy("key").orderBy("position", "stop").rowsBetween(Window.unboundedPreceding, -1)
    spans = matches.select("key", "position", (F.col("position") + F.col("length")).alias("stop")).distinct()
    new = F.greatest(F.col("stop") - F.greatest("position", F.coalesce(F.max("stop").over(order), F.lit(0))), F.lit(0))
    hits = spans.select("key", new.alias("new")).groupBy("key").agg(F.sum("new").cast("long").alias("n_hit"))
    return hits.join(matches.groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items")), "key")


def contamination(documents: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """The documents' rows with ``n_words``, ``n_hit`` and ``items``, the ids of matching items sorted as strings."""
    found = covered(phrase_matches(*index_for(documents, items, size)))
    (key,) = unused(documents, "key")
    rows = documents.withColumns({key: text_key(), "n_words": F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")})
    found = found.select(F.col("key").alias(key), "n_hit", "items")
    return rows.drop("n_hit", "items").join(found, key, "left").drop(key).withColumns(
        {"n_hit": F.coalesce("n_hit", F.lit(0)), "items": F.coalesce("items", F.array().cast("array<string>"))}
    )
