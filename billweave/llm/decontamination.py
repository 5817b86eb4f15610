"""Benchmark decontamination by a distributed positional inverted index; DataFrame functions only.

Postings (term, document, position) of all training tokens that occur in a test item are stored, with a header row for
each document. Each window of a test item gets its rarest terms by their corpus counts; their lists are intersected after
subtracting the terms' places in the item, which leaves few alignments of an item with a document. Those are checked
term by term against the index, and runs of matching places that are as long as a window are exact phrase matches.
`near_matches` asks the same lists for the rarest terms within a distance instead.

Words are runs of digits, letters a-z (A-Z folded) and characters beyond ASCII. A window has `size` words; an item with
fewer words, but not none, is one window.

Defined results: null or empty texts have no words; items without words match nothing; repeated items are reported once,
by their id as a string (a null id as the empty string); rows repeated in the input are rows of the output; rows that
share a doc_id are separate rows here; other columns, whatever their names, are kept out of the way; empty tables give
empty results, or documents without hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from billweave.llm.common import parted, saved

BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rarest terms of each window that must meet.
RAREST = 3
#: A table of test terms is sent to all executors up to so many rows (about 60 bytes each); larger ones are shuffled.
MOST_SENT = 200_000
#: Bits of the fixed-size map of documents with an alignment.
MAP_BITS = 1 << 23


def words_after_mark(text: Column) -> Column:
    """An empty string, the words of a text, and an empty string again if the text ends between words."""
    return F.split(F.concat(F.lit("."), F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)), BETWEEN_WORDS)


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcasting if its size has been checked."""
    return F.broadcast(df) if df.count() <= MOST_SENT else df


def item_terms(items: DataFrame) -> DataFrame:
    """item (a number), item_id, n (its words), place and word of every word of every item."""
    rows = items.select(F.monotonically_increasing_id().alias("item"), F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.filter(words_after_mark(F.col("text")), lambda w: w != "").alias("words"))
    return saved(rows.select("item", "item_id", F.size("words").alias("n"), F.posexplode("words").alias("place", "word")), "terms")


def build_index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The stored index: doc (a row's number), pos, term. Term 0 marks the header row, with doc_id and n_words."""
    terms = vocabulary.select("word", "term").union(docs.sparkSession.createDataFrame([("", 0)], "word string, term long"))
    rows = docs.select(F.monotonically_increasing_id().alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), words_after_mark(F.col("text")).alias("words"))
    last = F.element_at("words", -1)
    rows = rows.withColumn("n_words", F.size("words") - 1 - F.when((last == "") & (F.size("words") > 1), 1).otherwise(0))
    each = rows.select("doc", "doc_id", "n_words", F.posexplode("words").alias("pos", "word")).where("word != '' or pos = 0")
    kept = each.join(small(terms), "word")
    header = F.col("pos") == 0
    return saved(kept.select("term", "doc", "pos", F.when(header, F.col("doc_id")).alias("doc_id"), F.when(header, F.col("n_words")).alias("n_words")), "index")


def rare_places(terms: DataFrame, index: DataFrame, size: int, rarest: int = RAREST) -> DataFrame:
    """item, place, term and need of the places that are among the rarest of some window of their item.

    need: so many of these places an alignment holds at least if it holds a window.
    """
    counts = index.where("term > 0").groupBy("term").agg(F.count("*").alias("times"))
    seen = terms.join(counts, "term")
    # a window that holds a term which no document has cannot occur, so its other terms need not be looked up
    starts = terms.where(f"place <= greatest(n - {size}, 0)").select("item", F.col("place").alias("start"), F.least(F.col("n"), F.lit(size)).alias("length"))
    inside = starts.join(seen, "item").where("place >= start and place < start + length")
    by_window = Window.partitionBy("item", "start")
    ranked = inside.withColumn("found", F.count("*").over(by_window)).where("found = length").withColumn("rank", F.row_number().over(by_window.orderBy("times", "place")))
    return ranked.where(f"rank <= {rarest}").groupBy("item", "place", "term").agg(F.min(F.least("length", F.lit(rarest))).alias("need"))


def document_map(docs: DataFrame) -> DataFrame:
    """A bitmap of fixed size over a column `doc`, as rows (bucket, bits)."""
    slot = F.pmod(F.xxhash64("doc"), F.lit(MAP_BITS))
    return docs.select(slot.alias("slot")).groupBy(F.expr("bitmap_bucket_number(slot)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits"))


def in_map(df: DataFrame, bitmap: DataFrame) -> DataFrame:
    """The rows of df whose `doc` may be in the bitmap: all that are, and few others."""
    slot = F.pmod(F.xxhash64("doc"), F.lit(MAP_BITS))
    marked = df.withColumn("slot", slot).withColumn("bucket", F.expr("bitmap_bucket_number(slot)")).withColumn("at", F.expr("bitmap_bit_position(slot)"))
    got = marked.join(F.broadcast(bitmap), "bucket")  # MAP_BITS / 8 bytes at most
    byte = F.conv(F.hex(F.expr("substring(bits, cast(at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return got.where(F.getbit(byte, F.expr("cast(at % 8 as int)")) == 1).select(*df.columns)


def alignments(index: DataFrame, rare: DataFrame) -> DataFrame:
    """doc, item, shift: an item starts at shift in a document, as far as the rarest terms say."""
    met = index.where("term > 0").join(small(rare), "term").select("doc", "item", "place", "need", (F.col("pos") - F.col("place")).alias("shift"))
    return met.groupBy("doc", "item", "shift").agg(F.count("*").alias("met"), F.min("need").alias("need")).where("met >= need").select("doc", "item", "shift")


def phrase_matches(index: DataFrame, terms: DataFrame, size: int = 13) -> DataFrame:
    """doc, item, first, last: words first to last of a document are words of an item, in order, a window at least."""
    rare = saved(rare_places(terms, index, size), "rare")
    lined_up = saved(alignments(index, rare), "aligned")
    places = terms.select("item", "place", "term", "n")
    wanted = lined_up.join(small(places), "item").select("doc", "item", "shift", "place", "n", "term", (F.col("shift") + F.col("place")).alias("pos")).where("pos > 0")
    held = in_map(index.where("term > 0").select("doc", "pos", "term"), saved(document_map(lined_up), "map"))
    same = wanted.join(held, ["doc", "pos", "term"])
    run = Window.partitionBy("doc", "item", "shift").orderBy("place")
    runs = same.withColumn("run", F.col("place") - F.row_number().over(run)).groupBy("doc", "item", "shift", "run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.min("n").alias("n"))
    return runs.where(f"last - first + 1 >= least(n, {size})").select("doc", "item", "first", "last")


def near_matches(index: DataFrame, terms: DataFrame, size: int = 13, distance: int = 5) -> DataFrame:
    """doc, item: the rarest terms of a window stand in a document, each at most `distance` words from its place."""
    rare = rare_places(terms, index, size)
    met = index.where("term > 0").join(small(rare), "term").select("doc", "item", "place", "need", (F.col("pos") - F.col("place")).alias("shift"))
    first = F.floor(F.col("shift") / (distance + 1))  # also before the text's start, where shifts are negative
    band = F.explode(F.array(first, first + 1))
    return met.withColumn("band", band).groupBy("doc", "item", "band").agg(F.count_distinct("place").alias("met"), F.min("need").alias("need")).where("met >= need").select("doc", "item").distinct()


def contamination(docs: DataFrame, items: DataFrame, size: int = 13) -> DataFrame:
    """doc_id, n_words, n_hit (words inside occurrences of windows) and item_ids (sorted strings) of every row of docs."""
    terms = item_terms(items)
    vocabulary = terms.select("word").distinct()
    vocabulary = saved(vocabulary.select("word", (F.monotonically_increasing_id() + 1).alias("term")), "vocabulary")
    terms = saved(terms.join(vocabulary, "word"), "terms")
    index = build_index(docs, vocabulary)
    matches = saved(phrase_matches(index, terms, size), "matches")
    hit = matches.select("doc", F.explode(F.sequence("first", "last")).alias("pos")).distinct().groupBy("doc").agg(F.count("*").alias("n_hit"))
    names = terms.select("item", "item_id").distinct()
    listed = matches.select("doc", "item").distinct().join(names, "item").select("doc", "item_id").distinct().groupBy("doc").agg(F.sort_array(F.collect_list("item_id")).alias("item_ids"))
    rows = index.where("term = 0").select("doc", "doc_id", F.col("n_words").cast("long").alias("n_words"))
    found = rows.join(hit, "doc", "left").join(listed, "doc", "left")
    return found.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least a twentieth of the words are hit, and one at least."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def without_contaminated(docs: DataFrame, items: DataFrame, size: int = 13) -> DataFrame:
    """The rows of docs, all their columns, whose doc_id has no contaminated row."""
    found = contamination(docs, items, size).where(is_contaminated(F.col("n_hit"), F.col("n_words")) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return parted(docs, found)[0]
