"""Benchmark decontamination by template canonicalisation, on DataFrame functions alone.

Texts of both sides become word templates: white space is evened out, words that are all punctuation go, numbers become
<num>, a word after a number that is a unit <unit>; the rest is lower-cased and stripped of punctuation. In a second form of a window every
capitalised word is a <name> as well, at the start of a sentence too. Windows of five words are looked up by hash: in the first form, which finds copies in
any case, or in the second, which finds those with other names, if the window has two neighbouring words that are neither
capitalised nor placeholders. Replacement never changes the number of words, so a found window also gives the words behind its placeholders: the
slots, without punctuation around them. Windows that lie alike in the item and in
the document are one occurrence; it counts if its slots are consistent, which means that equal slots of the item are equal in
the document and the other way round; a question whose numbers or names were swapped throughout still matches.

Only the windows of the benchmark are ever grouped or sent. Documents stay where they are read: in pieces of some words, their pairs of words are looked
up among the windows' anchors (in each window the longest pair of neighbours, of words that are neither capitalised nor placeholders if it has such), and only around a
hit is a window hashed and its second form made. No row past the pieces holds a whole text, and memory holds the hits of one piece at a time. The
windows are broadcast if a count proves them few, else both sides are joined by a shuffle on the anchor.

An item is found in a document if at least ``coverage`` of its windows are. Defined results: items with fewer than five
words are one window; items of a single word, and items and documents without words, match nothing; null texts and null
ids match nothing; rows that share a doc_id count as one document; of rows that share an item_id and a template one
counts, and other rows that share an item_id are judged each by its number of windows; repeated rows change nothing; empty
tables give empty results; further columns play no part in the match and come back from ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units of measure that become placeholders behind a number. Fixed values, natural order.
UNITS = (
    "mm cm m km in ft yd mi mg g kg lb lbs oz t ml l s sec secs min mins h hr hrs second seconds minute minutes hour hours day days week weeks "
    "month months year years meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches gram grams "
    "kilogram kilograms pound pounds ounce ounces ton tons liter liters litre litres cent cents dollar dollars euro euros percent degree degrees"
).split()
#: More windows than this are not broadcast (some 60 bytes each).
FEW = 200_000
#: Words of a document that are looked up as one row.
PIECE = 128


def _even(text: Column) -> Column:
    """Single spaces, and no word without a letter or digit."""
    spaced = F.concat(F.lit(" "), F.regexp_replace(text, r"[\s\x{A0}]+", " "), F.lit(" "))
    return F.trim(F.regexp_replace(spaced, r" (?:[^\p{L}\p{N} ]+ )+", " "))


def with_words(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, words (as written) and template (of equal length) of every row with a key; a text without words has one empty word."""
    even = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), _even(F.col(text).cast("string")).alias("even"))
    units = F.regexp_replace("even", rf"(?i)(?<=\d )(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])", "<unit>")
    numbers = F.regexp_replace(units, r"(?<![^ ])[^\p{L}\p{N} <]*\d[\d.,:/]*[^ ]*", "<num>")
    typed = even.withColumn("t", F.when(F.col("even").rlike(r"\d"), numbers).otherwise(F.col("even")))  # no digit: no number, no unit
    template = F.split(F.regexp_replace(F.lower("t"), r"[^\p{L}\p{M}\p{N}<> ]+", ""), " ")
    # The lambda keeps this projection out of the generated code of what follows: with the patterns inside, the loop over
    # words becomes a method larger than the JVM compiles (8000 bytes), and runs some ten times slower.
    return typed.select(F.transform(F.array(key), lambda x: x)[0].alias(key), F.split("even", " ").alias("words"), template.alias("template"))


def _hash(words: Column) -> Column:
    return F.xxhash64(F.concat_ws(" ", words))


def _slots(words: Column) -> Column:
    return F.transform(words, lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def _named(slots: Column, template: Column) -> Column:
    """The second form of a window: capitalised words are names."""
    return F.zip_with(slots, template, lambda w, t: F.when(~t.startswith("<") & w.rlike(r"^\p{Lu}"), F.lit("<name>")).otherwise(t))


def windows(benchmark: DataFrame, size: int) -> DataFrame:
    """Each window of each item: item_id, no, n_windows, width, slots, anchor (hash of a pair of words), its place, and the hashes of both forms."""
    items = with_words(benchmark, "item_id").where("words[0] != ''").dropDuplicates(["item_id", "words"]).withColumn("width", F.least(F.lit(size), F.size("template")))
    last = F.size("template") - F.col("width")
    starts = items.select("item_id", "words", "template", "width", (last + 1).alias("n"), F.explode(F.sequence(F.lit(0), last)).alias("no"))
    cut = starts.select("item_id", "width", "n", "no", F.slice("template", F.col("no") + 1, F.col("width")).alias("template"), _slots(F.slice("words", F.col("no") + 1, F.col("width"))).alias("slots"))
    cut = cut.where("width > 1").withColumn("named", _named(F.col("slots"), F.col("template")))
    plain = F.transform("template", lambda w: F.when(w.startswith("<"), F.lit(0)).otherwise(F.length(w)))
    calm = F.transform("named", lambda w: F.when(w.startswith("<"), F.lit(0)).otherwise(F.length(w)))
    both = lambda of, add: F.zip_with(F.slice(of, F.lit(1), F.col("width") - 1), F.slice(of, F.lit(2), F.col("width") - 1), add)
    calm_pairs = both(calm, lambda x, y: F.when((x > 0) & (y > 0), x + y).otherwise(F.lit(0)))
    measured = cut.withColumns({"pairs": both(plain, lambda x, y: x + y), "calm": calm_pairs}).withColumn("fixed", F.array_max("calm") > 0)
    pairs = F.when(F.col("fixed"), F.col("calm")).otherwise(F.col("pairs"))
    anchored = measured.withColumn("offset", F.array_position(pairs, F.array_max(pairs)).cast("int") - 1)
    return anchored.select(
        "item_id", "no", F.col("n").alias("n_windows"), "width", "slots", "offset", F.xxhash64(F.get("template", F.col("offset")), F.get("template", F.col("offset") + 1)).alias("anchor"),
        _hash(F.col("template")).alias("hash"), F.when(F.col("fixed") & F.array_contains("named", "<name>"), _hash(F.col("named"))).alias("named_hash"),
    )


def _pieces(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, start, reach, words, template and anchors of each piece: the pairs from word start on, with the words from reach on that windows over them hold."""
    reach = lambda start: F.greatest(start - size + 1, F.lit(0))
    around = lambda of, start: F.slice(of, reach(start) + 1, F.lit(PIECE + 2 * size))
    # Generated code hands on the rows of a generator once it is through with its input, all of them in memory. So the first
    # makes pieces (a text's length in all), and the lambdas, which are outside of generated code, give these one by one to the next.
    # The outer form keeps Spark from filtering by the size of the array first, with all the patterns once more.
    starts = F.sequence(F.lit(0), F.greatest(F.size("template") - 1, F.lit(0)), F.lit(PIECE))
    cut = F.transform(starts, lambda i: F.struct(i.alias("start"), around("words", i).alias("words"), around("template", i).alias("template")))
    piece = with_words(docs, "doc_id").select("doc_id", F.explode_outer(cut).alias("piece")).select("doc_id", "piece.*").withColumn("reach", reach(F.col("start")))
    own = lambda behind: F.slice("template", F.col("start") - F.col("reach") + 1 + behind, F.lit(PIECE))
    return piece.withColumn("anchors", F.zip_with(own(0), own(1), lambda x, y: F.xxhash64(x, y)))


def _pairs(mine: Column, theirs: Column, template: Column) -> Column:
    """The slots of two equal templates, pair by pair."""
    zipped = F.arrays_zip(mine.alias("a"), theirs.alias("b"), template.alias("t"))
    return F.transform(F.filter(zipped, lambda x: x["t"].startswith("<")), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b")))


def matches(docs: DataFrame, benchmark: DataFrame, size: int = 5, coverage: float = 0.8) -> DataFrame:
    """doc_id, item_id, n_windows, n_found, coverage and changed (slots differ somewhere) of each item found in a document."""
    wanted = windows(benchmark, size)
    few = len(wanted.select("hash").take(FEW + 1)) <= FEW
    words = _pieces(docs, size).select("doc_id", "start", "reach", "words", "template", F.posexplode_outer("anchors").alias("p", "anchor")).withColumn("p", F.col("start") + F.col("p"))
    side = F.broadcast(wanted) if few else wanted
    if not few:  # a shuffle must not carry a piece along with every word
        narrow = F.greatest(F.col("p") - size + 1, F.lit(0))
        near = [F.slice(c, narrow - F.col("reach") + 1, F.lit(2 * size)).alias(c) for c in ("words", "template")]
        words = words.select("doc_id", "anchor", *near, "p", narrow.alias("reach"))
    at = F.col("p") - F.col("reach") - F.col("offset")
    inside = (at >= 0) & (at + F.col("width") <= F.size("template"))
    # The test is always true, but of a kind that Spark leaves where it stands: the windows are cut in the join's own code, and what follows gets no pieces.
    window = lambda of: F.when(F.monotonically_increasing_id() >= 0, F.slice(of, F.greatest(at, F.lit(0)) + 1, F.col("width"))).alias(of)
    near = words.join(side, "anchor").where(inside).select("doc_id", "item_id", "n_windows", "no", "slots", "hash", "named_hash", (F.col("reach") + at - F.col("no")).alias("lie"), window("words"), window("template"))
    alike, named = _hash(F.col("template")) == F.col("hash"), _named(_slots(F.col("words")), F.col("template"))
    hits = near.where(alike | (F.col("named_hash").isNotNull() & (_hash(named) == F.col("named_hash"))))
    hits = hits.withColumn("mine", _slots(F.col("words"))).withColumn("form", F.when(alike, F.col("template")).otherwise(_named(F.col("mine"), F.col("template"))))
    lying = hits.select("doc_id", "item_id", "n_windows", "no", "lie", _pairs(F.col("slots"), F.col("mine"), F.col("form")).alias("pairs"))
    occurrences = lying.groupBy("doc_id", "item_id", "n_windows", "lie").agg(F.collect_set("no").alias("nos"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    one = lambda c: F.size(F.array_distinct(F.transform("pairs", lambda x: x[c])))
    consistent = (F.size("pairs") == one("a")) & (F.size("pairs") == one("b"))
    changed = F.exists("pairs", lambda x: x["a"] != x["b"])
    found = (
        occurrences.where(consistent).groupBy("doc_id", "item_id", "n_windows")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_set("nos")))).cast("long").alias("n_found"), F.max(changed).alias("changed"))
    )
    share = F.col("n_found") / F.col("n_windows")
    return found.where(share >= coverage).select("doc_id", "item_id", "n_windows", "n_found", share.alias("coverage"), "changed")


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 5, coverage: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, in which no item of the benchmark is found."""
    found = matches(docs, benchmark, size, coverage).select(F.col("doc_id").alias("_found")).distinct()
    return docs.join(found, docs["doc_id"] == found["_found"], "left_anti")
