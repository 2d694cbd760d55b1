"""Benchmark passages in documents, also re-parameterised ones (template canonicalisation). DataFrame functions only."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a window. The first only tells whether the second is a name or a unit; the others are compared.
WINDOW = 8
#: Most words of an item of which one window is enough.
SHORT_ITEM = 11
#: Words of a window that are no placeholders, at least; windows of fewer would match everywhere and are compared by their literal words.
LEAST_PLAIN = 3
#: Most benchmark windows (of 48 bytes and their few slot words) that are broadcast; beyond it the join shuffles.
BROADCAST_WINDOWS = 500_000
# Units that may follow a number.
UNITS = "mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l gal s sec min h hr hrs day days week weeks month months year years usd eur gbp dollars euros pounds cents percent kmh mph km/h m/s hz kb mb gb tb w kw v a k c f degrees"

_NUMBER = r"(?<!\S)[$€£+\-(]?\d[\d.,:/\-]*[%°]?[\p{L}²³]{0,4}[).,;:!?]*(?!\S)"
_NAME = r"(?<=[\p{Ll}\p{Nd},;] )\p{Lu}[\p{L}\-']*[).,;:!?]*(?!\S)"
_UNIT = r"(?i)(?<=<num> )(?:" + "|".join(sorted(UNITS.split(), key=lambda u: -len(u))) + r")[).,;:!?]*(?!\S)"


def template(text: Column) -> Column:
    """The text with a typed placeholder for each number, unit after a number, and capitalised word inside a sentence; as many words as before."""
    flat = F.regexp_replace(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")), _NUMBER, "<num>")
    return F.regexp_replace(F.regexp_replace(flat, _UNIT, "<unit>"), _NAME, "<name>")


def _words(rows: DataFrame, *keys: str) -> DataFrame:
    """keys and, word for word of the text: form (canonical forms), slot (what stands in a placeholder, else empty) and plain (the form without placeholders)."""
    flat = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    # A word of punctuation only becomes empty and still counts, so both lists stay in step.
    form = F.lower(F.regexp_replace(template(F.col("text")), r"[^\p{L}\p{N}<> ]", ""))
    rows = rows.select(*keys, F.split(F.lower(flat), " ").alias("said"), F.split(form, " ").alias("form"))
    bare = lambda f, s: F.when(f == "<num>", F.regexp_replace(s, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")).otherwise(F.regexp_replace(s, r"[^\p{L}\p{N}]", ""))
    slot = F.zip_with("form", "said", lambda f, s: F.when(f.like("<%>"), s).otherwise(""))
    plain = F.zip_with("form", "said", lambda f, s: F.when(f.like("<%>"), bare(f, s)).otherwise(f))
    return rows.select(*keys, "form", slot.alias("slot"), plain.alias("plain"))


def _windows(length: int) -> Column:
    """(hash, at, slots) of each window: its place and what stands in its placeholders, in order.

    A whole WINDOW is compared without its first word. A shorter one, which is a whole item, is
    compared with it; as no name or unit begins an item, only a number is a placeholder there.
    """
    # The size of slot, not of form: used twice, slot is made once a text and not inside the loops over windows.
    n, last = WINDOW - 1, F.size("slot") - length
    number = lambda i: F.get("form", i) == "<num>"
    cut = lambda c, i: F.slice(c, i + 2, n)
    if length < WINDOW:
        n = length
        first = {"form": lambda i: F.when(number(i), "<num>").otherwise(F.get("plain", i)), "slot": lambda i: F.when(number(i), F.get("slot", i)).otherwise(""), "plain": lambda i: F.get("plain", i)}
        cut = lambda c, i: F.concat(F.array(first[c](i)), F.slice(c, i + 2, n - 1))
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.expr("cast(array() as array<int>)"))
    held = F.transform(at, lambda i: F.struct(i.alias("at"), F.array_remove(cut("slot", i), "").alias("slots")))
    literal = lambda w: F.xxhash64(cut("plain", w["at"]), F.lit(-length))
    canonical = lambda w: F.xxhash64(cut("form", w["at"]), F.lit(length))
    return F.transform(held, lambda w: F.struct(F.when(F.size(w["slots"]) > n - LEAST_PLAIN, literal(w)).otherwise(canonical(w)).alias("hash"), w["at"].alias("at"), w["slots"].alias("slots")))


def _exploded(rows: DataFrame, windows: Column, *keys: str) -> DataFrame:
    return rows.select(*keys, F.explode(windows).alias("w")).select(*keys, "w.*")


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(doc_id, item_id, n_windows, n_slots) for each document that holds a passage of a benchmark item, with the same or other numbers, names and units.

    Windows of canonical words are joined by hash. Matches of a document's text and an item's
    text are taken apart by alignment (place in the document less place in the item), and an
    alignment counts if its slots are consistent: each word in the item's slots always stands
    for the same word of the document. A pair counts if two windows of such alignments match (9
    words in a row always give two), or one of an item of at most 11 words. Items of fewer than
    8 words match as a whole, be it one word. Windows of fewer than 3 words that are no
    placeholders match by their literal words. n_windows and n_slots are taken over the
    consistent alignments.

    Null texts and texts without letters and digits match nothing;
    repeated rows of a document or item are one. Rows with a null id are left out. Other columns are not looked at.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).where("item_id is not null and text is not null").distinct()
    items = _words(items.withColumn("key", F.xxhash64("text")), "item_id", "key").where(F.exists("plain", lambda w: w != ""))
    items = items.withColumn("item", F.struct(F.col("key").alias("text"), F.size("form").alias("words"))).drop("key")
    short = sorted(r[0] for r in items.where(F.col("item.words") < WINDOW).select("item.words").distinct().collect())
    theirs = _exploded(items, _windows(WINDOW), "item_id", "item")
    for n in short:
        theirs = theirs.unionByName(_exploded(items.where(F.col("item.words") == n), _windows(n), "item_id", "item"))
    theirs = theirs.select("item_id", "item", "hash", F.col("at").alias("item_at"), F.col("slots").alias("theirs"))
    small = theirs.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    texts = _words(texts.withColumn("doc", F.xxhash64("text")), "doc_id", "doc")
    every = F.concat(*(_windows(n) for n in (WINDOW, *short))) if short else _windows(WINDOW)
    mine = _exploded(texts, every, "doc_id", "doc").withColumnRenamed("slots", "mine")
    # Windows of equal hash have their slots at the same places.
    met = mine.join(F.broadcast(theirs) if small else theirs, "hash").withColumn("slots", F.arrays_zip("theirs", "mine"))
    aligned = met.groupBy("doc_id", "item_id", "doc", "item", (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.collect_set(F.struct("doc", "at")).alias("places"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots")
    )
    consistent = F.size(F.array_distinct(F.transform("slots", lambda s: s["theirs"]))) == F.size("slots")
    together = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c)))).cast("long")
    pairs = aligned.where(consistent).groupBy("doc_id", "item_id").agg(together("places").alias("n_windows"), together("slots").alias("n_slots"), F.min("item.words").alias("item_words"))
    return pairs.where((F.col("n_windows") >= 2) | (F.col("item_words") <= SHORT_ITEM)).select("doc_id", "item_id", "n_windows", "n_slots")
