"""Benchmark decontamination by winnowing (Schleimer, Wilkerson, Aiken 2003), all in the JVM.

Of each window of ``window`` words the least hash of its k-grams is kept.  Equal
windows keep equal hashes, so every shared window has a fingerprint in common
and joining the fingerprints of documents and items finds it, wherever it
stands.

1. documents are written once as their kept places (hash, length, place), without
   words; 2. the places meet the hashes of the benchmark, by a broadcast if those
pass a check of their size and by a shuffle beyond it; 3. the words around a place
are cut out only in documents that met one, and a pair of places is extended
word by word to the windows that really agree, which rules out chance collisions;
4. documents without hits are kept by a left join, never by a key of their own.

A document is known by its id and the hash of its text, both of which a task
that runs again finds the same; rows equal in both share their result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.native_words import let, letter_words
from sheaf.llm.tables import integral, light, small, written

#: Fingerprints of the benchmark that may be broadcast.
BROADCAST_FINGERPRINTS = 200_000


def _some(words: Column, start: Column, n: int) -> list[Column]:
    """Elements one by one: ``slice`` would copy the whole list each time."""
    return [F.get(words, start + j) for j in range(n)]


def _places(words: Column, k: int, window: int, short: list[int]) -> Column:
    """The kept places of bound ``words``: structs of hash, length of the window and place (from 0)."""
    span = window - k
    n = F.size(words)
    grams = F.transform(words, lambda w, i: F.xxhash64(w, *_some(words, i + 1, k - 1)))
    place = lambda h, m, p: F.struct(h.alias("hash"), F.lit(m).alias("length"), p.alias("place"))

    def kept(g: Column) -> Column:
        least = F.transform(F.sequence(F.lit(0), n - window), lambda s: F.least(*_some(g, s, span + 1)))
        # A place is kept if it has the least hash of a window that holds it.
        return let(least, lambda m: F.transform(F.filter(F.sequence(F.lit(0), n - k), lambda p: F.get(g, p) == F.greatest(*_some(m, p - span, span + 1))), lambda p: place(F.get(g, p), window, p)))

    whole = lambda m: lambda p: place(F.xxhash64(F.lit(m), *_some(words, p, m)), m, p)
    out = F.when(n >= window, let(grams, kept)).otherwise(F.array())
    for m in short:
        out = F.concat(out, F.when(n >= m, F.transform(F.sequence(F.lit(0), n - m), whole(m))).otherwise(F.array()))
    return out


def _around(words: Column, places: Column, k: int, window: int, short: list[int]) -> Column:
    """``places`` of bound ``words`` with the words around each, and how many of them come before."""
    span = window - k
    before = F.when(F.lit(window) == places["length"], F.lit(span)).otherwise(F.lit(0))
    around = F.when(places["length"] == window, F.array(*_some(words, places["place"] - span, span + window)))
    for m in short:
        around = around.when(places["length"] == m, F.array(*_some(words, places["place"], m)))
    return F.struct(places["hash"].alias("hash"), places["length"].alias("length"), places["place"].alias("place"), around.alias("around"), before.alias("before"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 4, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_words, n_hit, n_items, items_sha256, contaminated, spans (merged [from, to) of hit words), text_hash.

    A window is ``window`` consecutive item words; a shorter item that has words
    is one window.  Null or empty texts have no words.  An item without an id hits
    words but is not listed; rows of one item id count once; an empty benchmark
    hits nothing.  Repeated and null document ids stay separate rows.
    """
    items = benchmark.select(F.col(item_col).alias("item"), letter_words(F.col(item_text_col)).alias("words")).where(F.size("words") > 0)
    # At most window - 1 numbers.
    short = sorted(r[0] for r in items.where(F.size("words") < window).select(F.size("words")).distinct().collect())
    cut = lambda w: F.transform(_places(w, k, window, short), lambda p: _around(w, p, k, window, short))
    known = items.select("item", let(F.col("words"), lambda w: F.struct(F.size(w).alias("whole"), cut(w).alias("places"))).alias("of")).select("item", "of.whole", "of.places").select("item", "whole", F.explode("places").alias("t"))
    known = known.where((F.col("t.length") == window) | (F.col("t.length") == F.col("whole")))
    known = written(known.select("item", *(F.col(f"t.{c}").alias(f"t_{c}") for c in ("hash", "length", "around", "before"))).distinct(), "fingerprints")

    source = docs.select(integral(docs, id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    found = let(letter_words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _places(w, k, window, short).alias("places")))
    rows = written(source.select("id", "text_hash", found.alias("of")).select("id", "text_hash", "of.n_words", "of.places"), "places")
    # The places that any fingerprint of the benchmark has, by document.
    prints = known.select(F.col("t_hash").alias("hash"), F.col("t_length").alias("length")).distinct()
    each = rows.select("id", "text_hash", F.explode("places").alias("d")).select("id", "text_hash", "d.hash", "d.length", "d.place")
    met = each.join(small(prints, BROADCAST_FINGERPRINTS), ["hash", "length"], "left_semi")
    met = written(met.groupBy("id", "text_hash").agg(F.collect_set(F.struct("hash", "length", "place")).alias("places")), "met")
    one = F.coalesce(source["id"], F.lit(0)) == F.coalesce(met["id"], F.lit(0))
    texts = source.join(light(met, 24 * F.size("places")), one & (source["id"].isNull() == met["id"].isNull()) & (source["text_hash"] == met["text_hash"])).select(met["id"], met["text_hash"], "text", "places").dropDuplicates(["id", "text_hash"])
    looked = texts.select("id", "text_hash", let(letter_words(F.col("text")), lambda w: F.transform(F.col("places"), lambda p: _around(w, p, k, window, short))).alias("places"))
    looked = looked.select("id", "text_hash", F.explode("places").alias("d")).select("id", "text_hash", *(F.col(f"d.{c}").alias(f"d_{c}") for c in ("hash", "length", "place", "around", "before")))
    pairs = looked.join(light(known, F.lit(16) * (2 * window - k)), (F.col("d_hash") == F.col("t_hash")) & (F.col("d_length") == F.col("t_length")))
    # Steps back from the place at which all words of a window agree.
    same = F.zip_with("d_around", "t_around", lambda a, b: F.coalesce(a == b, F.lit(False)))
    backs = let(same, lambda e: F.filter(F.sequence(F.lit(0), F.col("d_before")), lambda j: F.forall(F.sequence(F.lit(0), F.col("d_length") - 1), lambda i: F.get(e, F.col("d_before") - j + i))))
    hits = pairs.select("id", "text_hash", "item", F.col("d_length").alias("length"), F.explode(F.transform(backs, lambda j: F.col("d_place") - j)).alias("start"))
    whole = hits.groupBy("id", "text_hash").agg(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("stop")))).alias("windows"),
        F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"),
    )
    # Windows in order: a span begins where no earlier window reaches; one that does starts at most ``window`` words before.
    near = window * (len(short) + 1)
    kind = "array<struct<start:int,stop:int>>"
    earlier = lambda i: F.filter(F.sequence(F.greatest(i - near, F.lit(0)), i), lambda j: j < i)
    reach = F.transform("windows", lambda w, i: ~F.exists(earlier(i), lambda j: F.get("windows", j)["stop"] >= w["start"]))
    spans = whole.withColumn("reach", reach).withColumn("at", F.filter(F.sequence(F.lit(0), F.size("windows") - 1), lambda i: F.get("reach", i)))
    ends = lambda i: F.when(i + 1 < F.size("at"), F.get(F.col("at"), i + 1)).otherwise(F.size("windows"))
    merged = F.transform("at", lambda a, i: F.struct(F.get("windows", a)["start"].alias("start"), F.array_max(F.transform(F.slice("windows", a + 1, ends(i) - a), lambda w: w["stop"])).alias("stop")))
    spans = spans.select(F.col("id").alias("of"), F.col("text_hash").alias("of_hash"), "items", merged.cast(kind).alias("spans"))
    spans = light(written(spans, "hits"), 8 * F.size("spans") + 24 * F.size("items"))
    out = rows.select("id", "text_hash", "n_words").join(spans, (F.coalesce("id", F.lit(0)) == F.coalesce("of", F.lit(0))) & (F.col("id").isNull() == F.col("of").isNull()) & (F.col("text_hash") == F.col("of_hash")), "left")
    out = out.withColumn("spans", F.coalesce("spans", F.array().cast(kind))).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, w: a + (w["stop"] - w["start"]))
    return out.select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"), "spans", "text_hash",
    )
