"""Benchmark decontamination by winnowing, with DataFrame functions only.

A window is ``WINDOW`` consecutive words of an item. Of every ``WINDOW`` words, here and there, the smallest hash of the
``GRAM``-word grams in them is kept: two equal windows keep the same one, so every shared span of ``WINDOW`` words or more
gives a match between the fingerprints of a document and an item. Texts with a match are extended on the words themselves: their
windows are joined with those of the items, which settles exactly which occur and which words they cover. Items with fewer
words than a window are one window each, fingerprinted by all grams of their length.

Equal texts are looked at once. The fingerprints of an item are few, but their number isn't bounded: whether they are broadcast
or shuffled is left to Spark, which knows their size; the keys of contaminated texts are broadcast behind a check of their number.
Document words are lower-cased with Spark's own ``lower`` for fingerprints (which can only add candidates) and A-Z alone for the
extension.

Defined results: a null text has no words, and an item without words no windows; a null item_id is named 'null'; rows that
repeat an item count once; rows that repeat a document are reported one by one; without items every document is clean;
an empty table gives no rows; other columns are ignored (``report``) or kept (``clean_documents``), whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import attached, bind, own_columns, staged, table

WINDOW, GRAM = 10, 5
KEY = ("__text", "__text2", "__size")
#: Separators before lower-casing; A-Z are then words' letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def _ascii_words(text: Column) -> Column:
    return _words(F.translate(text, UPPER, LOWER))


def _grams(hashes: Column, n: int) -> Column:
    """A hash of every n consecutive ones."""
    return F.transform(F.sequence(F.lit(0), F.size(hashes) - n), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(n)]))


def _fingerprints(text: Column, short: list[int]) -> Column:
    """Distinct (kind, hash): kind is WINDOW for kept minima, or the length of short items."""

    def of_kind(hashes: Column, kind: int) -> Column:
        return F.transform(hashes, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("hash")))

    def of(h: Column) -> Column:
        minima = F.when(
            F.size(h) >= WINDOW,
            bind(_grams(h, GRAM), lambda g: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(g) - (WINDOW - GRAM)), lambda j: F.array_min(F.slice(g, j, WINDOW - GRAM + 1))))),
        ).otherwise(F.array().cast("array<bigint>"))
        kinds = [of_kind(minima, WINDOW)]
        for n in short:
            own = F.when(F.size(h) >= n, F.array_distinct(_grams(h, n))).otherwise(F.array().cast("array<bigint>"))
            kinds.append(of_kind(own, n))
        return F.concat(*kinds)

    return bind(F.transform(_words(text), lambda w: F.xxhash64(F.lower(w))), of)


def _windows(words: Column, n: int | Column) -> Column:
    """Every n consecutive words as one text."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """item (its id as text), text and size of its windows, for items with words."""
    own = own_columns(benchmark, "item_id", "text").select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text").distinct()
    sized = own.withColumn("size", F.size(_ascii_words(F.col("text")))).where("size > 0")
    return sized.select("item", "text", F.least("size", F.lit(WINDOW)).alias("window"))


def item_windows(items: DataFrame) -> DataFrame:
    """window, words and item of every window."""
    return items.select("item", "window", F.explode(_windows(_ascii_words(F.col("text")), F.col("window"))).alias("words")).distinct()


def with_key(docs: DataFrame) -> DataFrame:
    """docs with the columns KEY, by which equal texts are one: two hashes and the length. Null for a null text."""
    there = F.col("text").isNotNull()
    return docs.withColumns({"__text": F.when(there, F.xxhash64("text")), "__text2": F.when(there, F.hash("text")), "__size": F.length("text")})


def near_texts(docs: DataFrame, items: DataFrame, short: list[int]) -> DataFrame:
    """The keys of the texts that share a fingerprint with an item."""
    marked = items.select("window", F.explode(_fingerprints(F.col("text"), short)).alias("f")).where("f.kind = window").select("window", F.col("f.hash").alias("hash")).distinct()
    found = with_key(own_columns(docs, "text")).where("__size > 0").select(*KEY, F.explode(_fingerprints(F.col("text"), short)).alias("f"))
    return found.select(*KEY, F.col("f.kind").alias("window"), F.col("f.hash").alias("hash")).join(marked, ["window", "hash"], "left_semi").select(*KEY).distinct()


def _covered(starts: Column) -> Column:
    """How many words sorted spans cover."""
    none = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    longer = lambda acc, s: F.struct(F.greatest(acc["end"], s["end"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["end"], s["start"]))).alias("n"))
    return F.aggregate(starts, none, longer)["n"]


def contaminated_texts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """KEY, n_hit, n_items and items_sha256 of every distinct text in which a window occurs. Hits are joined as rows; what is
    gathered for a text is no longer than the text or its list of items."""
    items = staged(benchmark_items(benchmark), "items")
    short = sorted(r[0] for r in items.where(F.col("window") < WINDOW).select("window").distinct().collect())  # nine numbers at most
    texts = attached(with_key(own_columns(docs, "text")), near_texts(docs, items, short), list(KEY), "left_semi", "near").groupBy(*KEY).agg(F.first("text").alias("text"))
    split = texts.select(*KEY, _ascii_words(F.col("text")).alias("all"))
    windows = item_windows(items)
    at = [split.select(*KEY, F.lit(n).alias("window"), F.posexplode(_windows(F.col("all"), n)).alias("start", "words")) for n in (*short, WINDOW)]
    hits = staged(reduce(DataFrame.unionByName, at).join(windows.select("window", "words").distinct(), ["window", "words"], "left_semi"), "hits")
    spans = hits.groupBy(*KEY).agg(_covered(F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("window")).alias("end"))))).alias("n_hit"))
    named = hits.select(*KEY, "window", "words").distinct().join(windows, ["window", "words"]).groupBy(*KEY).agg(F.array_sort(F.collect_set("item")).alias("found"))
    return spans.join(named, list(KEY)).select(*KEY, "n_hit", F.size("found").cast("long").alias("n_items"), F.sha2(F.array_join("found", ","), 256).alias("items_sha256"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    own = own_columns(docs, "doc_id", "text")
    counted = with_key(own).select("doc_id", F.size(_words(F.col("text"))).cast("long").alias("n_words"), *KEY)
    return attached(counted, contaminated_texts(own, benchmark), list(KEY), "left", "contaminated").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no window of an item occurs."""
    whole = with_key(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "text")).drop("text")
    return attached(whole, contaminated_texts(docs, benchmark).select(*KEY), list(KEY), "left_anti", "contaminated").select("__row.*")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(string_split_regex(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
    list_filter(string_split_regex(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
bw AS (SELECT item, least(len(w), 10) AS n, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM bw),
sizes AS (SELECT DISTINCT n FROM windows),
dw AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT dw.r, dw.i, dw.n, windows.item FROM (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM dw) dw JOIN windows USING (n, t)),
covered AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
