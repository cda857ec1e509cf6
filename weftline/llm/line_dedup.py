"""Line dedup: an exact set-similarity join of lines, with DataFrame functions only.

A line's tokens are its distinct words (``[^\\x20\\x09-\\x0D]+``, unchanged). A line is removed if an earlier line of the corpus
(smaller doc_id, or earlier in its document) has a Jaccard similarity of ``SIMILAR`` percent or more with it. Lines are
judged on the input, not on what is left.

1. Words are counted in 2**``SKETCH_BITS`` counters, a fixed number; their ranks (four for each doubling) go into the plan as one
   array. Tokens are ordered by rank, then by hash; any one order is right, a good one begins with rare words.
2. Lines with equal sets become one node at once.
3. Prefix filter: similar sets share one of their first n - ceil(0.8 n) + 1 tokens. A tile holds the nodes of one such token and
   one doubling of sizes (a set near the top of its doubling is also a guest in the next).
4. Two sets of a tile make a pair only if sizes (length filter), what follows the shared token in both (positional filter) and
   parities of 128 bits allow it: each token turns one bit, so every bit that differs is a token that only one of them has.
5. In tiles of up to ``SMALL`` nodes all pairs are looked at. Larger ones are dealt anew by two shared tokens (sets that are similar
   share a second one among one more token). In what is still large each node meets the earliest; the nodes that
   this doesn't settle meet all others of it, in blocks of ``BLOCK``.
6. Pairs left are held against the overlap of 32-bit hashes of all words, which bounds that of the words. Every pair that this leaves
   is verified on the words of both lines, one pair of each line first.

No pair is left out but by a bound. Sets of fewer than four words are similar only if they are equal.

Defined results: a null text has no lines and stays null; a line without words is never removed; rows that repeat a doc_id
are ordered by a hash of their texts, and rows equal in both are one document with one result; a null doc_id comes first;
an empty table gives no rows; a document may be left with an empty text but stays; columns beside text are kept, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import bind, own_columns, release, staged, table

SIMILAR = 80
SKETCH_BITS, CHUNK = 18, 1024
SMALL, BLOCK = 256, 1024
LOW = (1 << 56) - 1
PLACE = ("doc_id", "text_hash", "line")
ROW = ("node", "n", "pos", "bits", "bits2")


def _blanks(text: Column) -> Column:
    """Other white space but line ends as blanks."""
    odd = "\t\x0b\x0c\r"
    return F.when(reduce(Column.__or__, [F.contains(text, F.lit(c)) for c in odd]), F.translate(text, odd, " " * len(odd))).otherwise(text)


def _words(line: Column) -> Column:
    several = F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    return F.when(several, F.array_remove(F.split(line, " "), "")).otherwise(F.split(line, " "))


def word_ranks(docs: DataFrame) -> Column:
    """By the top bits of a word's hash, about how common it is: a literal array of a fixed size."""
    word = docs.select(F.explode(F.split(F.replace(_blanks(F.col("text")), F.lit("\n"), F.lit(" ")), " ")).alias("word"))
    counts = word.groupBy(F.shiftrightunsigned(F.xxhash64("word"), 64 - SKETCH_BITS).alias("bucket")).count()
    parts = counts.groupBy(F.expr(f"bucket div {CHUNK}").alias("part")).agg(F.array_join(F.collect_list(F.concat_ws(":", F.pmod("bucket", F.lit(CHUNK)), "count")), " ").alias("counts"))
    ranks = ["0"] * (1 << SKETCH_BITS)
    for part, found in parts.collect():  # 2**SKETCH_BITS / CHUNK rows
        for k, n in (x.split(":") for x in found.split()):
            ranks[part * CHUNK + int(k)] = str(min(127, int(4 * log2(int(n) + 1))))
    return F.split(F.lit(",".join(ranks)), ",").cast("array<bigint>")


def line_sets(docs: DataFrame) -> DataFrame:
    """Every line that has a word: its place, a number of its own, its set's size and two digests, the tokens (31 bits of each) of one more than its
    prefix, and the parities of all tokens and of those with one bit set."""
    own = own_columns(docs, "doc_id", "text").where("text is not null")
    ranks = word_ranks(own)
    lines = own.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split(_blanks(F.col("text")), "\n")).alias("line", "words"))
    hashes = lines.where(F.ltrim("words") != "").select(*PLACE, F.array_distinct(F.transform(_words(F.col("words")), lambda w: F.xxhash64(w))).alias("hashes"))
    rank = lambda h: F.get(ranks, F.shiftrightunsigned(h, 64 - SKETCH_BITS).cast("int"))
    token = lambda h: F.coalesce(F.shiftleft(rank(h), 56).bitwiseOR(h.bitwiseAND(F.lit(LOW))), h)  # noqa: E731 (never null, so sorted as plain numbers)
    sets = hashes.select(*PLACE, F.sort_array(F.transform("hashes", token)).alias("set"))
    n = F.size("set")

    def parities(bit: Callable[[Column], Column]) -> Column:
        return F.aggregate("set", F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(F.call_function("shiftleft", bit(x), x.bitwiseAND(F.lit(63)).cast("int"))))

    prefix = F.slice("set", 1, n - F.expr(f"({SIMILAR} * size(set) + 99) div 100").cast("int") + 2)
    tokens = F.transform(prefix, lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))
    return sets.select(*PLACE, F.monotonically_increasing_id().alias("node"), n.alias("n"), F.xxhash64("set").alias("digest"), F.hash("set").alias("digest2"), tokens.alias("prefix"), parities(lambda _: F.lit(1).cast("long")).alias("bits"), parities(lambda x: F.shiftright(x, 6).bitwiseAND(F.lit(1))).alias("bits2"))


def distinct_sets(sets: DataFrame) -> DataFrame:
    """A row for each distinct set, with its first line's place and number. doc: the doc_id as a number that sorts alike."""
    first = F.min(F.struct(*PLACE, "node", "prefix", "bits", "bits2")).alias("first")
    return sets.groupBy("n", "digest", "digest2").agg(first).select("first.*", F.coalesce("first.doc_id", F.lit(-(2**63))).alias("doc"), "n")


def _needed(n: str, m: str) -> str:
    """The least overlap of two similar sets of these sizes."""
    return f"(({SIMILAR} * ({n} + {m}) + {99 + SIMILAR}) div {100 + SIMILAR})"


def tiles(nodes: DataFrame) -> DataFrame:
    """A row for each node and token of its prefix in each of its size bands. A guest is the smaller set of each of its pairs there, so
    it needs fewer tokens."""
    own = nodes.where("n >= 4").withColumns({"band": F.length(F.bin("n")) - 1, "most": F.size("prefix") - 1})
    guest = f"named_struct('band', band + 1, 'most', cast(least(most, n + 1 - {_needed('n', 'shiftleft(2L, band)')}) as int))"
    bands = F.expr(f"if(100 * n >= {SIMILAR} * shiftleft(2L, band), array(named_struct('band', band, 'most', most), {guest}), array(named_struct('band', band, 'most', most)))")
    banded = own.select("node", "n", "bits", "bits2", "prefix", F.explode(bands).alias("in"))
    rows = banded.select("node", "n", "bits", "bits2", "in.band", F.posexplode(F.slice("prefix", F.lit(1), F.col("in.most"))).alias("pos", "token"))
    return rows.select(F.shiftleft(F.col("token").cast("long"), 8).bitwiseOR(F.col("band")).alias("tile"), *ROW)


def finer(large: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of large tiles, one for each later token of the prefix and the one beyond it; with the doc_id."""
    rows = large.select("tile", "node", F.col("pos").alias("at")).join(nodes.select("node", "doc", "n", "bits", "bits2", "prefix"), "node")
    later = rows.select("tile", "node", "doc", "n", "bits", "bits2", "at", F.posexplode("prefix").alias("pos", "token")).where("pos > at")
    return later.select(F.xxhash64("tile", "token").alias("tile"), *ROW, "doc")


def sized(rows: DataFrame, first: Column) -> DataFrame:
    """Those rows of tiles that hold several nodes, with their number, and the least ``first`` as hub."""
    of_tile = Window.partitionBy("tile")
    return rows.select("*", F.count("*").over(of_tile).alias("nodes"), F.min(first).over(of_tile).alias("hub")).where("nodes > 1")


def could_match(shared: int) -> Column:
    """By the bits that differ, the sizes, and what can follow the last of ``shared`` shared tokens in both. a: node, n, ...; b: node_b,
    n_b, ... What tells most pairs apart without a division comes first."""
    both, differ = "(n + n_b)", "(bit_count(bits ^ bits_b ^ bits2 ^ bits2_b) + bit_count(bits2 ^ bits2_b))"
    return F.expr(
        f"{100 + SIMILAR} * {differ} <= {100 - SIMILAR} * {both} and 100 * least(n, n_b) >= {SIMILAR} * greatest(n, n_b)"
        f" and {100 + SIMILAR} * (least(n - pos, n_b - pos_b) + {shared - 1}) >= {SIMILAR} * {both} and {both} - {differ} >= 2 * {_needed('n', 'n_b')}"
    )


def _second(rows: DataFrame, *keys: str | Column) -> DataFrame:
    return rows.select(*keys, *[F.col(c).alias(f"{c}_b") for c in ROW])


def small_tile_pairs(rows: DataFrame) -> DataFrame:
    """tile, a, b: the pairs of small tiles, and for each large one a row in which a and b are its hub. rows: as ``sized`` gives them, with
    the least node as hub. In a pair, a is the larger set (of equal ones the later node) and no guest, as two guests meet in their own band;
    the shared token of b has to stand where it could if a were no larger than b."""
    large = F.col("nodes") > SMALL
    chosen = rows.where(~large | (F.col("node") == F.col("hub")))  # one exchange for both sides
    own = chosen.where(large | F.expr("length(bin(n)) - 1 = (tile & 255)"))
    others = chosen.where(large | F.expr(f"n - pos >= {_needed('n', 'n')}"))
    smaller = (F.col("n_b") < F.col("n")) | (F.col("n_b") == F.col("n")) & (F.col("node_b") < F.col("node"))
    met = ~large & smaller & could_match(1) | large & (F.col("node_b") == F.col("node"))
    return own.join(_second(others, "tile"), "tile").where(met).select("tile", F.col("node").alias("a"), F.col("node_b").alias("b"))


def hub_pairs(rows: DataFrame) -> DataFrame:
    """a, b: the pairs of small tiles, and in large ones each node with the hub, the one of the least doc_id."""
    large = F.col("nodes") > SMALL
    others = _second(rows.where(~large | (F.col("node") == F.col("hub.node"))), "tile")
    met = F.when(large, F.col("node_b") != F.col("node")).otherwise(F.col("node_b") < F.col("node")) & could_match(2)
    return rows.join(others, "tile").where(met).select(F.col("node").alias("a"), F.col("node_b").alias("b"))


def block_pairs(rows: DataFrame, open_nodes: DataFrame) -> DataFrame:
    """a, b: an open node with all of its large tiles that don't come later, in blocks."""
    blocks = rows.withColumn("blocks", F.expr(f"(nodes + {BLOCK - 1}) div {BLOCK}"))
    others = _second(blocks.withColumn("block", F.pmod(F.xxhash64("node"), "blocks")), "tile", "block", F.col("doc").alias("doc_b"))
    probes = blocks.join(open_nodes, "node", "left_semi").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = (F.col("doc_b") <= F.col("doc")) & (F.col("node_b") != F.col("node")) & could_match(2)
    return probes.join(others, ["tile", "block"]).where(met).select(F.col("node").alias("a"), F.col("node_b").alias("b"))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"__id": F.coalesce("doc_id", F.lit(0)), "__no_id": F.col("doc_id").isNull(), "__hash": F.xxhash64("text")})


def by_document(rows: DataFrame, value: Column) -> DataFrame:
    """value of all rows of a document, as a list; no longer than its lines."""
    lists = rows.groupBy("doc_id", "text_hash").agg(F.collect_set(value).alias("__lines"))
    return lists.select(F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("doc_id").isNull().alias("__no_id"), F.col("text_hash").alias("__hash"), "__lines").hint("shuffle_hash")


def line_texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n, text and place of the first lines of nodes, and 32 bits of each of their words."""
    key = ["__id", "__no_id", "__hash"]
    found = keyed(own_columns(docs, "doc_id", "text")).join(by_document(nodes, F.struct("node", "n", "line")), key).dropDuplicates(key)
    lines = bind(F.split(_blanks(F.col("text")), "\n"), lambda all_: F.transform("__lines", lambda x: F.struct(x["node"].alias("node"), x["n"].alias("n"), x["line"].alias("line"), F.get(all_, x["line"]).alias("words"))))
    each = found.select("doc_id", F.col("__hash").alias("text_hash"), F.inline(lines))
    return each.withColumn("hashes", F.array_distinct(F.transform(_words(F.col("words")), lambda w: F.hash(w))))


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def likely(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (later, earlier) whose words' hashes overlap enough. Two words of one line may share a hash: such a line has fewer
    hashes than words, and the overlap of words is larger than that of hashes by no more than this."""
    a, b = [texts.select(F.col("node").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("n", "hashes")]) for c in ("later", "earlier")]
    both = pairs.join(a, "later").join(b, "earlier")
    alike = f"size(array_intersect(hashes_later, hashes_earlier)) + least(n_later - size(hashes_later), n_earlier - size(hashes_earlier)) >= {_needed('n_later', 'n_earlier')}"
    return both.where(alike).select("later", "earlier")


def in_order(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """later, earlier: the pairs by the places of their lines."""
    a, b = [texts.select(F.col("node").alias(c), F.struct(*PLACE).alias(f"at_{c}")) for c in ("a", "b")]
    swapped = F.col("at_b") < F.col("at_a")
    return pairs.join(a, "a").join(b, "b").select(F.when(swapped, F.col("a")).otherwise(F.col("b")).alias("later"), F.when(swapped, F.col("b")).otherwise(F.col("a")).alias("earlier"))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """node: the later one of each of the pairs whose sets overlap enough."""
    a, b = [texts.select(F.col("node").alias(c), F.col("words").alias(f"words_{c}")) for c in ("later", "earlier")]
    sets = F.struct(*[F.array_distinct(_words(F.col(c))).alias(c) for c in ("words_later", "words_earlier")])
    both = pairs.join(a, "later").join(b, "earlier").select("later", F.inline(F.array(sets)))  # made once for each pair
    common = F.size(F.array_intersect("words_later", "words_earlier"))
    alike = both.where(bind(common, lambda c: 100 * c >= SIMILAR * (F.size("words_later") + F.size("words_earlier") - c)))
    return alike.select(F.col("later").alias("node")).distinct()


def matched(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The later one of each of the pairs that are similar: one pair of each node first, then the other pairs of those that it hasn't
    settled, each ``likely`` ones by hashes before words are compared."""
    pairs = staged(in_order(pairs, texts), "pairs")
    one = staged(verified(likely(pairs.groupBy("later").agg(F.min("earlier").alias("earlier")), texts), texts), "matched")
    rest = pairs.join(one.select(F.col("node").alias("later")), "later", "left_anti")
    return one.unionByName(staged(verified(likely(rest, texts), texts), "matched"))


def removed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and line of every line to remove."""
    spark = docs.sparkSession
    sets = staged(line_sets(docs), "lines")
    nodes = staged(distinct_sets(sets), "nodes")
    release(spark)
    first = staged(small_tile_pairs(sized(tiles(nodes), F.col("node"))), "pairs")
    release(spark)
    large = staged(first.where("a = b").select("tile"), "large")  # so Spark knows its size
    large = tiles(nodes).select("tile", "node", "pos").join(large, "tile", "left_semi")
    second = staged(sized(finer(large, nodes), F.struct("doc", "node")), "tiles")
    release(spark)
    tried = staged(distinct_pairs(first.select("a", "b").unionByName(hub_pairs(second))), "pairs")
    crowded = second.where(F.col("nodes") > SMALL)
    asked = tried.select(F.explode(F.array("a", "b")).alias("node")).union(crowded.select("node")).distinct()
    texts = staged(line_texts(docs, nodes.join(asked, "node", "left_semi")), "texts")
    release(spark)
    settled = matched(tried, texts)
    release(spark)
    open_nodes = crowded.select("node").distinct().join(settled, "node", "left_anti")
    rest = distinct_pairs(block_pairs(crowded, open_nodes)).join(tried, ["a", "b"], "left_anti")
    kept = nodes.join(settled.unionByName(matched(rest, texts)), "node", "left_anti")
    release(spark)
    same = [sets["doc_id"].eqNullSafe(kept["doc_id"]), *[sets[c] == kept[c] for c in PLACE[1:]]]  # never null
    return sets.join(kept.select(*PLACE).hint("shuffle_hash"), same, "left_anti").select(*PLACE)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the kept lines as text, and the array __removed of removed line numbers (null: none)."""
    gone = by_document(removed_lines(docs), F.col("line"))
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    whole = keyed(docs.select("doc_id", "text", (F.struct(*others) if others else F.lit(0)).alias("__row")))
    joined = whole.join(gone, ["__id", "__no_id", "__hash"], "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__lines", i)), "\n")
    return joined.select("__row", "doc_id", F.when(F.col("__lines").isNull(), F.col("text")).otherwise(kept).alias("text"), (1 + F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))).alias("all_lines"), F.col("__lines").alias("removed"))


def without_repeats(docs: DataFrame) -> DataFrame:
    found = dedup_lines(docs)
    return found.select(*[F.col(c) if c in ("doc_id", "text") else F.col("__row")[c].alias(c) for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the hash of the text that is left, for every row of docs."""
    return dedup_lines(own_columns(docs, "doc_id", "text")).select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.col("all_lines")).cast("long").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
