"""N-gram Jaccard join: documents whose sets of distinct ``GRAM``-word shingles overlap by ``SIMILAR`` percent or more.

1. A sketch of 2**``SKETCH_BITS`` counters (fixed in size) tells about how common every shingle is. Shingles are ordered from
   rare to common, then by hash; any such order is right, a good one keeps passages that many documents share out of the
   prefixes.
2. Documents with equal sets become one node. Linked sets share a shingle among the first n - ceil(0.8 n) + 1 of each.
3. Prefix shingles make tiles by size band (a doubling; a set near the top of its band is also a guest in the next).
   The rows are sorted by tile in ranges that may cut through a tile, and those alone in theirs are dropped.
4. Every set is compared with the first of each of its tiles. Groups of near copies become components at once, with as
   many comparisons as rows.
5. ``ROUNDS`` times, every set outside its tile's largest component is compared with one member of that component, another
   one each time, and the components are joined by the links found. This again takes as many comparisons as rows, and leaves
   few sets of a large group of near copies outside.
6. In tiles that still hold several components, all sets outside a tile's largest component are compared with everything
   in the tile that isn't of their component, in blocks of ``BLOCK`` rows: by length, by position, and by bitmap signatures, where the
   bits that differ bound the overlap from above.
7. The pairs of 4 and 5 are held against the same bitmaps. What is left in 4, 5 and 6 is decided on the sorted shingle arrays of both texts. Labels come from the links found.

No link is lost: a pair is left out only by a bound, or because it is in one component already.

Defined results: null or empty texts and those without words have the empty set, no links and their own id; fewer words
than GRAM are one shingle; a null doc_id can be linked but is never a component's id unless the component has no other;
rows that repeat a document get the same result each; an empty table gives no rows; other columns are ignored
(``classes``) or kept (``one_of_each``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import attached, bounded_batches, own_columns, release, staged, table
from weftline.llm.components import components
from weftline.llm.textarrays import U64, Texts, gram_hashes, mixed, range_hashes

GRAM, SIMILAR = 5, 80
SKETCH_BITS, CHUNK_BITS = 20, 16
BLOCK, LEAST_BITS, ROUNDS = 2048, 1024, 2
SETS = "doc_id long, text_hash long, n long, digest long, digest2 long, prefix array<long>"


def shingles(column: pa.Array, gram: int = GRAM, lower: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
    """The number of the text and the hash of every shingle of a batch, repeats included."""
    t = Texts(column, lower=lower)
    words = t.word_hashes()
    at = np.flatnonzero(t.same_text(gram))
    text, hashes = t.text[at], gram_hashes(words, gram)[at]
    few = np.flatnonzero((t.n_words > 0) & (t.n_words < gram))
    if len(few):
        whole = range_hashes(words, t.word_at[few], t.word_at[few] + t.n_words[few])
        order = np.argsort(np.concatenate((text, few)), kind="stable")
        text, hashes = np.concatenate((text, few))[order], np.concatenate((hashes, whole))[order]
    return text, hashes, t.n


def distinct_sorted(text: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values, rising, and where each text's begin."""
    order = np.lexsort((values, text))
    text, values = text[order], values[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    return values[new], np.searchsorted(text[new], np.arange(n + 1))


def shingle_ranks(docs: DataFrame, found: Callable[[pa.Array], tuple[np.ndarray, np.ndarray, int]] = shingles) -> np.ndarray:
    """By the top bits of a shingle's hash, about how common it is: 8 steps for each doubling. found: the shingles of a batch."""
    bounded_batches(docs.sparkSession)
    size, chunk = 1 << SKETCH_BITS, 1 << CHUNK_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.int64)
        for b in batches:
            _, hashes, _ = found(b.column(0))
            seen += np.bincount((hashes >> U64(64 - SKETCH_BITS)).astype(np.int64), minlength=size)
        if seen.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size // chunk)), pa.array([x.astype("<i8" if x.max() >= 1 << 32 else "<u4").tobytes() for x in seen.reshape(-1, chunk)], pa.binary())], ["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(raw, f"<u{len(raw) // chunk}").astype(np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(total), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["chunk", "counts"])

    parts = docs.select("text").mapInArrow(count, "chunk long, counts binary").repartition(size // chunk, "chunk").mapInArrow(add, "chunk long, counts binary")
    counts = np.zeros(size, np.int64)
    for r in parts.collect():  # size // chunk rows
        counts[r["chunk"] * chunk : (r["chunk"] + 1) * chunk] = np.frombuffer(r["counts"], "<i8")
    return np.minimum(255, 8 * np.log2(counts + 1)).astype(np.uint8)


def band_of(n: np.ndarray) -> np.ndarray:
    """The whole part of the binary logarithm; 0 for the empty set."""
    return np.frexp(n)[1] - (n > 0)


def band_bits(band: int | np.ndarray) -> int | np.ndarray:
    """A signature has a bit for each member of the largest set of its band, and ``LEAST_BITS`` at least."""
    return np.maximum(LEAST_BITS, 2 ** (band + 1))


def guest(n: np.ndarray) -> np.ndarray:
    """Whether a set of n could be linked with one of the next band."""
    return 100 * n >= SIMILAR * 2 ** (band_of(n) + 1)


def needed(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The least overlap of two linked sets."""
    return -(-SIMILAR * (na + nb) // (100 + SIMILAR))


def set_arrays(text: np.ndarray, hashes: np.ndarray, n_texts: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text: its distinct shingles in order of rarity (all in one array, and where each text's begin), and two digests."""
    rank = ranks[(hashes >> U64(64 - SKETCH_BITS)).astype(np.int64)]
    tokens, at = distinct_sorted(text, (rank.astype(U64) << U64(56)) | (hashes & U64((1 << 56) - 1)), n_texts)
    digests = np.zeros((2, n_texts), U64)
    if len(tokens):
        full = np.diff(at) > 0
        digests[0, full], digests[1, full] = [np.add.reduceat(x, at[:-1][full]) for x in (mixed(tokens), mixed(tokens ^ U64(0x5851F42D4C957F2D)))]
    return tokens, at, digests[0].view(np.int64), digests[1].view(np.int64)


def prefix_lists(tokens: np.ndarray, at: np.ndarray) -> pa.Array:
    """The first n - ceil(0.8 n) + 1 of each text's n shingles."""
    n = np.diff(at)
    prefix = np.where(n > 0, n - -(-SIMILAR * n // 100) + 1, 0)
    row = np.repeat(at[:-1], prefix) + np.arange(prefix.sum()) - np.repeat(np.cumsum(prefix) - prefix, prefix)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(prefix))), pa.int32()), pa.array(tokens[row].view(np.int64)))


def shingle_sets(docs: DataFrame) -> DataFrame:
    """Every document's set: its size and digests, and its prefix in order of rarity."""
    ranks = docs.sparkSession.sparkContext.broadcast(shingle_ranks(docs))  # 2**SKETCH_BITS bytes
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, at, *digests = set_arrays(*shingles(b.column(2)), ranks.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(at)), *map(pa.array, digests), prefix_lists(tokens, at)], [x.split()[0] for x in SETS.split(", ")])

    return own_columns(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, SETS)


def nodes_of(sets: DataFrame) -> DataFrame:
    """A row for each distinct set that isn't empty: node, and the first document that has it."""
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first")
    same = sets.where("n > 0").groupBy("n", "digest", "digest2").agg(first)
    return same.select(F.monotonically_increasing_id().alias("node"), F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"), "n", "digest", "digest2")


def of_node(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """node beside the rows of its first document (one or more where a row is repeated). rows: doc_id, text_hash and others."""
    keys = {"key": F.coalesce("doc_id", F.lit(0)), "no_id": F.col("doc_id").isNull()}
    asked = nodes.withColumns(keys).select("key", "no_id", "text_hash", "node")
    return rows.withColumns(keys).join(asked, ["key", "no_id", "text_hash"])


def shared_tiles(nodes: DataFrame) -> DataFrame:
    """token, band, node, n, pos of all rows that aren't alone in their tile (and a few that are, at the edges of batches).
    nodes: node, n and prefix; a repeated row counts once."""
    bounded_batches(nodes.sparkSession)
    bands = F.when(100 * F.col("n") >= SIMILAR * F.expr("shiftleft(2L, own)"), F.array(F.col("own"), F.col("own") + 1)).otherwise(F.array("own"))
    rows = nodes.select("node", "n", "prefix", (F.length(F.bin("n")) - 1).alias("own")).select("node", "n", "prefix", F.explode(bands).alias("band"))
    rows = rows.select("node", "n", "band", F.posexplode("prefix").alias("pos", "token")).select("token", "band", "node", F.col("n").cast("int").alias("n"), "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            if b.num_rows:
                token, band, node = [b.column(k).to_numpy() for k in (0, 1, 2)]
                same = (np.diff(token) == 0) & (np.diff(band) == 0)
                new = np.concatenate(([(token[0], band[0], node[0]) != last], ~same | (np.diff(node) != 0)))
                last = token[-1], band[-1], node[-1]
                yield b.filter(pa.array(new & (np.concatenate(([True], same)) | np.concatenate((same, [True])))))

    order = ("token", "band", "node")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "token long, band int, node long, n int, pos int")


def could_link(na: Column, nb: Column, pa_: Column, pb: Column) -> Column:
    """By length, and by what can follow in both orders if this is the first shingle that the sets share."""
    least = F.ceil(F.lit(SIMILAR) * (na + nb) / F.lit(100 + SIMILAR))
    return (100 * F.least(na, nb) >= SIMILAR * F.greatest(na, nb)) & (1 + F.least(na - pa_, nb - pb) - 1 >= least)


def first_of_tile_pairs(tiles: DataFrame) -> DataFrame:
    """Each set with the first of each of its tiles: a, b."""
    hub = tiles.groupBy("token", "band").agg(F.min(F.struct("node", "n", "pos")).alias("hub"))
    pairs = tiles.join(hub, ["token", "band"]).where((F.col("node") != F.col("hub.node")) & could_link(F.col("n"), F.col("hub.n"), F.col("pos"), F.col("hub.pos")))
    return pairs.select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()  # the hub's number is the smaller one


def labelled_rows(tiles: DataFrame, labels: DataFrame) -> DataFrame:
    """tiles with the label of each row's component."""
    return tiles.join(labels.withColumnRenamed("label", "of"), "node", "left").withColumn("label", F.coalesce("of", "node")).drop("of")


def mixed_tiles(rows: DataFrame, seed: int = 0) -> DataFrame:
    """Tiles of several components: their rows, those of the largest component, its label and one of its members."""
    star = F.min_by(F.struct("node", "n", "pos"), F.struct(F.xxhash64(F.lit(seed), "node"), "node")).alias("star")
    by_label = rows.groupBy("token", "band", "label").agg(F.count("*").alias("count"), star)
    largest = F.max_by(F.struct("label", "star"), F.struct("count", "label")).alias("largest")
    of_tile = by_label.groupBy("token", "band").agg(F.sum("count").alias("all"), F.max("count").alias("most"), largest)
    return of_tile.where("all > most").select("token", "band", "all", "most", F.col("largest.label").alias("major"), "largest.star")


def star_pairs(tiles: DataFrame, labels: DataFrame, seed: int) -> DataFrame:
    """Each set outside its tile's largest component with a member of that component: a, b."""
    rows = labelled_rows(tiles, labels)
    met = rows.join(mixed_tiles(rows, seed).select("token", "band", "major", "star"), ["token", "band"])
    left = met.where((F.col("label") != F.col("major")) & could_link(F.col("n"), F.col("star.n"), F.col("pos"), F.col("star.pos")))
    return left.select(F.least("node", "star.node").alias("a"), F.greatest("node", "star.node").alias("b")).distinct()


def _folded(bits: bytes, width: int) -> np.ndarray:
    """A signature at a smaller width: positions are remainders, so halves lie over each other."""
    x = np.frombuffer(bits, np.uint8)
    while 8 * len(x) > width:
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    return x.view("<u8")


def signatures(texts: DataFrame) -> DataFrame:
    """node, the size of its set and the bitmap of its shingles, wide enough for each band in which it has tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, at = distinct_sorted(*shingles(b.column(1)))
            n, marks, bits = np.diff(at), mixed(hashes), []
            width = band_bits(band_of(n) + guest(n))
            for w, low, high in zip(width.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                seen = np.zeros(w, bool)
                seen[(marks[low:high] % U64(w)).astype(np.int64)] = True
                bits.append(np.packbits(seen, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(bits, pa.binary())], ["node", "size", "bits"])

    bounded_batches(texts.sparkSession)
    return texts.select("node", "text").mapInArrow(run, "node long, size long, bits binary")


def near(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """Those of the pairs that their bitmaps leave open: every bit that differs is a shingle that only one of them has."""
    a, b = [signed.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("bits").alias(f"bits_{c}")) for c in ("a", "b")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("size_a").to_numpy(), batch.column("size_b").to_numpy()
            apart = np.zeros(batch.num_rows, np.int64)
            for i, (x, y) in enumerate(zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist(), strict=True)):
                width = 8 * min(len(x), len(y))
                apart[i] = np.bitwise_count(_folded(x, width) ^ _folded(y, width)).sum()
            open_ = pa.array((na + nb - apart) // 2 >= needed(na, nb))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(open_) for c in ("a", "b")], ["a", "b"])

    bounded_batches(pairs.sparkSession)
    return pairs.select("a", "b").join(a, "a").join(b, "b").mapInArrow(run, "a long, b long")


def block_pairs(tiles: DataFrame, labels: DataFrame, bits: DataFrame) -> DataFrame:
    """Pairs of different components in one tile that length, position and signatures leave open: a, b."""
    spark = tiles.sparkSession
    bounded_batches(spark)
    rows = labelled_rows(tiles, labels)
    mixed_ = mixed_tiles(rows).drop("star")
    minor = F.col("label") != F.col("major")
    blocks = lambda rows_: F.ceil(rows_ / BLOCK).cast("int")
    placed = rows.join(mixed_, ["token", "band"]).withColumns({"minors": blocks(F.col("all") - F.col("most")), "blocks": blocks(F.col("all")), "spot": F.xxhash64("node")})
    targets = placed.withColumns({"k": F.pmod("spot", "blocks").cast("int"), "m": F.explode(F.sequence(F.lit(0), F.col("minors") - 1)), "probe": F.lit(False)})
    probes = placed.where(minor).withColumns({"m": F.pmod("spot", "minors").cast("int"), "k": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "probe": F.lit(True)})
    columns = ["token", "band", "m", "k", "probe", "node", "n", "pos", "label", minor.alias("minor")]
    work = targets.select(*columns).unionByName(probes.select(*columns)).join(bits.select("node", "bits"), "node")
    work = work.select("token", "band", "m", "k", "probe", "node", "n", "pos", "label", "minor", "bits")

    def compare(group: dict[str, np.ndarray]) -> np.ndarray:
        width = int(band_bits(int(group["band"][0])))
        sign = np.stack([_folded(x, width) for x in group["bits"]])
        n, room, label, minor, node = (group[k] for k in ("n", "room", "label", "minor", "node"))
        probes, targets = np.flatnonzero(group["probe"]), np.flatnonzero(~group["probe"])
        step, out = max(1, (1 << 16) // max(1, len(targets))), [np.zeros((2, 0), np.int64)]
        for low in range(0, len(probes), step):
            i, j = probes[low : low + step, None], targets[None, :]
            fine = (label[i] != label[j]) & (np.minimum(room[i], room[j]) >= needed(n[i], n[j]))
            p, t = np.nonzero(fine & (~minor[j] | (node[j] > node[i])))  # minor pairs meet twice
            p, t = probes[low + p], targets[t]
            apart = np.bitwise_count(sign[p] ^ sign[t]).sum(1, dtype=np.int64)
            near = (n[p] + n[t] - apart) // 2 >= needed(n[p], n[t])
            out.append(np.stack((node[p[near]], node[t[near]])))
        return np.concatenate(out, axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def tasks(whole: pa.Table, last: bool) -> tuple[list[pa.RecordBatch], pa.Table]:
            keys = np.stack([whole.column(c).to_numpy() for c in ("token", "band", "m", "k")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            ends = [*cuts.tolist(), whole.num_rows] if last else cuts.tolist()
            out, begin = [], 0
            col = {c: whole.column(c).to_numpy() for c in ("band", "probe", "node", "n", "pos", "label", "minor")} | {"bits": np.array(whole.column("bits").to_pylist(), object)}
            col["room"] = col["n"] - col["pos"]
            for end in ends:
                a, b = compare({c: v[begin:end] for c, v in col.items()})
                if len(a):
                    out.append(pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"]))
                begin = end
            return out, whole.slice(begin)

        for b in batches:
            own = pa.Table.from_batches([b])
            done, rest = tasks(pa.concat_tables([rest, own]) if rest is not None and rest.num_rows else own, False)
            yield from done
        if rest is not None and rest.num_rows:
            yield from tasks(rest, True)[0]

    group = ("token", "band", "m", "k")
    return work.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "a long, b long").distinct()


def node_texts(docs: DataFrame, nodes: DataFrame, tiles: DataFrame) -> DataFrame:
    """node and text of every set that shares a tile."""
    keys = {"key": F.coalesce("doc_id", F.lit(0)), "no_id": F.col("doc_id").isNull()}
    asked = nodes.withColumns(keys).join(tiles.select("node").distinct(), "node", "left_semi").select("key", "no_id", "text_hash", "node")
    own = own_columns(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text")).withColumns(keys)
    found = attached(own, asked, ["key", "no_id", "text_hash"], "inner", "asked")
    return found.groupBy("key", "no_id", "text_hash", "node").agg(F.first("text").alias("text")).select("node", "text")  # no other shuffle


def verified(pairs: DataFrame, texts: DataFrame, found: Callable[[pa.Array], tuple[np.ndarray, np.ndarray, int]] = shingles) -> DataFrame:
    """The pairs whose sorted shingle arrays overlap enough: a, b."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (x, xa), (y, ya) = [distinct_sorted(*found(b.column(k))) for k in (2, 3)]
            keep = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                p, q = x[xa[i] : xa[i + 1]], y[ya[i] : ya[i + 1]]
                if len(q):
                    common = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                    keep[i] = 100 * common >= SIMILAR * (len(p) + len(q) - common)
            yield pa.RecordBatch.from_arrays([b.column(k).filter(pa.array(keep)) for k in (0, 1)], ["a", "b"])

    bounded_batches(pairs.sparkSession)
    return both.mapInArrow(run, "a long, b long")


def labelled_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row's set, and every distinct set that isn't empty with its first document and the label of its component."""
    spark = docs.sparkSession
    sets = staged(shingle_sets(docs), "sets")
    nodes = staged(nodes_of(sets), "nodes")
    release(spark)
    tiles = staged(shared_tiles(of_node(sets.select("doc_id", "text_hash", "n", "prefix"), nodes)), "tiles")
    release(spark)
    texts = staged(node_texts(docs, nodes, tiles), "texts")
    release(spark)
    signed = staged(signatures(texts), "bits")
    tried = staged(first_of_tile_pairs(tiles), "pairs")
    labels = staged(components(staged(verified(near(tried, signed), texts), "links")), "labels")

    def joined(pairs: DataFrame) -> DataFrame:
        """The labels when pairs that turn out to be links have been added. pairs: those that bitmaps leave open."""
        links = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(verified(pairs, texts))
        found = staged(components(links), "labels")
        release(spark)
        return found

    for seed in range(ROUNDS):
        pairs = staged(star_pairs(tiles, labels, seed).join(tried, ["a", "b"], "left_anti"), "pairs")
        labels, tried = joined(near(pairs, signed)), tried.unionByName(pairs)
    open_pairs = staged(block_pairs(tiles, labels, signed).join(tried, ["a", "b"], "left_anti"), "pairs")
    labels = joined(open_pairs)
    labelled = nodes.select("node", "doc_id", "text_hash", "n", "digest", "digest2").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return sets, labelled


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles and component_id of every row of docs."""
    sets, labelled = labelled_sets(docs)
    least = labelled.groupBy("label").agg(F.min("doc_id").alias("least"))
    of_set = labelled.join(least, "label").select("n", "digest", "digest2", F.col("least").alias("component"))
    found = sets.select("doc_id", "text_hash", "n", "digest", "digest2").join(of_set, ["n", "digest", "digest2"], "left")
    return found.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: the smallest id's (no id comes last), then the smallest text hash's. Texts without
    words are linked with nothing and stay. Of rows of the same id and text one stays, the first by the other columns; texts
    without words or ids aren't taken for the same."""
    _, labelled = labelled_sets(docs)
    first = labelled.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first"))
    first = first.select(F.coalesce("first.doc_id", F.lit(0)).alias("__key"), F.col("first.no_id").alias("__no_id"), F.col("first.text_hash").alias("__hash"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    wordless = ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    keys = {"__key": F.coalesce("doc_id", F.lit(0)), "__no_id": F.col("doc_id").isNull(), "__hash": F.xxhash64("text"), "__wordless": wordless}
    keyed = docs.where(~wordless | F.col("doc_id").isNotNull()).select(F.struct(*columns).alias("__row"), (F.to_json(F.struct(*others)) if others else F.lit("")).alias("__order"), *[v.alias(k) for k, v in keys.items()])
    # repeats are dropped in each task before the rows are shuffled
    distinct = keyed.groupBy("__key", "__no_id", "__hash").agg(F.min_by("__row", "__order").alias("__row"), F.first("__wordless").alias("__wordless"))
    met = distinct.join(first.withColumn("__first", F.lit(True)), ["__key", "__no_id", "__hash"], "left")
    kept = met.where("__first or __wordless").select("__row.*")
    return kept.unionByName(docs.where(wordless & F.col("doc_id").isNull()))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).drop("text_hash")
