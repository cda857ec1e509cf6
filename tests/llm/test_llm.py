"""Every operator against brute force on small tables with nulls, ties, repeats, long texts and clashing names."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm import binary_output, chat_format, common, components, decontamination, html_extraction, jaccard_join, license_scan, line_dedup, packing, quality_rules, substring_dedup
from weftline.llm.common import scratch
from weftline.llm.textarrays import Texts, gram_hashes
from weftline.llm.tokenizing import Encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("node", "label", "text_hash", "hash", "id", "n", "line", "at", "a", "b", "size", "part", "rank", "length")


def corpus(seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "naïve", "don't", "x|y"]
    passage = " ".join(r.choices(vocabulary, k=60))
    texts = [" ".join(r.choices(vocabulary, k=r.choice([3, 30, 200]))) for _ in range(30)]
    texts += [texts[5], texts[5], texts[8].replace("w1", "W1", 1), texts[8] + " tail", "head " + texts[8]]
    texts += [f"{texts[i]}\n{passage} {texts[i + 1]}" for i in (0, 3, 7)]
    texts += ["", None, "one", "a b c", "a b c", "The " * 100, " ".join(r.choices(vocabulary, k=9000)), "\t\n ", "x\ny\nx\n\nx", passage.upper(), " ".join(vocabulary[:12] * 9)]
    texts += SPECIAL
    return [(i, t, "en", "s", None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(corpus(), SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(7) for c in CLASHES})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def odd(spark):
    """Null and repeated ids."""
    t = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    return spark.createDataFrame([(None, t, None, None, None), (4, t, None, None, None), (4, t + " end", None, None, None), (4, t + " end", None, None, None), (None, None, None, None, None)], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def test_texts_split_like_the_pattern():
    texts = ["", None, "a  b\tc", " é\x0bü ", "x" * 5000, "q"]
    t = Texts(pa.array(texts))
    got = [[t.data[s:e].tobytes().decode() for s, e in zip(t.starts[a:b], t.ends[a:b], strict=True)] for a, b in zip(t.word_at, t.word_at[1:], strict=False)]
    assert got == [words(x) for x in texts]
    h = Texts(pa.array(["a b a b a"])).word_hashes()
    g = gram_hashes(h, 2)
    assert g[0] == g[2] and g[0] != g[1] and len(gram_hashes(h, 6)) == 0


def test_license_scan(spark, empty):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [(1, "/a/LICENSE", mit), (2, "/a/b/x.py", "code"), (3, "/a/b/c/COPYING", apache), (4, "/a/b/c/d/y.py", None), (5, "/z/q.py", f"# {apache}\ncode"), (6, "/z/other.py", "free"), (7, None, "x"), (8, "/a/b/y.py", "said the licensed the the")]
    df = spark.createDataFrame(rows, "file_id long, path string, text string").withColumn("license", F.lit("clash"))
    got = {r.file_id: (r.license, r.license_from, r.basis) for r in license_scan.inherit(license_scan.scan(df)).collect()}
    assert got == {1: ("MIT", None, "own"), 2: ("MIT", "/a", "inherited"), 3: ("Apache-2.0", None, "own"), 4: ("Apache-2.0", "/a/b/c", "inherited"), 5: ("Apache-2.0", None, "own"), 6: (None, None, "none"), 7: (None, None, "none"), 8: ("MIT", "/a", "inherited")}
    assert license_scan.inherit(license_scan.scan(df.limit(0))).count() == 0


def test_license_ties_repeats_and_long_texts(spark):
    """Two licence files of a directory with equal cosines: the smaller name; repeated rows are rows of their own."""
    mit, cc = "Released under the MIT License.", "Licensed under CC BY 4.0."
    long = "word " * 60_000 + "\n# " + mit + "\n" + "tail " * 60_000
    rows = [(1, "/t/LICENSE", mit), (2, "/t/COPYING", cc), (3, "/t/x.py", ""), (3, "/t/x.py", ""), (4, "/u/long.txt", long), (None, None, None), (None, None, None)]
    got = Counter((r.file_id, r.license, r.license_from, r.basis) for r in license_scan.inherit(license_scan.scan(spark.createDataFrame(rows, "file_id long, path string, text string"))).collect())
    assert got == {(1, "MIT", None, "own"): 1, (2, "CC-BY-4.0", None, "own"): 1, (3, "CC-BY-4.0", "/t", "inherited"): 2, (4, "MIT", None, "own"): 1, (None, None, None, "none"): 2}


def test_license_statements_over_lines(spark):
    gpl = "This work is licensed under the GNU General Public License,\n{}version 3.\n"
    permission = license_scan.TEMPLATES["MIT"][2].split()
    rows = [(1, "/a.py", "# " + gpl.format("# ") + "code = here"), (2, "/b.c", "int x;\n\n/*\n * " + gpl.format(" * ").replace("\n", "\r\n") + " */")]
    rows += [(3, "/c.js", "".join(f"// {' '.join(permission[i : i + 5])}\n" for i in range(0, len(permission), 5)) + "other code follows")]
    rows += [(4, "/d/COPYING", "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\n" + "many more words stand in it\n" * 300)]
    rows += [(5, "/e.py", "words\n\n\nand words"), (6, "/f.py", None)]
    rows += [(10 + i, f"/n{i}", "2") for i in range(40)]  # without its second line the statement would look like the GPL-2.0's
    got = {r.file_id: r.license for r in license_scan.scan(spark.createDataFrame(rows, "file_id long, path string, text string")).collect()}
    assert {i: got[i] for i in range(1, 7)} == {1: "GPL-3.0", 2: "GPL-3.0", 3: "MIT", 4: "GPL-3.0", 5: None, 6: None}


def test_license_joined_lines_against_all():
    """The best of all units of a text, each compared on its own."""
    r = random.Random(5)
    own = [x for v in license_scan.TEMPLATES.values() for x in v]
    statements = license_scan.Statements()
    idf, unknown = np.array([r.uniform(1, 4) for _ in statements.vocabulary]), 5.0
    texts = []
    for _ in range(60):
        parts = [p for _ in range(r.randrange(1, 4)) for p in [*r.choice(own).split(), *r.choice([[], ["zz", "yy"]])]]
        texts.append("".join(p + r.choice([" ", " ", " ", "\n", "\n* ", "\n\n"]) for p in parts))
    best = lambda xs, lines: license_scan.best_statements(pa.array(xs, pa.string()), lines, statements, idf, unknown)
    names, scores = best([*texts, None, ""], True)
    assert names[-2:] == [None, None]
    for text, name, score in zip(texts, names, scores, strict=False):
        runs = [[]]
        for line in text.split("\n"):
            runs[-1].append(line) if re.search("[a-zA-Z0-9]", line) else runs.append([])
        units = ["\n".join(run[i:k]) for run in runs for i in range(len(run)) for k in range(i + 1, len(run) + 1) if k - i <= license_scan.JOINED or k - i == len(run)]
        every = [(-s, x) for x, s in zip(*best(units, False), strict=True) if x]
        assert (-score, name) == (min(every) if every else (0, None)), text


def test_chat_format(spark):
    rows = [(1, 0, "system", "be"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, None, " ", "early"), (1, 300, "ann", "x" * 50), (2, 0, "system", "alone"), (None, 0, "ann", "lost"), (3, 1, "ann", "same"), (3, 1, "ann", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"seq": F.lit(1), "size": F.lit(2), "block": F.lit(3)})
    got = defaultdict(list)
    for r in chat_format.rotate(df).orderBy("seq").collect():
        got[r.conv_id, r.perspective].append(r)
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "unknown"), (3, "ann")}
    for (conv, who), turns in got.items():
        whole = "".join(t.segment for t in turns)
        assert [t.seq for t in turns] == list(range(1, len(turns) + 1))
        assert all(whole[t.start : t.start + len(t.segment)] == t.segment for t in turns)
        trained = [whole[t.mask_start : t.mask_end] for t in turns if t.mask_start is not None]
        mine = [x for c, _, s, x in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0)) if (s.strip() or "unknown") == who]
        assert trained == [f"{x or ''}<|im_end|>\n" for x in mine]
    assert chat_format.rotate(df.limit(0)).count() == 0


def test_chat_format_ties(spark):
    """Turns of one number go by speaker, then text; places still add up."""
    rows = [(1, 5, "bob", "z"), (1, 5, "ann", "b"), (1, 5, "ann", "a"), (1, 2**40, "bob", ""), (1, -3, "ann", "first")]
    got = chat_format.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)).where("perspective = 'ann'").orderBy("seq").collect()
    assert [r.segment.split("\n")[1].removesuffix("<|im_end|>") for r in got] == ["first", "a", "b", "z", ""]
    whole = "".join(r.segment for r in got)
    assert all(whole[r.start : r.start + len(r.segment)] == r.segment for r in got)


SPECIAL = ["a <|endoftext|> b", "<|startoftext|>", "x<|endoftext|>", "<|ENDOFTEXT|> <|endoftext", "|>", "<|endoftext|><|startoftext|> <|endoftext|>"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_library(name):
    texts = [t for _, t, *_ in corpus()] + ["a  b    c", "don't 'street x,y.  z!! \n\n k", "é, è; “quoted”, a b", "\x0bzz\x1c y", "Σσς ΑΣ, é x", "<|endoftext|> a", "1,000 a1.b2_c", " lead", "trail  ", "\r\n x", "日本語、テスト。", "a　b ​c"] + SPECIAL
    e, library = Encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    for _ in range(2):
        ids, at = e.ids(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids, t


def encoded(name, end, rows):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return {i: [*t.encode(x or "", add_special_tokens=False).ids, end] for i, x, *_ in rows}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(spark, docs, empty):
    path, ids = public_tokenizers.path("word_bpe_49k.json"), encoded("word_bpe_49k.json", 1, corpus())
    packed = packing.pack(docs, path, 1, capacity=512)
    rows = packed.toPandas().sort_values(["sequence_id", "offset"])
    assert all(crc(ids[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32 for r in rows.itertuples())
    assert rows["length"].sum() == sum(map(len, ids.values())) and rows.groupby("sequence_id")["length"].sum().max() <= 512
    assert (rows.groupby("sequence_id")["length"].cumsum() - rows["length"] == rows["offset"]).all()
    whole = {r.sequence_id: r.ids for r in packing.sequences(docs.drop(*CLASHES), packed, path, 1, 512).collect()}
    for s, g in rows.groupby("sequence_id"):
        assert whole[s] == [i for r in g.itertuples() for i in ids[r.doc_id][r.start : r.start + r.length]]
    assert packing.pack(empty, path, 1).count() == 0 and packing.pack(odd(spark), path, 1).count() == 5


def fewest(sizes, capacity):
    """Exact number of bins for a few pieces."""
    best = len(sizes)

    def go(left, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if not left:
            best = len(bins)
            return
        for i in {b: i for i, b in enumerate(bins)}.values():
            if bins[i] + left[0] <= capacity:
                go(left[1:], [*bins[:i], bins[i] + left[0], *bins[i + 1 :]])
        go(left[1:], [*bins, left[0]])

    go(sorted(sizes, reverse=True), [])
    return best


@pytest.mark.parametrize("seed", range(25))
def test_reduction_keeps_the_optimum(seed):
    r = random.Random(seed)
    sizes = [r.randint(1, 20) for _ in range(9)]
    fixed, left = packing.reduce_dominated(Counter(sizes), 20)
    rest = [k for k, n in left.items() for _ in range(n)]
    assert sum(n for n, _ in fixed) + fewest(rest, 20) == fewest(sizes, 20)
    used = Counter()
    for n, runs in packing.plan_packing(Counter(sizes), 20):
        assert sum(k * m for k, m in runs) <= 20
        for k, m in runs:
            used[k] += n * m
    assert used == Counter(sizes)


def test_substring_dedup(spark, docs, empty):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digest(docs).collect()}
    texts = {r.doc_id: r.text for r in substring_dedup.remove_repeats(docs).collect()}
    seen = set()
    for i, t, *_ in corpus():
        w, gone = words(t), set()
        for j in range(len(w) - 19):
            if (k := tuple(w[j : j + 20])) in seen:
                gone |= set(range(j, j + 20))
            seen.add(k)
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        assert got[i] == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
        assert texts[i] == (None if t is None else kept)
    assert substring_dedup.digest(empty).count() == 0
    assert sorted(r.n_removed for r in substring_dedup.digest(odd(spark)).collect()) == [0, 0, 26, 26, 26]


def test_binary_output(spark, docs, empty):
    path, ids = public_tokenizers.path("byte_bpe_50k.json"), encoded("byte_bpe_50k.json", 0, corpus())
    index = binary_output.with_starts(binary_output.write_records(docs, scratch(spark, "records"), path, 0))
    got = {r.doc_id: r for r in binary_output.read_records(index, 16).collect()}
    digests = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in binary_output.read_digests(index, 16).collect()}
    start = 0
    for i in sorted(ids):
        assert got[i].ids == ids[i] and digests[i] == (start, len(ids[i]), crc(ids[i]))
        start += len(ids[i])
    for bad in (b"\x01", b"\x00"):
        record = bytearray(binary_output.framed(b"payload"))
        record[-6 if bad == b"\x01" else 3] ^= 1
        with pytest.raises(ValueError):
            binary_output.unframed(bytes(record))
    assert binary_output.write_records(empty, scratch(spark, "records"), path, 0).count() == 0
    assert binary_output.write_records(odd(spark), scratch(spark, "records"), path, 0).orderBy("shard", "ordinal").first().doc_id is None


def shingled(t, lower=True):
    w = words(t.translate(UPPER) if lower and t else t)
    return frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()


def test_jaccard_join(spark, docs, empty):
    sets = {i: shingled(t) for i, t, *_ in corpus()}
    least = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                c = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
                    least[a] = min(least[a], least[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.classes(docs).collect()}
    assert got == {i: (len(s), least[i]) for i, s in sets.items()}
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in sets if least[i] == i}
    assert jaccard_join.classes(empty).count() == 0
    assert sorted(str(r.component_id) for r in jaccard_join.classes(odd(spark)).collect()) == ["4", "4", "4", "4", "None"]


def test_one_of_each_row(spark):
    """Null and repeated ids, with equal, linked and unlike texts."""
    text = lambda k: " ".join(f"{k}{i}" for i in range(30))
    rows = [
        (None, text("a")), (None, text("b")), (None, text("b")), (None, text("c") + " end"), (9, text("c")),  # unlike texts without ids; a copy with one
        (4, text("d")), (4, text("e")), (4, text("e")), (5, text("e")), (3, text("f")), (3, text("f") + " end"),  # one id, unlike, equal and linked texts
        (0, text("g")), (None, text("h")), (0, text("h") + " end"),
        (7, ""), (7, ""), (7, " "), (7, None), (7, None), (None, ""), (None, ""), (None, None),
    ]
    docs = spark.createDataFrame([(i, t, "en", str(k), k) for k, (i, t) in enumerate(rows)], SCHEMA).withColumns({c: F.lit(7) for c in CLASHES}).repartition(3)
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    linked = [p for p in got if p[0] == 3]
    assert len(linked) == 1 and linked[0] in rows
    want = [(None, text("a")), (None, text("b")), (9, text("c")), (4, text("d")), (4, text("e")), (0, text("g")), (0, text("h") + " end")]
    want += [(7, ""), (7, " "), (7, None), (None, ""), (None, ""), (None, None)]
    assert got == Counter(want + linked)
    assert {r.source for r in kept.where("doc_id = 4").collect()} == {"5", "6"}  # the first of the repeated rows
    bare = jaccard_join.one_of_each(docs.select("doc_id", "text"))
    assert Counter(map(tuple, bare.collect())) == got


def test_blocks_lose_no_link(spark, monkeypatch):
    """Tiles larger than a block, with chains of copies whose ends aren't alike."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    r = random.Random(2)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(24):
        base = list(base)
        for _ in range(2):
            base[r.randrange(len(base))] = f"e{i}{r.random()}"
        rows.append((i, " ".join(base), None, None, None))
    got = {x.doc_id: x.component_id for x in jaccard_join.classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    least = {i: i for i, *_ in rows}
    for _ in rows:
        for i, t, *_ in rows:
            for j, u, *_ in rows:
                a, b = shingled(t), shingled(u)
                if 100 * len(a & b) >= 80 * len(a | b):
                    least[i] = min(least[i], least[j])
    assert got == least


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)], "a long, b long")
    assert {r.node: r.label for r in components.components(links).collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


def lines_left(rows):
    """By document in ascending order: number of lines, lines removed, text left. Tokens of a line are its distinct words."""
    earlier, out = [], []
    for _, t in rows:
        kept = []
        for line in t.split("\n") if t is not None else []:
            s = frozenset(words(line))
            if not s or not any(100 * len(s & o) >= 80 * len(s | o) for o in earlier):
                kept.append(line)
            if s:
                earlier.append(s)
        n = len(t.split("\n")) if t is not None else 0
        out.append((n, n - len(kept), "\n".join(kept)))
    return out


def near_lines(seed):
    """Lines that differ in a few words: groups of like ones larger than tiles and blocks, chains, and other white space."""
    r = random.Random(seed)
    vocabulary, rows = [f"v{i}" for i in range(60)], []
    bases = [r.sample(vocabulary, n) for n in (4, 5, 9, 14, 30, 50)]
    for i in range(90):
        lines = []
        for _ in range(r.randrange(1, 4)):
            base = list(r.choice(bases))
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                base[r.randrange(len(base))] = r.choice([*vocabulary, f"new{i}{r.random()}"])
            lines.append(r.choice([" ", "  ", "\t", "\x0b"]).join(base) + r.choice(["", "\r", " "]))
        rows.append((i, "\n".join(lines)))
    return rows


def test_line_dedup(spark, docs, empty):
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in line_dedup.report(docs).collect()}
    for (i, *_), (n, removed, text) in zip(corpus(), lines_left([(i, t) for i, t, *_ in corpus()]), strict=True):
        assert got[i] == (n, removed, hashlib.sha256(text.encode()).hexdigest()), i
    left = line_dedup.without_repeats(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.where("text is null").collect()} == {i for i, t, *_ in corpus() if t is None}
    assert line_dedup.report(empty).count() == 0 and line_dedup.without_repeats(empty).count() == 0
    assert sorted(r.n_removed for r in line_dedup.report(odd(spark)).collect()) == [0, 0, 1, 1, 1]


def test_line_dedup_columns_that_clash(spark):
    names = [*line_dedup.PLACE[1:], *line_dedup.ROW, "tile", "__id", "__hash", "__row", "__lines", "removed", "all_lines", "set"]
    rows = [(i, f"one two three four {i}\nown words of {i}") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in names})
    got = line_dedup.without_repeats(docs)
    assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.collect()} == {i: x[2] for i, x in enumerate(lines_left(rows))} and {r["__row"] for r in got.collect()} == {"__row"}


@pytest.mark.parametrize("seed,small,block", [(1, 256, 1024), (2, 3, 4), (3, 2, 5), (4, 1, 1000)])
def test_line_dedup_loses_no_line(spark, monkeypatch, seed, small, block):
    """Whatever tiles count as large, and however these are cut into blocks."""
    monkeypatch.setattr(line_dedup, "SMALL", small)
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rows = near_lines(seed)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for (i, _), (n, removed, text) in zip(rows, lines_left(rows), strict=True):
        assert got[i] == (n, removed, hashlib.sha256(text.encode()).hexdigest()), i


def test_line_dedup_compares_few_texts(spark, monkeypatch):
    """Long lines with much in common fill the bitmaps; hashes of all words tell them apart before their texts are compared."""
    r, compared, verified = random.Random(5), [], line_dedup.verified
    lines = [r.sample([f"w{i}" for i in range(380)], 300) for _ in range(20)]
    lines.append(["new", *lines[3][1:]])
    rows = [(i, " ".join(line)) for i, line in enumerate(lines)]
    monkeypatch.setattr(line_dedup, "verified", lambda pairs, texts: (compared.append(pairs.count()), verified(pairs, texts))[1])
    got = {x.doc_id: x.n_removed for x in line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: x[1] for i, x in enumerate(lines_left(rows))} and sum(compared) == 1


def test_line_dedup_parities_tell_long_lines_apart(spark):
    """Bitmaps of 200 words with a bit for each are nearly full and let unlike lines pass as pairs; parities don't, and lose no pair."""
    r = random.Random(11)
    lines = [r.sample([f"w{i}" for i in range(1200)], 200) for _ in range(40)]
    lines += [[*x[:185], *(f"new{k}_{i}" for i in range(15))] for k, x in enumerate(lines[:4])]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], "doc_id long, text string")
    nodes = common.staged(line_dedup.distinct_sets(line_dedup.line_sets(docs)), "nodes")
    ids = {x.node: x.doc_id for x in nodes.collect()}
    found = line_dedup.small_tile_pairs(line_dedup.sized(line_dedup.tiles(nodes), F.col("node"))).collect()
    found = {frozenset((ids[p.a], ids[p.b])) for p in found}
    assert {frozenset((k, 40 + k)) for k in range(4)} <= found and len(found) < 20


def test_line_dedup_words_that_share_a_hash(spark):
    """A bound on the overlap loses no pair of lines in which several words have one hash."""
    texts = spark.createDataFrame([(0, 5, [1, 2, 3, 4]), (1, 5, [1, 2, 3, 4]), (2, 5, [1, 2, 3, 9, 8])], "node long, n int, hashes array<int>")
    pairs = spark.createDataFrame([(1, 0), (2, 0), (2, 1)], "later long, earlier long")
    assert [tuple(x) for x in line_dedup.likely(pairs, texts).select("later", "earlier").collect()] == [(1, 0)]


def counts(t):
    w, tri, seen, dup = words(t), Counter(), set(), 0
    tri.update(zip(w, w[1:], w[2:], strict=False))
    covered = {k for j in range(len(w) - 2) if tri[tuple(w[j : j + 3])] > 1 for k in range(j, j + 3)}
    for line in (t or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality_rules(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules.score_documents(docs, labels).collect()}
    for i, t, *_ in corpus():
        c, r = counts(t), got[i]
        assert tuple(r[k] for k in quality_rules.COUNTS) == c
        assert r.base_failed == (c[0] < 50 or 100 * c[4] > 50 * c[0]) and not (r.base_failed and r.kept)
    assert {r.doc_id for r in quality_rules.keep_documents(docs, labels).collect()} == {i for i, r in got.items() if r.kept}
    assert quality_rules.score_documents(empty, labels.limit(0)).count() == 0
    long = " ".join(f"x{i}" for i in range(60))
    repeats = spark.createDataFrame([(None, long), (7, long), (7, long), (7, None)], "doc_id long, text string").withColumn("score", F.lit(1))
    assert Counter((r.doc_id, r.n_words, r.kept) for r in quality_rules.score_documents(repeats, labels.limit(0)).collect()) == {(None, 60, True): 1, (7, 60, True): 2, (7, 0, False): 1}
    assert Counter(r.doc_id for r in quality_rules.keep_documents(repeats, labels.limit(0)).collect()) == {None: 1, 7: 2}
    many = spark.range(40_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality")).union(spark.createDataFrame([(5, 0)] * 50, "doc_id long, quality int"))
    assert quality_rules.labelled_sample(many, 1000).count() in range(850, 1150) and quality_rules.labelled_sample(many, 10**6).count() == 40_001
    assert [r.kept for r in quality_rules.score_documents(docs.where("doc_id = 2 or doc_id = 8"), labels.limit(0)).collect() if not r.base_failed] in ([True], [True, True], [])


def test_trees_learn_and_stay_monotonic():
    r = np.random.default_rng(0)
    x = r.random((4000, len(quality_rules.FEATURES)))
    j = quality_rules.FEATURES.index("symbols")
    y = ((x[:, j] < 0.4) ^ (r.random(4000) < 0.05)).astype(float)
    trees = quality_rules.fit_trees(x[:3000], y[:3000])
    assert ((trees.probability(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9  # held out
    for name in quality_rules.FALLING:
        rising = np.repeat(x[:50], 30, 0)
        rising[:, quality_rules.FEATURES.index(name)] = np.tile(np.linspace(0, 1, 30), 50)
        assert (np.diff(trees.probability(rising).reshape(50, 30), axis=1) <= 1e-12).all()
    assert quality_rules.fit_trees(x[:10], np.ones(10)) is None


@pytest.mark.parametrize("rows", [100_000, 0])
def test_decontamination(spark, docs, empty, monkeypatch, rows):
    """With the contaminated texts broadcast and dealt."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
    texts = {i: t for i, t, *_ in corpus()}
    span = " ".join(words(texts[6])[20:45]) if len(words(texts[6])) > 45 else " ".join(words(texts[29])[:25])
    items = [(1, span), (2, "W1 w2"), (3, None), (4, "!!"), (5, "one"), (5, "one"), (None, "head " + " ".join(words(texts[8])[:12])), (9, "É naïve")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit("clash"))
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(UPPER))
    windows = defaultdict(set)
    for item, t in items:
        w = split(t)
        n = min(len(w), 10)
        for j in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[j : j + n])].add("null" if item is None else str(item))
    got = {r.doc_id: r for r in decontamination.report(docs, bench).collect()}
    for i, t in texts.items():
        w, hit, found = split(t), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if (k := tuple(w[j : j + n])) in windows:
                    hit |= set(range(j, j + n))
                    found |= windows[k]
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)), i
    clean = decontamination.clean_documents(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, r in got.items() if not r.contaminated}
    assert decontamination.report(empty, bench).count() == 0 and decontamination.clean_documents(docs, bench.limit(0)).count() == len(texts)
    alphabet = spark.createDataFrame([(1, "c d e f g h i j k l"), (1, "c d e f g h i j k l")], "item_id long, text string")
    repeated = decontamination.report(odd(spark), alphabet).collect()
    assert Counter((x.doc_id, x.n_words, x.n_hit, x.n_items) for x in repeated) == {(None, 26, 10, 1): 1, (4, 26, 10, 1): 1, (4, 27, 10, 1): 2, (None, 0, 0, 0): 1}
    assert [tuple(x) for x in decontamination.clean_documents(odd(spark), alphabet).collect()] == [(None,) * 5]


def test_decontamination_columns_that_clash(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    names = [*decontamination.KEY, "__salt", "__row", "hits", "n_hit", "window", "item"]
    docs = spark.createDataFrame([(1, "x a b c y"), (2, "free")], "doc_id long, text string").withColumns({c: F.lit(c) for c in names})
    (kept,) = decontamination.clean_documents(docs, bench).collect()
    assert kept.asDict() == {"doc_id": 2, "text": "free", **{c: c for c in names}}


def test_html_extraction(spark):
    page = lambda body: f'<html><head><title>t</title><style>p{{}}</style></head><body class="ad-free"><nav><p>menu menu menu</nav><div class="ad">buy</div>{body}<footer>end</footer></body></html>'
    article = '<div class="post-12"><h2>Title &amp; more</h2><p>First <b>bold</b>part,\n  long enough to win.<p>Second&nbsp;one.<aside>side</aside><form><p>mail?</form><script>"</p>"</script><div id="comments"><p>reader says</div></div>'
    rows = [(1, "https://h.example/a", page(article)), (2, "https://h.example/b", page('<div class="post-77"><p>Short.</p></div>')), (3, None, None), (4, "no url", "plain  text"), (5, "https://h.example/c", ""), (6, "https://o.example/", "<p>1 &lt; 2<br>and < 3</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("clash"), "paths": F.lit(1), "salt": F.lit(2)})
    got = {r.page_id: (r.text, r.n_chars) for r in html_extraction.extract(df).collect()}
    want = {1: "Title & more First boldpart, long enough to win. Second one.", 2: "Short.", 3: "", 4: "plain text", 5: "", 6: "1 < 2 and < 3"}
    assert got == {k: (v, len(v)) for k, v in want.items()}
    assert html_extraction.extract(df.limit(0)).count() == 0
    assert html.unescape("&amp;") == "&"


@pytest.mark.parametrize("value", ["x" * 9000, "x" * 300_000, "<p>y</p> > " * 2000])
@pytest.mark.parametrize("quote", ['"', "'"])
def test_html_attribute_values_of_any_length(value, quote):
    source = f'<p>One.</p><img src={quote}{value}{quote}><p>Two kept words.</p><p>Three <a href="x">link</a>'
    assert html_extraction.Page(source).text(None) == "One. Two kept words. Three link"


def test_html_stray_and_unclosed_quotes():
    text = lambda source: html_extraction.Page(source).text(None)
    assert text('<p title="never closed>One.</p><p>Two.</p>') == "One. Two."
    assert text("<p don't>One.</p><p>It isn't two.</p>") == "One. It isn't two."
    assert text('<p class="a"">One.</p><p>Say "two".</p>') == 'One. Say "two".'
    assert text("<p>1 <b and 2 < 3</p>") == "1 <b and 2 < 3"
    assert text('<p>x</p>' + '<a v="<a" ' * 20_000).startswith("x <a v=")  # in linear time


def _prose(name, n):
    return (f"{name} " * n)[:n].strip()


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", '<div class="post-1">{}</div>', "{}"])
@pytest.mark.parametrize(
    "parts",
    [
        ["<h1>Head line</h1>", "<p>lead</p>", "<section><p>1000 one</p></section>", "<section><p>1000 two</p></section>"],
        ["<p>400 before</p>", "<table><tr><td>900 left</td><td>900 right</td></tr></table>", "<blockquote>90 said</blockquote>", "<p>100 after</p>"],
        ["<p>300 before</p>", "<blockquote>800 quoted</blockquote>", "<p>200 between</p>", "<blockquote><p>800 again</p></blockquote>"],
    ],
)
def test_html_parts_beside_the_best(spark, wrap, parts):
    """Headings, leads and paragraphs beside sections, cells and quotes stay, and unlabelled links beside all that don't come in."""
    filled = [re.sub(r"(\d+) (\w+)", lambda m: _prose(m[2], int(m[1])), p.replace("<p>lead", "<p>870 lead")) for p in parts]
    body = wrap.format("".join(filled)) + '<div class="x9"><a href="a">Elsewhere</a> <a href="b">Far away</a></div>'
    rows = [(i, "https://h.example/", f"<html><body><nav>menu</nav>{body}</body></html>") for i in range(3)]
    got = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = " ".join(" ".join(re.sub("<[^>]*>", " ", "".join(filled)).split()).split())
    links = " Elsewhere Far away" if wrap == "{}" else ""  # a body with text of its own is one whole
    assert {r.text for r in got} == {want + links}


class Scores(HTMLParser):
    """Containers of well-formed pages without boilerplate: path, own text, outer container."""

    def __init__(self, source):
        super().__init__()
        self.found, self.stack = [["", "", -1]], [0]
        self.feed(source)

    def handle_starttag(self, tag, attrs):
        if tag in html_extraction.CONTAINERS:
            path = f"{self.found[self.stack[-1]][0]}>{tag}" + "".join("." + re.sub(r"\d+", "0", c) for k, v in attrs if k == "class" for c in sorted(v.split()))
            self.found.append([path, "", self.stack[-1]])
            self.stack.append(len(self.found) - 1)

    def handle_endtag(self, tag):
        if tag in html_extraction.CONTAINERS:
            self.stack.pop()

    def handle_data(self, data):
        self.found[self.stack[-1]][1] += data

    def under(self, c):
        return self.found[c][1] + "".join(self.under(k) for k in range(len(self.found)) if self.found[k][2] == c)

    def score(self, c):
        text = self.found[c][1].strip()
        return (len(text) + 1 if text else 0) + sum(self.score(k) for k in range(len(self.found)) if self.found[k][2] == c) / 2


@pytest.mark.parametrize("rows", [100_000, 0])
def test_html_consensus_against_brute_force(spark, monkeypatch, rows):
    """Twelve layouts of one host, and two hosts that vote otherwise; with votes broadcast and dealt."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
    r = random.Random(3)
    part = lambda name, n: f'<div class="{name}">{_prose(r.choice("abcd"), n)}</div>'
    pages = []
    for i in range(60):
        body = "".join(part(f"{r.choice('xyz')}{k}" if k else f"lay{'abcdefghijkl'[i % 12]}", r.randrange(60, 200)) for k in range(2))
        pages.append((i, f"https://h{0 if i % 7 else i % 2 + 1}.example/{i}", f"<html><body>{body}</body></html>"))
    votes, parsed = Counter(), {}
    for i, url, source in pages:
        p = parsed[i] = Scores(source)
        by = Counter()
        for c, (path, _, _) in enumerate(p.found):
            by[path] += p.score(c)
        for path, s in by.items():
            votes[url[:19], path] += round(1000 * s / max(by.values()))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {(x.page_key, x.page_key2): x.path for x in html_extraction.winning_paths(html_extraction.page_paths(df)).collect()}
    keys = {x.page_id: (x.page_key, x.page_key2) for x in html_extraction.with_key(df).collect()}
    for i, url, _ in pages:
        p = parsed[i]
        inside = Counter()
        for c, (path, _, _) in enumerate(p.found):
            inside[path] += len(p.under(c))
        fit = [path for path, n in inside.items() if n >= html_extraction.ENOUGH * len(p.under(0))]
        assert got[keys[i]] == min(fit, key=lambda path: (-votes[url[:19], path], -len(path), path)), i
    assert len({path for (h, path) in votes if "lay" in path and h == "https://h0.example/"[:19]}) > 8


def test_html_long_pages_and_repeats(spark):
    long = " ".join(f"word{i}" for i in range(200_000))
    rows = [(1, "https://h.example/", f"<article><p>{long}</p></article>")] * 2 + [(1, "https://h.example/", "<p>other</p>"), (None, None, "<p>x</p>"), (None, None, "<p>x</p>")]
    got = Counter((r.page_id, r.text) for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == {(1, long): 2, (1, "other"): 1, (None, "x"): 2}


def test_html_heading_around_the_best():
    text = lambda source: html_extraction.Page(source).text(None)
    long = _prose("long", 2000)
    assert text(f'<body><div class="post"><h1>Head</h1><div class="in">{long}</div></div><div class="c3">{_prose("aside", 100)}</div>') == f"Head {long}"
    assert text(f'<body><div class="lead">{_prose("lead", 800)}</div><div class="part">{long}</div></body>') == f"{_prose('lead', 800)} {long}"


@pytest.mark.parametrize("attribute", ['class="content no-sidebar"', 'class="layout has-toc"', 'id="discussion"', 'id="related-work"', 'class="ad-free"', 'title="a hidden valley"', 'data-hidden="false"', 'data-id="comments-12"', 'data-style="display:none"', "title='class=\"ad\"'", 'class="a" class="ad"', 'aria-hidden="false"'])
@pytest.mark.parametrize("tag", ["div", "section", "td", "p"])
def test_html_names_that_are_not_boilerplate(attribute, tag):
    source = f'<body><article><p>{_prose("first", 500)}</p><{tag} {attribute}>{_prose("second", 200)}</{tag}></article></body>'
    assert html_extraction.Page(source).text(None) == f"{_prose('first', 500)} {_prose('second', 200)}"


@pytest.mark.parametrize("attribute", ['class="sidebar-left"', 'class="x site-header"', 'id="comments-12"', 'id=ad3', 'role="navigation"', 'CLASS="Comment_List"', "hidden", 'aria-hidden="true"', 'style="color:red;display: none"'])
@pytest.mark.parametrize("tag", ["div", "section", "td", "p"])
def test_html_names_that_are_boilerplate(attribute, tag):
    """However much longer than the article it is."""
    source = f'<body><article><p>{_prose("first", 500)}</p></article><{tag} {attribute}>{_prose("second", 2000)}</{tag}></body>'
    assert html_extraction.Page(source).text(None) == _prose("first", 500)


def test_html_boilerplate_names_around_the_main_text():
    text = lambda source: html_extraction.Page(source).text(None)
    long = _prose("long", 500)
    for inner in (f"<p>{long}</p>", f"<div>{long}</div>", f"<article><p>{long}</p></article>", f'<div class="widget">{long}</div>'):
        assert text(f'<body><div class="widget">{inner}<div class="ad">buy</div></div><div class="comments">short</div></body>') == long
    assert text(f'<article><div class="form">{long}</div></article>') == long
    assert text(f'<body><p class="notice">{long}</p></body>') == long


def pipeline_tables(spark, folder, docs, labels, items):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_against_brute_force(spark, tmp_path):
    """Labels of both classes; copies, near copies, repeated lines and a benchmark passage among the documents."""
    import corpus_pipeline

    r = random.Random(9)
    text = lambda: "\n".join(" ".join(f"w{r.randrange(3000)}" for _ in range(20)) for _ in range(5))
    texts = [text() for _ in range(24)] + [" ".join(f"#$%{i}" for i in range(80)) for _ in range(24)]
    texts += [texts[0], texts[1] + " tail", texts[2] + "\n" + texts[3].split("\n")[0], texts[4].replace(" ", "  ", 3), "short text", None]
    item = " ".join(words(texts[5])[3:15])
    rows = [(i, t, "en", "s", None) for i, t in enumerate(texts)]
    labels = [(i, int(i < 24), 0) for i in range(48) if i % 6]
    folder = pipeline_tables(spark, tmp_path, spark.createDataFrame(rows, SCHEMA).repartition(3), labels, [(1, item), (2, None)])
    score = quality_rules.score_documents(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    good = {x.doc_id for x in score.where("kept").collect()}
    assert {*range(24)} <= good and not good & {*range(24, 48), 52, 53}
    left = [(i, texts[i]) for i in sorted(good)]
    left = [(i, t) for (i, _), (_, _, t) in zip(left, lines_left(left), strict=True)]
    sets, least = {i: shingled(t) for i, t in left}, {i: i for i, _ in left}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    least[a] = min(least[a], least[b])
    window = lambda t: {tuple(w[j : j + 10]) for w in [re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.translate(UPPER))] for j in range(len(w) - 9)}
    left = [(i, t) for i, t in left if least[i] == i and not window(t) & window(item)]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in left}
    got = defaultdict(int)
    for x in corpus_pipeline.run(spark, folder).collect():
        got[x.doc_id] += x.length
    assert got == want and len(want) > 15 and 5 not in want


def test_pipeline_handles_odd_tables(spark, tmp_path):
    """Null and repeated ids, clashing columns, and an empty table."""
    import corpus_pipeline

    base = odd(spark).withColumns({c: F.lit(7) for c in CLASHES})
    words_ = [" ".join(f"{c}{i}" for i in range(60)) for c in "xyz"]
    base = base.unionByName(spark.createDataFrame([(None, words_[0], None, None, None), (None, words_[1], None, None, None), (4, words_[2], None, None, None), (4, words_[2], None, None, None)], SCHEMA).withColumns({c: F.lit(7) for c in CLASHES}))
    folder = pipeline_tables(spark, tmp_path, base, [(4, 1, 0)], [(1, "nothing like it")])
    out = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.staged(stage(spark, out, folder), name)
        assert out.columns == base.columns, name
        kept.append(sorted(((x.doc_id is None, x.doc_id), len(x.text or "")) for x in out.collect()))
    # four rows of 50 words or more; the repeated one loses nothing as a copy of itself, and is one row after the join
    assert [len(k) for k in kept] == [4, 4, 3, 3]
    assert corpus_pipeline.run(spark, folder).count() == 3
    nothing = pipeline_tables(spark, tmp_path / "none", base.limit(0), [(1, 1, 0)], [(1, "a")])
    assert corpus_pipeline.run(spark, nothing).count() == 0


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    base = docs.drop(*CLASHES)
    base.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(5)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(words(corpus()[6][1])[:12]) or "w1 w2 w3")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "decontamination", "best_fit_packing"]
    out = base
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path))
        assert out.columns == base.columns, name
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in final.collect()} == {r.doc_id for r in out.collect()}


def test_salted_rows_are_not_broadcast(spark, monkeypatch):
    """beyond the count, the rows made for every salt go by a merge; Spark takes them for as few as there were before."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 2)
    big = spark.createDataFrame([(k % 5, k) for k in range(40)], "key long, x long")
    found = common.attached(big, spark.createDataFrame([(k, -k) for k in range(4)], "key long, y long"), ["key"], "left", "small")
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.key, r.x, r.y or 0) for r in found.collect()) == sorted((k % 5, k, -(k % 5) if k % 5 < 4 else 0) for k in range(40))
