"""Runs of words, alignment of two tokenizers, and encoding by prefixes, against brute force and the libraries."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm import prefix_bpe, token_alignment, word_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BYTES, WORDS, PIECES = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"
SIGNS = "\r;abcABC'  \n\n\t éÉñß一あ😀​\x1c!?.<|>019ẞİﬁaaaa  tslveredmΣ\xa0 "


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def texts(seed=4):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["naïve", "don't", "Zoë,"]
    out = [" ".join(r.choices(vocabulary, k=r.choice([1, 5, 30, 200]))) for _ in range(60)]
    out += [" ".join(r.choices("ab", k=60)) for _ in range(20)] + ["".join(r.choices(SIGNS, k=r.randrange(1, 90))) for _ in range(60)]
    out += ["x y " * 9 + "x", "tok " * 5, "tok " * 6, "a b c\n" * 3000, "head " + "p q r s t u v " * 4 + "tail", out[0], out[0], "", None, "\t\n ", " ", "\n", "\0", "one"]
    out += ["<|endoftext|> a <s>x</s> <|startoftext|><|endoftext|>", "aaaaaaa" * 400, "▁ under", "the the the " * 40]
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with clashing columns, repeated rows and ids, and null ids."""
    rows = [(i * 7, t, "en", "s", None) for i, t in enumerate(texts())]
    rows += [rows[3], rows[3], (14, "again again again again again again", None, None, 1), (None, "x y " * 9, None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(3) for c in ("a", "b", "n", "row", "runs", "ids", "count", "links", "start")})
    path = str(tmp_path_factory.mktemp("docs"))
    df.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/none/documents.parquet")
    return path, [(r[0], r[1]) for r in rows]


def compared(df, want):
    key = lambda r: tuple((x is None, "" if x is None else x) for x in r)
    assert sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("query", [word_runs.op11_periodic_runs, token_alignment.op12_token_alignment, prefix_bpe.op13_bpe_codec])
def test_empty_tables_give_no_rows(spark, folder, query):
    assert query(spark, folder[0] + "/none").collect() == []


# ---- runs


def plain_runs(words):
    found, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if size >= max(6, 4 * q) and not any(words[i : i + size - p] == words[i + p : i + size] for p in range(1, q)):
                found.append((i, size, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_are_those_of_brute_force():
    r = random.Random(2)
    for k in range(1500):
        words = r.choices("abcdefgh"[: r.choice([1, 2, 3, 8])], k=r.randrange(60))
        for _ in range(r.randrange(3)):
            at, p = r.randrange(len(words) + 1), r.randrange(1, 9)
            loop = words[at : at + p]
            words = words[:at] + loop * r.randrange(1, 7) + loop[: r.randrange(p)] + words[at : at + r.randrange(9)]
        assert word_runs.runs_of(words) == plain_runs(words), (k, words)


def test_cut_stretches_hold_every_run():
    r = random.Random(6)
    words, text = [], []
    for i in range(40):
        part = [r.randrange(200) for _ in range(r.randrange(80))]
        for _ in range(r.randrange(3)):
            at = r.randrange(len(part) + 1)
            part[at:at] = [r.randrange(6) for _ in range(r.randrange(1, 6))] * r.randrange(2, 8)
        words += part
        text += [i] * len(part)
    spans = word_runs._stretches(np.array(words, np.uint64) * np.uint64(977), np.array(text))
    for i in range(40):
        first, own = text.index(i) if i in text else 0, [w for w, t in zip(words, text, strict=True) if t == i]
        inside = sorted((low + s - first, size, q) for low, high in spans if text[low] == i for s, size, q in word_runs.runs_of(words[low:high]))
        assert inside == sorted(plain_runs(own))


def test_op11_against_brute_force(spark, folder):
    want = []
    for doc_id, text in folder[1]:
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words) if n < 2000 else word_runs.runs_of(words)
        gone = {i for s, size, q in runs for i in range(s + q, s + size)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
        milli = 1000 * best[1] // best[2] if runs else None
        want.append((doc_id, len(runs), *best, milli, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))))
    assert sum(w[1] > 0 for w in want) > 10
    compared(word_runs.op11_periodic_runs(spark, folder[0]), want)


def test_long_periodic_texts():
    for n, p in ((30_000, 1), (30_000, 7), (30_000, 5_000)):
        assert word_runs.runs_of([i % p for i in range(n)]) == [(0, n, p)]


# ---- alignment


def plain_alignment(a, b, names_a, names_b, text):
    whole = " " + text if text else ""
    x, y = (a.encode(whole, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
    if b"".join(names_a[i] for i in x) != whole.encode() or b"".join(names_b[i] for i in y) != whole.encode():
        x, y = [], []
    ends = [np.cumsum([0, *(len(names[i]) for i in ids)]).tolist() for names, ids in ((names_a, x), (names_b, y))]
    cuts = sorted(set(ends[0]) & set(ends[1]))
    return x, y, [(x[ends[0].index(s) : ends[0].index(e)], y[ends[1].index(s) : ends[1].index(e)]) for s, e in zip(cuts, cuts[1:], strict=False)]


@pytest.mark.parametrize("head", [token_alignment.HEAD_PAIRS, 3])
def test_op12_against_brute_force(spark, folder, head, monkeypatch):
    monkeypatch.setattr(token_alignment, "HEAD_PAIRS", head)
    a = Tokenizer.from_file(public_tokenizers.path(BYTES))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECES))
    own = {c: i for i, c in enumerate(prefix_bpe.byte_characters())}
    names_a = {i: bytes(own[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items()}
    names_b = [bytes([int(p[1:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(b.id_to_piece, range(b.get_piece_size())))]
    found = [(doc_id, plain_alignment(a, b, names_a, names_b, t or "")) for doc_id, t in folder[1]]
    links = [Counter((p, q) for ga, gb in groups for p in ga for q in gb) for _, (_, _, groups) in found]
    counts = Counter(pair for one in links for pair in one)
    most: dict = {}
    for (p, _), n in counts.items():
        most[p] = max(most.get(p, 0), n)
    want = []
    for (doc_id, (x, y, groups)), one in zip(found, links, strict=True):
        text = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in groups)
        want.append((doc_id, len(x), len(y), len(groups), sum(one.values()), sum(n for p, n in one.items() if counts[p] == most[p[0]]), sum(n * counts[p] for p, n in one.items()), sha(text) if x else ""))
    compared(token_alignment.op12_token_alignment(spark, folder[0]), want)


def test_large_groups_and_cuts():
    r = random.Random(8)
    for _ in range(300):
        n = r.randrange(2, 120)
        a, b = ([0, *sorted(r.sample(range(1, n), r.randrange(n - 1))), n] for _ in range(2))
        at_a, at_b = token_alignment.shared_cuts(np.array(a), np.array(b), np.array([0, len(a) - 1]), np.array([0, len(b) - 1]))
        common = sorted(set(a) & set(b))
        assert [a[i] for i in at_a] == [b[j] for j in at_b] == common
    coders = token_alignment.both(public_tokenizers.path(BYTES), public_tokenizers.path(PIECES))
    narrow = token_alignment.aligned_batch([1, 2], ["ﬀﬁ" * 60 + " 😀" * 50, "x"], coders).to_pylist()
    wide, token_alignment.WIDE = token_alignment.WIDE, 1
    try:
        assert token_alignment.aligned_batch([1, 2], ["ﬀﬁ" * 60 + " 😀" * 50, "x"], coders).to_pylist() == narrow
    finally:
        token_alignment.WIDE = wide


# ---- encoding by prefixes


@pytest.mark.parametrize("name", [WORDS, BYTES])
def test_ids_and_texts_are_the_librarys(name):
    path = public_tokenizers.path(name)
    library, codec = Tokenizer.from_file(path), prefix_bpe.codec(path)
    r = random.Random(1)
    some = [t or "" for t in texts()] + ["".join(r.choices(SIGNS, k=r.randrange(1, 60))) for _ in range(1500)] + ["".join(r.choices("aab", k=r.randrange(1, 90))) for _ in range(500)]
    for text, e in zip(some, library.encode_batch(some, add_special_tokens=False), strict=True):
        assert codec.encode(text) == e.ids, repr(text)
        assert codec.decode(e.ids) == library.decode(e.ids, skip_special_tokens=False)
    odd = [r.randrange(49_000) for _ in range(3000)]
    assert codec.decode(odd) == library.decode(odd, skip_special_tokens=False)


def test_pairs_apart_are_what_merging_keeps_apart():
    """Compatibility against carrying out the merges of two tokens side by side."""
    merges = prefix_bpe.codec(public_tokenizers.path(BYTES)).merges

    def merged(symbols):
        while True:
            ranks = [(merges.rank.get(p, prefix_bpe.NEVER), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False))]
            rank, i = min(ranks, default=(prefix_bpe.NEVER, 0))
            if rank == prefix_bpe.NEVER:
                return symbols
            symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]

    r = random.Random(9)
    made = sorted(merges.made)
    for _ in range(1500):
        a, b = r.choice(made), r.choice(made)
        if r.random() < 0.5:
            b = a[-1] * r.randrange(1, 3) if a[-1] * 2 in merges.made else b[:2] if b[:2] in merges.made else b
        assert merges.compatible(a, b) == (merged([*(a + b)]) == [a, b]), (a, b)


def test_op13_against_the_library(spark, folder):
    library = Tokenizer.from_file(public_tokenizers.path(WORDS))
    want = []
    for doc_id, text in folder[1]:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    compared(prefix_bpe.op13_bpe_codec(spark, folder[0]), want)


def test_encoding_and_decoding_apart(spark, folder):
    path = public_tokenizers.path(BYTES)
    docs = spark.read.parquet(folder[0] + "/documents.parquet")
    back = prefix_bpe.decoded(prefix_bpe.encoded(docs, path), path)
    compared(back.select("doc_id", "text"), [(i, t or "") for i, t in folder[1]])
