"""Column functions on small inputs."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import scalars as S


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def fnv(data: bytes, start: int, prime: int, bits: int) -> int:
    for b in data:
        start = (start ^ b) * prime % (1 << bits)
    return start


@pytest.mark.parametrize("text", ["", "a", "demo::Thing", "café", "x" * 300])
def test_fnv(spark, text):
    assert one(spark, S.fnv1a32(F.col("t")), t=text) == fnv(text.encode(), 2166136261, 16777619, 32)
    assert one(spark, S.fnv1a64_hex(F.col("t")), t=text) == f"{fnv(text.encode(), 14695981039346656037, 1099511628211, 64):016x}"
    assert one(spark, S.work_bucket(F.col("t"), 17), t=text) == fnv(text.encode(), 14695981039346656037, 1099511628211, 64) % 17


def test_semver_order(spark):
    rising = ["not a version", "0.9.0", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.9.0", "1.10.0", "2.0.0"]
    df = spark.createDataFrame([(v,) for v in reversed(rising)], "v string")
    assert [r.v for r in df.orderBy(S.semver(F.col("v"))).collect()] == rising


@pytest.mark.parametrize(
    ("info", "language", "rust"), [("", "rust", True), ("rust,no_run", "rust", True), ("toml", "toml", False), ("ignore, text", "text", False), ("edition2021", "rust", True), ("should_panic", "rust", True)]
)
def test_fence(spark, info, language, rust):
    got = one(spark, S.fence_language(F.col("i")), i=info)
    assert (got["language"], got["is_rust"]) == (language, rust)


def test_texts(spark):
    assert one(spark, S.shown_code(F.col("c")), c="# hidden\nlet x = 1;\n#\n##[attr]\n  ## y") == "let x = 1;\n#[attr]\n  # y"
    assert one(spark, S.derive_names(F.col("c")), c="#[derive(Clone, Debug)]") == ["Clone", "Debug"]
    assert one(spark, S.repository_of(F.col("c")), c="https://github.com/a/b.git") == "a/b"
    assert one(spark, S.index_path(F.col("c")), c="Serde") == "se/rd/serde"
    assert one(spark, S.query_prefix(F.col("c")), c=" A") == "a"
    assert one(spark, S.search_prefix(F.col("c")), c="é") == "__"
    assert one(spark, S.line_count(F.col("a"), F.col("b")), a=5, b=3) == 1
    assert one(spark, S.run_id(F.col("c")), c="2026-01-01T00:00:00Z") == "2026-01-01T00-00-00Z"
    for asked, want in [(" Rust-Std  nightly", ("rust_std", "nightly")), ("proc macro@beta", ("proc_macro", "beta")), ("alloc:stable", ("alloc", "stable")), ("unstable", ("unstable", None)), ("core@latest", ("core@latest", None)), ("Nightly", ("", "nightly"))]:
        assert tuple(one(spark, S.toolchain_query(F.col("c")), c=asked)) == want
    assert one(spark, S.bucket_count(F.col("b"), 100, 3, 64), b=1000) == 16


def test_visibility_round_trip(spark):
    for key in ("Public", "Crate", "Inherited", "Restricted:a::b"):
        v = S.parse_visibility(F.col("k"))
        assert one(spark, S.visibility_key(v["kind"], v["path"]), k=key) == key
    assert one(spark, S.parse_visibility(F.col("k"))["kind"], k="odd") == "Unknown"
