"""Calls to the functions they name, by equi-joins on exploded suffixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import scalars as S
from weftline.operators.sieve import sieve, sifted
from weftline.shared import parts, staged


def _suffixes(functions: DataFrame) -> DataFrame:
    """package, suffix, target: what can follow a ``::`` in each function's path, so never the whole path."""
    n = F.size("parts")
    places = functions.select("package", F.col("id").alias("target"), S.segments(F.col("id")).alias("parts")).where(n > 1).select("*", F.explode(F.sequence(F.lit(2), n)).alias("k"))
    return places.select("package", "target", F.array_join(F.slice("parts", F.col("k"), n), "::").alias("suffix"))


def _counted(functions: DataFrame) -> DataFrame:
    """package, suffix, n, only: how many functions a suffix fits, and one of them; counted before calls are joined. Few suffixes repeat inside
    a task and the least of texts is found by sorting, so rows are dealt by suffix and sorted once, after that."""
    return _suffixes(functions).repartition(parts(functions), "package", "suffix").groupBy("package", "suffix").agg(F.count("*").alias("n"), F.min("target").alias("only"))


def _below(base: Column, rest: Column) -> Column:
    return F.when(base == "", rest).otherwise(F.concat_ws("::", base, rest))


def _anchored(path: Column, module: Column) -> tuple[Column, Column, Column]:
    """What a path names: the rest after its anchor (any number of ``super``, then ``crate``, ``self`` or ``Self``), the rest below
    the module that the anchor means, and the anchor itself. A package's root module is ''."""
    part = lambda k: F.regexp_extract(F.concat(path, F.lit("::")), r"^((?:super::)*)(?:(crate|self|Self)::)?(.*)$", k)
    ups, word, rest = F.regexp_count(part(1), F.lit("super")), part(2), F.regexp_replace(part(3), "::$", "")
    anchor = F.when(word == "crate", "crate").when(word != "", "self").when(ups > 0, "super").otherwise("")
    parts = F.split(module, "::")
    upper = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - ups, F.lit(0))), "::")
    base = F.when(anchor == "crate", "").when(anchor == "super", upper).otherwise(module)
    return rest, _below(base, rest), anchor


def _fits(functions: DataFrame, ambiguous: bool) -> DataFrame:
    """package, suffix, target, confidence: Static where one function fits. Where several do, none counts, or in ambiguous mode each,
    Inferred; only that mode makes a row for every function that fits."""
    if not ambiguous:
        return _counted(functions).where("n = 1").select("package", "suffix", F.col("only").alias("target"), F.lit("Static").alias("confidence"))
    return _every(_suffixes(functions), parts(functions))


def _every(suffixes: DataFrame, n: int) -> DataFrame:
    """package, suffix, target, confidence of every function that fits, dealt once by suffix."""
    counted = suffixes.repartition(n, "package", "suffix").withColumn("n", F.count("*").over(Window.partitionBy("package", "suffix")))
    return counted.select("package", "suffix", "target", F.when(F.col("n") == 1, "Static").otherwise("Inferred").alias("confidence"))


def resolve(calls: DataFrame, functions: DataFrame, ambiguous: bool = False) -> DataFrame:
    """calls (package, caller, module, path, span) to package, caller, target, confidence, span; functions: package, id.

    A path without an anchor counts as a suffix as it stands and below its module; with one only below the module that the
    anchor means. What fits by any of these counts, with the stronger confidence. (A single name fits the same functions
    by name as it does as a suffix, so a further attempt by name finds nothing new.) Nothing calls itself."""
    rest, scoped, anchor = _anchored(F.col("path"), F.col("module"))
    suffixes = F.when(rest == "", F.array().cast("array<string>")).when(anchor == "", F.array_distinct(F.array(rest, scoped))).otherwise(F.array(scoped))
    asked = calls.select("package", "caller", "span", F.explode(suffixes).alias("suffix"))
    if not ambiguous:
        found = asked.join(_fits(functions, False), ["package", "suffix"])
        return _strongest(found.where("caller <> target").drop("suffix"), ["package", "caller", "target", "span"])
    # calls are read once; suffixes that no call asks for go before they are shuffled; edges are grouped where their calls are
    asked, n, key = staged(asked, "asked"), max(parts(calls), parts(functions)), F.struct("package", "suffix").alias("key")
    table = sifted(_suffixes(functions).select("*", key), "key", sieve(asked.select(key), "key")).drop("key")
    found = asked.repartition(n, "package", "suffix").join(_every(table, n).hint("merge"), ["package", "suffix"])
    found = staged(found.where("caller <> target").drop("suffix"), "calls")
    return _strongest(found.repartition(n, "package", "caller", "target"), ["package", "caller", "target", "span"])


def _strongest(found: DataFrame, keys: list[str]) -> DataFrame:
    best = F.max(F.struct(S.confidence_rank(F.col("confidence")).alias("rank"), "confidence"))["confidence"]
    return found.groupBy(*keys).agg(best.alias("confidence"))


def resolve_methods(calls: DataFrame, methods: DataFrame, ambiguous: bool = False) -> DataFrame:
    """calls (package, caller, module, type, name, span; type: the path of the type that the caller belongs to, or null) to package,
    caller, target, confidence, span; methods: package, id.

    Below the type as it stands and, unless the type's own path is anchored to a package or an upper module, below the
    caller's module; if neither fits, by name alone. What fits, and what is asked, is made once for both."""
    keys = ["package", "caller", "module", "type", "name"]
    calls = calls.withColumn("type", F.coalesce("type", F.lit("")))
    rest, scoped, anchor = _anchored(F.col("type"), F.col("module"))
    own = F.when(anchor == "super", scoped).otherwise(rest)
    typed = F.when(rest == "", F.array().cast("array<string>")).when(anchor.isin("crate", "super"), F.array(own)).otherwise(F.array_distinct(F.array(own, _below(F.col("module"), own))))
    asked, fits = staged(calls.select(*keys).distinct(), "asked"), staged(_fits(methods, ambiguous), "fits")
    by_type = asked.select(*keys, F.explode(F.transform(typed, lambda t: F.concat_ws("::", t, "name"))).alias("suffix"))
    found = staged(by_type.join(fits, ["package", "suffix"]).drop("suffix"), "typed_calls")
    by_name = asked.join(found.select(*keys).distinct(), keys, "left_anti").withColumn("suffix", F.col("name"))
    every = found.unionByName(by_name.join(fits, ["package", "suffix"]).drop("suffix")).where("caller <> target")
    return calls.join(_strongest(every, [*keys, "target"]), keys).select("package", "caller", "target", "confidence", "span")


def call_edges(resolved: DataFrame) -> DataFrame:
    """One edge for each caller and target: the strongest confidence, and the distinct places of its calls in order."""
    best = F.max(F.struct(S.confidence_rank(F.col("confidence")).alias("rank"), "confidence"))["confidence"]
    return resolved.groupBy("package", F.col("caller").alias("from_id"), F.col("target").alias("to_id")).agg(best.alias("confidence"), F.array_sort(F.collect_set("span")).alias("occurrences"))


def unique_callers(places: DataFrame, nodes: DataFrame) -> DataFrame:
    """places (place, module, type, name) to the one callable that they are: by type, by module and type (or module alone without a type), by
    name alone; an attempt with several matches counts for nothing."""
    table = nodes.select(F.col("id").alias("target"), F.explode(S.suffixes(F.col("id"))).alias("suffix"))
    unique = table.groupBy("suffix").agg(F.count("*").alias("n"), F.min("target").alias("target")).where("n = 1").select("suffix", "target")
    typed = F.array(F.concat_ws("::", "type", "name"), F.concat_ws("::", "module", "type", "name"), F.col("name"))
    tries = places.select("place", F.posexplode(F.when(F.col("type").isNotNull(), typed).otherwise(F.array(F.concat_ws("::", "module", "name"), F.col("name")))).alias("attempt", "suffix"))
    return tries.join(unique, "suffix").groupBy("place").agg(F.min_by("target", "attempt").alias("caller"))
