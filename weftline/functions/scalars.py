"""Column functions. All are built-in expressions; those over bytes or words are folds over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.fixed import CONVENTIONS, MERGE_CONFIDENCE, NODE_KINDS, RELATIONS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEMVER = r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-([0-9A-Za-z.-]+))?(?:\+([0-9A-Za-z.-]+))?$"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def utf8_bytes(c: Column) -> Column:
    """A text's UTF-8 bytes as numbers. Of a text of one-byte characters they are its characters' codes, which takes no way through hex."""
    codes = F.transform(F.split(c, ""), lambda x: F.ascii(x).cast("bigint"))
    hexed = F.hex(F.encode(c, "UTF-8"))
    at = F.when(F.length(c) > 0, F.sequence(F.lit(0), F.octet_length(c) - 1)).otherwise(F.array().cast("array<int>"))
    hex_bytes = F.transform(at, lambda i: F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint"))
    return F.when((F.length(c) > 0) & (F.length(c) == F.octet_length(c)), codes).otherwise(hex_bytes)


def fnv1a32(c: Column) -> Column:
    return F.aggregate(utf8_bytes(c), F.lit(2166136261).cast("bigint"), lambda h, b: (h.bitwiseXOR(b) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))


def fnv1a64(c: Column) -> Column:
    """The 64-bit hash as struct<hi, lo> of 32 bits each. The prime is 2**40 + 435."""
    low = F.lit(4294967295)

    def step(h: Column, b: Column) -> Column:
        lo = h["lo"].bitwiseXOR(b)
        product = lo * 435
        hi = h["hi"] * 435 + F.shiftright(product, 32) + F.shiftleft(lo.bitwiseAND(F.lit(0xFFFFFF)), 8)
        return F.struct(hi.bitwiseAND(low).alias("hi"), product.bitwiseAND(low).alias("lo"))

    start = F.struct(F.lit(0xCBF29CE4).cast("bigint").alias("hi"), F.lit(0x84222325).cast("bigint").alias("lo"))
    return F.aggregate(utf8_bytes(c), start, step)


def fnv1a64_hex(c: Column) -> Column:
    h = fnv1a64(c)
    return F.lower(F.concat(F.lpad(F.hex(h["hi"]), 8, "0"), F.lpad(F.hex(h["lo"]), 8, "0")))


def work_bucket(work_id: Column, shards: int) -> Column:
    """fnv1a64 modulo shards."""
    h = fnv1a64(work_id)
    return F.pmod(F.pmod(h["hi"], F.lit(shards)) * F.lit((1 << 32) % shards) + F.pmod(h["lo"], F.lit(shards)), F.lit(shards))


def hex_label(value: Column, count: int, least: int) -> Column:
    """Lower-case hex, as wide as count - 1 needs and at least ``least``."""
    return F.lpad(F.lower(F.hex(value.cast("bigint"))), max(least, len(f"{max(count - 1, 0):x}")), "0")


def bucket_label(c: Column, count: int) -> Column:
    return hex_label(F.pmod(fnv1a32(c), F.lit(count)), count, 3)


def shard_label(index: Column, count: int) -> Column:
    return hex_label(index, count, 2)


def work_id(kind: Column, name: Column, version: Column, channel: Column) -> Column:
    return F.concat_ws(":", kind, name, version, channel)


def search_prefix(name: Column) -> Column:
    return F.rpad(F.substring(F.regexp_replace(ascii_lower(F.trim(name)), "[^a-z0-9_]", "_"), 1, 2), 2, "_")


def query_prefix(query: Column) -> Column:
    """As search_prefix, but one character stays one, and nothing is '__'."""
    cleaned = F.substring(F.regexp_replace(ascii_lower(F.trim(query)), "[^a-z0-9_]", "_"), 1, 2)
    return F.when(cleaned == "", F.lit("__")).otherwise(cleaned)


def normal_name(c: Column) -> Column:
    return ascii_lower(F.replace(c, F.lit("-"), F.lit("_")))


def hyphen_name(c: Column) -> Column:
    return ascii_lower(F.replace(c, F.lit("_"), F.lit("-")))


def segments(c: Column) -> Column:
    return F.split(c, "::")


def package_of(c: Column) -> Column:
    return F.substring_index(c, "::", 1)


def last_segment(c: Column) -> Column:
    return F.substring_index(c, "::", -1)


def parent_id(c: Column) -> Column:
    """The id without its last segment; null for a package."""
    return F.when(F.size(segments(c)) > 1, F.array_join(F.slice(segments(c), F.lit(1), F.size(segments(c)) - 1), "::"))


def join_path(package: Column, path: Column) -> Column:
    """Package and path, a leading repeat of the package dropped."""
    rest = F.when(F.get(path, F.lit(0)) == package, F.slice(path, 2, 1 << 30)).otherwise(path)
    return F.when(F.size(rest) > 0, F.concat_ws("::", package, F.array_join(rest, "::"))).otherwise(package)


def prefixes(c: Column, proper: bool = True) -> Column:
    """Every ``::`` prefix of an id, shortest first."""
    parts = segments(c)
    last = F.size(parts) - (1 if proper else 0)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "::"))).otherwise(F.array().cast("array<string>"))


def suffixes(c: Column) -> Column:
    """Every ``::`` suffix of an id, longest first."""
    parts = segments(c)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "::"))


def _mapped(c: Column, pairs: dict[str, object], default: Column) -> Column:
    out = None
    for key, value in pairs.items():
        out = F.when(c == key, F.lit(value)) if out is None else out.when(c == key, F.lit(value))
    return out.otherwise(default)


def kind_order(kind: Column) -> Column:
    return _mapped(kind, {k: i for i, (k, _, _) in enumerate(NODE_KINDS)}, F.lit(len(NODE_KINDS)))


def kind_label(kind: Column) -> Column:
    return _mapped(kind, {k: label for k, label, _ in NODE_KINDS}, kind)


def kind_slug(kind: Column) -> Column:
    return _mapped(kind, {k: slug for k, _, slug in NODE_KINDS}, F.lower(kind))


def relation(kind: Column) -> Column:
    return _mapped(kind, {k: r for k, r, _, _, _ in RELATIONS}, F.lit(None).cast("string"))


def relation_label(kind: Column, incoming: Column) -> Column:
    return F.when(incoming, _mapped(kind, {k: i for k, _, i, _, _ in RELATIONS}, kind)).otherwise(_mapped(kind, {k: o for k, _, _, o, _ in RELATIONS}, kind))


def relation_order(kind: Column) -> Column:
    return _mapped(kind, {k: n for k, _, _, _, n in RELATIONS}, F.lit(len(RELATIONS)))


def confidence_rank(confidence: Column, strongest_first: tuple[str, ...] = MERGE_CONFIDENCE) -> Column:
    """Higher is stronger."""
    return _mapped(confidence, {c: len(strongest_first) - i for i, c in enumerate(strongest_first)}, F.lit(0))


def visibility_key(kind: Column, path: Column) -> Column:
    return F.when(kind == "Restricted", F.concat(F.lit("Restricted:"), F.coalesce(path, F.lit("")))).otherwise(kind)


def parse_visibility(key: Column) -> Column:
    """struct<kind, path>; what isn't known is Unknown."""
    kind = F.when(key.startswith("Restricted:"), "Restricted").when(key.isin("Public", "Crate", "Inherited"), key).otherwise("Unknown")
    return F.struct(kind.alias("kind"), F.when(kind == "Restricted", F.substring(key, F.lit(12), F.length(key))).alias("path"))


def line_count(start: Column, end: Column) -> Column:
    return F.when(start.isNull() | end.isNull(), None).when(end >= start, end - start + 1).otherwise(1)


def semver(version: Column) -> Column:
    """A struct whose order is that of versions: invalid texts first (by text), then by precedence."""
    part = lambda i: F.regexp_extract(version, SEMVER, i)
    valid = version.rlike(SEMVER)
    number = lambda i: F.when(valid, F.try_to_number(part(i), F.lit("9" * 38)).cast("decimal(38,0)"))
    ids = F.when(valid & (part(4) != ""), F.split(part(4), r"\.")).otherwise(F.array().cast("array<string>"))
    pre = F.transform(
        ids,
        lambda x: F.struct(
            (~x.rlike(r"^\d+$")).alias("word"),
            F.when(x.rlike(r"^\d+$"), F.length(x)).otherwise(0).alias("digits"),
            x.alias("text"),
        ),
    )
    return F.struct(
        valid.alias("valid"), number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch"),
        (F.size(ids) == 0).alias("release"), pre.alias("pre"), F.when(valid, part(5)).otherwise(version).alias("rest"),
    )


def is_stable(version: Column) -> Column:
    return version.rlike(SEMVER) & (F.regexp_extract(version, SEMVER, 4) == "")


def newest_key(version: Column, include_pre: bool) -> Column:
    """Order for the newest version: stable ones beat pre-releases unless those are asked for."""
    return semver(version) if include_pre else F.struct(is_stable(version).alias("stable"), semver(version).alias("key"))


def staleness_text(state: Column, recorded: Column, current: Column) -> Column:
    short = lambda c: F.substring(c, 1, 8)
    return (
        F.when(state == "never", "never parsed")
        .when(state == "newer", F.concat(F.lit("crates.io "), current, F.lit(" vs recorded "), recorded))
        .when(state == "revision", F.concat(F.lit("parser "), short(recorded), F.lit(" \u2192 "), short(current)))
        .when(state == "schema", F.concat(F.lit("schema v"), recorded, F.lit(" \u2192 v"), current))
        .otherwise("fresh")
    )


def plan_reason(forced: Column, staleness: Column) -> Column:
    return F.when(forced, F.concat(F.lit("forced (otherwise: "), staleness, F.lit(")"))).otherwise(staleness)


def parser_target(reason: Column) -> Column:
    """The revision that a reason names as its target, null if it names none."""
    return F.nullif(F.regexp_extract(reason, r"\bparser\s+\S+\s+(?:\u2192|->)\s+([0-9a-fA-F]{7,40})\b", 1), F.lit(""))


def schema_target(reason: Column) -> Column:
    """The schema version that a reason names as its target, null if it names none."""
    return F.regexp_extract(reason, r"\bschema\s+v\d+\s+(?:\u2192|->)\s+v(\d+)\b", 1).try_cast("int")


def revision_matches(actual: Column, target: Column) -> Column:
    """Whether a revision is the one that a text of it, maybe shortened, means."""
    return F.coalesce((F.length(actual) > 0) & actual.startswith(target), F.lit(False))


def run_id(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9-]", "-")


def repository_of(url: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_extract(url, r"github\.com[/:]([^/\s]+/[^/\s#?]+)", 1), r"\.git$", ""), F.lit(""))


def index_path(name: Column) -> Column:
    n = F.lower(name)
    return (
        F.when(F.length(n) == 1, F.concat(F.lit("1/"), n))
        .when(F.length(n) == 2, F.concat(F.lit("2/"), n))
        .when(F.length(n) == 3, F.concat(F.lit("3/"), F.substring(n, 1, 1), F.lit("/"), n))
        .otherwise(F.concat(F.substring(n, 1, 2), F.lit("/"), F.substring(n, 3, 2), F.lit("/"), n))
    )


def docs_url(node_id: Column, kind: Column, version: Column) -> Column:
    """Where an item of another package is documented."""
    parts, package = segments(node_id), package_of(node_id)
    standard = package.isin("std", "core", "alloc")
    host = F.when(standard, F.concat(F.lit("https://doc.rust-lang.org/stable/"), package)).otherwise(F.concat(F.lit("https://docs.rs/"), package, F.lit("/"), F.coalesce(version, F.lit("latest")), F.lit("/"), F.replace(package, F.lit("-"), F.lit("_"))))
    inner = F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), "/")
    middle = F.when(inner == "", F.lit("/")).otherwise(F.concat(F.lit("/"), inner, F.lit("/")))
    page = F.when(F.size(parts) == 1, F.lit("index.html")).when(kind == "Module", F.concat(last_segment(node_id), F.lit("/index.html"))).otherwise(F.concat(kind_slug(kind), F.lit("."), last_segment(node_id), F.lit(".html")))
    return F.concat(host, middle, page)


def source_url(package: Column, version: Column, file: Column, line: Column) -> Column:
    return F.when(package.isNotNull() & version.isNotNull() & file.isNotNull() & line.isNotNull(), F.concat(F.lit("https://docs.rs/crate/"), package, F.lit("/"), version, F.lit("/source/"), file, F.lit("#L"), line.cast("string")))


def valid_name(c: Column) -> Column:
    return c.rlike("^[a-zA-Z][a-zA-Z0-9_-]{0,63}$")


def valid_version(c: Column) -> Column:
    return c.isin("latest", "stable", "beta", "nightly") | ((F.length(c) <= 64) & c.rlike(SEMVER))


def derive_names(attribute: Column) -> Column:
    """The names inside the first derive(...) of an attribute."""
    inside = F.regexp_extract(attribute, r"derive\(([^)]*)\)", 1)
    return F.filter(F.transform(F.split(inside, ","), lambda x: F.trim(x)), lambda x: x != "")


def shown_code(code: Column) -> Column:
    """A documentation example without its hidden lines: '#' and '# ...' go, '##...' loses one '#'."""
    lines = F.filter(F.split(code, "\n"), lambda x: ~(F.trim(x).isin("#") | F.ltrim(x).startswith("# ")))
    return F.array_join(F.transform(lines, lambda x: F.when(F.ltrim(x).startswith("##"), F.regexp_replace(x, r"^(\s*)##", "$1#")).otherwise(x)), "\n")


def fence_language(info: Column) -> Column:
    """struct<language, is_rust> of a code fence's info string."""
    tokens = F.filter(F.split(F.lower(info), r"[,\s]+"), lambda x: x != "")
    flags = ("rust", "should_panic", "no_run", "ignore", "compile_fail", "standalone_crate")
    is_flag = lambda x: x.isin(*flags) | x.rlike(r"^edition\d{4}$") | x.rlike(r"^e\d{4}$") | x.startswith("ignore-")
    first = F.get(F.filter(tokens, lambda x: ~is_flag(x)), F.lit(0))
    return F.struct(F.coalesce(first, F.lit("rust")).alias("language"), first.isNull().alias("is_rust"))


def toolchain_query(query: Column) -> Column:
    """What a search for the toolchain's packages asks for: a struct of the name as packages write it and the channel that it ends with."""
    value = F.regexp_replace(F.lower(F.trim(query)), r"proc[\s-]+macro", "proc_macro")
    ending = r"(?:^|[@:\s])(stable|beta|nightly)\z"
    return F.struct(F.regexp_replace(F.trim(F.regexp_replace(value, ending, "")), r"[\s-]+", "_").alias("name"), F.nullif(F.regexp_extract(value, ending, 1), F.lit("")).alias("channel"))


def prefer_non_empty(a: Column, b: Column) -> Column:
    return F.when(F.size(a) > 0, a).when(F.size(b) > 0, b).otherwise(F.coalesce(a, b))


def bucket_count(total: Column, target: int, least: int, most: int) -> Column:
    """The next power of two that keeps buckets near ``target`` bytes, within bounds."""
    wanted = F.greatest(F.ceil(total / F.lit(target)), F.lit(least))
    return F.least(F.pow(F.lit(2), F.ceil(F.log2(wanted))).cast("bigint"), F.lit(most))


def abi_text(abi: Column) -> Column:
    """The name of a calling convention (VARIANT: a name, or an object of a tag with its unwinding, or of any other name); none for the
    language's own."""
    unwind = lambda tag: F.try_variant_get(abi, f"$.{tag}.unwind", "boolean")
    named = [F.when(unwind(tag).isNotNull(), F.concat(F.lit(text), F.when(unwind(tag), "-unwind").otherwise(""))) for tag, text in CONVENTIONS.items()]
    return F.coalesce(F.try_variant_get(abi, "$.Other", "string"), *named)
