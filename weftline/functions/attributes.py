"""Attributes of items as they stand in source, from the forms that API documents give them in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Markers that the compiler leaves for itself; markers with a stability; how inlining is written.
INTERNAL = (
    "CfgAttrTrace", "CfgTrace", "AllowInternalUnsafe", "AllowInternalUnstable", "AllowConstFn", "RustcAllowConstFnUnstable", "Feature",
    "DocAlias", "ProcMacro", "Used", "Coverage", "PassByValue", "PointeeSized", "ConstParamTy",
)
STABILITIES = ("Stability", "ConstStability", "DefaultBodyStability", "BodyStability")
INLINE = {"Hint": "#[inline]", "Always": "#[inline(always)]", "Never": "#[inline(never)]"}
OPTIMIZE = {"Speed": "#[optimize(speed)]", "Size": "#[optimize(size)]"}
UNITS = ("non_exhaustive", "macro_export", "automatically_derived", "no_mangle")
REPRESENTATIONS = {"rust": "rust", "c": "C", "transparent": "transparent", "simd": "simd"}


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _between(text: Column, start: str, end: str) -> Column:
    """What stands between the first ``start`` and the next ``end``; null where one of them is missing."""
    pattern = rf"\Q{start}\E([\s\S]*?)\Q{end}\E"
    return F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_extract(text, pattern, 1))


def _held(payload: Column, name: str, quote: str = "") -> Column:
    """X of a payload ``name(X)``, else null."""
    return F.when(payload.rlike(rf"^{name}\({quote}[\s\S]*{quote}\)\z") & (F.length(payload) >= len(name) + 2 + 2 * len(quote)), F.substring(payload, F.lit(len(name) + 2 + len(quote)), F.length(payload) - (len(name) + 2 + 2 * len(quote))))


def snake(name: Column) -> Column:
    """Capitals after small letters begin a new word; ASCII capitals become small."""
    return F.translate(F.regexp_replace(name, r"(?<=\p{IsLowercase})(?=\p{IsUppercase})", "_"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _stability(payload: Column) -> Column:
    """A stable or unstable marker in its source form, null if parts of it are missing."""
    feature = _between(payload, 'feature: "', '"')
    numbers = [_between(payload, "major: ", ","), _between(payload, "minor: ", ","), F.regexp_replace(_between(payload, "patch: ", " "), r"[})]+\z", "")]
    dotted = F.concat(numbers[0], F.lit("."), numbers[1], F.lit("."), numbers[2])
    issue = F.coalesce(F.regexp_replace(F.trim(_between(payload, "issue: ", "}")), r"[,)]+\z", ""), F.lit("None"))
    parts = F.concat_ws(
        ", ", F.concat(F.lit('feature = "'), feature, F.lit('"')), F.when((issue != "None") & (issue != ""), F.concat(F.lit('issue = "'), issue, F.lit('"'))),
        F.concat(F.lit('reason = "'), _between(payload, 'reason: Some("', '")'), F.lit('"')),
    )
    stable = F.concat(F.lit('#[stable(feature = "'), feature, F.lit('", since = "'), dotted, F.lit('")]'))
    return F.when(payload.contains("level: Stable "), stable).when(payload.contains("level: Unstable ") & feature.isNotNull(), F.concat(F.lit("#[unstable("), parts, F.lit(")]")))


def _named(arg: Column, known: dict[str, str], hidden: str, other: Column) -> Column:
    out = F.when(arg == hidden, F.lit(None).cast("string"))
    for name, text in known.items():
        out = out.when(arg == name, text)
    return out.otherwise(other)


def _payload_text(payload: Column) -> Column:
    """A structured marker in its source form, null if it is for the compiler alone."""
    attribute = lambda *parts: F.concat(F.lit("#["), *parts, F.lit("]"))
    lang, item = _held(payload, "Lang"), _held(payload, "RustcDiagnosticItem", '"')
    inline, optimize = _held(payload, "Inline"), _held(payload, "Optimize")
    stable = F.when(payload.rlike(f"^({'|'.join(STABILITIES)}) "), _stability(payload))
    return (
        F.when(payload.rlike(rf"^({'|'.join(INTERNAL)})(\(|\z)"), F.lit(None).cast("string"))
        .when(lang.isNotNull(), attribute(F.lit('lang = "'), snake(lang), F.lit('"')))
        .when(item.isNotNull(), attribute(F.lit('rustc_diagnostic_item = "'), item, F.lit('"')))
        .when(stable.isNotNull(), stable)
        .when(inline.isNotNull(), _named(inline, INLINE, "No", F.lit("#[inline]")))
        .when(optimize.isNotNull(), _named(optimize, OPTIMIZE, "None", attribute(F.lit("optimize("), F.lower(optimize), F.lit(")"))))
        .when(payload.rlike(r"^\p{IsUppercase}[\p{IsAlphabetic}\p{N}_]*\z"), attribute(snake(payload)))
        .otherwise(attribute(payload))
    )


def cleaned(value: Column) -> Column:
    """An attribute's text as it stands in source: names of traces restored, lines joined, structured markers written out, those of the
    compiler null."""
    restored = F.replace(F.replace(value, F.lit("<cfg_attr_trace>"), F.lit("cfg_attr")), F.lit("<cfg_trace>"), F.lit("cfg"))
    lines = F.filter(F.transform(F.split(restored, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")), lambda x: x != "")

    def text(line: Column) -> Column:
        wrapped = line.startswith("#[attr = ") & line.endswith("]")
        return F.when(wrapped, _let(F.substring(line, F.lit(10), F.length(line) - 10), _payload_text)).otherwise(line)

    return _let(F.array_join(lines, " "), text)


def _get(attribute: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(attribute, path, kind)


def attribute_text(attribute: Column) -> Column:
    """An attribute (VARIANT: a name, or an object with one) as it stands in source; null if it isn't shown."""
    reason, features = _get(attribute, "$.must_use.reason"), _get(attribute, "$.target_feature.enable", "array<string>")
    kind = _get(attribute, "$.repr.kind")
    shown = F.coalesce(*[F.when(kind == k, v) for k, v in REPRESENTATIONS.items()])
    sized = lambda name: F.concat(F.lit(f"{name}("), _get(attribute, f"$.repr.{name}", "long").cast("string"), F.lit(")"))
    quoted = lambda name: F.concat(F.lit(f'#[{name} = "'), _get(attribute, f"$.{name}"), F.lit('"]'))
    return (
        F.when(_get(attribute, "$.other").isNotNull(), cleaned(_get(attribute, "$.other")))
        .when(_get(attribute, "$.must_use", "variant").isNotNull(), F.when(reason.isNull(), "#[must_use]").otherwise(F.concat(F.lit('#[must_use = "'), reason, F.lit('"]'))))
        .when(kind.isNotNull(), F.concat(F.lit("#[repr("), F.concat_ws(", ", shown, _get(attribute, "$.repr.int"), sized("align"), sized("packed")), F.lit(")]")))
        .when(features.isNotNull(), F.concat(F.lit("#[target_feature("), F.array_join(F.transform(features, lambda x: F.concat(F.lit('enable = "'), x, F.lit('"'))), ", "), F.lit(")]")))
        .otherwise(F.coalesce(quoted("export_name"), quoted("link_section"), F.when(_get(attribute, "$").isin(*UNITS), F.concat(F.lit("#["), _get(attribute, "$"), F.lit("]")))))
    )


def attribute_texts(attributes: Column) -> Column:
    """Those of an item that are shown, in order."""
    return F.filter(F.transform(attributes, attribute_text), lambda x: x.isNotNull())
