"""Kinds, their order and labels, relations, limits. Stated as data, joined as small dimension tables."""

# Node kinds in display order, with label and slug.
NODE_KINDS = [
    ("Crate", "Package", "crate"), ("Module", "Module", "mod"), ("Struct", "Struct", "struct"), ("Union", "Union", "union"),
    ("Enum", "Enum", "enum"), ("Variant", "Variant", "variant"), ("Trait", "Trait", "trait"), ("TraitAlias", "Trait alias", "traitalias"),
    ("Impl", "Implementation", "impl"), ("Function", "Function", "fn"), ("Method", "Method", "method"), ("TraitMethod", "Trait method", "tymethod"),
    ("Field", "Field", "structfield"), ("TypeAlias", "Type alias", "type"), ("AssocType", "Associated type", "associatedtype"),
    ("Constant", "Constant", "constant"), ("AssocConst", "Associated constant", "associatedconstant"), ("Static", "Static", "static"),
    ("Macro", "Macro", "macro"), ("ProcMacro", "Procedural macro", "procmacro"), ("Primitive", "Primitive", "primitive"),
]

STRUCTURAL = ("Contains", "Defines")
SEMANTIC = ("UsesType", "Implements", "CallsStatic", "CallsRuntime", "Derives", "ReExports")

# Relation, label of incoming and outgoing edges, display order.
RELATIONS = [
    ("Contains", "contains", "in", "contains", 0), ("Defines", "defines", "defined by", "defines", 1), ("UsesType", "uses", "used by", "uses", 2),
    ("Implements", "implements", "implemented by", "implements", 3), ("Derives", "derives", "derived by", "derives", 4),
    ("CallsStatic", "calls", "called by", "calls", 5), ("CallsRuntime", "calls", "called by", "calls", 6), ("ReExports", "reexports", "re-exported by", "re-exports", 7),
]

#: Which confidence wins when equal edges merge, and which one an overview shows: the first is strongest.
MERGE_CONFIDENCE = ("Runtime", "Static", "Inferred")
OVERVIEW_CONFIDENCE = ("Inferred", "Runtime", "Static")

TOP_RANK = 5000
PRIORITY_TIERS = ("forced", "top-download-stale", "newer-version", "catalog-stale", "catalog-newer", "never-parsed-backfill", "long-tail-backfill")
#: Which of three lanes (popular, catalog, backfill) each tier is in, and takes each of ten slots in daily and in backfill plans.
TIER_LANES = {"forced": -1, "top-download-stale": 0, "newer-version": 0, "catalog-stale": 1, "catalog-newer": 1, "never-parsed-backfill": 2, "long-tail-backfill": 2}
LANE_PATTERNS = {"daily": (0, 0, 1, 0, 2, 0, 1, 0, 2, 1), "backfill": (2, 2, 1, 2, 0, 2, 1, 2, 0, 2)}
MAX_DEPTH = 64

# Relations in the order in which a focused view keeps them; kinds that it hides unless asked for.
FOCUS_ORDER = ("UsesType", "CallsStatic", "CallsRuntime", "Implements", "Derives", "Contains", "Defines", "ReExports")
TRAIT_LIKE = ("Trait", "TraitAlias")
INTERNAL_ONLY = ("Impl", "StructField", "Variant", "AssocType", "AssocConst")
SUMMARY_PREFIX = "__cv_graph_summary__"

# Outcomes of a run that renew a package's record.
GOOD_OUTCOMES = ("published", "parser-bumped", "fresh")

# Channels of the toolchain in the order in which they are listed.
CHANNELS = ("stable", "beta", "nightly")

# Steps in which a status waits and uses no capacity; names of calling conventions by their tags in API documents.
WAITING_STEPS = ("waiting-capacity", "waiting-github-capacity", "waiting-rate-limit")
CONVENTIONS = {"C": "C", "Cdecl": "cdecl", "Stdcall": "stdcall", "Fastcall": "fastcall", "Aapcs": "aapcs", "Win64": "win64", "SysV64": "sysv64", "System": "system"}
