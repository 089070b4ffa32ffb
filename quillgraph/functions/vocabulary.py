"""Relation sets, type names and word lists that decide results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Relations by what they mean to an operator.
AFFECTED = (
    "calls", "indirect_call", "references", "imports", "imports_from", "dynamic_import", "re_exports", "inherits", "extends", "implements",
    "uses", "mixes_in", "embeds", "requires",
)
IMPACT = ("calls", "imports", "inherits", "implements", "references", "depends_on", "subscribes_to")
FORWARD = (
    "calls", "indirect_call", "references", "imports", "imports_from", "depends_on", "uses", "dynamic_import", "routes_to", "handles", "sends_to",
    "publishes_to", "subscribes_to", "writes_to", "reads_from", "queries", "mutates",
)
SUBTYPE = ("inherits", "implements", "extends", "subclass_of", "subtype_of", "embeds", "mixes_in")
NOT_A_REFERENCE = ("contains", "parent_of", "has_part", "rationale_for", "part_of")
STRUCTURAL = ("imports", "imports_from", "contains", "method")
GENERIC = ("references", "uses", "mentions")
DEAD_CODE_INBOUND = ("calls", "references", "imports", "inherits", "instantiates", "uses", "subscribes_to")
CYCLE = ("imports_from", "re_exports")
MEMBER = ("method", "contains")
CALLS = ("calls", "indirect_call")

# Node types, and spellings that stand for one of them.
FILE_TYPES = ("code", "document", "paper", "image", "rationale", "concept")
FILE_TYPE_SYNONYMS = {"markdown": "document", "text": "document", "tool": "code", "library": "code"}
CONFIDENCE_SCORES = {"EXTRACTED": 1.0, "INFERRED": 0.55, "AMBIGUOUS": 0.2}

# File endings of languages that link to each other, for edges and for surprise scores.
EDGE_FAMILIES = {
    "py": ("py", "pyi"),
    "js": ("js", "mjs", "cjs", "jsx", "ts", "tsx", "mts", "cts"),
    "go": ("go",),
    "rs": ("rs",),
    "jvm": ("java", "kt", "scala", "groovy"),
    "c": ("c", "h", "cc", "cpp", "hpp", "cxx", "hh", "hxx", "cu", "cuh", "metal", "m", "mm"),
    "rb": ("rb", "rake"),
    "php": ("php",),
    "cs": ("cs",),
    "swift": ("swift",),
    "lua": ("lua",),
}
SURPRISE_FAMILIES = {
    "python": ("py", "pyw"),
    "js": ("js", "jsx", "mjs", "cjs", "ejs", "ts", "tsx", "mts", "cts", "vue", "svelte"),
    "go": ("go",),
    "rust": ("rs",),
    "jvm": ("java", "kt", "kts", "scala"),
    "c": ("c", "h", "cpp", "cc", "cxx", "hpp"),
    "ruby": ("rb", "rake"),
    "swift": ("swift",),
    "dotnet": ("cs",),
    "php": ("php",),
    "r": ("r",),
    "cobol": ("cbl", "cob", "cobol", "cpy"),
}

# File endings by category.
CODE_ENDINGS = (
    "py ts tsx mts cts js jsx mjs cjs ejs ets go rs cbl cob cobol cpy java groovy gradle cpp cc cxx c h hpp cu cuh metal rb rake swift kt kts cs "
    "scala php lua luau toc zig ps1 psm1 psd1 ex exs m mm ml mli jl vue svelte astro dart v sv svh sql r f f90 f95 f03 f08 pas pp dpr dpk lpr inc "
    "dfm lfm lpk sh bash json tf tfvars hcl dm dme dmi dmm dmf sln slnx csproj fsproj vbproj xaml razor cshtml cls trigger lisp cl lsp asd robot "
    "resource proto avsc bzl bazel"
).split()
DOCUMENT_ENDINGS = "md mdx qmd skill txt rst".split()
IMAGE_ENDINGS = "png jpg jpeg gif webp svg".split()

# Labels of nodes that say nothing about a code base.
NOISE_LABELS = (
    "str int float bool bytes bytearray complex object True False MagicMock Mock AsyncMock NonCallableMock NonCallableMagicMock PropertyMock patch "
    "sentinel Path Any Optional List Dict Set Tuple Union Callable Type ClassVar Final Literal Protocol Counter defaultdict OrderedDict datetime "
    "Enum os sys re json io abc typing Foundation SwiftUI UIKit AppKit Combine String Int Double Float Bool Data URL Date UUID Sendable Codable "
    "Decodable Encodable Equatable Hashable Identifiable Comparable AnyObject Error LocalizedError NSObject NSString NSError NSLock View Color Font "
    "DispatchQueue"
).split()
JSON_NOISE_LABELS = (
    "start end name id type properties value key data items title description version dependencies devdependencies peerdependencies "
    "optionaldependencies bundleddependencies bundledependencies"
).split()

# Words that carry no meaning in English prose and in programs.
ENGLISH_STOPWORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can cannot could did do "
    "does doing down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its "
    "itself me more most my myself no nor not of off on once only or other ought our ours ourselves out over own same she should so some such than "
    "that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which "
    "while who whom why with would you your yours yourself yourselves also etc eg ie will shall just well"
).split()
PROGRAM_STOPWORDS = (
    "def class fn func function var let const val import export from return yield async await try catch finally except throw raise if else elif for "
    "while loop break continue switch case default match true false null none nil undefined self this super new delete struct interface type enum "
    "impl pub public private protected static final void int float double bool boolean string str list dict set tuple map array object package "
    "namespace module use using include require echo print println log error info debug warn test assert todo fixme note pass lambda mut ref extern "
    "auto goto typedef sizeof override virtual implements extends throws transient volatile synchronized native strictfp operator template typename "
    "constexpr decltype noexcept friend explicit"
).split()

# What names an environment, and names that are called from outside a code base.
ENVIRONMENTS = ("dev", "development", "staging", "stage", "prod", "production", "test", "qa", "uat")
ENTRY_NAMES = ("main", "cli", "run", "execute", "handler", "setup", "teardown", "setUp", "tearDown", "app", "create_app")

# Words of a question that name an edge context, and other names of contexts.
CONTEXT_HINTS = {
    "call": "call calls called caller callers invoke invokes invoked",
    "import": "import imports imported module modules",
    "field": "field fields member members property properties",
    "parameter_type": "parameter parameters param params argument arguments",
    "return_type": "return returns returned",
    "generic_arg": "generic generics template templates",
}
CONTEXT_ALIASES = {
    "parameter_type": "param params parameter parameters argument arguments arg args",
    "return_type": "return returns returned",
    "generic_arg": "generic generics template templates",
    "attribute": "annotation annotations decorator decorators",
    "call": "calls called invoke invocation",
    "field": "fields property properties member members",
    "import": "imports imported module modules",
    "export": "exports exported",
}


def one_of(x: Column, values: object) -> Column:
    return x.isin(*values)


def lookup(x: Column, groups: dict[str, object]) -> Column:
    """The name of the group that lists ``x``, null if none does."""
    out = F.lit(None).cast("string")
    for name, values in groups.items():
        out = F.when(x.isin(*values), name).otherwise(out)
    return out
