"""Properties of nodes, files and pull requests, decided from their columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions import vocabulary as V


def _any(tests: list[Column]) -> Column:
    return reduce(Column.__or__, tests)


def _has(x: Column, *parts: str) -> Column:
    return _any([x.contains(p) for p in parts])


def _starts(x: Column, *parts: str) -> Column:
    return _any([x.startswith(p) for p in parts])


def text_of(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def ending(path: Column) -> Column:
    """The lower-cased file ending without its dot, '' without one."""
    name = base_name(text_of(path))
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def source_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def file_type(x: Column) -> Column:
    """One of the known types; synonyms are folded, anything else is a concept."""
    key = F.lower(F.trim(text_of(x)))
    out = F.when(key.isin(*V.FILE_TYPES), key)
    for name, known in V.FILE_TYPE_SYNONYMS.items():
        out = out.when(key == name, known)
    return out.otherwise("concept")


def confidence(x: Column) -> Column:
    key = F.upper(F.trim(text_of(x)))
    return F.when(key.isin(*V.CONFIDENCE_SCORES), key).otherwise("EXTRACTED")


def confidence_score(score: Column, level: Column) -> Column:
    default = F.lit(1.0)
    for name, value in V.CONFIDENCE_SCORES.items():
        default = F.when(level == name, value).otherwise(default)
    return F.when(score.isNull() | F.isnan(score) | (score < 0) | (score == float("inf")), default).otherwise(score)


def weight(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (x < 0) | (x == float("inf")), 1.0).otherwise(x)


def line_number(location: Column) -> Column:
    return F.expr("int(null)") if location is None else F.regexp_extract(text_of(location), r"L?(\d+)", 1).try_cast("int")


def edge_family(path: Column) -> Column:
    return V.lookup(ending(path), V.EDGE_FAMILIES)


def surprise_family(path: Column) -> Column:
    return V.lookup(ending(path), V.SURPRISE_FAMILIES)


def file_category(path: Column) -> Column:
    """code, paper, image or doc, by the part after the last dot of the path."""
    last = F.when(path.contains("."), F.lower(F.substring_index(path, ".", -1))).otherwise("")
    return F.when(last.isin(*V.CODE_ENDINGS), "code").when(last == "pdf", "paper").when(last.isin(*V.IMAGE_ENDINGS), "image").otherwise("doc")


def top_directory(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def names_its_file(label: Column, path: Column) -> Column:
    """The label is the file's name or an end of its path."""
    label, path = text_of(label), text_of(path)
    tail = label.contains("/") & ((path == label) | F.endswith(path, F.concat(F.lit("/"), label)))
    return (label != "") & (path != "") & ((label == base_name(path)) | tail)


def is_file_node(label: Column, path: Column, degree: Column) -> Column:
    label = text_of(label)
    stub = label.endswith("()") & (label.startswith(".") | (degree <= 1))
    return (label != "") & (names_its_file(label, path) | stub)


def is_concept_node(path: Column) -> Column:
    return (text_of(path) == "") | ~base_name(text_of(path)).contains(".")


def is_json_key(label: Column, path: Column) -> Column:
    return F.lower(text_of(path)).endswith(".json") & F.lower(F.trim(text_of(label))).isin(*V.JSON_NOISE_LABELS)


def is_noise(label: Column) -> Column:
    return text_of(label).isin(*V.NOISE_LABELS)


def is_test(label: Column, path: Column) -> Column:
    label, path = F.lower(text_of(label)), F.lower(text_of(path))
    return _has(path, "test_", "_test", "tests/") | _has(label, "test_", "_test") | label.startswith("test")


def is_api(label: Column, kind: Column) -> Column:
    verbs = [f"{v} " for v in ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")]
    return F.lower(text_of(kind)).isin("api", "rpc", "endpoint") | _any([text_of(label).startswith(v) | text_of(label).contains(" " + v) for v in verbs])


def is_infrastructure(path: Column, kind: Column) -> Column:
    named = _has(F.lower(text_of(path)), "dockerfile", "docker-compose", "terraform", ".tf", "helm", "k8s")
    return F.lower(text_of(kind)).isin("k8s", "terraform", "helm", "kafka", "docker") | named


def node_category(label: Column, node_id: Column, kind: Column, path: Column) -> Column:
    """What a node is in an execution flow; the first rule that holds decides."""
    raw = F.when(text_of(label) == "", node_id).otherwise(label)
    label, node_id, kind, source = F.lower(raw), F.lower(text_of(node_id)), F.lower(text_of(kind)), F.lower(text_of(path))
    # Kinds, and parts of labels, that show a category.
    verbs = [f"{v} " for v in ("get", "post", "put", "delete", "patch", "head", "options")]
    rules = {
        "cache": kind.isin("cache", "redis", "memcached") | _has(label, "redis", "memcached", "cache"),
        "queue": kind.isin("kafka_topic", "topic", "queue", "kafka", "rabbitmq", "sqs", "pubsub")
        | _has(label, "kafka", "topic", "queue", "rabbitmq", "sqs") | node_id.startswith("kafka_"),
        "external_api": kind.isin("external_api", "external_http", "external", "webhook", "remote_service")
        | _starts(label, "http://", "https://") | _starts(node_id, "http://", "https://") | _has(label, "webhook", "external:"),
        "database": kind.isin("table", "sql_table", "database", "db", "sql", "repository", "entity", "model") | source.endswith(".sql")
        | _starts(node_id, "sql_table_", "table_") | label.contains(" table") | label.endswith("_table") | _starts(label, "table:", "db:")
        | _has(label, "database", "postgres", "mysql", "sqlite", "mongodb", "dynamodb"),
        "route": kind.isin("route", "endpoint", "http_route", "api_endpoint", "api", "rest_endpoint") | _starts(label, *verbs)
        | label.contains("route:") | label.startswith("route "),
        "rpc": kind.isin("rpc", "grpc", "grpc_rpc", "grpc_service") | _starts(label, "rpc:", "rpc ") | label.contains("grpc"),
        "cli": kind.isin("cli", "cli_command", "command", "entry", "entry_point") | _starts(label, "cli:", "cmd:")
        | label.isin("main", "main()", "run()", "cli()") | _has(label, "click.command", "app.command"),
        "consumer": kind.isin("consumer", "event_consumer", "listener", "subscriber", "kafka_consumer", "sqs_consumer", "worker", "job")
        | _has(label, "consumer", "listener", "subscriber", "on_message", "handle_event"),
        "middleware": kind.isin("middleware", "interceptor", "filter", "guard") | _has(label, "middleware", "interceptor", "filter", "guard", "cors"),
        "controller": kind.isin("controller", "handler") | _has(label, "controller", "handler"),
        "service": kind.isin("service", "manager", "processor", "usecase") | _has(label, "service", "manager", "processor", "usecase"),
        "module": kind.isin("module", "file") | ((source != "") & (raw == base_name(text_of(path)))),
    }
    out = None
    for name, rule in rules.items():
        out = F.when(rule, name) if out is None else out.when(rule, name)
    return out.otherwise("function")


ENTRY_CATEGORIES = ("route", "rpc", "cli", "consumer")
SINK_CATEGORIES = ("database", "cache", "queue", "external_api")


def architecture_role(label: Column, kind: Column, path: Column) -> Column:
    """The role of a node in the architecture; the first rule that holds decides."""
    label, kind, source = F.lower(F.trim(text_of(label))), F.lower(text_of(kind)), F.lower(text_of(path))
    # Kinds, and parts of labels, that show a role.
    rules = {
        "database": kind.isin("table", "sql_table", "database", "db", "sql", "repository", "entity", "model") | source.endswith(".sql")
        | _has(label, "table", "repository", "database", "sqlite", "postgres", "mysql", "dynamodb", "mongodb", "store", "model", "schema"),
        "cache": kind.isin("cache", "redis", "memcached") | _has(label, "redis", "memcached", "cache"),
        "queue": kind.isin("kafka_topic", "topic", "queue", "kafka", "rabbitmq", "sqs", "pubsub")
        | _has(label, "kafka", "topic", "queue", "rabbitmq", "sqs", "event_stream", "producer", "publish"),
        "external_api": kind.isin("external_api", "external_http", "external", "remote_service", "gateway")
        | _starts(label, "http://", "https://", "external:") | _has(label, "gateway", "webhook", "external", "remote", "client", "sdk", "api_client"),
        "route": kind.isin("route", "endpoint", "http_route", "api_endpoint", "api", "rest_endpoint")
        | _starts(label, "get ", "post ", "put ", "delete ", "patch ") | _has(label, "route:", "endpoint"),
        "rpc": kind.isin("rpc", "grpc", "grpc_rpc", "grpc_service") | label.startswith("rpc:") | label.contains("grpc"),
        "cli": kind.isin("cli", "cli_command", "command", "entry", "entry_point") | _starts(label, "cli:", "cmd:")
        | label.isin("main", "main()", "cli()", "run()") | _has(label, "command"),
        "consumer": kind.isin("consumer", "event_consumer", "listener", "subscriber", "worker", "job")
        | _has(label, "consumer", "listener", "subscriber", "on_message", "handle_event"),
        "middleware": kind.isin("middleware", "guard", "interceptor", "filter", "validator")
        | _has(label, "guard", "auth", "validat", "risk", "fraud", "schema", "verify", "permission", "idempotenc"),
        "controller": kind.isin("controller", "handler") | _has(label, "controller", "handler"),
        "service": kind.isin("service", "manager", "processor", "usecase", "engine", "orchestrator")
        | _has(label, "service", "manager", "processor", "usecase", "engine", "orchestrat", "intent", "pipeline"),
        "class": kind.isin("class", "struct", "interface"),
    }
    out = None
    for name, rule in rules.items():
        out = F.when(rule, name) if out is None else out.when(rule, name)
    return out.otherwise("function")


def architecture_stage(role: Column) -> Column:
    """The stage a role belongs to; roles without one are processing."""
    return (
        F.when(role == "queue", "events").when(role.isin("database", "cache"), "settlement").when(role == "external_api", "gateway")
        .when(role.isin("route", "cli", "rpc"), "initiation").when(role.isin("middleware", "controller"), "validation").otherwise("processing")
    )


def path_category(path: Column) -> Column:
    """The area a file belongs to, from its first directory or, at the top, its ending."""
    clean = F.regexp_replace(source_path(text_of(path)), "^/+|/+$", "")
    parts = F.split(clean, "/")
    first = F.lower(parts[0])
    last = ending(clean)
    # Directories that name an area.
    at_top = F.when(last.isin("md", "txt", "rst"), "documentation").when(last.isin("tf", "tfvars", "hcl"), "infrastructure").when(last.isin("yaml", "yml", "json"), "configuration").otherwise("root")
    below = (
        F.when(first.isin("charts", "helm"), "helm").when(first.isin("k8s", "kubernetes", "manifests"), "kubernetes")
        .when(first.isin("terraform", "tf", "infra", "infrastructure", "iac"), "infrastructure").when(first.isin("docs", "documentation", "wiki"), "documentation")
        .when(first.isin("tests", "test", "spec", "specs"), "testing")
        .when(first.isin("src", "lib", "app", "pkg", "packages") & (F.size(parts) > 2), F.lower(F.get(parts, F.lit(1)))).otherwise(first)
    )
    return F.when(text_of(path) == "", "general").when(F.size(parts) <= 1, at_top).otherwise(below)


def environment(path: Column) -> Column:
    """The environment that a path segment equals, starts or ends with; null without one."""
    def of(part: Column) -> Column:
        part = F.lower(part)
        out = F.when(part.isin(*V.ENVIRONMENTS), part)
        for e in V.ENVIRONMENTS:
            out = out.when(part.startswith(e + "-") | part.endswith("-" + e), e)
        return out

    return F.get(F.filter(F.transform(F.split(source_path(text_of(path)), "/"), of), lambda x: x.isNotNull()), F.lit(0))


def same_path(a: Column, b: Column) -> Column:
    """Equal, or one is the other's end at a directory."""
    return (a == b) | F.endswith(a, F.concat(F.lit("/"), b)) | F.endswith(b, F.concat(F.lit("/"), a))


def url_type(url: Column) -> Column:
    lower = F.lower(url)
    path = F.regexp_extract(lower, r"^(?:[a-z][a-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return (
        F.when(_has(lower, "twitter.com", "x.com"), "tweet").when(lower.contains("arxiv.org"), "arxiv").when(lower.contains("github.com"), "github")
        .when(_has(lower, "youtube.com", "youtu.be"), "youtube").when(path.endswith(".pdf"), "pdf")
        .when(path.rlike(r"\.(png|jpg|jpeg|webp|gif)$"), "image").otherwise("webpage")
    )


def is_sensitive(path: Column) -> Column:
    """Files that look like credentials, by a directory above them or by their name; source code in ambiguous directories and templates are none."""
    whole = source_path(text_of(path))
    name, above = base_name(whole), F.transform(F.slice(F.split(whole, "/"), 1, F.greatest(F.size(F.split(whole, "/")) - 1, F.lit(0))), F.lower)
    # Patterns of credential file names.
    patterns = (
        r"(?i)^\.(env|envrc)(\.|$)",
        r"(?i)\.(pem|key|p12|pfx|cert|crt|der|p8)$",
        r"(?i)(^|[^A-Za-z0-9])(id_rsa|id_dsa|id_ecdsa|id_ed25519)(\.pub)?$",
        r"(?i)^secring(\.(gpg|pgp))?$",
        r"(?i)(\.netrc|\.pgpass|\.htpasswd|\.npmrc|\.pypirc|\.git-credentials|\.boto)$",
    )
    # Directories of credential stores, and those that may be source packages as well.
    stores, ambiguous, templates = (".ssh", ".gnupg", ".aws", ".gcloud"), ("secrets", ".secrets", "credentials"), r"(?i)^\.(env|envrc)\..*(example|sample|template|dist)$"
    source = ending(path).isin(*(e for e in V.CODE_ENDINGS if e not in ("json", "yaml", "yml", "toml", "xml")))
    within = lambda names: F.exists(above, lambda p: p.isin(*names))
    return within(stores) | (within(ambiguous) & ~source) | (_any([name.rlike(p) for p in patterns]) & ~name.rlike(templates))


def pull_request_status(base: Column, ci: Column, review: Column, draft: Column, days_old: Column, expected_base: str, stale_days: int = 14) -> Column:
    """The first of the reasons that hold back a pull request, or READY."""
    return (
        F.when(base != expected_base, "WRONG-BASE").when(ci == "FAILURE", "CI-FAIL").when(review == "CHANGES_REQUESTED", "CHANGES-REQ").when(draft, "DRAFT")
        .when(days_old >= stale_days, "STALE").when(review == "APPROVED", "APPROVED").when(ci == "PENDING", "PENDING").otherwise("READY")
    )


def decay(at: Column, now: Column, half_life_days: float) -> Column:
    """0.5 ** (age / half life); undated and future signals keep their full weight."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 86_400_000_000)
    return F.coalesce(F.pow(F.lit(0.5), age / half_life_days), F.lit(1.0))
