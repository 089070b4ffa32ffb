"""Node rules in SQL, for comparison with the Column expressions."""

from __future__ import annotations

from quillgraph.functions import vocabulary as V
from quillgraph.plans.graphs import listed


def has(x: str, words: str) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words.split("|")) + ")"


def starts(x: str, words: str) -> str:
    return "(" + " OR ".join(f"starts_with({x}, '{w}')" for w in words.split("|")) + ")"


def kind(words: str) -> str:
    return f"k IN {listed(words.split())}"


# Expects l (lower label), i (lower id), k (lower kind), s (lower file), raw (label), base (file name).
CATEGORY = f"""CASE
  WHEN {kind("cache redis memcached")} OR {has("l", "redis|memcached|cache")} THEN 'cache'
  WHEN {kind("kafka_topic topic queue kafka rabbitmq sqs pubsub")} OR {has("l", "kafka|topic|queue|rabbitmq|sqs")} OR starts_with(i, 'kafka_') THEN 'queue'
  WHEN {kind("external_api external_http external webhook remote_service")} OR {starts("l", "http://|https://")} OR {starts("i", "http://|https://")} OR {has("l", "webhook|external:")} THEN 'external_api'
  WHEN {kind("table sql_table database db sql repository entity model")} OR ends_with(s, '.sql') OR {starts("i", "sql_table_|table_")} OR contains(l, ' table') OR ends_with(l, '_table') OR {starts("l", "table:|db:")}
    OR {has("l", "database|postgres|mysql|sqlite|mongodb|dynamodb")} THEN 'database'
  WHEN {kind("route endpoint http_route api_endpoint api rest_endpoint")} OR {starts("l", "get |post |put |delete |patch |head |options ")} OR contains(l, 'route:') OR starts_with(l, 'route ') THEN 'route'
  WHEN {kind("rpc grpc grpc_rpc grpc_service")} OR {starts("l", "rpc:|rpc ")} OR contains(l, 'grpc') THEN 'rpc'
  WHEN {kind("cli cli_command command entry entry_point")} OR {starts("l", "cli:|cmd:")} OR l IN ('main', 'main()', 'run()', 'cli()') OR {has("l", "click.command|app.command")} THEN 'cli'
  WHEN {kind("consumer event_consumer listener subscriber kafka_consumer sqs_consumer worker job")} OR {has("l", "consumer|listener|subscriber|on_message|handle_event")} THEN 'consumer'
  WHEN {kind("middleware interceptor filter guard")} OR {has("l", "middleware|interceptor|filter|guard|cors")} THEN 'middleware'
  WHEN {kind("controller handler")} OR {has("l", "controller|handler")} THEN 'controller'
  WHEN {kind("service manager processor usecase")} OR {has("l", "service|manager|processor|usecase")} THEN 'service'
  WHEN {kind("module file")} OR (s <> '' AND raw = base) THEN 'module' ELSE 'function' END"""

ROLE = f"""CASE
  WHEN {kind("table sql_table database db sql repository entity model")} OR ends_with(s, '.sql') OR {has("l", "table|repository|database|sqlite|postgres|mysql|dynamodb|mongodb|store|model|schema")} THEN 'database'
  WHEN {kind("cache redis memcached")} OR {has("l", "redis|memcached|cache")} THEN 'cache'
  WHEN {kind("kafka_topic topic queue kafka rabbitmq sqs pubsub")} OR {has("l", "kafka|topic|queue|rabbitmq|sqs|event_stream|producer|publish")} THEN 'queue'
  WHEN {kind("external_api external_http external remote_service gateway")} OR {starts("l", "http://|https://|external:")} OR {has("l", "gateway|webhook|external|remote|client|sdk|api_client")} THEN 'external_api'
  WHEN {kind("route endpoint http_route api_endpoint api rest_endpoint")} OR {starts("l", "get |post |put |delete |patch ")} OR {has("l", "route:|endpoint")} THEN 'route'
  WHEN {kind("rpc grpc grpc_rpc grpc_service")} OR starts_with(l, 'rpc:') OR contains(l, 'grpc') THEN 'rpc'
  WHEN {kind("cli cli_command command entry entry_point")} OR {starts("l", "cli:|cmd:")} OR l IN ('main', 'main()', 'cli()', 'run()') OR contains(l, 'command') THEN 'cli'
  WHEN {kind("consumer event_consumer listener subscriber worker job")} OR {has("l", "consumer|listener|subscriber|on_message|handle_event")} THEN 'consumer'
  WHEN {kind("middleware guard interceptor filter validator")} OR {has("l", "guard|auth|validat|risk|fraud|schema|verify|permission|idempotenc")} THEN 'middleware'
  WHEN {kind("controller handler")} OR {has("l", "controller|handler")} THEN 'controller'
  WHEN {kind("service manager processor usecase engine orchestrator")} OR {has("l", "service|manager|processor|usecase|engine|orchestrat|intent|pipeline")} THEN 'service'
  WHEN {kind("class struct interface")} THEN 'class' ELSE 'function' END"""

STAGE = """CASE WHEN role = 'queue' THEN 'events' WHEN role IN ('database', 'cache') THEN 'settlement' WHEN role = 'external_api' THEN 'gateway' WHEN role IN ('route', 'cli', 'rpc') THEN 'initiation'
  WHEN role IN ('middleware', 'controller') THEN 'validation' ELSE 'processing' END"""

AREA = r"""CASE WHEN coalesce(source_file, '') = '' THEN 'general' WHEN len(ps) <= 1 THEN CASE WHEN x IN ('md', 'txt', 'rst') THEN 'documentation' WHEN x IN ('tf', 'tfvars', 'hcl') THEN 'infrastructure' WHEN x IN ('yaml', 'yml', 'json') THEN 'configuration' ELSE 'root' END
  WHEN p1 IN ('charts', 'helm') THEN 'helm' WHEN p1 IN ('k8s', 'kubernetes', 'manifests') THEN 'kubernetes' WHEN p1 IN ('terraform', 'tf', 'infra', 'infrastructure', 'iac') THEN 'infrastructure'
  WHEN p1 IN ('docs', 'documentation', 'wiki') THEN 'documentation' WHEN p1 IN ('tests', 'test', 'spec', 'specs') THEN 'testing' WHEN p1 IN ('src', 'lib', 'app', 'pkg', 'packages') AND len(ps) > 2 THEN lower(ps[2]) ELSE p1 END"""

# Node columns under the names the rules expect; n must exist.
RULED = r"""
w AS (SELECT *, lower(label) AS l, lower(id) AS i, lower(coalesce(node_kind, '')) AS k, lower(coalesce(source_file, '')) AS s, label AS raw, regexp_extract(coalesce(source_file, ''), '[^/]*$') AS base,
  string_split(trim(coalesce(source_file, ''), '/'), '/') AS ps, lower(split_part(trim(coalesce(source_file, ''), '/'), '/', 1)) AS p1,
  lower(CASE WHEN contains(regexp_extract(coalesce(source_file, ''), '[^/]*$'), '.') THEN regexp_extract(source_file, '[^.]*$') ELSE '' END) AS x FROM n)"""


def environment(path: str) -> str:
    one = " ".join([f"WHEN lower(p) IN {listed(V.ENVIRONMENTS)} THEN lower(p)"] + [f"WHEN starts_with(lower(p), '{e}-') OR ends_with(lower(p), '-{e}') THEN '{e}'" for e in V.ENVIRONMENTS])
    return f"list_filter(list_transform(string_split({path}, '/'), lambda p: CASE {one} END), lambda q: q IS NOT NULL)[1]"


_NAMED = r"""(regexp_matches(base, '(?i)^\.(env|envrc)(\.|$)') OR regexp_matches(base, '(?i)\.(pem|key|p12|pfx|cert|crt|der|p8)$') OR regexp_matches(base, '(?i)(^|[^A-Za-z0-9])(id_rsa|id_dsa|id_ecdsa|id_ed25519)(\.pub)?$')
  OR regexp_matches(base, '(?i)^secring(\.(gpg|pgp))?$') OR regexp_matches(base, '(?i)(\.netrc|\.pgpass|\.htpasswd|\.npmrc|\.pypirc|\.git-credentials|\.boto)$'))"""
_ABOVE = "list_transform(string_split(s, '/')[:-2], lambda p: lower(p))"
_SOURCE = f"lower(CASE WHEN contains(base, '.') THEN regexp_extract(base, '[^.]*$') ELSE '' END) IN {listed(e for e in V.CODE_ENDINGS if e not in ('json', 'yaml', 'yml', 'toml', 'xml'))}"
SENSITIVE = f"""(list_has_any({_ABOVE}, ['.ssh', '.gnupg', '.aws', '.gcloud']) OR (list_has_any({_ABOVE}, ['secrets', '.secrets', 'credentials']) AND NOT {_SOURCE})
  OR ({_NAMED} AND NOT regexp_matches(base, '(?i)^\\.(env|envrc)\\..*(example|sample|template|dist)$')))"""

TEST = f"({has('s', 'test_|_test|tests/')} OR {has('l', 'test_|_test')} OR starts_with(l, 'test'))"
API = "(k IN ('api', 'rpc', 'endpoint') OR " + " OR ".join(f"starts_with(raw, '{v} ') OR contains(raw, ' {v} ')" for v in ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")) + ")"
INFRA = f"(k IN ('k8s', 'terraform', 'helm', 'kafka', 'docker') OR {has('s', 'dockerfile|docker-compose|terraform|.tf|helm|k8s')})"
