"""The standard rules, as data: id, severity, formats, filter, check, message, place, fix."""

from __future__ import annotations

import json

#: Definitions that all programs of standard rules may use.
PRELUDE = """
def text_of: [.. | objects | select(.type == "text" or .type == "code") | .value] | add // "";
def blank: test("^\\\\s*$");
def top: (.children? | arrays | .[] | objects) // empty;
def kind_of(kinds): .kind as $k | any(kinds; . == $k);
def pod: .spec // {} | objects | if .template // false then .template | objects | {at: "/spec/template/spec", pod: (.spec // {} | objects)} else {at: "/spec", pod: .} end;
def containers: pod | .at as $at | .pod.containers // [] | arrays | to_entries[] | select(.value | type == "object") | {at: "\\($at)/containers/\\(.key)", c: .value};
def inside(name): .c[name] // {} | objects;
def meta: .metadata // {} | objects;
def at_part(part): {name: .c.name, pointer: (.at + part)};
def below: recurse(.children? | arrays | .[] | objects);
def plain: [below | select(.type == "text") | .value | strings] | add // "";
def holders: .. | objects | select(.type? | IN("paragraph", "heading", "list_item", "table_cell", "block_quote"));
def many: if type == "array" then .[] else . end | objects;
def operations: .paths? | objects | to_entries[] | .key as $path | .value | objects | to_entries[] | select(.key | IN("get", "put", "post", "delete", "options", "head", "patch", "trace")) | select(.value | type == "object") | {path: $path, method: .key, op: .value};
def steps: .jobs? | objects | to_entries[] | .key as $job | .value | objects | .steps? | arrays | .[] | objects | {job: $job, step: .};
def words: [splits("[ \\\\t\\n]+") | select(. != "")];
def line_of: .position?.start?.line?;
def at_line: {line: line_of};
"""

_K8S = {"formats": ["yaml"], "filter": 'type == "object" and kind_of("Deployment", "StatefulSet", "DaemonSet", "Pod")', "pointer": ".pointer"}
_POINTED = {"formats": ["yaml"], "pointer": ".pointer"}
_MD = {"formats": ["markdown"], "line": ".line"}
_TF = {"formats": ["hcl"], "filter": 'type == "object"'}
_OPENAPI = {"formats": ["yaml", "json"], "filter": 'type == "object" and (.openapi | type == "string")'}
_ACTIONS = {"formats": ["yaml"], "filter": 'type == "object" and has("on") and has("jobs") and (.jobs | type | IN("null", "object"))'}
_NPM = {"formats": ["json"], "filter": 'type == "object" and has("name") and has("version")'}
_DOCKER = {"formats": ["dockerfile"], "line": ".line"}
#: API groups and versions that Kubernetes no longer serves. Fixed values.
_REMOVED = ["extensions/v1beta1", "apps/v1beta1", "apps/v1beta2", "policy/v1beta1"]
#: Texts of links that say nothing. Fixed values.
_SAYS_NOTHING = ["click here", "this page", "this link", "here", "this"]
#: Removal of the root or home folder; names of outputs that hold secrets. Fixed values.
_RM_ROOT = r"rm\s+-[a-zA-Z]*[rR][a-zA-Z]*[fF]?\s+(/(?:\s|$)|\$HOME|~(?:\s|$|/))"
_SECRET_NAME = "(?i)(secret|password|token|key|credential)"
#: Of skills' front matter. Fixed values.
_SKILL_NAME, _SKILL_NAME_LENGTH, _SKILL_TEXT_LENGTH = "^[a-z0-9][a-z0-9-]*$", 64, 1536


def _string(x: str) -> str:
    """x as a string of the query language."""
    return json.dumps(x)


_NAME = {"type": "string", "minLength": 1}


def _rule(id_: str, severity: str, check: object, message: str, base: dict, **more: object) -> dict:
    kind = "composite" if isinstance(check, dict) and "extract" in check else "schema" if isinstance(check, dict) else "jq"
    return {"id": id_, "severity": severity, "kind": kind, "check": check, "message": message, **base, **more}


RULES: list[dict] = [
    # dockerfile
    _rule("dockerfile.has-healthcheck", "info", 'select(length > 0 and all(.[]; .instruction != "HEALTHCHECK")) | {}', "no HEALTHCHECK", {"formats": ["dockerfile"]}),
    _rule("dockerfile.no-add-use-copy", "warn", r'.[] | select(.instruction == "ADD") | . as $i | (.arguments | if type == "array" then . else split("\n")[0] | words end | map(select(startswith("--") | not))) as $w | select($w[:-1] | all(test("^(?:https?|ftp|git)://|^git@|\\.git(?:#|$)|\\.(?:tar|tgz|tbz2?|txz|tar\\.\\w+|gz|bz2|xz|zst)$|^<<"; "i") | not)) | $i', "use COPY for local files", _DOCKER),
    _rule("dockerfile.no-curl-pipe-bash", "warn", r'.[] | select(.instruction == "RUN") | . as $i | (.arguments | if type == "array" then join(" ") else . end | gsub("\\|\\|"; ";")) as $t | first($t | splits(";|&&|\n") | [splits("\\|&?")] | . as $s | range(1; length) as $n | select($s[$n] | test("^\\s*(?:sudo\\s+(?:-\\S+\\s+)*)?(?:env\\s+(?:\\S+=\\S*\\s+)*)?(?:/(?:usr/)?bin/)?(?:ba|z|da|k|a)?sh\\b")) | select(any($s[:$n][]; test("(?:^|[\\s(`])(?:curl|wget)\\b")))) | $i', "a download is piped into a shell", _DOCKER),
    _rule("dockerfile.no-latest-base-image", "error", r'[.[] | select(.instruction == "FROM") | {line, words: (.arguments | tostring | words | map(select(startswith("--") | not)))} | {line, image: .words[0], alias: (if (.words[1] // "" | ascii_downcase) == "as" then .words[2] | ascii_downcase else null end)}] as $f | range($f | length) as $n | $f[$n] | select(.image != "scratch" and (.image | contains("$") | not) and (.image | contains("@") | not)) | (.image | ascii_downcase) as $own | select(any($f[:$n][]; .alias == $own) | not) | (.image | split("/")[-1]) as $last | select(($last | contains(":") | not) or ($last | endswith(":latest")))', "image {{ .image }} has no fixed tag", _DOCKER),
    # github-actions
    _rule("github-actions.action-pinned-by-sha", "warn", r'.jobs // {} | .[] | objects | .steps // [] | arrays | .[] | objects | select(.uses) | (.uses | tostring) as $u | select($u | test("^actions/|@[0-9a-f]{40}$") | not) | {step: (.name // .id // "<unnamed>"), uses}', "{{ .uses }} in step {{ .step }} is not pinned to a commit", _ACTIONS),
    _rule("github-actions.has-permissions", "warn", 'select(.permissions == null and (.jobs | all(.[] | objects; .permissions == null))) | {}', "no permissions are set", _ACTIONS),
    _rule("github-actions.has-timeout", "info", '.jobs // {} | to_entries[] | select(.value | type == "object" and .["timeout-minutes"] == null) | {job: .key}', "job '{{ .job }}' has no timeout-minutes", _ACTIONS),
    _rule("github-actions.no-pull-request-target-with-checkout", "error", r'select(.on | if type == "string" then . == "pull_request_target" elif type == "array" then index("pull_request_target") != null else type == "object" and has("pull_request_target") end) | steps | select(.step.uses | strings | test("^actions/checkout(?:@|$)")) | select(.step.with?.ref? | strings | test("github\\.event\\.pull_request\\.head|github\\.head_ref|refs/pull/")) | {job}', "job {{ .job }} checks out the pull request's head", _ACTIONS),
    # jsonschema
    _rule("jsonschema.helm-values-against-schema", "error", {"type": "object", "properties": {"image": {"type": "object", "properties": {"repository": _NAME, "tag": _NAME}}}}, "values", {"formats": ["yaml"], "filter": 'type == "object"'}),
    _rule("jsonschema.kubernetes-crd-shape", "error", {"type": "object", "required": ["apiVersion", "kind", "metadata"], "properties": {"apiVersion": _NAME, "kind": _NAME, "metadata": {"type": "object", "required": ["name"], "properties": {"name": _NAME}}}}, "manifest", {"formats": ["yaml", "json"], "filter": 'type == "object" and has("apiVersion") and has("kind")'}),
    _rule("jsonschema.openapi-3.1-shape", "error", {"type": "object", "required": ["openapi", "info", "paths"], "properties": {"openapi": {"type": "string", "pattern": r"^3\.1\."}, "info": {"type": "object", "required": ["title", "version"], "properties": {"title": _NAME, "version": _NAME}}, "paths": {"type": "object"}}}, "openapi", {"formats": ["yaml", "json"], "filter": 'type == "object" and has("openapi")'}),
    # k8s
    _rule("k8s.allow-privilege-escalation", "warn", 'containers | select(inside("securityContext").allowPrivilegeEscalation != false) | at_part("/name")', "container '{{ .name }}' may gain privileges", _K8S),
    _rule("k8s.deprecated-api", "error", f'select(.apiVersion | IN({", ".join(map(_string, _REMOVED))})) | {{api: .apiVersion, kind: (.kind // "<unknown>"), pointer: "/apiVersion"}}', "{{ .api }} of {{ .kind }} was removed", {**_POINTED, "filter": 'type == "object" and has("apiVersion")'}),
    _rule("k8s.host-network", "error", 'pod | select(.pod.hostNetwork == true) | {pointer: (.at + "/hostNetwork")}', "hostNetwork is on", _K8S),
    _rule("k8s.host-pid", "error", 'pod | select(.pod.hostPID == true) | {pointer: (.at + "/hostPID")}', "hostPID is on", _K8S),
    _rule("k8s.hostpath-volume", "warn", r'pod | .at as $at | .pod.volumes // [] | arrays | to_entries[] | select(.value | type == "object" and .hostPath != null) | {name: .value.name, pointer: "\($at)/volumes/\(.key)/hostPath"}', "volume '{{ .name }}' is a hostPath", _K8S),
    _rule("k8s.image-pull-policy-always", "info", 'containers | select(.c.imagePullPolicy == "Always" and (.c.image | tostring | endswith(":latest") | not)) | at_part("/name") + {image: .c.image}', "container '{{ .name }}' always pulls {{ .image }}", _K8S, fix_jq='walk(if type == "object" and .imagePullPolicy == "Always" and (.image // "" | tostring | endswith(":latest") | not) then .imagePullPolicy = "IfNotPresent" else . end)'),
    _rule("k8s.missing-labels", "info", 'meta as $m | $m.labels // {} | objects | select(.["app.kubernetes.io/name"] == null) | {name: ($m.name // "<unnamed>"), pointer: "/metadata/name"}', "'{{ .name }}' has no label app.kubernetes.io/name", {**_POINTED, "filter": 'type == "object" and kind_of("Deployment", "StatefulSet", "DaemonSet", "Service", "Job", "CronJob")'}),
    _rule("k8s.missing-liveness-probe", "warn", 'containers | select(.c.livenessProbe // null | . == null) | at_part("/name")', "container '{{ .name }}' has no livenessProbe", _K8S),
    _rule("k8s.missing-readiness-probe", "warn", 'containers | select(.c.readinessProbe // null | . == null) | at_part("/name")', "container '{{ .name }}' has no readinessProbe", _K8S),
    _rule("k8s.missing-resources-limits", "warn", 'containers | inside("resources") as $r | ($r.limits // {} | objects) as $l | select(any("cpu", "memory"; $l[.] // null | . == null)) | at_part("/name")', "container '{{ .name }}' is missing resources.limits", _K8S),
    _rule("k8s.no-latest-tag", "error", 'containers | (.c.image | tostring) as $i | select(($i | endswith(":latest")) or ($i | contains(":") | not)) | at_part("/image") + {image: .c.image}', "container '{{ .name }}' uses :latest ({{ .image }})", _K8S),
    _rule("k8s.privileged-container", "error", 'containers | select(inside("securityContext").privileged == true) | at_part("/securityContext/privileged")', "container '{{ .name }}' is privileged", _K8S),
    _rule("k8s.run-as-root", "warn", 'meta as $m | pod | select((.pod.securityContext // {} | objects | .runAsNonRoot) != true) | {name: ($m.name // "<unnamed>"), pointer: (.at + "/containers/0/name")}', "runAsNonRoot is not set for '{{ .name }}'", _K8S),
    _rule("k8s.service-no-selector", "warn", 'meta as $m | select((.spec.selector? // {}) | length == 0) | {name: ($m.name // "<unnamed>"), pointer: "/spec"}', "service '{{ .name }}' selects nothing", {**_POINTED, "filter": 'type == "object" and .kind == "Service" and (.spec.type? // "ClusterIP") != "ExternalName"'}),
    # markdown
    _rule("markdown.code-block-fenced", "info", 'top | select(.type == "code_block" and .fenced == false) | at_line', "the code block is not fenced", _MD),
    _rule("markdown.code-blocks-have-lang", "warn", 'top | select(.type == "code_block" and .fenced == true and (.lang // "" | blank)) | at_line', "the code block has no language", _MD),
    _rule("markdown.code-blocks-yaml-valid", "error", {"extract": '[.. | objects | select(.type == "code_block" and .fenced == true and (.lang // "" | ascii_downcase | IN("yaml", "yml"))) | {input: .value, line: (line_of + 1)}]', "format": "yaml", "rule": None}, "yaml parse failed", _MD),
    _rule("markdown.frontmatter-date-format", "warn", r'.frontmatter | objects | .value | objects | .date | values | tostring | select(test("^\\d{4}-\\d{2}-\\d{2}(?:[T ]\\d{2}:\\d{2}(?::\\d{2}(?:\\.\\d+)?)?\\s*(?:Z|[+-]\\d{2}:?\\d{2})?)?$") | not) | {date: .}', "date {{ .date }} is not ISO 8601", {"formats": ["markdown"]}),
    _rule("markdown.frontmatter-required-fields", "error", '.frontmatter | objects | .value | (if type == "object" then keys else [] end) as $has | (["title", "date"] - $has)[] | {field: .}', "front matter has no {{ .field }}", {"formats": ["markdown"]}),
    _rule("markdown.heading-order", "error", '[top | select(.type == "heading")] as $h | range(1; $h | length) as $n | select($h[$n].level > $h[$n - 1].level + 1) | $h[$n] | at_line + {level, before: $h[$n - 1].level}', "H{{ .before }} to H{{ .level }} skips a level", _MD),
    _rule("markdown.image-alt-required", "warn", 'holders | at_line as $l | below | select(.type == "image" and (text_of | blank)) | $l + {url}', "image {{ .url }} has no alternative text", _MD),
    _rule("markdown.link-text-not-here", "info", f'.. | objects | select(.type? == "link") | {{text: (plain | gsub("^\\\\s+|\\\\s+$"; "") | ascii_downcase), url}} | select(.text | IN({", ".join(map(_string, _SAYS_NOTHING))}))', "the link text '{{ .text }}' says nothing", {"formats": ["markdown"]}),
    _rule("markdown.no-bare-urls", "warn", 'top | . as $b | select(any(.. | objects; .type == "link" and .autolink == true)) | $b | at_line', "a bare URL", _MD),
    _rule("markdown.no-duplicate-headings", "warn", '[top | select(.type == "heading") | at_line + {text: text_of}] | group_by(.text) | [.[][1:][]] | sort_by(.line)[]', "heading {{ .text }} stands twice", _MD),
    _rule("markdown.no-empty-headings", "error", 'top | select(.type == "heading" and (text_of | blank) and (any(.. | objects; .type == "image") | not)) | at_line', "a heading with empty text", _MD),
    _rule("markdown.no-empty-links", "error", 'holders | at_line as $l | below | select(.type == "link" and (plain | blank)) | $l + {url}', "link to {{ .url }} has no text", _MD),
    _rule("markdown.no-empty-paragraphs", "warn", 'top | select(.type == "paragraph" and (text_of | blank) and (any(.. | objects; .type | IN("image", "link", "html_inline", "footnote_reference")) | not)) | at_line', "an empty paragraph", _MD),
    _rule("markdown.no-inline-html", "info", 'top | . as $b | select(any(.. | objects; .type | IN("html_block", "html_inline"))) | $b | at_line', "Inline HTML", _MD),
    _rule("markdown.no-multiple-blank-lines", "warn", '[top] as $b | range(1; $b | length) as $n | ($b[$n].position.start.line - $b[$n - 1].position.end.line - 1) as $k | select($k > 1) | $b[$n] | at_line + {n: $k}', "more than one blank line ({{ .n }} blank lines)", _MD),
    _rule("markdown.no-trailing-spaces-in-headings", "warn", 'top | select(.type == "heading") | select([.. | objects | select(.type == "text") | .value] | add // "" | test("\\\\s$")) | at_line', "the heading ends in white space", _MD),
    _rule("markdown.single-h1", "error", '[top | select(.type == "heading" and .level == 1)][1:][] | at_line', "more than one H1", _MD),
    _rule("markdown.table-header-required", "warn", '.. | objects | select(.type == "table") | select(.children[0].header? != true) | at_line', "a table without header", _MD),
    _rule("markdown.table-pipes-aligned", "warn", '.. | objects | select(.type == "table") | (.children[0].n_source_cells) as $n | .children[1:][] | select(.n_source_cells != $n) | at_line', "the row has another number of cells", _MD),
    # npm
    _rule("npm.has-engines", "info", 'select(.private != true and (.engines.node? // null) == null) | {}', "engines.node is missing", _NPM),
    _rule("npm.has-license", "warn", 'select(.private != true and (.license // "") == "") | {}', "license is missing", _NPM, fix_ops='if .private == true or (.license // "") != "" then [] else [{op: (if has("license") then "replace" else "add" end), path: "/license", value: "UNLICENSED"}] end'),
    _rule("npm.has-repository", "info", 'select(.private != true and (.repository // null) == null) | {}', "repository is missing", _NPM),
    _rule("npm.no-deprecated-fields", "warn", '("preferGlobal", "engineStrict") as $f | select(has($f)) | {field: $f}', "{{ .field }} is deprecated", _NPM),
    _rule("npm.no-wildcard-deps", "error", '[.dependencies, .devDependencies, .peerDependencies | objects] | add // {} | to_entries[] | select(.value | IN("*", "latest")) | {name: .key, version: .value}', "'{{ .name }}' is {{ .version }}", _NPM),
    _rule("npm.scripts-no-rm-rf-root", "error", f'.scripts // {{}} | objects | to_entries[] | select(.value | tostring | test({_string(_RM_ROOT)})) | {{name: .key}}', "script '{{ .name }}' removes the root or home", _NPM),
    # openapi
    _rule("openapi.info-required-fields", "error", {"type": "object", "required": ["info"], "properties": {"info": {"type": "object", "required": ["title", "version"], "properties": {"title": _NAME, "version": _NAME}}}}, "info", _OPENAPI),
    _rule("openapi.no-trailing-slash", "warn", '.paths | objects | keys[] | select(. != "/" and endswith("/")) | {path: .}', "path {{ .path }} ends with /", _OPENAPI),
    _rule("openapi.operation-id-unique", "error", '[.. | objects | .operationId | values] | group_by(.)[] | select(length > 1) | {id: .[0], times: length}', "operationId '{{ .id }}' is used {{ .times }} times", _OPENAPI),
    _rule("openapi.paths-non-empty", "warn", 'select(((.paths // {}) | length) == 0 and ((.webhooks // {}) | length) == 0) | {}', "no paths", _OPENAPI),
    _rule("openapi.response-200-or-201-required", "warn", 'operations | select(.op.responses | (objects | keys) // [] | any(test("^2(?:\\\\d\\\\d|XX)$")) | not) | {path, method: (.method | ascii_upcase)}', "{{ .method }} {{ .path }} has no successful response", _OPENAPI),
    _rule("openapi.security-defined", "warn", 'select(.security // [] | length == 0) | operations | select(.op.security == null) | {path, method: (.method | ascii_upcase)}', "{{ .method }} {{ .path }} has no security", _OPENAPI),
    # skills
    _rule("skills.evals-schema", "error", {"$defs": {"eval": {"type": "object", "required": ["id", "prompt", "expected_output"], "properties": {"id": {"anyOf": [{"type": "integer", "minimum": 0}, _NAME]}, "name": _NAME, "prompt": _NAME, "expected_output": {"type": "string"}, "expectations": {"type": "array", "items": _NAME}, "assertions": {"type": "array"}, "files": {"type": "array", "items": {"type": "string"}}}}}, "type": "object", "required": ["skill_name", "evals"], "properties": {"skill_name": _NAME, "evals": {"type": "array", "minItems": 1, "items": {"$ref": "#/$defs/eval"}}}, "additionalProperties": False}, "evals", {"formats": ["json"], "glob": "**/evals.json"}),
    _rule("skills.frontmatter", "error", f'.frontmatter | objects | .value | if type == "object" then . else {{}} end | ((.name | strings | (select(test({_string(_SKILL_NAME)}) | not) | "`name` must match {_SKILL_NAME}"), (length | select(. > {_SKILL_NAME_LENGTH}) | "`name` has \\(.) characters, exceeds {_SKILL_NAME_LENGTH}")), ([.description, .when_to_use | strings] | add // "" | length | select(. > {_SKILL_TEXT_LENGTH}) | "description and when_to_use have \\(.) characters, exceeds {_SKILL_TEXT_LENGTH:,}")) | {{problem: .}}', "front matter: {{ .problem }}", {"formats": ["markdown"], "filter": 'type == "object" and .frontmatter != null'}),
    # terraform
    _rule("terraform.module-pin-version", "warn", r'.module | objects | to_entries[] | .key as $n | .value | many | select(.source | strings | test("^\\.{1,2}/") | not) | select(.version == null and (.source | test("[?&]ref=") | not)) | {name: $n}', "module {{ .name }} has no version", _TF),
    _rule("terraform.no-public-ingress", "error", 'def open: arrays | any(. == "0.0.0.0/0" or . == "::/0"); (.. | objects | .ingress | if type == "array" then .[] else . end | objects | to_entries[] | select(.key | IN("cidr_blocks", "ipv6_cidr_blocks"))), (.. | objects | to_entries[] | select(.key == "source_ranges")) | select(.value | open) | {key}', "{{ .key }} is open to all", {"formats": ["hcl"]}),
    _rule("terraform.output-no-sensitive-without-flag", "error", f'.output // {{}} | objects | to_entries[] | select(.key | test({_string(_SECRET_NAME)})) | .key as $n | .value | if type == "array" then .[] else . end | select(.sensitive? != true) | {{name: $n}}', "output '{{ .name }}' is not marked sensitive", _TF),
    _rule("terraform.provider-pinned", "warn", '([.terraform | many | .required_providers | many | to_entries[] | select((.value | type == "string") or (.value | type == "object" and .version != null)) | .key]) as $pinned | .provider | objects | to_entries[] | .key as $n | select($pinned | index($n) | not) | select([.value | many | .version] | any(. != null) | not) | {name: $n}', "provider {{ .name }} has no version", _TF),
    _rule("terraform.state-backend-required", "warn", 'select(.terraform != null and ([.terraform | many | .backend, .cloud] | all(. == null))) | {}', "no backend keeps the state", _TF),
    _rule("terraform.tag-required", "warn", '.resource | objects | to_entries[] | select(.key | startswith("aws_")) | .key as $k | .value | objects | to_entries[] | .key as $n | .value | many | select(.tags == null) | {kind: $k, name: $n}', "{{ .kind }}.{{ .name }} has no tags", _TF),
    _rule("terraform.variable-has-description", "info", '.variable | objects | to_entries[] | .key as $n | .value | many | select((.description // "" | tostring) | blank) | {name: $n}', "variable {{ .name }} has no description", _TF),
    _rule("terraform.no-hardcoded-secrets", "error", r'[paths(strings) as $p | ($p[-1] | strings | select(test("password|secret|api_?key|token|access_?key|private_?key"; "i"))) as $k | getpath($p) | select(length > 0 and (contains("${") | not)) | {name: $k}][]', "{{ .name }} is a literal", _TF),
]
