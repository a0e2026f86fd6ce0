"""One query for each standard rule: documents of several shapes, bad and good, made from supplier."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.plans import lint
from treeloom.plans.rules import RULES
from treeloom.sources import registry

_POD = "kind: Pod\nspec:\n  containers:\n  - name: a\n"
_MD = "---\ntitle: t\ndate: 2024-01-02\n---\n# A\n\n"
_API = "openapi: 3.1.0\ninfo: {title: t, version: '1'}\n"
_FLOW = "on: push\njobs:\n  a:\n"
_SHA = "0123456789abcdef0123456789abcdef01234567"
_CHECKOUT = "    steps:\n    - uses: actions/checkout@v4\n      with: {ref: '${{ github.event.pull_request.head.sha }}'}\n"

#: Rule: format, file name, a bad document, a good one, violations in the bad one.
CASES: dict[str, tuple[str, str, str, str, int]] = {
    "dockerfile.has-healthcheck": ("dockerfile", "Dockerfile", "FROM a:1\n", "FROM a:1\nHEALTHCHECK CMD x\n", 1),
    "dockerfile.no-add-use-copy": ("dockerfile", "Dockerfile", "FROM a:1\nADD x y\n", "FROM a:1\nADD https://x/y.tgz /\nCOPY x y\n", 1),
    "dockerfile.no-curl-pipe-bash": ("dockerfile", "Dockerfile", "FROM a:1\nRUN wget -qO- x | sudo bash -\n", "FROM a:1\nRUN curl x | tar x && bash y\n", 1),
    "dockerfile.no-latest-base-image": ("dockerfile", "Dockerfile", "FROM reg:5000/a\nFROM b:latest\n", "FROM a:1 AS b\nFROM b\nFROM scratch\nFROM c@sha256:0\n", 2),
    "github-actions.action-pinned-by-sha": ("yaml", "w.yml", _FLOW + "    steps: [{uses: o/r@v1}, {uses: ./x}]\n", _FLOW + f"    steps: [{{uses: o/r@{_SHA}}}, {{uses: actions/cache@v4}}, {{run: x}}]\n", 2),
    "github-actions.has-permissions": ("yaml", "w.yml", _FLOW + "    steps: []\n", "permissions: {}\n" + _FLOW + "    steps: []\n", 1),
    "github-actions.has-timeout": ("yaml", "w.yml", _FLOW + "    steps: []\n  b: {uses: o/r/.github/workflows/x.yml@v1}\n  c: {timeout-minutes: 1}\n", _FLOW + "    timeout-minutes: 5\n", 2),
    "github-actions.no-pull-request-target-with-checkout": ("yaml", "w.yml", "on: [push, pull_request_target]\njobs:\n  a:\n" + _CHECKOUT, _FLOW + _CHECKOUT, 1),
    "jsonschema.helm-values-against-schema": ("yaml", "values.yaml", "image: {repository: '', tag: 1}\n", "image: {repository: a, tag: v1}\nreplicas: no\n", 2),
    "jsonschema.kubernetes-crd-shape": ("yaml", "m.yaml", "apiVersion: v1\nkind: ''\n", "apiVersion: v1\nkind: A\nmetadata: {name: n}\n", 2),
    "jsonschema.openapi-3.1-shape": ("yaml", "a.yaml", "openapi: 3.0.0\ninfo: {title: t}\n", _API + "paths: {}\n", 3),
    "k8s.allow-privilege-escalation": ("yaml", "m.yaml", _POD, _POD + "    securityContext: {allowPrivilegeEscalation: false}\n", 1),
    "k8s.deprecated-api": ("yaml", "m.yaml", "apiVersion: policy/v1beta1\n", "apiVersion: policy/v1\n", 1),
    "k8s.host-network": ("yaml", "m.yaml", "kind: StatefulSet\nspec: {template: {spec: {hostNetwork: true}}}\n", "kind: CronJob\nspec: {template: {spec: {hostNetwork: true}}}\n", 1),
    "k8s.host-pid": ("yaml", "m.yaml", "kind: DaemonSet\nspec: {template: {spec: {hostPID: true}}}\n", _POD, 1),
    "k8s.hostpath-volume": ("yaml", "m.yaml", "kind: Pod\nspec: {volumes: [{name: a, hostPath: {path: /}}, {name: b}, {hostPath: {}}]}\n", "kind: Pod\nspec: {volumes: [{name: a, emptyDir: {}}]}\n", 2),
    "k8s.image-pull-policy-always": ("yaml", "m.yaml", _POD + "    image: a:1\n    imagePullPolicy: Always\n  - {image: b, imagePullPolicy: Always}\n", _POD + "    image: a:latest\n    imagePullPolicy: Always\n", 2),
    "k8s.missing-labels": ("yaml", "m.yaml", "kind: Service\nmetadata: {name: a}\n", "kind: Job\nmetadata: {labels: {app.kubernetes.io/name: x}}\n", 1),
    "k8s.missing-liveness-probe": ("yaml", "m.yaml", _POD, _POD + "    livenessProbe: {}\n", 1),
    "k8s.missing-readiness-probe": ("yaml", "m.yaml", _POD, _POD + "    readinessProbe: {}\n", 1),
    "k8s.missing-resources-limits": ("yaml", "m.yaml", _POD + "    resources: {limits: {cpu: 1}}\n", _POD + "    resources: {limits: {cpu: 1, memory: 1}}\n", 1),
    "k8s.no-latest-tag": ("yaml", "m.yaml", _POD + "    image: a\n  - image: 'b:latest'\n  - image: c:1\n", _POD + "    image: a:1\n  initContainers: [{image: 'b:latest'}]\n", 2),
    "k8s.privileged-container": ("yaml", "m.yaml", _POD + "    securityContext: {privileged: true}\n", _POD + "    securityContext: {privileged: false}\n", 1),
    "k8s.run-as-root": ("yaml", "m.yaml", _POD, "kind: Pod\nspec: {securityContext: {runAsNonRoot: true}}\n", 1),
    "k8s.service-no-selector": ("yaml", "m.yaml", "kind: Service\nspec: {selector: {}}\n", "kind: Service\nspec: {type: ExternalName}\n", 1),
    "markdown.code-block-fenced": ("markdown", "p.md", _MD + "text\n\n    code\n", _MD + "```sh\ncode\n```\n", 1),
    "markdown.code-blocks-have-lang": ("markdown", "p.md", _MD + "```\ncode\n```\n", _MD + "```sh\ncode\n```\n", 1),
    "markdown.code-blocks-yaml-valid": ("markdown", "p.md", _MD + "```yaml\na: [\n```\n", _MD + "```yaml\na: []\n```\n", 1),
    "markdown.frontmatter-date-format": ("markdown", "p.md", "---\ndate: 1/2/2024\n---\nx\n", _MD, 1),
    "markdown.frontmatter-required-fields": ("markdown", "p.md", "---\nx: 1\n---\nx\n", "no front matter\n", 2),
    "markdown.heading-order": ("markdown", "p.md", _MD + "### C\n\n##### E\n", _MD + "## B\n\n### C\n\n# D\n", 2),
    "markdown.image-alt-required": ("markdown", "p.md", _MD + "![](a) ![ ](b)\n\n> ![](c)\n", _MD + "![x](a)\n", 4),
    "markdown.link-text-not-here": ("markdown", "p.md", _MD + "[Click here](a) and [this page](b)\n", _MD + "[the manual](a) and [more](b)\n", 2),
    "markdown.no-bare-urls": ("markdown", "p.md", _MD + "see https://a.b\n", _MD + "see [a](https://a.b) and `https://a.b`\n", 1),
    "markdown.no-duplicate-headings": ("markdown", "p.md", _MD + "## A\n\n## A\n", _MD + "## B\n", 2),
    "markdown.no-empty-headings": ("markdown", "p.md", _MD + "##\n", _MD + "## B\n", 1),
    "markdown.no-empty-links": ("markdown", "p.md", _MD + "[](a) [ ](b) [![x](i)](c)\n", _MD + "[b](a)\n", 2),
    "markdown.no-empty-paragraphs": ("markdown", "p.md", _MD + "&nbsp;\n", _MD + "![](a)\n", 1),
    "markdown.no-inline-html": ("markdown", "p.md", _MD + "a <b>c</b>\n\n<div>\n", _MD + "a < b\n", 2),
    "markdown.no-multiple-blank-lines": ("markdown", "p.md", _MD + "a\n\n\nb\n", _MD + "a\n\nb\n", 1),
    "markdown.no-trailing-spaces-in-headings": ("markdown", "p.md", _MD + "## B&nbsp;\n", _MD + "## B  \n", 1),
    "markdown.single-h1": ("markdown", "p.md", _MD + "# B\n\nC\n=\n", _MD + "## B\n", 2),
    "markdown.table-header-required": ("markdown", "p.md", "", "", 0),
    "markdown.table-pipes-aligned": ("markdown", "p.md", _MD + "|a|b|\n|-|-|\n|1|\n|1|2|\n", _MD + "|a|b|\n|-|-|\n|1|2|\n", 1),
    "npm.has-engines": ("json", "package.json", '{"name":"a","version":"1","engines":{"npm":"1"}}', '{"name":"a","version":"1","engines":{"node":"1"}}', 1),
    "npm.has-license": ("json", "package.json", '{"name":"a","version":"1","license":""}', '{"name":"a","version":"1","license":"MIT"}', 1),
    "npm.has-repository": ("json", "package.json", '{"name":"a","version":"1","x":1}', '{"name":"a","version":"1","repository":"x"}', 1),
    "npm.no-deprecated-fields": ("json", "package.json", '{"name":"a","version":"1","preferGlobal":true,"engineStrict":null}', '{"name":"a","version":"1","x":1}', 2),
    "npm.no-wildcard-deps": ("json", "package.json", '{"name":"a","version":"1","dependencies":{"a":"*","b":"1"},"devDependencies":{"c":"latest"}}', '{"name":"a","version":"1","dependencies":{"a":"^1.*"}}', 2),
    "npm.scripts-no-rm-rf-root": ("json", "package.json", '{"name":"a","version":"1","scripts":{"a":"rm -rf /","b":"rm -fr $HOME","c":"rm -rf ~"}}', '{"name":"a","version":"1","scripts":{"a":"rm -rf ./dist /tmp/x"}}', 3),
    "openapi.info-required-fields": ("yaml", "a.yaml", "openapi: 3.0.0\ninfo: {}\n", _API, 2),
    "openapi.no-trailing-slash": ("yaml", "a.yaml", _API + "paths: {/: {}, /a/: {}, /b: {}}\n", _API + "paths: {/: {}, /b: {}}\n", 1),
    "openapi.operation-id-unique": ("yaml", "a.yaml", _API + "paths: {/a: {get: {operationId: x}, put: {operationId: x}}}\nx: [{operationId: y}, {operationId: y}]\n", _API + "paths: {/a: {get: {operationId: x}, put: {operationId: y}}}\n", 2),
    "openapi.paths-non-empty": ("yaml", "a.yaml", _API + "paths: {}\n", _API + "webhooks: {a: {}}\n", 1),
    "openapi.response-200-or-201-required": ("yaml", "a.yaml", _API + "paths: {/a: {get: {responses: {'404': {}}}, put: {}}}\n", _API + "paths: {/a: {get: {responses: {2XX: {}}}}}\n", 2),
    "openapi.security-defined": ("yaml", "a.yaml", "security: []\n" + _API + "paths: {/a: {get: {}, put: {security: []}}}\n", "security: [{k: []}]\n" + _API + "paths: {/a: {get: {}}}\n", 1),
    "skills.evals-schema": ("json", "evals.json", '{"skill_name":"s","evals":[{"id":-1,"prompt":"p"}]}', '{"skill_name":"s","evals":[{"id":"a","prompt":"p","expected_output":""}]}', 2),
    "skills.frontmatter": ("markdown", "SKILL.md", "---\nname: Bad Name\ndescription: " + "d" * 1537 + "\n---\nx\n", "---\nwhen_to_use: x\n---\nx\n", 2),
    "terraform.module-pin-version": ("hcl", "m.tf", 'module "a" {\n  source = "t/x"\n}\n', 'module "a" {\n  source = "../x"\n}\nmodule "b" {\n  source = "t/x"\n  version = "1"\n}\n', 1),
    "terraform.no-public-ingress": ("hcl", "m.tf", 'resource "any_kind" "a" {\n  ingress {\n    ipv6_cidr_blocks = ["::/0"]\n  }\n}\nresource "other" "b" {\n  source_ranges = ["0.0.0.0/0"]\n}\n', 'resource "aws_security_group" "a" {\n  egress {\n    cidr_blocks = ["0.0.0.0/0"]\n  }\n}\n', 2),
    "terraform.output-no-sensitive-without-flag": ("hcl", "m.tf", 'output "ssh_key" {\n  value = 1\n}\n', 'output "db_password" {\n  value = 1\n  sensitive = true\n}\noutput "name" {\n  value = 1\n}\n', 1),
    "terraform.provider-pinned": ("hcl", "m.tf", 'provider "aws" {\n}\n', 'terraform {\n  required_providers {\n    aws = { version = "1" }\n  }\n}\nprovider "aws" {\n}\n', 1),
    "terraform.state-backend-required": ("hcl", "m.tf", "terraform {\n  x = 1\n}\n", 'terraform {\n  backend "s3" {\n    a = 1\n  }\n}\n', 1),
    "terraform.tag-required": ("hcl", "m.tf", 'resource "aws_a" "b" {\n  x = 1\n}\n', 'resource "aws_a" "b" {\n  tags = {}\n}\nresource "gcp_a" "b" {\n}\n', 1),
    "terraform.variable-has-description": ("hcl", "m.tf", 'variable "a" {\n  type = string\n}\n', 'variable "a" {\n  description = "d"\n}\n', 1),
    "terraform.no-hardcoded-secrets": ("hcl", "m.tf", 'a = 1\nx "y" {\n  db_password = "hunter2"\n}\n', "db_password = var.p\n", 1),
}


def _rule(id_: str) -> lint.Rule:
    return lint.Rule(next(r for r in RULES if r["id"] == id_))


#: Further shapes of some rules' documents: text, violations.
_PRIVATE = ('{"name":"a","version":"1","private":true,"engineStrict":1,"dependencies":{"b":"*"},"scripts":{"c":"rm -rf /"}}', 0)
_NO_PACKAGE = ('{"private":false}', 0)
_JOB = "kind: Job\nspec: {template: {spec: {hostNetwork: true, hostPID: true, containers: [{name: a}]}}}\n"
_INIT = "kind: Pod\nspec:\n  initContainers: [{name: a, imagePullPolicy: Always, securityContext: {privileged: true}}]\n"
_TWO = "kind: Deployment\nspec: {template: {spec: {containers: [{name: a}, x, {name: b}]}}}\n"
SHAPES: dict[str, list[tuple[str, int]]] = {
    **{f"npm.{r}": [_PRIVATE, _NO_PACKAGE] for r in ("has-engines", "has-license", "has-repository")},
    **{f"npm.{r}": [(_PRIVATE[0], 1), _NO_PACKAGE] for r in ("no-deprecated-fields", "no-wildcard-deps", "scripts-no-rm-rf-root")},
    **{f"k8s.{r}": [(_JOB, 0), (_INIT, 0), (_TWO, 2)] for r in ("allow-privilege-escalation", "missing-liveness-probe", "missing-readiness-probe", "missing-resources-limits", "no-latest-tag")},
    **{f"k8s.{r}": [(_JOB, 0), (_INIT, 0), (_TWO, 0)] for r in ("host-network", "host-pid", "privileged-container", "image-pull-policy-always", "hostpath-volume")},
    "k8s.run-as-root": [(_JOB, 0), (_INIT, 1), (_TWO, 1)],
    "k8s.missing-labels": [(_JOB, 1), (_INIT, 0), (_TWO, 1)],
    "k8s.deprecated-api": [("apiVersion: batch/v1beta1\n", 0), ("apiVersion: apps/v1beta2\n", 1), ("kind: x\n", 0)],
    "k8s.service-no-selector": [("kind: Service\nspec: x\n", 1), ("kind: Service\nspec: {selector: {a: b}}\n", 0)],
    "skills.frontmatter": [("---\nname: " + "a" * 65 + "\n---\n", 1), ("---\nname: 1\n---\n", 0), ("no front matter\n", 0), ("---\ndescription: " + "a" * 1000 + "\nwhen_to_use: " + "b" * 600 + "\n---\n", 1)],
    "terraform.no-public-ingress": [('x "a" {\n  y {\n    ingress {\n      cidr_blocks = ["10.0.0.0/8", "0.0.0.0/0"]\n    }\n    ingress {\n      cidr_blocks = ["10.0.0.0/8"]\n    }\n  }\n}\n', 1)],
    "openapi.security-defined": [(_API + "paths: {/a: {get: {}, head: {}, x-y: {}}}\n", 2)],
}


def shapes(id_: str) -> list[tuple[str, int]]:
    """(document, violations in it): supplier's rows take one after another."""
    _, _, bad, good, n = CASES[id_]
    return [(good, 0), (bad, n), *SHAPES.get(id_, [])]


def _query(id_: str) -> Callable[[SparkSession, str], DataFrame]:
    form, name, *_ = CASES[id_]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = F.col("s_suppkey").cast("string")
        texts = F.array(*(F.lit(t) for t, _ in shapes(id_)))
        text = F.element_at(texts, (F.col("s_suppkey") % len(shapes(id_)) + 1).cast("int"))
        s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("s/"), key, F.lit(f"/{name}")).alias("path"), text.cast("binary").alias("content"))
        found = lint.lint(registry.read_documents(s, form, spread=spark.sparkContext.defaultParallelism), [_rule(id_)])
        return found.groupBy(F.regexp_extract("path", r"^s/(\d+)", 1).cast("long").alias("s_suppkey"), "rule_id", "severity").agg(F.count("*").alias("n"))

    return run


def _sql(id_: str) -> str:
    severity = next(r["severity"] for r in RULES if r["id"] == id_)
    found = "CASE s_suppkey % {} {} END".format(len(shapes(id_)), " ".join(f"WHEN {k} THEN {n}" for k, (_, n) in enumerate(shapes(id_))))
    return f"SELECT s_suppkey, '{id_}' AS rule_id, '{severity}' AS severity, ({found})::BIGINT AS n FROM supplier WHERE {found} > 0"


def _name(id_: str) -> str:
    return "rule_" + id_.replace(".", "_").replace("-", "_")


QUERIES = {_name(i): _query(i) for i in CASES}
ORACLES = {_name(i): _sql(i) for i in CASES}
