"""Formats by name, extension and file name; documents as rows of a DataFrame."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.sources import text_formats as T
from treeloom.sources.dockerfile import read_dockerfile
from treeloom.sources.hcl import read_hcl, write_hcl
from treeloom.sources.markdown import read_markdown
from treeloom.values import DocumentError, parse_json, sorted_keys, to_json

#: Format: extensions. Fixed values; the order decides between formats of one extension.
EXTENSIONS = {
    "json": ("json",), "jsonl": ("jsonl", "ndjson"), "yaml": ("yaml", "yml"), "toml": ("toml",), "hcl": ("hcl", "tf", "tfvars"), "xml": ("xml", "pom", "xsd"), "ini": ("ini", "properties", "cfg"), "dotenv": ("env",),
    "csv": ("csv",), "tsv": ("tsv",), "markdown": ("md", "markdown"), "frontmatter": ("md", "markdown"), "dockerfile": ("dockerfile", "containerfile"), "ignore-list": ("gitignore", "dockerignore"),
}
#: File names without a telling extension.
NAMES = {"dockerfile": "dockerfile", "containerfile": "dockerfile", ".gitignore": "ignore-list", ".dockerignore": "ignore-list", ".npmignore": "ignore-list", ".eslintignore": "ignore-list", ".env": "dotenv"}

READERS: dict[str, Callable[[str], object]] = {
    "json": parse_json, "jsonl": T.read_jsonl, "yaml": lambda s: T.read_yaml_stream(s)[0], "toml": T.read_toml, "hcl": read_hcl, "xml": T.read_xml, "ini": T.read_ini, "dotenv": T.read_dotenv,
    "csv": T.read_csv, "tsv": lambda s: T.read_csv(s, "\t"), "markdown": read_markdown, "frontmatter": T.read_frontmatter, "dockerfile": read_dockerfile, "ignore-list": T.read_ignore_list,
}
WRITERS: dict[str, Callable[[object], str]] = {
    "json": lambda v: to_json(v, 2) + "\n", "jsonl": T.write_jsonl, "yaml": T.write_yaml, "toml": T.write_toml, "hcl": write_hcl, "xml": T.write_xml, "ini": T.write_ini, "dotenv": T.write_dotenv,
    "csv": T.write_csv, "tsv": lambda v: T.write_csv(v, "\t"), "frontmatter": lambda v: T.write_frontmatter(v, None, ""), "toon": T.write_toon,
}


def detect(path: str) -> str | None:
    """The extension decides, then the file name, then .env.*; None is no guess."""
    name = path.rpartition("/")[2].lower()
    stem, dot, extension = name.rpartition(".")
    if dot and stem:
        for found, known in EXTENSIONS.items():
            if extension in known:
                return found
    return NAMES.get(name) or ("dotenv" if name.startswith(".env.") and len(name) > 5 else None)


def detect_column(path: Column) -> Column:
    """`detect` as a column expression."""
    name = F.lower(F.regexp_extract(path, "([^/]*)$", 1))
    extension = F.when(name.rlike(r"^.+\."), F.regexp_extract(name, r"\.([^.]*)$", 1))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for found, known in EXTENSIONS.items():
        out = out.when(extension.isin(*known), found)
    for n, found in NAMES.items():
        out = out.when(name == n, found)
    return out.when(name.rlike(r"^\.env\..+"), "dotenv")


def documents_of(text: str, form: str) -> list:
    """The documents of a file: several only for YAML."""
    if form not in READERS:
        raise DocumentError("usage", f"unknown format {form}")
    return T.read_yaml_stream(text) if form == "yaml" else [READERS[form](text)]


def select_document(documents: list, which: str = "0") -> object:
    """--doc: a number, or `all` for an array of all."""
    if which == "all":
        return documents
    if not which.isdigit() or int(which) >= len(documents):
        raise DocumentError("usage", f"no document {which}: the file has {len(documents)}")
    return documents[int(which)]


def convert(text: str, source: str, target: str, sort: bool = False, indent: int | None = None, which: str = "0") -> str:
    """Read one format and write another. Markdown, Dockerfiles and ignore lists are never written."""
    if target == source == "markdown":
        return text
    if target not in WRITERS:
        raise DocumentError("write", f"{target} can't be written")
    value = select_document(documents_of(text, source), which)
    value = sorted_keys(value) if sort else value
    if target == "json" and indent is not None:
        return to_json(value, indent or None) + "\n"
    return WRITERS[target](value)


def losses(value: object, target: str) -> list[str]:
    """What a conversion to the target would change."""
    out = []
    if target in ("csv", "tsv", "ini", "dotenv"):
        text = to_json(value, finite=False)
        if re.search(r"(?:true|false|null|[-\d.]+)[,\]}]", text):
            out.append("scalars become strings")
    if target == "xml":
        out.append("types become text")
    return out


def format_text(text: str, form: str, sort: bool = False, indent: int = 2) -> str:
    """The same format anew."""
    if form == "frontmatter":
        kind, value, body, _ = T.split_frontmatter(text)
        return T.write_frontmatter(sorted_keys(value) if sort else value, kind, body)
    if form == "yaml":
        return T.write_yaml_stream([sorted_keys(d) if sort else d for d in documents_of(text, form)])
    return convert(text, form, form, sort, indent)


DOCUMENTS = "path string, format string, doc_idx int, json string, error_line int, error_col int, error string"


def read_documents(files: DataFrame, form: str | None = None, positions: bool = False, spread: int | None = None) -> DataFrame:
    """Rows of DOCUMENTS from files(path, content): one for each document, or one with an error.

    content is text or bytes; UTF-16 is told by its mark. form overrides detection. positions adds
    `spans`, for JSON and YAML: a JSON map from pointer to [line, column]. Files are read in tasks,
    one by one; nothing is shuffled, unless spread asks for so many partitions, by path: for few
    partitions of many small files whose reading and linting cost more than sending them.
    """
    from treeloom.sources.spans import spans_of

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = form or detect(path or "")
                try:
                    if own is None:
                        raise DocumentError("usage", "unknown format")
                    data = content or b""
                    text = data if own == "xml" else data.decode("utf-16" if data[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8")
                    documents = documents_of(text, own)
                    found = (spans_of(text, own) if positions else None) or [None] * len(documents)
                    rows += [(path, own, i, to_json(d, finite=False), None, None, None, to_json({p: list(x[:2]) for p, x in where.items()}) if where else None) for i, (d, where) in enumerate(zip(documents, found, strict=True))]
                except DocumentError as error:
                    rows.append((path, own, 0, None, error.line, error.col, error.message, None))
                except UnicodeDecodeError as error:
                    rows.append((path, own, 0, None, None, None, f"not UTF-8: {error.reason}", None))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)][: len(names)], names=names)

    schema = DOCUMENTS + ", spans string" * positions
    rows = files.select(F.col(files.columns[0]).cast("string").alias("path"), F.col(files.columns[1]).cast("binary").alias("content"))
    return (rows.repartition(spread, "path") if spread else rows).mapInArrow(run, schema)


def read_files(spark: SparkSession, paths: str | list[str], form: str | None = None) -> DataFrame:
    """Documents of the files that globs name; parts of the pattern prune the listing.

    A pattern with ** names the files at any depth below what comes before it whose paths fit the rest.
    """
    from treeloom.plans.lint import glob_pattern

    patterns = [paths] if isinstance(paths, str) else paths
    plain = [p for p in patterns if "**" not in p]
    found = [spark.read.format("binaryFile").load(plain)] if plain else []
    for p in patterns:
        if "**" in p:
            base = p[: p.index("**")].rstrip("/") or "."
            files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
            found.append(files.where(F.col("path").rlike("(?:^|/)" + glob_pattern(p.split("://", 1)[-1].lstrip("./"))[1:])))
    files = reduce(DataFrame.unionByName, found)
    return read_documents(files.select("path", "content"), form)


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One record a row, natively: (value VARIANT, record string); splittable, blank lines dropped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.try_parse_json("value").alias("value"), F.col("value").alias("record"))


def read_table(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """CSV or TSV natively: header, all strings, rows of another length are errors."""
    return spark.read.options(header=True, inferSchema=False, mode="FAILFAST", sep=delimiter, enforceSchema=False).csv(path)


def ini_rows(lines: DataFrame) -> DataFrame:
    """(path, section, key, value) from lines(path, n, line), natively: the section is the last header so far."""
    from pyspark.sql import Window

    bare = F.trim("line")
    header = F.when(bare.rlike(r"^\[.*\]$"), F.trim(F.regexp_extract(bare, r"^\[(.*)\]$", 1)))
    order = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("section", F.coalesce(F.last(header, ignorenulls=True).over(order), F.lit(""))).where(~bare.rlike(r"^(?:[#;\[]|$)"))
    return rows.select("path", "n", "section", F.trim(F.regexp_extract(bare, "^([^=:]*)[=:]", 1)).alias("key"), F.trim(F.regexp_extract(bare, "(?s)^[^=:]*[=:](.*)$", 1)).alias("value"))


def ignore_rows(lines: DataFrame) -> DataFrame:
    """(path, n, pattern) from lines(path, n, line)."""
    return lines.where(~F.col("line").rlike(r"^\s*(?:#.*)?$")).select("path", "n", F.regexp_replace("line", r"\s+$", "").alias("pattern"))
