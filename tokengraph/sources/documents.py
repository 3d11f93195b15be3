"""Header + body documents: scan, header decoding, validation, identity and metadata defaults, sink."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokengraph.functions import constants as K
from tokengraph.functions.text import py_trim

HEADER_BODY = r"(?s)^---\s*\n(.*?)\n---\s*\n(.*)"
HEADER_SCHEMA = (
    "error string, okf_version string, id string, title string, classification string, department string, "
    "author string, created string, entity_categories array<string>, redaction_policy string, "
    "min_confidence double, namespace string, link_strategy string, max_traversal_depth int"
)
TEXT_FORMATS = ["md", "markdown", "txt"]
TABLE_FORMATS = ["csv"]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): every file below ``path`` as one text."""
    return (
        spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    )


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def route(files: DataFrame) -> dict[str, DataFrame]:
    """Split (path, …) by file type: ``text``, ``table`` and ``rejected`` (path, reason)."""
    ext = extension(F.col("path"))
    rejected = files.filter(~ext.isin(TEXT_FORMATS + TABLE_FORMATS)).select(
        "path", F.concat(F.lit("unsupported format: "), ext).alias("reason")
    )
    return {"text": files.filter(ext.isin(TEXT_FORMATS)), "table": files.filter(ext.isin(TABLE_FORMATS)), "rejected": rejected}


_VALUE = r"""(?:"[^"\\]*"|'(?:[^']|'')*'|\w[\w./@-]*)"""
PLAIN_LINE = re.compile(rf" *(?:[A-Za-z_]\w*:(?: +{_VALUE})?|- +{_VALUE})", re.A)


def load_header(raw: str):
    """The YAML value of a header. One of plain lines only, on which both loaders agree, takes the much faster C loader."""
    import yaml

    plain = raw.isascii() and all(line.isprintable() and PLAIN_LINE.fullmatch(line) for line in raw.split("\n"))
    return yaml.load(raw, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader) if plain else yaml.SafeLoader)


def _header_row(raw: str | None) -> dict:
    """Decode one YAML header to the fields of the schema; a helper for the vectorised UDF below."""
    import yaml

    if raw is None:
        return {"error": None}
    try:
        data = load_header(raw)
    except yaml.YAMLError:
        return {"error": "malformed header"}
    if not isinstance(data, dict):
        return {"error": "malformed header"}
    doc, privacy, graph = (data.get(k) if isinstance(data.get(k), dict) else {} for k in ("document", "privacy", "graph"))

    def text(v):
        return v if isinstance(v, str) else None

    def number(v, default):
        if v is None:
            return default
        try:
            return float(v)
        except (TypeError, ValueError):
            return None

    cats = privacy.get("entity_categories")
    depth = number(graph.get("max_traversal_depth"), 3.0)
    created = doc.get("created")
    return {
        "error": None,
        "okf_version": text(data.get("okf_version", "1.0")),
        "id": text(doc.get("id")),
        "title": text(doc.get("title")),
        "classification": text(doc.get("classification")),
        "department": text(doc.get("department")),
        "author": text(doc.get("author")),
        "created": None if created is None else str(created),
        "entity_categories": cats if isinstance(cats, list) and all(isinstance(c, str) for c in cats) else None,
        "redaction_policy": text(privacy.get("redaction_policy", "TOKENIZE")),
        "min_confidence": number(privacy.get("min_confidence"), K.DEFAULT_MIN_CONFIDENCE),
        "namespace": text(graph.get("namespace")),
        "link_strategy": text(graph.get("link_strategy", "cross_document")),
        "max_traversal_depth": int(depth) if depth is not None and depth == int(depth) else None,
    }


def _decoder():
    @F.pandas_udf(HEADER_SCHEMA)
    def decode(raw: pd.Series) -> pd.DataFrame:
        names = [part.strip().split(" ")[0] for part in HEADER_SCHEMA.split(",") if part.strip()]
        rows = [_header_row(r) for r in raw]
        frame = pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names, dtype=object)
        return frame.astype({"max_traversal_depth": "Int32", "min_confidence": "Float64"})

    # A filter on its result would otherwise be pushed below it, and every header decoded twice.
    return decode.asNondeterministic()


def header_errors(h: Column) -> Column:
    """All reasons why a decoded header is not valid."""
    required = ["id", "title", "department", "author", "namespace", "entity_categories", "okf_version"]
    checks = [F.when(h["error"].isNotNull(), h["error"])]
    usable = h["error"].isNull()
    checks += [F.when(usable & h[c].isNull(), F.lit(f"missing {c}")) for c in required]
    checks += [
        F.when(usable & ~F.coalesce(h["classification"].isin(K.CLASSIFICATIONS), F.lit(False)), F.lit("bad classification")),
        F.when(usable & ~F.coalesce(h["redaction_policy"].isin(K.REDACTION_POLICIES), F.lit(False)), F.lit("bad redaction_policy")),
        F.when(usable & ~F.coalesce(h["link_strategy"].isin("ISOLATED", "cross_document"), F.lit(False)), F.lit("bad link_strategy")),
        F.when(usable & ~F.coalesce(h["min_confidence"].between(0.0, 1.0), F.lit(False)), F.lit("bad min_confidence")),
        F.when(usable & ~F.coalesce(h["max_traversal_depth"].between(1, 10), F.lit(False)), F.lit("bad max_traversal_depth")),
        F.when(usable & F.try_to_date(h["created"]).isNull(), F.lit("bad created")),
    ]
    return F.array_compact(F.array(*checks))


def parse_documents(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) from (path, content).

    Only the header text goes through Python (an Arrow batch UDF around a YAML reader); bodies stay in the JVM.
    Documents: path, header STRUCT, body. Rejects: path, reasons ARRAY<STRING>.
    """
    raw = F.regexp_extract("content", HEADER_BODY, 1)
    has = F.col("content").rlike(r"(?s)^---\s*\n.*?\n---\s*\n")
    staged = files.select(
        "path",
        has.alias("_has"),
        F.when(has, raw).alias("_raw"),
        F.when(has, py_trim(F.regexp_extract("content", HEADER_BODY, 2))).alias("body"),
    )
    decoded = staged.withColumn("header", _decoder()(F.col("_raw")))
    reasons = F.when(~F.col("_has"), F.array(F.lit("no header"))).otherwise(header_errors(F.col("header")))
    checked = decoded.withColumn("reasons", reasons)
    good = checked.filter(F.size("reasons") == 0).select("path", "header", "body")
    bad = checked.filter(F.size("reasons") > 0).select("path", "reasons")
    return good, bad


def sentences_with_hints(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, sent_idx, text, hints) from array columns; sentences past the hint list get none."""
    zipped = F.arrays_zip(F.col("sentences").alias("s"), F.col("sentence_hints").alias("h"))
    rows = docs.select(doc_id, F.posexplode_outer(zipped).alias("sent_idx", "_z"))
    return rows.filter(F.col("_z.s").isNotNull()).select(doc_id, "sent_idx", F.col("_z.s").alias("text"), F.col("_z.h").alias("hints"))


def clean_stem(filename: Column) -> Column:
    """File name without directories, extension and odd characters; ``doc`` when nothing is left."""
    base = F.regexp_extract(filename, r"([^/\\]*)$", 1)
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
    slug = F.regexp_replace(stem, r"(?U)[^\w\-_]", "")
    return F.when(slug == "", "doc").otherwise(slug)


def document_id(prefix: str, filename: Column, content: Column) -> Column:
    """``PREFIX-<stem>-<hash>`` in upper case; the hash covers the first 1024 bytes of ``content`` (binary)."""
    digest = F.substring(F.sha2(F.substring(content, 1, 1024), 256), 1, 6)
    return F.upper(F.concat(F.lit(prefix + "-"), F.substring(clean_stem(filename), 1, 24), F.lit("-"), digest))


def namespace(prefix: str, filename: Column) -> Column:
    return F.concat(F.lit(prefix + "."), F.lower(F.regexp_replace(clean_stem(filename), "[^a-zA-Z0-9_]", "_")))


def not_blank(c: Column) -> Column:
    return F.when(py_trim(c) != "", c)


def title_from_name(filename: Column) -> Column:
    base = F.regexp_extract(filename, r"([^/\\]*)$", 1)
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
    return F.initcap(F.translate(stem, "_-", "  "))


def resolve_title(override: Column, embedded: Column, body: Column, filename: Column) -> Column:
    """Override, embedded title, a short first body line, else the file name."""
    inside = F.when(py_trim(embedded) != "(anonymous)", not_blank(embedded))
    first = py_trim(F.get(F.split(body, "\n", 2), F.lit(0)))
    return F.coalesce(not_blank(override), inside, F.when((first != "") & (F.length(first) < 100), first), title_from_name(filename))


def resolve_author(override: Column, embedded: Column) -> Column:
    inside = F.when(py_trim(embedded) != "(anonymous)", not_blank(embedded))
    return F.coalesce(not_blank(override), inside, F.lit("System Ingest"))


def resolve_department(override: Column) -> Column:
    return F.coalesce(not_blank(override), F.lit("General"))


def resolve_classification(value: Column) -> Column:
    up = F.upper(value)
    return F.when(up.isin(K.CLASSIFICATIONS), up).otherwise("INTERNAL")


def resolve_date(raw: Column) -> Column:
    """Date inside ``D:YYYYMMDD…``; today when there is none."""
    return F.coalesce(F.try_to_date(F.regexp_extract(raw, r"(\d{8})", 1), "yyyyMMdd"), F.current_date())


def page_department(text: Column) -> Column:
    """Department of a roster heading on a page; null without one."""
    raw = py_trim(F.regexp_extract(text, K.ROSTER_PATTERN, 1))
    clean = py_trim(F.regexp_replace(raw, K.ROSTER_PREFIX_PATTERN, ""))
    one_case = (clean == F.lower(clean)) | (clean == F.upper(clean))
    return F.when(raw != "", F.when(one_case, F.initcap(clean)).otherwise(clean))


def to_markdown(docs: DataFrame) -> DataFrame:
    """(doc_id, value): each document as header + body text, ready for ``write.partitionBy('doc_id').text``."""

    def quoted(c: Column) -> Column:
        return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))

    h = F.col("header")
    cats = F.array_join(F.transform(h["entity_categories"], lambda c: F.concat(F.lit("  - "), quoted(c), F.lit("\n"))), "")
    value = F.concat(
        F.lit("---\nokf_version: "), quoted(h["okf_version"]),
        F.lit("\ndocument:\n  id: "), quoted(h["id"]),
        F.lit("\n  title: "), quoted(h["title"]),
        F.lit("\n  classification: "), h["classification"],
        F.lit("\n  department: "), quoted(h["department"]),
        F.lit("\n  author: "), quoted(h["author"]),
        F.lit("\n  created: '"), h["created"],
        F.lit("'\nprivacy:\n  entity_categories:\n"), cats,
        F.lit("  redaction_policy: "), h["redaction_policy"],
        F.lit("\n  min_confidence: "), h["min_confidence"].cast("string"),
        F.lit("\ngraph:\n  namespace: "), quoted(h["namespace"]),
        F.lit("\n  link_strategy: "), h["link_strategy"],
        F.lit("\n  max_traversal_depth: "), h["max_traversal_depth"].cast("string"),
        F.lit("\n---\n\n# "), h["title"], F.lit("\n\n"), F.col("body"), F.lit("\n"),
    )
    return docs.select(h["id"].alias("doc_id"), value.alias("value"))
