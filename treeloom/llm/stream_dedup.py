"""Exact deduplication by a stateful stream with disk-backed keyed state (operator 4).

Texts are equal when they are after each run of ASCII white space became one space. A first pass
writes (row, doc_id, digest, locator) of each document to the shared folder, the locator being the
file that holds it and its place there; a structured stream over such rows keeps, for each
digest, the stable identifier (least doc_id and row), the content locator of that document and the
number of its copies. The state lives in RocksDB, without
watermark, so nothing ever expires, and later batches of the stream go on from it. Copies of one
text within a batch are counted by partial aggregation before they are shuffled: a text with a
third of all rows is one row from each task.

A digest met again is a hit. On hits the full bytes are compared: the texts of all hits, fetched by
locator, meet that of the document to which the state's locator leads, dealt over salts where a digest
is very frequent. If any differ, the digest's documents are grouped by their bytes instead (`digest` may be any
function, tests use a colliding one; the result never depends on it).

Documents that don't come straight from files are written to the shared folder first.

Recovery: the stream's checkpoint, the first pass and the result are files in the shared folder.

Edge cases: null counts as empty, so nulls and empty texts are one group. Where rows with equal
texts share the least doc_id, one of them stays. A null doc_id is larger than all others. An empty
table gives an empty result. Further columns are ignored; `deduplicated` returns all columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm.common import SPACES, hot_counts, salted_join, shared_folder, temporary, written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_KEYS = "row long, doc_id long, digest string, locator string"
_NONE = (1 << 63) - 1


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def watch(rows: DataFrame, state: str, batches: str) -> None:
    """Run a stream of rows (row, doc_id, digest, locator) to its present end.

    state: folder of the stream's checkpoint, which holds the keyed state and from which a later
    call goes on; batches: folder that gets, for each batch, the digests it touched.
    """
    kept = rows.groupBy("digest").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(_NONE)).alias("id"), "row", "locator")).alias("first"), F.count("*").alias("n"))
    query = (
        kept.writeStream.outputMode("update")
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .foreachBatch(lambda df, batch: df.select("digest", "first.id", "first.row", "first.locator", "n", F.lit(batch).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{batches}/batch={batch}"))
        .start()
    )
    query.awaitTermination()


def state_of(spark: SparkSession, batches: str) -> DataFrame:
    """The newest (digest, id, row, locator, n) of each digest; id is the least doc_id."""
    schema = "digest string, id long, row long, locator string, n long, batch long"
    try:
        found = spark.read.schema(schema).parquet(batches)
    except Exception as error:  # no batch: the stream had no rows
        if "PATH_NOT_FOUND" not in str(error):
            raise
        found = spark.createDataFrame([], schema)
    if found.select("batch").distinct().limit(2).count() > 1:
        found = found.groupBy("digest").agg(F.max_by(F.struct("id", "row", "locator", "n"), "batch").alias("x")).select("digest", "x.*")
    return found.select("digest", "id", "row", "locator", "n")


def located(docs: DataFrame) -> DataFrame:
    """(_row, _locator): the rows of docs as structs, with the file that holds each and its place there, unique and the same in every run."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    place = F.concat_ws("#", "_metadata.file_path", F.col("_metadata.row_index").cast("string")).alias("_locator")
    try:
        if "_metadata" not in docs.columns:
            return docs.select(whole, place)
    except AnalysisException:  # not straight from files that number their rows
        pass
    return written(docs.select(whole), "contents").select("_row", place)


def keys(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(row, doc_id, digest, locator) of docs(doc_id, text)."""
    return _keys(located(docs), digest)


def _keys(places: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    return places.select(F.monotonically_increasing_id().alias("row"), F.col("_row.doc_id").cast("long").alias("doc_id"), digest(normalised(F.col("_row.text"))).alias("digest"), F.col("_locator").alias("locator"))


def groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(row, doc_id, digest, locator, keep_id, keep_row, group_size) for each document; bytes compared."""
    return _groups(located(docs), digest)


def _groups(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    spark = docs.sparkSession
    base = shared_folder(spark, "dedup")
    _keys(docs, digest).write.parquet(f"{base}/keys")
    temporary(spark, base)
    session = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        if (value := spark.conf.get(name, None)) is not None:
            session.conf.set(name, value)
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    # Else each of the many small databases reserves megabytes on disk that it never fills.
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    watch(session.readStream.schema(_KEYS).parquet(f"{base}/keys"), f"{base}/state", f"{base}/batches")
    state = state_of(spark, f"{base}/batches")
    hot = written(hot_counts(state, "digest"), "hot")
    rows = spark.read.schema(_KEYS).parquet(f"{base}/keys")
    state = state.select("digest", F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("locator").alias("keep_at"), F.col("n").alias("group_size"))
    out = salted_join(rows, state, "digest", hot, F.col("row"))
    out = written(out.withColumn("first", F.col("locator") == F.col("keep_at")).withColumn("keep_id", F.when(F.col("keep_id") < _NONE, F.col("keep_id"))).drop("keep_at"), "groups")
    # Full bytes of all hits, and of the documents to which the state's locators lead.
    hits = out.where("group_size > 1").select(F.col("locator").alias("_locator"), "digest", "doc_id", "row", "first")
    texts = written(docs.select("_locator", normalised(F.col("_row.text")).alias("text")).join(hits, "_locator"), "hits")
    firsts = texts.where("first").select("digest", F.col("text").alias("expected"))
    differ = salted_join(texts.select("digest", "text", "row"), firsts, "digest", hot, F.col("row")).where("text <> expected").select("digest").distinct()
    differ = written(differ, "differ")
    out = out.drop("first")
    if differ.isEmpty():
        return out
    rest = texts.join(differ, "digest", "left_semi").select("row", "digest", "text", F.coalesce("doc_id", F.lit(_NONE)).alias("id"))
    own = rest.groupBy("digest", "text").agg(F.min(F.struct("id", "row")).alias("k"), F.count("*").alias("group_size"))
    own = rest.join(own, ["digest", "text"]).select("row", F.when(F.col("k.id") < _NONE, F.col("k.id")).alias("keep_id"), F.col("k.row").alias("keep_row"), "group_size")
    clash = out.join(differ, "digest", "left_semi").drop("keep_id", "keep_row", "group_size").join(own, "row")
    return out.join(differ, "digest", "left_anti").unionByName(clash)


def marked(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest) for each document."""
    return groups(docs, digest).select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    places = located(docs)
    stays = _groups(places, sha256).where("row = keep_row").select(F.col("locator").alias("_locator"))
    return places.join(stays, "_locator", "left_semi").select("_row.*")
