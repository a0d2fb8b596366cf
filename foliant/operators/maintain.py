"""Corpus maintenance: splitting, deduplication, postings, compaction, checks."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow import by_token, posting_runs
from ..functions.blobs import readable_content
from ..functions.text import normalized
from ..plans.keywords import compile_filter, parse, required_terms, sanitize
from ..storage import small_batches
from .corpus import write
from .ordered import places

POSTINGS = "db_id string, token string, id long, positions array<int>"
POSTINGS_A_BATCH = 50_000


def split_by_ranges(paragraphs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows with the identifier of every (start_date, end_date, identifier) that holds their date; others are dropped.

    Ranges, a handful of shard definitions, are joined by months, so the join has keys and any number of them works.
    """
    months = F.explode(F.sequence(F.trunc("start_date", "month"), F.trunc("end_date", "month"), F.expr("interval 1 month")))
    keyed = ranges.where("start_date <= end_date").select("*", months.alias("month"))
    joined = paragraphs.withColumn("month", F.trunc("document_date", "month")).join(keyed, "month")
    return joined.where("document_date between start_date and end_date").drop("month", "start_date", "end_date")


def keep_first(paragraphs: DataFrame) -> DataFrame:
    """Of a shard's rows with equal contents the one with the smallest id.

    Digests are grouped with partial aggregation, so many copies of one content don't meet in a window.
    """
    keyed = paragraphs.withColumn("digest", F.md5("content"))
    first = keyed.groupBy("db_id", "digest").agg(F.min("id").alias("id"))
    return keyed.join(first, ["db_id", "digest", "id"], "left_semi").drop("digest").select(paragraphs.columns)


def renumbered(paragraphs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Ids from 0 in each shard in the order of the old ids.

    Rows are counted in ranges of (shard, id) that hold about equally many, however the ids are spread; no window sees a shard.
    """
    return places(paragraphs, ["db_id"], [F.col("id").asc_nulls_first()], "_new", ranges).withColumn("id", F.col("_new")).select(paragraphs.columns)


def decodable(paragraphs: DataFrame) -> DataFrame:
    """Rows with stored contents (bytes) as rows with texts; those that can't be decoded are passed over, as an index does."""
    return paragraphs.withColumn("content", readable_content("content")).where("content is not null")


def postings(paragraphs: DataFrame) -> DataFrame:
    """(db_id, token, id, positions): every token of every row, with all places where it stands; in runs that are sorted by token and id.

    A run holds the tokens of about 8 MB of text, and a task makes as many as it has texts for, so neither its memory nor its Python
    worker's grows with the rows that it reads.
    """
    small_batches(paragraphs.sparkSession)
    norm = F.col("content_norm") if "content_norm" in paragraphs.columns else normalized(F.col("content"))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, row, token, positions in posting_runs(batches):
            order = by_token(token, row, keys.column(1))
            for k in range(0, len(order), POSTINGS_A_BATCH):
                own = pa.array(order[k : k + POSTINGS_A_BATCH])
                rows = pa.array(row[order[k : k + POSTINGS_A_BATCH]])
                yield pa.record_batch([keys.column(0).take(rows), token.take(own).cast("string"), keys.column(1).take(rows), positions.take(own)], names=["db_id", "token", "id", "positions"])
            del keys, row, token, positions, order  # before the next run is gathered

    return paragraphs.select("db_id", norm.alias("text"), F.col("id").cast("long")).mapInArrow(places, POSTINGS)


def write_postings(paragraphs: DataFrame, path: str) -> None:
    """The inverted index in runs sorted by token, as ``postings`` makes them; nothing is shuffled or sorted besides.

    A search reads of each run the pages whose first and last token fit, so small row groups and sorted tokens are what counts. A stored
    corpus is read by shards, so the runs' statistics tell shards apart, too.
    """
    postings(paragraphs).write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)


def document_frequency(index: DataFrame) -> DataFrame:
    """In how many rows each token of an index stands."""
    return index.groupBy("token").agg(F.count("*").alias("documents"))


def token_frequency(paragraphs: DataFrame) -> DataFrame:
    """``document_frequency`` without an index: one shuffle, of sums per token."""
    norm = F.col("content_norm") if "content_norm" in paragraphs.columns else normalized(F.col("content"))
    tokens = paragraphs.select(F.explode(F.array_distinct(F.split(F.trim(norm), " "))).alias("token"))
    return tokens.where("token != ''").groupBy("token").agg(F.count("*").alias("documents"))


def postings_matches(paragraphs: DataFrame, index: DataFrame, keywords: str) -> DataFrame:
    """A keyword search that looks candidates up in the index, and then checks each; the same rows as a scan.

    Without a whole token in some alternative of the query, there is nothing to look up and all rows are checked.
    """
    tree = parse(sanitize(keywords))
    norm = F.col("content_norm") if "content_norm" in paragraphs.columns else normalized(F.col("content"))
    test, terms = compile_filter(tree, norm), required_terms(tree)
    if terms is None:
        return paragraphs.where(test)
    keys = None
    for alternative in terms:
        hits = index.where(F.col("token").isin(sorted(alternative))).groupBy("db_id", "id").agg(F.count("*").alias("n")).where(F.col("n") == len(alternative)).select("db_id", "id")
        keys = hits if keys is None else keys.unionAll(hits)
    return paragraphs.where(test) if keys is None else paragraphs.join(keys, ["db_id", "id"], "left_semi").where(test)


def keys_are_unique(paragraphs: DataFrame) -> bool:
    """Whether (db_id, id) is a key."""
    return paragraphs.groupBy("db_id", "id").count().where("count > 1").isEmpty()


def rewrite_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per shard: rows and characters before and after a rewrite, and by how many percent the characters are fewer."""
    sizes = lambda df, when: df.groupBy("db_id").agg(F.count("*").alias(f"rows_{when}"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias(f"chars_{when}"))
    both = sizes(before, "before").join(sizes(after, "after"), "db_id", "left").fillna(0)
    return both.withColumn("reduction_percent", F.when(F.col("chars_before") > 0, F.round((1 - F.col("chars_after") / F.col("chars_before")) * 100, 2)).otherwise(0.0))


def integrity(paragraphs: DataFrame) -> DataFrame:
    """Per shard: rows, distinct ids, and rows without a number, a date or a content."""
    missing = F.col("process_number").isNull() | F.col("document_date").isNull() | F.col("content").isNull()
    return paragraphs.groupBy("db_id").agg(F.count("*").alias("n_rows"), F.countDistinct("id").alias("distinct_ids"), F.count_if(missing).alias("incomplete"))


def shard_names(spark: SparkSession, path: str) -> list[str]:
    """The shards of a stored corpus, by its folders."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)
    return sorted(unquote(x.getPath().getName().removeprefix("db_id=")) for x in found if x.getPath().getName().startswith("db_id="))


def optimize_shards(spark: SparkSession, source: str, target: str, at_once: int = 4) -> list[dict]:
    """``optimize`` for each shard of a corpus by itself, into ``target/db_id=...``; a shard that fails is reported and left out.

    ``at_once`` shards are worked on side by side, so that one's last tasks don't keep the others waiting.
    """

    def one(name: str) -> dict:
        path = f"{target}/db_id={name}"
        try:
            own = spark.read.parquet(f"{source}/db_id={name}").withColumn("db_id", F.lit(name))
            kept = renumbered(keep_first(own.drop("content_norm")))
            write(kept.drop("db_id"), path, "append", shards=False)
            done = spark.read.parquet(path).withColumn("db_id", F.lit(name))
            return rewrite_summary(own, done).first().asDict() | {"error": None}
        except Exception as e:
            return {"db_id": name, "error": str(e)[:500]}

    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(one, shard_names(spark, source)))


def optimize(spark: SparkSession, source: str, target: str) -> dict[str, float]:
    """Deduplicate, renumber, normalize, sort and rewrite a corpus to ``target``; check it; report sizes."""
    before = spark.read.parquet(source)
    kept = renumbered(keep_first(before.drop("content_norm")))
    write(kept, target, "overwrite")
    after = spark.read.parquet(target)
    if not keys_are_unique(after):
        raise ValueError("ids aren't unique after the rewrite")
    sizes = [stored_bytes(spark, p) for p in (source, target)]
    return {"rows_before": before.count(), "rows_after": after.count(), "mb_before": sizes[0] / 1e6, "mb_after": sizes[1] / 1e6, "reduction_percent": reduction(*sizes)}


def reduction(before: float, after: float) -> float:
    return round((1 - after / before) * 100, 2) if before else 0.0


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes below a path, asked from its file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def analyze(spark: SparkSession, table: str) -> None:
    """Statistics of a catalog table for the optimizer."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")


def known_rows(spark: SparkSession, table: str) -> int | None:
    """The number of rows that the catalog knows of a table since it was analyzed."""
    told = spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Statistics'").select(F.regexp_extract("data_type", r"(\d+) rows", 1).alias("n")).first()
    return int(told.n) if told and told.n else None
