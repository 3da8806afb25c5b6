"""Log files as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from boxlore.functions import fixed_values as fixed, rolling_hash
from boxlore.functions.text import file_name
from boxlore.plans.ordered import SEGMENT, SEGMENTS


def valid_text(text: Column) -> Column:
    """Text without the bytes that are no UTF-8; valid text (nearly all) is only checked."""
    return F.when(F.is_valid_utf8(text), text).otherwise(F.regexp_replace(F.make_valid_utf8(text), "\ufffd", ""))


def _reader(spark: SparkSession, name_contains: str | None):
    reader = spark.read.option("recursiveFileLookup", "true")
    return reader.option("pathGlobFilter", f"*{name_contains}*") if name_contains else reader


def read_files(spark: SparkSession, root: str, name_contains: str | None = None) -> DataFrame:
    """(path, file_name, content, file_hash), one row per non-empty plain or gzip file, for
    files that fit a task; ``raw_lines`` reads files of any size."""
    raw = _reader(spark, name_contains).text(root, wholetext=True)
    return raw.where(F.col("value") != "").select(
        F.col("_metadata.file_path").alias("path"), valid_text(F.col("value")).alias("content")
    ).select(
        "path", file_name(F.col("path")).alias("file_name"), "content", F.md5("content").alias("file_hash")
    )


def lines_of_files(files: DataFrame) -> DataFrame:
    """(path, line_no, line) for each line of whole-file rows; a final line end adds no line."""
    text = F.regexp_replace("content", f"({fixed.LINE_ENDS})\\z", "")
    rest = [c for c in files.columns if c != "content"]
    return files.select(*rest, F.posexplode(F.split(text, fixed.LINE_ENDS)).alias("line_no", "line")).withColumn(
        "line_no", F.col("line_no").cast("bigint")
    )


# --- lines of files of any size ----------------------------------------------------------


def of_text(raw: DataFrame) -> DataFrame:
    """(path, _segment, value) of rows of the text source, batch or stream; the segment is the block of the file."""
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias(SEGMENT), "value")


def raw_lines(spark: SparkSession, root: str, name_contains: str | None = None) -> DataFrame:
    """Rows of all files under ``root``.  The source splits plain files into blocks that tasks
    read on their own (gzip files are one block) and cuts at the common line ends."""
    return of_text(_reader(spark, name_contains).text(root))


def cut_lines(raw: DataFrame) -> DataFrame:
    """(path, _segment, _at, line): each line with a number that counts up within its block.

    The rarer line ends are cut here, so lines are the same whatever blocks they came in."""
    ends = fixed.RARE_LINE_ENDS
    parts = F.split(F.translate(valid_text(F.col("value")), ends, "\n" * len(ends)), "\n")
    return raw.select("path", SEGMENT, F.explode(parts).alias("line")).select(
        "path", SEGMENT, F.monotonically_increasing_id().alias("_at"), "line")


def stored_lines(lines: DataFrame, folder: str) -> DataFrame:
    """The lines of ``cut_lines`` as a table in ``folder``, for steps that read them more than once:
    to open a small file takes longer than to read its lines."""
    lines.repartition("path", SEGMENT).write.parquet(folder)
    return lines.sparkSession.read.schema(lines.schema).parquet(folder)


_PLACE = (1 << 33) - 1  # the bits of _at that count the rows of a task


def summed_blocks(lines: DataFrame) -> DataFrame:
    """(path, _segment, first_at, line_count, first_line, sum_0 ...) of each block.

    One pass that shuffles one row per block: a task numbers the lines of a block one after
    the other, and their hashes are summed by that number (see rolling_hash)."""
    terms = rolling_hash.terms(F.col("line"), F.col("_at").bitwiseAND(F.lit(_PLACE)))
    return lines.groupBy("path", SEGMENT).agg(
        F.min("_at").alias("first_at"), F.count("*").alias("line_count"), F.min_by("line", "_at").alias("first_line"),
        *[F.sum(term).alias(f"sum_{k}") for k, term in enumerate(terms)])


def placed_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with the number of lines of the file before them (``before``) and of its blocks (``_segments``)."""
    before = W.partitionBy("path").orderBy(SEGMENT).rowsBetween(W.unboundedPreceding, -1)
    return blocks.withColumn("before", F.coalesce(F.sum("line_count").over(before), F.lit(0))).withColumn(
        SEGMENTS, F.count("*").over(W.partitionBy("path")))


def files_of(placed: DataFrame) -> DataFrame:
    """(path, file_name, file_hash, lines, first_line), one row per file, from its blocks.

    The hash depends on the lines and their order alone, not on line ends or blocks."""
    back = F.col("first_at").bitwiseAND(F.lit(_PLACE))
    sums = [F.sum(rolling_hash.moved(F.col(f"sum_{k}"), back, F.col("before"), k)) for k in range(len(rolling_hash.MODULI))]
    count = F.sum("line_count")
    return placed.groupBy("path").agg(
        rolling_hash.digest(count, sums).alias("file_hash"), count.alias("lines"), F.min_by("first_line", SEGMENT).alias("first_line"),
    ).select("path", file_name(F.col("path")).alias("file_name"), "file_hash", "lines", "first_line")


def numbered_lines(lines: DataFrame, placed: DataFrame) -> DataFrame:
    """(path, file_name, _segment, line_no, line) of the blocks in ``placed``, and its further columns."""
    known = ["path", SEGMENT, "first_at", "line_count", "first_line", "before", *[f"sum_{k}" for k in range(len(rolling_hash.MODULI))]]
    extra = [c for c in placed.columns if c not in known]
    # a block is one row beside its lines, so the blocks of a task are hashed and its lines needn't be sorted
    blocks = placed.select("path", SEGMENT, "first_at", "before", file_name(F.col("path")).alias("file_name"), *extra)
    joined = lines.join(blocks.hint("shuffle_hash"), ["path", SEGMENT])
    number = (F.col("before") + F.col("_at") - F.col("first_at")).cast("bigint")
    return joined.select("path", "file_name", SEGMENT, number.alias("line_no"), "line", *extra)


def inventory(spark: SparkSession, root: str, excludes: list[str] | None = None,
              endings: list[str] | None = None) -> DataFrame:
    """(file_name, md5) of every file under ``root`` outside the excluded names."""
    excludes = fixed.INVENTORY_EXCLUDES if excludes is None else excludes
    endings = fixed.INVENTORY_EXCLUDED_ENDINGS if endings is None else endings
    found = _reader(spark, None).format("binaryFile").load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString()
    relative = F.regexp_replace(F.col("path"), "^" + base.replace(".", r"\.") + "/?", "")
    kept = found.select(relative.alias("file_name"), "content")
    for part in excludes:
        kept = kept.where(~F.col("file_name").contains(part))
    for ending in endings:
        kept = kept.where(~F.col("file_name").endswith(ending))
    return kept.where(~F.col("file_name").rlike(r"(^|/)\.[^/]*/")).select("file_name", F.md5("content").alias("md5"))
