"""JSON-lines tables: declared schemas, violation counts, atomic writes, manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlpit.session import cut

_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "strings": T.ArrayType(T.StringType()), "doubles": T.ArrayType(T.DoubleType())}


def _schema(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in columns.items()])


ITEMS = _schema(item_id="string", domain="string", name="string", category="string", price="double", price_level="int", city="string", source="string")
INTERACTIONS = _schema(user_id="string", item_id="string", rating="int", timestamp="string", text="string", source="string")
AIRPORTS = _schema(iata="string", name="string", city="string", country="string")
ROUTES = _schema(airline="string", src="string", dst="string")
AIRLINES = _schema(code="string", name="string")
EMAILS = _schema(email_id="string", date="string", subject="string", body="string")
PREDICTIONS = _schema(id="string", qid="string", predictor="string", template="string", options="strings", logits="doubles", probs="doubles")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """Rows of a (gzipped) JSON-lines file or folder. Blank lines are skipped.

    ``strict`` fails on the first malformed line when the rows are used; otherwise malformed lines become rows whose
    ``_corrupt_record`` holds the line, for :func:`violations` to count.
    """
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])).option("mode", "PERMISSIVE").json(path)


def violations(df: DataFrame, key: list[str], required: list[str]) -> DataFrame:
    """(check, n): malformed rows, nulls in required columns, repeated keys. All zero for a clean table."""
    checks = [F.count_if(F.col("_corrupt_record").isNotNull()).alias("malformed")] if "_corrupt_record" in df.columns else []
    checks += [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in required]
    first = df.agg(*checks, F.count("*").alias("_rows"), F.count_distinct(F.struct(*key)).alias("_keys"))
    wide = first.withColumn("repeated_key", F.col("_rows") - F.col("_keys")).drop("_rows", "_keys")
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("bigint").alias("n")) for c in wide.columns])).alias("x")).select("x.*")


def first_filled(df: DataFrame, *names: str) -> Column:
    """The first of several candidate columns that holds a value; blanks, ``\\N`` and ``-`` are no values."""
    have = [F.trim(F.col(n).cast("string")) for n in names if n in df.columns]
    return F.coalesce(*[F.when(~c.isin("", "\\N", "-"), c) for c in have]) if have else F.lit(None).cast("string")


def tolerant(df: DataFrame, wanted: dict[str, tuple[str, ...]], required: tuple[str, ...] = ()) -> DataFrame:
    """The wanted columns of a table of unknown make: each from the first candidate column that holds a value.

    Rows without a required value are left out; columns that nobody wants too.
    """
    out = df.select(*[first_filled(df, *names).alias(c) for c, names in wanted.items()])
    return out.dropna(subset=list(required)) if required else out


def write_jsonl(df: DataFrame, path: str, *order: str) -> None:
    """A folder of JSON-lines files, rows in ``order`` where asked for; the folder is swapped in when it is whole."""
    _replace(df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df, path)


def manifest(df: DataFrame) -> DataFrame:
    """(n_rows, digest): an identity of the rows that does not depend on their order or partitioning."""
    h = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest"))


def lines_of(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, line, value): the lines of files or folders that are not blank, with file names and line numbers from 1.

    Numbers make a file one task's work; use it where lines must be named, and split reading elsewhere.
    """
    raw = spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    return raw.filter(F.trim("value") != "").select("file", (F.col("line") + 1).alias("line"), F.rtrim("value", F.lit("\r")).alias("value"))


def malformed_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(file, line): where a file breaks its schema: no JSON object, or not exactly the schema's fields.

    All lines are checked in a split scan; only files with a broken line are read again to number it.
    """
    names = F.array(*map(F.lit, sorted(schema.fieldNames())))
    keys = F.array_sort(F.json_object_keys("value"))
    broken = (F.trim("value") != "") & (keys.isNull() | (keys != names))
    files = [r["file"] for r in spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).filter(broken).select("file").distinct().collect()]  # names of broken files
    if not files:
        return spark.createDataFrame([], "file string, line int")
    return lines_of(spark, *files).filter(broken).select("file", "line")


def returned_texts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((id, text), (file, rows, malformed, repeated)): texts given back by outsiders, the first of each id, and counts per file."""
    x = lines_of(spark, path).select("file", "line", F.get_json_object("value", "$.id").alias("id"), F.get_json_object("value", "$.text").alias("text"))
    order = Window.partitionBy("id").orderBy("file", "line")
    good = x.filter("id is not null and text is not null").withColumn("r", F.row_number().over(order))
    bad = x.filter("id is null or text is null").withColumn("r", F.lit(0))
    counts = good.unionByName(bad).groupBy("file").agg(F.count("*").alias("rows"), F.count_if(F.col("r") == 0).alias("malformed"), F.count_if(F.col("r") > 1).alias("repeated"))
    return good.filter("r = 1").select("id", "text"), counts


def canonical_json(df: DataFrame, *columns: str) -> Column:
    """One compact JSON text per row, fields in the given order, nulls kept; never sorted, since the order of options is meaning."""
    return F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"})


def write_document(df: DataFrame, path: str) -> None:
    """A table of one row as one JSON file in the folder ``path``, replaced as a whole."""
    _replace(df.coalesce(1), path)


def write_batches(df: DataFrame, path: str, batches: int, *order: str) -> None:
    """The rows in ``order``, cut into contiguous batches of equal size, one folder ``batch=i`` each.

    Rows are range-partitioned; partition counts (one row a task) give each row its number, so nothing is gathered.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    rows = cut(rows.withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "batches")
    sizes = rows.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a task
    total = rows.count()
    size = max(1, -(-total // max(1, batches)))
    numbered = rows.join(F.broadcast(sizes.select("_p", before.alias("_from"))), "_p").withColumn("batch", F.floor((F.col("_from") + F.col("_i")) / size).cast("int"))
    numbered.drop("_p", "_i", "_from").write.mode("overwrite").option("ignoreNullFields", "false").partitionBy("batch").json(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of every file of a folder, hashed where it lies."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def guarded(path: str, allowed: bool = False) -> str:
    """The path, refused when it names sealed or hidden data and the caller did not say that it may."""
    if not allowed and any(w in path.lower() for w in ("sealed", "hidden")):
        raise PermissionError("sealed data: say so to read it")
    return path


def _replace(df: DataFrame, path: str) -> None:
    """Write beside the target, then swap folders: readers see the old table or the new one, never none or half of one."""
    spark = df.sparkSession
    new, old = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}", f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    df.write.option("ignoreNullFields", "false").json(new)
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(at(path)) and fs.rename(at(path), at(old))
    if not fs.rename(at(new), at(path)):
        if had:
            fs.rename(at(old), at(path))
        raise OSError(f"{path} could not be replaced")
    if had:
        fs.delete(at(old), True)
