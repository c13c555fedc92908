"""Input tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table below ``sf_dir``; any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """The same as a stream of files; zoneless timestamps become timestamps, as watermarks need them."""
    path = f"{sf_dir}/{name}.parquet"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        reader, path = reader.option("pathGlobFilter", f"{name}.parquet"), sf_dir  # a stream reads folders
    df = reader.parquet(path)
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` over all cores if the scan has fewer partitions than that; a larger scan stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def word_shingles(df: DataFrame, id_: str, text: str, n: int = 5) -> DataFrame:
    """id_, shingle: runs of n words joined by blanks, the whole text if it has fewer; nothing for no words."""
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("_w", i, n), " "))
    return spread(df.select(id_, text), id_, text).select(id_, words.alias("_w")).where(F.size("_w") > 0).select(id_, F.explode(runs).alias("shingle"))
