"""Small files and folders in whatever store the cluster's paths name, by its Hadoop file system."""

from pyspark.sql import SparkSession


def _of(spark: SparkSession, path: str):
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()), place


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, none if it does not exist."""
    fs, place = _of(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, place = _of(spark, path)
    stream = fs.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def publish_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that readers see whole or not at all; it must not exist yet."""
    fs, place = _of(spark, path)
    draft = place.suffix(".draft")
    stream = fs.create(draft, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if not fs.rename(draft, place):
        raise FileExistsError(path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or a folder with all it holds, if it exists."""
    fs, place = _of(spark, path)
    fs.delete(place, True)
