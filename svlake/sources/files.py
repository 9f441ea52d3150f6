"""Small files around the analysis: depth text, line dumps, label lists, JSON reports, listings, grey images."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEPTH = "chrom string, pos long, depth long"


def write_depth(depth: DataFrame, path: str) -> None:
    """(chrom, pos, depth) as tab-separated text without a header, a folder for each chromosome. pos counts from 0 here and from 1 in
    the text. What is there already stays."""
    rows = depth.select("chrom", F.col("chrom").alias("name"), (F.col("pos") + 1).alias("pos"), "depth")
    rows.write.mode("ignore").partitionBy("chrom").csv(path, sep="\t")


def read_depth(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, depth) of depth text, pos from 0. Folders of single chromosomes are read together."""
    rows = spark.read.csv(path, sep="\t", schema=DEPTH, recursiveFileLookup=True)
    return rows.withColumn("pos", F.col("pos") - 1)


def write_sorted(rows: DataFrame, order: list[str], line: str, path: str) -> None:
    """One text file in the folder ``path``, the values of ``line`` in the order of ``order``. All tasks sort and write ranges of the rows, whose
    bytes one task then copies behind each other, a piece at a time. What was in the folder goes."""
    spark = rows.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    target = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    rows.orderBy(*order).select(line).write.mode("overwrite").text(f"{target}.parts")

    def join(batches):
        for b in batches:
            for uri in b.column(0).to_pylist():
                fs, folder = pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace(":/", ":///", 1))
                parts = sorted(i.path for i in fs.get_file_info(pafs.FileSelector(f"{folder}.parts")) if i.base_name.startswith("part-"))
                if fs.get_file_info(folder).type != pafs.FileType.NotFound:
                    fs.delete_dir(folder)
                fs.create_dir(folder)
                with fs.open_output_stream(f"{folder}/_part", compression=None) as out:
                    for part in parts:
                        with fs.open_input_stream(part, compression=None) as into:
                            while piece := into.read(1 << 22):
                                out.write(piece)
                fs.move(f"{folder}/_part", f"{folder}/part-00000.txt")
                fs.delete_dir(f"{folder}.parts")
                yield pa.RecordBatch.from_pydict({"parts": pa.array([len(parts)], pa.int64())})

    spark.createDataFrame([(target,)], "uri string").coalesce(1).mapInArrow(join, "parts long").collect()


def write_lines(lines: DataFrame, path: str, head: str | None = None) -> None:
    """Lines (ord, line) in order, below one more line ``head``; one file, as its readers want it (``write_sorted``)."""
    rows = lines.select("ord", "line")
    if head is not None:
        rows = rows.unionByName(lines.sparkSession.range(1).select(F.lit(-(1 << 62)).alias("ord"), F.lit(head).alias("line")))
    write_sorted(rows, ["ord"], "line", path)


def write_labels(labels: DataFrame, path: str) -> None:
    """(place, label) as text, a number to a line in the order of place."""
    write_lines(labels.select(F.col("place").alias("ord"), F.col("label").cast("string").alias("line")), path)


def write_report(rows: DataFrame, path: str) -> None:
    """Rows as JSON, one object to a line."""
    rows.write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str, schema: str, whole: bool = False) -> DataFrame:
    """Rows of JSON files, one object to a line, or with ``whole`` one object or array to a file."""
    return spark.read.json(path, schema=schema, multiLine=whole)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(file, place) of all files below a folder; place is the number that the name begins with, or null. Contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"))
    return found.withColumn("place", F.regexp_extract("file", r"/(\d+)[^/]*$", 1).try_cast("long"))


def grey_pixels(png: bytes) -> tuple[int, int, bytes]:
    """(width, height, pixels) of an 8-bit PNG without interlacing; colours become grey by the weights 299, 587 and 114."""
    if png[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG image")
    at, data = 8, b""
    while at < len(png):
        (n,), kind = struct.unpack(">I", png[at : at + 4]), png[at + 4 : at + 8]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", png[at + 8 : at + 21])
        elif kind == b"IDAT":
            data += png[at + 8 : at + 8 + n]
        at += 12 + n
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or interlaced or channels is None:
        raise ValueError("only 8-bit grey and true-colour images without interlacing")
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * channels)
    out, above = np.zeros((height, width * channels), np.uint8), np.zeros(width * channels, np.int64)
    for y in range(height):
        kind, line = int(rows[y, 0]), rows[y, 1:].astype(np.int64)
        if kind == 2:
            line = line + above
        elif kind == 1:
            line = np.cumsum(line.reshape(-1, channels), axis=0).ravel()
        elif kind > 2:
            for x in range(len(line)):
                left, corner = (line[x - channels], above[x - channels]) if x >= channels else (0, 0)
                guess = (left + above[x]) // 2
                if kind == 4:
                    guess = min((left, above[x], corner), key=lambda v, p=left + above[x] - corner: abs(p - v))
                line[x] = (line[x] + guess) & 255
        above = line & 255
        out[y] = above
    image = out.reshape(height, width, channels).astype(np.int64)
    grey = image[..., 0] if channels < 3 else (image[..., 0] * 299 + image[..., 1] * 587 + image[..., 2] * 114) // 1000
    return width, height, grey.astype(np.uint8).tobytes()


def read_grey(spark: SparkSession, path: str) -> DataFrame:
    """(file, width, height, pixels) of the PNG images below a folder, each decoded where it is read."""

    def decode(batches):
        for b in batches:
            made = [grey_pixels(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([m[i] for m in made], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))]], ["file", "width", "height", "pixels"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(path)
    return files.select("path", "content").mapInArrow(decode, "file string, width int, height int, pixels binary")
