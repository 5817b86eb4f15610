"""Files as rows: binary scans with admission checks, text files, reading results of services, and engine hooks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGES = ["jpg", "jpeg", "png", "tiff", "tif", "bmp"]
#: The first bytes, as hex, by which a file's kind is known.
MAGIC = {"pdf": ["25504446"], "jpeg": ["FFD8FF"], "png": ["89504E47"], "tiff": ["49492A00", "4D4D002A"], "bmp": ["424D"]}
LEAST_BYTES, MOST_BYTES = 100, 50 * 1024 * 1024


def scan_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, kind (pdf, image, or null), modified and content of files; content is read only where used."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path.split(","))
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.when(ending == "pdf", "pdf").when(ending.isin(*IMAGES), "image")
    return files.select("path", "length", kind.alias("kind"), F.col("modificationTime").alias("modified"), "content")


def admission_problem(length: Column, kind: Column, content: Column) -> Column:
    """Why a file is refused, or null: size, ending, or first bytes."""
    head = F.hex(F.substring(content, 1, 4))
    known = reduce(lambda a, b: a | b, [head.startswith(m) for group in MAGIC.values() for m in group])
    is_pdf = head.startswith(MAGIC["pdf"][0])
    return F.when(length > MOST_BYTES, "file too large").when(length < LEAST_BYTES, "file too small").when(kind.isNull(), "unsupported type").when(~known | ((kind == "pdf") != is_pdf), "content does not match type")


def upload_problem(mime: Column, pages: Column, width: Column, height: Column, length: Column, most_pages: int = 100, most_side: int = 4096) -> Column:
    """Why an uploaded file is refused by its type, pages or pixels, or null; unknown pages and sizes are not judged."""
    allowed = mime.isin("application/pdf", "image/jpeg", "image/png", "image/tiff", "image/bmp")
    return F.when(~F.coalesce(allowed, F.lit(False)), "type not allowed").when(pages > most_pages, "too many pages").when(F.greatest(width, height) > most_side, "image too large").when(length > 10 * width * height, "more bytes than pixels allow")


def admitted(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted files, and refused ones with the problem."""
    checked = files.withColumn("problem", admission_problem(F.col("length"), F.col("kind"), F.col("content")))
    return checked.where("problem is null").drop("problem"), checked.where("problem is not null").select("path", "length", "problem")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path and text of whole files; readings of text have confidence 1."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.lit(1.0).alias("confidence"))


def directory_sizes(files: DataFrame) -> DataFrame:
    return files.groupBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("directory")).agg(F.sum("length").alias("bytes"))


def service_text(answer: Column) -> Column:
    """Text of a reading service's JSON answer: full_text, else its blocks, else predictions, one after the other."""
    kind = "struct<full_text:string,text_blocks:array<struct<text:string>>,result:array<struct<prediction:array<struct<ocr_text:string,score:double>>>>>"
    x = F.from_json(answer, kind)
    blocks = F.array_join(F.transform(x["text_blocks"], lambda b: b["text"]), "\n")
    found = F.flatten(F.transform(x["result"], lambda r: r["prediction"]))
    return F.coalesce(x["full_text"], blocks, F.array_join(F.transform(found, lambda p: p["ocr_text"]), "\n"), F.lit(""))


def service_confidence(answer: Column, otherwise: float = 0.85) -> Column:
    x = F.from_json(answer, "struct<result:array<struct<prediction:array<struct<score:double>>>>>")
    return F.coalesce(F.array_max(F.transform(F.flatten(F.transform(x["result"], lambda r: r["prediction"])), lambda p: p["score"])), F.lit(otherwise))


def result_text(result: Column) -> Column:
    """Text of a reader's VARIANT result: raw_text, else text_blocks (objects with text, or strings), else raw_output,
    else the members that are strings, by their names' order, without error and model_info; a plain string is the text."""
    blocks = F.transform(F.try_variant_get(result, "$.text_blocks", "array<variant>"), lambda b: F.coalesce(F.try_variant_get(b, "$.text", "string"), F.when(F.schema_of_variant(b) == "STRING", F.try_variant_get(b, "$", "string"))))
    members = F.map_entries(F.try_variant_get(result, "$", "map<string,variant>"))
    told = F.filter(members, lambda e: ~e["key"].isin("error", "model_info") & (F.schema_of_variant(e["value"]) == "STRING"))
    strings = F.filter(F.transform(told, lambda e: F.try_variant_get(e["value"], "$", "string")), lambda x: F.trim(x) != "")
    whole = F.when(F.schema_of_variant(result) == "STRING", F.try_variant_get(result, "$", "string"))
    return F.coalesce(F.try_variant_get(result, "$.raw_text", "string"), F.array_join(blocks, "\n"), F.try_variant_get(result, "$.raw_output", "string"), F.array_join(strings, "\n"), whole, F.lit(""))


def in_page_order(pages: DataFrame, readings: DataFrame) -> DataFrame:
    """One row for each of pages(doc_id, page_no), in order; pages without a reading have confidence 0 and an error."""
    every = pages.select("doc_id", "page_no").join(readings, ["doc_id", "page_no"], "left")
    missing = F.col("confidence").isNull()
    filled = {"text": F.coalesce("text", F.lit("")), "confidence": F.coalesce("confidence", F.lit(0.0)), "error": F.when(missing & F.col("error").isNull(), "no reading").otherwise(F.col("error"))}
    return every.withColumns(filled).orderBy("doc_id", "page_no")


def read_images(pages: DataFrame, engine: Callable[[], Callable[[bytes], tuple[str, float]]], model: str) -> DataFrame:
    """doc_id, page_no, text, confidence, model and error of pages(doc_id, page_no, content), by a pluggable engine.

    engine() loads a model once for each task and gives a function from bytes to text and confidence. A page that fails
    is kept with confidence 0 and its error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = engine()
        for batch in batches:
            rows = []
            for content in batch["content"]:
                try:
                    text, confidence = read(bytes(content))
                    rows.append((text, float(confidence), None))
                except Exception as e:  # kept as a row
                    rows.append(("", 0.0, f"{type(e).__name__}: {e}"))
            out = pd.DataFrame(rows, columns=["text", "confidence", "error"])
            yield pd.concat([batch[["doc_id", "page_no"]].reset_index(drop=True), out], axis=1).assign(model=model)

    return pages.select("doc_id", "page_no", "content").mapInPandas(run, "doc_id long, page_no int, text string, confidence double, error string, model string")


def rendered_pages(files: DataFrame, render: Callable[[bytes, int], Iterator[bytes]], dpi: int = 300, first: int = 1, last: int = 10_000) -> DataFrame:
    """path, page_no and content of the pages of documents, by a pluggable renderer; large documents spread by page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                for page, image in enumerate(render(bytes(content), dpi), 1):
                    if first <= page <= last:
                        yield pd.DataFrame({"path": [path], "page_no": [page], "content": [image]})

    return files.select("path", "content").mapInPandas(run, "path string, page_no int, content binary").repartition("path", "page_no")


def processed_images(pages: DataFrame, process: Callable[[bytes], bytes]) -> DataFrame:
    """pages with content mapped by a pluggable image function."""

    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda b: process(bytes(b)))

    return pages.withColumn("content", run("content"))


def reading_size(width: Column, height: Column, pages: Column) -> Column:
    """struct<width,height> that a reader gets: within 1024 x 1024 pixels, 800 x 800 beyond five pages, even numbers."""
    area = F.when(pages > 5, 800.0 * 800).otherwise(1024.0 * 1024)
    scale = F.least(F.lit(1.0), F.sqrt(area / (width * height)))
    even = [(F.floor(x * scale / 2) * 2).cast("int") for x in (width, height)]
    return F.struct(even[0].alias("width"), even[1].alias("height"))
