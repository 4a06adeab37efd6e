"""Readers and writers of JSON lines, JSON arrays, XML and markup, with ordinals and corrupt rows kept apart."""

from __future__ import annotations

import json
import warnings
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexmill.functions.text import clean, strip


def _ordinal() -> Column:
    """An order of lines: file, block in the file, place in the block."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")
    )


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(ord, raw) of the lines that aren't blank."""
    return spark.read.text(path).select(_ordinal().alias("ord"), F.col("value").alias("raw")).where(strip("raw") != "")


def json_lines(spark: SparkSession, path: str | list[str], schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """Good rows (ord, raw, row) and bad ones (ord, raw). Bad is what isn't a JSON object; the raw line
    tells an absent key from null and from a wrong type."""
    parsed = lines(spark, path).withColumn("kind", F.schema_of_variant(F.try_parse_json("raw")))
    good = F.coalesce(F.col("kind").startswith("OBJECT"), F.lit(False))
    return parsed.where(good).select("ord", "raw", F.from_json("raw", schema).alias("row")), parsed.where(~good).select("ord", "raw")


def json_lines_strict(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """Rows (ord, row); the query fails with the line if one isn't a JSON object."""
    parsed = lines(spark, path).withColumn("kind", F.schema_of_variant(F.try_parse_json("raw")))
    good = F.coalesce(F.col("kind").startswith("OBJECT"), F.lit(False))
    line = F.col("ord.line").bitwiseAND(F.lit(2**33 - 1)) + 1  # of the block that one task reads
    where = F.concat_ws(" ", F.lit("no JSON object in"), "ord.file", F.lit("from byte"), "ord.block", F.lit("line"), line)
    row = F.when(good, F.from_json("raw", schema)).otherwise(F.raise_error(F.concat(where, F.lit(": "), F.substring("raw", 1, 200))))
    return parsed.select("ord", row.alias("row"))


def json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Objects of a file that holds one JSON array; items that aren't objects are left out, and the
    query fails if a file holds anything else than an array."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))
    is_array = F.coalesce(F.schema_of_variant("v").startswith("ARRAY"), F.lit(False))
    items = F.when(is_array, F.try_variant_get("v", "$", "array<variant>")).otherwise(F.raise_error(F.concat(F.lit("no JSON array in "), "file")))
    objects = files.select(F.explode(items).alias("x")).where(F.schema_of_variant("x").startswith("OBJECT"))
    return objects.select(F.from_json(F.to_json("x"), schema).alias("row")).select("row.*")


def json_lines_of(spark: SparkSession, paths: list[str], schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """As json_lines, of those paths that exist, good rows with `split`, the name of their file; a missing path is warned of."""
    there = existing(spark, paths)
    for p in sorted({*paths} - {*there}):
        warnings.warn(f"missing: {p}", stacklevel=2)
    if not there:
        raise FileNotFoundError(", ".join(paths))
    good, bad = json_lines(spark, there, schema)
    return good.withColumn("split", F.regexp_extract("ord.file", r"([^/]+?)(?:\.[^./]*)?$", 1)), bad


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those paths that exist, in any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    there = lambda p: (q := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(q)
    return [p for p in paths if there(p)]


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    found = existing(spark, paths)
    if not found:
        raise FileNotFoundError(", ".join(paths))
    return found[0]


def position_slice(df: DataFrame, order: str, start: int, limit: int) -> DataFrame:
    """Rows start .. start + limit - 1 in an order."""
    return df.orderBy(order).offset(start).limit(limit)


def _texts(node: ET.Element | None) -> str:
    return " ".join("".join(node.itertext()).split()) if node is not None else ""


def xml_pairs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Question and answer pairs of all *.xml files below a folder, and the files that can't be parsed.

    (file, focus, source, url, question_id, question_type, question, answer, synonyms, semantic_types); pairs without
    a question or an answer are left out. Files are parsed whole, since mixed content keeps its order only there.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").text(path, wholetext=True)
    files = files.select(F.col("_metadata.file_path").alias("file"), "value")
    schema = (
        "file string, ok boolean, focus string, source string, url string, question_id string, question_type string, "
        "question string, answer string, synonyms array<string>, semantic_types array<string>"
    )

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["file", "ok", "focus", "source", "url", "question_id", "question_type", "question", "answer", "synonyms", "semantic_types"]
        for b in batches:
            rows: list[tuple] = []
            for file, text in zip(b["file"], b["value"], strict=True):
                try:
                    root = ET.fromstring(text)
                except ET.ParseError:
                    rows.append((file, False, *[None] * 9))
                    continue
                extra = [[_texts(x) for x in root.iter(tag) if _texts(x)] for tag in ("Synonym", "SemanticType")]
                for pair in root.iter("QAPair"):
                    q = pair.find("Question")
                    question, answer = _texts(q), _texts(pair.find("Answer"))
                    if question and answer:
                        rows.append((file, True, _texts(root.find("Focus")), root.get("source"), root.get("url"), q.get("qid"), q.get("qtype"), question, answer, *extra))
            yield pd.DataFrame(rows, columns=names)

    parsed = files.mapInPandas(parse, schema)
    return parsed.where("ok").drop("ok"), parsed.where("not ok").select("file")


def html_title(html: Column | str) -> Column:
    x = F.col(html) if isinstance(html, str) else html
    return clean(F.regexp_extract(x, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_text(html: Column | str) -> Column:
    """Text outside of scripts, styles, comments and tags, white space collapsed."""
    x = F.col(html) if isinstance(html, str) else html
    x = F.regexp_replace(x, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    return clean(F.regexp_replace(x, r"<[^>]*>", " "))


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """UTF-8 lines, null fields kept; mode errorifexists refuses to overwrite."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_once(df: DataFrame, path: str, force: bool = False) -> bool:
    """Write unless the path is there already; whether it wrote."""
    if not force and existing(df.sparkSession, [path]):
        return False
    write_json_lines(df, path)
    return True


def write_incrementally(df: DataFrame, path: str, key: str, batches: int) -> int:
    """JSON lines in batches dealt by the key's hash; batches that an earlier run finished are left out. How many it wrote."""
    wrote = 0
    for k in range(batches):
        part = f"{path}/batch={k}"
        if not existing(df.sparkSession, [f"{part}/_SUCCESS"]):
            write_json_lines(df.where(F.pmod(F.xxhash64(key), F.lit(batches)) == k), part)
            wrote += 1
    return wrote


def report(df: DataFrame, most_rows: int = 1000) -> str:
    """A small result as indented JSON; more rows are an error, not cut off."""
    rows = df.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"a report of more than {most_rows} rows")
    return json.dumps([r.asDict(True) for r in rows], indent=2, ensure_ascii=False, default=str)


def text_report(title: str, sections: dict[str, DataFrame], most_rows: int = 1000) -> str:
    """Ranked sections as plain text; a section of more rows is an error, not cut off."""
    out = [title, "=" * len(title)]
    for name, df in sections.items():
        out += ["", name, "-" * len(name)]
        rows = df.limit(most_rows + 1).collect()
        if len(rows) > most_rows:
            raise ValueError(f"{name}: more than {most_rows} rows")
        out += ["  ".join(str(v) for v in r) for r in rows]
    return "\n".join(out) + "\n"
