"""Text and JSON sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import first_match
from ..functions.text import matches


def smali_flags(spark: SparkSession, path: str) -> DataFrame:
    """(class_name, method, flag, status) of boolean getters in assembly text files."""
    return flags_of(spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name()), "value", "file")


def flags_of(files: DataFrame, text: str, name: str) -> DataFrame:
    """Flags that parameterless boolean methods name: UNIQUE when a flag occurs once in all files, else AMBIGUOUS.

    A file without a class header gives nothing; a flag twice in one method counts twice.
    """
    header = F.regexp_extract(text, r"(?m)^\.class[^\n]*?(L[^;\s]+;)", 1)
    blocks = F.regexp_extract_all(F.col(text), F.lit(r"(?ms)^(\.method[^\n]*?\(\)Z\s*$.*?)^\.end method"), F.lit(1))
    methods = files.select(F.col(name), header.alias("class_name"), F.explode(blocks).alias("_m")).where("class_name <> ''")
    flags = F.regexp_extract_all("_m", F.lit(r'const-string(?:/jumbo)? [vp]\d+, "([A-Za-z0-9]+__[A-Za-z0-9_]+)"'), F.lit(1))
    found = methods.select("class_name", F.regexp_extract("_m", r"(\S+)\(\)Z", 1).alias("method"), F.explode(flags).alias("flag"))
    counted = found.groupBy("flag").agg(F.count("*").alias("n"), F.min_by("class_name", F.struct("class_name", "method")).alias("class_name"), F.min_by("method", F.struct("class_name", "method")).alias("method"))
    return counted.select("flag", "class_name", "method", F.when(F.col("n") == 1, "UNIQUE").otherwise("AMBIGUOUS").alias("status"))


METHOD = "struct<dex:string,class_name:string,method_name:string,descriptor:string,return_type:string,parameter_types:array<string>,instruction_count:int,opcode_sha:string,is_clinit:boolean,fields:array<string>,calls:array<string>>"
INVENTORY = f"schemaVersion int, generated_at bigint, base_sha string, methods array<{METHOD}>, identifiers array<struct<key:string,namespace:string,value_type:string,compiled_default:string,confidence:string,editable:boolean,kind:string,getters:array<int>>>"


def inventory(spark: SparkSession, path: str, versions: tuple[int, int] = (2, 4)) -> DataFrame:
    """Identifiers of inventory documents, their getters looked up in the document's method table."""
    return inventory_rows(spark.read.schema(INVENTORY).json(path, multiLine=True), versions)


def inventory_rows(docs: DataFrame, versions: tuple[int, int] = (2, 4)) -> DataFrame:
    """``inventory`` of documents that are parsed already (columns of ``INVENTORY``)."""
    docs = docs.where(F.col("schemaVersion").between(*versions))
    rows = docs.select("base_sha", "generated_at", "methods", F.explode("identifiers").alias("i"))
    getters = F.transform(F.coalesce("i.getters", F.array().cast("array<int>")), lambda k: F.get("methods", k))
    return rows.select("base_sha", "generated_at", "i.key", "i.namespace", "i.value_type", "i.compiled_default", "i.confidence", F.coalesce("i.editable", F.lit(False)).alias("editable"), F.coalesce("i.kind", F.lit("UNKNOWN")).alias("kind"), getters.alias("getters"))


FIXTURE = "key string, namespace string, type string, compiledDefault string, confidence string, getters array<struct<dex:string,class:string,name:string,descriptor:string,returnType:string,parameters:array<string>,instructions:int,opcodeSha256:string,clinit:boolean,fields:array<string>,calls:array<string>>>"


def compatibility_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FIXTURE).json(path, multiLine=True)


def preferences(df: DataFrame, key: str, value: str, prefix: str) -> DataFrame:
    """A snapshot's string values under a prefix; (key, value as text, kind)."""
    return df.where(F.col(key).startswith(prefix) & (F.col("kind") == "string")).select(key, value)


def events(lines: DataFrame, prefix: str, text: str = "value") -> DataFrame:
    """(name, fields) of log lines ``prefix{json}``; others are left out."""
    body = F.substr(F.col(text), F.lit(len(prefix) + 1))
    fields = F.from_json(body, "map<string,string>")
    return lines.where(F.col(text).startswith(prefix)).withColumn("fields", fields).where("fields IS NOT NULL").withColumn("name", F.element_at("fields", "event"))


def event_line(prefix: str, fields: Column) -> Column:
    return F.concat(F.lit(prefix), F.to_json(fields))


def base64_payload(text: Column) -> Column:
    """Bytes of a plausible base64 text, standard or URL alphabet, padded or not; else null."""
    plausible = (F.length(text) >= 4) & (F.length(text) % 4 != 1) & matches(text, "[A-Za-z0-9+/_-]+={0,2}")
    standard = F.translate(F.regexp_replace(text, "=+$", ""), "-_", "+/")
    padded = F.rpad(standard, (F.ceil(F.length(standard) / 4) * 4).cast("int"), F.lit("="))
    return F.when(plausible, F.try_to_binary(padded, F.lit("base64")))


def config_like(key: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(key)
    return first_match([(low.contains(w), F.lit(True)) for w in words], F.lit(False))
