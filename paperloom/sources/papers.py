"""Stored papers: one JSON document each, with a backup; read tolerantly, and written as Parquet or JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as T

NOTE = "struct<id:string,page:int,text:string,color:string,note:string,paraIndex:int,timestamp:bigint>"
PARAGRAPH = "struct<id:int,type:string,cleanText:string,translation:string,sentenceTranslations:array<string>,cacheKey:string,visionLatex:string,modelLatex:string>"
QUESTION = "struct<id:string,page:int,selectedText:string,question:string,answer:string,model:string,at:bigint>"
FIELDS = {"annotations": f"array<{NOTE}>", "ai_qa": f"array<{QUESTION}>", "translations": "map<string,string>", "sentence_translations": "map<string,array<string>>", "page_archive": f"map<string,array<{PARAGRAPH}>>", "alignment": "map<string,struct<note:string,mode:string>>"}
NAMES = {"annotations": "annotations", "ai_qa": "aiQa", "translations": "translations", "sentence_translations": "sentenceTranslations", "page_archive": "pageArchive", "alignment": "alignment"}


def parsed(raw: Column) -> Column:
    """struct of FIELDS of a stored paper, null where the JSON is broken; fields of another shape are empty, lists of sentences with blank ones go."""
    v = F.try_parse_json(raw)
    some = {n: F.coalesce(F.try_variant_get(v, f"$.{NAMES[n]}", kind), (F.create_map() if kind.startswith("map") else F.array()).cast(kind)) for n, kind in FIELDS.items()}
    whole = lambda _, s: (F.size(s) > 0) & F.forall(s, lambda x: T.trimmed(F.coalesce(x, F.lit(""))) != "")
    some["sentence_translations"] = F.map_filter(some["sentence_translations"], whole)
    return F.when(v.isNotNull(), F.struct(*(c.alias(n) for n, c in some.items())))


def restored(stored: DataFrame) -> DataFrame:
    """stored: key, main, backup (JSON texts or null). key and FIELDS: of main; of the backup where main is missing or broken, and its annotations where main has none."""
    both = stored.select("key", parsed(F.col("main")).alias("m"), parsed(F.col("backup")).alias("b"))
    one = both.select("key", F.coalesce("m", "b").alias("p"), F.col("b.annotations").alias("spare")).filter("p is not null")
    notes = F.when((F.size("p.annotations") == 0) & (F.size("spare") > 0), F.col("spare")).otherwise(F.col("p.annotations"))
    return one.select("key", notes.alias("annotations"), *(F.col(f"p.{n}") for n in FIELDS if n != "annotations"))


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """The papers of a folder of paper_KEY.json files and their paper_KEY.bak.json."""
    files = spark.read.option("pathGlobFilter", "paper_*.json").text(folder, wholetext=True).select("value", F.regexp_extract(F.col("_metadata.file_name"), r"^paper_(.*?)(\.bak)?\.json$", 1).alias("key"), F.endswith(F.col("_metadata.file_name"), F.lit(".bak.json")).alias("spare"))
    both = files.groupBy("key").agg(F.max(F.when(~F.col("spare"), F.col("value"))).alias("main"), F.max(F.when(F.col("spare"), F.col("value"))).alias("backup"))
    return restored(both)


def write(papers: DataFrame, folder: str) -> None:
    """Papers (key and FIELDS) as JSON lines in folder/main, those with annotations also in folder/backup, which then can fill a lost or emptied main."""
    papers.write.mode("overwrite").json(f"{folder}/main")
    papers.filter("size(annotations) > 0").write.mode("overwrite").json(f"{folder}/backup")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """What `write` wrote."""
    schema = "key string, " + ", ".join(f"{n} {k}" for n, k in FIELDS.items())
    return spark.read.schema(schema).json(f"{folder}/main")


def binaries(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """path, name, size, modified and content of documents; without the column content only their metadata is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


ITEM = "struct<str:string,dir:string,width:double,height:double,transform:array<double>,fontName:string,hasEOL:boolean>"


def items(spark: SparkSession, path: str, fonts: DataFrame | None = None) -> DataFrame:
    """Text items of pages from JSON lines (paper_id, page, items): one row for each, with the font's real name from fonts (paper_id, font_key, font_name)."""
    rows = spark.read.schema(f"paper_id long, page int, items array<{ITEM}>").json(path)
    return placed_items(rows, fonts)


def placed_items(pages: DataFrame, fonts: DataFrame | None = None) -> DataFrame:
    rows = pages.select("paper_id", "page", F.posexplode("items").alias("item_idx", "i"))
    out = rows.select(
        "paper_id", "page", "item_idx", F.coalesce("i.str", F.lit("")).alias("str"), F.col("i.fontName").alias("font_key"), F.coalesce(F.get("i.transform", F.lit(4)), F.lit(0.0)).alias("x"), F.coalesce(F.get("i.transform", F.lit(5)), F.lit(0.0)).alias("y"),
        F.coalesce("i.width", F.lit(0.0)).alias("width"), F.coalesce(F.when(F.col("i.height") > 0, F.col("i.height")), F.hypot(F.get("i.transform", F.lit(2)), F.get("i.transform", F.lit(3)))).alias("height"),
        ((F.abs(F.get("i.transform", F.lit(1))) > 0.5) & (F.abs(F.get("i.transform", F.lit(0))) < 0.5)).alias("rotated"),
    )
    if fonts is None:
        return out.withColumn("font_name", F.col("font_key"))
    return out.join(fonts.select("paper_id", "font_key", "font_name"), ["paper_id", "font_key"], "left").withColumn("font_name", F.coalesce("font_name", "font_key"))
