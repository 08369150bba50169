"""File formats of the graph data sets: id maps, triples, temporal quads, JSON lists. Readers keep nothing on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.graph import cut

#: What stands for an unknown begin and end year.
FIRST_YEAR, LAST_YEAR = -500, 3000


def _parts(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.text(path).select(F.split(F.trim("value"), pattern).alias("p"))


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    """name, id. The count line and lines that are not ``name<TAB>id`` are left out."""
    p = _parts(spark, path, "\t").where(F.size("p") == 2)
    return p.select(F.col("p")[0].alias("name"), F.col("p")[1].try_cast("long").alias("id")).where("id is not null")


def read_triple2id(spark: SparkSession, path: str) -> DataFrame:
    """h, t, r. The count line and lines of another arity are left out."""
    p = _parts(spark, path, r"\s+").where(F.size("p") == 3)
    return p.select(*[F.col("p")[i].try_cast("long").alias(c) for i, c in enumerate(("h", "t", "r"))]).dropna()


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """value and a number that rises along the lines of each file, though tasks read parts of a file."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    return lines.withColumn("at", F.struct("file_path", "file_block_start", F.monotonically_increasing_id())).select("value", "at")


def read_type_constraints(spark: SparkSession, path: str) -> DataFrame:
    """r, side, id: of each relation the first line has the heads, the second one the tails. A line is ``r, n, ids``; the
    count line and lines with less than two fields are left out, as are ids over n and what isn't a number."""
    p = _numbered(spark, path).select(F.split(F.trim("value"), r"\s+").alias("p"), "at").where(F.size("p") > 1)
    lines = p.select(F.col("p")[0].try_cast("long").alias("r"), F.slice("p", F.lit(3), F.greatest(F.lit(0), F.coalesce(F.col("p")[1].try_cast("int"), F.lit(0)))).alias("ids"), "at")
    order = F.row_number().over(Window.partitionBy("r").orderBy("at"))  # two lines a relation
    sides = lines.where("r is not null").withColumn("k", order).where("k <= 2")
    ids = sides.select("r", F.when(F.col("k") == 1, "head").otherwise("tail").alias("side"), F.explode("ids").alias("id"))
    return ids.select("r", "side", F.col("id").try_cast("long").alias("id")).where("id is not null")


def read_json_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_tsv_quads(spark: SparkSession, path: str, start: str, days: int = 1) -> DataFrame:
    """h, r, t, step: the number of whole periods of ``days`` since ``start``."""
    q = spark.read.schema("h string, r string, t string, d string").csv(path, sep="\t")
    return q.select("h", "r", "t", F.floor(F.datediff(F.try_to_date("d", "yyyy-MM-dd"), F.lit(start).cast("date")) / days).cast("long").alias("step")).where("step is not null")


def partial_year(c, unknown: int):
    """``####`` is unknown, any other ``#`` counts as 0; years may be negative."""
    year = F.regexp_extract(c, r"^(-?[\d#]+)", 1)
    return F.when(year.startswith("####"), unknown).otherwise(F.regexp_replace(year, "#", "0").try_cast("int"))


def read_interval_quads(spark: SparkSession, path: str) -> DataFrame:
    """h, r, t, begin, end (years)."""
    q = spark.read.schema("h string, r string, t string, b string, e string").csv(path, sep="\t")
    return q.select("h", "r", "t", partial_year(F.col("b"), FIRST_YEAR).alias("begin"), partial_year(F.col("e"), LAST_YEAR).alias("end"))


def dense_ids(df: DataFrame, name: str, buckets: int = 256) -> DataFrame:
    """name, id: 0, 1, ... in the order of the names, without sorting all of them in one task. The range of a name is
    found from a sample of the names; only the size of each range is summed up in one place."""
    names = df.select(F.col(name).alias("name")).where("name is not null").distinct()
    ranged = cut(names.repartitionByRange(buckets, "name").withColumn("part", F.spark_partition_id()))  # read twice
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    base = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    at = F.row_number().over(Window.partitionBy("part").orderBy("name")) - 1
    return ranged.withColumn("at", at).join(F.broadcast(base), "part").select("name", (F.col("base") + F.col("at")).alias("id"))


def write_lines(df: DataFrame, line, path: str) -> None:
    """One column of text; the count is a file of its own beside the lines, so that writing stays distributed."""
    df.select(line.alias("value")).write.mode("overwrite").text(f"{path}/lines")
    df.agg(F.count(F.lit(1)).cast("string").alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/count")


def write_id_map(ids: DataFrame, path: str) -> None:
    write_lines(ids, F.concat_ws("\t", "name", F.col("id").cast("string")), path)


def write_triple2id(triples: DataFrame, path: str) -> None:
    write_lines(triples, F.concat_ws(" ", *[F.col(c).cast("string") for c in ("h", "t", "r")]), path)


def type_constraints(triples: DataFrame) -> DataFrame:
    """r, side, n, ids: the distinct heads and tails of each relation, as rows of ids by side (no array of all ids)."""
    heads = triples.select("r", F.lit("head").alias("side"), F.col("h").alias("id"))
    return heads.unionByName(triples.select("r", F.lit("tail").alias("side"), F.col("t").alias("id"))).distinct()


def write_table(df: DataFrame, path: str, kind: str = "parquet", marked: bool = False) -> None:
    """json, csv (with a header) or parquet. ``marked`` begins each file of a csv with the byte order mark, by which
    spreadsheets know UTF-8: it stands before the first name of the header."""
    w = df.write.mode("overwrite")
    if kind == "csv":
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0]) if marked else df
        w = df.write.mode("overwrite").option("header", True)
    w.format(kind).save(path)


def export_markdown(df: DataFrame) -> DataFrame:
    """value: one row of a bar-separated table for each row."""
    cells = [F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"[|\n\r]", " "), F.lit("")) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def read_extractions(spark: SparkSession, path: str) -> DataFrame:
    """idx, passage, entities, triples: cached extraction results, a row for each chunk, of a file ``{"docs": [...]}``."""
    doc = "struct<idx:string,passage:string,extracted_entities:array<string>,extracted_triples:array<array<string>>>"
    docs = spark.read.schema(f"docs array<{doc}>").option("multiLine", True).json(path).select(F.inline("docs"))
    return docs.withColumnsRenamed({"extracted_entities": "entities", "extracted_triples": "triples"})


def pending(chunks: DataFrame, done: DataFrame, text: str = "content", prefix: str = "chunk-") -> DataFrame:
    """idx and all columns of the chunks whose digest isn't among ``done``."""
    return chunks.withColumn("idx", F.concat(F.lit(prefix), F.md5(text))).join(done.select("idx"), "idx", "left_anti")


def new_embeddings(store: DataFrame | None, rows: DataFrame, prefix: str) -> DataFrame:
    """hash_id, content, embedding of the rows (content, embedding) that the store doesn't have, one row a content (the
    least embedding of several). Append them to the store's folder."""
    once = rows.where("content is not null").groupBy("content").agg(F.min("embedding").alias("embedding"))
    once = once.select(F.concat(F.lit(prefix), F.md5("content")).alias("hash_id"), "content", "embedding")
    return once if store is None else once.join(store.select("hash_id"), "hash_id", "left_anti")


def _write_plain(df: DataFrame, path: str, *columns: str) -> None:
    df.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in columns]).alias("value")).write.mode("overwrite").text(path)


def ascii_text(c, otherwise):
    """Words of ASCII characters with single spaces between, any other character counts as a space; ``otherwise`` if empty."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\x00-\x7F]", " "), r"\s+", " "))
    return F.when(bare == "", otherwise).otherwise(bare)


def write_type_constraints(triples: DataFrame, path: str) -> None:
    """A line of ``r, n, ids`` for the heads of a relation and one for its tails, ids in their order. The format has all
    ids of a relation in a line, so a line must fit into memory; ``type_constraints`` has them as rows."""
    sides = type_constraints(triples).groupBy("r", "side").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    line = F.concat_ws("\t", F.col("r").cast("string"), F.size("ids").cast("string"), F.array_join(F.col("ids").cast("array<string>"), "\t"))
    sides.orderBy("r", "side").select(line.alias("value")).write.mode("overwrite").text(f"{path}/lines")
    sides.agg(F.count_distinct("r").cast("string").alias("value")).write.mode("overwrite").text(f"{path}/count")


def write_text_triples(splits: dict[str, DataFrame], entities: DataFrame, relations: DataFrame, path: str) -> None:
    """For models that read texts: ``h<TAB>r<TAB>t`` of the names for each split, the names, and ``name<TAB>text`` of
    entities and relations (name, text), in ASCII; an empty text becomes the word for its kind and the name."""
    for split, triples in splits.items():
        _write_plain(triples, f"{path}/{split}", "h", "r", "t")
    for kind, one, named in (("entities", "entity", entities), ("relations", "relation", relations)):
        _write_plain(named, f"{path}/{kind}", "name")
        texts = named.select("name", ascii_text(F.col("text"), F.concat(F.lit(f"{one} "), "name")).alias("text"))
        _write_plain(texts, f"{path}/{one}2text", "name", "text")


def write_quads(splits: dict[str, DataFrame], entities: DataFrame, relations: DataFrame, path: str) -> None:
    """For temporal models: ``h<TAB>r<TAB>t<TAB>d`` of the names and the date for each split, and the id maps (name, id)
    without a count line."""
    for split, quads in splits.items():
        _write_plain(quads, f"{path}/{split}", "h", "r", "t", "d")
    for one, ids in (("entity", entities), ("relation", relations)):
        _write_plain(ids, f"{path}/{one}2id", "name", "id")
