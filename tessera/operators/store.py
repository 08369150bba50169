"""A document graph on disk that is maintained incrementally: documents go, and only what they touched is made again.

    folder/node_rows, folder/edge_rows   cached extraction rows, one for each mention, with the chunk they come from
    folder/nodes, folder/edges           the merged graph
    folder/chunks                        doc, chunk

All but ``chunks`` are dealt into folders ``bucket=...`` by the hash of their key (the entity, or the sorted pair of an
edge). A key's rows and its merged row have the same bucket, so a deletion reads and writes the buckets of the touched keys
only, however large the graph is.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import merge as M
from tessera.operators.graph import cut


@dataclass
class DocumentGraph:
    """The store in ``folder``. Columns of rows: node rows (entity, entity_type, description, source_id, ts, pos), edge
    rows (src, dst, weight, keywords, source_id); source_id is a chunk. Loops and rows with null keys aren't kept."""

    spark: SparkSession
    folder: str
    buckets: int = 64
    most: int = 300
    sep: str = "<SEP>"
    #: Keys and merge of each kind of rows.
    kinds: dict = field(init=False)

    def __post_init__(self):
        self.kinds = {
            "node": (["entity"], lambda rows: M.merge_nodes(rows, self.most, sep=self.sep)),
            "edge": (["src", "dst"], M.merge_edges),
        }

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._path(name))

    def _write(self, df: DataFrame, name: str, keys: list[str]) -> None:
        dealt = df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int"))
        # a bucket with many rows of one key is written by several tasks
        dealt = dealt.hint("rebalance", "bucket")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self._path(name))

    def build(self, node_rows: DataFrame, edge_rows: DataFrame, chunks: DataFrame) -> None:
        """A new store of extraction rows and of chunks (doc, chunk); one chunk may belong to several documents."""
        given = {"node": node_rows, "edge": M.sorted_pair(edge_rows)}
        for kind, (keys, merged) in self.kinds.items():
            self._write(given[kind].dropna(subset=keys), f"{kind}_rows", keys)
            self._write(merged(self.read(f"{kind}_rows").drop("bucket")), f"{kind}s", keys)
        chunks.select("doc", "chunk").distinct().write.mode("overwrite").parquet(self._path("chunks"))

    def gone(self, docs: DataFrame) -> DataFrame:
        """source_id: the chunks that no document has but those of ``docs`` (doc)."""
        marked = self.read("chunks").join(docs.select("doc").distinct().withColumn("__g", F.lit(1)), "doc", "left")
        counts = marked.groupBy("chunk").agg(F.count(F.when(F.col("__g").isNull(), 1)).alias("stay"), F.count("__g").alias("go"))
        return counts.where("stay = 0 and go > 0").select(F.col("chunk").alias("source_id"))

    def _touched(self, kind: str, gone: DataFrame) -> DataFrame:
        """The keys that have a row of a chunk that goes, with their bucket."""
        return self.read(f"{kind}_rows").join(gone, "source_id", "left_semi").select("bucket", *self.kinds[kind][0]).distinct()

    def delete(self, docs: DataFrame) -> dict[str, dict[str, int]]:
        """Takes the documents ``docs`` (doc) out. Keys that lose all their rows go, those that lose some are merged again from
        the cached rows that stay, all others keep what they have. Returns the number of keys deleted and rebuilt and of
        buckets written, by kind. It can be repeated after a failure: the chunks, which say what goes, are written last."""
        docs = cut(docs.select("doc").distinct())
        gone = cut(self.gone(docs))
        report = {}
        for kind, (keys, merged) in self.kinds.items():
            touched = cut(self._touched(kind, gone))
            buckets = [r["bucket"] for r in touched.select("bucket").distinct().collect()]  # as many as there are buckets at most
            here = F.col("bucket").isin(buckets)
            stay = cut(self.read(f"{kind}_rows").where(here).join(gone, "source_id", "left_anti"))
            again = stay.join(touched.select(*keys), keys, "left_semi").drop("bucket")
            rebuilt = cut(merged(again))
            kept = self.read(f"{kind}s").where(here).join(touched.select(*keys), keys, "left_anti").drop("bucket")
            whole = cut(kept.unionByName(rebuilt))
            self._replace(whole, f"{kind}s", keys, buckets)
            self._replace(stay.drop("bucket"), f"{kind}_rows", keys, buckets)
            n = rebuilt.count()
            report[kind] = {"deleted": touched.count() - n, "rebuilt": n, "buckets": len(buckets)}
        left = cut(self.read("chunks").join(docs, "doc", "left_anti"))
        left.write.mode("overwrite").parquet(self._path("chunks"))
        return report

    def _replace(self, rows: DataFrame, name: str, keys: list[str], buckets: list[int]) -> None:
        """The buckets get these rows; those that have none left go."""
        if not buckets:
            return
        self._write(rows, name, keys)
        filled = {r["bucket"] for r in rows.select(F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int").alias("bucket")).distinct().collect()}
        for bucket in set(buckets) - filled:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._path(name)}/bucket={bucket}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
