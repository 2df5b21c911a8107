"""Readers and writers of the file formats that records come in. Schemas are fixed; a file that breaks one fails loudly."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from prooflake.operators.ingest import parse_wiki_lines
from prooflake.sources import json_arrays, schemas


def read_split(spark: SparkSession, folder: str, split: str, records: tuple[str, ...] = ()) -> DataFrame:
    """A split of an exported dataset, folder/split as Parquet, with `ordinal`, a row's number from 0 in source order: by file name, then by
    place in the file, both as the files themselves have it. Columns in `records` may hold structs of lists, as older exports do (lists_as_records)."""
    from pyspark.errors import AnalysisException

    path = f"{folder.rstrip('/')}/{split}"
    try:
        rows = spark.read.parquet(path)
    except AnalysisException as error:
        raise FileNotFoundError(f"no split {split} in {folder}") from error
    if "ordinal" in rows.columns:
        return lists_as_records(rows, *records) if records else rows
    placed = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = placed.groupBy("_file").agg((F.max("_row") + 1).alias("_n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    bases = sizes.select(F.col("_file").alias("_f"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    numbered = placed.join(bases, F.col("_file") == F.col("_f")).select(*rows.columns, (F.col("_base") + F.col("_row")).cast("long").alias("ordinal"))
    return lists_as_records(numbered, *records) if records else numbered


#: Columns that a raw source must have; exports of other versions of a dataset lack some.
REQUIRED = {
    "hotpotqa": ["question", "answer", "supporting_facts", "context"],
    "musique": ["question", "answer", "answerable", "paragraphs"],
    "fever": ["label", "claim", "evidence_wiki_url", "evidence_sentence_id"],
}


def checked(rows: DataFrame, source: str) -> DataFrame:
    """rows, if they have what the source's converter reads."""
    if missing := [c for c in REQUIRED.get(source, []) if c not in rows.columns]:
        raise ValueError(f"{source}: no column {', '.join(missing)}; another version of the dataset?")
    return rows


def read_sentences(spark: SparkSession, pages: str | None = None, dump: str | None = None, lookup: str | None = None) -> DataFrame:
    """Sentences from whichever source is given and there, tried in this order: a ready lookup, a table of pages (Parquet), a dump of
    JSON lines."""
    from pyspark.errors import AnalysisException

    tried = []
    for path, read in ((lookup, read_lookup), (pages, lambda s, p: parse_wiki_lines(s.read.parquet(p))), (dump, read_wiki_pages)):
        if path:
            try:
                return read(spark, path)
            except AnalysisException:
                tried.append(path)
    raise FileNotFoundError(f"no sentences in {tried or 'any given source'}")


def _as_records(value: Column, kind: DataType) -> tuple[Column, bool]:
    """(value with every struct of lists in it as a list of structs, whether there was one)."""
    if isinstance(kind, ArrayType):
        found = []

        def element(x: Column) -> Column:
            made, changed = _as_records(x, kind.elementType)
            found.append(changed)
            return made

        made = F.transform(value, element)
        return (made, True) if any(found) else (value, False)
    if isinstance(kind, MapType):
        found = []

        def entry(_: Column, x: Column) -> Column:
            made, changed = _as_records(x, kind.valueType)
            found.append(changed)
            return made

        made = F.transform_values(value, entry)
        return (made, True) if any(found) else (value, False)
    if not isinstance(kind, StructType) or not kind.fields:
        return value, False
    parts = {f.name: _as_records(value[f"`{f.name}`" if "." in f.name else f.name], f.dataType) for f in kind.fields}
    if all(isinstance(f.dataType, ArrayType) for f in kind.fields):
        # a list that is missing counts as empty; shorter ones are filled up with nulls
        lists = [_as_records(F.coalesce(value[f"`{f.name}`" if "." in f.name else f.name], F.array().cast(f.dataType)), f.dataType)[0] for f in kind.fields]
        # an alias in arrays_zip would name the fields, but a list may be any expression, so they go by number
        zipped = F.arrays_zip(*(F.slice(x, 1, F.size(x)) for x in lists))
        return F.when(value.isNotNull(), F.transform(zipped, lambda x: F.struct(*(x[str(k)].alias(f.name) for k, f in enumerate(kind.fields))))), True
    if not any(changed for _, changed in parts.values()):
        return value, False
    return F.when(value.isNotNull(), F.struct(*(c.alias(name) for name, (c, _) in parts.items()))), True


def lists_as_records(rows: DataFrame, *columns: str) -> DataFrame:
    """Older exports hold structs of parallel lists where newer ones hold lists of structs: the former as the latter, at any depth, in the given
    columns or in all. A walk over the schema; the rows see one projection."""
    made = {}
    for f in rows.schema.fields:
        if not columns or f.name in columns:
            value, changed = _as_records(F.col(f"`{f.name}`"), f.dataType)
            if changed:
                made[f.name] = value
    return rows.withColumns(made) if made else rows


def write_results(tables: dict[str, DataFrame], path: str) -> None:
    """Each table of an experiment's results as JSON lines in a folder of its name."""
    for name, rows in tables.items():
        write_json(rows, f"{path}/{name}")


def read_json_array(spark: SparkSession, path: str, schema: str = schemas.INSTANCE) -> DataFrame:
    """The objects of files that are one JSON array each, read in parallel (json_arrays). A record that doesn't fit the schema is an error."""
    return json_arrays.read(spark, path, schema)


def find_one(spark: SparkSession, folder: str, part: str, ending: str = ".json") -> str:
    """The one file in folder whose name has `part` and the ending; none or several are an error."""
    names = [r.path for r in spark.read.format("binaryFile").option("pathGlobFilter", f"*{part}*{ending}").load(folder).select("path").take(2)]
    if len(names) != 1:
        raise FileNotFoundError(f"{len(names) or 'no'} files like *{part}*{ending} in {folder}")
    return names[0]


def read_wiki_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences (page_id, sent_id, text) from wiki-*.jsonl files at any depth; broken lines are skipped."""
    pages = spark.read.schema(schemas.WIKI_PAGE).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).option("pathGlobFilter", "wiki-*.jsonl").json(folder)
    return parse_wiki_lines(pages)


class Lookup(NamedTuple):
    """Sentences (page_id, sent_id, text) and their different pages (page_id), each bucketed by its columns but the text."""

    sentences: DataFrame
    pages: DataFrame


_BUCKETED = {"sentences": ["page_id", "sent_id"], "pages": ["page_id"]}


def write_lookup(sentences: DataFrame, path: str, buckets: int = 64) -> None:
    """Sentences and pages in buckets of their keys' hash, one sorted file a bucket, so that the joins of a claim table with them read them
    in place: 25 million sentences are shuffled once, when they are written, and not for every claim table."""
    import json

    rows = sentences.select("page_id", "sent_id", "text")
    for name, table in (("sentences", rows), ("pages", rows.select("page_id").distinct())):
        keys = _BUCKETED[name]
        own = _name(f"{path}/{name}")
        spark = sentences.sparkSession
        spark.sql(f"DROP TABLE IF EXISTS {own}")
        # as many partitions as buckets, dealt by the same hash, so a bucket is one file
        writer = table.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
        writer.option("path", f"{path}/{name}").format("parquet").saveAsTable(own)
    meta = json.dumps({"buckets": buckets})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/lookup")


def _name(path: str) -> str:
    """A table name of its own for each path."""
    import hashlib

    return "prooflake_" + hashlib.md5(path.encode()).hexdigest()


def open_lookup(spark: SparkSession, path: str) -> Lookup:
    """A written lookup as bucketed tables. A session that didn't write it makes them known first."""
    import json

    buckets = json.loads(spark.read.text(f"{path}/lookup").first()[0])["buckets"]
    tables = {}
    for name, keys in _BUCKETED.items():
        own = _name(f"{path}/{name}")
        if not spark.catalog.tableExists(own):
            columns = "page_id STRING, sent_id INT, text STRING" if name == "sentences" else "page_id STRING"
            by = ", ".join(keys)
            spark.sql(f"CREATE TABLE {own} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}/{name}'")
        tables[name] = spark.table(own)
    return Lookup(**tables)


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    return open_lookup(spark, path).sentences


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines with nulls kept; non-ASCII text is written as it is."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_features_csv(rows: DataFrame, path: str) -> None:
    """example_id, dataset, label and the eight features with a header."""
    rows.select("example_id", "dataset", "evidence_state_label", "graph_features.*").write.mode("overwrite").option("header", True).csv(path)


def read_features_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = "example_id string, dataset string, evidence_state_label string, source_diversity int, text_resolution_rate double, avg_evidence_length double, min_evidence_length int, duplicate_rate double, document_overlap_rate double, entity_overlap double, evidence_count int"
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def save_normalizer(stats: DataFrame, path: str) -> None:
    stats.coalesce(1).write.mode("overwrite").parquet(path)


def load_normalizer(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def example_json(rows: DataFrame, ordinal: int, key: str, most: int = 5000) -> DataFrame:
    """One record as JSON text cut to `most` characters: the one at this place in key order. Each task keeps ordinal + 1 rows at most."""
    first = rows.orderBy(key).limit(ordinal + 1)
    return first.orderBy(F.desc(key)).limit(int(first.count() == ordinal + 1)).select(F.substring(F.to_json(F.struct(*rows.columns)), 1, most).alias("record"))
