"""Table specs from YAML files, one document per table: `<domain>/<subdomain>/<table>.yml`."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import islice
from typing import Any
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierflow.plans.spec import LAYERS, SPEC_SCHEMA
from tierflow.session import configure

try:
    import yaml
except ImportError:  # only this source needs it
    yaml = None

LAYER_FIELDS = ["write_mode", "version", "description", "owner", "retention_policy"]
COLUMN_FIELDS = [
    "rename_from",
    "data_type",
    "is_primary_key",
    "is_nullable",
    "is_partition",
    "is_pii",
    "track_changes",
    "comment",
]


# Rows of a frame that a task hands on while it reads a document.
FRAME_ROWS = 10_000


class _Whole(Exception):
    """A document that has to be read as a whole."""


def _entries(stream: Any) -> Iterator[Any]:
    """The keys of the next mapping; whoever takes a key takes its value from the stream."""
    start = stream.get_event()
    if not isinstance(start, yaml.MappingStartEvent) or start.anchor:
        raise _Whole
    seen = set()
    while not stream.check_event(yaml.MappingEndEvent):
        event = stream.peek_event()
        merges = isinstance(event, yaml.ScalarEvent) and event.implicit[0] and event.value == "<<"
        key = None if merges else _value(stream)
        if merges or key in seen:
            raise _Whole
        seen.add(key)
        yield key
    stream.get_event()


def _value(stream: Any) -> Any:
    return stream.construct_document(stream.compose_node(None, None))


def _skipped(stream: Any) -> None:
    """Pass over a value. What it names, or takes from elsewhere, only the whole document tells."""
    depth = 0
    while True:
        event = stream.get_event()
        if isinstance(event, yaml.AliasEvent) or getattr(event, "anchor", None):
            raise _Whole
        depth += isinstance(event, yaml.CollectionStartEvent) - isinstance(event, yaml.CollectionEndEvent)
        if not depth:
            return


def _columns(text: str, document: dict, read: Callable[[Any], Any]) -> Iterator[tuple[str, int, str, Any]]:
    """(layer, position, name, column as `read`) one by one; `document` is given all that is not a column."""
    stream = _stream_class()(text)
    try:
        stream.get_event(), stream.get_event()
        for key in _entries(stream):
            if key != "layers":
                document[key] = _value(stream)
                continue
            document[key] = {}
            for layer in _entries(stream):
                document[key][layer] = declared = {}
                if not stream.check_event(yaml.MappingStartEvent):
                    if _value(stream):
                        raise _Whole
                    continue
                for name in _entries(stream):
                    if name != "schema":
                        declared[name] = _value(stream)
                        continue
                    for position, column in enumerate(_entries(stream), 1):
                        yield layer, position, column, read(stream)
        stream.get_event()
        if not stream.check_event(yaml.StreamEndEvent):
            raise _Whole
    finally:
        stream.dispose()


def _stream_class() -> type:
    """A loader that reads event by event, in C if PyYAML has that."""
    if not yaml.__with_libyaml__:
        return yaml.SafeLoader

    class Stream(yaml.cyaml.CParser, yaml.composer.Composer, yaml.constructor.SafeConstructor, yaml.resolver.Resolver):
        def __init__(self, text: str) -> None:
            yaml.cyaml.CParser.__init__(self, text)
            yaml.composer.Composer.__init__(self)
            yaml.constructor.SafeConstructor.__init__(self)
            yaml.resolver.Resolver.__init__(self)

    return Stream


def _whole_columns(document: dict) -> Iterator[tuple[str, int, str, Any]]:
    for layer in LAYERS:
        declared = document["layers"].get(layer) or {}
        for position, (name, column) in enumerate(declared.get("schema", {}).items(), 1):
            yield layer, position, name, column


def spec_rows(text: str, path: str) -> Iterator[dict]:
    """One row per layer and column of a spec document.

    The document is gone through twice, column by column, so that a table of very many columns takes the
    memory of its text: once for what stands beside the columns, then for the rows. One with anchors or
    repeated names among its columns is loaded as a whole.
    """
    document: dict = {}
    try:
        for _ in _columns(text, document, _skipped):
            pass
        columns = _columns(text, {}, _value)
    except (_Whole, yaml.YAMLError):
        document = yaml.safe_load(text)
        columns = _whole_columns(document)
    domain, subdomain = path.split("/")[-3:-1]
    layers = document["layers"]
    for layer, position, name, column in columns:
        if layer not in LAYERS:
            continue
        column = column or {}
        yield {
            "asset": document["name"],
            "domain": domain,
            "subdomain": subdomain,
            "layer": layer,
            **{f: layers[layer].get(f) for f in LAYER_FIELDS},
            "column_name": name,
            "ordinal_position": position,
            **{f: column.get(f) for f in COLUMN_FIELDS},
            "validations": json.dumps(column["validations"]) if "validations" in column else None,
        }


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = (row for text, path in zip(frame["value"], frame["path"]) for row in spec_rows(text, unquote(path)))
        while part := list(islice(rows, FRAME_ROWS)):
            yield pd.DataFrame(part, columns=SPEC_SCHEMA.names, dtype=object)


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    """All spec documents below `path` as rows (asset, layer, column); tasks parse the files."""
    if yaml is None:
        raise ImportError("Reading YAML specs needs PyYAML")
    files = (
        configure(spark)
        .read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.yml")
        .text(path, wholetext=True)
        .select("value", F.col("_metadata.file_path").alias("path"))
    )
    return files.mapInPandas(_parse, SPEC_SCHEMA)


def spec_documents(specs: DataFrame) -> DataFrame:
    """(domain, subdomain, asset, document): spec rows as documents that `read_specs` reads, JSON being YAML.

    An asset's columns meet in one row, as they do in its document; fields without a value are left out.
    """
    one = F.struct("ordinal_position", "column_name", F.struct(*COLUMN_FIELDS, "validations").alias("fields"))

    def entry(c: Column) -> Column:
        fields = [c["fields"][name].alias(name) for name in COLUMN_FIELDS]
        return F.struct(c["column_name"], F.struct(*fields, F.parse_json(c["fields"]["validations"]).alias("validations")))

    layers = specs.groupBy("asset", "domain", "subdomain", "layer").agg(
        *[F.any_value(c).alias(c) for c in LAYER_FIELDS], F.sort_array(F.collect_list(one)).alias("columns")
    )
    schema = F.map_from_entries(F.transform("columns", entry)).alias("schema")
    declared = layers.select("asset", "domain", "subdomain", "layer", F.struct(*LAYER_FIELDS, schema).alias("declared"))
    by_layer = F.map_from_entries(F.collect_list(F.struct("layer", "declared"))).alias("layers")
    assets = declared.groupBy("domain", "subdomain", "asset").agg(by_layer)
    return assets.select("domain", "subdomain", "asset", F.to_json(F.struct(F.col("asset").alias("name"), "layers")).alias("document"))


def write_specs(specs: DataFrame, path: str) -> None:
    """Spec rows as one document per asset, `<path>/<domain>/<subdomain>/<asset>.yml`."""
    spark, parts = specs.sparkSession, f"{path}-parts"
    place = ["domain", "subdomain", "asset"]
    spec_documents(specs).repartition(*place).write.partitionBy(*place).text(parts)
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(parts)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for file in system.globStatus(hadoop.Path(f"{parts}/domain=*/subdomain=*/asset=*/*.txt")):
        domain, subdomain, asset = [folder.split("=", 1)[1] for folder in file.getPath().toString().split("/")[-4:-1]]
        folder = hadoop.Path(f"{path}/{domain}/{subdomain}")
        system.mkdirs(folder)
        system.rename(file.getPath(), hadoop.Path(folder, f"{asset}.yml"))
    system.delete(root, True)
