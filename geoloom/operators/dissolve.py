"""Unions of polygons by group, as a tree: by grid cells of growing size, then by key."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from geoloom.functions import shapes
from geoloom.kernels import planar as P
from geoloom.kernels import predicates as Q

#: Merged polygons that a task gives on at once.
ROWS = 256


def dissolved(features: DataFrame, key: str, size: float = 5.0, remove_unknown: bool = False, levels: int = 4) -> DataFrame:
    """(key, geometry): the union of the polygons of each key; a missing key is a group of its own unless removed.

    Members are first merged in the grid cell of their first vertex, then in cells
    of twice the size, and so on, so that a large group is spread over tasks and
    only its merged parts meet in one: cells count from the world's corner.
    """
    own = features.where(F.col(key).isNotNull()) if remove_unknown else features
    first = F.try_variant_get(F.try_parse_json("geometry"), "$.coordinates[0][0]", "array<double>")
    kind = features.schema[key].dataType.simpleString()
    keyed = own.select(key, "geometry", F.floor((first[0] + 540) / size).cast("long").alias("cx"), F.floor((first[1] + 90) / size).cast("long").alias("cy"))

    def merged(members: list[str | None], united: bool) -> str | None:
        known = [t for t in members if t is not None]
        if united and len(known) == 1:
            return known[0]
        return shapes.multi(P.union_all([q for t in known for q in Q.parts(json.loads(t))[2]], united))

    def merger(united: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Groups come one after the other, each whole in its partition; a group costs its union and no table of its own."""
            group, members, done = None, [], []

            def out() -> pa.RecordBatch:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*done), arrow)]
                done.clear()
                return pa.RecordBatch.from_arrays(columns, schema=arrow)

            for batch in batches:
                for *own, text in zip(*(c.to_pylist() for c in batch.columns)):
                    if own != group:
                        if members:
                            done.append((*group, merged(members, united)))
                        group, members = own, []
                        if len(done) == ROWS:
                            yield out()
                    members.append(text)
            if members:
                done.append((*group, merged(members, united)))
            if done:
                yield out()

        return run

    schema = f"`{key}` {kind}, cx long, cy long, geometry string"
    arrow = to_arrow_schema(features.sparkSession.createDataFrame([], schema).schema)

    # The work is in the kernels, not in bytes, so small groups are dealt to as many tasks as there are cores for.
    tasks = 4 * features.sparkSession.sparkContext.defaultParallelism

    def united(rows: DataFrame, level: int) -> DataFrame:
        rows = rows.select(key, "cx", "cy", "geometry").repartition(tasks, key, "cx", "cy").sortWithinPartitions(key, "cx", "cy")
        return rows.mapInArrow(merger(level > 0), schema)

    for level in range(levels):
        keyed = united(keyed, level).select(key, "geometry", F.expr("cx div 2").alias("cx"), F.expr("cy div 2").alias("cy"))
    return united(keyed.select(key, "geometry", F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy")), levels).select(key, "geometry")
