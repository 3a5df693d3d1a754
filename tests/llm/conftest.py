"""Fixtures of the pipeline operators."""

import pytest

CLASHING = "key string, content string, doc string, start string, size string, place string, component string, n string"


@pytest.fixture
def table(spark):
    """A frame with extra columns whose names the operators use inside."""
    def make(data, schema, parts=3):
        extra = [c.split()[0] for c in CLASHING.split(", ") if c.split()[0] not in [x.split()[0] for x in schema.split(", ")]]
        rows = [tuple(r) + ("x",) * len(extra) for r in data]
        return spark.createDataFrame(rows, schema + "".join(f", {c} string" for c in extra)).repartition(parts)
    return make
