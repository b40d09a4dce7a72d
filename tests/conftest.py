import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from dossier.session import local_session

    return local_session(4, 4, **{"spark.sql.maxMetadataStringLength": "100000"})


@pytest.fixture(scope="session")
def sf():
    return SF


def profile(**parts):
    """A profile dict with every part, missing ones None."""
    from dossier import schema

    return {f.name: parts.get(f.name) for f in schema.PARSED_DATA}


@pytest.fixture(scope="session")
def make_profiles(spark):
    from pyspark.sql import types as T

    from dossier import schema

    shape = T.StructType([T.StructField("profile_id", T.StringType()), T.StructField("parsed_data", schema.PARSED_DATA)])

    def fill(value, dtype):
        if isinstance(dtype, T.StructType) and value is not None:
            return {f.name: fill(value.get(f.name), f.dataType) for f in dtype}
        if isinstance(dtype, T.ArrayType) and value is not None:
            return [fill(v, dtype.elementType) for v in value]
        return value

    def make(rows):
        return spark.createDataFrame([{"profile_id": k, "parsed_data": fill(v, schema.PARSED_DATA)} for k, v in rows.items()], shape)

    return make
