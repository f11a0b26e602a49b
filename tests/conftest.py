import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))
# Workers import nothing from here; the driver alone needs the path.
os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from termwise.session import local_session

    session = local_session(4, "termwise-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Sorted tuples of a frame's rows."""

    def read(df):
        return sorted((tuple(r) for r in df.collect()), key=repr)

    return read


@pytest.fixture
def enrollment(spark):
    """Typed enrollment from ``(student, term, state, regstat)`` and overrides."""
    from termwise.plans.staging import typed_enrollment
    from termwise.sources.landing import STAGED_SCHEMA

    base = dict(u_g="U", gender="Female", school="EN", degtype="BS", firstgen="Y", pell="Y", ethnicmultirace="1",
                citizen="1", creditenr="12", year_field=None, semester=None, accumgpa="3.00")

    def make(records):
        out = []
        for student, term, state, regstat, *extra in records:
            row = dict(base, student_id=student, term_code=term, academic_state=state, regstat=regstat)
            row.update(extra[0] if extra else {})
            out.append([row[n] for n in STAGED_SCHEMA.names])
        return typed_enrollment(spark.createDataFrame(out, STAGED_SCHEMA))

    return make
