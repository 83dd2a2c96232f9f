import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[4]").appName("tests")
         .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def make_files(spark):
    def make(repo: str, **by_path: str):
        rows = [(repo, p, bytearray(t.encode())) for p, t in by_path.items()]
        return spark.createDataFrame(rows, "repo string, path string, content binary")
    return make


GARDEN = '''
import functools


def water(x):
    return x + 1


def season():
    def spring():
        return water(1)
    return spring()


class Plant:
    """Something that grows."""

    def __init__(self, height, *, pot=None):
        self.leaves = []

    def grow(self):
        return water(2)


class Tomato(Plant):
    @functools.cache
    def ripen(self):
        return self.grow()

    def rest(self):
        return super().grow()

    def record(self, month):
        notes = {}
        return notes.setdefault("a", water(3))


def year():
    """Goes through the months, using water where needed."""
    return season()
'''


@pytest.fixture(scope="session")
def garden(make_files):
    from codeloom.operators.callgraph import analyze_files
    return analyze_files(make_files("plot", **{"garden.py": GARDEN}))
