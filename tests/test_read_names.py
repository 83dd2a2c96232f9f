"""Names of files are read without the texts of their definitions."""

from codeloom import session
from codeloom.functions import python_source
from codeloom.operators import reviews, symbols
from codeloom.plans import catalogue

from conftest import GARDEN

DIR = "/root/testdata/sf0.001"
FILES = {"src/a.py": GARDEN, "src/b/__init__.py": "def f(x):\n    self.y = 1\n", "src/b.py": "def f(z): pass\n",
         "bad.py": "def ok(a):\n    return 1\n\ndef broken(:\n", "web/s.ts": "export function go(m, n) { return m }\n",
         "empty.py": "x = 1\n"}


def test_names_agree_with_the_whole_reader():
    for path, body in FILES.items():
        if path.endswith(".py"):
            whole, names = (read(body.encode(), "m", path) for read in (python_source.read_python, python_source.read_names))
            assert names["attributes"] == whole["attributes"]
            assert names["defs"] == [{k: d[k] for k in ("qualname", "start_line", "end_line", "params", "pos")} for d in whole["defs"]]


def test_same_known_names_from_either_reader(make_files):
    files = make_files("r", **FILES)
    got = []
    for read in (symbols.parse_files, symbols.parse_names):
        parsed = read(files)
        sym = symbols.unique_symbols(symbols.definitions(parsed))
        got.append(sorted(map(tuple, reviews.known_names(sym, symbols.attribute_names(parsed)).collect())))
    assert got[0] == got[1] and ("r", "n") in got[0] and ("r", "ripen") in got[0] and ("r", "empty.py") not in got[0]


def test_known_names_keep_no_texts(spark):
    before = len(session._TABLES)
    catalogue.queries()["known_names"](spark, DIR)
    kept = [spark.read.parquet(p).schema.simpleString() for p in session._TABLES[before:]]
    assert kept and not any("source" in s or "calls" in s for s in kept)
