"""The driver's entry works with and without the subpackage for training corpora."""

import sys

import __spark_entry__ as entry
from pagelode.plans import registry


def test_without_llm(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("pagelode.llm")] + ["pagelode.llm"]:
        monkeypatch.setitem(sys.modules, name, None)
    assert set(entry.queries()) == set(registry.queries()) and set(entry.oracle_sql()) == set(registry.oracle_sql())


def test_flagship(spark, sf_dir):
    rows = registry.flagship(spark, sf_dir).collect()
    counts = [r.match_count for r in rows]
    assert rows and counts == sorted(counts, reverse=True)


def test_other_errors_are_raised(monkeypatch):
    import builtins

    real = builtins.__import__

    def broken(name, *args, **kw):
        if name == "pagelode.llm" or (args and args[2] and name.endswith("llm")):
            raise ModuleNotFoundError("no module", name="numpy_missing")
        return real(name, *args, **kw)

    monkeypatch.setattr(builtins, "__import__", broken)
    try:
        entry.queries()
    except ModuleNotFoundError as e:
        assert e.name == "numpy_missing"
    else:
        raise AssertionError("the error was swallowed")
