import importlib.util


def test_registry_is_consistent():
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)


def test_entry_survives_without_the_llm_subpackage(monkeypatch):
    import __spark_entry__ as entry

    def gone(name):
        raise ModuleNotFoundError(name=name)

    monkeypatch.setattr(entry.importlib, "import_module", gone)
    assert entry._optional("memlake.llm.queries") is None
    assert importlib.util.find_spec("__spark_entry__")
