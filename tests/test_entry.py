import __spark_entry__ as entry


def test_every_statement_has_its_query():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 60


def test_the_rest_stands_without_the_subpackage(monkeypatch):
    import builtins

    real = builtins.__import__

    def without(name, *args, **kwargs):
        if name.startswith("riwaya.llm") or (name == "riwaya" and "llm" in (args[2] or ())):
            raise ImportError(name)
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", without)
    assert not [k for k in entry.queries() if k.startswith("p1_")]
    assert entry.queries() and entry.oracle_sql()
