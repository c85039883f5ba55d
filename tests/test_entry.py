import duckdb
import pytest

import __spark_entry__ as entry
from tessella import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FAST = ["a5_upsert_merge", "b3_density", "b10_misses", "c16_codes_from_titles", "c25_triplets", "d5_retrieve_topk", "d12_quality", "e6_stride", "e11_split", "f3_final_topk", "h2_model_code", "i2_rate_window"]


def cell(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", FAST)
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = registry.queries()[name](spark, sf_dir)
    cursor = con.execute(registry.oracle_sql()[name])
    names = [x[0] for x in cursor.description]
    order = sorted(df.columns)
    assert order == sorted(names)
    want = sorted([str([cell(r[names.index(c)]) for c in order]) for r in cursor.fetchall()])
    assert sorted(str([cell(r[c]) for c in order]) for r in df.collect()) == want


def test_registry_is_whole():
    assert len(registry.queries()) > 110
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_returns_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_other_queries_stay_if_the_optional_part_cannot_be_imported(monkeypatch):
    load = entry.importlib.import_module

    def broken(name):
        if name == "tessella.llm.queries":
            raise ImportError("broken")
        return load(name)

    monkeypatch.setattr(entry.importlib, "import_module", broken)
    with pytest.warns(UserWarning, match="broken"):
        assert set(entry.queries()) == set(registry.queries())
    with pytest.warns(UserWarning, match="broken"):
        assert set(entry.oracle_sql()) == set(registry.oracle_sql())
