"""Queries against their SQL on rows that the smallest tables do not hold."""

import duckdb
import pytest
from test_queries import QUERIES, TABLES, TWINS, canonical


def both(spark, folder, name):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, str(folder))
    rows = [tuple(r) for r in df.collect()]
    cur = c.execute(TWINS[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    return canonical(rows, df.columns), canonical(cur.fetchall(), names)


def copied(sf, folder, **made):
    """The smallest tables, those named as given instead."""
    c = duckdb.connect()
    for t in TABLES:
        if t in made:
            c.execute(f"COPY ({made[t].format(t=f'{sf}/{t}.parquet')}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        else:
            (folder / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
    return folder


@pytest.fixture(scope="module")
def long_keys(sf, tmp_path_factory):
    """Parts and lines three times, with keys of up to seven digits, of which some begin alike."""
    more = "SELECT * REPLACE ({}) FROM '{{t}}', (SELECT unnest([0, 100000, 1000000]) AS more)"
    return copied(
        sf,
        tmp_path_factory.mktemp("keys"),
        part=f"SELECT * EXCLUDE (more) FROM ({more.format('p_partkey + more AS p_partkey')})",
        lineitem=f"SELECT * EXCLUDE (more) FROM ({more.format('l_partkey + more AS l_partkey, l_orderkey + more AS l_orderkey')})",
    )


@pytest.mark.parametrize("name", ["ex14_citation_filter", "ex15_pin_validation", "ex8_pins", "jn10_alternate_names", "kg1_best_value", "kg5_checked_merge", "kg6_suspicion", "kg8_completeness", "sc8_nested_chips", "ex1_cascade"])
def test_keys_of_seven_digits_stay_apart(spark, long_keys, name):
    ours, theirs = both(spark, long_keys, name)
    assert ours == theirs


def test_each_part_is_a_chip_of_its_own(spark, long_keys):
    from sheetmill.plans import fixtures

    chips = fixtures.read(spark, str(long_keys), "fx_chips")
    assert chips.select("chip_id").distinct().count() == chips.count() == spark.read.parquet(f"{long_keys}/part.parquet").count()


def test_components_of_texts_that_have_some(spark, sf, tmp_path):
    parts = " ".join(f"AB{k}" for k in range(10, 17)) + " LM358 LM741 NE5532 NE555 TL072 10kΩ 4Ω 22Ω 5Ω 9Ω 100nF 10uF"
    folder = copied(sf, tmp_path, documents=f"SELECT * REPLACE (CASE doc_id % 3 WHEN 0 THEN '{parts}' WHEN 1 THEN 'an LM358 with 10kΩ, AB12 and AB12' ELSE text END AS text) FROM '{{t}}'")
    ours, theirs = both(spark, folder, "tx9_components")
    assert ours == theirs and any("LM358" in c for c, _ in ours)


def test_every_pair_of_query_and_figure_has_a_relevance(spark, sf):
    from sheetmill.plans.fixtures import read

    queries, figures = read(spark, sf, "fx_figure_queries"), read(spark, sf, "fx_figures")
    out = QUERIES["rt17_figure_relevance"](spark, sf)
    assert out.count() == queries.count() * figures.count() == out.where("query_id is not null").distinct().count()
