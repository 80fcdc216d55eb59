"""Some of the queries against their SQL on the smallest driver tables, where these are there."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
NAMES = ["scalar_rules", "label_and_token_rules", "staged_issues", "observation_issues", "offer_checks", "known_listing_bindings", "review_of_listings", "branch_probes", "groups_by_distance", "branch_product_feed", "publish_decisions", "matched_offers", "online_prices_page", "api_stores", "refreshed_listings"]


@pytest.fixture(scope="module")
def tables():
    if not os.path.isdir(SF):
        pytest.skip("no driver tables here")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6)
    return value.replace(tzinfo=None) if isinstance(value, datetime.datetime) else value


@pytest.mark.parametrize("name", NAMES)
def test_query_gives_what_its_sql_gives(spark, tables, name):
    import __spark_entry__ as e

    df = e.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = tables.execute(e.oracle_sql()[name])
    said = [c[0] for c in found.description]
    assert sorted(said) == columns
    want = sorted((tuple(plain(row[said.index(c)]) for c in columns) for row in found.fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr) == want
