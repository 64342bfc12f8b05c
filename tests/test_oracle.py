"""Every named query with SQL gives the same rows, columns and types as that SQL."""

import pytest

from lendframe.plans import oracle, registry
from tests.compare import connect, differences

SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(registry.queries()) == set(SQL)


def test_audits_find_the_faults_and_guards_let_some_members_go(con):
    for name in ("check_domains_faulty", "check_unique_faulty", "check_references_faulty"):
        rows = con.execute(SQL[name]).fetchall()
        assert sum(1 for r in rows if r[-1]) >= 4, name
    for name in ("delete_members_settled_outcomes", "update_emails_outcomes"):
        accepted = {r[-2] for r in con.execute(SQL[name]).fetchall()}
        assert accepted == {True, False}, name


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, sf_dir, con, name):
    assert differences(spark, sf_dir, registry.queries()[name], SQL[name], con) == []
