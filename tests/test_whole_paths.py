"""Pairs of whole path tables, beside those of g19_prefixes over short ones."""

import pytest

from entigraph.plans import catalog
from tests.compare import database

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["g19_all_prefixes", "g19_suffixes", "g19_subpaths"])
def test_paths_of_every_length(name):
    """The SQL's longest short path is as long as the longest conversation allows."""
    db = database(SF)
    turns = db.execute("select max(n) from (select count(*) as n from conversations group by conv_id)").fetchone()[0]
    sql = catalog.ORACLE_SQL[name]
    turn = "CAST(regexp_extract({}, '-([0-9]+)$', 1) AS BIGINT)"
    longest = db.execute(f"select max({turn.format('short_end')} - {turn.format('short_start')}) from ({sql})").fetchone()[0]
    assert longest == turns - 1 > 3
