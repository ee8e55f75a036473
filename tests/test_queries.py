"""Every registered query: against its SQL where there is one, else that it runs."""

import pytest
from oracle import differences

from graphlex import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_its_sql(spark, con, sf_dir, name):
    assert differences(spark, con, catalog.QUERIES[name], catalog.ORACLE_SQL[name], sf_dir) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_roundtrips_are_lossless(spark, sf_dir):
    out = catalog.QUERIES["roundtrip_modes"](spark, sf_dir).toPandas()
    assert set(out["mode"]) == {"original", "compact", "entropy", "motif_macro", "motif_entropy", "motif_hybrid"}
    assert (out.lossless_expand_match == 1).all() and (out.bits > 0).all()
    assert (out[out["mode"] == "compact"].token_count <= out[out["mode"] == "compact"].original_token_count).all()


def test_graphs_come_back(spark, sf_dir):
    out = catalog.QUERIES["reconstruction"](spark, sf_dir).toPandas()
    assert (out.strict_exact_reconstruction == 1).all() and (out.edge_f1 == 1).all() and (out.spectrum_distance < 1e-6).all()
    back = catalog.QUERIES["decoded_fidelity"](spark, sf_dir).toPandas()
    assert back.same_counts.all() and back.same_degree_sequence.all() and back.wl_match.all() and (back.component_error == 0).all()
    assert (catalog.QUERIES["executability"](spark, sf_dir).toPandas().executable == 1).all()


def test_entry():
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
