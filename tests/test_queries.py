"""Every query against its SQL, and the shape of the results that SQL can't say."""

import pytest
from oracle import compare

from prooflake.plans import ORACLE, QUERIES
from prooflake.plans.certificates import FIXED


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equal_to_sql(spark, sf, name):
    n, odd = compare(QUERIES[name](spark, sf), ORACLE[name], sf)
    assert not odd


def rows(spark, sf, name):
    return FIXED[name](spark, sf).collect()


def test_seed_proofs(spark, sf):
    got = rows(spark, sf, "gold_verify")
    assert len(got) == 23 and all(r.verdict == 100 and r.open_hyps == 0 for r in got)
    got = {r.label: r for r in rows(spark, sf, "seeds")}
    assert sum(r.ood_label for r in got.values()) == 10 and sum(r.ood_shape for r in got.values()) == 9
    assert got["disj_imp_self"].ood_label and not got["disj_imp_self"].ood_shape
    assert got["conj_swap"].shape == "ASSUME-CONJUNCT1-CONJUNCT2-CONJ-DISCH"
    assert sum(r.depth for r in got.values()) == len(rows(spark, sf, "prefix_theorems"))


def test_grammar(spark, sf):
    for r in rows(spark, sf, "grammar_accept"):
        assert r.accepted != r.cert_id.endswith("/half") and r.n_allowed >= 1


def test_generated(spark, sf):
    corpus = rows(spark, sf, "curated_corpus")
    assert len(corpus) == 7800 and len({r.shape for r in corpus}) == 20 and all(r.shape_from_tokens and r.length <= 320 for r in corpus)
    walks = rows(spark, sf, "gen_walks")
    assert len(walks) >= 380 and all(r.verdict == 100 for r in walks) and len({r.shape for r in walks}) >= 50
    variants = rows(spark, sf, "gen_variants")
    assert len(variants) == 69 and all(r.verdict == 100 for r in variants)


def test_buffer_and_documents(spark, sf):
    got = rows(spark, sf, "buffer_scan")
    assert len(got) == 23 and {(r.source, r.discovered_round) for r in got} == {("corpus", 0)}
    assert {r.shape for r in got} == {r.shape for r in rows(spark, sf, "seeds")}
    assert len(rows(spark, sf, "proof_trace")) == 23


def test_every_query_reads_a_table(spark, sf, tmp_path):
    for name, f in QUERIES.items():
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            f(spark, str(tmp_path)).collect()
            raise AssertionError(name)


def test_walks_do_not_depend_on_partitions(spark):
    from prooflake.operators import verify

    a = {tuple(r.cert_toks) for r in verify.generate(spark, 40, 5).collect()}
    b = {tuple(r.cert_toks) for r in verify.generate(spark, 40, 5).repartition(3).collect()}
    assert a == b


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
