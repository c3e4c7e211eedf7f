"""Detection over all documents meets pairs between sources, which the per-source forms leave out."""

import __spark_entry__ as entry
from tests.conftest import SMALL

QUERIES = entry.queries()


def test_links_between_sources(spark):
    rows = QUERIES["detect_one_job"](spark, SMALL).collect()
    assert {r.job_id for r in rows} == {"all"}
    source = lambda f: f.split("/")[0]
    between = [r for r in rows if source(r.file_a) != source(r.file_b)]
    own = QUERIES["detect"](spark, SMALL).collect()
    assert between and len(rows) > len(own)
    total = QUERIES["detect_totals_one_job"](spark, SMALL).collect()
    assert len(total) == 1
    parts = QUERIES["detect_totals"](spark, SMALL).collect()
    assert total[0].candidate_pairs > sum(r.candidate_pairs for r in parts)
    for c in ("type1_pairs", "type2_pairs", "type3_pairs"):
        assert total[0][c] >= sum(r[c] for r in parts)
    assert total[0].type3_pairs == sum(r.n_pairs for r in rows if r.clone_type == "Type-3")
