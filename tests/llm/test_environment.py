"""Corpus queries in a plain local session, and over executors in other processes."""

from tests.test_environment import pytestmark, run  # noqa: F401

SCRATCH = ["op1_minhash", "op2_toxicity", "op3_quality_rules", "op5_packing", "op7_substring_dedup", "op9_token_ids", "op10_chat"]


def test_plain_local_session(tmp_path):
    got = run(tmp_path, "local[4]", SCRATCH)
    assert set(got) == set(SCRATCH) and {got[n] for n in SCRATCH if n not in ("op5_packing", "op10_chat")} == {200}


def test_executors_elsewhere(tmp_path):
    got = run(tmp_path, "local-cluster[2,1,1024]", ["op3_quality_rules", "op8_pieces"], {"spark.checkpoint.dir": f"file://{tmp_path}/shared", "spark.executor.memory": "1g"})
    assert got == {"op3_quality_rules": 200, "op8_pieces": 200}
