"""Stages of a study, evaluation records and orientation of matrices."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.operators import profile
from arbora.plans import evaluation, stages, workflow
from arbora.plans.search import Config


@pytest.fixture(scope="module")
def data(spark):
    draw = random.Random(3)
    rows = []
    for i in range(240):
        a = draw.randrange(2)
        rows.append((i, a, a if draw.random() < 0.9 else 1 - a, draw.randrange(2), "x" if i % 3 else "y"))
    return spark.createDataFrame(rows, "id long, a int, b int, c int, grp string")


def plan(**more):
    return stages.network_stages(["a", "b", "c"], ["id"], Config(tabu_tenure=0, assoc_rows=0), replicates=4, group="grp", **more)


def test_a_study_goes_on_where_it_stopped(spark, data, tmp_path):
    study = stages.Study(spark, f"file://{tmp_path}/s")
    study.put("data", data)
    first = study.run(plan()[:4])  # stopped after the consensus
    assert first == dict.fromkeys(["learn", "importance", "bootstrap", "consensus"], "done")
    again = stages.Study(spark, f"file://{tmp_path}/s")
    got = again.run(plan(), skip=["groups"])
    assert got == {"learn": "kept", "importance": "kept", "bootstrap": "kept", "consensus": "kept", "consensus_importance": "done", "groups": "skipped", "consensus_groups": "done"}
    assert again.read("consensus_importance").count() >= 1 and {r.grp for r in again.read("consensus_group_importance").collect()} == {"x", "y"}
    # Another option runs what depends on it again, and only that.
    got = again.run(plan(alpha=2.0))
    assert [k for k, v in got.items() if v == "done"] == ["importance", "consensus_importance", "groups", "consensus_groups"]
    # Thresholds that nothing passes leave no consensus: the old one goes, and what reads it waits.
    got = again.run(plan(alpha=2.0, least_prob=1.1))
    assert got["consensus"] == "done" and got["consensus_importance"] == "waiting" and got["consensus_groups"] == "waiting" and got["importance"] == "kept"
    # Other data run all again; a table that is lost runs its stage again.
    again.put("data", data.where("id < 200"))
    assert again.run(plan()[:2]) == {"learn": "done", "importance": "done"}
    again.fs.delete_dir(f"{again.base}/importance")
    assert again.run(plan()[:2]) == {"learn": "kept", "importance": "done"}
    assert "bootstrap" in json.loads(open(f"{tmp_path}/s/manifest.json").read())


def test_stages_wait_for_what_is_missing(spark, tmp_path):
    study = stages.Study(spark, str(tmp_path / "empty"))
    assert set(study.run(plan()).values()) == {"waiting"}


def test_record_with_pairs_and_checks(spark, tmp_path):
    truth, pred = [(0, 1), (1, 2)], [(1, 0), (1, 2)]
    whole = workflow.evaluation_record(spark, 3, truth, pred).first()
    some = workflow.evaluation_record(spark, 3, truth, pred, pairs=[(1, 2), (2, 1)]).first()
    # SID is about the whole networks, whatever pairs the other metrics are restricted to.
    assert some.sid == whole.sid is not None and some.n_true_not_evaluable == 1 and whole.n_true_not_evaluable == 0
    net = evaluation.Network(list("abc"), [["0", "1"]] * 3, [[], [0], [1]], [np.full((1, 2), 0.5), np.full((2, 2), 0.5), np.full((2, 2), 0.5)])
    good = spark.createDataFrame([(i % 2, i % 2, i % 2) for i in range(50)], "a int, b int, c int")
    record = workflow.evaluation_record(spark, 3, truth, pred, net=net, data=good, extra={"preset": "x"})
    assert record.first().kl > 0
    with pytest.raises(ValueError, match="does not have"):
        workflow.evaluation_record(spark, 3, truth, pred, net=net, data=good.withColumn("b", F.lit(2)))
    assert workflow.evaluation_record(spark, 3, truth, pred, net=net, data=good, max_states=4).first().kl is None
    cyclic = workflow.evaluation_record(spark, 2, [(0, 1), (1, 0)], [(0, 1)])
    workflow.write_record(cyclic.withColumn("preset", F.lit("y")), str(tmp_path / "r"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "r.tsv")).collect()]
    assert len(lines) == 2 and dict(zip(lines[0].split("\t"), lines[1].split("\t"), strict=True))["kl"] == "NA"
    back = json.loads(spark.read.text(str(tmp_path / "r.json")).first().value)
    assert back["kl"] is None and back["true_is_dag"] == 0 and back["preset"] == "y"


def test_samples_of_a_sweep_do_not_depend_on_partitions(spark, data):
    one, other = (
        workflow.sweep(spark, {"d": df.select("a", "b", "c")}, Config(tabu_tenure=0, assoc_rows=0), sizes=[60], reps=2, score=["bic"]).orderBy("rep").collect() for df in (data, data.repartition(3).orderBy("c"))
    )
    assert [tuple(r) for r in one] == [tuple(r) for r in other] and not math.isclose(one[0].score, one[1].score)


def test_orientation(spark):
    genes = spark.createDataFrame([(f"g{i}", "1000", str(i), "0.5") for i in range(9)] + [("g9", "x", "1", "2")], "gene_id string, gene_length string, s1 string, s2 string")
    got = profile.orientation(genes)
    assert got["genes_in_rows"] and got["evidence"] == [True, True, True] and got["samples"] == ["s1", "s2"] and set(got["annotations"]) == {"gene_id", "gene_length"}
    turned = spark.createDataFrame([(1, 2, 3)], "A int, B int, C int")
    got = profile.orientation(turned)
    assert not got["genes_in_rows"] and got["evidence"] == [False, False, False] and got["samples"] == ["A", "B", "C"]
    assert profile.orientation(turned.limit(0))["genes_in_rows"] is False
