from __future__ import annotations

import numpy as np

from pulsegrid.llm import toxicity


def test_a_cut_sample_keeps_the_share_of_toxic_documents(spark):
    ids = range(900)
    table = spark.createDataFrame([(i, "plain words that mark nothing") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, int(i % 10 == 0)) for i in ids], "doc_id long, quality int, toxic int")
    held = {r["doc_id"] for r in table.where(toxicity.held_out()).collect()}
    known = [int(i % 10 == 0) for i in ids if i not in held]
    assert abs(toxicity.fit(table, labels, most=60).empty - sum(known) / len(known)) < 1e-9  # about half before


def test_votes_and_calibration_count_what_examples_stand_for():
    one = (np.array([0]), np.array([1.0]))
    model = toxicity.Model([], np.array([5]), np.array([1.0]))
    model.build([one] * 4, [1, 1, 0, 0], [1, 2, 3, 4], (9.0, 1.0))
    assert abs(model.vote(*model.nearest([one])[0], False) - 0.1) < 1e-12
    model.calibrate(np.array([0.1, 0.1, 0.2, 0.2]), np.array([1.0, 1.0, 0.0, 0.0]), False, (9.0, 1.0))
    assert abs(float(np.interp(0.1, *model.steps[False])) - 0.1) < 1e-12
