"""The queries over vectors see every draw of each pair."""

from lagpair.operators import folds
from lagpair.plans import bindings as B
from lagpair.plans.queries import QUERIES


def test_every_draw_is_an_example(spark, sf_dir):
    examples = B.event_examples(spark, sf_dir).count()
    rows = B.vector_pairs(spark, sf_dir)
    assert rows.count() == examples == rows.select("id", "before", "after").distinct().count() * B.DRAWS
    projected = QUERIES["project_deltas"](spark, sf_dir)
    assert projected.count() == examples and projected.select("draw").distinct().count() == B.DRAWS
    attentive = QUERIES["delta_attentive"](spark, sf_dir)
    assert attentive.where("dim = 0").count() == examples and attentive.select("draw").distinct().count() == B.DRAWS


def test_the_head_is_scored_on_every_draw_of_the_test_fold(spark, sf_dir):
    fold = folds.fold_map(B.event_pairs(spark, sf_dir), B.FOLDS, B.SEED)
    test = folds.split(B.event_examples(spark, sf_dir).join(fold, "id"), B.TEST_FOLD)[1]
    assert QUERIES["train_linear_head"](spark, sf_dir).first()["n"] == test.count()
