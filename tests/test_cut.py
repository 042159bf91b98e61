"""What queries write on their way goes with the scope around them."""

import os

import pytest

from lumenfold.plans import catalog, cut

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["preprocess_chain", "sirt_tiled", "array_block", "checkpoint_slices"])
def test_a_scope_deletes_what_was_written(spark, name):
    top = cut.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(top))
    with cut.stashes():
        rows = catalog.QUERIES[name](spark, DATA).collect()
        assert rows and set(os.listdir(top)) > before
    assert set(os.listdir(top)) <= before


def test_scopes_within_scopes_and_errors(spark):
    with pytest.raises(ValueError), cut.stashes():
        kept = cut.stash(spark.range(3), "outer")
        with cut.stashes():
            gone = cut.stash(spark.range(3), "inner")
        assert not os.path.exists(gone.stash_path.removeprefix("file://")) and kept.count() == 3
        raise ValueError
    assert not os.path.exists(kept.stash_path.removeprefix("file://"))
    assert cut.stash(spark.range(2), "free").count() == 2
