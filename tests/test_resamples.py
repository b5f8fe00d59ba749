"""The registered queries resample as often, and grow as many trees, as the operators' defaults say."""

import inspect

import pytest

from cohortis.operators import ml, stats
from cohortis.plans import inference

CASES = [("bootstrap_ci", stats, "bootstrap_ci", "n_boot", 2000), ("paired_table", stats, "paired_table", "n_boot", 2000), ("seen_unseen_table", stats, "unpaired_table", "n_boot", 2000), ("gain_unseen_table", stats, "unpaired_table", "n_boot", 2000), ("agreement_table", stats, "agreement", "n_boot", 2000), ("bias_by_scanner", stats, "bias_by_scanner", "n_boot", 2000), ("isolation_forest", ml, "isolation_forest", "trees", 500)]


@pytest.mark.parametrize("query,module,name,parameter,want", CASES, ids=[c[0] for c in CASES])
def test_whole_number_of_draws(spark, data, monkeypatch, query, module, name, parameter, want):
    shape, seen = inspect.signature(getattr(module, name)), []

    def told(*args, **kwargs):
        bound = shape.bind(*args, **kwargs)
        bound.apply_defaults()
        seen.append(bound.arguments[parameter])

    monkeypatch.setattr(module, name, told)
    getattr(inference, query)(spark, data)
    assert seen == [want]
