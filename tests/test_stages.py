"""How the stage tables are written."""

import pytest

from refloom.plans import derived as D
from refloom.session import METHOD_CONF, METHOD_LIMIT


def test_stages_are_written_with_methods_that_the_jvm_compiles(spark, sf, monkeypatch):
    seen, own = [], spark.conf.get(METHOD_CONF)

    def failing(df, path):
        seen.append(df.sparkSession.conf.get(METHOD_CONF))
        raise OSError("full")

    monkeypatch.setattr(D, "write_stage", failing)
    with pytest.raises(OSError):
        D._stage(spark, sf, "of-a-test", D.ARTICLES)
    assert seen == [METHOD_LIMIT] and spark.conf.get(METHOD_CONF) == own
